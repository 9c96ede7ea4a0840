"""Phrase collocations: counts of all phrases of 1 to 4 words per language, and the phrases that hold together best.

A Rabin-Karp fingerprint of every phrase comes from prefix sums of a polynomial over the text's bytes. Fingerprints are
counted inside each block of text, then by a shuffle, length by length: a phrase is only looked at if the parts counted
before it may be frequent. What a task has to know of these is a table of bits of bounded size (``Sieve``); a bit set
by another phrase costs time, never a result. In the end the texts are read once more. Every fingerprint that may be
frequent points to its first occurrence in a block, the other occurrences are compared with that text, so that
colliding phrases part, and each block sends every such phrase once, with its count. Phrases are counted by their text.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gravitas.llm import text as tx
from gravitas.llm.sieve import SIEVE_BITS, Sieve, sieve_of

LONGEST = 4
#: A phrase must occur so often in its language.
LEAST = 30
#: Phrases reported per language.
TOP = 2000
#: A phrase goes if a longer one that holds it has at least this share of its occurrences, in percent.
SWALLOWED = 80
SCALE = 2_000_000
#: Bits of a fingerprint. It only says what may be frequent, so a collision costs time alone.
PRINT_BITS = 40
BLOCK_BYTES = 4 << 20
NO_LANGUAGE = "und"

#: What ends a piece of text, and all that parts words, as a table that turns both into spaces.
BREAKS = np.zeros(256, bool)
BREAKS[list(b".,;:!?\n\x0b\x0c\r")] = True
PLAIN = np.where(BREAKS, np.uint8(32), tx.LOWER).astype(np.uint8)

_BASE = 0x9E3779B97F4A7C15
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    if len(_powers.get("up", ())) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            _powers[name] = np.multiply.accumulate(table)
    return _powers["up"], _powers["down"]


class Block:
    """The words of some texts: lower case, one space after each, with their places and languages."""

    def __init__(self, part: pa.RecordBatch):
        data, offsets = tx.bytes_of(part.column("text"))
        starts, ends, self.first = tx.word_bounds(PLAIN[data], offsets)
        self.data, self.at = tx.join_spans(np.append(PLAIN[data], np.uint8(32)), starts, ends + 1)
        self.data[self.at[1:] - 1] = 32
        self.row = tx.owners(self.first)
        broken = np.concatenate(([0], np.cumsum(BREAKS[data])))[starts]
        #: Whether a word and the next one stand in one piece.
        self.linked = np.append((self.row[1:] == self.row[:-1]) & (broken[1:] == broken[:-1]), False)[: len(starts)]
        lang = part.column("lang").dictionary_encode()
        self.langs = [x if x is not None else NO_LANGUAGE for x in lang.dictionary.to_pylist()]
        code = lang.indices.fill_null(len(self.langs)).to_numpy(zero_copy_only=False)
        self.langs.append(NO_LANGUAGE)
        self.lang = code[self.row]
        self.numbers = np.zeros(0, np.int32)
        up, self.down = powers(len(self.data) + 1)
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * up[: len(self.data)], dtype=np.uint64)))
        self.salt = np.array([int.from_bytes(blake2b(x.encode(), digest_size=8).digest(), "little") for x in self.langs], np.uint64)

    def places(self, size: int, parts: np.ndarray | None = None, part_size: int = 1) -> np.ndarray:
        """Words at which a phrase of ``size`` words begins, of whose parts all may be frequent if ``parts`` says so."""
        n = max(0, len(self.row) - size + 1)
        inside = np.ones(n, bool)
        for i in range(size - 1):
            inside &= self.linked[i : i + n]
        for i in range(size - part_size + 1 if parts is not None else 0):
            inside &= parts[i : i + n]
        return np.flatnonzero(inside)

    def fingerprints(self, places: np.ndarray, size: int) -> np.ndarray:
        lo, hi = self.at[places], self.at[places + size] - 1
        rolled = (self.sums[hi] - self.sums[lo]) * self.down[lo] + (hi - lo).astype(np.uint64)
        return tx.mix(tx.mix(rolled) ^ self.salt[self.lang[places]]) >> np.uint64(64 - PRINT_BITS)

    def passing(self, sieve: Sieve, size: int) -> np.ndarray:
        """For every word whether the phrase of ``size`` words that begins there may be frequent."""
        out = np.zeros(len(self.row), bool)
        places = self.places(size)
        out[places] = sieve.has(self.fingerprints(places, size))
        return out


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    for batch in batches:
        for part in tx.pieces(batch, "text", BLOCK_BYTES):
            yield Block(part)


def frequent_prints(docs: DataFrame, sizes: list[int], least: int, bits: int, part_size: int = 0, parts: Sieve | None = None) -> Sieve:
    """A sieve of the fingerprints found ``least`` times: no phrase of these sizes that is frequent is missing."""
    shared = docs.sparkSession.sparkContext.broadcast(parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            known = block.passing(shared.value, part_size) if shared.value else None
            for size in sizes:
                prints, n = np.unique(block.fingerprints(block.places(size, known, part_size), size), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(prints.view(np.int64)), pa.array(n)], names=["key", "n"])

    counted = docs.mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    with tx.scratch():
        return sieve_of(tx.written(counted.where(F.col("n") >= least).select("key"), "prints"), bits)


def distinct_phrases(block: Block, places: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """First place and count of each phrase. Occurrences with one fingerprint are compared as words with the first of
    them; those that differ stand for themselves."""
    prints = block.fingerprints(places, size)
    _, first, group, n = np.unique(prints, return_index=True, return_inverse=True, return_counts=True)
    group, leader = group.reshape(-1), places[first]
    same = block.lang[places] == block.lang[leader[group]]
    for i in range(size):
        same &= block.numbers[places + i] == block.numbers[leader[group] + i]
    other = places[~same]
    return np.concatenate((leader, other)), np.concatenate((n - np.bincount(group[~same], minlength=len(n)), np.ones(len(other), np.int64)))


def counted_phrases(docs: DataFrame, sieves: dict[int, Sieve]) -> DataFrame:
    """``key, n`` per block for phrases that pass, and for all words of a language; see ``phrase_key``."""
    shared = docs.sparkSession.sparkContext.broadcast(sieves)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sieves = shared.value
        for block in blocks(batches):
            heads = pa.array([f"{lang}\n" for lang in block.langs])
            yield pa.RecordBatch.from_arrays([heads, pa.array(np.bincount(block.lang, minlength=len(block.langs)))], names=["key", "n"])
            known = {part: block.passing(sieve, part) for part, sieve in sieves.items() if part < 3}
            block.numbers = tx.binary_array(block.data, block.at).dictionary_encode().indices.to_numpy()
            for size in range(1, LONGEST + 1):
                places = block.places(size, known[min(size, 2)], min(size, 2))
                if size > 2:
                    places = places[sieves[3].has(block.fingerprints(places, size))]
                first, n = distinct_phrases(block, places, size)
                text = tx.binary_array(*tx.join_spans(block.data, block.at[first], block.at[first + size] - 1), pa.string())
                key = pc.binary_join_element_wise(heads.take(pa.array(block.lang[first])), text, "")
                yield pa.RecordBatch.from_arrays([key, pa.array(n)], names=["key", "n"])

    return docs.mapInArrow(run, "key string, n long")


def phrase_counts(docs: DataFrame, least: int = LEAST, bits: int = SIEVE_BITS) -> DataFrame:
    """``lang, size, phrase, n`` for phrases of 1 to 4 words found at least ``least`` times in their language, and a row
    of size 0 with an empty phrase and the number of all words of each language.

    The key that is shuffled is the language, a line break (no word holds one) and the phrase.
    """
    words = frequent_prints(docs, [1], least, bits)
    pairs = frequent_prints(docs, [2], least, bits, 1, words)
    longer = frequent_prints(docs, [3, 4], least, bits, 2, pairs)
    total = counted_phrases(docs, {1: words, 2: pairs, 3: longer}).groupBy("key").agg(F.sum("n").alias("n"))
    phrase = F.substring_index("key", "\n", -1)
    lang = F.expr("left(key, char_length(key) - char_length(phrase) - 1)")
    size = F.when(F.col("phrase") == "", 0).otherwise(F.size(F.split("phrase", " ", -1)))
    return total.withColumn("phrase", phrase).select(lang.alias("lang"), size.alias("size"), "phrase", "n").where((F.col("n") >= least) | ((F.col("size") == 0) & (F.col("n") > 0)))


def scored(counts: DataFrame) -> DataFrame:
    """Phrases of two words and more with the counts ``l`` and ``r`` of the parts at their weakest cut, and its score."""
    words = F.split("phrase", " ", -1)
    part = lambda a, n: F.array_join(F.slice(words, a, n), " ")
    cut = lambda k: F.struct(k.alias("k"), part(F.lit(1), k).alias("left"), part(k + 1, F.col("size") - k).alias("right"))
    cuts = counts.where("size >= 2").select("lang", "size", "phrase", F.col("n").alias("a"), F.inline(F.transform(F.sequence(F.lit(1), F.col("size") - 1), cut)))
    side = lambda name, n: counts.where(f"size between 1 and {LONGEST - 1}").select("lang", F.col("phrase").alias(name), F.col("n").alias(n))
    both = cuts.join(side("left", "l"), ["lang", "left"]).join(side("right", "r"), ["lang", "right"])
    score = F.expr(f"cast({SCALE} as decimal(7,0)) * cast(a as decimal(20,0)) div (cast(l as decimal(20,0)) + r)")
    weakest = both.groupBy("lang", "size", "phrase").agg(F.first("a").alias("a"), F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    return weakest.select("lang", "size", "phrase", "a", "cut.l", "cut.r", "cut.score")


def swallowed(counts: DataFrame) -> DataFrame:
    """``lang, phrase, longer``: the greatest count of a longer phrase that holds it."""
    words, size = F.split("phrase", " ", -1), F.col("size")
    inner = lambda n: F.transform(F.sequence(F.lit(1), size - n + 1), lambda i: F.array_join(F.slice(words, i, n), " "))
    parts = F.flatten(F.transform(F.sequence(F.lit(2), size - 1), inner))
    return counts.where("size >= 3").select("lang", "n", F.explode(parts).alias("phrase")).groupBy("lang", "phrase").agg(F.max("n").alias("longer"))


def mine_phrases(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, top: int = TOP, bits: int = SIEVE_BITS) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the ``top`` phrases of 2 to 4 words of each language.

    A-Z count as lower case; words are parted by spaces and tabs, and a phrase lies between two marks of ``.,;:!?`` or
    line breaks. ``a`` is the number of a phrase's occurrences (overlaps included, ``least`` at least), ``l`` and ``r``
    those of the two parts of its weakest cut, ``n`` all words of the language, ``score`` 2,000,000 a / (l + r), rounded
    down; of equal cuts the first counts. A phrase inside a longer one with 80 % of its occurrences is left out. Order:
    score, a (both falling), phrase. Texts that are null or empty have no words; a null language is ``und``. Every row
    counts, so repeated rows count as often as they stand there. An empty table gives an empty result. Only the two
    named columns are read.
    """
    plain = docs.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    with tx.scratch():
        counts = tx.written(phrase_counts(plain, least, bits), "phrases")
        ranked = scored(counts).join(swallowed(counts), ["lang", "phrase"], "left")
        kept = ranked.where(f"longer is null or 100 * cast(longer as decimal(20,0)) < {SWALLOWED} * cast(a as decimal(20,0))")
        order = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
        best = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
        whole = counts.where("size = 0").select("lang", F.col("n").alias("whole"))
        out = best.join(whole, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", F.col("whole").alias("n"), "score")
        return tx.kept(tx.written(out, "collocations"))
