"""BPE encoding and decoding with a vocabulary of word pieces.

A word is encoded by taking, from left to right, the longest token that an Aho-Corasick automaton finds, as long as it
may stand after the token before it; otherwise a shorter one, or a step back. Two tokens may stand side by side if no
merge across their border comes before the merges that made them; the merge list decides this and answers are kept.
So every word gets exactly the tokens that applying all merges in order would give, in time linear in its length.
Decoding copies token strings out of one buffer through a table of offsets.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gravitas.llm.text import binary_array, join_spans, list_array, pieces

END = "\x00"
WORDS_KEPT = 200_000
#: Longer words, such as addresses or encoded data, are encoded every time.
LONGEST_KEPT = 64
PAIRS_KEPT = 300_000


def byte_letters() -> list[str]:
    """The printable character that byte-level vocabularies use for each byte."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in kept else chr(next(others)) for b in range(256)]


class Strings:
    """Texts behind one table of offsets; ``take`` joins any selection of them."""

    def __init__(self, texts: list[bytes]):
        self.data = np.frombuffer(b"".join(texts), np.uint8)
        self.offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)

    def take(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return join_spans(self.data, self.offsets[ids], self.offsets[ids + 1])


class WordBpe:
    """A tokenizer file of the kind: NFC, lower case, words by a pattern, byte letters, merges with a word end."""

    def __init__(self, spec: str):
        whole = json.loads(spec)
        model, suffix = whole["model"], whole["model"].get("end_of_word_suffix")
        if model["type"] != "BPE" or not suffix:
            raise ValueError("the file is no BPE vocabulary with word ends")
        vocab = model["vocab"]
        inner = lambda t: t[: -len(suffix)] + END if t.endswith(suffix) and t != suffix else t
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        made = {a + b for a, b in merges}
        #: Tokens are numbered in the order in which merges make them; single letters come first.
        order = [t for t in vocab if t not in made] + [a + b for a, b in merges]
        number = {t: i for i, t in enumerate(order)}
        if len(number) != len(order):
            raise ValueError("two merges make the same token")
        self.letters = len(order) - len(merges)
        self.ids = [vocab[t] for t in order]
        self.texts = [inner(t) for t in order]
        self.pair = {(number[a], number[b]): self.letters + i for i, (a, b) in enumerate(merges)}
        self.left = [*range(self.letters), *(number[a] for a, _ in merges)]
        self.right = [*range(self.letters), *(number[b] for _, b in merges)]
        self.found = {t: i for i, t in enumerate(self.texts)}
        self.automaton = ahocorasick.Automaton()
        for t, i in self.found.items():
            self.automaton.add_word(t, i)
        self.automaton.make_automaton()
        self.shorter = [next((self.found[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in self.found), -1) for t in self.texts]
        self.fits: dict[tuple[int, int], bool] = {}
        self.known: dict[str, bytes] = {}

        added = {t["content"]: t["id"] for t in whole.get("added_tokens", [])}
        self.added = {t: np.uint32(i).tobytes() for t, i in added.items()}
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        pattern = next(p["pattern"]["Regex"] for p in whole["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(pattern.replace(r"\s", r"\p{White_Space}"))
        self.byte_letters = byte_letters()
        strings = {i: t for t, i in (vocab | added).items()}
        size = max(strings, default=-1) + 1
        self.strings = Strings([strings.get(i, "").encode() + b" " for i in range(size)])

    def side_by_side(self, left: int, right: int) -> bool:
        """Whether merging in order leaves the border between two tokens as it is."""
        if (known := self.fits.get((left, right))) is not None:
            return known
        a, b, before, answer = left, right, len(self.texts), True
        while True:
            if self.pair.get((a, b), before) < before:
                answer = False
                break
            # Take back the later of the merges that end at the border; of equal ones the right is later.
            if max(a, b) < self.letters:
                break
            if a > b:
                a, before = self.right[a], a
            else:
                b, before = self.left[b], b + 1
        if len(self.fits) >= PAIRS_KEPT:
            self.fits.clear()
        self.fits[left, right] = answer
        return answer

    def encode_letters(self, word: str) -> list[int]:
        """Token ids of one word in byte letters, its end mark included."""
        n = len(word)
        longest = [-1] * n
        for last, token in self.automaton.iter(word):  # later finds are longer ones
            longest[last + 1 - len(self.texts[token])] = token
        dead, out, at, token = bytearray(n + 1), [], 0, longest[0]
        while at < n:
            before = out[-1] if out else -1
            while token >= 0:
                to = at + len(self.texts[token])
                if not dead[to] and (before < 0 or self.side_by_side(before, token)):
                    break
                token = self.shorter[token]
            if token >= 0:
                out.append(token)
                at = to
                token = longest[at] if at < n else -1
            else:
                dead[at] = 1
                token = out.pop()
                at -= len(self.texts[token])
        return [self.ids[t] for t in out]

    def encode_word(self, word: str) -> bytes:
        """Token ids of one word as little-endian 32-bit numbers, kept for the next time."""
        letters = word if word.isascii() and word.isalnum() else "".join(self.byte_letters[b] for b in word.encode())
        ids = np.array(self.encode_letters(letters + END), "<u4").tobytes()
        if len(word) <= LONGEST_KEPT:
            if len(self.known) >= WORDS_KEPT:
                self.known.clear()
            self.known[word] = ids
        return ids

    def encode(self, text: str | None) -> np.ndarray:
        known, encode, parts = self.known, self.encode_word, []
        for i, part in enumerate(self.split.split(text or "") if self.split else [text or ""]):
            if i % 2:
                parts.append(self.added[part])
                continue
            # Lower case letter by letter: only the capital sigma would depend on what follows.
            plain = unicodedata.normalize("NFC", part).replace("Σ", "σ").lower()
            parts += [known.get(w) or encode(w) for w in self.words.findall(plain)]
        return np.frombuffer(b"".join(parts), "<u4").astype(np.int32)

    def decode(self, ids: np.ndarray) -> bytes:
        """Token strings joined by one space: the file names no decoder."""
        return self.strings.take(ids)[0].tobytes()[:-1]


def load(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def encode_documents(docs: DataFrame, text_col: str = "text", path: str | None = None) -> DataFrame:
    """``docs`` with ``ids`` (array of int) and ``decoded`` (string) for the whole text of each row.

    ``path`` names the vocabulary on the driver; its content travels to the tasks as a broadcast whose size is that of
    the file. Null and empty texts give an empty array and an empty string; each row stands for itself, so repeated
    rows and ids give equal results. Other columns stay, except any of the names ``ids`` and ``decoded``. Columns of
    the same name must be told apart by the caller first. A task keeps at most ``WORDS_KEPT`` short
    words it has met; what it keeps changes speed alone and ends with the task, as its process lives on for other work.
    """
    spec = docs.sparkSession.sparkContext.broadcast(load(path or public_tokenizers.path("word_bpe_49k.json")))
    kept = docs.drop("ids", "decoded")
    schema = kept.withColumn("ids", F.array(F.lit(0))).withColumn("decoded", F.lit("")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = WordBpe(spec.value)
        for batch in batches:
            for part in pieces(batch, text_col):
                each = [bpe.encode(t) for t in part.column(text_col).to_pylist()]
                sizes = np.array([len(x) for x in each], np.int64)
                ids = np.concatenate(each) if each else np.zeros(0, np.int32)
                data, offsets = bpe.strings.take(ids)
                last = np.cumsum(sizes)
                to, start = offsets[last], offsets[last - sizes]
                decoded = binary_array(*join_spans(data, start, np.maximum(start, to - 1)), pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns, list_array(pa.array(ids, pa.int32()), sizes), decoded], names=schema.names)

    return kept.mapInArrow(run, schema)
