"""Quality rules whose cutoffs follow the corpus: quantile sketches per language and source instead of fixed numbers.

A sketch is a histogram that keeps the leading bits of a value, so a bucket is narrow next to its value, the number of
buckets is bounded, and sketches merge by adding counts. A language and source with few documents borrows the sketch
of its language, and that of the whole corpus if need be. From the merged sketch come the median and the lower
quartile of each measure; a document is out if it lies many of these distances beyond the median. The lower half sets
the scale because junk sits above it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gravitas.llm import text as tx

SYMBOLS = "#*$%&|<>"
#: Fixed limits of the base rules.
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Leading bits that a sketch keeps: buckets are at most 1/512 of their value wide.
LEADING_BITS = 10
#: Documents that a sketch needs to speak for itself.
ENOUGH = 200
#: A document is out beyond the median by so many distances between lower quartile and median.
REACH = 12
#: Smallest distance of each measure (thousandths), for groups where most documents agree. A word's length may also be
#: too small; of the other measures, only too much is a fault.
MEASURES = {"word_length": 100, "symbols": 10, "dup_lines": 45, "repeat_words": 35}


def _per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate(([0], np.cumsum(flags)))[offsets])


def repeated_in_windows(grams: np.ndarray, size: int) -> int:
    """Units covered by windows whose hash occurs twice or more."""
    order = np.argsort(grams, kind="stable")
    same = grams[order[1:]] == grams[order[:-1]]
    if not same.any():
        return 0
    hit = np.zeros(len(grams) + size - 1, bool)
    again = np.concatenate((order[1:][same], order[:-1][same]))
    for i in range(size):
        hit[again + i] = True
    return int(hit.sum())


def measured(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` without its text, with counts of words, their characters, symbols, lines and repeats."""
    symbol, inner = np.zeros(256, bool), (np.arange(256) & 0xC0) == 0x80
    symbol[[ord(c) for c in SYMBOLS]] = True
    names = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]
    schema = docs.drop(text_col, *names).select("*", *(F.lit(0).cast("long").alias(n) for n in names)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tx.pieces(batch, text_col):
                data, offsets = tx.bytes_of(part.column(text_col))
                starts, ends, first = tx.word_bounds(data, offsets)
                grams = tx.gram_hashes(tx.span_hashes(data, starts, ends), 3)
                lines, dups = [], []
                for a, b in zip(offsets[:-1], offsets[1:]):
                    full = [x for x in data[a:b].tobytes().split(b"\n") if x.split(None, 1)]
                    lines.append(len(full))
                    dups.append(len(full) - len(set(full)))
                repeats = [repeated_in_windows(grams[a : b - 2], 3) if b - a > 2 else 0 for a, b in zip(first[:-1], first[1:])]
                solid = ~(tx.IS_SPACE | inner)[data]
                columns = [np.diff(first), _per_text(solid, offsets), _per_text(symbol[data], offsets), lines, dups, repeats]
                rest = [part.column(n) for n in schema.names[: -len(names)]]
                yield pa.RecordBatch.from_arrays([*rest, *(pa.array(c, pa.int64()) for c in columns)], names=schema.names)

    return docs.select(*schema.names[: -len(names)], text_col).mapInArrow(run, schema)


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def measures() -> dict[str, Column]:
    """Thousandths, as whole numbers; null without words."""
    share = lambda a, b: F.expr(f"1000 * {a} div nullif({b}, 0)")
    return {"word_length": share("word_chars", "n_words"), "symbols": share("n_symbols", "n_words"), "dup_lines": share("n_dup_lines", "n_lines"), "repeat_words": share("n_repeat_words", "n_words")}


def leading(value: Column) -> Column:
    """The value with all but its leading bits set to zero: the lower end of its bucket."""
    low = F.pow(F.lit(2.0), F.greatest(F.length(F.bin(value)) - LEADING_BITS, F.lit(0))).cast("long")
    return value - F.pmod(value, low)


def sketches(rows: DataFrame) -> DataFrame:
    """``lang, source, measure, bucket, n`` over documents that pass the base rules."""
    each = F.array(*(F.struct(F.lit(name).alias("measure"), leading(value).alias("bucket")) for name, value in measures().items()))
    return rows.where(~base_failed()).select("lang", "source", F.inline(each)).groupBy("lang", "source", "measure", "bucket").agg(F.count(F.lit(1)).alias("n"))


def merge(sketch: DataFrame, *by: str) -> DataFrame:
    return sketch.groupBy(*by, "measure", "bucket").agg(F.sum("n").alias("n"))


def quantiles(sketch: DataFrame, *by: str) -> DataFrame:
    """``measure, docs, q1, q2``: size, lower quartile and median of each sketch, by a running sum of its buckets."""
    group = ", ".join([*by, "measure"])
    ranked = sketch.selectExpr("*", f"sum(n) over (partition by {group} order by bucket) as upto", f"sum(n) over (partition by {group}) as docs")
    return ranked.groupBy(*by, "measure", "docs").agg(F.min(F.when(4 * F.col("upto") >= F.col("docs"), F.col("bucket"))).alias("q1"), F.min(F.when(2 * F.col("upto") >= F.col("docs"), F.col("bucket"))).alias("q2"))


def cutoffs(sketch: DataFrame) -> DataFrame:
    """``lang, source`` and for each measure ``<measure>_lo, <measure>_hi``."""
    own = quantiles(sketch, "lang", "source")
    of_lang = quantiles(merge(sketch, "lang"), "lang").select(F.col("lang").alias("l_lang"), F.col("measure").alias("l_measure"), F.col("docs").alias("l_docs"), F.col("q1").alias("l_q1"), F.col("q2").alias("l_q2"))
    of_all = quantiles(merge(sketch)).select(F.col("measure").alias("a_measure"), F.col("q1").alias("a_q1"), F.col("q2").alias("a_q2"))
    both = own.join(of_lang, (F.col("measure") == F.col("l_measure")) & F.col("lang").eqNullSafe(F.col("l_lang"))).join(of_all, F.col("measure") == F.col("a_measure"))
    pick = lambda q: F.when(F.col("docs") >= ENOUGH, F.col(q)).when(F.col("l_docs") >= ENOUGH, F.col(f"l_{q}")).otherwise(F.col(f"a_{q}"))
    floor = F.create_map(*(F.lit(x) for pair in MEASURES.items() for x in pair))
    reach = REACH * F.greatest(pick("q2") - pick("q1"), floor[F.col("measure")])
    at = both.select("lang", "source", "measure", pick("q2").alias("q2"), reach.alias("reach"))
    ends = [(F.max(F.when(F.col("measure") == m, F.col("q2") - F.col("reach"))).alias(f"{m}_lo"), F.max(F.when(F.col("measure") == m, F.col("q2") + F.col("reach"))).alias(f"{m}_hi")) for m in MEASURES]
    return at.groupBy("lang", "source").agg(*(x for pair in ends for x in pair))


def apply_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """``doc_id, lang, source``, the counts of ``measured``, ``base_failed``, ``faults`` (measures out of bounds), ``kept``.

    Every row is judged for itself, so repeated rows and ids give equal results (and count in the sketches as often as
    they stand there). A null or empty text has no words and fails the base rules. A null language or source is a
    group of its own. An empty table gives an empty result. Only the four named columns are read.
    """
    named = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"), F.col(text_col).alias("text"))
    rows = tx.kept(tx.written(measured(named), "measured"))
    cuts = cutoffs(tx.kept(tx.written(sketches(rows), "sketches")))
    renamed = cuts.withColumnsRenamed({"lang": "c_lang", "source": "c_source"})
    joined = rows.join(renamed, F.col("lang").eqNullSafe(F.col("c_lang")) & F.col("source").eqNullSafe(F.col("c_source")), "left")
    outside = [F.when((value > F.col(f"{m}_hi")) | (F.lit(m == "word_length") & (value < F.col(f"{m}_lo"))), F.lit(m)) for m, value in measures().items()]
    judged = joined.withColumn("base_failed", base_failed()).withColumn("faults", F.array_compact(F.array(*outside)))
    return judged.select(*rows.columns, "base_failed", "faults", (~F.col("base_failed") & (F.size("faults") == 0)).alias("kept"))
