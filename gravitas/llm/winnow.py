"""Benchmark decontamination by winnowing, in DataFrame functions alone.

Of the k-word hashes inside each window of a text only the smallest is kept, so neighbouring windows mostly keep the
same one and a text leaves few fingerprints; but every window leaves one, so no shared window can be missed. The
fingerprints of documents and of benchmark items are joined, and each hit is extended to the words around it and
compared as text. Hash collisions therefore cost time, never a wrong hit.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gravitas.llm.text import kept, unique_documents, written

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10
#: Benchmark windows up to this size are sent to every task; beyond it both sides are shuffled.
BROADCAST_BYTES = 16 << 20


def words_of(text: str) -> Column:
    """Words of letters, digits and everything beyond ASCII, with A-Z in lower case; none for a null text."""
    lower = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    return F.coalesce(F.regexp_extract_all(lower, F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def joined(words: str | Column, start: Column, size: Column | int) -> Column:
    return F.concat_ws(" ", F.slice(words, start + 1, size))


def with_fingerprints(df: DataFrame, window: int, out: str) -> DataFrame:
    """Column ``out``: for each window of the array ``words`` its smallest k-word hash, k being half of the window."""
    k = max(1, window // 2)
    w = window - k + 1
    first = lambda column, n: F.slice(column, 1, F.greatest(F.size(column) - (n - 1), F.lit(0)))
    near = lambda column, i, x, n: [x, *(F.get(F.col(column), i + j) for j in range(1, n))]
    return (
        df.withColumn("_h", F.transform("words", lambda x: F.xxhash64(x)))
        .withColumn("_g", F.transform(first("_h", k), lambda x, i: F.xxhash64(*near("_h", i, x, k))))
        .withColumn(out, F.transform(first("_g", w), lambda x, i: F.least(*near("_g", i, x, w)) if w > 1 else x))
        .drop("_h", "_g")
    )


def with_runs(df: DataFrame, window: int, out: str) -> DataFrame:
    """Column ``out``: runs of windows with the same fingerprint as (f, at, context); the context holds their words."""
    m = F.col("_m")
    starts = F.when(F.size(m) > 0, F.filter(F.sequence(F.lit(0), F.size(m) - 1), lambda i: (i == 0) | (F.get(m, i) != F.get(m, F.greatest(i - 1, F.lit(0))))))
    run = lambda i, j: F.struct(
        F.get(m, i).alias("f"),
        i.alias("at"),
        joined("words", i, F.coalesce(F.get(F.col("_s"), j + 1), F.size(m)) - i + (window - 1)).alias("context"),
    )
    return (
        with_fingerprints(df, window, "_m")
        .withColumn("_s", F.coalesce(starts, F.array().cast("array<int>")))
        .withColumn(out, F.transform("_s", run))
        .drop("_m", "_s")
    )


def each_window(size: int) -> Column:
    return F.transform("_m", lambda f, i: F.struct(f.alias("f"), joined("words", i, size).alias("text")))


def benchmark_windows(items: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """Every window of every item as ``item_id, f, size, text``; an item shorter than a window is one."""
    words = items.select(F.col(id_col).alias("item_id"), words_of(text_col).alias("words")).where(F.size("words") > 0)
    sizes = [r[0] for r in words.select(F.least(F.size("words"), F.lit(window))).distinct().collect()]  # at most ``window`` rows
    parts = []
    for size in sorted(sizes):
        own = words.where(F.size("words") >= window if size == window else F.size("words") == size)
        parts.append(with_fingerprints(own, size, "_m").select("item_id", F.lit(size).alias("size"), F.inline(each_window(size))))
    empty = words.select("item_id", F.lit(0).alias("size"), F.lit(0).cast("long").alias("f"), F.lit("").alias("text")).where("false")
    for part in parts:
        empty = empty.unionByName(part)
    return empty.distinct()


def find_hits(docs: DataFrame, windows: DataFrame, sizes: list[int], broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``doc_id, n_words, start, size, text`` for every place where a benchmark window stands in a document.

    Each document also has one row with a null ``start``, which carries its number of words.
    """
    fingerprints = windows.groupBy("f", "size", "text").count().drop("count").withColumnRenamed("size", "n")
    taken = fingerprints.agg(F.coalesce(F.sum(F.octet_length("text") + 40), F.lit(0))).first()[0]
    read = docs.select("doc_id", words_of("text").alias("words"))
    for size in sizes:
        read = with_runs(read, size, f"_runs{size}")
    #: The document's own row has a key of its own, so that such rows spread evenly if both sides are shuffled.
    own = F.struct(F.xxhash64("doc_id", F.lit("own")).alias("f"), F.lit(-1).alias("at"), F.lit(None).cast("string").alias("context"))
    runs = read.select("doc_id", F.size("words").cast("long").alias("n_words"), F.inline(F.concat(F.array(own), *(f"_runs{s}" for s in sizes))))
    pairs = runs.join(F.broadcast(fingerprints) if taken <= broadcast_bytes else fingerprints, "f", "left")
    pairs = pairs.where("at < 0 or contains(context, text)").withColumn("context", F.split("context", " "))
    places = F.filter(F.sequence(F.lit(0), F.size("context") - F.col("n")), lambda j: joined("context", j, F.col("n")) == F.col("text"))
    found = F.when(F.col("at") < 0, F.array(F.lit(None).cast("int"))).otherwise(F.transform(places, lambda j: j + F.col("at")))
    return pairs.select("doc_id", "n_words", F.explode(found).alias("start"), F.col("n").alias("size"), "text")


def contamination(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW
) -> DataFrame:
    """``doc_id, n_words, spans, items`` for every document: hit word ranges as (start, size), and items found.

    A window is ``window`` consecutive words of an item; a shorter item is one window. Rows that share a document id
    are one document, see ``unique_documents``. Null and empty texts have no words and no hits; empty items cannot
    occur. Items with a null id mark words, but are not listed. Repeated rows of items change nothing. Only the named
    columns are read. With no items every document has no hits.
    """
    windows = benchmark_windows(items, item_col, item_text_col, window)
    sizes = [r[0] for r in windows.select("size").distinct().collect()]  # at most ``window`` rows
    hits = kept(written(find_hits(unique_documents(docs, id_col, text_col), windows, sizes), "hits"))
    spans = hits.groupBy("doc_id").agg(F.max("n_words").alias("n_words"), F.collect_set(F.when(F.col("start").isNotNull(), F.struct("start", "size"))).alias("spans"))
    listed = (
        hits.where("start is not null").select("doc_id", "text").distinct().join(windows.select("text", "item_id").distinct(), "text").groupBy("doc_id").agg(F.collect_set("item_id").alias("items"))
    ).withColumnRenamed("doc_id", "_id")
    none = F.array().cast(listed.schema["items"].dataType)
    return spans.join(listed, F.col("doc_id").eqNullSafe(F.col("_id")), "left").select("doc_id", "n_words", "spans", F.coalesce("items", none).alias("items"))


def covered(spans: str) -> Column:
    """Number of positions inside any of the ranges."""
    return F.size(F.array_distinct(F.flatten(F.transform(spans, lambda s: F.sequence(s["start"], s["start"] + s["size"] - 1))))).cast("long")
