"""Bring equal windows of a corpus together without shuffling every window.

The smallest hash of the short grams inside a window is its anchor. Neighbouring windows mostly share it, so they are
kept as one run; windows with equal content always have equal anchors. Anchors that occur once in the corpus cannot
belong to a repeated window, and only runs of the others are cut out of the texts, as one segment of text each.
Equal segments are merged before they are shuffled to the bucket of their anchor. There an exact method (``Judge``)
marks windows. A bucket with very many different segments is dealt out anew by longer keys: windows whose anchor stands
at about the same place in them have more text in common than the anchor, and that text is their new key. The same
method then marks them. Marks travel back to all places where the segment stands.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gravitas.llm import text as tx
from gravitas.llm.sieve import sieve_of

#: A key with more different segments than this gets longer keys; so many fit into about one block.
FREQUENT = 4000
#: Longer keys hold what windows have in common whose anchor stands at one of so many neighbouring places.
GRAINS = (8, 1)
#: Up to so many recurring anchors go to every task as a sieve (128 MB at most); beyond it they are joined.
SIEVED = 1 << 24
BLOCK_BYTES = 1 << 20


@dataclass(frozen=True)
class Units:
    """What a window consists of.

    ``grams(data, offsets, k)`` gives the hash of every run of k units and the first unit of each text;
    ``packed(data, offsets)`` the bytes of the units, where each begins, and how many bytes are left out where a
    segment ends.
    """

    size: int
    k: int
    grams: Callable[[np.ndarray, np.ndarray, int], tuple[np.ndarray, np.ndarray]]
    packed: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, int]]


#: From segments (one buffer and offsets) with their numbers of copies to marks, one boolean per window, in order.
Judge = Callable[[np.ndarray, np.ndarray, np.ndarray], list[np.ndarray]]


def anchors(data: np.ndarray, offsets: np.ndarray, units: Units) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of grams, the anchor of each window, whether the window lies in one text, the first unit of each text."""
    grams, first = units.grams(data, offsets, units.k)
    anchor = tx.slide(grams, units.size - units.k + 1, np.minimum)
    n = len(anchor)
    inside = np.arange(n) + units.size <= np.repeat(first[1:], np.diff(first))[:n]
    return grams, anchor, inside, first


def find_places(data: np.ndarray, offsets: np.ndarray, units: Units) -> np.ndarray:
    """The anchor at each place that is one: where the largest anchor of the windows around equals the gram."""
    grams, anchor, inside, _ = anchors(data, offsets, units)
    if not len(anchor):
        return np.zeros(0, np.int64)
    w = units.size - units.k + 1
    edge = np.zeros(w - 1, np.uint64)
    top = tx.slide(np.concatenate((edge, np.where(inside, anchor, 0), edge)), w, np.maximum)
    return grams[: len(top)][top == grams[: len(top)]].view(np.int64)


def find_runs(data: np.ndarray, offsets: np.ndarray, units: Units) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one anchor: row, first window, number of windows, anchor."""
    _, anchor, inside, first = anchors(data, offsets, units)
    begins = inside.copy()
    begins[1:] &= (anchor[1:] != anchor[:-1]) | ~inside[:-1]
    at = np.flatnonzero(begins)
    so_far = np.concatenate(([0], np.cumsum(inside)))
    counts = np.diff(np.append(so_far[at], so_far[-1]))
    row = np.searchsorted(first, at, "right") - 1
    return row, at - first[row], counts, anchor[at].view(np.int64)


def anchor_counts(docs: DataFrame, units: Units) -> DataFrame:
    """Anchors that stand at more than one place of the corpus, with how many.

    Places are counted, not runs: one run may hold its anchor twice, in a text that repeats itself.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tx.pieces(batch, "text"):
                key, n = np.unique(find_places(*tx.bytes_of(part.column("text")), units), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n.astype(np.int64))], names=["key", "n"])

    return docs.select("text").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where("n > 1")


def runs_by_document(docs: DataFrame, counts: DataFrame, units: Units) -> DataFrame:
    """``doc_id, runs``: the runs whose anchor occurs again, as array of (at, key); a document's own, no more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tx.pieces(batch, "text"):
                row, start, n, key = find_runs(*tx.bytes_of(part.column("text")), units)
                at = (start.astype(np.int64) << 32) | n
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(row)), pa.array(key), pa.array(at)], names=["doc_id", "key", "at"])

    schema = docs.select("doc_id", F.lit(0).cast("long").alias("key"), F.lit(0).cast("long").alias("at")).schema
    found = docs.select("doc_id", "text").mapInArrow(run, schema).join(counts, "key")
    return found.groupBy("doc_id").agg(F.collect_list(F.struct("at", "key")).alias("runs"))


def same_id(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    """Join on ``doc_id``, a null id being an id like any other; the right side's other columns are added."""
    return left.join(right.withColumnRenamed("doc_id", "_id"), F.col("doc_id").eqNullSafe(F.col("_id")), how).drop("_id")


def with_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """``doc_id, size, packed, spans`` for every document, an empty array where there are no spans.

    A sieve of the ids that have spans tells which texts must meet them; only these are shuffled. That is by a join of
    one kind at every size: a few spans sent to all tasks would only make small tables look cheaper than large ones.
    """
    none = F.array().cast(spans.schema["spans"].dataType)
    shared = docs.sparkSession.sparkContext.broadcast(sieve_of(spans.select(F.xxhash64("doc_id").alias("key"))))
    listed = same_id(tx.packed_texts(docs, lambda key: shared.value.has(key)), spans.hint("merge"), "left")
    others = tx.packed_texts(docs, lambda key: ~shared.value.has(key)).withColumn("spans", none)
    return listed.withColumn("spans", F.coalesce("spans", none)).unionByName(others)


def segments(ids: pa.Array, row: np.ndarray, start: np.ndarray, n: np.ndarray, key: np.ndarray, first: np.ndarray, packed: tuple, units: Units) -> Iterator[pa.RecordBatch]:
    """``doc_id, start, n, key, segment`` of the given runs of some texts."""
    data, starts, gap = packed
    for i in range(0, len(row), 20_000):
        s = slice(i, i + 20_000)
        lo = first[row[s]] + start[s]
        segment = tx.binary_array(*tx.join_spans(data, starts[lo], starts[lo + n[s] + units.size - 1] - gap))
        yield pa.RecordBatch.from_arrays(
            [ids.take(pa.array(row[s])), pa.array(start[s].astype(np.int32)), pa.array(n[s].astype(np.int32)), pa.array(key[s]), segment], names=["doc_id", "start", "n", "key", "segment"]
        )


def segment_schema(docs: DataFrame) -> str:
    return f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, start int, n int, key long, segment binary"


def sieved_segments(docs: DataFrame, counts: DataFrame, units: Units) -> DataFrame:
    """The text of the windows of every run whose anchor passes the sieve of the recurring ones, as one string."""
    shared = docs.sparkSession.sparkContext.broadcast(sieve_of(counts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tx.pieces(batch, "text"):
                data, offsets = tx.bytes_of(part.column("text"))
                row, start, n, key = find_runs(data, offsets, units)
                again = shared.value.has(key.view(np.uint64))
                first = units.grams(data, offsets, 0)[1]
                yield from segments(part.column("doc_id"), row[again], start[again], n[again], key[again], first, units.packed(data, offsets), units)

    return docs.select("doc_id", "text").mapInArrow(run, segment_schema(docs))


def joined_segments(docs: DataFrame, counts: DataFrame, units: Units) -> DataFrame:
    """The same by joins, for more recurring anchors than a sieve should hold."""
    runs = tx.written(runs_by_document(docs, counts, units), "runs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in tx.unpacked(batch):
                listed = part.column("runs")
                flat = listed.flatten()
                row = np.repeat(np.arange(part.num_rows), pc.list_value_length(listed).to_numpy(zero_copy_only=False))
                at, key = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("at", "key"))
                first = units.grams(data, offsets, 0)[1]
                yield from segments(part.column("doc_id"), row, at >> 32, at & 0xFFFFFFFF, key, first, units.packed(data, offsets), units)

    return same_id(tx.packed_texts(docs), runs, "inner").mapInArrow(run, segment_schema(docs))


def blocks(batches: Iterator[pa.RecordBatch], limit: int = BLOCK_BYTES) -> Iterator[pa.Table]:
    """Rows that arrive sorted by ``key``, in tables of about ``limit`` bytes that never part a key."""
    held, size = [], 0
    for batch in batches:
        at = 0
        key = batch.column("key").to_numpy()
        sizes = np.cumsum(pc.binary_length(batch.column("segment")).to_numpy().astype(np.int64) + 64)
        borders = np.flatnonzero(key[1:] != key[:-1]) + 1
        if held and batch.num_rows and held[-1].column("key")[-1].as_py() != key[0]:
            borders = np.concatenate(([0], borders))
        for b in borders:
            now = size + (int(sizes[b - 1]) if b else 0) - (int(sizes[at - 1]) if at else 0)
            if now >= limit:
                yield pa.Table.from_batches([*held, batch.slice(at, b - at)])
                held, size, at = [], 0, b
        if at < batch.num_rows:
            held.append(batch.slice(at))
            size += int(sizes[-1]) - (int(sizes[at - 1]) if at else 0)
    if held:
        yield pa.Table.from_batches(held)


def disputed(block: pa.Table, units: Units) -> np.ndarray:
    """Segments that can hold equal windows: their anchor has other segments, or stands twice in the only one."""
    key = block.column("key").to_numpy()
    grams, first = units.grams(*tx.bytes_of(pa.concat_arrays(block.column("segment").chunks)), units.k)
    row = np.searchsorted(first, np.arange(len(grams)), "right") - 1
    places = np.bincount(row[grams.view(np.int64) == key[row]], minlength=len(key))
    new = np.append(True, key[1:] != key[:-1])
    return ~(new & np.append(new[1:], True)) | (places > 1)


def judged(distinct: DataFrame, units: Units, judge: Judge) -> DataFrame:
    """``key, seg, marks`` for segments with marks: half-open ranges of window numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            block = block.filter(pa.array(disputed(block, units)))
            if not block.num_rows:
                continue
            marks = judge(*tx.bytes_of(pa.concat_arrays(block.column("segment").chunks)), block.column("copies").to_numpy())
            keep, lo, hi, sizes = [], [], [], []
            for i, marked in enumerate(marks):
                if marked.any():
                    edge = np.flatnonzero(np.diff(np.concatenate(([0], marked.view(np.int8), [0]))))
                    keep.append(i)
                    lo.append(edge[::2])
                    hi.append(edge[1::2])
                    sizes.append(len(edge) // 2)
            if keep:
                pair = pa.StructArray.from_arrays([pa.array(np.concatenate(x).astype(np.int32)) for x in (lo, hi)], names=["lo", "hi"])
                part = block.select(["key", "seg"]).take(pa.array(keep)).combine_chunks()
                yield pa.RecordBatch.from_arrays([part.column("key").chunk(0), part.column("seg").chunk(0), tx.list_array(pair, np.array(sizes))], names=["key", "seg", "marks"])

    together = distinct.repartition("key").sortWithinPartitions("key", *(["first"] if "first" in distinct.columns else []), "segment")
    return together.select("key", "segment", "copies", F.xxhash64("segment").alias("seg")).mapInArrow(run, "key long, seg long, marks array<struct<lo:int,hi:int>>")


def refined(distinct: DataFrame, units: Units, grain: int) -> DataFrame:
    """Segments cut into windows whose anchor stands at ``grain`` neighbouring places, with what they share as key.

    Columns of ``distinct`` with the new ``key`` and ``segment``; ``first`` moves along. ``of_key``, ``of_seg``, ``lo``
    and ``hi`` say which windows of which segment these are. The anchor of a window is the first of equal ones, so equal
    windows of all segments get equal keys. With a grain of 1 the key is the hash of a window.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tx.pieces(batch, "segment"):
                data, offsets = tx.bytes_of(part.column("segment"))
                key = part.column("gram").to_numpy()
                grams, first = units.grams(data, offsets, units.k)
                data, starts, gap = units.packed(data, offsets)
                n = np.diff(first) - units.size + 1
                row = np.repeat(np.arange(part.num_rows), n)
                s = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + first[row]
                is_anchor = grams.view(np.int64) == key[np.minimum(np.searchsorted(first, np.arange(len(grams)), "right") - 1, part.num_rows - 1)]
                ahead = np.minimum.accumulate(np.where(is_anchor, np.arange(len(grams)), len(grams))[::-1])[::-1]
                place = ahead[s]
                group = (place - s) // grain
                new = np.ones(len(s), bool)
                new[1:] = (row[1:] != row[:-1]) | (place[1:] != place[:-1]) | (group[1:] != group[:-1])
                at = np.flatnonzero(new)
                end = np.append(at[1:], len(s))
                r, p, g = row[at], place[at], group[at]
                least, most = g * grain, np.minimum((g + 1) * grain, units.size - units.k + 1) - 1
                same = tx.span_hashes(data, starts[p - least], starts[p - most + units.size] - gap)
                child = tx.mix(same + tx.mix(g.astype(np.uint64) + np.uint64(1))).view(np.int64)
                lo, hi = s[at] - first[r], s[end - 1] - first[r] + 1
                piece = tx.binary_array(*tx.join_spans(data, starts[s[at]], starts[s[end - 1] + units.size] - gap))
                given = [part.column(c).take(pa.array(r)) for c in part.schema.names if c != "segment"]
                yield pa.RecordBatch.from_arrays(
                    [*given, pa.array(child), piece, pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32))], names=[*(c for c in part.schema.names if c != "segment"), "child", "segment", "lo", "hi"]
                )

    rest = [c for c in ("gram", "copies", "first") if c in distinct.columns]
    named = distinct.select(*rest, F.col("key").alias("of_key"), F.xxhash64("segment").alias("of_seg"), "segment")
    schema = named.drop("segment").select("*", F.lit(0).cast("long").alias("child"), F.lit(b"").alias("segment"), F.lit(0).alias("lo"), F.lit(0).alias("hi")).schema
    cut = named.mapInArrow(run, schema).withColumnRenamed("child", "key")
    return cut.withColumn("first", F.struct(F.col("first.doc_id").alias("doc_id"), (F.col("first.start") + F.col("lo")).alias("start"))) if "first" in rest else cut


def ranges_of(rows: DataFrame, marks: DataFrame, keep_first: bool) -> DataFrame:
    """``rows`` (``key, seg, place, n``) with what is marked of their windows as ``marks``, those with none left out.

    ``marks`` has ``key, seg, copies, best, marks``: a segment's copies are marked as a whole, but for its first place
    if that is kept; there, and where it stands once, the judge's marks count.
    """
    whole: Column = F.array(F.struct(F.lit(0).alias("lo"), F.col("n").alias("hi")))
    own = F.col("place").eqNullSafe(F.col("best")) if keep_first else F.col("copies") == 1
    return rows.join(marks, ["key", "seg"]).withColumn("marks", F.when(own, F.col("marks")).otherwise(whole)).where("marks is not null").drop("copies", "best")


def with_marks(distinct: DataFrame, units: Units, judge: Judge, frequent: int, grains: tuple[int, ...] = GRAINS) -> DataFrame:
    """``key, seg, copies, best, marks`` for segments that stand twice or have marks."""
    keep_first = "first" in distinct.columns
    marks = judged(distinct, units, judge)
    hot = tx.written(distinct.groupBy("key").count().where(F.col("count") > frequent).select("key"), "hot") if grains else None
    if hot is not None and not hot.isEmpty():
        marks = judged(distinct.join(hot, "key", "left_anti"), units, judge)
        cut = tx.written(refined(distinct.join(hot, "key", "left_semi"), units, grains[0]), "refined")
        best = [F.min("first").alias("first")] if keep_first else []
        inner = tx.written(cut.groupBy("key", "segment").agg(F.sum("copies").alias("copies"), F.min("gram").alias("gram"), *best), "pieces")
        place = F.col("first") if keep_first else F.lit(None).cast("boolean")
        rows = cut.select("key", F.xxhash64("segment").alias("seg"), place.alias("place"), (F.col("hi") - F.col("lo")).alias("n"), "of_key", "of_seg", F.col("lo").alias("shift"))
        found = ranges_of(rows, with_marks(inner, units, judge, frequent, grains[1:]), keep_first)
        each = found.select(F.col("of_key").alias("key"), F.col("of_seg").alias("seg"), "shift", F.inline("marks"))
        moved = F.struct((F.col("lo") + F.col("shift")).alias("lo"), (F.col("hi") + F.col("shift")).alias("hi"))
        marks = marks.unionByName(each.groupBy("key", "seg").agg(F.collect_list(moved).alias("marks")))
    best = F.col("first") if keep_first else F.lit(None).cast("boolean")
    named = distinct.select("key", F.xxhash64("segment").alias("seg"), "copies", best.alias("best"))
    return tx.written(named.join(marks, ["key", "seg"], "left").where("copies > 1 or marks is not null"), "marks")


def merged(df: DataFrame) -> DataFrame:
    """``doc_id, spans`` with the ranges of each document joined where they overlap or touch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            listed = batch.column("spans")
            sizes = pc.list_value_length(listed).to_numpy(zero_copy_only=False)
            flat = listed.flatten()
            row = np.repeat(np.arange(batch.num_rows), sizes)
            lo, hi = (flat.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("start", "end"))
            shift = row * (hi.max(initial=0) + 2)
            order = np.argsort(lo + shift, kind="stable")
            lo, hi, row = (lo + shift)[order], (hi + shift)[order], row[order]
            reach = np.maximum.accumulate(hi)
            new = np.flatnonzero(np.concatenate((np.ones(min(1, len(lo)), bool), lo[1:] > reach[:-1])))
            end = reach[np.append(new[1:], len(lo)) - 1] if len(new) else reach
            back = shift[order][new] if len(new) else lo
            pair = pa.StructArray.from_arrays([pa.array((lo[new] - back).astype(np.int32)), pa.array((end - back).astype(np.int32))], names=["start", "end"])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), tx.list_array(pair, np.bincount(row[new], minlength=batch.num_rows))], names=["doc_id", "spans"])

    return df.mapInArrow(run, df.schema)


def marked_spans(docs: DataFrame, units: Units, judge: Judge, keep_first: bool, frequent: int = FREQUENT, sieved: int = SIEVED) -> DataFrame:
    """``doc_id, spans`` for documents with marked units: sorted, disjoint ranges of unit numbers as (start, end).

    ``docs`` has unique ids. With ``keep_first`` the first place of every window (smallest id, then earliest) stays
    unmarked; else every window with a second place is marked.
    """
    with tx.scratch():
        counts = tx.written(anchor_counts(docs, units), "anchors")
        cut = sieved_segments if counts.count() <= sieved else joined_segments
        places = tx.written(cut(docs, counts, units), "segments")
        tx.remove(counts)
        first = [F.min(F.struct("doc_id", "start")).alias("first")] if keep_first else []
        distinct = tx.written(places.groupBy("key", "segment").agg(F.count(F.lit(1)).alias("copies"), *first).withColumn("gram", F.col("key")), "distinct")
        marks = with_marks(distinct, units, judge, frequent)
        rows = places.select("key", F.xxhash64("segment").alias("seg"), F.struct("doc_id", "start").alias("place"), "n")
        each = ranges_of(rows, marks, keep_first).select("place.doc_id", "place.start", F.inline("marks"))
        spans = each.groupBy("doc_id").agg(F.collect_list(F.struct((F.col("start") + F.col("lo")).alias("start"), (F.col("start") + F.col("hi") + (units.size - 1)).alias("end"))).alias("spans"))
        return tx.kept(tx.written(merged(spans), "spans"))
