"""Periodic runs of words: maximal repetitions found by uniting suffix classes from long to short agreement.

Suffixes of a text that agree on at least L words are a class. From the greatest L downwards, neighbours in suffix order
are united (Kruskal on the agreement of neighbours, with union-find), and every class keeps its positions in order. Two
positions that become neighbours in such an order when L words agree, at a distance d of at most L, lie in a stretch of
d + L words with period d. Whatever has a smaller period would have united them with a position in between before, so d
is the smallest one; the stretch is maximal if the words before both positions differ.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gravitas.llm import text as tx
from gravitas.llm.superkmer import covered_units, packed_words

MIN_LENGTH = 12
RUNS = "array<struct<start:long,length:long,period:long>>"


def suffix_order(words: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffixes of numbered words in order, and the rank of every run of 1, 2, 4, ... words.

    Only suffixes still tied are sorted again. A rank table has one entry more, which equals no other.
    """
    n = len(words)
    order = np.argsort(words, kind="stable")
    slots, new = np.arange(n), np.ones(n, bool)
    new[1:] = words[order[1:]] != words[order[:-1]]
    rank = np.empty(n + 1, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, slots, 0))
    rank[n] = -1
    levels, h = [rank.astype(np.int32)], 1
    tied = slots[~(new & np.append(new[1:], True))]
    while len(tied):
        at = order[tied]
        key = rank[at] * (n + 1) + rank[np.minimum(at + h, n)] + 1
        by = np.argsort(key, kind="stable")
        at, key = at[by], key[by]
        order[tied] = at
        new = np.ones(len(tied), bool)
        new[1:] = key[1:] != key[:-1]
        rank[at] = np.maximum.accumulate(np.where(new, tied, 0))
        levels.append(rank.astype(np.int32))
        tied, h = tied[~(new & np.append(new[1:], True))], h * 2
    return order, levels


def agreements(order: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """For every suffix in order the number of words on which it agrees with the one before; 0 for the first."""
    a, b = order[:-1], order[1:]
    n, length = len(order), np.zeros(max(0, len(order) - 1), np.int64)
    for level in range(len(levels) - 1, -1, -1):
        rank = levels[level]
        length += (rank[np.minimum(a + length, n)] == rank[np.minimum(b + length, n)]).astype(np.int64) << level
    return np.concatenate(([0], length))[: n]


def seeds(order: np.ndarray, agree: np.ndarray, least: int) -> Iterator[tuple[int, int, int]]:
    """(x, y, L): positions newly next to each other in a class of L agreeing words, at a distance of at most L."""
    edges = np.flatnonzero(agree >= least)
    edges = edges[np.argsort(-agree[edges], kind="stable")]
    above: dict[int, int] = {}
    positions: dict[int, list[int]] = {}

    def find(x: int) -> int:
        while (up := above.get(x, x)) != x:
            above[x] = above.get(up, up)
            x = up
        return x

    for slot, length in zip(edges.tolist(), agree[edges].tolist()):
        a, b = find(slot - 1), find(slot)
        big, small = (positions.pop(x, None) or [int(order[x])] for x in (a, b))
        if len(big) < len(small):
            a, b, big, small = b, a, small, big
        above[b] = a
        for i, x in enumerate(small):
            j = bisect_left(big, x)
            if j and x - big[j - 1] <= length and not (i and small[i - 1] > big[j - 1]):
                yield big[j - 1], x, length
            if j < len(big) and big[j] - x <= length and not (i + 1 < len(small) and small[i + 1] < big[j]):
                yield x, big[j], length
        if 8 * len(small) < len(big):
            for x in small:
                insort(big, x)
        else:
            big += small
            big.sort()
        positions[a] = big


def find_runs(words: np.ndarray, row: np.ndarray, min_length: int) -> np.ndarray:
    """Runs as (first word, length, period), over the numbered words of several texts; ``row`` names each word's text."""
    pair = row * (int(words.max(initial=0)) + 1) + words
    own = np.unique(pair, return_inverse=True)[1].reshape(-1)  # no word of one text equals one of another
    order, levels = suffix_order(own)
    first = levels[0]
    found = [
        (x, y - x + length, y - x)
        for x, y, length in seeds(order, agreements(order, levels), (min_length + 1) // 2)
        if y - x + length >= min_length and (x == 0 or first[x - 1] != first[y - 1])
    ]
    out = np.array(found, np.int64).reshape(-1, 3)
    return out[np.lexsort((out[:, 2], out[:, 0]))]


def repeating_rows(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, k: int) -> np.ndarray:
    """Texts in which some k words stand twice. Only these can hold a run; equal hashes of other words do no harm."""
    grams = tx.gram_hashes(tx.span_hashes(data, starts, ends), k)
    at = np.arange(len(grams))
    row = tx.owners(first)[: len(grams)]
    inside = at + k <= first[row + 1]
    key = (grams + tx.mix(row.astype(np.uint64) + np.uint64(1)))[inside]
    order = np.argsort(key)
    again = order[1:][key[order[1:]] == key[order[:-1]]]
    return np.unique(row[inside][again])


def runs_of_texts(data: np.ndarray, offsets: np.ndarray, min_length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, run (first word in its text, length, period) of all texts, and the first word of each text."""
    starts, ends, first = tx.word_bounds(data, offsets)
    rows = repeating_rows(data, starts, ends, first, (min_length + 1) // 2)
    if not len(rows):
        return np.zeros(0, np.int64), np.zeros((0, 3), np.int64), first
    n = np.diff(first)[rows]
    begin = np.cumsum(n) - n
    at = np.repeat(first[rows] - begin, n) + np.arange(n.sum())
    words = tx.binary_array(*tx.join_spans(data, starts[at], ends[at])).dictionary_encode().indices.to_numpy().astype(np.int64)
    runs = find_runs(words, np.repeat(np.arange(len(rows)), n), min_length)
    of = np.searchsorted(begin, runs[:, 0], "right") - 1
    runs[:, 0] -= begin[of]
    return rows[of], runs, first


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH) -> DataFrame:
    """``doc_id, n_words, runs, collapsed``: all maximal runs of each text, and the text without their repeats.

    Words are runs of anything but ASCII white space, compared as they are and numbered from 0. A run is a stretch of at
    least ``min_length`` and two periods that no word before or after extends; runs are sorted by start and period. In
    ``collapsed`` each run keeps its first period, and words are joined by one space. Every row is judged for itself, so
    repeated rows and ids give equal results. A null or empty text has no words, no runs and an empty ``collapsed``; an
    empty table gives an empty result. Only the two named columns are read.
    """
    plain = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tx.pieces(batch, "text"):
                data, offsets = tx.bytes_of(part.column("text"))
                row, runs, first = runs_of_texts(data, offsets, min_length)
                sizes = np.bincount(row, minlength=part.num_rows)
                again = pa.StructArray.from_arrays([pa.array(runs[:, 0] + runs[:, 2]), pa.array(runs[:, 0] + runs[:, 1])], names=["start", "end"])
                keep = ~covered_units(tx.list_array(again, sizes), first)
                packed, at, _ = packed_words(data, offsets)
                kept, ends = tx.join_spans(packed, at[:-1][keep], at[1:][keep])
                so_far = np.concatenate(([0], np.cumsum(keep)))[first]
                lo, hi = ends[so_far[:-1]], ends[so_far[1:]]
                collapsed = tx.binary_array(*tx.join_spans(kept, lo, np.maximum(lo, hi - 1)), pa.string())
                found = pa.StructArray.from_arrays([pa.array(runs[:, i]) for i in range(3)], names=["start", "length", "period"])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(first)), tx.list_array(found, sizes), collapsed], names=["doc_id", "n_words", "runs", "collapsed"])

    return plain.mapInArrow(run, f"doc_id {plain.schema['doc_id'].dataType.simpleString()}, n_words long, runs {RUNS}, collapsed string")
