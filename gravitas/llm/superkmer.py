"""Substring dedup on words: windows that share a minimiser travel as one packed string, and sorting counts them.

A window of words has as minimiser the smallest hash of its short word grams. Neighbouring windows with one minimiser
are packed into one string (a super-k-mer) and sent to the minimiser's bucket. There words become numbers, and windows
are ranked by sorting runs of 1, 2, 4, ... words, so equal ranks mean equal words: counts are exact, no hash decides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from gravitas.llm import text as tx
from gravitas.llm.anchors import FREQUENT, SIEVED, Units, marked_spans

WINDOW = 35
GRAM = 6


def word_grams(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, first = tx.word_bounds(data, offsets)
    return tx.gram_hashes(tx.span_hashes(data, starts, ends), k) if k else np.zeros(0, np.uint64), first


def packed_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """All words, each followed by one space; where each begins; a segment leaves out its last space."""
    starts, ends, _ = tx.word_bounds(data, offsets)
    packed, at = tx.join_spans(np.append(data, np.uint8(32)), starts, ends + 1)
    packed[at[1:] - 1] = 32
    return packed, at, 1


def ranks(values: np.ndarray) -> np.ndarray:
    return np.unique(values, return_inverse=True)[1].reshape(-1)


def window_ranks(words: np.ndarray, size: int) -> np.ndarray:
    """Equal numbers for equal runs of ``size`` words, by sorting runs of doubled length."""
    rank, have = words.astype(np.int64), 1
    while have < size:
        step = min(have, size - have)
        top = len(rank) - step
        if top <= 0:
            return rank[:0]
        rank, have = ranks(rank[:top] * (int(rank.max()) + 1) + rank[step:]), have + step
    return rank


def counted(size: int):
    """Marks windows that occur at least twice, copies of their segments included."""

    def judge(data: np.ndarray, offsets: np.ndarray, copies: np.ndarray) -> list[np.ndarray]:
        starts, ends, first = tx.word_bounds(data, offsets)
        words = tx.binary_array(*tx.join_spans(data, starts, ends)).dictionary_encode().indices.to_numpy()
        rank = window_ranks(words, size)
        n = len(rank)
        row = tx.owners(first)[:n]
        inside = np.arange(n) + size <= first[row + 1]
        total = np.bincount(rank[inside], weights=copies[row[inside]], minlength=1)
        again = np.zeros(len(words), bool)
        again[:n][inside] = total[rank[inside]] > 1
        return [again[a : b - size + 1] for a, b in zip(first[:-1], first[1:])]

    return judge


def repeated_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM, frequent: int = FREQUENT, sieved: int = SIEVED) -> DataFrame:
    """``doc_id, spans``: ranges of words covered by a window that occurs anywhere else in the corpus.

    Words are runs of anything but ASCII white space, unchanged; every occurrence is marked, the first one too. Only
    documents with marked words have a row. Texts that are null, empty or shorter than a window have none. Rows that
    share an id are one document, see ``unique_documents``; an empty table gives an empty result. Only the two named
    columns are read.
    """
    units = Units(window, min(gram, window), word_grams, packed_words)
    return marked_spans(tx.unique_documents(docs, id_col, text_col), units, counted(window), keep_first=False, frequent=frequent, sieved=sieved)


def kept_words(docs: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_removed, kept`` from ``anchors.with_spans``: the words outside, joined by one space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in tx.unpacked(batch):
                first = word_grams(data, offsets, 0)[1]
                packed, at, _ = packed_words(data, offsets)
                keep = ~covered_units(part.column("spans"), first)
                words, ends = tx.join_spans(packed, at[:-1][keep], at[1:][keep])
                so_far = np.concatenate(([0], np.cumsum(keep)))[first]
                lo, hi = ends[so_far[:-1]], ends[so_far[1:]]
                kept = tx.binary_array(*tx.join_spans(words, lo, np.maximum(lo, hi - 1)), pa.string())
                n = np.diff(first)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n), pa.array(n - np.diff(so_far)), kept], names=["doc_id", "n_words", "n_removed", "kept"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, n_words long, n_removed long, kept string")


def covered_units(spans: pa.Array, first: np.ndarray) -> np.ndarray:
    """Whether each unit lies in a range; ``first`` has the first unit of each row."""
    sizes = spans.value_lengths().to_numpy(zero_copy_only=False)
    flat = spans.flatten()
    row = np.repeat(np.arange(len(sizes)), sizes)
    edge = np.zeros(int(first[-1]) + 1, np.int32)
    np.add.at(edge, first[row] + flat.field("start").to_numpy(zero_copy_only=False), 1)
    np.add.at(edge, first[row] + flat.field("end").to_numpy(zero_copy_only=False), -1)
    return np.cumsum(edge)[:-1] > 0
