"""Suffix-array dedup with a run-length index: mark byte strings that also start earlier in the corpus.

Texts of one bucket stand one after the other in corpus order. Their Burrows-Wheeler transform is cut into runs of
equal characters. At every run start the index keeps one sample: the text position, its neighbour in suffix order and
how far both agree. From these samples alone the matching statistics of the whole text are streamed in text order:
between two samples the neighbour moves along by one and the agreement shrinks by one. Positions whose agreement is
long enough are linked to their neighbours; the linked positions hold equal strings, and the smallest is the earliest.
Repetitive texts have few runs, so the index is small where there is most to mark.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from gravitas.llm import text as tx
from gravitas.llm.anchors import FREQUENT, SIEVED, Units, marked_spans
from gravitas.llm.superkmer import covered_units

LENGTH = 100
GRAM = 20
#: Stands between texts; no UTF-8 text holds it.
BORDER = 0xFF


def byte_grams(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every k bytes, built from hashes of 1, 2, 4, ... bytes."""
    if not k or len(data) < k:
        return np.zeros(0, np.uint64), offsets
    power = lambda n: np.uint64(pow(0x9E3779B97F4A7C15, n, 1 << 64))
    part, length, out, done = data.astype(np.uint64) + np.uint64(1), 1, None, 0
    while True:
        if k & length:
            out = part if out is None else out[: len(data) - done - length + 1] * power(length) + part[done : len(data) - length + 1]
            done += length
        if length * 2 > k:
            return tx.mix(out), offsets
        part, length = part[:-length] * power(length) + part[length:], length * 2


def packed_bytes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    return data, np.arange(len(data) + 1), 0


def eights(text: np.ndarray) -> np.ndarray:
    """Every 8 bytes as one number that sorts as they do."""
    out = np.zeros(len(text) + 8, np.uint64)
    out[: len(text)] = text
    for n in (1, 2, 4):
        out[:-n] = (out[:-n] << np.uint64(8 * n)) | out[n:]
    return out[: len(text)]


def suffix_array(text: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Suffixes in order: by 8 bytes first, then those still tied by twice as many each time."""
    n = len(text)
    order = np.argsort(first, kind="stable")
    slots = np.arange(n)
    new = np.ones(n, bool)
    new[1:] = first[order[1:]] != first[order[:-1]]
    rank = np.empty(n + 1, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, slots, 0))
    rank[n] = -1
    tied, h = slots[~(new & np.append(new[1:], True))], 8
    while len(tied):
        at = order[tied]
        key = rank[at] * (n + 1) + rank[np.minimum(at + h, n)] + 1
        by = np.argsort(key, kind="stable")
        at, key = at[by], key[by]
        order[tied] = at
        new = np.ones(len(tied), bool)
        new[1:] = key[1:] != key[:-1]
        rank[at] = np.maximum.accumulate(np.where(new, tied, 0))
        tied, h = tied[~(new & np.append(new[1:], True))], h * 2
    return order


def agreement(first: np.ndarray, a: np.ndarray, b: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Length of the longest common prefix of the suffixes at a and b."""
    n = len(text)
    length, left = np.zeros(len(a), np.int64), np.arange(len(a))
    while len(left):
        x, y = a[left] + length[left], b[left] + length[left]
        same = (np.maximum(x, y) + 8 <= n) & (first[np.minimum(x, n - 1)] == first[np.minimum(y, n - 1)])
        length[left[same]] += 8
        left = left[same]
    padded = np.append(text, np.uint8(BORDER))
    left = np.arange(len(a))
    for _ in range(8):
        x, y = a[left] + length[left], b[left] + length[left]
        same = (np.maximum(x, y) < n) & (padded[np.minimum(x, n)] == padded[np.minimum(y, n)])
        length[left[same]] += 1
        left = left[same]
    return length


@dataclass
class RunIndex:
    """Runs of the transform (character and length) and a sample at each run start, in text order."""

    heads: np.ndarray
    lengths: np.ndarray
    position: np.ndarray
    neighbour: np.ndarray
    agree: np.ndarray
    size: int

    @classmethod
    def build(cls, text: np.ndarray) -> RunIndex:
        first = eights(text)
        order = suffix_array(text, first)
        last = text[order - 1]  # the character before each suffix
        start = np.ones(len(text), bool)
        start[1:] = (last[1:] != last[:-1]) | (order[1:] == 0) | (order[:-1] == 0)
        rows = np.flatnonzero(start)
        position, neighbour = order[rows], np.where(rows > 0, order[rows - 1], order[rows])
        agree = agreement(first, position, neighbour, text)
        agree[rows == 0] = 0
        by = np.argsort(position)
        return cls(last[rows], np.diff(np.append(rows, len(text))), position[by], neighbour[by], agree[by], len(text))

    def matching_statistics(self) -> tuple[np.ndarray, np.ndarray]:
        """For every text position its neighbour in suffix order and the length on which both agree."""
        x = np.arange(self.size)
        sample = np.searchsorted(self.position, x, "right") - 1
        moved = x - self.position[sample]
        return self.neighbour[sample] + moved, self.agree[sample] - moved


def earlier(length: int):
    """Marks windows whose bytes also start earlier in the block."""

    def judge(data: np.ndarray, offsets: np.ndarray, copies: np.ndarray) -> list[np.ndarray]:
        sizes = np.diff(offsets)
        at = offsets[:-1] + np.arange(len(sizes))
        text = np.full(len(data) + len(sizes), BORDER, np.uint8)
        text[np.arange(len(data)) + np.repeat(at - offsets[:-1], sizes)] = data
        neighbour, agree = RunIndex.build(text).matching_statistics()
        n = np.maximum(sizes - length + 1, 0)
        windows = np.arange(n.sum()) + np.repeat(at - (np.cumsum(n) - n), n)
        root = np.arange(len(text))
        linked = windows[agree[windows] >= length]
        root[linked] = neighbour[linked]
        while len(linked):
            to = root[root[linked]]
            moved = to != root[linked]
            root[linked] = to
            linked = linked[moved]
        earliest = np.empty(len(text), np.int64)
        earliest[root[windows[::-1]]] = windows[::-1]  # of several values the last stays, which is the smallest
        marked = earliest[root[windows]] != windows
        return np.split(marked, np.cumsum(n)[:-1])

    return judge


def repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, frequent: int = FREQUENT, sieved: int = SIEVED) -> DataFrame:
    """``doc_id, spans``: ranges of UTF-8 bytes covered by ``length`` bytes that also start earlier in the corpus.

    Earlier means in a document with a smaller id, or before in the same one, overlaps included; matches never cross
    documents. Only documents with marked bytes have a row. Texts that are null, empty or shorter than ``length`` have
    none. Rows that share an id are one document, see ``unique_documents``; an empty table gives an empty result.
    Only the two named columns are read.
    """
    units = Units(length, min(gram, length), byte_grams, packed_bytes)
    return marked_spans(tx.unique_documents(docs, id_col, text_col), units, earlier(length), keep_first=True, frequent=frequent, sieved=sieved)


def kept_bytes(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept`` (binary) from ``anchors.with_spans``: the bytes outside."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in tx.unpacked(batch):
                keep = ~covered_units(part.column("spans"), offsets)
                so_far = np.concatenate(([0], np.cumsum(keep)))[offsets]
                n, spans = np.diff(offsets), part.column("spans").value_lengths().cast(pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(n), pa.array(n - np.diff(so_far)), spans, tx.binary_array(data[keep], so_far)],
                    names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary")


def kept_texts(docs: DataFrame) -> DataFrame:
    """``doc_id, kept`` (string): as ``kept_bytes``, without the halves of characters that a span has cut in two."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x.decode("utf-8", "ignore") for x in batch.column("kept").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "kept"])

    kept = kept_bytes(docs)
    return kept.select("doc_id", "kept").mapInArrow(run, f"doc_id {kept.schema['doc_id'].dataType.simpleString()}, kept string")
