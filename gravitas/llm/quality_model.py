"""Quality classifier: random-indexing word vectors pooled per document, and a small network with calibrated output.

Every word has a sparse random index vector. A word's vector is the sum of the index vectors of its neighbours over
the whole corpus, so words used alike get similar vectors; words share a table of fixed size by their hash. A document
is the mean and the spread of its words' vectors. A network of two layers learns the label from a bounded sample of
labelled documents; a temperature fitted on a part it has not seen makes its output a probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gravitas.llm import text as tx

#: Rows and columns of the table of word vectors, which is the size of what is broadcast.
SLOTS = 1 << 15
DIMENSIONS = 48
#: Non-zero entries of an index vector, and neighbours on each side.
ENTRIES = 4
REACH = 2
#: Labelled documents that the network is fitted on.
SAMPLE = 20_000
HIDDEN = 32
EPOCHS = 25
BLOCK = 512
PIECE = 128 << 10

#: Classes of bytes: white space, lower case (and all beyond ASCII), upper case, digits, the rest.
KIND = np.full(256, 4, np.int8)
KIND[97:123] = KIND[128:] = 1
KIND[65:91], KIND[48:58] = 2, 3
KIND[tx.IS_SPACE] = 0


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slot of each token and the first token of each text. A token is a run of bytes of one class; a capital stays
    with the lower case that follows it."""
    kind = KIND[data]
    border = np.ones(len(data) + 1, bool)
    border[1:-1] = (kind[1:] != kind[:-1]) & ~((kind[:-1] == 2) & (kind[1:] == 1))
    border[offsets] = True
    at = np.flatnonzero(border)
    solid = kind[at[:-1]] > 0 if len(data) else np.zeros(len(at) - 1, bool)
    starts, ends = at[:-1][solid], at[1:][solid]
    slots = (tx.span_hashes(data, starts, ends) % np.uint64(SLOTS)).astype(np.int64)
    return slots, np.searchsorted(starts, offsets)


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the non-zero entries of each slot's random vector; always the same."""
    rng = np.random.default_rng(3)
    places = np.argsort(rng.random((SLOTS, DIMENSIONS)), axis=1)[:, :ENTRIES]
    return places.astype(np.int32), rng.choice(np.array([-1, 1], np.int8), (SLOTS, ENTRIES))


def contexts(slots: np.ndarray, first: np.ndarray, places: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """Sums of the neighbours' index vectors, as a flat table."""
    row, out = tx.owners(first), np.zeros(SLOTS * DIMENSIONS, np.int64)
    for step in range(1, REACH + 1):
        near = np.flatnonzero(row[step:] == row[:-step])
        for a, b in ((near, near + step), (near + step, near)):
            word, other = slots[a], slots[b]
            at = (word[:, None] * DIMENSIONS + places[other]).reshape(-1)
            out += np.bincount(at, weights=signs[other].reshape(-1), minlength=len(out)).astype(np.int64)
    return out


def word_vectors(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Unit vectors of all slots from the whole corpus, zero for slots without words.

    Each task sums its part, in whole numbers, so that the result does not depend on how rows are dealt; the sums of a block of slots then meet in one task, read one after the other. Only the
    final table comes to the driver: ``SLOTS * DIMENSIONS`` numbers, whatever the corpus.
    """

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, signs = index_vectors()
        total = np.zeros(SLOTS * DIMENSIONS, np.int64)
        for batch in batches:
            for part in tx.pieces(batch, text_col):
                slots, first = tokens(*tx.bytes_of(part.column(text_col)))
                total += contexts(slots, first, places, signs)
        for block, sums in enumerate(total.reshape(-1, BLOCK * DIMENSIONS)):
            if sums.any():
                small = sums.astype(np.int32) if abs(sums).max() < 1 << 31 else sums
                yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([small.tobytes()], pa.binary())], names=["block", "sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, sums in zip(batch.column("block").to_pylist(), batch.column("sums").to_pylist()):
                part = np.frombuffer(sums, np.int32 if len(sums) == 4 * BLOCK * DIMENSIONS else np.int64)
                total[block] = total.get(block, 0) + part.astype(np.int64)
        for block, sums in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([sums.tobytes()], pa.binary())], names=["block", "sums"])

    kind = "block long, sums binary"
    rows = docs.select(text_col).mapInArrow(gather, kind).repartition("block").mapInArrow(add, kind).collect()
    table = np.zeros((SLOTS // BLOCK, BLOCK * DIMENSIONS), np.float32)
    for r in rows:
        table[r["block"]] = np.frombuffer(r["sums"], np.int64)
    table = table.reshape(SLOTS, DIMENSIONS)
    norm = np.linalg.norm(table, axis=1, keepdims=True)
    return table / np.where(norm > 0, norm, 1)


def pooled(data: np.ndarray, offsets: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Mean and standard deviation of the word vectors of each text, and the length of the mean; zeros without words."""
    slots, first = tokens(data, offsets)
    n = np.diff(first)
    each = vectors[slots]
    sums, squares = (np.zeros((len(n), DIMENSIONS), np.float64) for _ in range(2))
    full = n > 0
    if full.any():
        sums[full] = np.add.reduceat(each, first[:-1][full], axis=0, dtype=np.float64)
        squares[full] = np.add.reduceat(each * each, first[:-1][full], axis=0, dtype=np.float64)
    per = np.maximum(n, 1)[:, None]
    mean = sums / per
    spread = np.sqrt(np.maximum(squares / per - mean * mean, 0))
    return np.concatenate((mean, spread, np.linalg.norm(mean, axis=1, keepdims=True)), axis=1).astype(np.float32)


@dataclass(frozen=True)
class Network:
    centre: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.centre) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def train(x: np.ndarray, y: np.ndarray, seed: int = 5) -> Network:
    """Fit on four fifths of the rows, then the temperature on the last fifth."""
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(x))
    held, own = np.split(order, [len(x) // 5])
    centre, scale = x[own].mean(axis=0), x[own].std(axis=0) + 1e-4
    z = (x - centre) / scale
    p = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
    m, v, t = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    for _ in range(EPOCHS):
        for rows in np.array_split(rng.permutation(own), max(1, len(own) // 128)):
            hidden = np.tanh(z[rows] @ p[0] + p[1])
            error = (1 / (1 + np.exp(-np.clip(hidden @ p[2] + p[3], -30, 30))) - y[rows]) / len(rows)
            back = error[:, None] * p[2] * (1 - hidden * hidden)
            gradient = [z[rows].T @ back + 1e-4 * p[0], back.sum(axis=0), hidden.T @ error + 1e-4 * p[2], error.sum(keepdims=True)]
            t += 1
            for i, g in enumerate(gradient):
                m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.999 * v[i] + 0.001 * g * g
                p[i] -= 0.003 * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    network = Network(centre, scale, p[0], p[1], p[2], float(p[3][0]), 1.0)
    logits, truth = network.logits(x[held]), y[held] * 2 - 1
    loss = [(np.logaddexp(0, -truth * logits / s).mean() if len(held) else 0.0, s) for s in np.geomspace(0.25, 8, 60)]
    return Network(*(getattr(network, n) for n in ("centre", "scale", "w1", "b1", "w2", "b2")), temperature=float(min(loss)[1]))


def sample_labels(labels: DataFrame, id_col: str, label_col: str, sample: int) -> DataFrame:
    """At most ``sample`` labelled ids, chosen by a hash of the id; of repeated labels the largest counts."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
    one = known.groupBy(F.col(id_col).alias("doc_id")).agg(F.max(label_col).cast("int").alias("label"))
    return one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)


def fit(docs: DataFrame, labels: DataFrame, vectors: np.ndarray, id_col: str, text_col: str, label_col: str, sample: int = SAMPLE) -> Network | float:
    """The network, or a constant score where the sample has fewer than two labels: that label, 1 without any."""
    shared = docs.sparkSession.sparkContext.broadcast(vectors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tx.pieces(batch, "text", PIECE):
                x = pooled(*tx.bytes_of(part.column("text")), shared.value)
                yield pa.RecordBatch.from_arrays([part.column("label"), pa.array([r.tobytes() for r in x], pa.binary())], names=["label", "x"])

    plain = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    chosen = sample_labels(labels, id_col, label_col, sample)  # at most ``sample`` narrow rows, so safe to broadcast
    rows = plain.join(F.broadcast(chosen), "doc_id").mapInArrow(run, "label int, x binary").limit(sample).collect()
    rows.sort(key=lambda r: (r["x"], r["label"]))
    y = np.array([r["label"] for r in rows], np.float64)
    if len(np.unique(y)) < 2:
        return float(y[0]) if len(y) else 1.0
    return train(np.array([np.frombuffer(r["x"], np.float32) for r in rows], np.float64), y)


def score(docs: DataFrame, vectors: np.ndarray, model: Network | float, text_col: str) -> DataFrame:
    """``docs`` with ``score`` added."""
    shared = docs.sparkSession.sparkContext.broadcast((vectors, model))
    kept = docs.drop("score")
    schema = kept.withColumn("score", F.lit(0.0)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, model = shared.value
        for batch in batches:
            for part in tx.pieces(batch, text_col, PIECE):
                x = pooled(*tx.bytes_of(part.column(text_col)), vectors)
                p = model.probability(x) if isinstance(model, Network) else np.full(len(x), model)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(p.astype(np.float64))], names=schema.names)

    return kept.mapInArrow(run, schema)


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> DataFrame:
    """``docs`` with ``score``: the probability that a document's label is 1.

    Only the text is an input of the score. Word vectors come from all of ``docs``, the network from at most ``sample``
    labelled rows. Null and empty texts are documents without words and are scored as such. Every row is scored for
    itself, so repeated rows and ids get equal scores. Null labels and labels of unknown ids are passed over; with
    one label only the score is that label everywhere, with none it is 1. An empty table gives an empty result. A
    column named ``score`` is replaced, all others stay.
    """
    vectors = word_vectors(docs, text_col)
    return score(docs, vectors, fit(docs, labels, vectors, id_col, text_col, label_col, sample), text_col)
