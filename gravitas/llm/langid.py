"""Language identification with a byte convolutional network, trained here in numpy.

A text is cut into windows of fixed length. Filters of several widths slide over the bytes of a window; each keeps its
largest response (max pooling), and a softmax layer turns the responses into languages. A document's prediction is the
mean over its windows. As the input of a filter is one byte per place, its response is a sum of rows of a table, one
look-up for each place of the filter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gravitas.llm import text as tx

WINDOW = 128
WIDTHS = (2, 3, 4)
FILTERS = 16
#: Documents that the network is fitted on, and windows taken from each.
SAMPLE = 6000
WINDOWS_EACH = 3
EPOCHS = 4
BATCH = 64
#: Windows that are scored together.
TOGETHER = 256
UNKNOWN = "und"


def windows_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all windows, padded with zeros, and the text of each; an empty text has none."""
    sizes = np.diff(offsets)
    n = -(-sizes // WINDOW)
    row = np.repeat(np.arange(len(sizes)), n)
    start = offsets[row] + (np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)) * WINDOW
    padded = np.append(data, np.zeros(WINDOW, np.uint8))
    out = np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[start].copy() if len(row) else np.zeros((0, WINDOW), np.uint8)
    out[np.arange(WINDOW) >= (offsets[row + 1] - start)[:, None]] = 0
    return out, row


def slide(table: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Responses of the filters of one width at every place of every window."""
    n = windows.shape[1] - len(table) + 1
    out = table[0][windows[:, :n]]
    for j in range(1, len(table)):
        out += table[j][windows[:, j : j + n]]
    return out


@dataclass
class ByteNetwork:
    languages: list[str]
    filters: list[np.ndarray]  # one (width, 256, FILTERS) for each width
    bias: np.ndarray
    weights: np.ndarray
    last: np.ndarray

    def responses(self, windows: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Largest response of each filter, and where it was."""
        best, where = [], []
        for table in self.filters:
            r = slide(table, windows)
            at = r.argmax(axis=1)
            where.append(at)
            best.append(np.take_along_axis(r, at[:, None, :], axis=1)[:, 0])
        return np.maximum(np.concatenate(best, axis=1) + self.bias, 0), where

    def pair_tables(self) -> tuple[np.ndarray, np.ndarray]:
        """Responses to two neighbouring bytes: the first two places of all filters, then the rest of the wider ones.

        Two look-ups of these give what one look-up for each place of each filter would.
        """
        two, three, four = self.filters
        pairs = lambda a, b: (a[:, None, :] + b[None, :, :]).reshape(1 << 16, FILTERS)
        head = np.concatenate([pairs(f[0], f[1]) for f in (two, three, four)], axis=1)
        tail = np.concatenate((pairs(three[2], np.zeros_like(three[2])), pairs(four[2], four[3])), axis=1)
        return head, tail

    def log_probabilities(self, windows: np.ndarray, tables: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        head, tail = tables
        out = []
        for i in range(0, len(windows), TOGETHER):
            x = windows[i : i + TOGETHER].astype(np.uint16)
            pair = (x[:, :-1] << np.uint16(8)) | x[:, 1:]
            r = head.take(pair, axis=0)
            r[:, :-2, FILTERS:] += tail.take(pair[:, 2:], axis=0)
            # The filter of width three also fits one place later, where only its last byte is left.
            end = r[:, -2, FILTERS : 2 * FILTERS] + self.filters[1][2][windows[i : i + TOGETHER, -1]]
            best = np.concatenate((r[:, :, :FILTERS].max(axis=1), np.maximum(r[:, :-2, FILTERS : 2 * FILTERS].max(axis=1), end), r[:, :-2, 2 * FILTERS :].max(axis=1)), axis=1)
            out.append(np.maximum(best + self.bias, 0) @ self.weights + self.last)
        z = np.concatenate(out) if out else np.zeros((0, len(self.languages)), np.float32)
        z = z - z.max(axis=1, keepdims=True)
        return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


def train(windows: np.ndarray, labels: np.ndarray, languages: list[str], seed: int = 7) -> ByteNetwork:
    rng = np.random.default_rng(seed)
    total = FILTERS * len(WIDTHS)
    filters = [rng.normal(0, 0.3 / np.sqrt(w), (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS]
    net = ByteNetwork(languages, filters, np.zeros(total, np.float32), rng.normal(0, 0.1, (total, len(languages))).astype(np.float32), np.zeros(len(languages), np.float32))
    params = [*net.filters, net.bias, net.weights, net.last]
    m, v, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(EPOCHS):
        for rows in np.array_split(rng.permutation(len(windows)), max(1, len(windows) // BATCH)):
            x = windows[rows]
            hidden, where = net.responses(x)
            z = hidden @ net.weights + net.last
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(rows)), labels[rows]] -= 1
            p /= len(rows)
            back = (p @ net.weights.T) * (hidden > 0)
            gradient = [np.zeros_like(f) for f in net.filters]
            for i, (g, at) in enumerate(zip(gradient, where)):
                part = back[:, i * FILTERS : (i + 1) * FILTERS]
                for j in range(len(g)):  # only the place of the largest response learns
                    np.add.at(g[j], (np.take_along_axis(x, at + j, axis=1), np.arange(FILTERS)), part)
            gradient += [back.sum(axis=0), hidden.T @ p, p.sum(axis=0)]
            t += 1
            for param, g, a, b in zip(params, gradient, m, v):
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                param -= 0.01 * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.999**t)) + 1e-8)
    return net


def training_windows(docs: DataFrame, sample: int) -> list:
    """``lang, window`` of at most ``sample`` documents with a known language, chosen by a hash of the id.

    A window starts at every third of a text; a short text gives what it has.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tx.pieces(batch, "text"):
                data, offsets = tx.bytes_of(part.column("text"))
                lang, out = [], []
                for name, a, b in zip(part.column("lang").to_pylist(), offsets[:-1], offsets[1:]):
                    for i in range(WINDOWS_EACH if b - a > WINDOW else 1):
                        at = a + (b - a) * i // WINDOWS_EACH
                        lang.append(name)
                        out.append(data[at : min(at + WINDOW, b)].tobytes().ljust(WINDOW, b"\0"))
                yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(out, pa.binary())], names=["lang", "window"])

    usable = docs.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & F.col("doc_id").isNotNull())
    chosen = usable.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)  # narrow and bounded, so safe to broadcast
    rows = usable.select("doc_id", "lang", "text").join(F.broadcast(chosen), "doc_id").select("lang", "text").mapInArrow(run, "lang string, window binary")
    return sorted(rows.limit(sample * WINDOWS_EACH).collect())


def fit(docs: DataFrame, sample: int = SAMPLE) -> ByteNetwork | None:
    rows = training_windows(docs, sample)
    languages = sorted({r["lang"] for r in rows})
    if not languages:
        return None
    windows = np.frombuffer(b"".join(r["window"] for r in rows), np.uint8).reshape(-1, WINDOW)
    number = {name: i for i, name in enumerate(languages)}
    return train(windows, np.array([number[r["lang"]] for r in rows]), languages)


def predict(docs: DataFrame, model: ByteNetwork | None, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``lang_score``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.drop("lang_pred", "lang_score")
    schema = kept.withColumn("lang_pred", F.lit("")).withColumn("lang_score", F.lit(0.0)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        tables = net.pair_tables() if net is not None else None
        for batch in batches:
            for part in tx.pieces(batch, text_col, 256 << 10):
                n = part.num_rows
                names, p = [UNKNOWN] * n, np.zeros(n)
                if net is not None:
                    windows, row = windows_of(*tx.bytes_of(part.column(text_col)))
                    logs = net.log_probabilities(windows, tables)
                    count = np.maximum(np.bincount(row, minlength=n), 1)
                    mean = np.stack([np.bincount(row, weights=logs[:, k], minlength=n) for k in range(logs.shape[1])], axis=1) / count[:, None]
                    probability = np.exp(mean - mean.max(axis=1, keepdims=True))
                    probability /= probability.sum(axis=1, keepdims=True)
                    names, p = [net.languages[k] for k in probability.argmax(axis=1)], probability.max(axis=1)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(names, pa.string()), pa.array(p, pa.float64())], names=schema.names)

    letters = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))
    out = kept.mapInArrow(run, schema)
    return out.withColumn("lang_pred", F.when(letters, F.col("lang_pred")).otherwise(UNKNOWN)).withColumn("lang_score", F.when(letters, F.col("lang_score")).otherwise(0.0))


def identify(docs: DataFrame, learn: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> DataFrame:
    """``docs`` with ``lang_pred`` (a learnt language) and ``lang_score`` (its probability) for the whole text.

    The network learns from at most ``sample`` documents of ``learn`` (by default ``docs``) with a known language; a
    language that the sample does not hold is not learnt. Only the text is an input of a prediction. Texts that are
    null or have no letter get ``und`` and score 0, and so do all if nothing could be learnt. Every row is judged for
    itself, so repeated rows and ids get equal results. An empty table gives an empty result. Columns named
    ``lang_pred`` and ``lang_score`` are replaced, all others stay.
    """
    known = (learn if learn is not None else docs).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    return predict(docs, fit(known, sample), text_col)
