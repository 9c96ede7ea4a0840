"""Pearson correlations of all numeric pairs from one pass, and the lists read off them."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gravitas import preset

#: Tasks that first merge what the scan has found; so many rows per pair are left, whatever the size of the table.
MERGERS = 64
FIGURES = ("n", "mean_a", "mean_b", "m_aa", "m_bb", "m_ab", "low_a", "high_a", "low_b", "high_b", "own_a", "own_b")
MOMENTS = "a int, b int, " + ", ".join(f"{f} double" for f in FIGURES)


def _pair_moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Count, means and centred second moments of every pair over a task's rows, by matrix products.

    A pair uses the rows in which both are known. Values are taken relative to the first known one of the task, so
    that large offsets do not cost precision and a constant column has a moment of exactly 0.
    """
    total = shift = None
    for pdf in batches:
        x = pdf.to_numpy(dtype=float)
        if not len(x):
            continue
        known = ~np.isnan(x)
        if shift is None:
            shift = np.full(x.shape[1], np.nan)
        new = np.isnan(shift) & known.any(axis=0)
        shift[new] = x[known.argmax(axis=0), np.arange(x.shape[1])][new]
        z = np.where(known, x - shift, 0.0)
        m = known.astype(float)
        part = np.stack([m.T @ m, z.T @ m, (z * z).T @ m, z.T @ z])
        total = part if total is None else total + part
    if total is None:
        return
    a, b = np.triu_indices(len(shift), 1)
    n = total[0][a, b]
    a, b, n = a[n > 0], b[n > 0], n[n > 0]
    sa, sb = total[1][a, b], total[1][b, a]
    mean_a, mean_b = shift[a] + sa / n, shift[b] + sb / n
    m_aa, m_bb = total[2][a, b] - sa * sa / n, total[2][b, a] - sb * sb / n
    figures = (n, mean_a, mean_b, m_aa, m_bb, total[3][a, b] - sa * sb / n, mean_a, mean_a, mean_b, mean_b, m_aa, m_bb)
    yield pd.DataFrame({"a": a, "b": b} | dict(zip(FIGURES, figures)))


def _added(rows: pd.DataFrame) -> pd.DataFrame:
    """One row per pair: counts add up, and moments with the spread of the means around their common mean."""
    pairs, at = np.unique(rows[["a", "b"]].to_numpy(), axis=0, return_inverse=True)
    at = at.reshape(-1)
    add = lambda x: np.bincount(at, weights=x, minlength=len(pairs))
    x = {f: rows[f].to_numpy() for f in FIGURES}
    n = add(x["n"])
    mean_a, mean_b = add(x["n"] * x["mean_a"]) / n, add(x["n"] * x["mean_b"]) / n
    da, db = x["mean_a"] - mean_a[at], x["mean_b"] - mean_b[at]
    moments = [add(x[m] + x["n"] * u * v) for m, u, v in (("m_aa", da, da), ("m_bb", db, db), ("m_ab", da, db))]

    def extreme(f: str, start: float, pick) -> np.ndarray:
        out = np.full(len(pairs), start)
        pick.at(out, at, x[f])
        return out

    low, high = (np.inf, np.minimum), (-np.inf, np.maximum)
    ends = [extreme(f, *(low if f.startswith("low") else high)) for f in FIGURES[6:]]
    return pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]} | dict(zip(FIGURES, (n, mean_a, mean_b, *moments, *ends))))


def _merged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """What a task receives as one row per pair; no more than a batch and that is held."""
    total = None
    for pdf in batches:
        if len(pdf):
            total = _added(pdf if total is None else pd.concat([total, pdf]))
    if total is not None:
        yield total


def merged_moments(df: DataFrame, cols: Sequence[str], mergers: int = MERGERS) -> DataFrame:
    """One row per pair of column numbers with count, means and centred moments over the whole table."""
    partial = df.select(*[F.col(c).cast("double").alias(c) for c in cols]).mapInPandas(_pair_moments, MOMENTS)
    first = partial.repartition(mergers).mapInPandas(_merged, MOMENTS)
    return first.repartition("a", "b").mapInPandas(_merged, MOMENTS)


def correlation_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Upper triangle in long form; each pair uses the rows in which both are known. Null where undefined.

    One pass for any number of columns: a task sends one row per pair. ``MERGERS`` tasks merge these as they come,
    and one per pair merges what is left. The same as aggregate expressions needs three of them per pair, too much code
    to compile for more than a few columns.
    """
    if len(cols) < 2:
        raise ValueError("correlation needs two numeric columns")
    whole = merged_moments(df, cols)
    defined = ((F.col("own_a") > 0) | (F.col("high_a") > F.col("low_a"))) & ((F.col("own_b") > 0) | (F.col("high_b") > F.col("low_b")))
    spread = F.sqrt(F.greatest("m_aa", F.lit(0.0))) * F.sqrt(F.greatest("m_bb", F.lit(0.0)))
    r = F.col("m_ab") / F.nullif(spread, F.lit(0.0))
    seen = whole.select("a", "b", F.when(defined, F.least(F.greatest(r, F.lit(-1.0)), F.lit(1.0))).alias("correlation"))
    label = F.array(*[F.lit(c) for c in cols])
    listed = df.sparkSession.createDataFrame(
        [(i, j) for i in range(len(cols)) for j in range(i + 1, len(cols))], "a int, b int"
    )
    return listed.join(seen, ["a", "b"], "left").select(
        label[F.col("a")].alias("feature_1"), label[F.col("b")].alias("feature_2"), "correlation"
    )


def strong_correlations(matrix: DataFrame, k: int = 10) -> DataFrame:
    size = F.abs("correlation")
    strength = F.when(size > preset.VERY_STRONG_CORRELATION, "Very Strong").otherwise("Strong")
    return (
        matrix.where(size > preset.STRONG_CORRELATION)
        .withColumn("strength", strength)
        .orderBy(F.round(size, 9).desc(), "feature_1", "feature_2")
        .limit(k)
    )


def multicollinearity(matrix: DataFrame) -> DataFrame:
    return matrix.where(F.abs("correlation") > preset.COLLINEAR)


def target_correlations(matrix: DataFrame, target: str, k: int = 5) -> DataFrame:
    """The k largest positive and the k largest negative correlations with a numeric target."""
    first, second = F.col("feature_1"), F.col("feature_2")
    other = F.when(first == target, second).when(second == target, first)
    long = matrix.select(other.alias("feature"), "correlation").where(F.col("feature").isNotNull())
    order = [F.round(F.abs("correlation"), 9).desc(), F.col("feature")]
    return long.where("correlation > 0").orderBy(*order).limit(k).unionByName(
        long.where("correlation < 0").orderBy(*order).limit(k)
    )
