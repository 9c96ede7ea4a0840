"""Exact linear-interpolated quantiles without holding a column's distinct values in one task.

``percentile`` keeps every distinct value of a column in its buffer. That is the fast way while the number of distinct
values is small, which one survey pass checks with a sketch. Beyond it each quantile is bracketed by a bounded sketch and the bracket
is verified by exact counts and narrowed, pass by pass, until few distinct values remain between its ends.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gravitas.functions.buckets import running_sums, with_range_bucket
from gravitas.session import ensure_checkpoint_dir

DISTINCT_LIMIT = 200_000
# Rows that may be left between the ends of a bracket when its values are read one by one.
BRACKET_ROWS = 20_000
GROUP_LIMIT = 10_000
SKETCH_ACCURACY = 10_000


def percentile_exprs(col: str, probs: Sequence[float]) -> list[Column]:
    """Entries of one percentile aggregate: written alike, they share a single buffer of values."""
    every = F.percentile(F.col(col).cast("double"), F.array(*[F.lit(float(p)) for p in probs]))
    return [F.try_element_at(every, F.lit(i + 1)) for i in range(len(probs))]


def is_few(sketched: int, limit: int | None = None) -> bool:
    """Whether that many distinct values fit an in-task buffer, with room for the sketch's own error."""
    return sketched * 1.2 <= (DISTINCT_LIMIT if limit is None else limit)


def survey(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> list:
    """Per group and column: values, extremes and about how many are distinct (n, lo, hi, d and the column's place)."""
    stats = []
    for i, c in enumerate(cols):
        v = F.col(c).cast("double")
        stats += [
            F.count(v).alias(f"n{i}"), F.min(v).alias(f"lo{i}"), F.max(v).alias(f"hi{i}"),
            F.approx_count_distinct(v, 0.05).alias(f"d{i}"),
        ]
    return _bounded(df.groupBy(*by).agg(*stats))


def few_distinct(surveyed: list, cols: Sequence[str], limit: int | None = None) -> list[str]:
    """Columns whose distinct values, over all groups, fit an in-task buffer."""
    return [c for i, c in enumerate(cols) if is_few(sum(row[f"d{i}"] for row in surveyed), limit)]


@dataclass
class _Target:
    """One quantile looked for: the two neighbouring ranks it interpolates, and the bracket known to hold both."""

    low_rank: int
    high_rank: int
    weight: float
    lower: float
    upper: float
    below: int
    inside: int
    values: tuple[float, float] | None = None

    def settle(self, low: float, high: float) -> None:
        self.values = (low, high)

    def value(self) -> float:
        low, high = self.values
        return low + (high - low) * self.weight


def narrow_quantiles(
    df: DataFrame, cols: Sequence[str], probs: Sequence[float], by: Sequence[str] = (), limit: int | None = None,
    surveyed: list | None = None,
) -> dict[tuple, dict[str, list[float | None]]]:
    """Exact quantiles per group and column by verified narrowing; result keyed by group tuple, then column.

    The number of rows is no limit: every pass is a map-side aggregate that returns one row per group.
    """
    limit = BRACKET_ROWS if limit is None else limit
    data = df.select(*by, *[F.col(c).cast("double").alias(f"v{i}") for i, c in enumerate(cols)])
    first = survey(df, cols, by) if surveyed is None else surveyed
    targets: dict[tuple, dict[tuple[int, int], _Target]] = {}
    for row in first:
        found = targets.setdefault(tuple(row[b] for b in by), {})
        for i in range(len(cols)):
            n = row[f"n{i}"]
            for j, p in enumerate(probs if n else ()):
                r = p * (n - 1)
                low = math.floor(r)
                t = _Target(low, math.ceil(r), r - low, row[f"lo{i}"], row[f"hi{i}"], 0, n)
                if t.lower == t.upper:
                    t.settle(t.lower, t.upper)
                found[(i, j)] = t

    while True:
        open_ = {g: {k: t for k, t in ts.items() if t.values is None and t.inside > limit} for g, ts in targets.items()}
        open_ = {g: ts for g, ts in open_.items() if ts}
        if not open_:
            break
        _narrow_once(data, by, open_)
    _finish(data, by, {g: {k: t for k, t in ts.items() if t.values is None} for g, ts in targets.items()})
    return {
        g: {c: [ts[(i, j)].value() if (i, j) in ts else None for j in range(len(probs))] for i, c in enumerate(cols)}
        for g, ts in targets.items()
    }


def _bounded(grouped: DataFrame) -> list:
    rows = grouped.limit(GROUP_LIMIT + 1).collect()
    if len(rows) > GROUP_LIMIT:
        raise ValueError(f"more than {GROUP_LIMIT} groups; quantiles are for bounded classes")
    return rows


def _with_brackets(data: DataFrame, by: Sequence[str], table: dict, names: Sequence[str]) -> DataFrame:
    """Attach the doubles named ``names`` to each row; the table has one row per group, at most GROUP_LIMIT."""
    if not by:
        (values,) = table.values()
        return data.select("*", *[F.lit(v).cast("double").alias(n) for n, v in zip(names, values)])
    schema = ", ".join([f"`{b}_k` {data.schema[b].dataType.simpleString()}" for b in by] + [f"{n} double" for n in names])
    side = data.sparkSession.createDataFrame([(*g, *v) for g, v in table.items()], schema)
    on = None
    for b in by:
        match = data[b].eqNullSafe(side[f"{b}_k"])
        on = match if on is None else on & match
    return data.join(F.broadcast(side), on, "inner")


def _narrow_once(data: DataFrame, by: Sequence[str], open_: dict) -> None:
    """One sketch pass proposing tighter brackets, one counting pass accepting only what the counts prove."""
    keys = sorted({k for ts in open_.values() for k in ts})
    eps = 2.0 / SKETCH_ACCURACY

    def asked(t: _Target) -> tuple[float, float]:
        span = max(t.inside - 1, 1)
        return max(0.0, (t.low_rank - t.below) / span - eps), min(1.0, (t.high_rank - t.below) / span + eps)

    # Quantiles of one column that still share a bracket, as all do at first, share a sketch.
    slots: dict[tuple, list] = {}
    for k in keys:
        spans = tuple((g, ts[k].lower, ts[k].upper) for g, ts in open_.items() if k in ts)
        slots.setdefault((k[0], spans), []).append(k)
    slot_keys = list(slots.values())
    names = [f"{end}{s}" for s in range(len(slot_keys)) for end in ("a", "z")]
    table = {
        g: [x for ks in slot_keys for x in ((ts[ks[0]].lower, ts[ks[0]].upper) if ks[0] in ts else (None, None))]
        for g, ts in open_.items()
    }
    aggs, points = [], []
    for s, ks in enumerate(slot_keys):
        wanted = sorted({q for ts in open_.values() for k in ks if k in ts for q in asked(ts[k])})
        points.append({q: at for at, q in enumerate(wanted)})
        v = F.col(f"v{ks[0][0]}")
        inside = F.when(v.between(F.col(f"a{s}"), F.col(f"z{s}")), v)
        aggs.append(F.percentile_approx(inside, wanted, SKETCH_ACCURACY).alias(f"q{s}"))
    proposals: dict[tuple, dict] = {}
    for row in _with_brackets(data, by, table, names).groupBy(*by).agg(*aggs).collect():
        g = tuple(row[b] for b in by)
        for s, ks in enumerate(slot_keys):
            for k in ks:
                if k in open_.get(g, {}):
                    low, high = asked(open_[g][k])
                    proposals.setdefault(g, {})[k] = (row[f"q{s}"][points[s][low]], row[f"q{s}"][points[s][high]])

    names = [f"{end}{s}" for s in range(len(keys)) for end in ("a", "z")]
    table = {g: [x for k in keys for x in proposals[g].get(k, (None, None))] for g in open_}
    aggs = []
    for s, (i, _) in enumerate(keys):
        v, a, z = F.col(f"v{i}"), F.col(f"a{s}"), F.col(f"z{s}")
        aggs += [
            F.count(F.when(v < a, 1)).alias(f"lt{s}"),
            F.count(F.when(v <= a, 1)).alias(f"le{s}"),
            F.count(F.when(v < z, 1)).alias(f"zlt{s}"),
            F.count(F.when(v <= z, 1)).alias(f"zle{s}"),
            F.max(F.when(v < a, v)).alias(f"pre{s}"),
            F.min(F.when(v > a, v)).alias(f"post{s}"),
            F.max(F.when(v < z, v)).alias(f"zpre{s}"),
            F.min(F.when(v > z, v)).alias(f"zpost{s}"),
        ]
    for row in _with_brackets(data, by, table, names).groupBy(*by).agg(*aggs).collect():
        g = tuple(row[b] for b in by)
        for s, k in enumerate(keys):
            if k in open_.get(g, {}):
                a, z = proposals[g][k]
                _accept(open_[g][k], a, z, {n: row[f"{n}{s}"] for n in ("lt", "le", "zlt", "zle", "pre", "post", "zpre", "zpost")})


def _accept(t: _Target, a: float, z: float, seen: dict) -> None:
    """Move the bracket to the stretch of sorted values, cut at ``a`` and ``z``, that holds both ranks.

    The cuts give five stretches: below a, a itself, between, z itself, above z; each starts at a counted rank.
    """
    stretches = [
        (t.below, seen["lt"], t.lower, seen["pre"]),
        (seen["lt"], seen["le"], a, a),
        (seen["le"], seen["zlt"], seen["post"], seen["zpre"]),
        (seen["zlt"], seen["zle"], z, z),
        (seen["zle"], t.below + t.inside, seen["zpost"], t.upper),
    ]
    if a == z:
        stretches = [stretches[0], stretches[1], stretches[4]]
    for start, end, first, last in stretches:
        if start <= t.low_rank and t.high_rank < end:
            t.below, t.inside, t.lower, t.upper = start, end - start, first, last
            if first == last:
                t.settle(first, last)
            return
    low = next(last for start, end, _, last in stretches if start <= t.low_rank < end)
    high = next(first for start, end, first, _ in stretches if start <= t.high_rank < end)
    t.settle(low, high)


def _finish(data: DataFrame, by: Sequence[str], open_: dict) -> None:
    """Read the two neighbours of each remaining quantile from the at most ``limit`` values in its bracket."""
    open_ = {g: ts for g, ts in open_.items() if ts}
    if not open_:
        return
    keys = sorted({k for ts in open_.values() for k in ts})
    names = [f"{end}{s}" for s in range(len(keys)) for end in ("a", "z", "l", "h")]
    table = {}
    for g, ts in open_.items():
        table[g] = []
        for k in keys:
            t = ts.get(k)
            table[g] += [t.lower, t.upper, float(t.low_rank - t.below), float(t.high_rank - t.below)] if t else [None] * 4
    slots = [
        F.struct(
            F.lit(s).alias("slot"),
            F.when(F.col(f"v{i}").between(F.col(f"a{s}"), F.col(f"z{s}")), F.col(f"v{i}")).alias("value"),
            F.col(f"l{s}").alias("low"),
            F.col(f"h{s}").alias("high"),
        )
        for s, (i, _) in enumerate(keys)
    ]
    within = F.lit(False)
    for s, (i, _) in enumerate(keys):
        within = within | F.coalesce(F.col(f"v{i}").between(F.col(f"a{s}"), F.col(f"z{s}")), F.lit(False))
    hits = _with_brackets(data, by, table, names).where(within).select(*by, F.inline(F.array(*slots))).where("value is not null")
    counted = hits.groupBy(*by, "slot", "value", "low", "high").agg(F.count("*").alias("n"))
    ranked = counted.withColumn("end", F.sum("n").over(Window.partitionBy(*by, "slot").orderBy("value")))

    def holds(rank: str):
        return F.max(F.when((F.col(rank) < F.col("end")) & (F.col(rank) >= F.col("end") - F.col("n")), F.col("value")))

    for row in ranked.groupBy(*by, "slot").agg(holds("low").alias("x"), holds("high").alias("y")).collect():
        t = open_.get(tuple(row[b] for b in by), {}).get(keys[row["slot"]])
        if t is not None:
            t.settle(row["x"], row["y"])


def part_of_survey(surveyed: list, cols: Sequence[str], wanted: Sequence[str], by: Sequence[str]) -> list:
    """The survey of some of its columns, with their places renumbered."""
    at = [cols.index(c) for c in wanted]
    return [
        {**{b: row[b] for b in by}, **{f"{k}{j}": row[f"{k}{i}"] for j, i in enumerate(at) for k in ("n", "lo", "hi", "d")}}
        for row in surveyed
    ]


def fit_quantiles(
    df: DataFrame, cols: Sequence[str], probs: Sequence[float], by: Sequence[str] = (), few: Sequence[str] | None = None
) -> dict[tuple, dict[str, list[float | None]]]:
    """Exact quantiles on the driver, one small row per group; each column in the way its number of values allows.

    ``few`` are the columns an earlier pass already found to have few distinct values.
    """
    cols = list(cols)
    surveyed = None
    if few is None or set(cols) - set(few):
        surveyed = survey(df, cols, by)
        few = few_distinct(surveyed, cols)
    direct = [c for c in cols if c in few]
    many = [c for c in cols if c not in few]
    out: dict[tuple, dict[str, list[float | None]]] = {}
    if direct:
        plist = F.array(*[F.lit(float(p)) for p in probs])
        aggs = [F.percentile(F.col(c).cast("double"), plist).alias(f"q{i}") for i, c in enumerate(direct)]
        for r in _bounded(df.groupBy(*by).agg(*aggs)):
            found = {c: r[f"q{i}"] for i, c in enumerate(direct)}
            out[tuple(r[b] for b in by)] = {c: [None] * len(probs) if q is None else list(q) for c, q in found.items()}
    if many:
        rest = part_of_survey(surveyed, cols, many, by)
        for g, found in narrow_quantiles(df, many, probs, by, surveyed=rest).items():
            out.setdefault(g, {}).update(found)
    return out


def group_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float], by: Sequence[str], rows_per_bucket: int | None = None) -> DataFrame:
    """Exact quantiles of every column in every group: ``by, feature, q``, for any number of groups and values.

    Equal values are counted first; the counts are then summed in order, range by range, so that no group is sorted in
    one task. A quantile lies between the values at the two ranks next to it. Nothing comes to the driver.
    """
    ensure_checkpoint_dir(df.sparkSession)
    keys = [*by, "feature"]
    each = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in cols])
    long = df.select(*by, F.inline(each)).where(F.col("value").isNotNull())
    counted = long.groupBy(*keys, "value").agg(F.count("*").alias("n")).checkpoint()
    summed = running_sums(with_range_bucket(counted, "value", rows_per_bucket=rows_per_bucket), keys, "bucket", F.col("value").asc(), {"upto": "n"})
    totals = counted.groupBy(*keys).agg(F.sum("n").alias("total"))
    ranked = summed.join(totals, keys)

    def at(rank: Column) -> Column:
        return F.max(F.when((rank < F.col("upto")) & (rank >= F.col("upto") - F.col("n")), F.col("value")))

    out = []
    for p in probs:
        rank = F.lit(float(p)) * (F.col("total") - 1)
        low, high, weight = at(F.floor(rank)), at(F.ceil(rank)), F.max(rank - F.floor(rank))
        out.append(low + (high - low) * weight)
    return ranked.groupBy(*keys).agg(F.array(*out).alias("q"))
