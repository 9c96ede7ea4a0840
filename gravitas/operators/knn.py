"""Exact k nearest neighbours without comparing all pairs of a group.

Identical vectors are first collapsed, so a vector with any number of copies is compared once. The rest is cut into
cells around pivots, and a cell with many vectors into cells around pivots of its own, until all are small: a tree of
any number of cells, each held as a row. Each vector is compared with its own cell; the distance to its k-th neighbour
there bounds what can matter. Neighbouring cells then form blocks of bounded size, and balls around their parts tell
which pairs of blocks can hold a near pair. Only these meet, so a vector moves once per block, not once per cell. Inside
a pair of blocks, balls around cells close most of them for each vector, the nearest cells come first and tighten the
bound, and a matrix product leaves few pairs whose distance is taken. A pair of blocks emits k neighbours per vector.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gravitas.functions.hashing import order_key
from gravitas.session import ensure_checkpoint_dir

CELL_ROWS = 2_000
BLOCK_ROWS = 4_096
#: Pivots of one cell that is cut, and how often cells are cut; what is still large then is compared in blocks.
FANOUT = 32
MAX_DEPTH = 16
#: Vectors of a block of neighbouring cells, and those of them that are compared at a time.
SEARCH_ROWS = 16_384
SLICE = 512
SLACK = 1e-9

EDGE = "g string, q bigint, v bigint, dist double"
MEMBER = "g string, v bigint, vec array<double>, cell string"
BALL = "g string, block bigint, part string, centre array<double>, radius double"


def squared_distances(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sum over dimensions in order, so a pair has the same distance in every block."""
    total = np.zeros((len(left), len(right)))
    for j in range(left.shape[1]):
        step = left[:, j, None] - right[None, :, j]
        total += step * step
    return total


def _block_nearest(k: int):
    def nearest(queries: pd.DataFrame, members: pd.DataFrame) -> pd.DataFrame:
        if queries.empty or members.empty:
            return pd.DataFrame({"g": [], "q": [], "v": [], "dist": []})
        q = np.stack(queries["vec"].to_numpy())
        m = np.stack(members["m_vec"].to_numpy())
        qid, vid = queries["q"].to_numpy(), members["v"].to_numpy()
        out_q, out_v, out_d = [], [], []
        for at in range(0, len(q), SLICE):
            dist = np.sqrt(squared_distances(q[at : at + SLICE], m))
            if dist.shape[1] > k:
                kth = np.partition(dist, k - 1, axis=1)[:, k - 1 : k]
                row, col = np.nonzero(dist <= kth)
            else:
                row, col = np.nonzero(np.ones_like(dist, dtype=bool))
            found, ids = dist[row, col], vid[col]
            order = np.lexsort((ids, found, row))
            row, found, ids = row[order], found[order], ids[order]
            place = np.arange(len(row)) - np.searchsorted(row, row, side="left")
            keep = place < k
            out_q.append(qid[at + row[keep]])
            out_v.append(ids[keep])
            out_d.append(found[keep])
        n = sum(len(x) for x in out_q)
        return pd.DataFrame(
            {
                "g": np.repeat(queries["g"].iloc[0], n),
                "q": np.concatenate(out_q),
                "v": np.concatenate(out_v),
                "dist": np.concatenate(out_d),
            }
        )

    return nearest


def _nearest_pivot(queries: pd.DataFrame, members: pd.DataFrame) -> pd.DataFrame:
    """The child cell of each vector, that of its nearest pivot."""
    if queries.empty or members.empty:
        return pd.DataFrame({c: pd.Series([], dtype=object) for c in ("g", "v", "vec", "cell")})
    members = members.sort_values("v")
    vec, pivots = np.stack(queries["vec"].to_numpy()), np.stack(members["m_vec"].to_numpy())
    cell = np.zeros(len(vec), np.int64)
    for lo in range(0, len(vec), SLICE):
        cell[lo : lo + SLICE] = squared_distances(vec[lo : lo + SLICE], pivots).argmin(axis=1)
    parent = queries["cell"].iloc[0]
    return pd.DataFrame({"g": queries["g"], "v": queries["q"], "vec": queries["vec"], "cell": [f"{parent}.{i}" for i in cell]})


def _ball(rows: pd.DataFrame) -> pd.DataFrame:
    """A ball that holds all vectors of a part."""
    vec = np.stack(rows["vec"].to_numpy())
    centre = vec.mean(axis=0)
    radius = np.sqrt(squared_distances(vec, centre[None, :]).max())
    return pd.DataFrame({"g": [rows["g"].iloc[0]], "block": [rows["block"].iloc[0]], "part": [rows["part"].iloc[0]], "centre": [centre], "radius": [radius]})


def paired_distances(left: np.ndarray, right: np.ndarray, row: np.ndarray, col: np.ndarray) -> np.ndarray:
    """Distances of the named pairs, added up in the same order as in ``squared_distances``."""
    total = np.zeros(len(row))
    for j in range(left.shape[1]):
        step = left[row, j] - right[col, j]
        total += step * step
    return np.sqrt(total)


def _search(need: int) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """The ``need`` nearest members within the bound for each query of a block, those of its own cell left out."""

    def search(queries: pd.DataFrame, members: pd.DataFrame) -> pd.DataFrame:
        if queries.empty or members.empty:
            return pd.DataFrame({"g": [], "q": [], "v": [], "dist": []})
        queries, members = queries.sort_values(["leaf", "q"]), members.sort_values(["m_leaf", "v"])
        vec, them = np.stack(queries["vec"].to_numpy()), np.stack(members["m_vec"].to_numpy())
        own, bounds, qid, vid = *(queries[c].to_numpy() for c in ("leaf", "bound", "q")), members["v"].to_numpy()
        leaves, starts, sizes = np.unique(members["m_leaf"].to_numpy(), return_index=True, return_counts=True)
        centres = np.add.reduceat(them, starts, axis=0) / sizes[:, None]
        away = paired_distances(them, centres, np.arange(len(them)), np.repeat(np.arange(len(leaves)), sizes))
        radius = np.maximum.reduceat(away, starts)
        norms, out = (them * them).sum(axis=1), []
        for lo in range(0, len(vec), SLICE):
            part = slice(lo, lo + SLICE)
            bound, some = bounds[part].copy(), vec[part]
            lengths = (some * some).sum(axis=1)
            least = np.sqrt(squared_distances(some, centres)) * (1 - SLACK) - radius * (1 + SLACK)
            other = own[part][:, None] != leaves
            row, ids, dist = np.zeros(0, np.int64), vid[:0], np.zeros(0)
            order = np.argsort(least.min(axis=0), kind="stable")
            turn = (np.cumsum(sizes[order]) - 1) // BLOCK_ROWS
            for now in np.unique(turn):
                cells, limit = order[turn == now], bound * (1 + SLACK) + SLACK
                opened = other[:, cells] & (least[:, cells] <= limit[:, None])
                used = opened.any(axis=0)
                if not used.any():
                    continue
                cells, opened = cells[used], opened[:, used]
                at = np.concatenate([np.arange(starts[c], starts[c] + sizes[c]) for c in cells])
                squares = lengths[:, None] + norms[at]
                near = ~(squares - 2 * (some @ them[at].T) > (limit * limit)[:, None] + SLACK * squares)
                near &= np.repeat(opened, sizes[cells], axis=1)
                r, c = np.nonzero(near)
                d = paired_distances(some, them, r, at[c])
                kept = d <= limit[r]
                row, ids, dist = np.concatenate([row, r[kept]]), np.concatenate([ids, vid[at[c[kept]]]]), np.concatenate([dist, d[kept]])
                by = np.lexsort((ids, dist, row))
                row, ids, dist = row[by], ids[by], dist[by]
                place = np.arange(len(row)) - np.searchsorted(row, row, side="left")
                row, ids, dist, place = (x[place < need] for x in (row, ids, dist, place))
                last = place == need - 1
                bound[row[last]] = np.minimum(bound[row[last]], dist[last])
            out.append(pd.DataFrame({"g": queries["g"].iloc[0], "q": qid[part][row], "v": ids, "dist": dist}))
        return pd.concat(out)

    return search


def _meet(queries: DataFrame, members: DataFrame, each: Callable, schema: str, whole: bool = False) -> DataFrame:
    """Bring the queries of a cell and its members together; big cells are cut into chunks on both sides, or only the
    queries if a cell's members, of which there are few, must be seen as a whole.

    ``queries`` has ``g, cell, q, vec`` and more, ``members`` ``g, cell, v, vec``.
    """

    def chunks(n):
        return F.greatest(F.ceil(n / F.lit(BLOCK_ROWS)), F.lit(1)).cast("int")

    asked = queries.groupBy("g", "cell").agg(chunks(F.count("*")).alias("qc"))
    plan = members.groupBy("g", "cell").agg((F.lit(1) if whole else chunks(F.count("*"))).alias("mc")).join(asked, ["g", "cell"])
    left = (
        queries.join(plan, ["g", "cell"])
        .withColumn("qk", F.pmod(F.xxhash64("q"), F.col("qc")).cast("int"))
        .withColumn("mk", F.explode(F.sequence(F.lit(0), F.col("mc") - 1)))
    )
    right = (
        members.join(plan, ["g", "cell"])
        .withColumn("mk", F.pmod(F.xxhash64("v"), F.col("mc")).cast("int"))
        .withColumn("qk", F.explode(F.sequence(F.lit(0), F.col("qc") - 1)))
    )
    keys = ["g", "cell", "qk", "mk"]
    a = left.select(*keys, *[c for c in queries.columns if c not in keys]).groupBy(*keys)
    b = right.select(*[F.col(c).alias(f"m_{c}") for c in keys], "v", F.col("vec").alias("m_vec"))
    return a.cogroup(b.groupBy(*[f"m_{c}" for c in keys])).applyInPandas(each, schema)


def _blocks(queries: DataFrame, members: DataFrame, k: int) -> DataFrame:
    """The k nearest members of its cell for each query and chunk of the cell."""
    return _meet(queries.select("g", "cell", "q", "vec"), members, _block_nearest(k), EDGE)


def _first_k(edges: DataFrame, k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("q").orderBy("dist", "v"))
    return edges.withColumn("place", place).where(F.col("place") <= k).drop("place")


def collapse(points: DataFrame, keep: int) -> DataFrame:
    """One row per distinct vector of a group: ``v`` the smallest id, ``ids`` the smallest few with their tags."""
    order = Window.partitionBy("g", "vec").orderBy("id")
    few = points.withColumn("at", F.row_number().over(order)).where(F.col("at") <= keep)
    return few.groupBy("g", "vec").agg(F.min("id").alias("v"), F.sort_array(F.collect_list(F.struct("id", "tag"))).alias("ids"))


def cell_tree(distinct: DataFrame, cell_rows: int) -> DataFrame:
    """Members with their last cell: ``r`` if a group is one cell, else a path of numbers below it.

    A cell with more than ``cell_rows`` members is cut around those of its members that have the smallest hash.
    """
    members = distinct.select("g", "v", "vec", F.lit("r").alias("cell"))
    for depth in range(MAX_DEPTH):
        large = members.groupBy("g", "cell").count().where(F.col("count") > cell_rows).select("g", "cell").checkpoint()
        if large.isEmpty():
            break
        inside = members.join(large, ["g", "cell"], "left_semi")
        place = F.row_number().over(Window.partitionBy("g", "cell").orderBy(order_key(F.col("v"), depth), "v"))
        pivots = inside.withColumn("place", place).where(F.col("place") <= FANOUT).select("g", "cell", "v", "vec").checkpoint()
        cut = _meet(inside.select("g", "cell", F.col("v").alias("q"), "vec"), pivots, _nearest_pivot, MEMBER, whole=True)
        members = members.join(large, ["g", "cell"], "left_anti").unionByName(cut).checkpoint()
    return members


def leaf_blocks(members: DataFrame) -> DataFrame:
    """``g, cell, n, leaf, part``: size, first place and part of each last cell, in the order of the tree.

    A part is the largest cell around it that fits a block, so the vectors of a part lie together in space.
    """
    leaves = members.groupBy("g", "cell").agg(F.count("*").alias("n"))
    path = F.split("cell", r"\.")
    tops = F.transform(F.sequence(F.lit(1), F.size(path)), lambda i: F.struct(i.alias("depth"), F.array_join(F.slice(path, F.lit(1), i), ".").alias("top")))
    above = leaves.select("g", "cell", "n", F.inline(tops))
    fits = above.groupBy("g", "top").agg(F.sum("n").alias("m")).where(F.col("m") <= SEARCH_ROWS).select("g", "top")
    part = above.join(fits, ["g", "top"]).groupBy("g", "cell").agg(F.min_by("top", "depth").alias("part"))
    before = F.sum("n").over(Window.partitionBy("g").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1))
    return leaves.join(part, ["g", "cell"], "left").select("g", "cell", "n", F.coalesce(before, F.lit(0)).alias("leaf"), F.coalesce("part", "cell").alias("part"))


def block_pairs(placed: DataFrame, asked: DataFrame) -> DataFrame:
    """``g, block, part, mblock``: parts of queries and blocks of members that may hold a pair within its query's bound."""
    balls = placed.select("g", "block", "part", "vec").groupBy("g", "block", "part").applyInPandas(_ball, BALL).checkpoint()
    far = asked.groupBy("g", "block", "part").agg(F.max("bound").alias("far"))
    members = balls.select("g", F.col("block").alias("mblock"), F.col("centre").alias("m_centre"), F.col("radius").alias("m_radius"))
    apart = F.sqrt(F.aggregate(F.zip_with("centre", "m_centre", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, x: a + x))
    gap = apart * (1 - SLACK) - (F.col("radius") + F.col("m_radius")) * (1 + SLACK)
    near = balls.join(far, ["g", "block", "part"]).join(members, "g").where(gap <= F.col("far") * (1 + SLACK) + SLACK)
    return near.select("g", "block", "part", "mblock").distinct().checkpoint()


def searched(edges: DataFrame, asked: DataFrame, members: DataFrame, need: int) -> DataFrame:
    """The ``need`` nearest of each vector of ``asked`` among all cells of its group.

    ``edges`` are the nearest of the own cell. Vectors move once for each block that theirs meets.
    """
    leaves = leaf_blocks(members.where("cell <> 'r'")).checkpoint()
    block = F.floor((F.col("leaf") + F.pmod(F.xxhash64("v"), F.col("n"))) / SEARCH_ROWS)
    placed = members.join(leaves, ["g", "cell"]).select("g", "v", "vec", "leaf", "part", block.alias("block"))
    reached = edges.groupBy(F.col("q").alias("v")).agg(F.count("*").alias("n"), F.max("dist").alias("far"))
    bound = F.when(F.col("n") >= need, F.col("far")).otherwise(F.lit(float("inf")))
    bounded = placed.join(asked.select("v"), "v", "left_semi").join(reached, "v").select(
        "g", "block", "part", F.col("v").alias("q"), "vec", "leaf", bound.alias("bound")
    ).checkpoint()
    pairs = block_pairs(placed, bounded)
    keys = ["g", "block", "mblock"]
    left = bounded.join(pairs, ["g", "block", "part"]).select(*keys, "q", "vec", "leaf", "bound").groupBy(*keys)
    right = placed.withColumnRenamed("block", "mblock").join(pairs.select(*keys).distinct(), ["g", "mblock"]).select(
        *[F.col(c).alias(f"m_{c}") for c in keys], "v", F.col("vec").alias("m_vec"), F.col("leaf").alias("m_leaf")
    )
    found = left.cogroup(right.groupBy(*[f"m_{c}" for c in keys])).applyInPandas(_search(need), EDGE)
    return _first_k(edges.unionByName(found), need).checkpoint()


def nearest_neighbours(
    points: DataFrame, k: int, queries: DataFrame | None = None, cell_rows: int | None = None
) -> DataFrame:
    """k nearest other points of the same group for each query, nearer first, equally near ones by id.

    ``points`` has ``id`` unique, of any type that sorts, ``g`` string, ``vec`` array<double> without nulls, and may have a string ``tag``
    that neighbours carry along; ``queries`` has a subset of its ids. The result has ``id``, ``g``, ``tag``, ``vec`` and
    ``neighbours``, an array of (dist, id, tag, vec).
    """
    spark = points.sparkSession
    ensure_checkpoint_dir(spark)
    tag = F.col("tag") if "tag" in points.columns else F.lit(None).cast("string")
    points = points.select("id", "g", "vec", tag.alias("tag"))
    distinct = collapse(points, k + 1).checkpoint()
    if distinct.isEmpty():
        raise ValueError("no points")
    members = cell_tree(distinct, cell_rows or CELL_ROWS)
    asked = members
    if queries is not None:
        ids = points.join(queries.select("id"), "id", "left_semi").select("g", "vec").distinct()
        asked = members.join(ids, ["g", "vec"], "left_semi")
    asked = asked.withColumn("q", F.col("v"))
    need = k + 1
    edges = _first_k(_blocks(asked, members, need), need).checkpoint()
    if not members.where("cell <> 'r'").isEmpty():
        edges = searched(edges, asked, members, need)

    found = edges.join(distinct.select("v", F.col("ids"), F.col("vec").alias("nvec")), "v")
    rows = F.flatten(
        F.transform(
            F.collect_list(F.struct("dist", "ids", "nvec")),
            lambda e: F.transform(
                e["ids"],
                lambda i: F.struct(e["dist"].alias("dist"), i["id"].alias("id"), i["tag"].alias("tag"), e["nvec"].alias("vec")),
            ),
        )
    )
    lists = found.groupBy("q").agg(rows.alias("all")).select("q", F.slice(F.sort_array("all"), 1, need).alias("near"))
    # Lists meet their vectors first, one row each; only this last join has as many rows as a vector has copies.
    listed = distinct.select("g", "vec", F.col("v").alias("q")).join(lists, "q").drop("q")
    wanted_points = points if queries is None else points.join(queries.select("id"), "id", "left_semi")
    return wanted_points.join(listed, ["g", "vec"]).select(
        "id", "g", "tag", "vec", F.slice(F.filter("near", lambda e: e["id"] != F.col("id")), 1, k).alias("neighbours")
    )


def neighbour_pairs(near: DataFrame) -> DataFrame:
    """One row per point and neighbour with its place."""
    return near.select("id", "g", F.posexplode("neighbours").alias("pos", "e")).select(
        "id", "g", (F.col("pos") + 1).alias("place"), F.col("e.id").alias("neighbour_id"), F.col("e.dist").alias("distance")
    )


def as_points(
    df: DataFrame, row_id: str, features: Sequence[str], group: str | None = None, tag: str | None = None
) -> DataFrame:
    """Rows as points; group and tag are taken as text, and there is one group if none is named."""
    g = F.col(group).cast("string") if group else F.lit("")
    t = F.col(tag).cast("string") if tag else F.lit(None).cast("string")
    vec = F.array(*[F.col(c).cast("double") for c in features])
    return df.select(F.col(row_id).alias("id"), g.alias("g"), vec.alias("vec"), t.alias("tag"))
