"""Near duplicates by MinHash signatures and a multi-index Hamming join.

Every distinct shingle set has a signature of 64 symbols of 16 bits. Sets as similar as asked differ in at most
``distance`` symbols (five standard deviations above the expected number). The signature is cut into so many chunks
that one of them must hold at most one error (pigeonhole); keys that leave out each symbol of a chunk in turn name all
chunks with that error, so two signatures within the distance always share a key.

Sets that share a key are not paired with each other. First all are compared with the most central of them, which
settles groups of copies with one comparison each and gives linked sets a common label. Keys that still hold different
labels are compared in blocks, where only sets of different labels meet. Every link is confirmed on the full sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gravitas.llm import text as tx
from gravitas.llm.components import components

SYMBOLS = 64
DEVIATIONS = 5
BLOCK_ROWS = 1000

_rng = np.random.default_rng(20)
_MULTIPLY = _rng.integers(0, 1 << 31, SYMBOLS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_ADD = _rng.integers(0, 1 << 32, SYMBOLS, dtype=np.uint32)


@dataclass(frozen=True)
class Similarity:
    """Two sets are near if 100 * intersection >= percent * union."""

    words: int = 5
    percent: int = 80

    @property
    def distance(self) -> int:
        p = self.percent / 100
        return math.ceil(SYMBOLS * (1 - p) + DEVIATIONS * math.sqrt(SYMBOLS * p * (1 - p)))

    @property
    def masks(self) -> list[tuple[int, ...]]:
        """Symbols that make up each key: every chunk without one of its symbols, in all ways."""
        chunks = np.array_split(np.arange(SYMBOLS), self.distance // 2 + 1)
        if min(map(len, chunks)) < 3:
            raise ValueError("the similarity is too low for this number of symbols")
        return [left for chunk in chunks for left in combinations(map(int, chunk), len(chunk) - 1)]

    def near(self, a: np.ndarray, b: np.ndarray) -> bool:
        if 100 * min(len(a), len(b)) < self.percent * max(len(a), len(b)):
            return False
        both = len(np.intersect1d(a, b, assume_unique=True))
        return 100 * both >= self.percent * (len(a) + len(b) - both)


def shingle_sets(texts: pa.Array, words: int) -> list[np.ndarray]:
    """Sorted distinct hashes of the word runs of each text; a shorter text is one run; none without words."""
    data, offsets = tx.bytes_of(texts)
    data = tx.LOWER[data]
    starts, ends, first = tx.word_bounds(data, offsets)
    hashes = tx.span_hashes(data, starts, ends)
    grams = tx.gram_hashes(hashes, words)
    out = []
    for a, b in zip(first[:-1], first[1:]):
        if b - a >= words:
            each = np.sort(grams[a : b - words + 1])
            out.append(each[np.append(True, each[1:] != each[:-1])])
        else:
            out.append(tx.gram_hashes(hashes[a:b], b - a) if b > a else hashes[:0])
    return out


def signature(shingles: np.ndarray) -> np.ndarray:
    low = np.full(SYMBOLS, 0xFFFFFFFF, np.uint32)
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    for i in range(0, len(x), 2048):
        low = np.minimum(low, (_MULTIPLY[:, None] * x[i : i + 2048] + _ADD[:, None]).min(axis=1))
    return ((low * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype("<u2")


def signed(docs: DataFrame, words: int) -> DataFrame:
    """``doc_id, n_shingles, h1, h2, signature``: size, a 128-bit hash of the set, and its signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tx.pieces(batch, "text"):
                sets = shingle_sets(part.column("text"), words)
                whole = [[int(tx.mix(s ^ np.uint64(salt)).sum(dtype=np.uint64).astype(np.int64)) for s in sets] for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), *(pa.array(h, pa.int64()) for h in whole), pa.array([signature(s).tobytes() for s in sets], pa.binary())],
                    names=["doc_id", "n_shingles", "h1", "h2", "signature"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, n_shingles long, h1 long, h2 long, signature binary")


def chunk_keys(nodes: DataFrame, similarity: Similarity) -> DataFrame:
    """``node, key``: one row per set and key."""
    masks = similarity.masks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                symbols = np.frombuffer(b"".join(part.column("signature").to_pylist()), "<u2").reshape(-1, SYMBOLS).astype(np.uint64)
                keys = np.empty((len(symbols), len(masks)), np.uint64)
                for i, mask in enumerate(masks):
                    key = np.full(len(symbols), i + 1, np.uint64)
                    for s in mask:
                        key = tx.mix(key * np.uint64(0xD6E8FEB86659FD93) + symbols[:, s])
                    keys[:, i] = key
                node = part.column("node").take(pa.array(np.repeat(np.arange(len(symbols)), len(masks))))
                yield pa.RecordBatch.from_arrays([node, pa.array(keys.reshape(-1).view(np.int64))], names=["node", "key"])

    kind = nodes.schema["node"].dataType.simpleString()
    return nodes.select("node", "signature").mapInArrow(run, f"node {kind}, key long")


def central_pairs(members: DataFrame) -> DataFrame:
    """``a, b, weight``: each set with the most central one of every key it has; central sets share most keys with
    others, which is their weight.

    As elsewhere here, what is joined to rows of a frequent key is written first: adaptive execution splits such a
    key's rows only where nothing but the join follows the shuffle.
    """
    weight = members.groupBy("node").agg(F.sum("n").alias("weight"))
    hubs = tx.written(members.join(weight, "node").groupBy("key").agg(F.max(F.struct("weight", "node")).alias("hub")), "hubs")
    pairs = members.join(hubs, "key").where("hub.node <> node")
    return pairs.select(F.col("hub.node").alias("a"), F.col("node").alias("b"), F.col("hub.weight").alias("weight")).distinct()


def full_sets(docs: DataFrame, nodes: DataFrame, words: int) -> DataFrame:
    """``node, shingles`` (binary) for the given nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tx.pieces(batch, "text"):
                sets = [s.tobytes() for s in shingle_sets(part.column("text"), words)]
                yield pa.RecordBatch.from_arrays([part.column("node"), pa.array(sets, pa.binary())], names=["node", "shingles"])

    kind = nodes.schema["node"].dataType.simpleString()
    chosen = docs.withColumnRenamed("doc_id", "node").join(nodes, "node", "left_semi")
    return chosen.select("node", "text").mapInArrow(run, f"node {kind}, shingles binary")


def confirmed(pairs: DataFrame, sets: DataFrame, similarity: Similarity) -> DataFrame:
    """The pairs whose full sets are near."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = zip(batch.column("x").to_pylist(), batch.column("y").to_pylist())
            near = [similarity.near(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in both]
            yield batch.select(["a", "b", "weight"]).filter(pa.array(near, pa.bool_()))

    of = lambda name, as_: sets.select(F.col("node").alias(name), F.col("shingles").alias(as_))
    return pairs.join(of("b", "y"), "b").join(of("a", "x"), "a").select("a", "b", "weight", "x", "y").mapInArrow(run, pairs.schema)


def labels_of(links: DataFrame) -> DataFrame:
    """``node, label`` of linked sets: the heaviest set linked to a set, or what that one is linked to in turn.

    Equal labels mean one component; one component may still have several labels.
    """
    best = tx.written(links.groupBy("b").agg(F.max(F.struct("weight", "a"))["a"].alias("label")).withColumnRenamed("b", "node"), "labels")
    up = best.select(F.col("node").alias("label"), F.col("label").alias("next"))
    return best.join(up, "label", "left").select("node", F.coalesce("next", "label").alias("label"))


def open_rows(members: DataFrame, labels: DataFrame) -> DataFrame:
    """``cluster, node, label`` of sets that share a key with sets of another label.

    A cluster gathers the keys with one smallest label, so that a pair with several keys meets in few clusters.
    """
    labelled = members.select("key", "node").join(labels, "node", "left").select("key", "node", F.coalesce("label", "node").alias("label"))
    labelled = tx.written(labelled, "labelled")
    opened = labelled.groupBy("key").agg(F.min("label").alias("cluster"), F.max("label").alias("last")).where("cluster <> last").drop("last")
    opened = tx.written(opened, "opened")
    return tx.written(labelled.join(opened, "key").select("cluster", "node", "label").distinct(), "open")


def block_links(rows: DataFrame, sets: DataFrame, nodes: DataFrame, similarity: Similarity, block_rows: int) -> DataFrame:
    """Links between sets of different labels in one cluster.

    The sets of a cluster's largest label are not compared with each other. All other sets form blocks of about
    ``block_rows``, which meet each other and the blocks of the largest label in cells of bounded size. A cell gives
    only links that join labels, fewer than it has labels.
    """
    sizes = rows.groupBy("cluster", "label").count()
    top = sizes.groupBy("cluster").agg(F.max(F.struct("count", "label")).alias("top"), F.sum("count").alias("n"))
    blocks = lambda n: F.greatest(F.ceil(n / block_rows), F.lit(1)).cast("int")
    top = top.select("cluster", F.col("top.label").alias("main"), blocks(F.col("top.count")).alias("m"), blocks(F.col("n") - F.col("top.count")).alias("r"))
    placed = rows.join(top, "cluster").withColumn("rest", F.col("label") != F.col("main"))
    placed = placed.withColumn("own", F.pmod(F.xxhash64("node"), F.when(F.col("rest"), F.col("r")).otherwise(F.col("m"))).cast("int"))
    span = lambda n: F.sequence(F.lit(0), n - 1)
    cell = lambda i, j, side: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), F.lit(side).alias("side"))
    # A cell (i, j) compares block i of the rest with its other side: block j of the rest, or block -1-j of the largest.
    of_rest = F.concat(
        F.transform(span(F.col("m")), lambda j: cell(F.col("own"), -1 - j, 0)),
        F.transform(span(F.col("r")), lambda j: F.when(j >= F.col("own"), cell(F.col("own"), j, 0)).otherwise(cell(j, F.col("own"), 1))),
    )
    of_main = F.transform(span(F.col("r")), lambda i: cell(i, -1 - F.col("own"), 1))
    dealt = placed.select("cluster", "node", "label", F.inline(F.when(F.col("rest"), of_rest).otherwise(of_main)))
    full = dealt.join(nodes.select("node", "signature"), "node").join(sets, "node")

    def compare(cell: pa.Table) -> pa.Table:
        side = cell.column("side").to_numpy()
        symbols = np.frombuffer(b"".join(cell.column("signature").to_pylist()), "<u2").reshape(-1, SYMBOLS)
        shingles = [np.frombuffer(s, np.uint64) for s in cell.column("shingles").to_pylist()]
        label = np.unique(np.array(cell.column("label").to_pylist(), dtype=object).astype(str), return_inverse=True)[1]
        left = np.flatnonzero(side == 0)
        right = np.flatnonzero(side == 1) if (side == 1).any() else left
        joined = {}

        def root(x: int) -> int:
            while x in joined:
                x = joined[x]
            return x

        found = []
        for a in left:
            far = (symbols[right] != symbols[a]).sum(axis=1)
            for b in right[(far <= similarity.distance) & (label[right] != label[a])]:
                x, y = root(int(label[a])), root(int(label[b]))
                if x != y and similarity.near(shingles[a], shingles[b]):
                    joined[max(x, y)] = min(x, y)
                    found.append((int(a), int(b)))
        node = cell.column("node")
        take = lambda k: node.take(pa.array([f[k] for f in found], pa.int64()))
        return pa.table({"a": take(0), "b": take(1)})

    kind = rows.schema["node"].dataType.simpleString()
    return full.select("cluster", "i", "j", "side", "node", "label", "signature", "shingles").groupBy("cluster", "i", "j").applyInArrow(compare, f"a {kind}, b {kind}")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: Similarity = Similarity(), block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every document.

    A document's set holds the distinct runs of ``similarity.words`` words, A-Z in lower case; a shorter text is one
    run; a text without words (or null) has an empty set and is linked with nothing. ``component_id`` is the smallest
    id that can be reached over links, the own one included, and the document with that id is kept. Rows that share an
    id are one document, see ``unique_documents``; a null id is linked with nothing and kept. An empty table gives an
    empty result. Only the two named columns are read.
    """
    plain = tx.unique_documents(docs, id_col, text_col)
    with tx.scratch():
        sets = tx.written(signed(plain, similarity.words), "signatures")
        linked = sets.where("n_shingles > 0 and doc_id is not null")
        classes = tx.written(linked.groupBy("h1", "h2").agg(F.min("doc_id").alias("node")), "classes")
        tagged = tx.written(linked.join(classes, ["h1", "h2"]).select("doc_id", "node", "signature"), "classes")
        nodes = tagged.where("doc_id = node").select("node", "signature")

        keys = chunk_keys(nodes, similarity)
        shared = tx.written(keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "shared")
        members = tx.written(keys.join(shared, "key"), "members")
        full = tx.written(full_sets(plain, members.select("node").distinct(), similarity.words), "sets")
        links = tx.written(confirmed(central_pairs(members), full, similarity), "links")
        rows = open_rows(members, labels_of(links))
        more = tx.written(block_links(rows, full, nodes, similarity, block_rows), "links")
        groups = tx.written(components(links.select("a", "b").unionByName(more)), "groups")

        classes = tagged.select("doc_id", "node").join(groups, "node", "left").select(F.col("doc_id").alias("_id"), F.coalesce("component", "node").alias("component"))
        out = sets.join(classes, F.col("doc_id") == F.col("_id"), "left").withColumn("component_id", F.coalesce("component", "doc_id"))
        done = out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
        return tx.kept(tx.written(done, "components"))
