"""Byte-level BPE by recursive SQL: every task runs DuckDB on the distinct words of its texts.

A word is a match of the vocabulary's pattern. Its bytes are rows (word, position, token). Each step of a recursive
query joins neighbouring rows with the merge table, contracts the leftmost pairs of minimum rank of every word, and
stops when no pair of any word can be merged. Equal pairs that do not overlap are contracted in one step, left to
right: what a merge makes has a higher rank in a vocabulary built by merges, so no other pair can come between.
Decoding joins token rows with the vocabulary and puts their bytes together in order of position.

Spark deals the texts out; the queries inside a task are small helpers on at most a few MB of text.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gravitas.llm import text as tx

BLOCK_BYTES = 4 << 20
#: Characters of words that a task keeps with their tokens; beyond it starts afresh. Changes speed alone.
KEPT_CHARACTERS = 8 << 20
#: Steps of one recursive query, which holds the rows of all its steps; words that need more go through another one.
STEPS = 32

#: Rows come in order of position and one thread keeps them so; the first line inside checks it at every step.
CONTRACT = f"""
with recursive s(k, w, p, t) as (
    select 0, w, p, t from start
    union all (
        with pairs as (
            select k, w, p, t, case when lead(w) over () = w then if(lead(p) over () > p, lead(t) over (), error('rows out of order')) end as next from s
        ),
        ranked as (select pairs.*, merged from pairs left join merges on t = a and next = b),
        least as (select w, min(merged) as best from ranked where merged is not null group by w),
        hits as (select ranked.*, merged is not null and merged = best as hit from ranked join least using (w)),
        chains as (select *, row_number() over () as no, case when hit and not coalesce(lag(hit) over (), false) then row_number() over () end as begins from hits),
        taken as (select *, hit and (no - max(begins) over (rows between unbounded preceding and current row)) % 2 = 0 as take from chains),
        marked as (select *, coalesce(lag(take) over (), false) as gone from taken)
        select k + 1, w, p, case when take then merged else t end from marked where not gone and k < {STEPS}
    )
)
select k, w, p, t from s
"""
LAST = "select k, w, p, t from steps join (select w, max(k) as k from steps group by w) using (w, k) order by p"
JOIN = """
select unhex(string_agg(coalesce(bytes, error('no token has this id')), '' order by p)) as text
from tokens left join vocabulary using (t) group by d order by d
"""


class SqlBpe:
    """A vocabulary of ranks (base64 token, rank per line) in a database of the task, with the words met so far."""

    def __init__(self, spec: bytes, pattern: str):
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, spec.splitlines())}
        self.single = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = [(self.ranks[t[:i]], self.ranks[t[i:]], r) for t, r in self.ranks.items() for i in range(1, len(t)) if t[:i] in self.ranks and t[i:] in self.ranks]
        # No spill to a local folder; one thread keeps rows in order.
        self.con = duckdb.connect(config={"threads": 1, "temp_directory": ""})
        self.load("merges", pa.table(dict(zip("ab", (pa.array([p[i] for p in pairs], pa.int32()) for i in (0, 1)))) | {"merged": pa.array([p[2] for p in pairs], pa.int32())}))
        self.load("vocabulary", pa.table({"t": pa.array(list(self.ranks.values()), pa.int32()), "bytes": [t.hex() for t in self.ranks]}))
        self.pattern = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        self.forget()

    def load(self, name: str, table: pa.Table) -> None:
        self.con.register("loaded", table)
        self.con.execute(f"create table {name} as select * from loaded")
        self.con.unregister("loaded")

    def forget(self) -> None:
        self.words: dict[str, int] = {}
        self.chunks: dict[str, list[int]] = {}
        self.ids, self.offsets, self.kept = np.zeros(0, np.int32), np.zeros(1, np.int64), 0

    def contracted(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all words one after the other, and how many each has."""
        whole = np.array([self.ranks.get(w, -1) for w in words], np.int32)
        sizes = np.where(whole < 0, np.array([len(w) for w in words], np.int64), 1)
        token = np.repeat(whole, sizes)
        token[token < 0] = self.single[np.frombuffer(b"".join(w for w, r in zip(words, whole.tolist()) if r < 0), np.uint8)]
        owner = np.repeat(np.arange(len(words), dtype=np.int32), sizes)
        place = np.arange(len(token), dtype=np.int64)
        done, todo = [], [np.repeat(whole, sizes) < 0]
        done.append(tuple(x[~todo[0]] for x in (owner, place, token)))
        state = tuple(x[todo[0]] for x in (owner, place, token))
        while len(state[0]):
            self.con.register("start", pa.table(list(map(pa.array, state)), names=["w", "p", "t"]))
            self.con.register("steps", self.con.sql(CONTRACT).to_arrow_table())
            last = self.con.sql(LAST).to_arrow_table()
            open_ = last.column("k").to_numpy() >= STEPS
            rows = [last.column(c).to_numpy() for c in ("w", "p", "t")]
            done.append(tuple(x[~open_] for x in rows))
            state = tuple(x[open_] for x in rows)
        owner, place, token = (np.concatenate(x) for x in zip(*done))
        return token[np.argsort(place)], np.bincount(owner, minlength=len(words))

    def split(self, chunk: str) -> list[int]:
        """Numbers of a chunk's words, kept for the next time."""
        numbers = [self.words.setdefault(w, len(self.words)) for w in self.pattern.findall(chunk)]
        self.chunks[chunk] = numbers
        self.kept += 2 * len(chunk)
        return numbers

    def numbers(self, text: str) -> list[int]:
        """Words of a text by number. A single space begins a word, so texts without double spaces are cut there."""
        if "  " in text:
            return self.split(text)
        out: list[int] = []
        known, split, first = self.chunks, self.split, True
        for part in text.split(" "):
            chunk = part if first else " " + part
            first = False
            out += known.get(chunk) or split(chunk)
        return out

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all texts one after the other, and how many each has."""
        each = [self.numbers(t) if t else [] for t in texts]
        if new := list(self.words)[len(self.offsets) - 1 :]:
            ids, sizes = self.contracted([w.encode() for w in new])
            self.ids = np.concatenate((self.ids, ids))
            self.offsets = np.concatenate((self.offsets, self.offsets[-1] + np.cumsum(sizes)))
        counts = np.array([len(x) for x in each], np.int64)
        at = np.fromiter((n for x in each for n in x), np.int64, int(counts.sum()))
        ids, ends = tx.join_spans(self.ids, self.offsets[at], self.offsets[at + 1])
        last = np.cumsum(counts)
        if self.kept > KEPT_CHARACTERS:
            self.forget()
        return ids, ends[last] - ends[last - counts]

    def decode(self, ids: np.ndarray, sizes: np.ndarray) -> list[bytes]:
        """The bytes of every run of ids."""
        rows = pa.table({"d": np.repeat(np.arange(len(sizes), dtype=np.int32), sizes), "p": np.arange(len(ids), dtype=np.int64), "t": ids.astype(np.int32)})
        self.con.register("tokens", rows)
        out = np.full(len(sizes), b"", object)
        out[np.flatnonzero(sizes)] = self.con.sql(JOIN).to_arrow_table().column("text").to_pylist()
        return out.tolist()


def packed_ids(ids: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Little-endian unsigned 32-bit numbers of each text as bytes."""
    return tx.binary_array(ids.astype("<u4").view(np.uint8), 4 * np.concatenate(([0], np.cumsum(sizes))))


def vocabulary_file(path: str | None) -> bytes:
    with open(path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        return f.read()


def encode_documents(docs: DataFrame, text_col: str = "text", path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """``docs`` with ``ids`` (binary: little-endian unsigned 32-bit numbers) and ``decoded`` (binary) of each whole text.

    ``path`` names the file of ranks on the driver; its content travels to the tasks, its size is that of the file. Null
    and empty texts give no bytes in both. Every row stands for itself, so repeated rows and ids give equal results. An
    empty table gives an empty result. Other columns stay, except any of the names ``ids`` and ``decoded``; columns of
    the same name must be told apart by the caller first.
    """
    spec = docs.sparkSession.sparkContext.broadcast(vocabulary_file(path))
    kept = docs.drop("ids", "decoded")
    schema = kept.withColumn("ids", F.lit(b"")).withColumn("decoded", F.lit(b"")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = SqlBpe(spec.value, pattern)
        for batch in batches:
            for part in tx.pieces(batch, text_col, BLOCK_BYTES):
                ids, sizes = bpe.encode(part.column(text_col).to_pylist())
                decoded = pa.array(bpe.decode(ids, sizes), pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns, packed_ids(ids, sizes), decoded], names=schema.names)

    return kept.mapInArrow(run, schema)


def decode_documents(docs: DataFrame, ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """``docs`` with ``decoded`` (binary): the bytes of the packed ids in ``ids_col``. Null counts as no ids; an id that
    the vocabulary lacks is an error. A column named ``decoded`` is replaced, all others stay."""
    spec = docs.sparkSession.sparkContext.broadcast(vocabulary_file(path))
    kept = docs.drop("decoded")
    schema = kept.withColumn("decoded", F.lit(b"")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = SqlBpe(spec.value, public_tokenizers.PATTERN)
        for batch in batches:
            for part in tx.pieces(batch, ids_col, BLOCK_BYTES):
                data, offsets = tx.bytes_of(part.column(ids_col))
                decoded = bpe.decode(np.frombuffer(data.tobytes(), "<u4").astype(np.int32), np.diff(offsets) // 4)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(decoded, pa.binary())], names=schema.names)

    return kept.mapInArrow(run, schema)
