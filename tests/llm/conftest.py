from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

WORDS = "the of and in to that river stone cloud window paper ñandú straße 中文 lamp coin x y z".split()


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "", str(rng.randrange(50))]) for _ in range(n))


def awkward_rows() -> list[tuple]:
    """Nulls, empty and very long texts, ties, repeated rows and ids, texts that repeat themselves and each other."""
    rng = random.Random(11)
    base = prose(rng, 120)
    shared = prose(rng, 45)
    rows = [
        (1, None), (2, ""), (3, " \t\n\r "), (4, "one"), (5, "Two WORDS"), (6, "two words"),
        (10, base), (11, base), (12, base.upper()), (13, base + " tail"), (14, base + " another tail of it"), (15, base), (15, base),
        (20, prose(rng, 30) + " " + shared + " " + prose(rng, 30)), (21, shared + " " + prose(rng, 10)), (22, prose(rng, 5) + "\n" + shared),
        (30, "ab " * 200), (31, "a" * 400), (32, "ab " * 90), (33, "line of text here\n" * 30),
        (40, prose(rng, 40_000)), (41, "x" * 150_000), (50, prose(rng, 60)), (50, "another text of the same id"), (51, prose(rng, 60)), (51, None),
        (None, prose(rng, 70)), (None, None), (60, "\x00 \x1c \x85 a\u0085b \U0001F600 é İ " * 12),
    ]
    rows += [(100 + i, " ".join(base.split()[: 118 - i] + [f"w{i}"] + base.split()[119 - i :])) for i in range(12)]
    rows += [(200 + i, prose(rng, rng.randrange(1, 150))) for i in range(40)]
    return rows


#: Columns that operators use themselves.
CLASHING = "string key, long node, string component, int start, string spans, string seg, double score, string ids, int n, string words, long label, string packed, string f, int at, string window"


def frame(spark, rows):
    """Rows of (doc_id, text) as a table of documents with extra columns."""
    extra = {name: F.lit(None).cast(kind) for kind, name in (c.strip().split(" ") for c in CLASHING.split(","))}
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = {"lang": F.when(F.col("doc_id") % 3 != 0, "en"), "source": F.when(F.col("doc_id") % 5 != 0, "s1"), "n_chars": F.length("text").cast("long")}
    return df.withColumns(kept | extra)


@pytest.fixture(scope="session")
def rows():
    return awkward_rows()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return frame(spark, rows).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return frame(spark, [])
