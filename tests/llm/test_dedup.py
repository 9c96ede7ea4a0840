from __future__ import annotations

import random

import pytest
from brute import kept_after_bytes, near_components, repeated_word_marks, shingles, spans
from pyspark.sql import functions as F

from gravitas.llm import neardup, runindex, superkmer


def ranges(df) -> dict:
    return {r["doc_id"]: [(s["start"], s["end"]) for s in r["spans"]] for r in df.collect()}


def unique(rows):
    out = {}
    for i, t in rows:
        known = [x for x in (out.get(i), t) if x is not None]
        out[i] = min(known, key=lambda s: s.encode(), default=None)
    return out


@pytest.mark.parametrize(("frequent", "sieved"), [(1000, 1 << 20), (1, 1 << 20), (2, 0)])
def test_repeated_bytes(docs, rows, frequent, sieved):
    """All ways give what brute force gives: by bucket, with longer keys, and with joins in place of a sieve."""
    want = {i: spans(m) for i, m in kept_after_bytes(unique(rows), 40).items() if any(m)}
    assert ranges(runindex.repeated_bytes(docs, length=40, gram=8, frequent=frequent, sieved=sieved)) == want


@pytest.mark.parametrize(("frequent", "sieved"), [(1000, 1 << 20), (1, 1 << 20), (2, 0)])
def test_repeated_words(docs, rows, frequent, sieved):
    want = {i: spans(m) for i, m in repeated_word_marks(unique(rows), 12).items() if any(m)}
    assert ranges(superkmer.repeated_words(docs, window=12, gram=3, frequent=frequent, sieved=sieved)) == want


def test_production_sizes(docs, rows):
    texts = unique(rows)
    assert ranges(superkmer.repeated_words(docs)) == {i: spans(m) for i, m in repeated_word_marks(texts, 35).items() if any(m)}
    assert ranges(runindex.repeated_bytes(docs)) == {i: spans(m) for i, m in kept_after_bytes(texts, 100).items() if any(m)}


def test_run_index_against_suffixes():
    """Neighbours and agreements streamed from run samples are those of the sorted suffixes."""
    import numpy as np

    rng = random.Random(4)
    for text in (b"abracadabra\xff", b"a" * 50 + b"\xff", bytes(rng.choice(b"ab") for _ in range(300)) + b"\xff", b"xyxyxy\xffxyxy\xffz\xff"):
        index = runindex.RunIndex.build(np.frombuffer(text, np.uint8))
        neighbour, agree = index.matching_statistics()
        order = sorted(range(len(text)), key=lambda i: text[i:])
        assert index.lengths.sum() == len(text)
        for before, at in zip(order, order[1:]):
            same = next((k for k in range(len(text)) if text[before + k : before + k + 1] != text[at + k : at + k + 1]), 0)
            assert (neighbour[at], agree[at]) == (before, same)


def test_near_duplicates(docs, rows):
    texts = unique(rows)
    for words, percent in ((3, 85), (5, 80)):
        want = near_components(texts, words, percent)
        got = {r["doc_id"]: r for r in neardup.near_duplicates(docs, similarity=neardup.Similarity(words, percent)).collect()}
        assert set(got) == set(texts)
        for i, r in got.items():
            assert r["n_shingles"] == len(shingles(texts[i], words))
            assert r["component_id"] == want[i], i
            assert r["kept"] == (want[i] == i)


def test_near_duplicates_in_small_blocks(spark):
    """Chains of texts that are no copies of one another: open keys are compared in blocks and no link is lost."""
    rng = random.Random(8)
    rows, words = [], [f"w{rng.randrange(10**6)}" for _ in range(60)]
    for i in range(60):
        words[rng.randrange(60)] = f"w{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = near_components(dict(rows), 3, 85)
    got = neardup.near_duplicates(df, similarity=neardup.Similarity(3, 85), block_rows=7)
    assert {r["doc_id"]: r["component_id"] for r in got.collect()} == want


def test_signatures_within_distance_share_a_key():
    """Pigeonhole: any two signatures that differ in at most ``distance`` symbols agree on all symbols of some key."""
    rng = random.Random(2)
    for similarity in (neardup.Similarity(5, 80), neardup.Similarity(3, 85)):
        for _ in range(300):
            wrong = set(rng.sample(range(neardup.SYMBOLS), similarity.distance))
            assert any(not wrong & set(mask) for mask in similarity.masks)


def test_empty_tables(empty):
    assert neardup.near_duplicates(empty).count() == 0
    assert runindex.repeated_bytes(empty).count() == 0
    assert superkmer.repeated_words(empty).count() == 0


def test_text_ids(spark):
    """Ids keep their type."""
    text = " ".join(f"w{i}" for i in range(80))
    df = spark.createDataFrame([("b", text), ("a", text + " z"), ("c", "other")], "doc_id string, text string")
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(df).collect()}
    assert got == {"a": "a", "b": "a", "c": "c"}
    assert ranges(runindex.repeated_bytes(df)) == {"b": [(0, len(text))]}
    assert set(ranges(superkmer.repeated_words(df.withColumn("text", F.col("text"))))) == {"a", "b"}


def test_common_passage(spark):
    """One passage in thousands of texts, different on both sides: its keys are dealt out anew and nothing is lost."""
    rng = random.Random(9)
    word = lambda: f"w{rng.randrange(10**6)}"
    passage = " ".join(word() for _ in range(50))
    texts = {i: " ".join([*(word() for _ in range(8)), passage, *(word() for _ in range(8))]) for i in range(5000)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(8)
    assert ranges(superkmer.repeated_words(df)) == {i: spans(m) for i, m in repeated_word_marks(texts, 35).items() if any(m)}
    want = {i: spans(m) for i, m in kept_after_bytes(texts, 100).items() if any(m)}
    assert ranges(runindex.repeated_bytes(df)) == want


def test_two_operators_at_once(spark, docs, rows):
    """Each call deletes its own tables only."""
    from concurrent.futures import ThreadPoolExecutor

    texts = unique(rows)
    with ThreadPoolExecutor(2) as pool:
        by_words, by_bytes = pool.submit(lambda: ranges(superkmer.repeated_words(docs))), pool.submit(lambda: ranges(runindex.repeated_bytes(docs)))
        assert by_words.result() == {i: spans(m) for i, m in repeated_word_marks(texts, 35).items() if any(m)}
        assert by_bytes.result() == {i: spans(m) for i, m in kept_after_bytes(texts, 100).items() if any(m)}
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "false") != "true"


def test_only_texts_with_spans_are_shuffled(spark):
    """At every size: a few spans are not sent to all tasks instead, and rows of one id, null too, get the same spans."""
    from gravitas.llm import anchors
    from gravitas.llm import text as tx

    rows = [(i, f"text {i}") for i in range(300)] + [(7, "again"), (None, "no id"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    pairs = [(7, [(0, 1)]), (11, [(1, 2)]), (None, [(0, 2)])]
    spans_of = spark.createDataFrame(pairs, "doc_id long, spans array<struct<start:int,end:int>>").coalesce(1)
    with tx.scratch():
        out = anchors.with_spans(df, tx.written(spans_of, "spans"))
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan and "Union" in plan
        got = sorted((r["doc_id"] or -1, r["size"], [tuple(s) for s in r["spans"]]) for r in out.collect())
    want = dict(pairs)
    assert got == sorted((i or -1, len(t or ""), want.get(i, [])) for i, t in rows)
