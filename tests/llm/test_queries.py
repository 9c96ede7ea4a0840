from __future__ import annotations

import numpy as np
import pytest
from brute import kept_after_bytes, near_components, spans
from compare import compare

import corpus_pipeline
from gravitas.llm import bpe, queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(spark, sf, duck, name):
    assert compare(queries.QUERIES[name](spark, sf), duck, queries.ORACLES[name]) == ""


@pytest.fixture(scope="module")
def texts(duck):
    return dict(duck.execute("select doc_id, text from documents").fetchall())


def test_run_index_query(spark, sf, texts):
    want = kept_after_bytes(texts, 100)
    for r in queries.QUERIES["op6_run_index"](spark, sf).collect():
        marks = want[r["doc_id"]]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"]) == (len(marks), sum(marks), len(spans(marks)))


def test_near_duplicate_query(spark, sf, texts):
    want = near_components(texts, 3, 85)
    assert {r["doc_id"]: r["component_id"] for r in queries.QUERIES["op7_near_duplicates"](spark, sf).collect()} == want


def test_quality_held_out(spark, duck):
    """Ranking of held-out documents by label."""
    label = dict(duck.execute("select doc_id, quality from '/root/testdata/sf0.01/labels.parquet'").fetchall())
    rows = [(r["score"], label[r["doc_id"]]) for r in queries.QUERIES["op3_quality_model"](spark, "/root/testdata/sf0.01").collect() if r["held_out"] and r["doc_id"] in label]
    good, bad = (np.array([s for s, y in rows if y == k]) for k in (1, 0))
    assert (good[:, None] > bad[None, :]).mean() > 0.9


def test_language_held_out(spark, duck):
    lang = dict(duck.execute("select doc_id, lang from '/root/testdata/sf0.01/documents.parquet'").fetchall())
    rows = [r["lang_pred"] == lang[r["doc_id"]] for r in queries.QUERIES["op4_language"](spark, "/root/testdata/sf0.01").collect() if r["held_out"]]
    assert np.mean(rows) > 0.98


def test_pipeline(spark, sf, duck, tmp_path):
    """Every stage against brute force on its own input; all but the last return the columns of documents."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    items = [r[0] for r in duck.execute("select text from benchmark").fetchall()]
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r for r in docs.collect()}
        stage(spark, docs, sf).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        after = {r["doc_id"]: r for r in docs.collect()}
        assert len(after) == docs.count()
        if name != "bpe_encoding":
            assert docs.columns == corpus_pipeline.COLUMNS
        if name == "quality_classifier":
            label = dict(duck.execute("select doc_id, quality from labels").fetchall())
            good = [i for i in before if label.get(i) == 1]
            assert sum(i in after for i in good) > 0.9 * len(good) and len(after) < len(before)
            assert all(after[i] == before[i] for i in after)
        if name == "minhash_near_dedup":
            group = near_components({i: r["text"] for i, r in before.items()}, 5, 80)
            assert set(after) == {i for i in before if group[i] == i}
        if name == "suffix_array_dedup":
            marks = kept_after_bytes({i: r["text"] for i, r in before.items()}, 100)
            assert set(after) == set(before)
            for i, r in after.items():
                kept = bytes(b for b, m in zip(before[i]["text"].encode(), marks[i]) if not m).decode("utf-8", "ignore")
                assert (r["text"], r["n_chars"]) == (kept, len(kept))
        if name == "benchmark_decontamination":
            from test_text_operators import lower

            windows = {tuple(w[s : s + 10]) for w in map(lower, items) for s in range(max(1, len(w) - 9)) if w}
            dirty = {i for i, r in before.items() for w in [lower(r["text"])] for s in range(len(w) - 9) if tuple(w[s : s + 10]) in windows}
            assert set(after) == set(before) - dirty
        if name == "bpe_encoding":
            mine = bpe.WordBpe(bpe.load(bpe.public_tokenizers.path("word_bpe_49k.json")))
            assert all(r["n_tokens"] == len(mine.encode(before[i]["text"])) for i, r in after.items())


def test_pipeline_on_awkward_documents(spark, docs, tmp_path, monkeypatch):
    """Nulls, repeated ids, long texts and clashing columns pass through all stages."""
    for table, kind in (("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], kind).write.parquet(str(tmp_path / f"{table}.parquet"))
    at = docs
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, at, str(tmp_path)).write.parquet(str(tmp_path / name))
        at = spark.read.parquet(str(tmp_path / name))
    assert at.count() > 40 and at.where("doc_id = 50").count() == 2
    empty = spark.createDataFrame([], docs.select(*corpus_pipeline.COLUMNS).schema)
    for name, stage in corpus_pipeline.STAGES:
        empty_out = stage(spark, empty, str(tmp_path))
        assert empty_out.count() == 0


def test_pipeline_keeps_documents_without_own_id(spark, tmp_path):
    """Different texts without an id, or under one id, all stay, are cut and judged one by one; equal rows are one."""
    word = lambda k, n: " ".join(f"{k}{i}" for i in range(n))
    shared, bad = word("shared", 40), word("bench", 12)
    texts = {None: [word("a", 60), word("b", 60), word("b", 60), f"{shared} {word('c', 30)}", f"{word('d', 30)} {shared}", f"{word('e', 30)} {bad}"], 7: [f"{word('g', 20)} {shared}"], 8: [word("h", 60)], 9: [word("k", 60), word("m", 60), word("m", 60), f"{word('o', 30)} {bad}"]}
    rows = [(i, t, "en", "s", len(t)) for i, ts in texts.items() for t in ts]
    spark.createDataFrame([(1, bad)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    at = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = {}
    for name, stage in corpus_pipeline.STAGES[1:]:
        stage(spark, at, str(tmp_path)).write.parquet(str(tmp_path / name))
        at = spark.read.parquet(str(tmp_path / name))
        got[name] = at.collect()
    pairs = lambda name: sorted((r["doc_id"] or 0, r["text"]) for r in got[name])
    every = sorted({(i or 0, t) for i, ts in texts.items() for t in ts})
    assert pairs("minhash_near_dedup") == every
    cut = [t for _, t in pairs("suffix_array_dedup")]
    assert len(cut) == len(every) and sum(shared in t for t in cut) == 1 and all(r["n_chars"] == len(r["text"]) for r in got["suffix_array_dedup"])
    assert shared not in dict(pairs("suffix_array_dedup"))[7]
    assert pairs("benchmark_decontamination") == [p for p in pairs("suffix_array_dedup") if bad not in p[1]]
    assert len(got["bpe_encoding"]) == len(every) - 2
