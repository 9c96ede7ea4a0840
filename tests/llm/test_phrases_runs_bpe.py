"""Byte-level BPE by recursive SQL, periodic runs and phrase collocations."""

from __future__ import annotations

import base64
import hashlib
import random
import re
import struct
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken

from gravitas.llm import periodic, phrases, queries, sqlbpe

SPEC = sqlbpe.vocabulary_file(None)


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, SPEC.splitlines())}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def awkward_texts():
    rng = random.Random(3)
    letters = "aabbcdehinorst  \n\t.,'0123ßéñ中文\U0001F600\x00\x1c\x85 ́İ"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(0, 200))) for _ in range(150)]
    return texts + [" ", "   ", "a  b", "a   b  ", "x\n \n  y", "it's  we'll 'tis", " lead", "trail ", "a" * 5000, "ab" * 3000, "".join(rng.choice("abcdefgh") for _ in range(4000)), "\r\n\r\n x"]


def test_recursive_bpe_as_the_library(library):
    bpe = sqlbpe.SqlBpe(SPEC, public_tokenizers.PATTERN)
    texts = [*awkward_texts(), None, ""]
    for _ in range(2):  # the second time from what is kept
        ids, sizes = bpe.encode(texts)
        each = np.split(ids, np.cumsum(sizes)[:-1])
        for text, got in zip(texts, each):
            assert got.tolist() == library.encode_ordinary(text or ""), text
        assert bpe.decode(ids, sizes) == [(t or "").encode() for t in texts]


def test_unknown_ids_are_an_error():
    bpe = sqlbpe.SqlBpe(SPEC, public_tokenizers.PATTERN)
    with pytest.raises(Exception, match="no token"):
        bpe.decode(np.array([1, 50256]), np.array([2]))


def test_bpe_on_awkward_documents(docs, rows, empty, library):
    got = sorted((r["doc_id"] is not None, r["doc_id"], bytes(r["ids"]), bytes(r["decoded"])) for r in sqlbpe.encode_documents(docs.select("doc_id", "text", "ids")).collect())
    want = []
    for i, t in rows:
        ids = library.encode_ordinary(t or "")
        want.append((i is not None, i, struct.pack(f"<{len(ids)}I", *ids), (t or "").encode()))
    assert got == sorted(want)
    again = sqlbpe.decode_documents(sqlbpe.encode_documents(docs.select("doc_id", "text")).drop("decoded"))
    assert sorted(bytes(r["decoded"]) for r in again.collect()) == sorted((t or "").encode() for _, t in rows)
    assert sqlbpe.encode_documents(empty).count() == 0


def test_bpe_query(spark, sf, duck, library):
    text = dict(duck.execute("select doc_id, text from documents").fetchall())
    for r in queries.QUERIES["op11_sql_bpe"](spark, sf).collect():
        ids = library.encode_ordinary(text[r["doc_id"]] or "")
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256((text[r["doc_id"]] or "").encode()).hexdigest()


def words(text) -> list[str]:
    return [w.decode() for w in (text or "").encode().split()]


def brute_runs(w: list[str], least: int = 12) -> list[tuple[int, int, int]]:
    """Per period the maximal stretches in which words that far apart agree; a smaller period of a stretch wins."""
    by_end: dict[tuple[int, int], int] = {}
    for p in range(1, len(w) // 2 + 1):
        i = 0
        while i + p < len(w):
            s = i
            while i + p < len(w) and w[i] == w[i + p]:
                i += 1
            if i - s + p >= max(least, 2 * p):
                by_end.setdefault((s, i - s + p), p)
            i += 1
    return sorted((s, n, p) for (s, n), p in by_end.items())


def collapsed(w: list[str], runs) -> str:
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def test_runs_against_brute_force():
    rng = random.Random(1)
    for _ in range(300):
        least, texts = rng.choice([2, 3, 5, 12]), []
        for _ in range(rng.randrange(1, 6)):
            n, k = rng.randrange(0, 60), rng.choice([1, 2, 3, 8])
            w = [rng.choice("abcdefgh"[:k]) for _ in range(n)]
            if n > 5 and rng.random() < 0.6:
                p, a = rng.randrange(1, n // 3 + 1), rng.randrange(n)
                w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
            texts.append(w)
        raw = [" ".join(w).encode() for w in texts]
        offsets = np.concatenate(([0], np.cumsum([len(r) for r in raw])))
        row, runs, _ = periodic.runs_of_texts(np.frombuffer(b"".join(raw), np.uint8), offsets, least)
        for i, w in enumerate(texts):
            assert [tuple(r) for r in runs[row == i].tolist()] == brute_runs(w, least), w


def test_runs_on_awkward_documents(docs, rows, empty):
    short = [(i, t) for i, t in rows if len(t or "") < 10_000]
    got = sorted((str(r["doc_id"]), r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in periodic.periodic_runs(docs).collect() if r["n_words"] < 5_000 and len(r["collapsed"]) < 10_000)
    want = sorted((str(i), len(words(t)), brute_runs(words(t)), collapsed(words(t), brute_runs(words(t)))) for i, t in short)
    assert got == want
    assert any(r for _, _, r, _ in want)
    assert periodic.periodic_runs(empty).count() == 0


def test_runs_query(spark, sf, duck):
    text = dict(duck.execute("select doc_id, text from documents").fetchall())
    seen = 0
    for r in queries.QUERIES["op12_periodic_runs"](spark, sf).collect():
        w, h = words(text[r["doc_id"]]), zlib.crc32(str(r["doc_id"]).encode())
        g, n = h // 10, len(w)
        if n > 3_000:
            continue  # the brute force is quadratic
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        runs = brute_runs(w)
        best = max(runs, key=lambda x: (x[1], -x[0], -x[2]), default=None)
        want = (len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None)
        assert (r["n_runs"], r["start"], r["length"], r["period"], r["exponent_milli"]) == want
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{s},{n},{p}\n" for s, n, p in runs).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(collapsed(w, runs).encode()).hexdigest()
        seen += bool(runs)
    assert seen > 5


def brute_phrases(rows, least: int, top: int) -> list[tuple]:
    """``rows`` of (lang, text)."""
    count, total = {}, Counter()
    for lang, text in rows:
        f = count.setdefault(lang or "und", Counter())
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", lower):
            w = [x for x in re.split(r"[ \t]", piece) if x]
            total[lang or "und"] += len(w)
            for m in (1, 2, 3, 4):
                f.update(tuple(w[i : i + m]) for i in range(len(w) - m + 1))
    out = []
    for lang, f in count.items():
        common = {g: n for g, n in f.items() if len(g) > 1 and n >= least}
        gone = {g[i : i + m] for g, n in common.items() for m in range(2, len(g)) for i in range(len(g) - m + 1) if 100 * n >= 80 * f[g[i : i + m]]}
        kept = []
        for g, a in common.items():
            if g not in gone:
                score, _, left, right = min((2_000_000 * a // (f[g[:k]] + f[g[k:]]), k, f[g[:k]], f[g[k:]]) for k in range(1, len(g)))
                kept.append((-score, -a, " ".join(g).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, total[lang], -score))
    return sorted(out)


COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


@pytest.mark.parametrize(("least", "top", "bits"), [(3, 40, 27), (2, 10_000, 8)])
def test_phrases_on_awkward_documents(docs, empty, least, top, bits):
    """A sieve of 256 bits is nearly full and lets almost everything through; results stay the same."""
    got = phrases.mine_phrases(docs, least=least, top=top, bits=bits).collect()
    plain = [(r["lang"], r["text"]) for r in docs.select("lang", "text").collect()]
    assert sorted(tuple(r[c] for c in COLUMNS) for r in got) == brute_phrases(plain, least, top)
    assert phrases.mine_phrases(empty).count() == 0


def test_colliding_fingerprints_part():
    part = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array(["a b a b c a b", "a b x"]), pa.array(["en", None])], names=["doc_id", "text", "lang"])
    block = phrases.Block(part)
    block.numbers = phrases.tx.binary_array(block.data, block.at).dictionary_encode().indices.to_numpy()
    block.fingerprints = lambda places, size: np.zeros(len(places), np.uint64)
    first, n = phrases.distinct_phrases(block, block.places(2), 2)
    count = Counter()
    for f, k in zip(first.tolist(), n.tolist()):
        count[block.langs[block.lang[f]], bytes(block.data[block.at[f] : block.at[f + 2] - 1])] += k
    assert count == {("en", b"a b"): 3, ("en", b"b a"): 1, ("en", b"b c"): 1, ("en", b"c a"): 1, ("und", b"a b"): 1, ("und", b"b x"): 1}
