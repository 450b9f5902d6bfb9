"""Runs against a scan of every period."""

from __future__ import annotations

import hashlib
import random
import zlib
from fractions import Fraction

import pytest

from sievework.llm import periodic, queries


def every_run(words, min_length, min_exponent):
    """All maximal stretches for each period in ascending order; the first period of a stretch is its smallest."""
    found = {}
    for p in range(1, len(words) // min_exponent + 1):
        i = 0
        while i + p < len(words):
            start = i
            while i + p < len(words) and words[i] == words[i + p]:
                i += 1
            if i - start + p >= max(min_length, min_exponent * p):
                found.setdefault((start, i - start + p), p)
            i += i == start
    return sorted(((s, m, p) for (s, m), p in found.items()), key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("bounds", [(1, 2), (5, 2), (6, 3), (24, 3), (8, 4)])
def test_runs_equal_brute_force(bounds):
    pick = random.Random(bounds[0])
    for _ in range(400):
        texts = []
        for _ in range(pick.randint(1, 4)):
            words = [str(pick.randrange(pick.choice([1, 2, 3, 6]))).encode() for _ in range(pick.randint(0, 60))]
            for _ in range(pick.randint(0, 3)):
                if words:
                    a = pick.randrange(len(words))
                    b = min(len(words), a + pick.randint(1, 12))
                    words = words[:b] + words[a:b] * pick.randint(1, 6) + words[b:]
            texts.append(words + words if pick.random() < 0.3 else words)
        assert periodic.runs_of_texts(texts, *bounds) == [every_run(t, *bounds) for t in texts]
    with pytest.raises(ValueError):
        periodic.find_runs(periodic.np.zeros(3, int), 1, 1)


def contract(doc_id, text):
    words = [w for w in (text or "").translate({i: 32 for i in range(9, 14)}).split(" ") if w]
    n = len(words)
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = every_run(words, 24, 3)
    dropped = {i for s, m, p in runs for i in range(s + p, s + m)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None,) * 3)
    digests = [hashlib.sha256(t.encode()).hexdigest() for t in ("".join(f"{s},{m},{p}\n" for s, m, p in runs), " ".join(w for i, w in enumerate(words) if i not in dropped))]
    return (len(runs), *best, None if best[0] is None else 1000 * best[1] // best[2], *digests)


COLUMNS = ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def test_query_equals_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in queries.op13_periodic_runs(spark, sf_dir).collect()}
    want = {d.doc_id: contract(d.doc_id, d.text) for d in docs}
    assert got == want and sum(v[0] > 0 for v in want.values()) > 10


def test_hostile_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(periodic, "BATCH_WORDS", 40)
    rows = [(1, None, "x"), (None, "a b " * 30, "x"), (2, " \t\n ", "x"), (3, "", "x"), (4, "la " * 100, "x"), (4, "la " * 100, "x"), (5, "x y z " * 9, "x"), (6, ("p q r s " * 8 + "t ") * 3, "x"), *((k, "ab c d e f g h " * 5, "y") for k in range(10, 60))]
    spark.createDataFrame(rows, "doc_id bigint, text string, runs string").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted((tuple(r[c] for c in ["doc_id", *COLUMNS]) for r in queries.op13_periodic_runs(spark, str(tmp_path)).collect()), key=str)
    assert got == sorted(((i, *contract(i, t)) for i, t, _ in rows), key=str)


def test_collapsed_text(spark):
    docs = spark.createDataFrame([("k", "so it goes " * 9 + "on and on")], "id string, body string")
    (row,) = periodic.detect(docs, "id", "body").collect()
    assert row.collapsed == "so it goes on and on" and [tuple(r) for r in row.runs] == [(0, 27, 3)] and row.n_words == 30
    assert periodic.detect(docs.limit(0), "id", "body").collect() == []
