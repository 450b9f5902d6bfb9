"""The bounded top-k join against all pairs, and the number of pairs that it compares."""

from __future__ import annotations

import difflib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievework.functions import text as X
from sievework.operators import audit, dedup, retrieval
from sievework.plans import text_queries


def grams(text):
    padded = f"  {text}  "
    return {padded[i : i + 3] for i in range(len(padded) - 2)}


def nearest(queries, texts, k):
    out = {}
    sets = [(grams(t), t, i) for i, t in texts]
    for qid, q in queries:
        g = grams(q)
        ranked = sorted((-2.0 * len(g & s) / (len(g) + len(s)), t, i) for s, t, i in sets if g & s)
        out[qid] = [(i, -d) for d, _, i in ranked[:k]]
    return out


def corpus(n_families, per_family):
    pick = random.Random(4)
    word = lambda: "".join(pick.choice("abcdefghijklmnopqrstuvwxyzäß😀") for _ in range(pick.randint(2, 8)))
    families = [[word() for _ in range(pick.randint(5, 40))] for _ in range(n_families)]
    texts = []
    for f, words in enumerate(families):
        for _ in range(per_family):
            changed = [w if pick.random() < 0.85 else word() for w in words]
            texts.append((f"{f}:{len(texts)}", " ".join(changed)))
    texts += [(f"copy{i}", texts[3][1]) for i in range(7)] + [("empty", ""), ("one", "a")]
    queries = [(f, " ".join(words)) for f, words in enumerate(families[:12])] + [(97, ""), (98, "zz"), (99, texts[5][1])]
    return queries, texts


def test_shortlist_equals_all_pairs(spark):
    queries, texts = corpus(60, 20)
    q, t = spark.createDataFrame(queries, "qid int, text string"), spark.createDataFrame(texts, "tid string, text string")
    want = nearest(queries, texts, 5)
    got: dict = {}
    for r in sorted(audit.dice_shortlist(q, t, 5).collect(), key=lambda r: (r.qid, r["rank"])):
        got.setdefault(r.qid, []).append((r.tid, r.dice))
    assert got == {k: v for k, v in want.items() if v}
    folded = t.groupBy("text").agg(F.min("tid").alias("low"))
    compared = audit.dice_candidates(q.where("qid < 12"), folded, 5).groupBy("qid").count().collect()
    assert max(r["count"] for r in compared) < 150  # of 1,202 texts
    assert audit.dice_shortlist(q.limit(0), t, 5).collect() == [] == audit.dice_shortlist(q, t.limit(0), 5).collect()


def shuffled_rows(spark, run):
    """Rows that all stages of ``run`` wrote to shuffles."""
    before = {x.stageId() for x in _stages(spark)}
    run()
    return sum(x.shuffleWriteRecords() for x in _stages(spark) if x.stageId() not in before)


def _stages(spark):
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    found = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    return [found.apply(i) for i in range(found.size())]


def test_shortlist_shuffles_the_nearest_alone(spark):
    """No pair of a query and a text, and no trigram, is shuffled to be counted; queries in several blocks give the same."""
    queries, texts = corpus(60, 20)
    q, t = spark.createDataFrame(queries, "qid int, text string"), spark.createDataFrame(texts, "tid string, text string").repartition(4).localCheckpoint()
    assert shuffled_rows(spark, lambda: audit.dice_shortlist(q, t, 5).collect()) < len(texts) + 2 * 4 * 5 * len(queries)


def test_shortlist_in_blocks_and_ties(spark, monkeypatch):
    queries, texts = corpus(20, 10)
    texts += [(None, texts[0][1]), ("none", None)] + [(f"again{i}", texts[8][1]) for i in range(40)]
    q, t = spark.createDataFrame(queries, "qid int, text string"), spark.createDataFrame(texts, "tid string, text string")
    rows = lambda: sorted(((r.qid, r["rank"], r.tid, r.text, r.dice) for r in audit.dice_shortlist(q, t, 5).collect()), key=str)
    whole = rows()
    monkeypatch.setattr(audit, "BROADCAST_GRAMS", 300)
    assert rows() == whole
    named = [(i or "", x) for i, x in texts if x is not None]  # a null id comes before all others
    want = {k: [(i or None, d) for i, d in v] for k, v in nearest(queries, named, 5).items() if v}
    got: dict = {}
    for r in sorted(whole, key=lambda r: r[:2]):
        got.setdefault(r[0], []).append((r[2], r[4]))
    assert got == want


def test_trigram_codes(spark):
    texts = ["", "a", "ab", "aaaa", "héé 😀😀 x", "  "]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", X.trigram_codes(F.col("t")).alias("c")).collect()
    for r in rows:
        code = {ord(g[0]) << 42 | ord(g[1]) << 21 | ord(g[2]) for g in grams(r.t)}
        assert set(r.c) == code and len(r.c) == len(code)


def test_nearest_ratio_equals_difflib_over_all_pairs(spark, sf_dir):
    q, t = text_queries._prompts(spark, sf_dir)
    queries, texts = [(r.qid, r.text) for r in q.collect()], [(r.tid, r.text) for r in t.collect()]
    by_id = dict(texts)
    short = nearest(queries, texts, audit.SHORTLIST)
    got = {r.qid: r for r in text_queries.q_nearest_prompt_ratio(spark, sf_dir).collect()}
    for qid, text in queries:
        ratios = [(difflib.SequenceMatcher(None, text, by_id[i], autojunk=False).ratio(), -n, i) for n, (i, _) in enumerate(short[qid])]
        best = max(ratios)
        assert (got[qid].tid, got[qid].ratio, got[qid].too_close) == (best[2], round(best[0], 9), best[0] >= audit.CEILING)
    assert len(got) == sum(bool(v) for v in short.values())
    pairs = spark.createDataFrame([("abcd", "bcde"), (None, "x"), ("", "")], "a string, b string")
    assert [r[0] for r in pairs.select(dedup.ratio(F.col("a"), F.col("b"), False)).collect()] == [0.75, None, 1.0]


def passages(seed, n, repeated=0):
    pick = random.Random(seed)
    vocabulary = [f"w{int(200 * pick.random() ** 3)}" for _ in range(400)]
    chunks = [(i, " ".join(pick.choice(vocabulary) for _ in range(pick.randint(0, 30)))) for i in range(n)]
    chunks += [(pick.randrange(n), pick.choice(chunks)[1]) for _ in range(repeated)] + [(None, chunks[1][1])] * 2
    queries = [(f"q{i}", " ".join(pick.choice(vocabulary) for _ in range(pick.randint(0, 12)))) for i in range(25)]
    return queries, chunks


def ranked(queries, chunks, aims, limit, min_score):
    """What the SQL of the lookup says: terms of a repeated id count as often as they come."""
    sets = [(i, set(t.split())) for i, t in chunks]
    df = Counter(w for _, s in sets for w in s)
    out = {}
    for qid, text in queries:
        w = {t: (math.log((len(sets) + 1) / (df[t] + 1)) + 1) * (1.75 if t in aims else 1.0) for t in set(text.split())}
        parts, aimed = Counter(), set()
        for i, s in sets:
            for t in s & set(w):
                parts[i] += w[t]
                aimed |= {i} if t in aims else set()
        scores = {i: round(p / sum(w.values()), 6) for i, p in parts.items() if i in aimed}
        first = sorted((-s, i is not None, i) for i, s in scores.items() if s >= min_score)[:limit]
        out |= {(qid, k): (i, -s) for k, (s, _, i) in enumerate(first, 1)}
    return out


@pytest.mark.parametrize("repeated,terms", [(0, 500_000), (40, 500_000), (40, 20)])
def test_lookup_like_its_sql(spark, monkeypatch, repeated, terms):
    monkeypatch.setattr(retrieval, "BROADCAST_TERMS", terms)
    queries, chunks = passages(repeated, 300, repeated)
    q, c = spark.createDataFrame(queries, "query_id string, text string"), spark.createDataFrame(chunks, "chunk_id int, text string").repartition(3)
    got = {(r.query_id, r["rank"]): (r.chunk_id, r.score) for r in retrieval.lookup(q, c, ("w0", "w1", "w5"), 3, 0.1, stop=(), aliases={}).collect()}
    want = ranked(queries, chunks, {"w0", "w1", "w5"}, 3, 0.1)
    assert got == want and len(got) > 30


def test_lookup_shuffles_the_best_alone(spark):
    """No pair of a query and a chunk is shuffled to be summed."""
    queries, chunks = passages(1, 3000)
    q, c = spark.createDataFrame(queries, "query_id string, text string"), spark.createDataFrame(chunks[:-2], "chunk_id int, text string").repartition(4).localCheckpoint()
    run = lambda: retrieval.lookup(q, c, ("w0", "w1", "w5"), 3, 0.1, stop=(), aliases={}).collect()
    assert shuffled_rows(spark, run) < 3 * len(chunks)


def test_rounded_like_spark(spark):
    values = [0.0, 0.1234565, 0.1234575, 1.0000005, 0.4999995, 0.49999949999, 2 / 3, 1 / 3, 0.3000004999999999]
    values += [(2 * i + 1) / 2e6 for i in range(0, 400_000, 977)]
    want = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v double").select(F.round("v", 6)).collect()]
    assert retrieval.rounded(np.array(values)).tolist() == want


def contaminated(seed, n):
    pick = random.Random(seed)
    word = lambda: f"v{int(300 * pick.random() ** 2)}"
    items = [(i, ". ".join(" ".join(word() for _ in range(pick.randint(1, 12))) for _ in range(3))) for i in range(20)]
    docs = [(i, " ".join(word() for _ in range(pick.randint(0, 40)))) for i in range(n)]
    docs += [(n + k, f"x {pick.choice(docs)[1]}, {t.upper()}! y") for k, (_, t) in enumerate(items)] + [(None, items[0][1]), (n + 99, None), (n + 98, "")]
    return items, docs


def plain(text):
    return " ".join(re.findall(r"[^\W_]+", (text or "").lower()))


@pytest.mark.parametrize("most", [500_000, 7])
def test_phrases_like_all_pairs(spark, monkeypatch, most):
    """Facts of one word or more and eight-word sequences, in one block or several; only matches are shuffled."""
    monkeypatch.setattr(audit, "BROADCAST_GRAMS", most)
    items, docs = contaminated(3, 400)
    facts = [(i, part) for i, t in items for part in t.split(".")] + [(50, "v1"), (51, "v0 v1"), (52, " !"), (53, None)]
    f = spark.createDataFrame(facts, "fact_id int, fact string").localCheckpoint()
    b = spark.createDataFrame(items, "item_id int, text string").localCheckpoint()
    d = spark.createDataFrame(docs, "doc_id int, text string").repartition(4).localCheckpoint()
    want = {(i, k) for i, t in docs for k, p in facts if plain(p) and f" {plain(p)} " in f" {plain(t)} "}
    assert {tuple(r) for r in audit.facts_in_texts(f, d).collect()} == want and len(want) > 60

    def grams(text):
        w = plain(text).split()
        return {tuple(w[i : i + 8]) for i in range(len(w) - 7)}

    shared = {(i, k): len(grams(t) & grams(p)) for i, t in docs for k, p in items}
    got = []
    rows = shuffled_rows(spark, lambda: got.extend(audit.ngram_matches(d, b).collect()))
    assert {(r.doc_id, r.item_id): r.n_shared for r in got} == {k: n for k, n in shared.items() if n} and len(got) > 15
    assert most == 7 or rows < 3 * len(docs)


def test_documents_stay_where_they_are_read(spark):
    """Neither texts nor their sentences are shuffled to find those that an item has."""
    items, docs = contaminated(5, 3000)
    f = spark.createDataFrame(items, "fact_id int, fact string").localCheckpoint()
    b = f.toDF("item_id", "text")
    d = spark.createDataFrame(docs, "doc_id int, text string").repartition(4).localCheckpoint()
    assert shuffled_rows(spark, lambda: audit.facts_in_texts(f, d).collect()) < len(docs) // 2
    assert shuffled_rows(spark, lambda: audit.sentence_matches(d, b).collect()) < len(docs) // 2
