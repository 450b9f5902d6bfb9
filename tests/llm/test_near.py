"""Near-duplicate stage against brute-force Jaccard similarity of five-word shingles."""

from __future__ import annotations

import random

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sievework.llm import near, simhash
from sievework.llm._common import BATCH_BYTES, connected_components


def brute_set(text):
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    return frozenset(tuple(parts[i : i + 5]) for i in range(max(1, len(parts) - 4))) if parts else frozenset()


def brute_kept(rows):
    """Smallest id of each component of ``rows`` (id, text) under Jaccard >= 0.8, by all pairs."""
    rows = sorted(rows)
    sets, root = [brute_set(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    linked = 0
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a == b or 10 * len(a & b) >= 8 * len(a | b):
                linked += a != b
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return [rows[i][0] for i in range(len(rows)) if find(i) == i], linked


@pytest.mark.parametrize("scale", ["sf0.001", "sf0.01"])
def test_stage_joins_what_brute_force_joins(spark, scale):
    docs = spark.read.parquet(f"/root/testdata/{scale}/documents.parquet")
    want, linked = brute_kept([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    got = corpus_pipeline.drop_near_duplicates(spark, docs, f"/root/testdata/{scale}")
    assert linked and sorted(r.doc_id for r in got.select("doc_id").collect()) == want


@pytest.mark.parametrize("rounds", [0, 1, 3])
def test_large_buckets_are_exact(spark, monkeypatch, rounds):
    """Edits of one text near the bound, in full buckets: some pairs reach 0.8, some don't."""
    monkeypatch.setattr(near, "ROUNDS", rounds)
    monkeypatch.setattr(near, "PAIRS", 500)
    monkeypatch.setattr(near, "BLOCK", 16)
    rng = random.Random(rounds)
    base, rows = [f"w{i}" for i in range(60)], []
    for i in range(160):
        words = list(base)
        for at in rng.sample(range(60), rng.choice((0, 1, 2, 3, 4, 8))):
            words[at] = f"x{rng.randrange(4)}"
        rows.append((i, " ".join(words)))
    rows += [(i, " ".join(base[: rng.randrange(1, 60)])) for i in range(160, 200)]
    want, linked = brute_kept(rows)
    got = near.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert linked > 300 and len(want) > 10 and sorted(r.doc_id for r in got.collect()) == want


def test_parities_never_exceed_the_difference():
    rng = random.Random(4)
    for size in (3, 40, 400, 4000):
        a = {rng.getrandbits(64) for _ in range(size)}
        for share in (0.0, 0.1, 0.5, 1.0):
            b = {x for x in a if rng.random() > share} | {rng.getrandbits(64) for _ in range(int(share * size))}
            bits = [near.parities(np.array(sorted(x), dtype=np.uint64)) for x in (a, b)]
            assert sum(int(x).bit_count() for x in (bits[0] ^ bits[1]).view(np.uint64)) <= len(a ^ b)


def test_rows_without_ids_words_or_own_ids(spark):
    rows = [(5, "a b c d"), (3, "A  b\tc D"), (3, "a b c d"), (9, None), (8, ""), (7, " \n"), (None, "a b c d"), (None, "alone here now"), (None, "alone here  now"), (2, "one text of this id"), (2, "another text of this id"), (2, "another text of this id")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, " ".join(r.text.lower().split())) for r in near.keep_one(df).collect()), key=str)
    assert got == sorted([(3, "a b c d"), (7, ""), (None, "alone here now"), (2, "one text of this id"), (2, "another text of this id")], key=str)
    assert near.keep_one(df.limit(0)).count() == 0


def test_repeats_that_differ_elsewhere(spark):
    rows = [(1, "one two three four five six", c) for c in "dbeac"] + [(2, "other words than those of the first text", "z")] * 3 + [(None, "no id here at all but some words", c) for c in "yx"]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, extra string")
    kept = [sorted(tuple(r) for r in near.keep_one(df.repartition(n)).collect() if r.doc_id is not None) for n in (1, 3, 7)]
    assert kept[0] == kept[1] == kept[2] and [r[0] for r in kept[0]] == [1, 2]
    alone = [near.keep_one(df.where("doc_id IS NULL").repartition(n)).collect() for n in (1, 2)]
    assert alone[0] == alone[1] and len(alone[0]) == 1


def test_fingerprints_link_first(spark):
    """Operator 3's links, compared in full, are those of brute force; the exact join gets what is left."""
    rng = random.Random(11)
    base, texts = [f"w{i}" for i in range(300)], []
    for _ in range(60):
        words = list(base)
        for at in rng.sample(range(300), rng.choice((1, 2, 6, 30))):
            words[at] = f"x{rng.randrange(9)}"
        texts.append(" ".join(words))
    texts = list(dict.fromkeys([*texts, texts[0].upper(), texts[0].replace(" ", "\n"), "a b c", "no words in common"]))
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] * 2, "node long, text string")
    sets, fps = [brute_set(t) for t in texts], [simhash.simhash(t, 5) for t in texts]
    near_bits = lambda i, j: (fps[i] ^ fps[j]).bit_count() <= simhash.MAX_BITS
    least = [fps.index(f) for f in fps]
    pairs = {(min(least[i], i), i) for i in range(len(texts)) if least[i] != i} | {(i, j) for j in set(least) for i in set(least) if i < j and near_bits(i, j)}
    want = {(i, j) for i, j in pairs if 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j])}
    got = near.fingerprint_links(rows).collect()
    assert len(want) > 5 and len(got) == len(set(got)) and {(r.a, r.b) for r in got} == want


def test_texts_go_to_python_in_small_batches(spark, monkeypatch):
    """The stage bounds its Arrow batches by bytes, and the session's own bound is as before."""
    key, seen = "spark.sql.execution.arrow.maxBytesPerBatch", []
    before = spark.conf.get(key)
    df = spark.range(0, 6000, 1, 1).select("id", F.repeat(F.lit("x"), 1000).alias("text"))
    real = near.links

    def links(rows, *more):
        batches = df.mapInArrow(lambda it: (pa.RecordBatch.from_pydict({"size": [b.nbytes]}) for b in it), "size long").collect()
        seen.extend(r.size for r in batches)
        return real(rows, *more)

    monkeypatch.setattr(near, "links", links)
    rows = [(2, "one two three"), (1, "One two three"), (3, "other words")]
    assert sorted(r.doc_id for r in near.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()) == [1, 3]
    assert len(seen) > 1 and max(seen) < 1.1 * BATCH_BYTES and spark.conf.get(key) == before


def test_pairs_meet_about_once(spark):
    """Texts that share a long run of early shingles, but too little to be linked, make a row a pair rather than one a shingle."""
    texts = [" ".join([f"s{j}" for j in range(40)] + [f"t{i}-{j}" for j in range(20)]) for i in range(30)]
    sets = [near.shingle_set(t, 5, near._Hashes()) for t in texts]
    first = sorted(set(sets[0].tolist()) & set(sets[1].tolist()))[:20]
    rows = [(t, i, len(s), at, i) for i, s in enumerate(sets) for at, t in enumerate(np.array(first, dtype=np.uint64).view(np.int64).tolist())]
    placed = near._after(spark.createDataFrame(rows, "token long, node long, n long, at long, root long"))
    met = near._meetings(placed, 0.8).collect()
    assert len(met) == len({(r.a, r.b) for r in met}) == 30 * 29 // 2


def test_few_edges_take_few_tasks(spark):
    """Components of a few edges aren't dealt to all shuffle partitions in every round."""
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "a long, b long")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        spark.sparkContext.setJobGroup("few-edges", "components of a few edges")
        roots = {r.node: r.root for r in connected_components(edges).collect()}
        tracker = spark.sparkContext.statusTracker()
        jobs = [tracker.getJobInfo(j) for j in tracker.getJobIdsForGroup("few-edges")]
        tasks = sum(s.numCompletedTasks for k in {k for j in jobs for k in j.stageIds} if (s := tracker.getStageInfo(k)))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert roots == {**{i: 0 for i in range(61)}, 100: 100, 101: 100} and tasks < 200
