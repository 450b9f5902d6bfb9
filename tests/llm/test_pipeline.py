"""The pipeline against a brute-force version of each stage."""

from __future__ import annotations

from collections import Counter

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from sievework.llm import language, mixing, sharding
from tests.llm.test_near import brute_kept
from tests.llm.test_text import brute_contamination


def test_stages_like_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    rows = sorted(docs.collect())
    classifier = language.Classifier(language.fit(docs))
    rows = [r for r in rows if (p := classifier.predict(r.text))[0] != "und" and p[2] >= language.MIN_MARGIN]
    kept = set(brute_kept([(r.doc_id, r.text) for r in rows])[0])
    assert len(kept) < len(rows)
    rows = [r for r in rows if r.doc_id in kept]
    dirty = {i for i, _, n, _ in brute_contamination([(r.doc_id, r.text) for r in rows], items) if n}
    rows = [r for r in rows if r.doc_id not in dirty]
    assert dirty and len(rows) < docs.count()
    counts = mixing.mixing_counts(spark.createDataFrame(rows, docs.schema)).collect()
    want = Counter({r.doc_id: r.copies for r in counts if r.copies})
    got = corpus_pipeline.run(spark, sf_dir).collect()
    assert Counter(r.doc_id for r in got) == want
    table = {r.slot: r.shard for r in sharding.table_frame(spark, sharding.SHARDS).collect()}
    by_id = {r.doc_id: r for r in rows}
    for r in got:
        assert r.shard == table[r.slot] and (r.text, r.lang, r.source, r.n_chars) == tuple(by_id[r.doc_id])[1:]


#: Names that stages use for their own columns, or might.
CLASHING = "score margin accepted lang_pred language copies size hash tag stratum slot shard fp id key node n spans root count text_key bare".split()


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_keep_the_users_columns(spark, sf_dir, name, stage):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    wide = docs.withColumns({c: F.concat(F.lit(f"{c} of "), F.col("doc_id")) for c in CLASHING})
    extra = wide.unionByName(wide.limit(1)).unionByName(wide.where("doc_id = 1").withColumn("text", F.lit(None).cast("string")))
    usual = Counter((r.doc_id, r.text) for r in stage(spark, extra.select(*docs.columns), sf_dir).collect())
    out = stage(spark, extra, sf_dir)
    replaced = {"slot", "shard"} if name == "sharding" else set()
    assert set(out.columns) == {*docs.columns, *CLASHING}
    rows = out.collect()
    assert Counter((r.doc_id, r.text) for r in rows) == usual
    assert all(r[c] == f"{c} of {r.doc_id}" for r in rows for c in CLASHING if c not in replaced)
    assert stage(spark, extra.where(F.lit(False)), sf_dir).count() == 0
    if name != "sharding":
        assert out.columns == extra.columns


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_take_nulls_and_repeats(spark, sf_dir, name, stage):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    odd = docs.limit(60).unionByName(docs.limit(3)).unionByName(spark.createDataFrame([(None, None, None, None, None), (None, "", None, None, None), (900_001, None, "en", None, 0), (900_002, "?! 12", None, "s", 5), (900_003, "long text " * 200_000, "en", "s", 5)], docs.schema))
    out = stage(spark, odd, sf_dir).collect()
    given = Counter(map(tuple, odd.collect()))
    assert out and all(given[tuple(r)[:5]] for r in out)
