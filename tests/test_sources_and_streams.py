"""Readers, sinks, and the streaming twins of batch operators."""

from __future__ import annotations

import hashlib
import json
import os

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from sievework.operators import bank
from sievework.plans.dialogue_queries import fsm_input
from sievework.sources import readers, sinks
from sievework.streaming import dialogue, sessions


def test_json_and_csv(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"k": 1}\n\n{"k": 2}\n')
    (tmp_path / "b.json").write_text('{\n"k": 3}')
    (tmp_path / "c.jsonl").write_text('{"k": "x"}\n')
    (tmp_path / "d.csv").write_text("text,category\nhi,x\n ,y\nyo,\n")
    assert sorted(r.k for r in readers.json_rows(spark, str(tmp_path / "a.jsonl"), "k int").collect()) == [1, 2]
    assert [r.k for r in readers.json_rows(spark, str(tmp_path / "b.json"), "k int").collect()] == [3]
    with pytest.raises(Exception, match="MALFORMED|FAILFAST|malformed"):
        readers.json_rows(spark, str(tmp_path / "c.jsonl"), "k int").collect()
    assert [tuple(r) for r in readers.labelled_csv(spark, str(tmp_path / "d.csv")).collect()] == [("hi", "x")]


def test_labelled_pairs(spark):
    rows = spark.createDataFrame([("train", [["a", "x"], [" ", "x"], ["b", "y"]])], "k string, v array<array<string>>")
    assert [(r.text, r.position) for r in readers.labelled_pairs(rows, "k", "v", ["x"]).collect()] == [("a", 0)]
    with pytest.raises(Exception, match="pair"):
        readers.labelled_pairs(spark.createDataFrame([("t", [["a"]])], "k string, v array<array<string>>"), "k", "v").collect()


def test_manifest(spark, tmp_path):
    body = '{"k":1}\n{"k":2}\n'
    (tmp_path / "train.jsonl").write_text(body)
    entry = {"name": "train", "path": "train.jsonl", "record_count": 2, "bytes": len(body), "sha256": hashlib.sha256(body.encode()).hexdigest(), "allowed_use": ["train"]}
    at = tmp_path / "manifest.jsonl"

    def read(use="train", **change):
        at.write_text(json.dumps(entry | change) + "\n")
        return readers.manifest_splits(spark, str(tmp_path), str(at), "k int", use)

    assert sorted((r.k, r.split) for r in read().collect()) == [(1, "train"), (2, "train")]
    for change in ({"record_count": 3}, {"sha256": "0" * 64}, {"bytes": 1}, {"path": "../train.jsonl"}):
        with pytest.raises(ValueError):
            read(**change)
    with pytest.raises(ValueError):
        read(use="evaluate")


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(2, "b", None), (1, "a", "x")], "z int, a string, n string")
    sinks.write_jsonl(rows, str(tmp_path / "out"), "z")
    (part,) = (tmp_path / "out").glob("part-*")
    assert part.read_text() == '{"a":"a","n":"x","z":1}\n{"a":"b","n":null,"z":2}\n'
    found = readers.file_digests(spark, str(part)).first()
    assert found.sha256 == hashlib.sha256(part.read_bytes()).hexdigest()
    expected = spark.createDataFrame([(part.name, found.sha256), ("gone", "0")], "name string, sha256 string")
    assert [r.name for r in sinks.folder_drift(str(part), expected).collect()] == ["gone"]
    assert sinks.pending(rows, rows.where("z = 1"), "z").count() == 1


def test_manifest_ignores_order(spark):
    rows = spark.range(50).select("id", F.lit("train").alias("split"))
    a = sinks.manifest(rows, "split", "id").first()
    assert a == sinks.manifest(rows.repartition(7), "split", "id").first() and a.record_count == 50
    assert a.fingerprint != sinks.manifest(rows.where("id <> 7"), "split", "id").first().fingerprint


CASES = [
    (("in_domain", "freeze_card", 0.9, False, "u1"), ("a1", None, False), ("servicing", False, "freeze_card", "awaiting_user", False)),
    (("in_domain", "policy_knowledge", 0.9, False, "u2"), ("a2", None, False), ("policy", False, "freeze_card", "awaiting_user", True)),
    (("uncertain", "view_cards", 0.9, True, "u3"), ("a3", None, False), ("unchanged", False, "freeze_card", "awaiting_user", True)),
    (("in_domain", "conversation", 0.4, True, "u4"), ("a4", None, False), ("unchanged", False, "freeze_card", "awaiting_user", True)),
    (("in_domain", "conversation", 0.5, True, "u5"), ("a5", None, False), ("servicing", True, "freeze_card", "awaiting_user", False)),
    (("in_domain", "freeze_card", 0.9, False, "u6"), ("a6", "freeze_card", False), ("servicing", False, "freeze_card", "awaiting_user", False)),
    (("in_domain", "freeze_card", 0.9, False, "u7"), ("a7", "freeze_card", True), ("servicing", False, "", "", False)),
    (("in_domain", "policy_knowledge", 0.9, False, "u8"), ("a8", None, False), ("policy", False, "", "", False)),
    (("in_domain", "nonsense", 0.9, False, "u9"), ("", None, False), ("unchanged", False, "", "", False)),
]


def test_dialogue_transitions():
    state = dialogue.State()
    for observed, delivered, (lane, resumed, intent, phase, detour) in CASES:
        state, got_lane, got_resumed = dialogue.begin(state, *observed)
        state = dialogue.finish(state, *delivered)
        assert (got_lane, got_resumed, state.intent, state.phase, state.detour) == (lane, resumed, intent, phase, detour), observed


def streamed(spark, tmp_path, name, frames, **options):
    """Rows of the dialogue stream over one file per frame, read one by one in the order given."""
    source = tmp_path / name
    source.mkdir()
    for k, frame in enumerate(frames):
        frame.coalesce(1).write.parquet(str(tmp_path / f"{name}-{k}"))
        (file,) = (tmp_path / f"{name}-{k}").glob("part-*")
        target = source / f"{k}.parquet"
        target.write_bytes(file.read_bytes())
        os.utime(target, (1_000_000 + k, 1_000_000 + k))  # files are read by their times
    rows = spark.readStream.schema(frames[0].schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    q = dialogue.stream(rows, **options).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / f"{name}-cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(180) and q.exception() is None
    return sorted(tuple(r) for r in spark.table(name).collect())


def numbered(spark, sf_dir):
    """The turns of some users, numbered from 0."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    return fsm_input(spark, sf_dir).where("conv_id < 12").withColumn("turn", F.row_number().over(order).cast("bigint") - 1).cache()


def test_stream_bears_any_order(spark, sf_dir, tmp_path):
    rows = numbered(spark, sf_dir)
    batch = sorted(tuple(r) for r in dialogue.replay(rows).collect())
    assert len(batch) > 100
    patient = {"late": "10000 days", "patience": 10**8}
    backwards = [rows.where(f"turn % 3 = {k}") for k in (2, 1, 0)]
    assert streamed(spark, tmp_path, "backwards", backwards, **patient) == batch
    scattered = [rows.where(f"abs(hash(conv_id, turn)) % 2 = {k}").orderBy(F.rand(3)) for k in (0, 1)]
    twice = [scattered[0], scattered[1].unionByName(scattered[0]).unionByName(scattered[1])]
    assert streamed(spark, tmp_path, "scattered", twice, **patient) == batch


def test_stream_gives_up_gaps(spark, sf_dir, tmp_path):
    """Turn 2 never comes; turns 3 and 4 wait for it until the watermark passes them; turn 1 comes again, and too late turn 2 does."""
    one = numbered(spark, sf_dir).where("conv_id = (SELECT min(conv_id) FROM VALUES (0), (1) AS t(conv_id))").where("turn < 8").withColumn("at", F.timestamp_seconds(1_700_000_000 + F.col("turn") * 60))
    other = one.where("turn = 0").withColumn("conv_id", F.lit(99).cast("bigint"))
    late = other.withColumn("at", F.timestamp_seconds(F.lit(1_700_100_000)))
    frames = [one.where("turn IN (0, 3)"), one.where("turn IN (4, 1)").unionByName(one.where("turn = 0")), late, late.withColumn("turn", F.lit(1).cast("bigint")), one.where("turn IN (1, 2, 5, 6)").withColumn("at", F.timestamp_seconds(F.lit(1_700_100_000)))]
    got = streamed(spark, tmp_path, "gaps", frames, late="1 minute", patience=600)
    want = dialogue.replay(one.where("turn IN (0, 1, 3, 4, 5, 6)")).collect()
    assert [r for r in got if r[0] != 99] == sorted(tuple(r) for r in want)


def test_replay_of_repeats_and_nulls(spark, sf_dir):
    rows = numbered(spark, sf_dir)
    noise = rows.unionByName(rows.where("turn % 2 = 0")).unionByName(rows.limit(3).withColumn("turn", F.lit(None).cast("bigint")))
    assert sorted(tuple(r) for r in dialogue.replay(noise).collect()) == sorted(tuple(r) for r in dialogue.replay(rows).collect())
    assert dialogue.replay(rows.limit(0)).collect() == []


def test_session_windows_like_islands(spark, sf_dir):
    events = readers.table(spark, sf_dir, "events")
    islands = bank.sessions(events, "user_id", "ts").groupBy("user_id", "session_no").count()
    windows = sessions.session_counts(events)
    assert sorted((r.user_id, r["count"]) for r in islands.collect()) == sorted((r.user_id, r.n_events) for r in windows.collect())
