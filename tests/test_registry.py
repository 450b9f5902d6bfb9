"""Session registries against a plain dictionary, in batch and as a stream."""

from __future__ import annotations

import os
import random

from pyspark.sql import functions as F

from sievework.plans.service_queries import accesses
from sievework.sources.readers import table
from sievework.streaming import registry

START = 1_700_000_000


def plainly(rows, ttl, most):
    """Opened and evicted sessions by a dictionary that is searched for its oldest entry; expired ones when they are purged."""
    held, out = {}, []
    for reg, session, at, _ in sorted(rows, key=lambda r: (r[2], r[3])):
        live = held.setdefault(reg, {})
        for s, last in list(live.items()):
            if at - last > ttl:
                out.append((reg, s, last + ttl, "expired"))
                del live[s]
        if session not in live:
            while len(live) >= most:
                oldest = min(live, key=lambda s: live[s])
                out.append((reg, oldest, at, "evicted"))
                del live[oldest]
            out.append((reg, session, at, "opened"))
        live.pop(session, None)
        live[session] = at
    return sorted(out, key=str)


def frame(spark, rows):
    df = spark.createDataFrame(rows, "registry string, session string, s bigint, id bigint")
    return df.select("registry", "session", F.timestamp_seconds("s").alias("at"), "id")


def seconds(rows):
    return sorted(((r.registry, r.session, r.at_us // 1_000_000, r.change) for r in rows), key=str)


def made(seed):
    pick, rows, now = random.Random(seed), [], START
    for i in range(900):
        now += pick.choice([0, 1, 5, 30, 200])
        rows.append((pick.choice(["hot", "hot", "hot", "cold", None, f"r{i % 40}"]), f"s{pick.randrange(12)}", now, i))
    return rows


def test_batch_equals_a_dictionary(spark):
    for seed, (ttl, most) in enumerate([(60, 4), (400, 3), (10_000, 5), (300, 1)]):
        rows = made(seed)
        df = frame(spark, [*rows, ("hot", None, START, 1)]).repartition(9)
        assert seconds(registry.changes(df, ttl, most).collect()) == plainly(rows, ttl, most)
    assert registry.changes(frame(spark, []), 60, 4).collect() == []


def test_events_in_one_registry(spark, sf_dir):
    rows = [("bank", str(r.user_id), r.us, r.event_id) for r in table(spark, sf_dir, "events").selectExpr("user_id", "unix_micros(CAST(ts AS TIMESTAMP)) AS us", "event_id").collect()]
    for ttl, most in ((7200, 3), (7200, 32), (600, 2)):
        got = sorted(((r.registry, r.session, r.at_us, r.change) for r in registry.changes(accesses(spark, sf_dir), ttl, most).collect()), key=str)
        assert got == plainly(rows, ttl * 1_000_000, most)


def test_stream_equals_batch(spark, tmp_path):
    rows = [r for r in made(7) if r[0] is not None]
    source = tmp_path / "in"
    source.mkdir()
    for k in range(3):
        frame(spark, rows[300 * k : 300 * (k + 1)]).coalesce(1).write.parquet(str(tmp_path / f"p{k}"))
        (file,) = (tmp_path / f"p{k}").glob("part-*")
        (source / f"{k}.parquet").write_bytes(file.read_bytes())
        os.utime(source / f"{k}.parquet", (1_000_000 + k, 1_000_000 + k))
    opened = spark.readStream.schema("registry string, session string, at timestamp, id bigint").option("maxFilesPerTrigger", 1).parquet(str(source))
    q = registry.stream(opened, 300, 4).writeStream.format("memory").queryName("live").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(180) and q.exception() is None
    got, want = seconds(spark.table("live").collect()), plainly(rows, 300, 4)
    assert set(want) <= set(got) and len(got) == len(set(got))
    # What the stream adds are sessions that timers ended after their registry's last access.
    assert {r[3] for r in set(got) - set(want)} <= {"expired"}
