"""Nested JSON of any depth against Python, and replays of calls against hand-made ends."""

from __future__ import annotations

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from sievework.functions import text as X
from sievework.operators import ledger as L
from sievework.operators import wire as W


def made(pick, depth):
    if depth == 0 or pick.random() < 0.1:
        return pick.choice(["x", 'a "[{', "", 7, -3, True, None, 2.5, "\\", "é{", 123456])
    if pick.random() < 0.5:
        return [made(pick, depth - 1) for _ in range(pick.randint(0, 2))]
    return {pick.choice(["a_id", "case_id", "b", "paid_cents", "z", "é_id"]): made(pick, depth - 1) for _ in range(pick.randint(0, 3))}


def depth_of(v):
    return 1 + max((depth_of(x) for x in (v.values() if isinstance(v, dict) else v)), default=0) if isinstance(v, dict | list) else 0


def bare(v):
    if isinstance(v, dict):
        return {k: bare(x) for k, x in v.items() if not k.endswith("_id") or k == "case_id"}
    return [bare(x) for x in v] if isinstance(v, list) else v


def leaves(v, key=""):
    if isinstance(v, dict):
        return [y for k, x in v.items() for y in leaves(x, k)]
    return [y for x in v for y in leaves(x, key)] if isinstance(v, list) else [(key, v)]


def canonical(v):
    return json.dumps(v, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def test_any_depth_equals_python(spark):
    pick = random.Random(2)
    values = [made(pick, pick.randint(0, 11)) for _ in range(60)]
    deep = {"a": "x"}
    for i in range(12):
        deep = {"k": [deep], "n_id": f"p{i}", "case_id": "c"}
    values += [deep, None, [], {}]
    rows = spark.createDataFrame([(i, json.dumps(v)) for i, v in enumerate(values)], "i int, t string").withColumn("v", F.parse_json("t"))
    assert W.deepest(rows, "v") == 25
    got = W.with_private_apart(rows.withColumn("d", W.depth(F.col("v"))), "v", ("case_id",)).select("i", "d", F.to_json("v").alias("w"), W.record_hash(F.col("v")).alias("h"), "private_ids").collect()
    for r in got:
        v = values[r.i]
        assert (r.d, r.w) == (depth_of(v), canonical(bare(v)))
        assert r.h == "sha256:" + hashlib.sha256(canonical(bare(v)).encode()).hexdigest()
        assert r.private_ids == sorted({x for k, x in leaves(v) if k.endswith("_id") and isinstance(x, str) and x})
    facts = {(r.i, r.fact) for r in W.scalar_rows(rows.select("i", "v"), "v").collect()}
    texts = {(i, str(x).lower() if isinstance(x, bool) else str(x), k) for i, v in enumerate(values) for k, x in leaves(v) if x is not None}
    normal = {t: r for t, r in spark.createDataFrame([(t,) for _, t, _ in texts], "t string").distinct().select("t", X.normalize(F.col("t"))).collect()}
    want = {(i, normal[t]) for i, t, _ in texts} | {(i, f) for i, t, k in texts if k.endswith("_cents") and t.lstrip("-").isdigit() for f in (f"{abs(int(t)) // 100}.{abs(int(t)) % 100:02}", f"{abs(int(t)) // 100:,}.{abs(int(t)) % 100:02}")}
    assert facts == want
    with pytest.raises(Exception, match="deeper than told"):
        rows.select(W.private_values(F.col("v"))).collect()
    with pytest.raises(Exception, match="deeper than told"):
        rows.select(W.without_private(F.col("v"))).collect()


CARDS = [("k1", "1111", "Gold", "frozen"), ("k2", "2222", "Blue", "active"), ("k3", "2222", "Cash", "active")]
DEBITS = [(-5, "Shop", False, "2024-01-02", "posted", "t1"), (-7, "shop", True, "2024-01-03", "posted", "t2"), (9, "Pay", False, "2024-01-04", "posted", "t3"), (-8, "Café", False, "2024-01-01", "posted", "t4")]
TRANSFERS = [(10, "2024-01-01", "Ann", "pending", "w1"), (10, "2024-01-02", "Bob", "pending", "w2"), (10, "2024-01-03", "ann", "completed", "w3")]
SEEDED = [("c1", "other", "2023-01-01", "closed", "Old"), ("c2", "other", "2023-02-01", "open", "Newer")]


def replayed(spark, *calls):
    names = ("last4", "transaction_id", "description", "transfer_id", "recipient", "limit")
    rows = [(CARDS, DEBITS, TRANSFERS, SEEDED)] if calls is not None else []
    plan = [(c[0], *(c[1].get(n) for n in names)) for c in calls]
    df = spark.createDataFrame([(rows[0], plan)], f"s {L.STATE}, c array<{L.CALL}>")
    return df.select(L.replay(F.col("s"), F.col("c")).alias("r"), F.col("c")).select("r", L.snapshot(F.col("r")).alias("shown"), L.state_hash(F.col("r"), F.col("c")).alias("h"), L.events_hash(F.col("r")).alias("e")).first()


def told(row):
    return [e.message or json.loads(e.result) for e in row.r.envelopes]


def test_selectors_and_failures(spark):
    row = replayed(
        spark,
        ("freeze_card", {}), ("replace_card", {"last4": "2222"}), ("freeze_card", {"last4": "9"}),
        ("dispute_transaction", {"description": "SHOP"}), ("dispute_transaction", {"description": "shop"}), ("dispute_transaction", {"transaction_id": "t3"}), ("dispute_transaction", {}), ("dispute_transaction", {}),
        ("dispute_transaction", {"transaction_id": "t1", "description": "x"}), ("cancel_transfer", {"recipient": "ANN"}), ("cancel_transfer", {}), ("cancel_transfer", {"transfer_id": "w3"}),
        ("freeze_card", {"recipient": "Ann"}), ("close_account", {}), ("list_transactions", {"limit": 2}), ("list_cards", {}),
    )
    got = told(row)
    assert [g["card_id"] if "card_id" in g else g for g in got[:3]] == ["k2", "k2", L.NO_MATCH]
    assert [g if isinstance(g, str) else g["transaction_id"] for g in got[3:9]] == ["t1", L.NO_MATCH, "t3", "t4", L.NO_MATCH, L.NOT_COMPLETED]
    assert [g if isinstance(g, str) else g["transfer_id"] for g in got[9:12]] == ["w1", "w2", L.NO_MATCH]
    assert got[12:14] == [L.NOT_SUPPORTED] * 2
    assert [t["transaction_id"] for t in got[14]] == ["t3", "t2"] and [c["name"] for c in got[15]] == ["Blue", "Cash", "Gold"]
    state = json.loads(row.shown)
    assert {c["card_id"]: c["status"] for c in state["cards"]} == {"k1": "frozen", "k2": "replacement_pending", "k3": "active"}
    assert [c["case_id"] for c in state["service_cases"]] == [f"generated_case_00{i}" for i in range(1, 6)] + ["c2", "c1"]
    assert state["service_cases"][0]["subject"] == "Stolen Card for card ending 2222" and state["service_cases"][4]["subject"] == "Dispute Café (t4)"
    assert {t["transfer_id"]: t["status"] for t in state["transfers"]} == {"w1": "cancelled", "w2": "cancelled", "w3": "completed"}
    assert row.h == "sha256:" + hashlib.sha256(canonical(state).encode()).hexdigest()


def test_failed_calls_change_nothing(spark):
    none, failed = replayed(spark), replayed(spark, ("freeze_card", {"last4": "0"}), ("cancel_transfer", {"recipient": "Cy"}))
    assert none.h is None and none.r.envelopes == [] and none.shown == failed.shown and failed.h is not None
    assert [(e.ok, e.code) for e in failed.r.envelopes] == [(False, L.FAILED_CODE)] * 2
    assert replayed(spark, ("freeze_card", {})).e == replayed(spark, ("freeze_card", {})).e != failed.e
    empty = spark.sql(f"SELECT CAST(NULL AS {L.STATE}) AS s, CAST(NULL AS array<{L.CALL}>) AS c").select(L.replay(F.col("s"), F.col("c")).alias("r")).first()
    assert empty.r.cards == [] and empty.r.envelopes == []


def test_read_bundles(spark):
    df = spark.createDataFrame([((CARDS, DEBITS, TRANSFERS, SEEDED), [("freeze_card", "2222", None, None, None, None, None)])], f"s {L.STATE}, c array<{L.CALL}>")
    state = df.select(L.replay(F.col("s"), F.col("c")).alias("r"))

    def read(*tools):
        given = F.array(*map(F.lit, tools)).cast("array<string>") if tools != (None,) else F.lit(None).cast("array<string>")
        return state.select(L.read_bundle(F.col("r"), given).alias("b")).first().b

    both = read("list_cards", "list_service_cases", "list_cards")
    assert both.problem is None and set(both.results) == {"list_cards", "list_service_cases"}
    assert [c["status"] for c in json.loads(both.results["list_cards"])] == ["frozen", "active", "frozen"]
    assert [c["case_id"] for c in json.loads(both.results["list_service_cases"])] == ["generated_case_001", "c2", "c1"]
    assert (read("list_cards", "freeze_card").problem, read().problem, read(None).problem) == ("not_a_read", "empty_bundle", "empty_bundle")
    assert read("list_cards", "freeze_card").results is None


def test_walks_in_batches_keep_every_level_and_number(spark):
    deep = '{"a":' * 120 + '{"x_id":["s","",{"y":1}],"n_cents":-1234567,"big_cents":12345678901234567890123,"f":1.50,"e":{},"t":true,"z":null}' + "}" * 120
    rows = spark.createDataFrame([(1, deep), (2, None), (3, '"Ä b"'), (4, "[]")], "i int, j string").selectExpr("i", "try_parse_json(j) AS v")
    got = {r.i: r for r in W.with_private_apart(rows, "v", (), "depth").selectExpr("i", "to_json(v) AS v", "private_ids AS p", "depth").collect()}
    bare = '{"a":' * 120 + '{"big_cents":12345678901234567890123,"e":{},"f":1.5,"n_cents":-1234567,"t":true,"z":null}' + "}" * 120
    assert (got[1].v, got[1].p, got[1].depth) == (bare, ["s"], 123)
    assert [(got[i].v, got[i].p, got[i].depth) for i in (2, 3, 4)] == [(None, [], 0), ('"Ä b"', [], 0), ("[]", [], 1)]
    facts = {r.i: sorted(r.facts) for r in W.scalar_sets(rows, "v").collect()}
    assert facts == {1: sorted(["s", "", "1", "1234567", "12345.67", "12,345.67", "12345678901234567890123", "1 5", "true"]), 2: [], 3: ["ä b"], 4: []}
