"""Rules, wire forms, calibrations and governed reads on hand-made cases."""

from __future__ import annotations

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from sievework.operators import contracts as K
from sievework.operators import metrics as M
from sievework.operators import records
from sievework.operators import retrieval as R
from sievework.operators import splits
from sievework.operators import tool_eval as T
from sievework.operators import wire as W
from sievework.sources import governed, readers
from sievework.streaming import dialogue


def parsed(spark, outputs):
    df = spark.createDataFrame(list(enumerate(outputs)), "i int, raw_output string")
    return {r.i: r for r in W.strict_parse(df).collect()}


def test_strict_parse_forms(spark):
    call = '{"name": "a", "arguments": {"y": 1, "x": [1, null]}}'
    outputs = [
        None, "", "plain text", call, f"<tool_call>{call}</tool_call>\n<tool_call>{call}</tool_call>", f"hi <tool_call>{call}</tool_call>", "<tool_call>{</tool_call>", '{"a": 1}', '{"content": "c"}', '{"tool_calls": []}',
        '<tool_call>{"name": "a", "arguments": {}, "index": 1}</tool_call>', '<tool_call>{"name": "a", "arguments": {}, "index": true}</tool_call>', '<tool_call>{"name": "a", "arguments": {}, "id": "k"}</tool_call><tool_call>{"name": "a", "arguments": {}, "id": " k "}</tool_call>',
        f"<tool_call>{call}</tool_call>" * 4, '{"tool_calls": [{"name": "", "arguments": {}}]}', "<tool_call>[1]</tool_call>", '<tool_call>{"name": "a"}</tool_call>', "{broken",
    ]
    got = parsed(spark, outputs)
    assert [got[i].failure for i in range(len(outputs))] == [
        "empty", "empty", None, None, None, "prose_outside_blocks", "invalid_json", "neither_calls_nor_content", None, None,
        "index_order", "index_not_an_integer", "repeated_id", "too_many_calls", "no_name", "not_an_object", "arguments_not_an_object", "invalid_json",
    ]
    assert [c.arguments for c in got[4].calls] == ["x=[1,null],y=1"] * 2 and [c["index"] for c in got[4].calls] == [0, 1]
    assert (got[2].content, got[8].content, got[3].content, got[5].calls) == ("plain text", "c", None, [])


def test_schema_errors_like_python(spark):
    schemas = {"t": {"a": (("integer", "null"), 1, 9, None, True), "b": (("number",), None, 2.5, None, False), "c": (("string",), None, None, ("x", "y"), False)}}
    rng = random.Random(1)
    values = [None, True, 0, 5, 12, 2.0, 3.25, "x", "z", [1], {"k": 1}]
    cases = [{k: rng.choice(values) for k in rng.sample("abcd", rng.randrange(5))} for _ in range(200)]

    def expected(case):
        kind = lambda v: "null" if v is None else "boolean" if isinstance(v, bool) else "integer" if isinstance(v, int) else "number" if isinstance(v, float) else "string" if isinstance(v, str) else "array" if isinstance(v, list) else "object"
        out = [f"extra:{k}" for k in case if k not in schemas["t"]]
        for k, (types, low, high, listed, required) in schemas["t"].items():
            if k not in case:
                out += [f"missing:{k}"] * required
                continue
            v, t = case[k], kind(case[k])
            if t not in types and not (t == "integer" and "number" in types):
                out.append(f"type:{k}")
            elif t in ("integer", "number") and low is not None and v < low:
                out.append(f"minimum:{k}")
            elif t in ("integer", "number") and high is not None and v > high:
                out.append(f"maximum:{k}")
            elif t == "string" and listed and v not in listed:
                out.append(f"enum:{k}")
        return sorted(out)

    df = spark.createDataFrame([(i, json.dumps(c)) for i, c in enumerate(cases)], "i int, j string")
    got = {r.i: r.e for r in df.select("i", W.schema_errors(F.lit("t"), F.parse_json("j"), schemas).alias("e")).collect()}
    assert got == {i: expected(c) for i, c in enumerate(cases)}
    assert df.select(W.schema_errors(F.lit("u"), F.parse_json("j"), schemas).alias("e")).first().e == ["unknown_tool"]


def test_private_keys_like_python(spark):
    value = {"a_id": "p1", "b": [{"c_id": "p2", "d": 1, "case_id": "k"}, [{"e_id": 7}]], "f": {"g": {"h_id": "p3", "i": None}}, "cost_cents": 123456}

    def strip(v):
        return {k: strip(x) for k, x in v.items() if not k.endswith("_id") or k == "case_id"} if isinstance(v, dict) else [strip(x) for x in v] if isinstance(v, list) else v

    df = spark.createDataFrame([(json.dumps(value),)], "j string").select(F.parse_json("j").alias("v"))
    r = df.select(F.to_json(W.without_private(F.col("v"), ("case_id",))).alias("bare"), W.private_values(F.col("v")).alias("ids"), W.scalars(F.col("v")).alias("facts")).first()
    assert json.loads(r.bare) == strip(value) and r.ids == ["k", "p1", "p2", "p3"]
    assert {"123456", "1234.56", "1,234.56", "p3", "1", "7"} <= set(r.facts)


def test_ceilings_and_thresholds(spark):
    """A best threshold of .95 is cut to the relation's ceiling; others keep theirs."""
    rows = [(k, p, y) for k in ("agent_repair", "clarification_answer", "topic_shift") for p, y in ((0.97, 1), (0.96, 1), (0.92, 0), (0.91, 0))]
    got = {r.relation: r.threshold for r in M.calibrate_relations(spark.createDataFrame(rows, "relation string, p double, label int")).collect()}
    assert got == {"agent_repair": 0.75, "clarification_answer": 0.8, "topic_shift": 0.95}


@pytest.mark.parametrize("seed", range(4))
def test_binary_threshold_like_all_comparisons(spark, seed):
    """Probabilities on thresholds (0.145, 0.285, 0.29, 0.565 and all others) count as reaching them."""
    rng = random.Random(seed)
    rows = [(rng.randrange(0, 201) / 200, int(rng.random() < 0.6), rng.random() < 0.3) for _ in range(150)] + [(p, 1, True) for p in (0.145, 0.285, 0.29, 0.565)]
    least, talk_least = 0.9, 0.8

    def scored(t):
        rate = lambda xs, ok: sum(map(ok, xs)) / len(xs) if xs else 0.0
        pos, neg, talk = [r for r in rows if r[1] == 1], [r for r in rows if r[1] == 0], [r for r in rows if r[1] == 1 and r[2]]
        recall, spec, talked = rate(pos, lambda r: r[0] >= t), rate(neg, lambda r: r[0] < t), rate(talk, lambda r: r[0] >= t)
        return (recall >= least and talked >= talk_least, spec, (recall + spec) / 2, t), recall, talked

    best = max(scored(i / 200) for i in range(1, 200))
    r = M.calibrate_binary(spark.createDataFrame(rows, "p double, y int, talk boolean"), "p", "y", least, "talk", talk_least).first()
    assert (r.specificity, r.balanced_accuracy, r.threshold, r.recall, r.conversational_recall) == (*best[0][1:], *best[1:])


def test_empty_slices_and_non_finite(spark):
    rows = spark.createDataFrame([(1, True)], "x int, ok boolean")
    got = {r.name: r.score for r in M.suite(rows, {"none": (F.col("x") > 5, F.col("ok")), "acceptance": (F.col("x") > 5, F.col("ok"), 1.0)}).collect()}
    assert got == {"none": None, "acceptance": 1.0}
    metrics = spark.createDataFrame([("a", 1.0), ("b", float("nan")), ("c", float("-inf")), ("d", None)], "name string, score double")
    assert sorted(r.name for r in M.non_finite(metrics).collect()) == ["b", "c"]


def test_percentiles_like_sorting(spark):
    rng = random.Random(5)
    values = [rng.choice((0.0, 1.0, rng.random() ** 6 * 100)) for _ in range(999)] + [None]
    df = spark.createDataFrame([(v,) for v in values], "d double")
    want = df.select(F.percentile("d", 0.5), F.percentile("d", 0.99), F.percentile("d", 1.0)).first()
    assert M.percentiles(df, "d", (0.5, 0.99, 1.0)).first().p == pytest.approx(list(want))
    assert M.percentiles(df.where("d > 1e9"), "d", (0.5,)).first().p is None


def test_created_at(spark):
    cases = [
        ("opened on 2024-03-05 at 09:07 UTC", "2024-03-05T09:07:00Z", True),
        ("opened March 5, 2024, 09:07:30Z", "2024-03-05T09:07:30Z", True),
        ("opened March 5, 2024 at 09:07", "2024-03-05T09:07:00Z", False),
        ("opened March 5, 2024 at 09:07", "2024-03-05T09:07:00", True),
        ("opened March 05, 2024 at 09:07 utc", "2024-03-05T09:07:00Z", False),
        ("opened 2024-03-06 at 09:07 UTC", "2024-03-05T09:07:00Z", False),
        ("it was some day", "some_day", False),
        ("it was some_day", "some_day", True),
    ]
    df = spark.createDataFrame([(i, c.lower(), v) for i, (c, v, _) in enumerate(cases)], "i int, c string, v string")
    got = {r.i: r.ok for r in df.select("i", T.created_at_grounded(F.col("c"), F.col("v")).alias("ok")).collect()}
    assert got == {i: ok for i, (_, _, ok) in enumerate(cases)}


def test_single_target(spark):
    m = lambda role, content=None, loss=False, call_id=None, tool=None: (role, content, loss, call_id, 0, tool, None, None, None)
    two = [m("user", "u"), m("assistant", None, True, "a", "list_cards"), m("tool", "{}", False, "a"), m("assistant", None, True, "b", "freeze_card"), m("tool", "{}", False, "b"), m("assistant", "done", True)]
    df = spark.createDataFrame([("r", two), ("s", two[:1] + two[3:])], f"rid string, messages array<{K.MESSAGE}>")
    got = {r.rid: [(x.role, x.content, x.loss, x.call_id) for x in r.new] for r in df.select("rid", K.to_single_target(F.col("rid"), F.col("messages"), F.lit("go on")).alias("new")).collect()}
    assert got["r"] == [("user", "u", False, None), ("assistant", None, False, "context_r_0"), ("tool", "{}", False, "context_r_0"), ("user", "go on", False, None), ("assistant", None, True, "call_r_0"), ("tool", "{}", False, "call_r_0"), ("assistant", "done", True, None)]
    assert len(got["s"]) == 4 and got["s"][1][3] == "b"


def test_lookup_like_brute_force(spark):
    """Pruning by the lightest terms changes no score and no rank."""
    import math

    rng = random.Random(2)
    words = [f"t{i}" for i in range(30)]
    some = lambda n: [words[min(29, int(rng.expovariate(0.2)))] for _ in range(n)]
    chunks, queries = {i: some(rng.randrange(1, 12)) for i in range(60)}, {i: some(rng.randrange(1, 10)) for i in range(25)} | {99: ["unheard"]}
    df = lambda d, k: spark.createDataFrame([(i, " ".join(w)) for i, w in d.items()], f"{k} int, text string")
    want, heavy = {}, {"t0", "t4", "t20"}
    n, docs = len(chunks), {i: set(w) for i, w in chunks.items()}
    weight = lambda t: (math.log((n + 1) / (sum(t in d for d in docs.values()) + 1)) + 1) * (1.75 if t in heavy else 1)
    for q, terms in queries.items():
        terms = set(terms)
        whole = sum(map(weight, terms))
        scored = [(-round(sum(map(weight, terms & d)) / whole, 6), i) for i, d in docs.items() if terms & d & heavy]
        want[q] = [(i, -s) for s, i in sorted(scored) if -s >= 0.3][:3]
    found = R.lookup(df(queries, "query_id"), df(chunks, "chunk_id"), tuple(heavy), 3, 0.3, stop=(), aliases={})
    got = {q: [] for q in queries}
    for r in sorted(found.collect(), key=lambda r: r["rank"]):
        got[r.query_id].append((r.chunk_id, r.score))
    assert got == want and any(want.values())
    matched = {r.query_id: (r.matched, list(r.chunk_ids)) for r in R.with_unmatched(df(queries, "query_id"), found).collect()}
    assert matched == {q: (bool(w), [str(i) for i, _ in w]) for q, w in want.items()}
    with pytest.raises(ValueError):
        R.lookup(df(queries, "query_id"), df(chunks, "chunk_id"), limit=0)


def test_ranked_like_sorting(spark):
    rng = random.Random(7)
    rows = [(i, rng.choice(["a", "b", None]), rng.randrange(-1000, 100_000)) for i in range(500)]
    df = spark.createDataFrame(rows, "i int, g string, v bigint")
    want = {}
    for g in ("a", "b", None):
        for n, r in enumerate(sorted((r for r in rows if r[1] == g), key=lambda r: (r[2], r[0]))):
            want[r[0]] = n
    assert {r.i: r.n for r in splits.ranked(df, ["g"], splits.value_bin(df, "v"), ["v", "i"], "n").collect()} == want
    assert splits.ranked(df.limit(0), ["g"], splits.value_bin(df.limit(0), "v"), ["v"], "n").count() == 0
    parts = splits.group_split(df, "g")
    assert parts.count() == 500 and parts.columns == ["i", "g", "v", "split"]


def test_reset_and_commit(spark):
    turns = [(1, 0, "in_domain", "freeze_card", 0.9, False, "u", "which?", None, None), (1, 1, "reset", None, None, False, "", "", None, None), (1, 2, "in_domain", "policy_knowledge", 0.9, False, "u", "", None, None), (None, 0, "in_domain", "freeze_card", 0.9, False, "u", "", "freeze_card", True)]
    got = sorted(dialogue.replay(spark.createDataFrame(turns, dialogue.INPUT)).collect(), key=str)
    assert [(r.conv_id, r.turn, r.lane, r.pending_intent) for r in got] == [(1, 0, "servicing", "freeze_card"), (1, 1, "reset", ""), (1, 2, "policy", ""), (None, 0, "servicing", "")]
    pending = dialogue.State("freeze_card", "u", "", "awaiting_assistant")
    assert dialogue.commit(pending, "freeze_card", True) == dialogue.State() and dialogue.commit(pending, "list_cards", True) == pending
    assert dialogue.deliver(pending, "a").phase == "awaiting_user"


def written(path, value):
    path.write_text(value if isinstance(value, str) else json.dumps(value))
    return str(path)


def test_governed_reads(spark, tmp_path):
    lines = '{"record_id": "a", "trainable": true}\n\n{"record_id": "b"}\n'
    gate = '{"record_id": "g", "trainable": false}\n'
    written(tmp_path / "train.jsonl", lines)
    written(tmp_path / "gate.jsonl", gate)
    schema = "record_id string, trainable boolean"
    entry = {"name": "coreference-shadow", "trainable": False, "allowed_use": ["post-selection-evaluation-once"], "path": "gate.jsonl", "sha256": hashlib.sha256(gate.encode()).hexdigest(), "record_count": 1}
    good = {"splits": {"train": {"path": "train.jsonl"}, "gate": "gate.jsonl"}, "behavioral_gates": [entry]}
    at = written(tmp_path / "m.json", good)
    read = lambda manifest, split="train": governed.training_rows(spark, str(tmp_path), manifest, split, schema)
    assert sorted(r.record_id for r in read(at).collect()) == ["a", "b"]
    listed = written(tmp_path / "l.json", {"tool_sft": [{"name": "train", "path": "train.jsonl"}, {"name": "train", "path": "gone.jsonl", "included": False}]})
    assert read(listed).count() == 2
    for bad, split in (({**good, "training_allowed": False}, "train"), (good, "gate"), (good, "test"), ({"contract": governed.EVALUATION_CONTRACT, **good}, "train"), ({"splits": {"train": "../x"}}, "train"), ({"tool_sft": []}, "train")):
        with pytest.raises(ValueError):
            read(written(tmp_path / "bad.json", bad), split)
    test = spark.createDataFrame([("t", None)], schema)
    assert sorted(r.record_id for r in governed.with_shadow_gate(spark, str(tmp_path), at, test, schema).collect()) == ["g", "t"]
    for change in ({"trainable": True}, {"allowed_use": []}, {"sha256": "0" * 64}, {"record_count": 2}, {"name": "other"}):
        with pytest.raises(ValueError):
            governed.with_shadow_gate(spark, str(tmp_path), written(tmp_path / "bad.json", {"behavioral_gates": [entry | change]}), test, schema)


def test_policy_corpus(spark, tmp_path):
    chunks = [{"chunk_id": "b", "title": "T é", "text": "x", "effective_from": "2024-01-01", "effective_to": None}]
    revision = lambda c: "sha256:" + hashlib.sha256(json.dumps({"schema_version": 1, "chunks": c}, ensure_ascii=False, separators=(",", ":"), sort_keys=True).encode()).hexdigest()
    made = lambda c, r=None, v=1: written(tmp_path / "c.json", {"schema_version": v, "corpus_revision": r or revision(c), "chunks": c})
    r = governed.policy_corpus(spark, made(chunks)).first()
    assert (r.chunk_id, r.title, r.effective_to) == ("b", "T é", None)
    for bad in (made(chunks, "sha256:0"), made(chunks * 2), made([]), made(chunks, v=2)):
        with pytest.raises(ValueError):
            governed.policy_corpus(spark, bad)


def test_json_lines_reads_lists_of_paths(spark, tmp_path):
    paths = [written(tmp_path / f"{i}.jsonl", json.dumps({"a": i})) for i in range(2)]
    assert sorted(r.a for r in readers.json_lines(spark, paths, "a int").collect()) == [0, 1]


def test_strict_parse_refuses_other_tool_calls(spark):
    schemas = {"a": {"n": (("integer",), 1, 9, None, True)}}
    outputs = ['{"tool_calls": {"name": "a"}}', '{"tool_calls": null}', '{"tool_calls": "x", "content": "y"}', '{"tool_calls": [], "content": "y"}', '{"tool_calls": [{"name": "a", "arguments": {"n": 2}}]}', '<tool_call>{"name": "b", "arguments": {}}</tool_call>', '<tool_call>{"name": "a", "arguments": {"n": 0}}</tool_call>', '{"name": "a", "arguments": {"m": 1, "n": 1}}', '{"name": "a", "arguments": {}}']
    rows = spark.createDataFrame(list(enumerate(outputs)), "i int, raw_output string")
    got = {r.i: r for r in W.strict_parse(rows, schemas=schemas).collect()}
    assert [got[i].failure for i in range(len(outputs))] == ["tool_calls_not_a_list"] * 3 + [None, None, "unknown_tool", "minimum:n", "extra:m", "missing:n"]
    assert got[3].content == "y" and got[4].calls[0].name == "a"
    assert parsed(spark, outputs)[5].failure is None


@pytest.mark.parametrize(
    ("answer", "evidence", "errors"),
    [
        ("Up to 3 days. [Policy: p]", "Up to 30 days to arrive.", ["number_without_evidence"]),
        ("Up to three days. [Policy: p]", "Up to 30 days to arrive.", ["number_without_evidence"]),
        ("Effective January 1, 2026. [Policy: p]", "Cards. 2026-01-01", []),
        ("You may request 1 replacement, the fee is $1000 now. [policy:  p ]", "One replacement is allowed and the fee is $1,000.00 in all", []),
        ("The rate is 3.50% and 1,250 apply [Policy: p]", "3.5% of 1250 or so", []),
        ("The fee is 5 [Policy: p]", "The fee is $5 or 5%", ["number_without_evidence"]),
        ("Twelve [Policy: q]", "3", ["citation_not_allowed", "nothing_returned_cited", "number_without_evidence"]),
        ("Fine [Policy: p] [Policy: q 2]", "", ["citation_not_allowed"]),
        ("Our demo says so", "", ["internal_demo", "no_citation"]),
        (None, None, ["empty", "no_citation"]),
    ],
)
def test_policy_answers(spark, answer, evidence, errors):
    row = spark.createDataFrame([(answer, evidence)], "a string, e string")
    assert row.select(records.policy_answer_errors(F.col("a"), F.array(F.lit("p")), F.col("e")).alias("x")).first().x == errors
    assert "no_evidence" in row.select(records.policy_answer_errors(F.col("a"), F.array(F.lit(" ")), F.col("e")).alias("x")).first().x


def test_policy_answers_take_all_cores(spark, sf_dir):
    from sievework.plans import record_queries

    assert record_queries.q_policy_answers(spark, sf_dir).rdd.getNumPartitions() == 4 * spark.sparkContext.defaultParallelism
