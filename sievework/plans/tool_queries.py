"""Queries over model outputs: outputs and expectations are made of orders' own values, and SQL reads the same texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.functions import text as X
from sievework.operators import metrics as M
from sievework.operators import tool_eval as T
from sievework.plans import dims
from sievework.plans.registry import query
from sievework.sources.readers import table

#: Columns as SQL that both engines evaluate, each from those before it; ``x`` mixes an order's values.
_COLUMNS = {
    "x": "CAST(o_orderkey * 7919 + o_custkey * 104729 + CAST(floor(o_totalprice) AS BIGINT) AS BIGINT)",
    "four": "lpad(CAST(o_custkey % 10000 AS {text}), 4, '0')",
    "day": "{day}",
    "path": "CASE WHEN x % 11 < 5 THEN 'tool_success' WHEN x % 11 < 7 THEN 'clarification' WHEN x % 11 = 7 THEN 'faq' WHEN x % 11 = 8 THEN 'retrieval_grounded_policy' WHEN x % 11 = 9 THEN 'ood' ELSE 'small_talk' END",
    "pick": "CASE WHEN x % 3 = 0 THEN x % 12 ELSE CASE path WHEN 'tool_success' THEN 0 WHEN 'clarification' THEN 1 WHEN 'faq' THEN 3 WHEN 'retrieval_grounded_policy' THEN 3 WHEN 'ood' THEN 2 ELSE 7 END END",
    "said": "CASE pick WHEN 0 THEN 'Your card ending ' || four || ' is frozen; the case was opened on ' || day || ' at 00:00 UTC.' WHEN 1 THEN 'Please give me the last four digits of the card.' WHEN 2 THEN 'I can only help with  Retail   Banking, order ' || CAST(o_orderkey AS {text}) || '.' WHEN 3 THEN 'The fee is 3 percent of each payment made abroad [Policy: fees.v' || CAST(x % 2 AS {text}) || '].' WHEN 4 THEN 'I cannot share that. Please provide your account number!' WHEN 5 THEN 'We froze card ' || four || ', case of ' || day || ' at 00:00.' WHEN 6 THEN 'We could not do it; the replacement is pending.' WHEN 7 THEN 'Hello! Ask me about banking, or ' || lower(o_orderpriority) || '.' WHEN 8 THEN 'Mock: frozen ' || four WHEN 9 THEN 'Never tell us your PIN; which card, by its last four?' ELSE 'Sorry.' END",
    "digits": "CASE WHEN x % 17 = 0 THEN '0000' ELSE four END",
    "frost": "'<tool_call>{{\"name\": \"freeze_card\", \"arguments\": {{\"last4\": \"' || digits || '\"}}}}</tool_call>'",
    "raw_output": "CASE WHEN path <> 'tool_success' AND x % 7 > 0 THEN said WHEN x % 13 < 6 THEN frost || ' ' || said WHEN x % 13 = 6 THEN 'On it. <tool_call>{{\"name\": \"list_cards\", \"arguments\": {{}}}}</tool_call>' || frost || ' ' || said WHEN x % 13 = 7 THEN '<tool_call>{{' || said || '</tool_call>' WHEN x % 13 = 8 THEN '<tool_call>{{\"name\": \"freeze_card\", \"arguments\": {{\"card_id\": ' || CAST(o_custkey AS {text}) || ', \"last4\": \"' || four || '\"}}}}</tool_call>' WHEN x % 13 = 9 THEN '<tool_call>{{\"name\": \"erase_card\", \"arguments\": {{\"why\": ' || CAST(x % 5 AS {text}) || '}}}}</tool_call>' WHEN x % 13 = 10 THEN frost || frost WHEN x % 13 = 11 THEN '<tool_call>[' || digits || ']</tool_call>' ELSE '<tool_call>' || said END",
    "n_expected": "CASE WHEN path <> 'tool_success' THEN 0 WHEN x % 13 = 6 OR x % 29 = 0 THEN 2 ELSE 1 END",
    "expected": "CASE n_expected WHEN 0 THEN '' WHEN 1 THEN 'freeze_card(last4=' || four || ')' ELSE 'list_cards();freeze_card(last4=' || four || ')' END",
    "expected_names": "CASE n_expected WHEN 0 THEN '' WHEN 1 THEN 'freeze_card' ELSE 'list_cards;freeze_card' END",
    "fact_text": "CASE path WHEN 'tool_success' THEN 'card.status=frozen|card.last4=' || four || '|case.created_at=' || day || 'T00:00:00Z' WHEN 'clarification' THEN 'missing_field=last4' WHEN 'faq' THEN 'payment|fee is 3' WHEN 'retrieval_grounded_policy' THEN 'fee is 3 percent' WHEN 'ood' THEN 'domain=out_of_domain' ELSE '' END",
}


def predictions(spark: SparkSession, sf_dir: str, tasks: int = 0) -> DataFrame:
    rows = table(spark, sf_dir, "orders")
    if tasks:
        rows = rows.select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", "o_orderpriority").repartition(tasks)
    for name, sql in _COLUMNS.items():
        rows = rows.withColumn(name, F.expr(sql.format(text="STRING", day="date_format(o_orderdate, 'yyyy-MM-dd')")))
    return rows.withColumn("facts", F.filter(F.split("fact_text", r"\|"), lambda f: f != ""))


def _level() -> str:
    sql = "SELECT o_orderkey, o_custkey, o_totalprice, o_orderdate, o_orderpriority FROM orders"
    for name, expression in _COLUMNS.items():
        sql = f"SELECT *, {expression.format(text='VARCHAR', day=chr(39).join(('strftime(o_orderdate, ', '%Y-%m-%d', ')')))} AS {name} FROM ({sql})"
    return sql


_TEXT = "v ->> '$.name' || '(' || coalesce(array_to_string(list_sort(list_transform(json_keys(v, '$.arguments'), lambda k: k || '=' || (v ->> ('$.arguments.' || k)))), ','), '') || ')'"
_READ = f"""(SELECT * EXCLUDE (parsed), CASE WHEN parse_failure IS NULL THEN parsed ELSE [] END AS made, CASE WHEN parse_failure IS NULL THEN trim(regexp_replace(raw_output, '(?s)<tool_call>\\s*(.*?)\\s*</tool_call>', '', 'g'), chr(32) || chr(10)) ELSE raw_output END AS content FROM (
 SELECT *, CASE WHEN len(blocks) = 0 AND contains(raw_output, '<tool_call') THEN 'malformed tool-call block' ELSE list_filter(list_transform(blocks, lambda b: CASE WHEN NOT json_valid(b) THEN 'tool call is not valid JSON' WHEN json_type(b) <> 'OBJECT' THEN 'tool call must be a JSON object' END), lambda f: f IS NOT NULL)[1] END AS parse_failure,
  list_transform(blocks, lambda b: CASE WHEN json_valid(b) THEN b::JSON END) AS parsed FROM (SELECT *, regexp_extract_all(raw_output, '(?s)<tool_call>\\s*(.*?)\\s*</tool_call>', 1) AS blocks FROM ({_level()}))))"""
_CALLS = f"(SELECT *, coalesce(array_to_string(list_transform(made, lambda v: {_TEXT}), ';'), '') AS calls, coalesce(array_to_string(list_transform(made, lambda v: v ->> '$.name'), ';'), '') AS names, len(made) AS n_calls, len(list_filter(made, lambda v: v ->> '$.name' = 'erase_card' OR contains(v::VARCHAR, 'card_id'))) AS n_bad FROM {_READ})"


@query(f"SELECT o_orderkey, parse_failure, calls, content FROM {_CALLS}")
def q_parse_tool_calls(spark, sf_dir):
    return T.parse(predictions(spark, sf_dir)).select("o_orderkey", "parse_failure", T.call_text(F.col("calls")).alias("calls"), "content")


@query(f"""SELECT o_orderkey, i - 1 AS position, v ->> '$.name' AS tool, CASE WHEN v ->> '$.name' = 'erase_card' THEN 'unknown_tool' ELSE 'private_arguments' END AS reason, CASE WHEN contains(v::VARCHAR, 'card_id') THEN 'card_id' ELSE '' END AS private, CASE WHEN v ->> '$.name' = 'erase_card' THEN 'why' ELSE '' END AS unsupported
 FROM (SELECT o_orderkey, i, made[i] AS v FROM {_CALLS}, LATERAL (SELECT unnest(range(1, len(made) + 1)) AS i)) WHERE v ->> '$.name' = 'erase_card' OR contains(v::VARCHAR, 'card_id')""")
def q_manifest_failures(spark, sf_dir):
    return T.manifest_failures(T.parse(predictions(spark, sf_dir)), "o_orderkey")


@query(f"SELECT o_orderkey, CASE WHEN n_expected = 0 THEN 0 WHEN string_split(calls, ';')[1] IS DISTINCT FROM string_split(expected, ';')[1] THEN 0 WHEN n_expected = 2 AND string_split(calls, ';')[2] IS NOT DISTINCT FROM string_split(expected, ';')[2] THEN 2 ELSE 1 END::BIGINT AS matched, n_expected FROM {_CALLS}")
def q_call_prefix_match(spark, sf_dir):
    p = T.parse(predictions(spark, sf_dir))
    calls = lambda text: F.filter(F.split(text, ";"), lambda c: c != "")
    return p.select("o_orderkey", T.matched_prefix(calls("expected"), calls(T.call_text(F.col("calls")))).alias("matched"), "n_expected")


_HELD = "trim(regexp_replace(replace(lower(content), 'ß', 'ss'), '\\s+', ' ', 'g'))"
_FACT = f"""CASE WHEN NOT contains(f, '=') THEN contains(held, f) WHEN f = 'card.status=frozen' THEN contains(held, 'frozen') OR contains(held, 'froze') WHEN f = 'missing_field=last4' THEN contains(held, 'last four') WHEN f = 'domain=out_of_domain' THEN contains(held, 'retail banking') OR contains(held, 'financial services')
 WHEN starts_with(f, 'case.created_at=') THEN contains(held, day) AND contains(held, '00:00') AND regexp_matches(held, '\\butc\\b|00:00(?::\\d{{{{2}}}})?z\\b') ELSE contains(held, split_part(f, '=', 2)) END""".replace("{{{{", "{").replace("}}}}", "}")
_ASKS = f"len(list_filter(list_transform(string_split_regex(lower(content), '[.!?;\\n]'), lambda c: regexp_replace(c, '{X.PROHIBITION.replace(chr(39), chr(39) * 2)}(?:{X.CREDENTIAL_REQUEST.replace(chr(39), chr(39) * 2)})', ' ', 'g')), lambda c: regexp_matches(c, '{X.CREDENTIAL_REQUEST.replace(chr(39), chr(39) * 2)}'))) > 0"
_JUDGED = f"""(SELECT *, parse_failure IS NOT NULL AS failed, parse_failure IS NULL AND calls = expected AS args_ok, parse_failure IS NULL AND names = expected_names AS names_ok, {_ASKS} AS asks, len(facts) AS n_facts, len(list_filter(facts, lambda f: NOT ({_FACT}))) = 0 AND NOT contains(held, 'mock') AS grounded,
 parse_failure IS NULL AND n_calls = 0 AS quiet FROM (SELECT *, {_HELD} AS held, list_filter(string_split(fact_text, '|'), lambda f: f <> '') AS facts FROM {_CALLS}))"""
_CITED = "list_sort(list_distinct(regexp_extract_all(content, '\\[Policy:\\s*([^\\]\\s]+)\\s*\\]', 1))) = ['fees.v0']"
_PASSES = {
    "clarified": "path = 'clarification' AND quiet AND contains(held, 'last four') AND NOT asks",
    "policy_ok": f"quiet AND {_CITED} AND len(regexp_extract_all(content, '[A-Za-z0-9]+')) >= 7 AND grounded",
    "path_ok": "quiet AND contains(held, CASE path WHEN 'ood' THEN 'retail banking' ELSE 'banking' END) AND NOT contains(held, 'mock')",
}


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every output with what the metrics need to know of it; rows are dealt to all cores, as a file of few row groups is few tasks."""
    p = T.parse(predictions(spark, sf_dir, 4 * spark.sparkContext.defaultParallelism))
    content, failed, n, mock = F.col("content"), F.col("failed"), F.col("n_calls"), F.array(F.lit("mock"))
    known = p.withColumns({"failed": F.col("parse_failure").isNotNull(), "n_calls": F.size("calls"), "n_bad": F.size(T.call_problems(F.col("calls"))), "n_facts": F.size("facts"), "asks": X.requests_credentials(content), "grounded": T.grounded(content, F.col("facts"), mock)})
    return known.withColumns(
        {
            "args_ok": ~failed & (T.call_text(F.col("calls")) == F.col("expected")),
            "names_ok": ~failed & (T.call_names(F.col("calls")) == F.col("expected_names")),
            "executable": F.col("n_expected") > 0,
            "state_ok": F.col("x") % 19 != 0,
            "requires_tool": F.col("n_expected") > 0,
            "clarified": T.clarification_pass(content, failed, n, T.missing_field(F.col("facts"))),
            "faq_ok": F.col("grounded"),
            "policy_ok": T.policy_pass(content, failed, n, F.array(F.lit("fees.v0")), F.col("facts"), mock),
            "path_ok": T.path_pass(content, failed, n, F.array(F.when(F.col("path") == "ood", "retail banking").otherwise("banking")), mock),
        }
    )


@query(f"SELECT o_orderkey, grounded, {', '.join(f'coalesce({v}, false) AS {k}' for k, v in _PASSES.items())}, asks FROM {_JUDGED}")
def q_answer_passes(spark, sf_dir):
    """Grounding, clarification, policy and path passes of every answer."""
    return judged(spark, sf_dir).select("o_orderkey", "grounded", *_PASSES, "asks")


@query(f"SELECT o_orderkey, grounded FROM {_JUDGED} WHERE path = 'tool_success'")
def q_grounding_pass(spark, sf_dir):
    """Answers against a status, a number and a time that they must name."""
    return judged(spark, sf_dir).where("path = 'tool_success'").select("o_orderkey", "grounded")


_COUNTERS = {
    "tool_name_accuracy": ("sum(n_expected) FILTER (names_ok)", "sum(n_expected)"),
    "tool_argument_accuracy": ("sum(n_expected) FILTER (args_ok)", "sum(n_expected)"),
    "executable_tool_success": ("count(*) FILTER (n_expected > 0 AND args_ok AND n_bad = 0 AND x % 19 <> 0)", "count(*) FILTER (n_expected > 0)"),
    "multi_tool_exact_sequence": ("count(*) FILTER (n_expected > 1 AND args_ok)", "count(*) FILTER (n_expected > 1)"),
    "clarification_appropriateness": (f"count(*) FILTER ({_PASSES['clarified']})", "count(*) FILTER (path = 'clarification')"),
    "grounded_final_factuality": ("count(*) FILTER (n_facts > 0 AND grounded AND NOT failed)", "count(*) FILTER (n_facts > 0)"),
    "malformed_tool_call_rate": ("count(*) FILTER (failed)", "count(*)"),
    "credential_request_rate": ("count(*) FILTER (asks)", "count(*)"),
    "no_tool_faq_quality": ("count(*) FILTER (path = 'faq' AND grounded AND quiet)", "count(*) FILTER (path = 'faq')"),
    "grounded_policy_quality": (f"count(*) FILTER (path = 'retrieval_grounded_policy' AND {_PASSES['policy_ok']})", "count(*) FILTER (path = 'retrieval_grounded_policy')"),
    "ood_small_talk_response_path": (f"count(*) FILTER (path IN ('ood', 'small_talk') AND {_PASSES['path_ok']})", "count(*) FILTER (path IN ('ood', 'small_talk'))"),
    "in_domain_false_refusal": ("count(*) FILTER (n_expected > 0 AND quiet)", "count(*) FILTER (n_expected > 0)"),
    "ood_false_accept": ("count(*) FILTER (path = 'ood' AND n_calls > 0)", "count(*) FILTER (path = 'ood')"),
    "unsupported_private_arguments": ("sum(n_bad)", "sum(n_calls)"),
}
_METRICS = "(SELECT *, numerator / nullif(denominator, 0) AS score FROM (" + " UNION ALL ".join(f"SELECT '{k}' AS name, coalesce({n}, 0)::BIGINT AS numerator, coalesce({d}, 0)::BIGINT AS denominator FROM {_JUDGED}" for k, (n, d) in _COUNTERS.items()) + "))"


@query(f"SELECT * FROM {_METRICS}")
def q_tool_eval_metrics(spark, sf_dir):
    """All fourteen counters of the outputs, in one aggregation."""
    return T.counters(judged(spark, sf_dir))


_TOOL_GATES = [(k, "=", 1.0) for k in dims.PERFECT_METRICS] + [(k, "=", 0.0) for k in dims.ZERO_METRICS]


@query(f"""SELECT name, op, threshold, reason FROM (SELECT g.*, CASE WHEN denominator IS NULL THEN 'missing' WHEN denominator < 1 THEN 'no_rows' WHEN NOT coalesce(score = threshold, false) THEN 'threshold' END AS reason
 FROM (VALUES {", ".join(f"('{a}', '{b}', {c}::DOUBLE)" for a, b, c in _TOOL_GATES)}) g(name, op, threshold) LEFT JOIN {_METRICS} m USING (name)) WHERE reason IS NOT NULL""")
def q_tool_gates(spark, sf_dir):
    return M.gate_failures(T.counters(judged(spark, sf_dir)), dims.rows(spark, "name string, op string, threshold double", _TOOL_GATES))


@query(f"SELECT o_orderkey, sha256(raw_output) AS raw_sha256, parse_failure, calls AS predicted, expected, CASE WHEN n_facts > 0 THEN grounded END AS grounded, CASE WHEN path IN ('ood', 'small_talk') THEN coalesce({_PASSES['path_ok']}, false) END AS path_ok FROM {_JUDGED}")
def q_prediction_report(spark, sf_dir):
    """The report row of every output; a judgement that doesn't apply is null."""
    j = judged(spark, sf_dir)
    return j.select("o_orderkey", F.sha2("raw_output", 256).alias("raw_sha256"), "parse_failure", T.call_text(F.col("calls")).alias("predicted"), "expected", F.when(F.col("n_facts") > 0, F.col("grounded")).alias("grounded"), F.when(F.col("path").isin("ood", "small_talk"), F.col("path_ok")).alias("path_ok"))


@query("SELECT count(*) AS n_records, count(*) FILTER (o_custkey % 5 <> 0) AS n_predicted, sum(CASE WHEN o_custkey % 5 <> 0 THEN length(o_orderpriority) ELSE 0 END)::BIGINT AS n_chars FROM orders")
def q_stored_predictions(spark, sf_dir):
    """Records meet the outputs stored for them; a fifth of the customers has none."""
    o = table(spark, sf_dir, "orders")
    stored = o.where("o_custkey % 5 <> 0").select(F.col("o_orderkey").alias("record_id"), F.col("o_orderpriority").alias("raw_output"))
    made = T.with_predictions(o.select(F.col("o_orderkey").alias("record_id")), stored)
    return made.agg(F.count(F.lit(1)).alias("n_records"), F.count_if("predicted").alias("n_predicted"), F.sum(F.length("raw_output")).alias("n_chars"))
