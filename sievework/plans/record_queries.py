"""Queries over supervised records made from orders: by number sound, or broken in one way."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.functions import text as X
from sievework.operators import bank as B
from sievework.operators import records as S
from sievework.plans import dims
from sievework.plans.registry import norm_ascii, query
from sievework.sources.readers import table

_KIND = 9


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``record_id, n, last4, messages``; ``n`` says what is wrong: 0 and 8 nothing."""
    o = table(spark, sf_dir, "orders")
    n, four, k = F.col("o_orderkey") % _KIND, F.lpad((F.col("o_custkey") % 10000).cast("string"), 4, "0"), F.col("o_orderkey").cast("string")
    text = lambda v: F.lit(v).cast("string")
    none = F.lit(None).cast("map<string,string>")

    def message(role, content, loss, call_id=text(None), tool=text(None), arguments=none):
        return F.struct(F.lit(role).alias("role"), content.alias("content"), loss.alias("loss"), call_id.alias("call_id"), tool.alias("tool"), arguments.alias("arguments"))

    call = message("assistant", F.lit("Working on it."), n != 8, F.concat(F.lit("c"), k), F.when(n == 7, "erase_card").otherwise("freeze_card"), F.create_map(F.lit("last4"), four))
    result = message("tool", F.lit('{"ok": true}'), F.lit(False), F.concat(F.when(n == 2, "x").otherwise("c"), k))
    head = F.array(message("system", F.lit("Help the customer."), F.lit(False)), message("user", F.concat(F.lit("Freeze card "), four), n == 5))
    final = message("assistant", F.concat(F.when(n == 4, "Demo: ").otherwise(""), F.lit("Card "), four, F.lit(" is frozen.")), F.lit(True))
    blank = message("assistant", F.lit(" "), F.lit(True))
    messages = F.when(n == 1, F.concat(head, F.array(final))).when(n == 3, F.concat(head, F.array(call, result, blank))).when(n == 6, F.concat(head, F.array(call, result, call, result))).otherwise(F.concat(head, F.array(call, result, final)))
    return o.select(k.alias("record_id"), n.alias("n"), four.alias("last4"), messages.cast(S.MESSAGES).alias("messages"))


_M = "{{'role': {0}, 'content': {1}, 'loss': {2}, 'call_id': {3}, 'tool': {4}}}".format
_CALL = _M("'assistant'", "'Working on it.'", "n <> 8", "'c' || record_id", "CASE WHEN n = 7 THEN 'erase_card' ELSE 'freeze_card' END")
_RESULT = _M("'tool'", "'{\"ok\": true}'", "false", "CASE WHEN n = 2 THEN 'x' ELSE 'c' END || record_id", "NULL::VARCHAR")
_HEAD = _M("'system'", "'Help the customer.'", "false", "NULL::VARCHAR", "NULL::VARCHAR") + ", " + _M("'user'", "'Freeze card ' || last4", "n = 5", "NULL::VARCHAR", "NULL::VARCHAR")
_FINAL = _M("'assistant'", "CASE WHEN n = 4 THEN 'Demo: ' ELSE '' END || 'Card ' || last4 || ' is frozen.'", "true", "NULL::VARCHAR", "NULL::VARCHAR")
_BLANK = _M("'assistant'", "' '", "true", "NULL::VARCHAR", "NULL::VARCHAR")
_RECORDS = f"""(SELECT *, CASE WHEN n = 1 THEN [{_HEAD}, {_FINAL}] WHEN n = 3 THEN [{_HEAD}, {_CALL}, {_RESULT}, {_BLANK}] WHEN n = 6 THEN [{_HEAD}, {_CALL}, {_RESULT}, {_CALL}, {_RESULT}] ELSE [{_HEAD}, {_CALL}, {_RESULT}, {_FINAL}] END AS m
 FROM (SELECT o_orderkey::VARCHAR AS record_id, o_orderkey % 9 AS n, lpad((o_custkey % 10000)::VARCHAR, 4, '0') AS last4 FROM orders))"""
_LINE = "concat_ws('|', x.role, coalesce(x.content, ''), coalesce(x.call_id, ''), coalesce(x.tool, ''))"
_LAST = "coalesce(list_max(list_filter(list_transform(range(1, len(m) + 1), lambda i: CASE WHEN m[i].role = '{0}' AND m[i].tool IS NULL THEN i END), lambda i: i IS NOT NULL)), 0)".format
_PLAIN = norm_ascii("coalesce(m[-1].content, '')")
_TERMS = "['demo', 'synthetic', 'mock', 'test', 'backend', 'gpu', 'router', 'tool call']"


@query(f"""SELECT record_id, unnest(list_filter([CASE WHEN m[-1].role <> 'assistant' OR m[-1].tool IS NOT NULL THEN 'final_not_assistant' END, CASE WHEN m[-1].role = 'assistant' AND {_PLAIN} = '' THEN 'final_blank' END,
 CASE WHEN len(list_filter({_TERMS}, lambda t: contains({_PLAIN}, t))) > 0 THEN 'final_forbidden_term' END,
 CASE WHEN len(list_filter(range(1, len(m) + 1), lambda i: m[i].tool IS NOT NULL AND NOT (coalesce(m[i + 1].role = 'tool', false) AND coalesce(m[i + 1].call_id = m[i].call_id, false)))) > 0 THEN 'call_without_result' END,
 CASE WHEN len(list_filter(range(1, len(m) + 1), lambda i: m[i].role = 'tool' AND NOT coalesce(m[i - 1].call_id = m[i].call_id, false))) > 0 THEN 'result_without_call' END,
 CASE WHEN len(list_distinct(list_transform(list_filter(m, lambda x: x.tool IS NOT NULL), lambda x: x.call_id))) < len(list_filter(m, lambda x: x.tool IS NOT NULL)) THEN 'repeated_call_id' END,
 CASE WHEN len(list_filter(m, lambda x: x.loss AND x.role <> 'assistant')) > 0 THEN 'loss_outside_assistant' END,
 CASE WHEN len(list_filter(m, lambda x: x.tool = 'erase_card')) > 0 THEN 'unknown_tool' END], lambda r: r IS NOT NULL)) AS rule FROM {_RECORDS}""")
def q_violations_records(spark, sf_dir):
    return S.violations(records(spark, sf_dir))


@query(f"SELECT record_id, len(m[1:coalesce(list_position(list_transform(m, lambda x: x.tool IS NOT NULL), true), len(m) + 1) - 1]) AS n_before, len(list_filter(m, lambda x: x.role = 'tool' AND list_contains(list_transform(list_filter(m, lambda c: c.tool IS NOT NULL AND c.loss), lambda c: c.call_id), x.call_id))) AS n_results FROM {_RECORDS}")
def q_target_calls(spark, sf_dir):
    m = F.col("messages")
    return records(spark, sf_dir).select("record_id", F.size(S.before_first_call(m)).cast("bigint").alias("n_before"), F.size(S.supervised_results(m)).cast("bigint").alias("n_results"))


@query(f"""SELECT record_id, sha256(concat_ws(chr(10), array_to_string(list_transform(list_filter(range(1, len(m) + 1), lambda i: i <> u AND i <> a), lambda i: concat_ws('|', m[i].role, coalesce(m[i].content, ''), coalesce(m[i].call_id, ''), coalesce(m[i].tool, ''))), chr(10)), last4)) AS immutable,
 sha256(array_to_string(list_transform(range(1, len(m) + 1), lambda i: CASE WHEN i = u THEN 'user|*||' ELSE concat_ws('|', m[i].role, coalesce(m[i].content, ''), coalesce(m[i].call_id, ''), coalesce(m[i].tool, '')) END), chr(10))) AS semantic
 FROM (SELECT *, {_LAST('user')} AS u, {_LAST('assistant')} AS a FROM {_RECORDS})""")
def q_record_digests(spark, sf_dir):
    m = F.col("messages")
    return records(spark, sf_dir).select("record_id", S.immutable_digest(m, F.col("last4")).alias("immutable"), S.semantic_digest(m).alias("semantic"))


@query(f"""SELECT record_id, len(t) AS n_tokens, len(list_filter(t, lambda x: x)) AS n_trained, coalesce(array_to_string(list_transform(list_filter(range(1, len(t) + 1), lambda i: t[i]), lambda i: i - 1), ','), '') AS positions
 FROM (SELECT record_id, flatten(list_transform(m, lambda x: list_transform(list_filter(string_split_regex(coalesce(x.content, ''), '\\s+'), lambda w: w <> ''), lambda w: x.loss))) AS t FROM {_RECORDS})""")
def q_loss_labels(spark, sf_dir):
    labels = records(spark, sf_dir).select("record_id", S.token_labels(F.col("messages")).alias("y"))
    on = F.filter("y", lambda v: v != S.IGNORED)
    return labels.select("record_id", F.size("y").cast("bigint").alias("n_tokens"), F.size(on).cast("bigint").alias("n_trained"), F.array_join(on.cast("array<string>"), ",").alias("positions"))


def _calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    n = F.col("p_partkey") % 8
    m = lambda *kv: F.create_map(*(x if not isinstance(x, str) else F.lit(x) for x in kv))
    size = F.col("p_partkey").cast("string")
    args = (
        F.when(n == 0, m("limit", size)).when(n == 1, m("limit", "many")).when(n == 2, m("last4", F.substring(F.concat(F.lit("000"), size), -4, 4)))
        .when(n == 3, m("last4", "12")).when(n == 4, m("card_id", "9", "case_id", "7")).when(n == 5, m("recipient", " ")).when(n == 6, m("recipient", "Club", "note", "x")).otherwise(m("k", "v"))
    )
    tool = F.when(n <= 1, "list_transactions").when(n <= 4, "freeze_card").when(n <= 6, "cancel_transfer").otherwise("list_cards")
    return p.select("p_partkey", tool.alias("tool"), args.alias("arguments"))


@query("""SELECT p_partkey, CASE WHEN n <= 1 THEN 'list_transactions' WHEN n <= 4 THEN 'freeze_card' WHEN n <= 6 THEN 'cancel_transfer' ELSE 'list_cards' END AS tool,
 CASE n WHEN 0 THEN 'bounds:limit' WHEN 1 THEN 'type:limit' WHEN 3 THEN 'bounds:last4' WHEN 4 THEN 'missing:last4,unknown:card_id,unknown:case_id' WHEN 5 THEN 'bounds:recipient' WHEN 6 THEN 'unknown:note' ELSE 'unknown:k' END AS errors
 FROM (SELECT p_partkey, p_partkey % 8 AS n FROM part) WHERE n <> 2 AND NOT (n = 0 AND p_partkey BETWEEN 1 AND 20)""")
def q_argument_errors(spark, sf_dir):
    return S.argument_errors(_calls(spark, sf_dir), "p_partkey")


@query("""SELECT p_partkey, CASE n WHEN 4 THEN 'case_id' WHEN 0 THEN 'limit' WHEN 1 THEN 'limit' WHEN 2 THEN 'last4' WHEN 3 THEN 'last4' WHEN 5 THEN 'recipient' WHEN 6 THEN 'note,recipient' ELSE 'k' END AS kept FROM (SELECT p_partkey, p_partkey % 8 AS n FROM part)""")
def q_private_ids(spark, sf_dir):
    return _calls(spark, sf_dir).select("p_partkey", F.array_join(F.array_sort(F.map_keys(S.strip_private(F.col("arguments")))), ",").alias("kept"))


@query(f"""SELECT u.record_id, array_to_string(list_filter([CASE WHEN m IS NULL THEN 'unknown_record' END, CASE WHEN trim(transcript) = '' THEN 'blank_transcript' END, CASE WHEN NOT (start_ms >= 0 AND start_ms < end_ms) THEN 'interval' END,
 CASE WHEN NOT (confidence BETWEEN 0.0 AND 1.0) THEN 'confidence' END, CASE WHEN NOT reviewed THEN 'not_reviewed' END], lambda x: x IS NOT NULL), ',') AS broken, CASE WHEN m IS NOT NULL AND transcript <> ' ' AND start_ms >= 0 AND start_ms < end_ms AND confidence <= 1.0 AND reviewed THEN transcript END AS last_user
 FROM (SELECT (event_id * 3)::VARCHAR AS record_id, CASE WHEN event_id % 5 = 0 THEN ' ' ELSE 'said ' || event_id END AS transcript, event_id % 7 * 100 - 100 AS start_ms, user_id * 3 AS end_ms, event_id % 11 / 9.5 AS confidence, event_id % 2 = 0 AS reviewed FROM events) u LEFT JOIN {_RECORDS} r USING (record_id)""")
def q_transcript_overlay(spark, sf_dir):
    i = F.col("event_id")
    said = table(spark, sf_dir, "events").select((i * 3).cast("string").alias("record_id"), F.when(i % 5 == 0, " ").otherwise(F.concat(F.lit("said "), i.cast("string"))).alias("transcript"), (i % 7 * 100 - 100).alias("start_ms"), (F.col("user_id") * 3).alias("end_ms"), (i % 11 / 9.5).alias("confidence"), (i % 2 == 0).alias("reviewed"))
    out = S.overlay_transcripts(said, records(spark, sf_dir))
    return out.select("record_id", "broken", F.get("overlaid", S.last_of(F.col("overlaid"), "user") - 1)["content"].alias("last_user"))


_PLAN = "SELECT l_orderkey, l_linenumber AS line_no, l_partkey, l_suppkey, l_extendedprice, CASE l_returnflag WHEN 'A' THEN 'freeze_card' WHEN 'R' THEN 'replace_card' ELSE 'list_cards' END AS tool, CASE WHEN l_suppkey % 9 = 8 THEN NULL ELSE (l_suppkey % 4)::VARCHAR END AS four FROM lineitem"
_STEP = "CASE WHEN c.tool <> 'list_cards' AND i = hit THEN CASE c.tool WHEN 'freeze_card' THEN 'frozen' ELSE 'replacement_pending' END ELSE cards[i] END"
_HIT = "list_filter([1, 2, 3], lambda i: cards[i] IN ('active', 'frozen') AND (c.four IS NULL OR (i - 1)::VARCHAR = c.four))[1]"


@query(f"""WITH RECURSIVE c AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY line_no, l_partkey, l_suppkey, l_extendedprice) AS i FROM ({_PLAN})),
 s AS (SELECT o_orderkey AS k, 0::BIGINT AS n, ['active', CASE WHEN o_custkey % 2 = 0 THEN 'active' ELSE 'closed' END, CASE WHEN o_custkey % 3 = 0 THEN 'frozen' ELSE 'closed' END] AS cards, '' AS oks FROM orders
  UNION ALL SELECT k, n + 1, list_transform([1, 2, 3], lambda i: {_STEP}), oks || CASE WHEN tool <> 'list_cards' AND hit IS NOT NULL THEN 'T' ELSE 'F' END FROM (SELECT s.*, c.tool, c.four, {_HIT} AS hit FROM s JOIN c ON c.l_orderkey = s.k AND c.i = s.n + 1) c)
 SELECT k::VARCHAR AS record_id, array_to_string(arg_max(cards, n), ';') AS cards, arg_max(oks, n) AS ok FROM s GROUP BY k""")
def q_state_replay(spark, sf_dir):
    """An order's lines as calls on its customer's three cards: by number, or without one on the first that is open."""
    k = F.col("o_custkey")
    card = lambda four, status: F.struct(F.lit(four).alias("last4"), status.alias("status"))
    cards = F.array(card("0", F.lit("active")), card("1", F.when(k % 2 == 0, "active").otherwise("closed")), card("2", F.when(k % 3 == 0, "frozen").otherwise("closed")))
    tool = F.when(F.col("l_returnflag") == "A", "freeze_card").when(F.col("l_returnflag") == "R", "replace_card").otherwise("list_cards")
    call = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", tool.alias("tool"), F.when(F.col("l_suppkey") % 9 != 8, (F.col("l_suppkey") % 4).cast("string")).alias("last4"))
    plans = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(call)).alias("plan"))
    calls = F.transform(F.coalesce("plan", F.array().cast(plans.schema["plan"].dataType)), lambda c: F.struct(c["tool"].alias("tool"), c["last4"].alias("last4")))
    done = table(spark, sf_dir, "orders").join(plans, "o_orderkey", "left").select(F.col("o_orderkey").cast("string").alias("record_id"), S.replay(cards, calls).alias("r"))
    return done.select("record_id", F.array_join(F.transform("r.cards", lambda c: c["status"]), ";").alias("cards"), F.array_join(F.transform("r.ok", lambda b: F.when(b, "T").otherwise("F")), "").alias("ok"))


@query("""WITH p AS (SELECT l_orderkey, row_number() OVER w AS i, l_quantity::BIGINT % 3 AS calls, l_linestatus = 'F' AND l_quantity::BIGINT % 10 = 9 AS bad, l_returnflag <> 'R' AS matched FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity)),
 s AS (SELECT *, sum(calls) OVER (PARTITION BY l_orderkey ORDER BY i) AS total FROM p), e AS (SELECT *, CASE WHEN bad THEN 'parse_error' WHEN calls = 0 THEN 'final_answer' WHEN total > 3 THEN 'max_tool_calls' WHEN NOT matched THEN 'unmatched_tool_call' END AS why FROM s)
 SELECT l_orderkey, coalesce(arg_min(why, i) FILTER (why IS NOT NULL), 'max_tool_passes') AS stop_reason FROM e GROUP BY l_orderkey""")
def q_trajectory_stops(spark, sf_dir):
    item = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_linestatus", "l_returnflag")
    q = lambda x: x["l_quantity"].cast("bigint")
    passes = F.transform(F.array_sort(F.collect_list(item)), lambda x: F.struct((q(x) % 3).cast("int").alias("calls"), ((x["l_linestatus"] == "F") & (q(x) % 10 == 9)).alias("parse_error"), (x["l_returnflag"] != "R").alias("matched")))
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(passes.alias("p")).select("l_orderkey", S.stop_reason(F.col("p")).alias("stop_reason"))


# A fee in one of six written forms, for an answer and for its evidence, which may be another fee; both engines read this text.
_WORD = f"element_at({list(X.NUMBER_WORDS)}, CAST({{n}} % 20 + 1 AS INT))"
_FORM = "CASE {{f}} WHEN 0 THEN concat({n}, ',250') WHEN 1 THEN concat({n}, '250.00') WHEN 2 THEN concat('$', {n}, ',250.50') WHEN 3 THEN concat({n}, '.50%') WHEN 4 THEN {word} ELSE concat('0', {n} % 20) END"
_REPLY = "concat('The fee of ', p_name, ' is ', {form}, CASE WHEN p_partkey % 4 = 0 THEN ' .' ELSE concat(' for now, [policy:  fee.v', p_partkey % 3, ' ]') END, CASE WHEN p_partkey % 7 = 0 THEN ' [Policy: fee.v1]' ELSE '' END, CASE WHEN p_size % 11 = 0 THEN ' says the Router' ELSE '' END)"
_EVIDENCE = "concat('A fee of ', {form}, ' or ', {other}, ' applies to ', p_type)"


def _form(engine: str, n: str, f: str) -> str:
    word = _WORD.format(n=n).replace("['", "array('").replace("'], CAST", "'), CAST") if engine == "spark" else f"({list(X.NUMBER_WORDS)})[CAST({n} % 20 + 1 AS INT)]"
    return _FORM.format(n=n, word=word).format(f=f)


def _policy_texts(engine: str) -> tuple[str, str]:
    reply = _REPLY.format(form=_form(engine, "p_size", "p_partkey % 6"))
    return reply, _EVIDENCE.format(form=_form(engine, "p_size", "(p_partkey + p_size) % 6"), other=_form(engine, "(p_size + p_partkey % 2)", "p_size % 6"))


_ANSWER_SQL, _EVIDENCE_SQL = _policy_texts("duckdb")
_CITED = r"list_distinct(regexp_extract_all(a, '(?i)\[Policy:\s*([^\]]+?)\s*\]', 1))"
_NUMBERS = "list_transform(list_filter(list_transform(string_split_regex({0}, '[^\\w.$%,]+'), lambda x: trim(x, ',')), lambda x: regexp_full_match(x, '\\$?(\\d{{1,3}}(,\\d{{3}})+|\\d+)(\\.\\d+)?%?')), lambda x: regexp_replace(regexp_replace(regexp_replace(replace(x, ',', ''), '(\\.\\d*?)0+(%?)$', '\\1\\2'), '\\.(%?)$', '\\1'), '^(\\$?)0+(\\d)', '\\1\\2'))".format
_SPELLED = (f"list_transform(regexp_extract_all(lower({{0}}), '\\b(?:{'|'.join(X.NUMBER_WORDS)})\\b'), lambda w: " + "CASE w " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in X.NUMBER_WORDS.items()) + " END)").format
_SAID = r"regexp_replace(a, '(?i)\[Policy:\s*([^\]]+?)\s*\]', '', 'g')"
_INTERNAL = ", ".join(f"CASE WHEN regexp_matches(a, '{p}') THEN 'internal_{k}' END" for k, p in X.INTERNAL_LANGUAGE.items())


@query(f"""SELECT p_partkey, array_to_string(list_filter([{_INTERNAL}, CASE WHEN len({_CITED}) = 0 THEN 'no_citation' END, CASE WHEN len(list_filter({_CITED}, lambda c: c NOT IN ('fee.v0', 'fee.v1'))) > 0 THEN 'citation_not_allowed' END,
 CASE WHEN len({_CITED}) > 0 AND NOT list_has_any({_CITED}, ['fee.v0', 'fee.v1']) THEN 'nothing_returned_cited' END,
 CASE WHEN len(list_filter(list_concat({_NUMBERS(_SAID)}, {_SPELLED(_SAID)}), lambda n: NOT list_contains(list_concat({_NUMBERS("e")}, {_SPELLED("e")}), n))) > 0 THEN 'number_without_evidence' END], lambda x: x IS NOT NULL), ',') AS errors FROM (SELECT p_partkey, {_ANSWER_SQL} AS a, {_EVIDENCE_SQL} AS e FROM part)""")
def q_policy_answers(spark, sf_dir):
    """Answers about parts with fees in six written forms, and citations, against what the evidence says in its own forms."""
    answer, evidence = _policy_texts("spark")
    errors = S.policy_answer_errors(F.expr(answer), F.array(F.lit("fee.v0"), F.lit("fee.v1")), F.expr(evidence))
    # A small file is one task, and a row costs some 0.2 ms: rows are dealt to all cores first.
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size", "p_type").repartition(4 * spark.sparkContext.defaultParallelism)
    return parts.select("p_partkey", F.array_join(errors, ",").alias("errors"))


_SCENES = ("freeze", "replace", "dispute", "cancel", "list")


@query(f"""SELECT i AS scenario_no, {list(_SCENES)}[i % 5 + 1] AS scene, ('0x' || substr(sha256('711:' || i), 1, 12))::BIGINT % 4 AS slot, r AS request, c AS context, {list(_SCENES)}[i % 5 + 1] || '-' || i || '-' || r || '-' || c AS record_id
 FROM (SELECT unnest(range((SELECT count(*) FROM customer))) AS i), (SELECT unnest(range(2)) AS r), (SELECT unnest(range(4)) AS c)""")
def q_scenario_expansion(spark, sf_dir):
    """Scenario slots by hash, each spread over 2 requests and 4 contexts."""
    from sievework.functions.text import stable_int

    base = spark.range(table(spark, sf_dir, "customer").count()).withColumnRenamed("id", "scenario_no")
    i = F.col("scenario_no")
    grid = F.explode(F.array(*(F.struct(F.lit(r).cast("bigint").alias("request"), F.lit(c).cast("bigint").alias("context")) for r in range(2) for c in range(4)))).alias("g")
    scene = F.element_at(F.array(*map(F.lit, _SCENES)), (i % 5 + 1).cast("int"))
    made = base.select("scenario_no", scene.alias("scene"), F.pmod(stable_int(F.concat(F.lit("711:"), i.cast("string"))), F.lit(4)).alias("slot"), grid).select("*", "g.*").drop("g")
    return made.withColumn("record_id", F.concat_ws("-", "scene", i.cast("string"), F.col("request").cast("string"), F.col("context").cast("string")))


@query("SELECT event_id, CASE WHEN bad_intent THEN 'unknown_intent' WHEN lane_off THEN 'lane_mismatch' END AS rule FROM (SELECT event_id, event_id % 14 >= 12 AS bad_intent, event_id % 14 < 12 AND event_id % 5 <> CASE WHEN event_id % 14 < 9 THEN 1 WHEN event_id % 14 = 9 THEN 2 WHEN event_id % 14 = 10 THEN 3 ELSE 4 END AS lane_off FROM events) WHERE bad_intent OR lane_off")
def q_violations_hierarchy(spark, sf_dir):
    """Labels whose intent is unknown or whose lane isn't that of the intent."""
    rows = table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 14).cast("int").alias("intent_index"), (F.col("event_id") % 5).cast("int").alias("lane_index"))
    known = dims.intents(spark).select("intent_index", F.array_position(F.array(*map(F.lit, dims.LANES)), F.col("lane")).alias("lane"))
    joined = rows.join(F.broadcast(known), "intent_index", "left")
    rule = F.when(F.col("lane").isNull(), "unknown_intent").when(F.col("lane") - 1 != F.col("lane_index"), "lane_mismatch")
    return joined.withColumn("rule", rule).where("rule IS NOT NULL").select("event_id", "rule")


@query("SELECT o_custkey, count(*) AS n, count(*) FILTER (s = 'ok') AS n_ok FROM (SELECT o_custkey, CASE WHEN o_orderstatus IN ('O', 'P') THEN 'ok' ELSE 'closed' END AS s FROM orders) GROUP BY o_custkey")
def q_bundle_read(spark, sf_dir):
    """One consistent read of a customer's rows with their states."""
    rows = table(spark, sf_dir, "orders").select("o_custkey", F.when(F.col("o_orderstatus").isin("O", "P"), "ok").otherwise("closed").alias("s"))
    return rows.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("s") == "ok").alias("n_ok"))


@query("SELECT user_id, arg_max(event_type, (value, -event_id)) AS best_type, max(value) AS best_value FROM events GROUP BY user_id")
def q_best_offender(spark, sf_dir):
    best = B.top_per_key(table(spark, sf_dir, "events"), "user_id", [F.desc("value"), F.col("event_id")], 1)
    return best.select("user_id", F.col("event_type").alias("best_type"), F.col("value").alias("best_value"))
