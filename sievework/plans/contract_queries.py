"""Queries over whole training records made from orders: what is wrong with one follows from its own numbers, several faults at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.operators import contracts as K
from sievework.plans import dims
from sievework.plans.registry import norm, query
from sievework.sources.readers import table

#: Scalars of a record as SQL that both engines evaluate; ``x`` mixes an order's values, and each fault has a prime of its own.
_COLUMNS = {
    "x": "CAST(o_orderkey * 7919 + o_custkey * 31 + CAST(floor(o_totalprice) AS BIGINT) AS BIGINT)",
    "rid": "CAST(o_orderkey AS {text})",
    "four": "lpad(CAST(o_custkey % 10000 AS {text}), 4, '0')",
    "path": "CASE WHEN x % 7 < 4 THEN 'tool_success' WHEN x % 7 = 4 THEN 'clarification' WHEN x % 7 = 5 THEN 'retrieval_grounded_policy' ELSE 'ood' END",
    "family": "CASE WHEN x % 3 = 0 THEN 'card_ambiguity' ELSE lower(o_orderpriority) END",
    "tool": "CASE WHEN x % 37 = 0 THEN 'erase_card' WHEN x % 2 = 0 THEN 'freeze_card' ELSE 'list_cards' END",
    "words": "CASE path WHEN 'tool_success' THEN 'The card that ends in ' || four || ' has been seen to as you asked' WHEN 'clarification' THEN CASE WHEN x % 5 = 0 THEN 'Which card is it?' ELSE 'Please tell me the last four digits of the card you mean' END WHEN 'ood' THEN CASE WHEN x % 5 = 0 THEN 'That is nothing that I can help you with here' ELSE 'I can only help with retail banking, order ' || rid END ELSE 'A fee of ' || four || ' cents applies to each transfer abroad [Policy: fees.v' || CAST(x % 3 AS {text}) || ']' END",
    "final": "CASE WHEN x % 13 = 0 THEN 'Demo: ' ELSE '' END || words",
    "call_id": "CASE WHEN x % 29 = 0 THEN 'c1' WHEN x % 47 = 0 THEN 'context_' || rid || '_0' ELSE 'call_' || rid || '_0' END",
    "back_id": "CASE WHEN x % 53 = 0 THEN 'other' ELSE call_id END",
    "prompt": "CASE WHEN x % 83 = 0 THEN 'You are a synthetic helper.' ELSE 'Help the customer. fees.v1' END",
    "asked": "CASE WHEN x % 19 = 0 THEN 'Freeze it' ELSE 'Freeze card ' || four || ' of order ' || rid END",
}


def _level(text: str) -> str:
    """The columns as nested SQL over ``orders``."""
    sql = "SELECT o_orderkey, o_custkey, o_totalprice, o_orderpriority FROM orders"
    for name, expression in _COLUMNS.items():
        sql = f"SELECT *, {expression.format(text=text)} AS {name} FROM ({sql})"
    return sql


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority")
    for name, expression in _COLUMNS.items():
        rows = rows.withColumn(name, F.expr(expression.format(text="STRING")))
    every = lambda k: F.col("x") % k == 0
    text, none = (lambda v: F.lit(v).cast("string")), F.lit(None)

    def message(role, content=text(None), loss=F.lit(False), call_id=text(None), index=none, tool=text(None), arguments=none, ok=none, parts=none):
        return F.struct(*(c.alias(n) for n, c in zip(("role", "content", "loss", "call_id", "index", "tool", "arguments", "ok", "parts"), (role, content, loss, call_id, index, tool, arguments, ok, parts), strict=True))).cast(K.MESSAGE)

    arguments = F.map_from_arrays(F.when(every(41), F.array(F.lit("last4"), F.lit("note"))).otherwise(F.array(F.lit("last4"))), F.when(every(41), F.array("four", "rid")).otherwise(F.array("four")))
    arguments = F.when(F.col("tool") == "list_cards", F.map_filter(arguments, lambda k, _: k != "last4")).otherwise(arguments)
    call = message(F.lit("assistant"), F.when(every(43), "One moment"), F.when(every(89), None).otherwise(~every(47)), F.col("call_id"), F.when(every(31), 1).otherwise(0), F.col("tool"), arguments)
    result = message(F.lit("tool"), text("{}"), every(59), F.col("back_id"), ok=F.when(every(61), None).otherwise(~every(3)), parts=F.when(every(67), F.array(F.lit("ok"))).when(every(3), F.array(F.lit("ok"), F.lit("error"))).otherwise(F.array(F.lit("result"), F.lit("ok"))))
    head = F.array(message(F.lit("system"), F.col("prompt")), message(F.lit("system"), F.when(every(11), "Context: none").otherwise(F.concat(F.lit("Context: fees.v"), (F.col("x") % 3).cast("string")))), message(F.when(every(79), "robot").otherwise("user"), F.col("asked"), every(73)))
    end = F.array(message(F.lit("assistant"), F.col("final"), ~every(17)))
    middle = F.when(F.col("path") != "tool_success", F.array().cast(f"array<{K.MESSAGE}>")).when(every(23), F.array(call, result, call, result)).otherwise(F.array(call, result))
    citations = F.when(F.col("path") == "retrieval_grounded_policy", F.when(every(5), F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("fees.v"), (F.col("x") % 4).cast("string")))))
    tools = F.when(F.col("path") != "tool_success", F.array().cast("array<string>")).when(every(23), F.array("tool", "tool")).otherwise(F.array(F.col("tool")))
    ordered = F.when((F.col("path") != "tool_success") | every(71), F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("call_"), "rid", F.lit("_0"))))
    return rows.select("rid", "x", "path", "family", "final", "asked", F.concat(head, middle, end).alias("messages"), citations.alias("citations"), tools.alias("tools"), ordered.alias("ordered"), ((F.col("path") == "tool_success") != every(97)).alias("requires_tool"))


_MSG = "{{'role': {role}, 'content': {content}, 'loss': {loss}, 'call_id': {call_id}, 'idx': {idx}, 'tool': {tool}, 'args': {args}, 'ok': {ok}, 'parts': {parts}}}"


def _msg(role: str, **more: str) -> str:
    given = {"content": "NULL::VARCHAR", "loss": "false", "call_id": "NULL::VARCHAR", "idx": "NULL::INTEGER", "tool": "NULL::VARCHAR", "args": "NULL::VARCHAR[]", "ok": "NULL::BOOLEAN", "parts": "NULL::VARCHAR[]"} | more
    return _MSG.format(role=role, **given)


_CALL = _msg("'assistant'", content="CASE WHEN x % 43 = 0 THEN 'One moment' END", loss="CASE WHEN x % 89 = 0 THEN NULL ELSE x % 47 <> 0 END", call_id="call_id", idx="CASE WHEN x % 31 = 0 THEN 1 ELSE 0 END", tool="tool", args="list_filter(CASE WHEN x % 41 = 0 THEN ['last4', 'note'] ELSE ['last4'] END, lambda a: a <> 'last4' OR tool <> 'list_cards')")
_RESULT = _msg("'tool'", content="'{}'", loss="x % 59 = 0", call_id="back_id", ok="CASE WHEN x % 61 = 0 THEN NULL ELSE x % 3 <> 0 END", parts="CASE WHEN x % 67 = 0 THEN ['ok'] WHEN x % 3 = 0 THEN ['error', 'ok'] ELSE ['ok', 'result'] END")
_HEAD = ", ".join((_msg("'system'", content="prompt"), _msg("'system'", content="CASE WHEN x % 11 = 0 THEN 'Context: none' ELSE 'Context: fees.v' || (x % 3) END"), _msg("CASE WHEN x % 79 = 0 THEN 'robot' ELSE 'user' END", content="asked", loss="x % 73 = 0")))
_END = _msg("'assistant'", content="final", loss="x % 17 <> 0")
_RECORDS = f"""(SELECT rid, x, path, family, final, asked, CASE WHEN path <> 'tool_success' THEN [{_HEAD}, {_END}] WHEN x % 23 = 0 THEN [{_HEAD}, {_CALL}, {_RESULT}, {_CALL}, {_RESULT}, {_END}] ELSE [{_HEAD}, {_CALL}, {_RESULT}, {_END}] END AS m,
 CASE WHEN path = 'retrieval_grounded_policy' THEN CASE WHEN x % 5 = 0 THEN []::VARCHAR[] ELSE ['fees.v' || (x % 4)] END END AS citations, CASE WHEN path <> 'tool_success' THEN []::VARCHAR[] WHEN x % 23 = 0 THEN [tool, tool] ELSE [tool] END AS tools,
 CASE WHEN path <> 'tool_success' OR x % 71 = 0 THEN []::VARCHAR[] ELSE ['call_' || rid || '_0'] END AS ordered, (path = 'tool_success') <> (x % 97 = 0) AS requires_tool FROM ({_level('VARCHAR')}))"""


def _fired(rules: dict[str, str]) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN coalesce({c}, false) THEN '{k}' END" for k, c in rules.items()) + "], lambda r: r IS NOT NULL)"


_ALL = "len(list_filter(range(1, len(m) + 1), lambda i: coalesce({0}, false))) > 0".format
_TARGETS = "list_transform(list_filter(m, lambda y: y.role = 'assistant' AND y.tool IS NOT NULL AND coalesce(y.loss, false)), lambda y: y.call_id)"
_CONTEXT = "list_transform(list_filter(m, lambda y: y.role = 'assistant' AND y.tool IS NOT NULL AND NOT coalesce(y.loss, false)), lambda y: y.call_id)"
_IDS = "list_transform(list_filter(m, lambda y: y.role = 'assistant' AND y.tool IS NOT NULL), lambda y: y.call_id)"
_MESSAGE_RULES = {
    "invalid_role": _ALL("m[i].role NOT IN ('system', 'user', 'assistant', 'tool')"),
    "call_with_content": _ALL("m[i].tool IS NOT NULL AND m[i].content IS NOT NULL"),
    "loss_label": _ALL("m[i].role = 'assistant' AND m[i].loss IS NULL"),
    "labelled_context": _ALL("m[i].role IN ('system', 'user') AND m[i].loss"),
    "labelled_result": _ALL("m[i].role = 'tool' AND m[i].loss"),
    "repeated_call_id": f"len(list_distinct({_IDS})) < len({_IDS})",
    "call_index": _ALL("m[i].tool IS NOT NULL AND m[i].idx <> 0"),
    "unstable_id": f"len(list_filter(range(1, len({_TARGETS}) + 1), lambda i: ({_TARGETS})[i] <> 'call_' || rid || '_' || (i - 1))) > 0",
    "unstable_context_id": f"len(list_filter(range(1, len({_CONTEXT}) + 1), lambda i: ({_CONTEXT})[i] <> 'context_' || rid || '_' || (i - 1))) > 0",
    "unknown_tool": _ALL("m[i].tool = 'erase_card'"),
    "extra_arguments": _ALL("m[i].tool IN ('freeze_card', 'list_cards') AND len(list_filter(m[i].args, lambda a: NOT (m[i].tool = 'freeze_card' AND a = 'last4'))) > 0"),
    "envelope": _ALL("m[i].role = 'tool' AND CASE WHEN coalesce(m[i].ok, false) THEN m[i].parts <> ['ok', 'result'] ELSE m[i].parts <> ['error', 'ok'] END"),
    "envelope_without_ok": _ALL("m[i].role = 'tool' AND m[i].ok IS NULL"),
    "result_correlation": "(" + _ALL("m[i].role = 'tool' AND m[i - 1].call_id <> m[i].call_id") + ")",
    "ordered_calls": f"{_TARGETS} <> ordered",
    "results_of_calls": f"list_transform(list_filter(range(2, len(m) + 1), lambda i: m[i].role = 'tool' AND m[i - 1].loss AND m[i - 1].call_id = m[i].call_id), lambda i: m[i].call_id) <> {_TARGETS}",
    "requires_tool": f"(len({_TARGETS}) > 0) <> requires_tool",
}


@query(f"SELECT rid, unnest({_fired(_MESSAGE_RULES)}) AS rule FROM {_RECORDS}")
def q_message_rules(spark, sf_dir):
    """All broken rules of the records' messages, one row each."""
    broken = K.message_violations(F.col("rid"), F.col("messages"), F.col("ordered"), F.col("requires_tool"))
    return records(spark, sf_dir).select("rid", F.explode(broken).alias("rule"))


_PLAIN, _TERMS = norm("final"), "['demo', 'synthetic', 'mock', 'test', 'backend', 'gpu', 'router', 'tool call']"
_ANSWER_RULES = {
    "final_short": f"len(list_filter(string_split({_PLAIN}, ' '), lambda w: w <> '')) < 7",
    "final_untrained": "x % 17 = 0",
    "final_internal_words": f"len(list_filter({_TERMS}, lambda t: contains({_PLAIN}, t))) > 0",
    "system_internal_words": f"len(list_filter(m, lambda y: y.role = 'system' AND len(list_filter({_TERMS}, lambda t: contains({norm('y.content')}, t))) > 0)) > 0",
    "path_marker": f"(path = 'clarification' AND NOT contains({_PLAIN}, 'last four digits')) OR (path = 'ood' AND NOT contains({_PLAIN}, 'retail banking'))",
    "no_citations": "path = 'retrieval_grounded_policy' AND len(coalesce(citations, [])) = 0",
    "citation_not_given": "path = 'retrieval_grounded_policy' AND len(list_filter(citations, lambda c: NOT contains(final, '[Policy: ' || c || ']'))) > 0",
    "citation_not_in_context": "path = 'retrieval_grounded_policy' AND len(list_filter(citations, lambda c: len(list_filter(m[2:], lambda y: y.role = 'system' AND contains(y.content, c))) = 0)) > 0",
}


@query(f"SELECT rid, unnest({_fired(_ANSWER_RULES)}) AS rule FROM {_RECORDS}")
def q_answer_rules(spark, sf_dir):
    return records(spark, sf_dir).select("rid", F.explode(K.answer_violations(F.col("messages"), F.col("path"), F.col("citations"))).alias("rule"))


@query(f"SELECT rid, 'repeated_user' AS rule FROM (SELECT rid, count(*) OVER (PARTITION BY {norm('asked')}) AS n FROM {_RECORDS}) WHERE n > 1 UNION ALL SELECT rid, 'repeated_final' FROM (SELECT rid, count(*) OVER (PARTITION BY {norm('final')}) AS n FROM {_RECORDS}) WHERE n > 1")
def q_repeated_texts(spark, sf_dir):
    from sievework.functions import text as X

    return K.repeats(records(spark, sf_dir), "rid", {"repeated_user": X.normalize(F.col("asked")), "repeated_final": X.normalize(F.col("final"))})


_DISTINCT_TOOLS = "CASE WHEN len(tools) = 0 THEN []::VARCHAR[] ELSE [tools[1]] END"
_MODE = "CASE WHEN len(tools) > 0 THEN 'execute_tool' WHEN path = 'clarification' THEN 'clarify' WHEN path = 'retrieval_grounded_policy' THEN 'retrieve_policy' WHEN path = 'ood' THEN 'refuse_ood' ELSE 'converse' END"
_STATE = "CASE WHEN len(tools) > 0 THEN CASE WHEN tools[1] = 'freeze_card' THEN 'resolved' ELSE 'not_required' END WHEN path = 'clarification' THEN CASE WHEN contains(family, 'ambigu') OR x % 6 = 1 THEN 'ambiguous' ELSE 'missing' END ELSE 'not_required' END"


def _contract():
    facts = F.when(F.col("x") % 6 == 1, F.array(F.lit("card=ambiguous"))).otherwise(F.array().cast("array<string>"))
    return K.generation_contract(F.col("path"), F.col("family"), facts, F.col("tools"))


@query(f"SELECT rid, {_MODE} AS mode, {_STATE} AS entity_state, array_to_string({_DISTINCT_TOOLS}, ',') AS tool_names FROM {_RECORDS}")
def q_generation_contract(spark, sf_dir):
    made = records(spark, sf_dir).withColumn("c", _contract())
    return made.select("rid", "c.mode", "c.entity_state", F.array_join("c.tool_names", ",").alias("tool_names"))


_STATED = f"""(SELECT *, CASE WHEN x % 10 = 3 THEN 'v1' ELSE '{K.CONTRACT_VERSION}' END AS c_version, CASE WHEN x % 9 = 4 THEN 'converse' WHEN x % 31 = 5 THEN 'guess' ELSE {_MODE} END AS c_mode, CASE WHEN x % 8 = 2 THEN 'ambiguous' WHEN x % 33 = 7 THEN 'gone' ELSE {_STATE} END AS c_state,
 CASE WHEN x % 12 = 5 THEN ['list_cards', 'freeze_card'] ELSE {_DISTINCT_TOOLS} END AS c_tools, {_DISTINCT_TOOLS} AS want FROM {_RECORDS})"""
_ONE = "(len(c_tools) = 1 AND c_tools = want)"
_CONTRACT_RULES = {
    "contract_version": f"c_version <> '{K.CONTRACT_VERSION}'",
    "contract_decision": f"c_mode NOT IN {K.MODES} OR c_state NOT IN {K.STATES}",
    "contract_tools": "list_contains(c_tools, 'erase_card')",
    "contract_one_tool": f"c_mode = 'execute_tool' AND NOT {_ONE}",
    "contract_state": f"c_mode = 'execute_tool' AND {_ONE} AND c_state <> CASE WHEN c_tools[1] = 'freeze_card' THEN 'resolved' ELSE 'not_required' END",
    "contract_no_tools": "c_mode <> 'execute_tool' AND (len(c_tools) > 0 OR len(want) > 0)",
    "contract_clarify": "c_mode = 'clarify' AND c_state NOT IN ('missing', 'ambiguous')",
    "contract_other_state": "c_mode NOT IN ('execute_tool', 'clarify') AND c_state <> 'not_required'",
}


@query(f"SELECT rid, unnest({_fired(_CONTRACT_RULES)}) AS rule FROM {_STATED}")
def q_contract_rules(spark, sf_dir):
    """Stated contracts with wrong versions, modes, states and tools against the calls that records expect."""
    x = F.col("x")
    made = records(spark, sf_dir).withColumn("c", _contract())
    stated = F.struct(
        F.when(x % 10 == 3, "v1").otherwise(F.col("c.version")).alias("version"),
        F.when(x % 9 == 4, "converse").when(x % 31 == 5, "guess").otherwise(F.col("c.mode")).alias("mode"),
        F.when(x % 8 == 2, "ambiguous").when(x % 33 == 7, "gone").otherwise(F.col("c.entity_state")).alias("entity_state"),
        F.when(x % 12 == 5, F.array(F.lit("list_cards"), F.lit("freeze_card"))).otherwise(F.col("c.tool_names")).alias("tool_names"),
    )
    return made.select("rid", F.explode(K.contract_violations(stated, F.col("tools"))).alias("rule"))


@query(f"""SELECT rid, len(m) + CASE WHEN x % 23 = 0 AND two THEN 1 ELSE 0 END AS n_messages, CASE WHEN two THEN 1 ELSE len({_TARGETS}) END AS n_trained, CASE WHEN two THEN 'call_' || rid || '_0' ELSE coalesce(({_TARGETS})[1], '') END AS trained, two AND len(m) > 0 AS aligned
 FROM (SELECT *, coalesce(path = 'tool_success' AND x % 23 = 0 AND x % 47 <> 0 AND x % 89 <> 0 AND x % 53 <> 0, false) AS two FROM (SELECT * REPLACE (list_transform(m, lambda y, i: struct_update(y, call_id := CASE WHEN i > 5 AND y.call_id IS NOT NULL THEN y.call_id || 'b' ELSE y.call_id END)) AS m) FROM {_RECORDS}))""")
def q_single_target(spark, sf_dir):
    """Records of two trained calls as one target; others as they are."""
    # The two calls of a record get ids of their own first.
    apart = F.transform("messages", lambda m, i: F.struct(*((F.when((i > 4) & m["call_id"].isNotNull(), F.concat(m["call_id"], F.lit("b"))).otherwise(m["call_id"]) if c == "call_id" else m[c]).alias(c) for c in ("role", "content", "loss", "call_id", "index", "tool", "arguments", "ok", "parts"))))
    rows = records(spark, sf_dir).withColumn("messages", apart)
    made = rows.withColumn("new", K.to_single_target(F.col("rid"), F.col("messages"), F.concat(F.lit("Go ahead with "), "rid")))
    ids = F.transform(F.filter("new", lambda m: K.is_call(m) & F.coalesce(m["loss"], F.lit(False))), lambda m: m["call_id"])
    return made.select("rid", F.size("new").cast("bigint").alias("n_messages"), F.size(ids).cast("bigint").alias("n_trained"), F.coalesce(F.get(ids, F.lit(0)), F.lit("")).alias("trained"), F.exists("new", lambda m: F.coalesce(F.startswith(m["content"], F.lit("Go ahead")), F.lit(False))).alias("aligned"))


@query(f"SELECT rid, CASE WHEN len(tools) > 0 AND len(list_filter(tools, lambda t: t NOT IN {dims.READ_TOOLS})) = 0 THEN 'read' ELSE 'answer' END AS policy, len(list_filter(m, lambda y: y.loss)) - CASE WHEN len(tools) > 0 AND len(list_filter(tools, lambda t: t NOT IN {dims.READ_TOOLS})) = 0 AND x % 17 <> 0 THEN 1 ELSE 0 END AS n_trained FROM {_RECORDS}")
def q_read_only_targets(spark, sf_dir):
    """Records whose calls only read train the call alone, not the answer."""
    read = K.is_read_only(F.col("tools"))
    made = records(spark, sf_dir).withColumn("new", K.unmask_last_answer(F.col("messages"), read))
    return made.select("rid", F.when(read, "read").otherwise("answer").alias("policy"), F.size(F.filter("new", lambda m: F.coalesce(m["loss"], F.lit(False)))).cast("bigint").alias("n_trained"))


_LABELLED = """(SELECT event_id, CASE WHEN event_id % 14 < 12 THEN ['view_accounts', 'view_cards', 'freeze_card', 'replace_card', 'view_transactions', 'dispute_transaction', 'view_transfers', 'cancel_transfer', 'view_service_cases', 'policy_knowledge', 'conversation', 'other_banking'][event_id % 14 + 1] WHEN event_id % 14 = 12 THEN 'sing' END AS intent,
 k, {domains}[k % 3 + 1] AS domain, {lanes}[(k + user_id) % 5 + 1] AS lane, {families}[(k * 7 + user_id) % 9 + 1] AS family, CASE WHEN k % 13 = 5 THEN 'wait' ELSE {actions}[k % 5 + 1] END AS action, {entities}[(k // 5) % 5 + 1] AS entity, CASE WHEN k % 4 = 0 THEN k % 3 END AS action_at, CASE k % 3 WHEN 0 THEN []::VARCHAR[] WHEN 1 THEN ['list_cards'] ELSE ['list_cards', 'freeze_card'] END AS tools
 FROM (SELECT *, (props::JSON ->> '$.k')::BIGINT AS k FROM events))""".format(**{n: list(getattr(dims, n.upper())) for n in ("domains", "lanes", "families", "actions", "entities")})


def _of(d: str, position: int) -> str:
    return "CASE intent " + " ".join(f"WHEN '{k}' THEN '{v[position]}'" for k, v in dims.INTENTS.items()) + f" ELSE '{getattr(dims, d)[0]}' END"


_KNOWN = f"(intent IS NULL OR intent IN {tuple(dims.INTENTS)})"
_COMPATIBLE = "CASE intent " + " ".join(f"WHEN '{k}' THEN {list(v[3])}::VARCHAR[]" for k, v in dims.INTENTS.items()) + " ELSE []::VARCHAR[] END"
_LABEL_RULES = {
    "unknown_intent": f"NOT {_KNOWN}",
    "domain_mismatch": f"{_KNOWN} AND domain <> {_of('DOMAINS', 0)}",
    "lane_mismatch": f"{_KNOWN} AND lane <> {_of('LANES', 1)}",
    "family_mismatch": f"{_KNOWN} AND family <> {_of('FAMILIES', 2)}",
    "unknown_action": f"action NOT IN {dims.ACTIONS}",
    "unknown_entity": f"entity NOT IN {dims.ENTITIES}",
    "action_index": f"action_at <> coalesce(list_position({list(dims.ACTIONS)}, action), 0) - 1",
    "refusal_in_domain": "action = 'refuse_ood' AND intent IS NOT NULL",
    "out_of_domain_decision": "intent IS NULL AND (action <> 'refuse_ood' OR entity <> 'not_required')",
    "policy_intent": "action = 'retrieve_policy' AND coalesce(intent <> 'policy_knowledge', true)",
    "clarify_state": "action = 'clarify' AND entity NOT IN ('missing', 'ambiguous')",
    "tool_lane": f"action = 'execute_tool' AND {_KNOWN} AND {_of('LANES', 1)} <> 'servicing'",
    "tool_state": "action = 'execute_tool' AND entity IN ('missing', 'ambiguous', 'ineligible')",
    "no_tools": "action = 'execute_tool' AND len(tools) = 0",
    "incompatible_tool": f"action = 'execute_tool' AND {_KNOWN} AND len(list_filter(tools, lambda t: NOT list_contains({_COMPATIBLE}, t))) > 0",
}


@query(f"SELECT event_id, unnest({_fired(_LABEL_RULES)}) AS rule FROM {_LABELLED}")
def q_label_rules(spark, sf_dir):
    """Labels in all five dimensions, told by each event's own values, under every rule of the hierarchy."""
    e = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("bigint"))
    i, k, u = F.col("event_id") % 14, F.col("k"), F.col("user_id")
    pick = lambda names, at: F.element_at(F.array(*map(F.lit, names)), (at + 1).cast("int"))
    intent = F.when(i < 12, F.get(F.array(*map(F.lit, dims.INTENTS)), i.cast("int"))).when(i == 12, "sing")
    labels = {"domain": pick(dims.DOMAINS, k % 3), "lane": pick(dims.LANES, (k + u) % 5), "family": pick(dims.FAMILIES, (k * 7 + u) % 9), "action": F.when(k % 13 == 5, "wait").otherwise(pick(dims.ACTIONS, k % 5)), "entity": pick(dims.ENTITIES, F.floor(k / 5) % 5)}
    nothing = F.lit(None).cast("int")
    indexes = {d: nothing for d in labels} | {"action": F.when(k % 4 == 0, k % 3).cast("int")}
    tools = F.when(k % 3 == 0, F.array().cast("array<string>")).when(k % 3 == 1, F.array(F.lit("list_cards"))).otherwise(F.array(F.lit("list_cards"), F.lit("freeze_card")))
    return e.select("event_id", F.explode(K.label_violations(intent, labels, indexes, tools)).alias("rule"))


_SPOKEN = """(SELECT event_id, (k - 3) / 90.0 AS confidence, CASE WHEN k % 5 = 0 THEN 'sha256:' || sha256(props) WHEN k % 5 = 1 THEN substr(sha256(props), 2) WHEN k % 5 = 2 THEN NULL ELSE sha256(props) END AS audio_sha256, CASE k % 4 WHEN 0 THEN 'agent' WHEN 1 THEN ' Customer ' WHEN 2 THEN 'CUSTOMER' ELSE NULL END AS speaker,
 k * 10 - 50 AS start_ms, user_id * 10 AS end_ms, CASE WHEN k % 6 = 0 THEN ' ' ELSE event_type END AS recording_id, CASE WHEN k % 7 = 0 THEN NULL ELSE 'en' END AS lang, k % 2 = 0 AS semantic_match, CASE WHEN k % 3 = 0 THEN NULL ELSE true END AS pii_reviewed, k % 11 <> 0 AS consent, CASE WHEN k % 8 = 0 THEN '' ELSE 'r' END AS reviewer,
 [{'t': CASE WHEN k % 9 = 0 THEN '  ' WHEN k % 9 = 1 THEN 'call 555-123-' || lpad((user_id % 10000)::VARCHAR, 4, '0') ELSE event_type END, 'c': value / 90.0}] AS alternatives FROM (SELECT *, (props::JSON ->> '$.k')::BIGINT AS k FROM events))"""
_PII_ANY = "|".join(("\\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}\\b", "\\b\\d{3}-\\d{2}-\\d{4}\\b", "\\b(?:\\d[ -]?){12,19}\\b", "\\b(?:\\+?1[ -.]?)?(?:\\(?\\d{3}\\)?[ -.]?)\\d{3}[ -.]\\d{4}\\b"))
_SPOKEN_RULES = {
    "confidence": "coalesce(confidence NOT BETWEEN 0 AND 1, true)",
    "audio_digest": "NOT coalesce(regexp_full_match(audio_sha256, '(?:sha256:)?[0-9a-f]{64}'), false)",
    "speaker": "coalesce(trim(lower(speaker)) <> 'customer', true)",
    "interval": "NOT (start_ms >= 0 AND start_ms < end_ms)",
    "recording": "trim(recording_id) = ''",
    "language": "lang IS NULL",
    "alternative_text": "trim(alternatives[1].t) = ''",
    "alternative_confidence": "coalesce(alternatives[1].c NOT BETWEEN 0 AND 1, true)",
    "alternative_pii": f"regexp_matches(alternatives[1].t, '{_PII_ANY}')",
    "review_semantic_match": "NOT semantic_match",
    "review_pii_reviewed": "pii_reviewed IS NULL",
    "review_consent_for_training": "NOT consent",
    "reviewer": "reviewer = ''",
    "license": "lang IS NULL",
}


@query(f"SELECT event_id, unnest({_fired(_SPOKEN_RULES)}) AS rule FROM {_SPOKEN}")
def q_transcript_rules(spark, sf_dir):
    """Transcribed utterances made of events, each wrong in what its own values say."""
    e = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("bigint"))
    k, digest = F.col("k"), F.sha2("props", 256)
    language = F.when(k % 7 != 0, "en")
    u = {
        "confidence": (k - 3) / 90.0,
        "audio_sha256": F.when(k % 5 == 0, F.concat(F.lit("sha256:"), digest)).when(k % 5 == 1, F.substring(digest, 2, 64)).when(k % 5 > 2, digest),
        "speaker": F.when(k % 4 == 0, "agent").when(k % 4 == 1, " Customer ").when(k % 4 == 2, "CUSTOMER"),
        "start_ms": k * 10 - 50,
        "end_ms": F.col("user_id") * 10,
        "recording_id": F.when(k % 6 == 0, " ").otherwise(F.col("event_type")),
        "language": language,
        "semantic_match": k % 2 == 0,
        "pii_reviewed": F.when(k % 3 != 0, True),
        "consent_for_training": k % 11 != 0,
        "reviewer": F.when(k % 8 == 0, "").otherwise("r"),
        "license": language,
        "alternatives": F.array(F.struct(F.when(k % 9 == 0, "  ").when(k % 9 == 1, F.concat(F.lit("call 555-123-"), F.lpad((F.col("user_id") % 10000).cast("string"), 4, "0"))).otherwise(F.col("event_type")).alias("text"), (F.col("value") / 90.0).alias("confidence"))),
    }
    return e.select("event_id", F.explode(K.transcript_violations(u)).alias("rule"))


_FAMILIES = ("deictic_replace_action", "deictic_replace_ambiguity", "tool_outcome_consistency", "card_status")


@query(f"""SELECT c, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN f = '{_FAMILIES[0]}' AND t = 'replace_card' THEN 'coreference_positive' END, CASE WHEN f = '{_FAMILIES[1]}' AND t = 'clarification' THEN 'coreference_ambiguity' END, CASE WHEN path = 'retrieval_grounded_policy' OR f = 'card_status' THEN 'policy_faq' END, CASE WHEN f = '{_FAMILIES[2]}' THEN 'tool_outcome' END, CASE WHEN path IN ('tool_success', 'ood') THEN 'regression' END], lambda z: z IS NOT NULL)) AS c
 FROM (SELECT path, {list(_FAMILIES)}[x % 4 + 1] AS f, ['replace_card', 'clarification', 'none'][x % 3 + 1] AS t FROM {_RECORDS})) GROUP BY c""")
def q_record_classes(spark, sf_dir):
    x = F.col("x")
    family = F.get(F.array(*map(F.lit, _FAMILIES)), (x % 4).cast("int"))
    target = F.get(F.array(*map(F.lit, ("replace_card", "clarification", "none"))), (x % 3).cast("int"))
    flags = K.record_classes(family, target, F.col("path"), ("card_status",))
    return records(spark, sf_dir).select(F.explode(K.fired(flags)).alias("c")).groupBy("c").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT kind, count(*) AS n FROM (SELECT CASE WHEN source IN ('web', 'news') THEN 'clinc_supported_banking' WHEN lang IN ('de', 'fr') THEN 'clinc_conversational_in_domain' WHEN n_chars % 9 = 0 THEN 'clinc_oos' ELSE 'clinc_nonbanking' END AS kind FROM documents) GROUP BY kind")
def q_source_kinds(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    label = F.when(F.col("source").isin("web", "news"), F.col("source")).when(F.col("lang").isin("de", "fr"), F.col("lang")).when(F.col("n_chars") % 9 == 0, "oos").otherwise("weather")
    return d.select(K.source_kind(label, ("web", "news"), ("de", "fr")).alias("kind")).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM (SELECT doc_id AS h, text FROM documents WHERE doc_id % 5 = 0) x WHERE {norm('x.text')} = {norm('d.text')})")
def q_held_out_excluded(spark, sf_dir):
    """Documents none of whose text, normalized, is a held-out one's: copies go with it."""
    d = table(spark, sf_dir, "documents")
    return K.held_out_excluded(d, d.where("doc_id % 5 = 0")).select("doc_id")


@query("""SELECT event_id, CASE WHEN regexp_full_match(trim(t), '\\+?\\d{1,18}') THEN replace(trim(t), '+', '')::BIGINT END AS n, nullif(trim(t), '') AS t FROM (SELECT event_id, CASE event_id % 6 WHEN 0 THEN ' ' || k || ' ' WHEN 1 THEN '-' || k WHEN 2 THEN '+' || k WHEN 3 THEN 'true' WHEN 4 THEN '  ' ELSE k || '.5' END AS t FROM (SELECT event_id, props::JSON ->> '$.k' AS k FROM events))""")
def q_coercions(spark, sf_dir):
    k, i = F.get_json_object("props", "$.k"), F.col("event_id") % 6
    t = F.when(i == 0, F.concat(F.lit(" "), k, F.lit(" "))).when(i == 1, F.concat(F.lit("-"), k)).when(i == 2, F.concat(F.lit("+"), k)).when(i == 3, "true").when(i == 4, "  ").otherwise(F.concat(k, F.lit(".5")))
    return table(spark, sf_dir, "events").select("event_id", K.count_or_null(t).alias("n"), K.text_or_null(t).alias("t"))


@query("""SELECT event_id, user_id, CASE WHEN g THEN 'generated_case_' || lpad((sum(g::INTEGER) OVER (PARTITION BY user_id ORDER BY ts, event_id))::VARCHAR, 3, '0') ELSE c END AS case_id, g AS generated
 FROM (SELECT *, starts_with(c, 'case_') AND NOT starts_with(c, 'case_view_') AS g FROM (SELECT *, CASE WHEN event_id % 3 = 0 THEN 'ref_' ELSE 'case_' END || event_type || '_' || event_id AS c FROM events))""")
def q_generated_ids(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("case_id", F.concat(F.when(F.col("event_id") % 3 == 0, "ref_").otherwise("case_"), "event_type", F.lit("_"), F.col("event_id").cast("string")))
    return K.generated_ids(e, "user_id", ["ts", "event_id"], "case_id", ("case_view_",)).select("event_id", "user_id", "case_id", "generated")
