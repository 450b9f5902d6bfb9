"""Queries over conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.functions import text as X
from sievework.operators import conversation as C
from sievework.plans.registry import norm, query
from sievework.sources.readers import table
from sievework.streaming import dialogue


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations")


_CUR = "(SELECT conv_id, max(turn) AS turn, arg_max(text, turn) AS text FROM conversations WHERE role = 'user' AND trim(text) <> '' GROUP BY conv_id)"
_HIST = f"(SELECT c.*, u.turn AS current_turn FROM conversations c JOIN {_CUR} u ON c.conv_id = u.conv_id AND c.turn < u.turn WHERE role IN ('user', 'assistant') AND trim(c.text) <> '')"
_EX = f"""(SELECT conv_id, user_turn, user_text, turn AS assistant_turn, text AS assistant_text, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM (
 SELECT *, lag(role) OVER w AS before, lag(text) OVER w AS user_text, lag(turn) OVER w AS user_turn FROM {_HIST} WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role)) WHERE role = 'assistant' AND before = 'user')"""


@query(f"SELECT * FROM {_CUR}")
def q_last_user(spark, sf_dir):
    return C.last_user(turns(spark, sf_dir))


@query("SELECT conv_id, max(turn) AS turn, arg_max(text, turn) AS text FROM conversations WHERE role = 'assistant' AND trim(text) <> '' AND NOT contains(text, '<tool_call') GROUP BY conv_id")
def q_final_assistant(spark, sf_dir):
    return C.final_assistant(turns(spark, sf_dir))


@query(f"SELECT conv_id, turn, role, text, current_turn FROM {_HIST}")
def q_history_before_current(spark, sf_dir):
    return C.visible_history(turns(spark, sf_dir)).select("conv_id", "turn", "role", "text", "current_turn")


@query(f"SELECT conv_id, user_turn, user_text, assistant_turn, assistant_text, back::INTEGER AS back FROM {_EX}")
def q_exchanges(spark, sf_dir):
    return C.exchanges(turns(spark, sf_dir))


@query(f"SELECT conv_id, count(*) AS n, string_agg(assistant_turn::VARCHAR, ',' ORDER BY back) AS turns FROM {_EX} WHERE back <= 3 GROUP BY conv_id")
def q_last3_exchanges(spark, sf_dir):
    newest = C.exchanges(turns(spark, sf_dir)).where("back <= 3")
    item = F.array_sort(F.collect_list(F.struct("back", "assistant_turn")))
    return newest.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.transform(item, lambda x: x["assistant_turn"].cast("string")), ",").alias("turns"))


def states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dialogue states told by each conversation's own texts: commas, stops and turns."""
    commas, stops = F.sum(F.regexp_count("text", F.lit(","))), F.sum(F.regexp_count("text", F.lit(r"\.")))
    pending = F.when(commas % 3 == 0, F.lit(None)).when(commas % 3 == 1, "freeze_card").otherwise("").cast("string")
    return turns(spark, sf_dir).groupBy("conv_id").agg(pending.alias("pending_servicing"), F.when(stops % 4 == 0, F.lit(None)).otherwise(stops % 2 == 0).alias("knowledge_detour_active"), (F.max("turn") % 3 == 2).alias("topic_shift"))


_STATES = """(SELECT conv_id, CASE c % 3 WHEN 0 THEN NULL WHEN 1 THEN 'freeze_card' ELSE '' END AS pending_servicing, CASE WHEN s % 4 = 0 THEN NULL ELSE s % 2 = 0 END AS detour, last % 3 = 2 AS topic_shift
 FROM (SELECT conv_id, sum(length(text) - length(replace(text, ',', ''))) AS c, sum(length(text) - length(replace(text, '.', ''))) AS s, max(turn) AS last FROM conversations GROUP BY conv_id))"""
_HEADER = """CASE WHEN coalesce(pending_servicing <> '', false) OR coalesce(detour, false) THEN '[PRIOR_DIALOGUE_STATE]' || chr(10) || '{"knowledge_detour_active":' || coalesce(detour::VARCHAR, 'null') || ',"pending_servicing":' || coalesce('"' || pending_servicing || '"', 'null') || '}' || chr(10) ELSE '' END"""


@query(f"""SELECT u.conv_id, {_HEADER} || '[CURRENT_USER]' || chr(10) || u.text || coalesce(chr(10) || past, '') AS router_text FROM {_CUR} u JOIN {_STATES} d ON d.conv_id = u.conv_id LEFT JOIN (
 SELECT conv_id, string_agg('[PREVIOUS_ASSISTANT]' || chr(10) || assistant_text || chr(10) || '[PREVIOUS_USER]' || chr(10) || user_text, chr(10) ORDER BY back) AS past FROM {_EX} WHERE back <= 3 GROUP BY conv_id) p ON u.conv_id = p.conv_id""")
def q_render_input(spark, sf_dir):
    return C.router_input(turns(spark, sf_dir), states=states(spark, sf_dir))


@query("""SELECT conv_id, '[CURRENT]' || chr(10) || trim(text) || CASE WHEN trim(coalesce(previous, '')) <> '' THEN chr(10) || '[PREVIOUS_USER]' || chr(10) || trim(previous) ELSE '' END AS router_text
 FROM (SELECT *, lag(text) OVER w AS previous, max(turn) OVER (PARTITION BY conv_id) AS last FROM conversations WHERE role = 'user' AND trim(text) <> '' WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE turn = last""")
def q_render_dual_head(spark, sf_dir):
    return C.dual_head_input(turns(spark, sf_dir))


@query("SELECT conv_id, turn, group_no FROM (SELECT conv_id, turn, sum((role = 'user')::INTEGER) OVER (PARTITION BY conv_id ORDER BY turn, role ROWS UNBOUNDED PRECEDING)::BIGINT AS group_no FROM conversations) WHERE group_no > 0")
def q_turn_groups(spark, sf_dir):
    return C.turn_groups(turns(spark, sf_dir)).select("conv_id", "turn", "group_no")


def _has(words: tuple[str, ...]) -> str:
    return f"len(list_intersect(w, {list(words)})) > 0"


_REL = f"""(SELECT conv_id, n_history, n_history > 0 AND (len(w) <= 6 OR {_has(C.DEICTIC)}) AS context_dependent, {_has(C.REPAIR)} AS agent_repair, topic_shift, n_history > 0 AND {_has(C.CONFIRM)} AND len(w) <= 6 AS clarification_answer, coalesce(detour AND pending_servicing <> '', false) AND {_has(C.RESUME)} AS resume_previous_service
 FROM (SELECT u.conv_id, coalesce(n, 0) AS n_history, d.pending_servicing, d.detour, d.topic_shift, list_distinct(list_filter(string_split({norm('u.text')}, ' '), lambda x: x <> '')) AS w FROM {{cur}} u JOIN {_STATES} d ON d.conv_id = u.conv_id LEFT JOIN (SELECT conv_id, count(*) AS n FROM {_HIST} GROUP BY conv_id) h ON u.conv_id = h.conv_id))"""
_SAID = f"(SELECT conv_id, turn, CASE conv_id % 3 WHEN 0 THEN text || ' - back to it' WHEN 1 THEN text ELSE left(text, 20) || ' no, return' END AS text FROM {_CUR})"


def _reworded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations whose last user message of two in three is reworded, so that words of all lists occur."""
    rows, last = turns(spark, sf_dir), C.last_user(turns(spark, sf_dir)).select("conv_id", F.col("turn").alias("at"))
    c, t = F.col("conv_id") % 3, F.col("text")
    said = F.when(c == 0, F.concat(t, F.lit(" - back to it"))).when(c == 1, t).otherwise(F.concat(F.substring(t, 1, 20), F.lit(" no, return")))
    return rows.join(last, "conv_id", "left").withColumn("text", F.when((F.col("turn") == F.col("at")) & (F.col("role") == "user"), said).otherwise(t)).drop("at")


_KIND = "CASE WHEN agent_repair THEN 'agent_repair' WHEN clarification_answer THEN 'clarification_answer' WHEN context_dependent THEN 'contextual_followup' WHEN n_history > 0 THEN 'visible_multiturn' ELSE 'sft_single_turn' END AS example_kind"


@query(f"SELECT *, {' || '.join(f'{c}::INTEGER::VARCHAR' for c in C.RELATION_FLAGS)} AS multi_hot, {_KIND} FROM {_REL.replace('{cur}', _SAID)}")
def q_relations(spark, sf_dir):
    return C.relations(_reworded(spark, sf_dir), states(spark, sf_dir))


@query(f"SELECT example_kind, count(*) AS n FROM (SELECT {_KIND} FROM {_REL.replace('{cur}', _SAID)}) GROUP BY example_kind")
def q_example_kind(spark, sf_dir):
    return C.relations(_reworded(spark, sf_dir)).groupBy("example_kind").agg(F.count(F.lit(1)).alias("n"))


_TOK = "len(regexp_extract_all(text, '\\S+'))"


@query(f"""WITH s AS (SELECT conv_id, turn, role, {_TOK}::BIGINT AS n, sum(CASE WHEN role = 'system' THEN {_TOK} ELSE 0 END) OVER (PARTITION BY conv_id) AS sys FROM conversations),
 r AS (SELECT *, sum(n) OVER w AS suffix, sum((role = 'assistant')::INTEGER) OVER w AS trained FROM s WHERE role <> 'system' WINDOW w AS (PARTITION BY conv_id ORDER BY turn DESC, role DESC ROWS UNBOUNDED PRECEDING))
 SELECT conv_id, min(turn) AS start_turn, (max(suffix) + max(sys))::BIGINT AS tokens FROM r WHERE role = 'user' AND suffix + sys <= 256 AND trained > 0 GROUP BY conv_id""")
def q_suffix_budget(spark, sf_dir):
    return C.suffix_budget(turns(spark, sf_dir), 256)


@query(f"""WITH RECURSIVE t AS (SELECT conv_id, {_TOK}::BIGINT AS n, sum((role = 'user')::INTEGER) OVER (PARTITION BY conv_id ORDER BY turn, role ROWS UNBOUNDED PRECEDING)::BIGINT AS g FROM conversations),
 g AS (SELECT conv_id, g, sum(n)::BIGINT AS n, row_number() OVER (PARTITION BY conv_id ORDER BY g DESC) AS i FROM t WHERE g > 0 GROUP BY conv_id, g),
 f AS (SELECT conv_id, 1::BIGINT AS i, n AS used, [g] AS kept FROM g WHERE i = 1
  UNION ALL SELECT f.conv_id, f.i + 1, CASE WHEN used + g.n <= 128 THEN used + g.n ELSE used END, CASE WHEN used + g.n <= 128 THEN list_append(kept, g.g) ELSE kept END FROM f JOIN g ON f.conv_id = g.conv_id AND g.i = f.i + 1)
 SELECT conv_id, arg_max(used, i) AS tokens, array_to_string(list_sort(arg_max(kept, i)), ',') AS groups_kept FROM f GROUP BY conv_id""")
def q_token_budget_greedy(spark, sf_dir):
    return C.greedy_budget(turns(spark, sf_dir), 128)


@query(f"""WITH RECURSIVE t AS (SELECT conv_id, {_TOK}::BIGINT AS n, sum((role = 'user')::INTEGER) OVER (PARTITION BY conv_id ORDER BY turn, role ROWS UNBOUNDED PRECEDING)::BIGINT AS g FROM conversations),
 g AS (SELECT *, i = 1 OR g = 1 AND conv_id % 3 > 0 AS must FROM (SELECT conv_id, g, sum(n)::BIGINT AS n, row_number() OVER (PARTITION BY conv_id ORDER BY g DESC) AS i FROM t WHERE g > 0 GROUP BY conv_id, g)),
 f AS (SELECT conv_id, 0::BIGINT AS i, sum(n) FILTER (must)::BIGINT AS used, list(g) FILTER (must) AS kept, sum(n) FILTER (must) > 128 AS over_budget FROM g GROUP BY conv_id
  UNION ALL SELECT f.conv_id, f.i + 1, CASE WHEN NOT must AND used + g.n <= 128 THEN used + g.n ELSE used END, CASE WHEN NOT must AND used + g.n <= 128 THEN list_append(kept, g.g) ELSE kept END, over_budget FROM f JOIN g ON f.conv_id = g.conv_id AND g.i = f.i + 1)
 SELECT conv_id, arg_max(used, i) AS tokens, array_to_string(list_sort(arg_max(kept, i)), ',') AS groups_kept, bool_or(over_budget) AS over_budget FROM f GROUP BY conv_id""")
def q_token_budget_pinned(spark, sf_dir):
    """The same with each second and third conversation's first exchange pinned."""
    rows = turns(spark, sf_dir)
    pins = rows.select("conv_id").distinct().where("conv_id % 3 > 0").withColumn("group_no", F.lit(1).cast("bigint"))
    return C.greedy_budget(rows, 128, pins)


@query("""WITH w AS (SELECT conv_id, conv_id // 8 AS batch_no, flatten(list(list_transform(regexp_extract_all(text, '\\S+'), lambda x: length(x)::BIGINT) ORDER BY turn, role, text)) AS ids, flatten(list(list_transform(regexp_extract_all(text, '\\S+'), lambda x: CASE WHEN role = 'assistant' THEN length(x) ELSE -100 END::BIGINT) ORDER BY turn, role, text)) AS y FROM conversations GROUP BY conv_id),
 p AS (SELECT *, max(len(ids)) OVER (PARTITION BY batch_no) - len(ids) AS k FROM w) SELECT conv_id, batch_no, (len(ids) + k)::INTEGER AS width, len(ids)::BIGINT AS attended, sha256(array_to_string(list_concat(ids, list_transform(range(k), lambda x: 0::BIGINT)), ',')) AS ids_sha256, sha256(array_to_string(list_concat(y, list_transform(range(k), lambda x: -100::BIGINT)), ',')) AS labels_sha256 FROM p""")
def q_padded_batches(spark, sf_dir):
    """Rows of token ids and labels padded to the longest of their batch; a token's id is its length."""
    words = F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0))
    told = turns(spark, sf_dir).select("conv_id", "turn", "role", "text", F.transform(words, lambda w: F.length(w).cast("bigint")).alias("ids"), F.transform(words, lambda w: F.when(F.col("role") == "assistant", F.length(w)).otherwise(-100).cast("bigint")).alias("y"))
    listed = told.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text", "ids", "y"))).alias("m"))
    whole = listed.select("conv_id", F.floor(F.col("conv_id") / 8).cast("bigint").alias("batch_no"), F.flatten(F.transform("m", lambda x: x["ids"])).alias("ids"), F.flatten(F.transform("m", lambda x: x["y"])).alias("y"))
    made = C.padded(whole, "ids", "y", "batch_no")
    digest = lambda c: F.sha2(F.array_join(F.col(c).cast("array<string>"), ","), 256)
    return made.select("conv_id", "batch_no", F.size("ids").alias("width"), F.size(F.filter("attention", lambda a: a == 1)).cast("bigint").alias("attended"), digest("ids").alias("ids_sha256"), digest("y").alias("labels_sha256"))


@query(f"SELECT conv_id, n_tokens, batch_no, max(n_tokens) OVER (PARTITION BY batch_no) - n_tokens AS padding FROM (SELECT conv_id, sum({_TOK})::BIGINT AS n_tokens, conv_id // 8 AS batch_no FROM conversations GROUP BY conv_id)")
def q_collate_padding(spark, sf_dir):
    return C.collate(turns(spark, sf_dir))


@query("""WITH s AS (SELECT *, lag(role) OVER w AS before, lag(turn) OVER w AS tb FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
 SELECT conv_id, rule, count(*) AS n FROM (SELECT conv_id, unnest(list_filter([CASE WHEN NOT coalesce(trim(text) <> '', false) THEN 'blank_text' END, CASE WHEN NOT coalesce(role IN ('system', 'user', 'assistant', 'tool'), false) THEN 'unknown_role' END,
 CASE WHEN role = 'system' AND before IS NOT NULL THEN 'system_not_first' END, CASE WHEN role = 'assistant' AND coalesce(before = 'system', true) THEN 'assistant_without_user' END, CASE WHEN role = before THEN 'role_repeats' END,
 CASE WHEN turn <> coalesce(tb + 1, 0) THEN 'turn_gap' END], lambda x: x IS NOT NULL)) AS rule FROM s) GROUP BY conv_id, rule""")
def q_violations_conversations(spark, sf_dir):
    """All rule violations of the conversations as they are."""
    return C.role_violations(turns(spark, sf_dir))


@query("""WITH c AS (SELECT conv_id, turn + CASE WHEN conv_id % 5 = 0 AND turn > 1 THEN 1 ELSE 0 END AS turn, CASE WHEN turn = 2 THEN 'system' WHEN turn = 3 AND conv_id % 2 = 0 THEN 'robot' ELSE role END AS role, CASE WHEN turn = 1 AND conv_id % 3 = 0 THEN ' ' ELSE text END AS text FROM conversations), s AS (SELECT *, lag(role) OVER w AS before, lag(turn) OVER w AS tb FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
 SELECT rule, count(*) AS n FROM (SELECT conv_id, unnest(list_filter([CASE WHEN NOT coalesce(trim(text) <> '', false) THEN 'blank_text' END, CASE WHEN NOT coalesce(role IN ('system', 'user', 'assistant', 'tool'), false) THEN 'unknown_role' END, CASE WHEN role = 'system' AND before IS NOT NULL THEN 'system_not_first' END, CASE WHEN role = 'assistant' AND coalesce(before = 'system', true) THEN 'assistant_without_user' END,
 CASE WHEN role = before THEN 'role_repeats' END, CASE WHEN turn <> coalesce(tb + 1, 0) THEN 'turn_gap' END], lambda x: x IS NOT NULL)) AS rule FROM s) GROUP BY rule""")
def q_violations_broken(spark, sf_dir):
    """The same rules on conversations broken on purpose, field by field: a mutation test as a query."""
    c, t = F.col("conv_id"), F.col("turn")
    broken = turns(spark, sf_dir).select(
        "conv_id",
        (t + F.when((c % 5 == 0) & (t > 1), 1).otherwise(0)).alias("turn"),
        F.when(t == 2, "system").when((t == 3) & (c % 2 == 0), "robot").otherwise(F.col("role")).alias("role"),
        F.when((t == 1) & (c % 3 == 0), " ").otherwise(F.col("text")).alias("text"),
    )
    return C.role_violations(broken).groupBy("rule").agg(F.sum("n").alias("n"))


_PHRASES = ("please freeze my card it was stolen", "replace the card", "I dispute a purchase", "cancel the transfer to the club", "what happened to my case", "policy on a mortgage", "show cards", "that transaction again", "transfer status", "account balance", "hello there", "nothing of these")


@query(f"""SELECT c_custkey, CASE WHEN contains(t, 'freeze') OR contains(t, 'stolen') THEN 'freeze_card' WHEN contains(t, 'replace') THEN 'replace_card' WHEN contains(t, 'dispute') THEN 'dispute_transaction'
 WHEN contains(t, 'cancel_transfer') OR (contains(t, 'cancel') AND contains(t, 'transfer')) THEN 'cancel_transfer' WHEN contains(t, 'case') OR contains(t, 'address') THEN 'view_service_cases'
 WHEN contains(t, 'faq') OR contains(t, 'policy') OR contains(t, 'mortgage') THEN 'policy_knowledge' WHEN contains(t, 'card') THEN 'view_cards' WHEN contains(t, 'transaction') OR contains(t, 'purchase') THEN 'view_transactions'
 WHEN contains(t, 'transfer') THEN 'view_transfers' WHEN contains(t, 'account') OR contains(t, 'balance') THEN 'view_accounts' WHEN contains(t, 'conversation') OR contains(t, 'greeting') OR contains(t, 'hello') THEN 'conversation' ELSE 'other_banking' END AS intent,
 len(list_intersect(string_split({norm('t')}, ' '), {list(X.CONTEXT_WORDS)})) > 0 AS contextual FROM (SELECT c_custkey, lower({list(_PHRASES)}[c_custkey % 12 + 1]) AS t FROM customer)""")
def q_intent_rules(spark, sf_dir):
    said = F.element_at(F.array(*map(F.lit, _PHRASES)), (F.col("c_custkey") % 12 + 1).cast("int"))
    return table(spark, sf_dir, "customer").select("c_custkey", C.intent_of(said).alias("intent"), X.is_contextual(said).alias("contextual"))


def fsm_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Router observations made from events: a user is a conversation, an event type an intent."""
    e = table(spark, sf_dir, "events")
    n = F.pmod(F.col("event_id"), F.lit(11))
    intents = list(dialogue.SERVICING_TOOLS) + ["policy_knowledge", "conversation"]
    intent = F.element_at(F.array(*map(F.lit, intents)), (n + 1).cast("int"))
    tool = F.element_at(F.array(*(F.lit(dialogue.SERVICING_TOOLS.get(i, "")) for i in intents)), (n + 1).cast("int"))
    return e.select(
        F.col("user_id").alias("conv_id"),
        F.col("event_id").alias("turn"),
        F.when(F.pmod("event_id", F.lit(13)) == 0, "uncertain").otherwise("in_domain").alias("route"),
        intent.alias("intent"),
        (F.pmod("event_id", F.lit(10)) / 10).alias("confidence"),
        (F.pmod("event_id", F.lit(5)) == 0).alias("resume"),
        F.concat(F.lit("ask "), F.col("event_id").cast("string")).alias("user_text"),
        F.when(F.pmod("event_id", F.lit(4)) == 0, "").otherwise(F.col("event_type")).alias("assistant_text"),
        tool.alias("tool"),
        (F.pmod("event_id", F.lit(3)) == 0).alias("tool_ok"),
        F.col("ts").cast("timestamp").alias("at"),
    )


@query()
def q_dialogue_fsm(spark, sf_dir):
    """An ordered fold; tests hold it against its streaming twin and hand-made cases."""
    return dialogue.replay(fsm_input(spark, sf_dir))
