"""Queries of label derivation, merges, outcome checks and isolation."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sievework.functions import text as X
from sievework.operators import governance as G
from sievework.operators import splits
from sievework.plans import dims
from sievework.plans.registry import norm, norm_ascii, query
from sievework.sources.readers import table

_INTENTS = list(dims.INTENTS)


def _pick(values, at):
    return F.element_at(F.array(*(F.lit(v) for v in values)), (F.pmod(at, F.lit(len(values))) + 1).cast("int"))


@query("""SELECT o_orderkey, coalesce(r.mode, o_orderpriority) AS text, r.mode IS NOT NULL AS realized FROM orders LEFT JOIN (SELECT l_orderkey, arg_min(l_returnflag || l_linestatus, (l_linenumber, l_partkey, l_suppkey, l_extendedprice)) AS mode FROM lineitem WHERE l_returnflag <> 'N' GROUP BY l_orderkey) r ON o_orderkey = l_orderkey""")
def q_teacher_merge(spark, sf_dir):
    """Requests with their responses; those without keep their own text."""
    answers = table(spark, sf_dir, "lineitem").where("l_returnflag <> 'N'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min_by(F.concat("l_returnflag", "l_linestatus"), F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")).alias("mode"))
    return table(spark, sf_dir, "orders").join(answers, "o_orderkey", "left").select("o_orderkey", F.coalesce("mode", "o_orderpriority").alias("text"), F.col("mode").isNotNull().alias("realized"))


@query("""WITH a AS (SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS i FROM lineitem), b AS (SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey) AS i FROM lineitem)
 SELECT l_orderkey, count(*) AS n, count(*) FILTER (a.l_partkey IS DISTINCT FROM b.l_partkey) AS changed FROM a JOIN b USING (l_orderkey, i) GROUP BY l_orderkey""")
def q_positional_audit(spark, sf_dir):
    """Two orders of the same items compared by position."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    at = lambda *cols: F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*cols))
    a = rows.select("l_orderkey", at("l_linenumber", "l_partkey").alias("i"), F.col("l_partkey").alias("x"))
    b = rows.select("l_orderkey", at("l_partkey").alias("i"), F.col("l_partkey").alias("y"))
    return a.join(b, ["l_orderkey", "i"]).groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("x").eqNullSafe(F.col("y"))).alias("changed"))


@query("""SELECT l_shipdate::DATE AS day, count(*) AS n_calls, count(*) FILTER (l_returnflag = 'N') AS n_ok, count(*) FILTER (l_returnflag <> 'N') AS n_error, count(DISTINCT l_partkey) AS n_parts FROM lineitem GROUP BY 1""")
def q_outcome_counts(spark, sf_dir):
    ok = F.col("l_returnflag") == "N"
    return table(spark, sf_dir, "lineitem").groupBy(F.to_date("l_shipdate").alias("day")).agg(F.count(F.lit(1)).alias("n_calls"), F.count_if(ok).alias("n_ok"), F.count_if(~ok).alias("n_error"), F.count_distinct("l_partkey").alias("n_parts"))


@query(f"(SELECT DISTINCT md5({norm('text')}) AS text_key FROM documents WHERE source < 'src2') INTERSECT (SELECT md5({norm('text')}) FROM documents WHERE source >= 'src2')")
def q_text_intersection(spark, sf_dir):
    """Texts that two parts of the corpus share, as a set."""
    keyed = table(spark, sf_dir, "documents").select((F.col("source") < "src2").alias("a"), F.md5(X.normalize(F.col("text"))).alias("text_key"))
    return keyed.where("a").select("text_key").intersect(keyed.where("NOT a").select("text_key"))


@query("""SELECT o_orderkey, coalesce(nullif(array_to_string(list_filter([CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority ELSE '' END, CASE WHEN o_orderkey % 5 = 0 THEN o_custkey::VARCHAR ELSE '' END], lambda x: x <> ''), '|'), ''), nullif(CASE WHEN o_orderkey % 7 = 0 THEN o_orderstatus ELSE '' END, ''), o_orderkey::VARCHAR) AS group_key FROM orders""")
def q_group_keys(spark, sf_dir):
    k = F.col("o_orderkey")
    some = lambda n, c: F.when(k % n == 0, c.cast("string")).otherwise("")
    return table(spark, sf_dir, "orders").select("o_orderkey", G.group_key(k.cast("string"), some(7, F.col("o_orderstatus")), some(3, F.col("o_orderpriority")), some(5, F.col("o_custkey"))).alias("group_key"))


_NEEDS = list(dims.NEEDS_ENTITY)


@query(f"""SELECT event_id, CASE WHEN i IS NULL THEN 'refuse_ood' WHEN i = 'policy_knowledge' THEN 'retrieve_policy' WHEN i IN ('conversation', 'other_banking') THEN 'converse' WHEN x IN ('missing', 'ambiguous') THEN 'clarify' WHEN x = 'ineligible' THEN 'converse' WHEN c THEN 'clarify'
 WHEN e = 1 AND t = 2 THEN 'execute_tool' WHEN t = 0 THEN 'converse' ELSE 'execute_tool' END AS action,
 CASE WHEN i IS NULL OR i IN ('policy_knowledge', 'conversation', 'other_banking') THEN 'not_required' WHEN x IN ('missing', 'ambiguous', 'ineligible') THEN x WHEN c THEN CASE WHEN e > 1 THEN 'ambiguous' ELSE 'missing' END WHEN e = 1 AND t = 2 THEN 'resolved' WHEN t = 0 THEN 'not_required'
 WHEN list_contains({_NEEDS}, i) THEN 'resolved' ELSE 'not_required' END AS entity
 FROM (SELECT event_id, ({_INTENTS})[event_id % 13 + 1] AS i, ['', '', '', 'missing', 'ambiguous', 'ineligible', 'resolved'][event_id % 7 + 1] AS x, event_id % 5 = 0 AS c, event_id % 3 AS t, event_id % 4 AS e FROM events)""")
def q_actions_entities(spark, sf_dir):
    """Supervision derived from annotations made of event numbers."""
    n = F.col("event_id")
    intent = F.get(F.array(*map(F.lit, _INTENTS)), (n % 13).cast("int"))
    tools = F.when(n % 3 == 0, F.array().cast("array<string>")).when(n % 3 == 1, F.array(F.lit("list_cards"))).otherwise(F.array(intent))
    made = G.action_and_entity(intent, F.when(n % 5 == 0, "Clarification").otherwise("tool"), tools, intent, (n % 4).cast("int"), _pick(("", "", "", "missing", "ambiguous", "ineligible", "resolved"), n))
    return table(spark, sf_dir, "events").select("event_id", made.alias("m")).select("event_id", "m.*")


_ERRORS = ("unsupported tool: ", "unsupported arguments", "select a transfer by ID or recipient, not both", "expected exactly one matching synthetic ", "no matching synthetic banking record", "select a transaction by ID or description", "disk full ")
_MESSAGE = f"CASE WHEN user_id % 4 = 0 THEN lower(e) WHEN user_id % 4 = 1 THEN e ELSE e || event_type END"
_ERROR_ROWS = f"(SELECT event_id, {_MESSAGE} AS m FROM (SELECT *, {list(_ERRORS)}[(event_id * 31 + user_id) % 7 + 1] AS e FROM events))"


@query(f"""SELECT code, count(*) AS n FROM (SELECT CASE WHEN starts_with(m, 'unsupported tool') THEN 'unsupported_tool' WHEN starts_with(m, 'unsupported arguments') THEN 'invalid_arguments' WHEN starts_with(m, 'select a transaction by ID or description') THEN 'ambiguous_transaction_selector'
 WHEN starts_with(m, 'select a transfer by ID or recipient') THEN 'ambiguous_transfer_selector' WHEN starts_with(m, 'expected exactly one matching synthetic') THEN 'record_match_count' WHEN m = 'no matching synthetic banking record' THEN 'record_not_found' ELSE 'backend_error' END AS code FROM {_ERROR_ROWS}) GROUP BY code""")
def q_error_codes(spark, sf_dir):
    """Messages with the rows' own words after them, or in lower case, which no rule knows."""
    e = table(spark, sf_dir, "events").withColumn("e", _pick(_ERRORS, F.col("event_id") * 31 + F.col("user_id")))
    return e.select(G.error_code(F.expr(_MESSAGE)).alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT user_id, count(*) AS n_calls, coalesce(bool_or(event_type = 'click' AND (value < 60) AND NOT (coalesce(event_id % 5 = 0, false)) AND event_id % 7 <> 0), false) AS succeeded FROM events GROUP BY user_id""")
def q_tool_success(spark, sf_dir):
    """A user's events as calls with results: errors by value, explicit failures and missing results by number."""
    i = F.col("event_id")
    result = F.when(i % 7 != 0, F.struct(F.when(F.col("value") >= 60, F.concat(F.lit("bad "), F.col("value").cast("string"))).when(i % 2 == 0, "").alias("error"), F.when(i % 5 == 0, False).when(i % 3 == 0, True).alias("success")))
    calls = F.array_sort(F.collect_list(F.struct("event_id", "event_type", result.alias("r"))))
    u = table(spark, sf_dir, "events").groupBy("user_id").agg(calls.alias("c"))
    return u.select("user_id", F.size("c").cast("bigint").alias("n_calls"), G.tool_succeeded(F.lit("click"), F.transform("c", lambda x: x["event_type"]), F.transform("c", lambda x: x["r"])).alias("succeeded"))


_ANSWER = "CASE WHEN x % 6 = 0 THEN 'Card ' || four || ' is frozen' WHEN x % 6 = 1 THEN 'The card is frozen' WHEN x % 6 = 2 THEN 'A replacement for ' || four || ' is coming' WHEN x % 6 = 3 THEN 'I was unable to do that' WHEN x % 6 = 4 THEN ' ' ELSE 'Done with ' || four END || CASE WHEN x % 5 = 0 THEN ' (' || upper(private_id) || ')' ELSE '' END"
_ASKED = {"x": "CAST(o_orderkey * 7919 + o_custkey AS BIGINT)", "four": "lpad(CAST(o_custkey % 10000 AS {text}), 4, '0')", "private_id": "'card-' || CAST(o_orderkey AS {text})", "tool": "CASE WHEN x % 4 = 0 THEN 'replace_card' WHEN x % 4 = 1 THEN 'list_cards' ELSE 'freeze_card' END", "ok": "x % 7 > 1", "answer": _ANSWER}


def _asked_sql() -> str:
    sql = "SELECT o_orderkey, o_custkey FROM orders"
    for name, expression in _ASKED.items():
        sql = f"SELECT *, {expression.format(text='VARCHAR')} AS {name} FROM ({sql})"
    return sql


_SAID = {"freeze_card": "contains(low, 'froze')", "replace_card": "contains(low, 'replacement')", "list_cards": "true"}


@query(f"""SELECT o_orderkey, CASE WHEN trim(answer) = '' THEN 'empty_answer' ELSE array_to_string(list_filter([CASE WHEN contains(low, lower(private_id)) THEN 'private_identifier' END, CASE WHEN NOT ok AND NOT contains(low, 'unable') THEN tool || ':failure_hidden' END, CASE WHEN ok AND NOT contains(answer, four) THEN tool || ':value_missing' END,
 CASE WHEN ok AND NOT CASE tool {" ".join(f"WHEN '{k}' THEN {v}" for k, v in _SAID.items())} END THEN tool || ':outcome_missing' END], lambda e: e IS NOT NULL), ',') END AS errors FROM (SELECT *, lower(answer) AS low FROM ({_asked_sql()}))""")
def q_grounded_answers(spark, sf_dir):
    """Answers of three tools that name their card, or don't, or name what they may not."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    for name, expression in _ASKED.items():
        rows = rows.withColumn(name, F.expr(expression.format(text="STRING")))
    call = F.struct(F.col("tool"), F.col("ok"), F.col("four").alias("value"), F.col("private_id"))
    return rows.select("o_orderkey", F.array_join(G.answer_errors(F.col("answer"), F.array(call)), ",").alias("errors"))


@query("""WITH r AS (SELECT o_custkey AS pair_id, CASE WHEN i = 1 THEN 'replace_card' ELSE 'clarification' END AS target, CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN i = 1 ELSE CASE i WHEN 1 THEN o_orderkey % 3 <> 0 ELSE o_orderkey % 4 <> 0 END END AS p, o_orderkey % 5 = 0 AS m
  FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i FROM orders) WHERE i <= 2), g AS (SELECT pair_id, count(*) FILTER (target = 'replace_card') AS np, count(*) FILTER (target <> 'replace_card') AS na, count(*) FILTER (coalesce(p, false) AND target = 'replace_card') AS p, count(*) FILTER (coalesce(p, false) AND target <> 'replace_card') AS a, bool_and(coalesce(p, false)) AS b, count(*) FILTER (m) AS m FROM r GROUP BY pair_id)
 SELECT sum(np)::BIGINT AS positive_records, sum(na)::BIGINT AS ambiguity_records, sum(p) / sum(np) AS positive_accuracy, sum(a) / sum(na) AS ambiguity_accuracy, avg(b::INTEGER::DOUBLE) AS pair_flip_accuracy, sum(m)::BIGINT AS parse_failures, count(*) FILTER (np + na <> 2) AS incomplete_pairs FROM g""")
def q_coreference_report(spark, sf_dir):
    """Pairs made of a customer's first two orders: one must act, the other must ask."""
    k, i = F.col("o_orderkey"), F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    rows = table(spark, sf_dir, "orders").withColumn("i", i).where("i <= 2")
    first = F.col("i") == 1
    good = F.when(k % 5 == 1, first).otherwise(F.when(first, k % 3 != 0).otherwise(k % 4 != 0))
    calls = F.when(k % 5 == 0, F.lit(None)).when(first & good, "replace_card(last4=1)").when(first, "").when(good, "").otherwise("replace_card(last4=1)")
    return G.coreference_report(rows.select(F.col("o_custkey").alias("pair_id"), F.when(first, "replace_card").otherwise("clarification").alias("target"), F.lit("replace_card(last4=1)").alias("expected"), calls.alias("calls"), F.lit("Which CARD do you mean?").alias("content")))


@query(f"""WITH x AS (SELECT md5({norm_ascii("o_orderpriority || ' ' || o_custkey")}) AS key, CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE (o_orderkey // 2)::VARCHAR END AS pair_id, CASE o_orderkey % 2 WHEN 0 THEN 'replace_card' ELSE 'clarification' END AS target, o_orderkey % 2 + 1 AS n_cards, o_orderstatus AS split, o_orderkey // 2 AS entity FROM orders),
 p AS (SELECT key, pair_id, count(*) AS n, pair_id <> '' AND count(*) = 2 AND count(DISTINCT target) = 2 AND min(n_cards) = 1 AND max(n_cards) = 2 AND count(DISTINCT split) = 1 AND count(DISTINCT entity) = 1 AS sound, any_value(entity) AS entity FROM x GROUP BY key, pair_id),
 g AS (SELECT key, sum(n)::BIGINT AS n_rows, count(*) AS n_pairs, bool_and(sound) AS sound, count(DISTINCT entity) AS e FROM p GROUP BY key)
 SELECT key, n_rows, n_pairs FROM g WHERE n_rows > 1 AND NOT (sound AND e = n_pairs)""")
def q_ungoverned_repeats(spark, sf_dir):
    k = F.col("o_orderkey")
    half = F.floor(k / 2).cast("bigint")
    rows = table(spark, sf_dir, "orders").select(
        F.concat_ws(" ", "o_orderpriority", F.col("o_custkey").cast("string")).alias("text"),
        F.when(k % 11 == 0, "").otherwise(half.cast("string")).alias("pair_id"),
        F.when(k % 2 == 0, "replace_card").otherwise("clarification").alias("target"),
        (k % 2 + 1).alias("n_cards"),
        F.col("o_orderstatus").alias("split"),
        half.alias("entity"),
        half.alias("history"),
    )
    return G.ungoverned_repeats(rows)


@query("""WITH r AS (SELECT CASE WHEN doc_id % 10 = 0 THEN 'shadow' ELSE 'governed' END AS side, doc_id, source, md5(""" + norm("text") + """) AS t FROM documents), e AS (SELECT side, 'id' AS kind, doc_id::VARCHAR AS value FROM r UNION ALL SELECT side, 'source', source FROM r UNION ALL SELECT side, 'text', t FROM r)
 SELECT kind, value FROM e GROUP BY kind, value HAVING bool_or(side = 'shadow') AND bool_or(side = 'governed')""")
def q_shadow_isolation(spark, sf_dir):
    """A tenth of the ids as the shadow side, the rest governed: what both have."""
    rows = table(spark, sf_dir, "documents").withColumn("side", F.when(F.col("doc_id") % 10 == 0, "shadow").otherwise("governed"))
    return G.isolation_breaks(rows, {"id": F.col("doc_id"), "source": F.col("source"), "text": F.md5(X.normalize(F.col("text")))})


_NEXT = {"de": "fr", "fr": "es", "es": "en", "en": "de"}


@query(f"""WITH n AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY sha256(doc_id::VARCHAR)) - 1 AS i FROM documents), s AS (SELECT a.doc_id AS current_id, b.doc_id AS prior_id FROM n a JOIN n b ON b.lang = CASE a.lang {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _NEXT.items())} END AND a.i = b.i)
 SELECT current_id, prior_id, 'to' AS kind FROM s UNION ALL SELECT prior_id, current_id, 'back' FROM s""")
def q_topic_shifts(spark, sf_dir):
    """Shifts from each language's rows to the next one's and back, zipped up to the shorter."""
    n = splits.numbered(table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", F.sha2(F.col("doc_id").cast("string"), 256), "i")
    after = F.create_map(*(F.lit(x) for pair in _NEXT.items() for x in pair))
    current = n.select(F.try_element_at(after, F.col("lang")).alias("lang"), "i", F.col("doc_id").alias("current_id"))
    zipped = current.join(n.select("lang", "i", F.col("doc_id").alias("prior_id")), ["lang", "i"]).select("current_id", "prior_id")
    back = zipped.select(F.col("prior_id").alias("current_id"), F.col("current_id").alias("prior_id"), F.lit("back").alias("kind"))
    return zipped.withColumn("kind", F.lit("to")).unionByName(back)


_TOOLS = [*dims.TOOL_ARGUMENTS, "erase_card"]
_STATED = "CASE WHEN p_size % 9 = 0 THEN NULL ELSE list_transform(range(p_size % 4), lambda i: {0}[(p_partkey * 7 + p_size * i) % 10 + 1]) END"


@query(f"SELECT p_partkey, array_to_string(CASE WHEN c IS NULL THEN {list(dims.TOOL_ARGUMENTS)} WHEN NOT list_contains(c, 'erase_card') AND len(list_distinct(c)) = len(c) THEN c END, ',') AS tools FROM (SELECT p_partkey, {_STATED.format(_TOOLS)} AS c FROM part)")
def q_exposed_tools(spark, sf_dir):
    """Contracts of none to three tools, some of them unknown or repeated."""
    size, tools = F.col("p_size"), F.array(*map(F.lit, _TOOLS))
    at = lambda i: F.get(tools, ((F.col("p_partkey") * 7 + size * i) % 10).cast("int"))
    n = (size % 4).cast("int")
    stated = F.when(size % 9 != 0, F.when(n == 0, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(0), n - 1), at)))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(G.exposed_tools(stated), ",").alias("tools"))


@query("SELECT event_id FROM (SELECT event_id, event_id % 12 AS i, event_id % 5 AS a, event_id % 4 AS e FROM events) WHERE (i < 9 AND ((a = 1 AND e = CASE WHEN i IN (2, 3, 5, 7) THEN 1 ELSE 0 END) OR (a = 2 AND e IN (2, 3)) OR (a = 4 AND e = 0))) OR (i = 9 AND a = 3 AND e = 0) OR (i > 9 AND a = 4 AND e = 0)")
def q_compatible_tuples(spark, sf_dir):
    """Decisions that are legal for their intent; domain, lane and family follow from it."""
    rows = table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 12).cast("int").alias("intent_index"), (F.col("event_id") % 5).cast("int").alias("action_index"), (F.col("event_id") % 4).cast("int").alias("entity_index"))
    place = lambda names, c: (F.array_position(F.array(*map(F.lit, names)), F.col(c)) - 1).cast("int")
    known = dims.intents(spark).select("intent_index", place(dims.DOMAINS, "domain").alias("domain_index"), place(dims.LANES, "lane").alias("lane_index"), place(dims.FAMILIES, "family").alias("family_index"))
    return G.compatible_tuples(rows.join(F.broadcast(known), "intent_index"), dims.legal_tuples(spark)).select("event_id")


@query("SELECT o_custkey, len(list(o_orderkey)) AS n_rows, count(*) FILTER (o_orderstatus = 'F') AS n_closed FROM orders GROUP BY o_custkey")
def q_nested_seed(spark, sf_dir):
    """A nested document per customer, exploded into a flat table again."""
    nested = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_list(F.struct("o_orderkey", "o_orderstatus")).alias("items"))
    flat = nested.select("o_custkey", F.inline("items"))
    return flat.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("o_orderstatus") == "F").alias("n_closed"))
