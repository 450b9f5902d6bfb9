"""Queries over orders, customers and events: reads, state, tool evaluation, retrieval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.functions import text as X
from sievework.operators import bank as B
from sievework.operators import governance as G
from sievework.operators import retrieval as R
from sievework.plans import dims
from sievework.plans.registry import norm, query
from sievework.sources.readers import table
from sievework.streaming import registry


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders")


_CENTS = "round(o_totalprice * 100)::BIGINT"
_MONEY = "CASE WHEN {0} < 0 THEN '-' ELSE '' END || 'USD ' || format('{{:,.2f}}', abs({0}) / 100)"


def _cents(c: str) -> Column:
    return F.round(F.col(c) * 100).cast("bigint")


@query("SELECT o_custkey, o_orderkey, rank FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey)::INTEGER AS rank FROM orders) WHERE rank <= 5")
def q_recent_txn_topk(spark, sf_dir):
    return B.top_per_key(orders(spark, sf_dir), "o_custkey", [F.desc("o_orderdate"), F.col("o_orderkey")], 5).select("o_custkey", "o_orderkey", "rank")


@query("SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE o_orderstatus WHEN 'O' THEN 0 WHEN 'P' THEN 1 ELSE 2 END, o_orderdate DESC, o_orderkey) AS r FROM orders) WHERE r = 1")
def q_card_priority(spark, sf_dir):
    rank = F.when(F.col("o_orderstatus") == "O", 0).when(F.col("o_orderstatus") == "P", 1).otherwise(2)
    return B.top_per_key(orders(spark, sf_dir), "o_custkey", [rank, F.desc("o_orderdate"), F.col("o_orderkey")], 1).select("o_custkey", "o_orderkey")


@query("SELECT c_custkey, c_mktsegment, c_name, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment, c_name)::INTEGER AS place FROM customer")
def q_account_order(spark, sf_dir):
    from pyspark.sql.window import Window

    w = Window.partitionBy("c_nationkey").orderBy("c_mktsegment", "c_name")
    return table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_name", F.row_number().over(w).alias("place"))


@query("SELECT c_custkey AS o_custkey, coalesce(n, 0) AS matches, CASE WHEN n = 1 THEN m END AS match, CASE coalesce(n, 0) WHEN 1 THEN 'ok' WHEN 0 THEN 'not_found' ELSE 'ambiguous' END AS status FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, min(o_orderkey) AS m FROM orders WHERE o_orderstatus = 'P' GROUP BY o_custkey) o ON c_custkey = o_custkey")
def q_selector_exactly_one(spark, sf_dir):
    selectors = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"))
    return B.exactly_one(orders(spark, sf_dir).where("o_orderstatus = 'P'"), selectors, "o_custkey", "o_orderkey")


@query("""SELECT c_custkey, coalesce(l.t, c_mktsegment) AS status, coalesce(n, 0) AS n_changes FROM customer LEFT JOIN (SELECT user_id, arg_max(event_type, (ts, event_id)) AS t, count(*) AS n FROM events GROUP BY user_id) l ON c_custkey = user_id""")
def q_state_overlay(spark, sf_dir):
    base = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("status"))
    changes = table(spark, sf_dir, "events").select(F.col("user_id").alias("c_custkey"), "ts", "event_id", F.col("event_type").alias("status"))
    return B.overlay(base, changes, "c_custkey", ["ts", "event_id"], "status")


_SESS = "(SELECT event_id, user_id, ts, sum(n) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS session_no FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 2 HOUR THEN 0 ELSE 1 END AS n FROM events))"


@query(f"SELECT user_id, session_no, count(*) AS n_events, min(event_id) AS first_event FROM {_SESS} GROUP BY user_id, session_no")
def q_session_islands(spark, sf_dir):
    s = B.sessions(table(spark, sf_dir, "events"), "user_id", "ts")
    return s.groupBy("user_id", "session_no").agg(F.count(F.lit(1)).alias("n_events"), F.min("event_id").alias("first_event"))


@query("SELECT event_type, arg_min(user_id, (last, user_id)) AS evicted, count(*) AS n_sessions FROM (SELECT event_type, user_id, max(ts) AS last FROM events GROUP BY event_type, user_id) GROUP BY event_type")
def q_session_lru(spark, sf_dir):
    last = table(spark, sf_dir, "events").groupBy("event_type", "user_id").agg(F.max("ts").alias("last"))
    return last.groupBy("event_type").agg(F.min_by("user_id", F.struct("last", "user_id")).alias("evicted"), F.count(F.lit(1)).alias("n_sessions"))


def accesses(spark, sf_dir):
    """Every event as an access to its user's session, in one registry."""
    return table(spark, sf_dir, "events").select(F.lit("bank").alias("registry"), F.col("user_id").cast("string").alias("session"), F.col("ts").alias("at"), F.col("event_id").alias("id"))


@query("""WITH a AS (SELECT user_id::VARCHAR AS session, epoch_us(ts) AS t, row_number() OVER (ORDER BY ts, event_id) AS r FROM events), p AS (SELECT *, lead(r) OVER w AS nr, lead(t) OVER w AS nt FROM a WINDOW w AS (PARTITION BY session ORDER BY r)),
 others AS (SELECT p.r, q.session, min(q.r) AS f FROM p JOIN a q ON q.t BETWEEN p.t AND p.t + 7200000000 AND q.r > p.r AND q.session <> p.session AND (p.nr IS NULL OR q.r < p.nr) GROUP BY p.r, q.session),
 evicted AS (SELECT r, f FROM (SELECT r, f, row_number() OVER (PARTITION BY r ORDER BY f) AS n FROM others) WHERE n = 32),
 ended AS (SELECT p.session, p.r, p.nr, p.nt, CASE WHEN e.f IS NOT NULL THEN 'evicted' WHEN (p.nt IS NULL OR p.nt - p.t > 7200000000) AND p.t + 7200000000 < (SELECT max(t) FROM a) THEN 'expired' END AS change, coalesce(b.t, p.t + 7200000000) AS at_us FROM p LEFT JOIN evicted e ON e.r = p.r LEFT JOIN a b ON b.r = e.f)
 SELECT 'bank' AS registry, session, at_us, change FROM ended WHERE change IS NOT NULL
 UNION ALL SELECT 'bank', session, t, 'opened' FROM (SELECT session, min(t) AS t FROM a GROUP BY session) UNION ALL SELECT 'bank', session, nt, 'opened' FROM ended WHERE change IS NOT NULL AND nt IS NOT NULL""")
def q_session_registry(spark, sf_dir):
    """Sessions opened, evicted and expired in a registry of 32 that idle for at most two hours."""
    return registry.changes(accesses(spark, sf_dir))


@query("""WITH s AS (SELECT user_id, event_id AS step, value >= 50 AS p FROM events), r AS (SELECT *, sum((NOT p)::INTEGER) OVER (PARTITION BY user_id ORDER BY step ROWS UNBOUNDED PRECEDING) AS run FROM s),
 n AS (SELECT *, row_number() OVER (PARTITION BY user_id, run ORDER BY step) AS n FROM r WHERE p) SELECT user_id, min(step) AS first_passing_step, min(step) FILTER (n = 2) AS selected_step FROM n GROUP BY user_id""")
def q_consecutive_gate(spark, sf_dir):
    steps = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("step"), (F.col("value") >= 50).alias("passed"))
    return B.consecutive_gate(steps, "user_id", "step", "passed")


@query(f"SELECT o_orderkey, {_MONEY.format(_CENTS)} AS amount, strftime(o_orderdate, '%Y-%m-%d %H:%M UTC') AS placed FROM orders")
def q_money_and_moments(spark, sf_dir):
    iso = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))
    return orders(spark, sf_dir).select("o_orderkey", X.money(_cents("o_totalprice"), F.lit("USD")).alias("amount"), X.moment(iso).alias("placed"))


@query(f"""SELECT o_custkey, string_agg('| ' || replace(o_orderpriority, '|', '\\|') || ' | ' || {_MONEY.format(_CENTS)} || ' |', chr(10) ORDER BY rank) AS rendered FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 3 GROUP BY o_custkey""")
def q_snapshot_render(spark, sf_dir):
    top = B.top_per_key(orders(spark, sf_dir), "o_custkey", [F.desc("o_orderdate"), F.col("o_orderkey")], 3)
    line = F.concat(F.lit("| "), B.cell(F.col("o_orderpriority")), F.lit(" | "), X.money(_cents("o_totalprice"), F.lit("USD")), F.lit(" |"))
    return B.render_lines(top, "o_custkey", ["rank"], line)


_AIMS = ("the", "der", "les", "que")
_TERMS = "list_distinct(list_filter(regexp_extract_all(trim(regexp_replace(replace(lower({0}), 'ß', 'ss'), '\\s+', ' ', 'g')), '[a-z0-9]+'), lambda w: NOT list_contains(['a', 'of', 'and', 'to', 'in', 'de', 'la', 'und'], w)))"


@query(f"""WITH t AS (SELECT chunk_id, unnest(w) AS term FROM (SELECT doc_id AS chunk_id, {_TERMS.format("text")} AS w FROM documents)), q AS (SELECT query_id, unnest(w) AS term FROM (SELECT item_id AS query_id, {_TERMS.format("text")} AS w FROM benchmark)),
 n AS (SELECT count(*) AS n FROM documents), idf AS (SELECT term, count(*) AS df FROM t GROUP BY term), x AS (SELECT query_id, q.term, (ln((n + 1) / (coalesce(df, 0) + 1)) + 1) * CASE WHEN q.term IN {_AIMS} THEN 1.75::DOUBLE ELSE 1.0::DOUBLE END AS w FROM q CROSS JOIN n LEFT JOIN idf USING (term)),
 s AS (SELECT query_id, chunk_id, sum(w) AS part, bool_or(term IN {_AIMS}) AS aimed FROM x JOIN t USING (term) GROUP BY query_id, chunk_id), f AS (SELECT query_id, sum(w) AS whole FROM x GROUP BY query_id),
 r AS (SELECT query_id, chunk_id, round(part / whole, 6) AS score FROM s JOIN f USING (query_id) WHERE aimed)
 SELECT query_id, chunk_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::INTEGER AS rank FROM r WHERE score >= 0.1) WHERE rank <= 3""")
def q_policy_lookup(spark, sf_dir):
    """Documents as passages; frequent words of the four languages as intent terms."""
    chunks = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    queries = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return R.lookup(queries, chunks, _AIMS, 3, 0.1, stop=("a", "of", "and", "to", "in", "de", "la", "und"), aliases={})


@query("""WITH d AS (SELECT o_custkey AS query_id, o_orderkey % 3 AS attempt, o_totalprice > 200000 AS valid, o_orderpriority || ' ' || o_orderkey AS answer FROM orders), b AS (SELECT query_id, arg_min(attempt, (attempt, answer)) FILTER (valid) AS attempt, arg_min(answer, (attempt, answer)) FILTER (valid) AS answer FROM d WHERE attempt < 2 GROUP BY query_id)
 SELECT query_id, s AS status, CASE WHEN s IN ('delivered', 'repaired') THEN answer END AS answer FROM (SELECT *, CASE WHEN NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = query_id AND c_acctbal > 0) THEN 'no_evidence' WHEN attempt IS NULL THEN 'rejected' WHEN attempt = 0 THEN 'delivered' ELSE 'repaired' END AS s FROM b)""")
def q_policy_turn(spark, sf_dir):
    """A customer's orders as drafts, large ones valid; those with money as queries with evidence."""
    drafts = orders(spark, sf_dir).select(F.col("o_custkey").alias("query_id"), (F.col("o_orderkey") % 3).alias("attempt"), (F.col("o_totalprice") > 200000).alias("valid"), F.concat_ws(" ", "o_orderpriority", F.col("o_orderkey").cast("string")).alias("answer"))
    evidence = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("query_id"))
    return R.policy_turn(drafts, evidence)


@query("""SELECT query_id, rank, '[Policy: ' || chunk_id || ']' AS citation, chunk_id, lang AS title, source AS effective_from, NULL::VARCHAR AS effective_to FROM (SELECT item_id AS query_id, doc_id AS chunk_id, lang, source, row_number() OVER (PARTITION BY item_id ORDER BY doc_id)::INTEGER AS rank FROM benchmark JOIN documents ON doc_id % 40 = item_id % 40) WHERE rank <= 2""")
def q_policy_citations(spark, sf_dir):
    """Citations of matches made by number, with what their passages say of themselves."""
    d = table(spark, sf_dir, "documents")
    pairs = table(spark, sf_dir, "benchmark").join(d.select("doc_id"), F.col("doc_id") % 40 == F.col("item_id") % 40).select(F.col("item_id").alias("query_id"), F.col("doc_id").alias("chunk_id"))
    matches = B.top_per_key(pairs, "query_id", [F.col("chunk_id")], 2)
    chunks = d.select(F.col("doc_id").alias("chunk_id"), F.col("lang").alias("title"), F.col("source").alias("effective_from"), F.lit(None).cast("string").alias("effective_to"))
    return R.citations_of(matches, chunks)


@query("""WITH s AS (SELECT user_id, event_type AS name, max(value) AS v FROM events GROUP BY ALL), w AS (SELECT user_id, event_type AS name, max(value) AS v FROM events WHERE event_id % 50 <> 0 GROUP BY ALL), f AS (SELECT user_id, string_agg(name || '=' || v, chr(10) ORDER BY name || '=' || v) AS t FROM s GROUP BY user_id), g AS (SELECT user_id, string_agg(name || '=' || v, chr(10) ORDER BY name || '=' || v) AS t FROM w GROUP BY user_id)
 SELECT g.user_id, coalesce(g.t = f.t, false) AS resumes FROM g LEFT JOIN (SELECT * FROM f WHERE user_id % 4 <> 0) f USING (user_id)""")
def q_resume_provenance(spark, sf_dir):
    """Runs whose settings are a user's largest values, before and after some events go."""
    e = table(spark, sf_dir, "events")
    told = lambda rows: G.provenance(rows.groupBy("user_id", "event_type").agg(F.max("value").alias("v")), "user_id", "event_type", "v")
    return G.may_resume(told(e).where("user_id % 4 <> 0"), told(e.where("event_id % 50 <> 0")), "user_id")


_CHUNKS = """(SELECT doc_id, 'c' || doc_id % 190 AS chunk_id, CASE WHEN n_chars % 11 = 0 THEN ' ' ELSE lang END AS title, left(text, 40) AS text, CASE n_chars % 5 WHEN 0 THEN '2024-02-30' WHEN 1 THEN '2024-1-5' ELSE '2024-0' || (1 + n_chars % 9) || '-10' END AS effective_from, CASE n_chars % 4 WHEN 0 THEN NULL WHEN 1 THEN 'never' ELSE '2024-05-2' || n_chars % 10 END AS effective_to FROM documents)"""
_DAY = "CASE WHEN regexp_full_match({0}, '\\d{{4}}-\\d{{2}}-\\d{{2}}') THEN try_cast({0} AS DATE) END".format


def _chunks(spark, sf_dir) -> DataFrame:
    n, text = F.col("n_chars"), lambda c: c.cast("string")
    first = F.when(n % 5 == 0, "2024-02-30").when(n % 5 == 1, "2024-1-5").otherwise(F.concat(F.lit("2024-0"), text(1 + n % 9), F.lit("-10")))
    last = F.when(n % 4 == 1, "never").when(n % 4 > 1, F.concat(F.lit("2024-05-2"), text(n % 10)))
    return table(spark, sf_dir, "documents").select(F.concat(F.lit("c"), text(F.col("doc_id") % 190)).alias("chunk_id"), F.when(n % 11 == 0, " ").otherwise(F.col("lang")).alias("title"), F.substring("text", 1, 40).alias("text"), first.alias("effective_from"), last.alias("effective_to"))


@query(f"""SELECT rule, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN coalesce(trim(title) = '', true) THEN 'blank_title' END, CASE WHEN coalesce(trim(text, ' ') = '', true) THEN 'blank_text' END, CASE WHEN {_DAY('effective_from')} IS NULL THEN 'effective_from' END, CASE WHEN effective_to IS NOT NULL AND {_DAY('effective_to')} IS NULL THEN 'effective_to' END,
 CASE WHEN {_DAY('effective_to')} < {_DAY('effective_from')} THEN 'interval' END], lambda r: r IS NOT NULL)) AS rule FROM {_CHUNKS} UNION ALL SELECT 'repeated_id' FROM {_CHUNKS} GROUP BY chunk_id HAVING count(*) > 1) GROUP BY rule""")
def q_chunk_rules(spark, sf_dir):
    """Passages with dates that are none, intervals that end before they begin, blank titles and repeated ids."""
    return R.chunk_violations(_chunks(spark, sf_dir)).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT n_nationkey, upper(n_name) AS name, count(c_custkey) AS n_customers, coalesce(round(sum(c_acctbal), 2), 0.0) AS balance FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_nationkey, n_name""")
def q_nation_balances(spark, sf_dir):
    """A left join whose dimension keeps its empty rows."""
    c = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("c_custkey").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("b"))
    return table(spark, sf_dir, "nation").join(c, "n_nationkey", "left").select("n_nationkey", F.upper("n_name").alias("name"), F.coalesce("n", F.lit(0)).cast("bigint").alias("n_customers"), F.coalesce("b", F.lit(0.0)).alias("balance"))


_PAIRED = "SELECT l_orderkey, l_linenumber, l_returnflag, lead(l_returnflag) OVER w AS nxt FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_returnflag)"


@query(f"SELECT l_orderkey, count(*) FILTER (l_returnflag = 'A') AS n_calls, count(*) FILTER (l_returnflag = 'R') AS n_results, count(*) FILTER (l_returnflag = 'A' AND nxt = 'R') AS n_matched FROM ({_PAIRED}) GROUP BY l_orderkey")
def q_call_correlation(spark, sf_dir):
    """Calls (flag A) whose next row is their result (flag R), per order as record."""
    from pyspark.sql.window import Window

    rows = table(spark, sf_dir, "lineitem").withColumn("nxt", F.lead("l_returnflag").over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_returnflag")))
    f = F.col("l_returnflag")
    return rows.groupBy("l_orderkey").agg(F.count_if(f == "A").alias("n_calls"), F.count_if(f == "R").alias("n_results"), F.count_if((f == "A") & (F.col("nxt") == "R")).alias("n_matched"))


@query("SELECT event_type, (props::JSON ->> '$.k') AS k, count(*) AS n FROM events GROUP BY ALL")
def q_event_props(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type", F.get_json_object("props", "$.k").alias("k")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT i AS intent_index, intent, n FROM (SELECT o_orderkey % 12 AS i, count(*) AS n FROM orders GROUP BY 1) JOIN (SELECT unnest(range(12)) AS i, unnest(" + str(list(dims.INTENTS)) + ") AS intent) USING (i)")
def q_intent_dimension(spark, sf_dir):
    n = orders(spark, sf_dir).groupBy((F.col("o_orderkey") % 12).alias("intent_index")).agg(F.count(F.lit(1)).alias("n"))
    d = dims.intents(spark).select(F.col("intent_index").cast("bigint").alias("intent_index"), "intent")
    return n.join(F.broadcast(d), "intent_index").select("intent_index", "intent", "n")
