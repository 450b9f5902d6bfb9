"""Queries over tool calls on the wire: outputs are made of the rows' own values, and SQL reads the same texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.operators import wire as W
from sievework.plans.registry import norm, query
from sievework.sources.readers import table

#: Outputs as SQL over ``part``; both engines evaluate this text. ``z`` mixes a row's values, so that forms meet arguments of all kinds.
_ARGS = """CASE (z + p_size) % 9 WHEN 0 THEN '{"limit": ' || p_size || '}' WHEN 1 THEN '{"limit": "' || p_size || '"}' WHEN 2 THEN '{"limit": ' || p_retailprice || ', "order": "' || lower(p_type) || '"}'
 WHEN 3 THEN '{}' WHEN 4 THEN '{"order": "' || lower(p_type) || '", "limit": ' || (p_size - 5) || '}' WHEN 5 THEN '{"limit": null, "exact": true}' WHEN 6 THEN '{"exact": ' || p_size || '}' WHEN 7 THEN '{"limit": true, "brand_id": "' || p_brand || '"}' ELSE '[' || p_size || ']' END"""
_NAME = "CASE z % 5 WHEN 0 THEN 'list_parts' WHEN 1 THEN 'count_parts' WHEN 2 THEN 'erase_parts' WHEN 3 THEN ' list_parts ' ELSE '' END"
_ONE = """'{"name": ' || CASE WHEN z % 11 = 7 THEN p_size::VARCHAR ELSE '"' || name || '"' END || ', "arguments": ' || args || CASE z % 7 WHEN 2 THEN ', "index": 0' WHEN 4 THEN ', "index": "0"' WHEN 5 THEN ', "index": 1' ELSE '' END || CASE z % 3 WHEN 0 THEN ', "id": "c' || p_size % 3 || '"' ELSE '' END || '}'"""
_TWO = """'{"name": "count_parts", "arguments": {"exact": false}, "id": "c' || p_size % 2 || '"}'"""
_RAW = """CASE z % 13 WHEN 0 THEN '<tool_call>' || one || '</tool_call>' WHEN 1 THEN '<tool_call> ' || one || ' </tool_call> <tool_call>' || two || '</tool_call>' WHEN 2 THEN 'Looking for ' || p_name || '. <tool_call>' || one || '</tool_call>'
 WHEN 3 THEN '<tool_call>' || p_name || '</tool_call>' WHEN 4 THEN one WHEN 5 THEN '{"tool_calls": [' || one || ', ' || two || ']}' WHEN 6 THEN '{"content": "' || p_name || '"}' WHEN 7 THEN '{"note": ' || p_size || '}' WHEN 8 THEN p_name || ' is ' || p_type
 WHEN 9 THEN CASE z % 4 WHEN 0 THEN '<tool_call>' || one WHEN 1 THEN '{"tool_calls": ' || one || '}' WHEN 2 THEN '{"tool_calls": null, "content": "' || p_name || '"}' ELSE '{"tool_calls": "' || p_name || '", "content": "x"}' END WHEN 10 THEN '' WHEN 11 THEN '<tool_call>' || two || '</tool_call><tool_call>' || two || '</tool_call><tool_call>' || two || '</tool_call><tool_call>' || two || '</tool_call>' ELSE '{' || p_name END"""


_Z = "CAST(p_partkey * 7919 + p_size * 104729 AS BIGINT) % 100003"


def _made(spark: SparkSession, sf_dir: str, **columns: str) -> DataFrame:
    """``part`` with columns given as SQL, each of which may use those before it."""
    rows = table(spark, sf_dir, "part")
    for name, sql in columns.items():
        rows = rows.withColumn(name, F.expr(sql.replace("::VARCHAR", "::STRING")))
    return rows


def outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _made(spark, sf_dir, z=_Z, args=_ARGS, name=_NAME, one=_ONE, two=_TWO, raw_output=_RAW).select("p_partkey", "raw_output")


_OUT = f"(SELECT p_partkey, {_RAW} AS raw_output FROM (SELECT *, {_ONE} AS one, {_TWO} AS two FROM (SELECT *, {_ARGS} AS args, {_NAME} AS name FROM (SELECT *, {_Z} AS z FROM part))))"
_VALID = "CASE WHEN json_valid({0}) THEN {0}::JSON END"
_CALL = """{{'f': CASE WHEN {v} IS NULL THEN 'invalid_json' WHEN json_type({v}) <> 'OBJECT' THEN 'not_an_object' WHEN coalesce(json_type({v}, '$.name'), '') <> 'VARCHAR' OR trim({v} ->> '$.name') = '' THEN 'no_name' WHEN coalesce(json_type({v}, '$.arguments'), '') <> 'OBJECT' THEN 'arguments_not_an_object' WHEN coalesce(json_type({v}, '$.index'), 'NULL') NOT IN ('NULL', 'BIGINT', 'UBIGINT') THEN 'index_not_an_integer' END,
 'i': coalesce(TRY_CAST({v} ->> '$.index' AS BIGINT), {i}), 'id': CASE WHEN json_type({v}, '$.id') = 'VARCHAR' THEN {v} ->> '$.id' END, 'n': trim({v} ->> '$.name'), 'a': coalesce(array_to_string(list_sort(list_transform(json_keys({v}, '$.arguments'), lambda k: k || '=' || regexp_replace(({v} -> ('$.arguments.' || k))::VARCHAR, '\\.0$', ''))), ','), '')}}"""
_PARSED = f"""(SELECT p_partkey, raw_output, b, bare, CASE WHEN len(b) > 0 THEN list_transform(list_zip(list_transform(b, lambda x: {_VALID.format('x')}), range(len(b))), lambda p: {_CALL.format(v='p[1]', i='p[2]')})
 WHEN bare IS NULL OR coalesce(json_type(bare, '$.tool_calls'), 'ARRAY') <> 'ARRAY' THEN [] WHEN json_type(bare, '$.tool_calls') = 'ARRAY' THEN list_transform(list_zip((bare -> '$.tool_calls')::JSON[], range(json_array_length(bare, '$.tool_calls')::BIGINT)), lambda p: {_CALL.format(v='p[1]', i='p[2]')})
 WHEN json_exists(bare, '$.name') AND json_exists(bare, '$.arguments') THEN [{_CALL.format(v='bare', i='0')}] ELSE [] END AS c
 FROM (SELECT *, regexp_extract_all(raw_output, '(?s)<tool_call>\\s*(.*?)\\s*</tool_call>', 1) AS b, CASE WHEN starts_with(raw_output, '{{') AND json_valid(raw_output) THEN raw_output::JSON END AS bare FROM {_OUT}))"""
_FAILED = f"""(SELECT *, CASE WHEN raw_output = '' THEN 'empty' WHEN len(b) > 0 AND trim(regexp_extract(raw_output, '(?s)^(.*?)<tool_call>', 1) || regexp_extract(raw_output, '(?s)^.*</tool_call>(.*)$', 1)) <> '' THEN 'prose_outside_blocks'
 WHEN len(b) = 0 AND contains(raw_output, '<tool_call') THEN 'malformed_block' WHEN starts_with(raw_output, '{{') AND bare IS NULL THEN 'invalid_json' WHEN coalesce(json_type(bare, '$.tool_calls'), 'ARRAY') <> 'ARRAY' THEN 'tool_calls_not_a_list' WHEN len(list_filter(c, lambda x: x.f IS NOT NULL)) > 0 THEN list_filter(c, lambda x: x.f IS NOT NULL)[1].f
 WHEN bare IS NOT NULL AND len(c) = 0 AND NOT json_exists(bare, '$.tool_calls') AND NOT json_exists(bare, '$.content') THEN 'neither_calls_nor_content' WHEN len(c) > 3 THEN 'too_many_calls'
 WHEN list_transform(c, lambda x: x.i) <> range(len(c)) THEN 'index_order' WHEN len(list_distinct(list_transform(c, lambda x: x.id))) < len(list_filter(c, lambda x: x.id IS NOT NULL)) THEN 'repeated_id' END AS failure FROM {_PARSED})"""


@query(f"""SELECT p_partkey, failure, CASE WHEN failure IS NULL THEN array_to_string(list_transform(c, lambda x: x.n || '(' || x.a || ')'), ';') ELSE '' END AS calls,
 CASE WHEN failure IS NULL THEN CASE WHEN bare IS NOT NULL THEN bare ->> '$.content' WHEN len(b) = 0 THEN raw_output END END AS content FROM {_FAILED}""")
def q_strict_parse(spark, sf_dir):
    """Outputs in all forms of the wire: blocks, bare objects, lists, prose, and what is wrong with them."""
    shown = F.array_join(F.transform("calls", lambda c: F.concat(c["name"], F.lit("("), c["arguments"], F.lit(")"))), ";")
    return W.strict_parse(outputs(spark, sf_dir)).select("p_partkey", "failure", shown.alias("calls"), "content")


@query(f"SELECT coalesce(failure, 'ok') AS failure, count(*) AS n FROM {_FAILED} GROUP BY 1")
def q_strict_parse_failures(spark, sf_dir):
    return W.strict_parse(outputs(spark, sf_dir)).groupBy(F.coalesce("failure", F.lit("ok")).alias("failure")).agg(F.count(F.lit(1)).alias("n"))


SCHEMAS = {
    "list_parts": {"limit": (("integer", "null"), 1, 20, None, False), "order": (("string",), None, None, ("small", "economy", "promo"), False), "exact": (("boolean",), None, None, None, False)},
    "count_parts": {"limit": (("number",), 0, 950, None, True), "exact": (("boolean", "integer"), 10, 30, None, False)},
    "drop_parts": {},
}


_TOOL = "CASE z % 4 WHEN 0 THEN 'list_parts' WHEN 1 THEN 'count_parts' WHEN 2 THEN 'drop_parts' ELSE 'erase_parts' END"
_RULE_ROWS = ", ".join(f"('{t}', '{n}', {list(k)}, {low if low is not None else 'NULL'}::DOUBLE, {high if high is not None else 'NULL'}::DOUBLE, {list(e) if e else 'NULL'}::VARCHAR[], {str(r).lower()})" for t, s in SCHEMAS.items() for n, (k, low, high, e, r) in s.items())
_KIND = "CASE json_type({0}) WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' WHEN 'VARCHAR' THEN 'string' WHEN 'BIGINT' THEN 'integer' WHEN 'UBIGINT' THEN 'integer' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'NULL' THEN 'null' ELSE 'number' END"
_ARG_ROWS = f"(SELECT p_partkey, {_TOOL} AS tool, ({_ARGS})::JSON AS args FROM (SELECT *, {_Z} AS z FROM part))"


@query(f"""WITH a AS (SELECT * FROM {_ARG_ROWS} WHERE json_type(args) = 'OBJECT'), r(tool, name, types, low, high, listed, required) AS (VALUES {_RULE_ROWS}),
 v AS (SELECT p_partkey, name, CASE WHEN NOT list_contains(json_keys(args), name) THEN CASE WHEN required THEN 'missing:' || name END WHEN NOT (list_contains(types, k) OR (k = 'integer' AND list_contains(types, 'number'))) THEN 'type:' || name
  WHEN k IN ('integer', 'number') AND x::VARCHAR::DOUBLE < low THEN 'minimum:' || name WHEN k IN ('integer', 'number') AND x::VARCHAR::DOUBLE > high THEN 'maximum:' || name WHEN k = 'string' AND listed IS NOT NULL AND NOT list_contains(listed, x ->> '$') THEN 'enum:' || name END AS error
  FROM (SELECT a.*, r.name, types, low, high, listed, required, args -> ('$.' || name) AS x, {_KIND.format("args -> ('$.' || name)")} AS k FROM a JOIN r USING (tool))),
 e AS (SELECT p_partkey, 'extra:' || key AS error FROM (SELECT p_partkey, tool, unnest(json_keys(args)) AS key FROM a WHERE tool <> 'erase_parts') x WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.tool = x.tool AND r.name = x.key)
  UNION ALL SELECT p_partkey, error FROM v WHERE error IS NOT NULL UNION ALL SELECT p_partkey, 'unknown_tool' FROM a WHERE tool = 'erase_parts')
 SELECT p_partkey, string_agg(error, ',' ORDER BY error) AS errors FROM e GROUP BY p_partkey""")
def q_argument_schema(spark, sf_dir):
    """Arguments of every JSON type under schemas with unions, bounds, lists and required names."""
    rows = _made(spark, sf_dir, z=_Z, args=_ARGS, tool=_TOOL).withColumn("v", F.try_parse_json("args")).where(W.kind_of(F.col("v")) == "object")
    return rows.select("p_partkey", F.array_join(W.schema_errors(F.col("tool"), F.col("v"), SCHEMAS), ",").alias("errors")).where("errors <> ''")


def _nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their lines as nested JSON with private and public ids."""
    line = F.struct(F.col("l_linenumber").alias("line_no"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("part_id"), F.struct(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("supplier_id"), F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("paid_cents")).alias("supplier"))
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(line)).alias("lines"))
    o = table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    whole = F.struct(F.concat(F.lit("k"), F.col("o_orderkey").cast("string")).alias("case_id"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("customer_id"), F.col("o_orderpriority").alias("priority"), F.col("lines"))
    return o.select("o_orderkey", F.parse_json(F.to_json(whole)).alias("v"))


_LINES = "(SELECT l_orderkey, list(l ORDER BY l) AS lines FROM (SELECT l_orderkey, {'line_no': l_linenumber, 'part_id': 'p' || l_partkey, 'supplier': {'supplier_id': 's' || l_suppkey, 'paid_cents': round(l_extendedprice * 100)::BIGINT}} AS l FROM lineitem) GROUP BY l_orderkey)"


@query(f"""SELECT o_orderkey, 'k' || o_orderkey AS case_id, (SELECT string_agg(line, ';' ORDER BY i) FROM (SELECT i, lines[i].line_no || ':' || lines[i].supplier.paid_cents AS line FROM unnest(range(1, len(lines) + 1)) t(i))) AS shown, '' AS private,
 (SELECT string_agg(DISTINCT x, ',' ORDER BY x) FROM (SELECT unnest(flatten([['k' || o_orderkey, 'c' || o_custkey], list_transform(lines, lambda l: l.part_id), list_transform(lines, lambda l: l.supplier.supplier_id)])) AS x)) AS ids FROM orders JOIN {_LINES} ON o_orderkey = l_orderkey""")
def q_private_nested(spark, sf_dir):
    """Nested objects without their private ids, and the ids found in them."""
    bare = W.with_private_apart(_nested(spark, sf_dir), "v", ("case_id",)).select("o_orderkey", F.col("v").alias("bare"), F.array_join("private_ids", ",").alias("ids"), "v")
    bare = W.with_private_apart(bare, "v")  # what is left in the bare value
    lines = F.transform(F.try_variant_get("bare", "$.lines", "array<variant>"), lambda x: F.concat(F.try_variant_get(x, "$.line_no", "string"), F.lit(":"), F.try_variant_get(x, "$.supplier.paid_cents", "string")))
    left = F.array_join(F.filter("private_ids", lambda i: ~F.startswith(i, F.lit("k"))), ",")
    return bare.select("o_orderkey", F.try_variant_get("bare", "$.case_id", "string").alias("case_id"), F.array_join(lines, ";").alias("shown"), left.alias("private"), "ids")


@query(f"""WITH s AS (SELECT o_orderkey, unnest(flatten([['k' || o_orderkey, 'c' || o_custkey, {norm('o_orderpriority')}], flatten(list_transform(lines, lambda l: [l.line_no::VARCHAR, l.part_id, l.supplier.supplier_id, l.supplier.paid_cents::VARCHAR, (l.supplier.paid_cents // 100) || '.' || lpad((l.supplier.paid_cents % 100)::VARCHAR, 2, '0'), format('{{:,}}', l.supplier.paid_cents // 100) || '.' || lpad((l.supplier.paid_cents % 100)::VARCHAR, 2, '0')]))])) AS fact FROM orders JOIN {_LINES} ON o_orderkey = l_orderkey)
 SELECT fact, count(*) AS n FROM (SELECT DISTINCT o_orderkey, fact FROM s) GROUP BY fact""")
def q_scalar_facts(spark, sf_dir):
    """Every scalar of nested objects as a fact, amounts in cents also as money, with the objects that hold it."""
    return _holders(spark, sf_dir, _nested(spark, sf_dir))


def _holders(spark: SparkSession, sf_dir: str, rows: DataFrame) -> DataFrame:
    """Facts with the orders that hold them: an order's are distinct in its own task, and only where orders repeat are all facts shuffled to be so."""
    facts = W.scalar_sets(rows, "v").select("o_orderkey", F.explode("facts").alias("fact"))
    again = table(spark, sf_dir, "orders").groupBy("o_orderkey").count().where("count > 1").limit(1).count()
    return (facts.distinct() if again else facts).groupBy("fact").agg(F.count(F.lit(1)).alias("n"))


def chained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``o_orderkey`` and ``v``: each order with its lines nested in one another."""
    line = F.struct("l_linenumber", "l_partkey", "l_suppkey", F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("cents"))
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(line), asc=False).alias("lines"))
    shown = lambda c: c.cast("string")
    chain = F.aggregate("lines", F.lit(""), lambda acc, x: F.concat(F.lit('{"line_no": '), shown(x["l_linenumber"]), F.lit(', "part_id": "p'), shown(x["l_partkey"]), F.lit('", "supplier": {"supplier_id": "s'), shown(x["l_suppkey"]), F.lit('", "paid_cents": '), shown(x["cents"]), F.lit('}, "next": ['), acc, F.lit("]}")))
    o = table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    whole = F.concat(F.lit('{"priority": "'), F.col("o_orderpriority"), F.lit('", "case_id": "k'), F.col("o_orderkey").cast("string"), F.lit('", "lines": ['), chain, F.lit("]}"))
    return o.select("o_orderkey", F.parse_json(whole).alias("v"))


_CHAIN_ROWS = "(SELECT l_orderkey, list({'n': l_linenumber, 'p': l_partkey, 's': l_suppkey, 'c': round(l_extendedprice * 100)::BIGINT} ORDER BY l_linenumber, l_partkey, l_suppkey, round(l_extendedprice * 100)) AS lines FROM lineitem GROUP BY l_orderkey)"
_BARE = """'{"case_id":"k' || o_orderkey || '","lines":[' || array_to_string(list_transform(lines, lambda x: '{"line_no":' || x.n || ',"next":['), '') || array_to_string(list_transform(list_reverse(lines), lambda x: '],"supplier":{"paid_cents":' || x.c || '}}'), '') || '],"priority":"' || o_orderpriority || '"}'"""


@query(f"""SELECT o_orderkey, (2 * len(lines) + 2)::INTEGER AS depth, 'sha256:' || sha256({_BARE}) AS bare_hash,
 (SELECT string_agg(DISTINCT x, ',' ORDER BY x) FROM (SELECT unnest(flatten([['k' || o_orderkey], list_transform(lines, lambda l: 'p' || l.p), list_transform(lines, lambda l: 's' || l.s)])) AS x)) AS ids FROM orders JOIN {_CHAIN_ROWS} ON o_orderkey = l_orderkey""")
def q_private_deep(spark, sf_dir):
    """Orders with their lines nested in one another: canonical digests without private ids at any level, and the ids."""
    rows = W.with_private_apart(chained(spark, sf_dir), "v", ("case_id",), "depth")
    return rows.select("o_orderkey", "depth", W.record_hash(F.col("v")).alias("bare_hash"), F.array_join("private_ids", ",").alias("ids"))


@query(f"""WITH s AS (SELECT DISTINCT o_orderkey, unnest(flatten([['k' || o_orderkey, {norm('o_orderpriority')}], flatten(list_transform(lines, lambda l: [l.n::VARCHAR, 'p' || l.p, 's' || l.s, l.c::VARCHAR, (l.c // 100) || '.' || lpad((l.c % 100)::VARCHAR, 2, '0'), format('{{:,}}', l.c // 100) || '.' || lpad((l.c % 100)::VARCHAR, 2, '0')]))])) AS fact FROM orders JOIN {_CHAIN_ROWS} ON o_orderkey = l_orderkey)
 SELECT fact, count(*) AS n FROM s GROUP BY fact""")
def q_scalar_facts_deep(spark, sf_dir):
    """Every scalar of orders of any number of lines, at whatever depth, with the orders that hold it."""
    return _holders(spark, sf_dir, chained(spark, sf_dir))
