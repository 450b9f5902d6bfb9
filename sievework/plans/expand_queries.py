"""Scenarios from templates that the parts give, with slots filled from the other tables' values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sievework.operators import expand as X
from sievework.plans.registry import query
from sievework.sources.readers import table

SLOTS = {"brand": ("brands", 1, 0), "other_brand": ("brands", 11, 3), "segment": ("segments", 7, 0), "nation": ("nations", 13, 4), "priority": ("priorities", 5, 1)}
_TEXTS = {
    "request": "concat('Please send {brand} ', lower(p_type), ' to {nation} ({unknown}), as {priority}.')",
    "known": "concat('{nation} has {brand} ', lower(p_type), ' for {segment}; take {realization} of {state}.')",
    "unknown": "concat('{nation} has {other_brand} ', lower(p_type), ' for {segment}, {brand')",
}


def made(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = lambda t, c: table(spark, sf_dir, t).agg(F.array_sort(F.collect_set(c)).alias("v"))  # noqa: E731  a few values each
    lists = values("part", "p_brand").withColumnRenamed("v", "brands")
    for name, (t, c) in {"segments": ("customer", "c_mktsegment"), "nations": ("nation", "n_name"), "priorities": ("orders", "o_orderpriority")}.items():
        lists = lists.crossJoin(values(t, c).withColumnRenamed("v", name))
    kinds = table(spark, sf_dir, "part").select("p_type").distinct()
    templates = kinds.select(F.lower(F.replace("p_type", F.lit(" "), F.lit("_"))).alias("template_id"), (F.row_number().over(Window.orderBy("p_type")) - 1).alias("ordinal"), *(F.expr(sql).alias(k) for k, sql in _TEXTS.items()))
    return X.scenarios(templates, 3 * table(spark, sf_dir, "customer").count(), SLOTS, lists, tuple(_TEXTS))


_PICK = "{0}[((seed // {1} + {2}) % len({0}) + 1)::INTEGER]"
_LISTS = "(SELECT (SELECT list_sort(list(DISTINCT p_brand)) FROM part) AS brands, (SELECT list_sort(list(DISTINCT c_mktsegment)) FROM customer) AS segments, (SELECT list_sort(list(DISTINCT n_name)) FROM nation) AS nations, (SELECT list_sort(list(DISTINCT o_orderpriority)) FROM orders) AS priorities)"
_FILLED = "replace(replace({0}, '{{state}}', lpad(state_no::VARCHAR, 4, '0')), '{{realization}}', realization::VARCHAR)"
for _name, (_of, _by, _plus) in SLOTS.items():
    _FILLED = f"replace({_FILLED}, '{{{{{_name}}}}}', {_PICK.format(_of, _by, _plus)})"
_MADE = f"""(WITH t AS (SELECT *, lower(replace(p_type, ' ', '_')) AS template_id, row_number() OVER (ORDER BY p_type) - 1 AS ordinal, (SELECT count(DISTINCT p_type) FROM part) AS n FROM (SELECT DISTINCT p_type FROM part)),
 r AS (SELECT i, i // n AS occurrence, i // n // 3 AS state_no, i // n % 3 AS realization, t.*, {", ".join(f"{sql} AS {k}_text" for k, sql in _TEXTS.items())} FROM (SELECT unnest(range(3 * (SELECT count(*) FROM customer))) AS i) x JOIN t ON t.ordinal = x.i % n),
 s AS (SELECT *, ('0x' || substr(sha256(template_id || ':' || state_no), 1, 12))::BIGINT AS seed FROM r, {_LISTS})
 SELECT CASE WHEN occurrence = 0 THEN template_id ELSE template_id || '_state_' || lpad(state_no::VARCHAR, 4, '0') || '_realization_' || realization END AS scenario_id, template_id, state_no, realization, template_id || '_state_' || lpad(state_no::VARCHAR, 4, '0') AS split_group, seed, {", ".join(f"{_FILLED.format(k + '_text')} AS {k}" for k in _TEXTS)} FROM s)"""


@query(f"SELECT * FROM {_MADE}")
def q_scenarios(spark, sf_dir):
    """Three scenarios a customer: templates by part type, slots of brands, segments, nations and priorities."""
    return made(spark, sf_dir)


@query(f"SELECT 'pair-' || substr(sha256(scenario_id), 1, 16) AS pair_id, scenario_id, request, v AS variant, CASE v WHEN 'a' THEN known ELSE unknown END AS evidence FROM {_MADE}, (VALUES ('a'), ('b')) w(v)")
def q_counterfactual_pairs(spark, sf_dir):
    """Each scenario with the evidence that meets its request, and with that which doesn't."""
    return X.counterfactual_pairs(made(spark, sf_dir), "known", "unknown").select("pair_id", "scenario_id", "request", "variant", "evidence")
