"""The router's whole metric suite over score heads made of embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.functions import numbers as N
from sievework.operators import router_suite as R
from sievework.plans import dims
from sievework.plans.registry import query
from sievework.plans.score_queries import _ARGMAX, _DECODED, _VEC, _legal_sql, vectors

_KINDS = (R.RESUME, *R.STATE_KINDS, R.HELDOUT, "standalone", "context")
# The truth of each row, as SQL that both engines read: a head's own decision where a component says so, else by the id. f0 to f9 are components.
_TRUTH = {
    "domain_label": "CASE WHEN f0 > -0.2 THEN 1 ELSE 0 END",
    "kind": f"element_at({{kinds}}, CAST(vec_id % {len(_KINDS)} + 1 AS INT))",
    "pair_id": "CASE WHEN vec_id % 3 = 0 THEN concat('pair-', CAST(floor(vec_id / 6) AS BIGINT)) ELSE '' END",
    "intent_index": "CASE WHEN f0 <= -0.2 THEN -1 WHEN f1 > 0 THEN best_intent ELSE CAST(vec_id % 12 AS INT) END",
    "domain_index": "CASE WHEN f2 > 0 THEN said_domain ELSE CAST(vec_id % 3 AS INT) END",
    "lane_index": "CASE WHEN f3 > 0 THEN said_lane ELSE CAST(vec_id % 5 AS INT) END",
    "family_index": "CASE WHEN f4 > 0 THEN said_family ELSE CAST(vec_id % 9 AS INT) END",
    "action_index": "CASE vec_id % 6 WHEN 0 THEN 1 WHEN 3 THEN 2 ELSE CASE WHEN f5 > 0 THEN best_action ELSE CAST(vec_id % 5 AS INT) END END",
    "entity_index": "CASE WHEN f6 > -0.3 THEN best_entity ELSE CAST(vec_id % 5 AS INT) END",
}


def suite_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir)
    decided = R.joint_decode(v, dims.legal_tuples(spark), "vec_id").select("vec_id", *(F.greatest(F.lit(0), F.col(f"{h}_index")).alias(f"best_{h}") for h in ("intent", "action", "entity")))
    part = lambda i: F.get("v", F.lit(i))
    told = v.join(decided, "vec_id").withColumns({f"said_{h}": N.argmax(F.col(h)).cast("int") for h in ("domain", "lane", "family")}).withColumns({f"f{i}": part(49 + i) for i in range(7)})
    kinds = "array(" + ", ".join(f"'{k}'" for k in _KINDS) + ")"
    made = told.select("vec_id", "domain", "lane", "family", "intent", "action", "entity", N.sigmoid(4 * part(56)).alias("p"), F.array(*(N.sigmoid(3 * part(57 + i) - 0.5) for i in range(5))).alias("relations"), F.array(*((part(57 + i) + part(62) / 4 > 0.1).cast("int") for i in range(5))).alias("relation_labels"), *(F.expr(sql.format(kinds=kinds)).alias(name) for name, sql in _TRUTH.items()))
    return R.judged(made, dims.legal_tuples(spark), "vec_id")


_HEAD_SQL = ", ".join(f"{_ARGMAX.format(h)} AS said_{h}" for h in ("domain", "lane", "family", "intent", "action", "entity"))
_MADE = f"""(SELECT x.*, {", ".join(f"v[{50 + i}] AS f{i}" for i in range(7))}, {_HEAD_SQL}, d.intent_index AS win_intent, greatest(0, d.intent_index) AS best_intent, d.domain_index AS best_domain, d.lane_index AS best_lane, d.family_index AS best_family, d.action_index AS best_action, d.entity_index AS best_entity FROM {_VEC} x JOIN {_DECODED} d USING (vec_id))"""
_LABELLED = f"""(SELECT *, 1.0::DOUBLE / (1.0::DOUBLE + exp(-4 * v[57])) AS p, list_transform(range(5), lambda i: 1.0::DOUBLE / (1.0::DOUBLE + exp(-(3 * v[58 + i] - 0.5)))) AS relations, list_transform(range(5), lambda i: (v[58 + i] + v[63] / 4 > 0.1)::INTEGER) AS labels,
 {", ".join(sql.format(kinds=list(_KINDS)).replace("element_at(", "list_extract(") + f" AS {name}" for name, sql in _TRUTH.items())} FROM {_MADE})"""
_FIRST = "CASE WHEN p >= 0.5 THEN 'in_domain' WHEN p < 0.45 AND greatest(relations[1], relations[2], relations[4], relations[5]) < 0.4 THEN 'out_of_domain' ELSE 'uncertain' END"
_SHOWN = "CASE route WHEN 'in_domain' THEN {0} WHEN 'out_of_domain' THEN {1} ELSE -1 END"
_JUDGED = f"""(SELECT *, route = 'in_domain' AS accepted, {_SHOWN.format('win_intent', -1)} AS shown_intent, {_SHOWN.format('best_action', 0)} AS shown_action, {_SHOWN.format('best_entity', 0)} AS shown_entity, list_transform(relations, lambda r: r >= 0.5) AS active,
 (own_intent, said_domain, said_lane, said_family, said_action, said_entity) NOT IN (SELECT (intent_index, domain_index, lane_index, family_index, action_index, entity_index) FROM {_legal_sql()}) AS incompatible,
 (own_intent, said_domain, said_lane, said_family, said_action, said_entity) <> (win_intent, best_domain, best_lane, best_family, best_action, best_entity) AS disagrees
 FROM (SELECT *, CASE WHEN said_domain = 0 THEN -1 ELSE said_intent END AS own_intent, CASE WHEN first_route = 'in_domain' AND best_domain = 0 THEN 'uncertain' ELSE first_route END AS route FROM (SELECT *, {_FIRST} AS first_route FROM {_LABELLED})))"""
_STATE = "kind IN (" + ", ".join(f"'{k}'" for k in R.STATE_KINDS) + ")"
_IN = "(accepted AND shown_intent >= 0 AND shown_intent = intent_index OR accepted AND shown_intent < 0 AND intent_index < 0)"
_MOVED = f"CASE kind WHEN '{R.RESUME}' THEN {_IN} AND active[5] WHEN 'state_ood_detour' THEN route = 'out_of_domain' AND NOT active[5] ELSE {_IN} AND NOT active[5] END"
_WRONG_ROUTE = "route <> CASE domain_label WHEN 1 THEN 'in_domain' ELSE 'out_of_domain' END"
_RATE_SQL = {
    "in_domain_false_refusal_rate": ("domain_label = 1", "NOT accepted"), "ood_false_accept_rate": ("domain_label = 0", "accepted"), "hierarchy_compatibility_error_rate": ("true", "false"),
    "raw_independent_head_incompatibility_rate": ("true", "incompatible"), "joint_decoder_disagreement_rate": ("true", "disagrees"),
    "counterfactual_action_accuracy": ("pair_id <> ''", "shown_action = action_index"), "counterfactual_entity_resolution_accuracy": ("pair_id <> ''", "shown_entity = entity_index"),
    "contextual_false_refusal_rate": ("domain_label = 1 AND labels[1] = 1", "NOT accepted"), "repair_false_refusal_rate": ("domain_label = 1 AND labels[2] = 1", "NOT accepted"), "topic_shift_ood_false_accept_rate": ("domain_label = 0 AND labels[3] = 1", "accepted"),
    "trajectory_resume_intent_error_rate": (f"kind = '{R.RESUME}' AND intent_index >= 0", "shown_intent <> intent_index"), "trajectory_resume_relation_error_rate": (f"kind = '{R.RESUME}'", "NOT accepted OR active[5] <> (labels[5] = 1)"),
    "trajectory_state_route_error_rate": (_STATE, _WRONG_ROUTE), "trajectory_state_intent_error_rate": (f"{_STATE} AND intent_index >= 0", "shown_intent <> intent_index"), "trajectory_non_resume_false_positive_rate": (_STATE, "active[5]"),
    "trajectory_runtime_transition_error_rate": (f"(kind = '{R.RESUME}' OR {_STATE})", f"NOT ({_MOVED})"), "heldout_social_generalization_error_rate": (f"kind = '{R.SOCIAL}'", f"NOT ({_MOVED})"), "heldout_policy_followup_generalization_error_rate": (f"kind = '{R.POLICY}'", f"NOT ({_MOVED})"),
    "heldout_regression_route_error_rate": (f"kind = '{R.HELDOUT}'", "accepted <> (domain_label = 1)"), "heldout_regression_intent_error_rate": (f"kind = '{R.HELDOUT}' AND intent_index >= 0", "shown_intent <> intent_index"),
    "heldout_regression_relation_error_rate": (f"kind = '{R.HELDOUT}'", "list_transform(labels, lambda y: y = 1) <> active"),
    "rows": ("true", "true"), "exposed_decision_rows": ("true", "true"), "intent_rows": ("true", "intent_index >= 0"), "counterfactual_rows": ("true", "pair_id <> ''"), "trajectory_resume_rows": ("true", f"kind = '{R.RESUME}'"), "trajectory_state_negative_rows": ("true", _STATE), "heldout_regression_rows": ("true", f"kind = '{R.HELDOUT}'"),
}
_SUM = "SELECT {by}'{name}' AS name, count(*) FILTER (({base}) AND ({ok})) AS numerator, count(*) FILTER ({base}) AS denominator FROM j{group}"
_PAIRS_SQL = [("intent_macro_f1", "said_intent", "intent_index"), ("domain_macro_f1", "said_domain", "domain_index"), ("lane_macro_f1", "said_lane", "lane_index"), ("family_macro_f1", "said_family", "family_index"), ("action_macro_f1", "said_action", "action_index"), ("entity_resolution_macro_f1", "said_entity", "entity_index"), ("exposed_action_macro_f1", "shown_action", "action_index"), ("exposed_entity_resolution_macro_f1", "shown_entity", "entity_index")]
_CLASS_SQL = " UNION ALL ".join(
    [f"SELECT '{n}' AS name, c, count(*) FILTER ({s} = c AND {t} = c) AS tp, count(*) FILTER ({s} = c AND {t} <> c) AS fp, count(*) FILTER ({s} <> c AND {t} = c) AS fn FROM j, range(12) r(c) WHERE {t if n == 'intent_macro_f1' else '0'} >= 0 GROUP BY c" for n, s, t in _PAIRS_SQL]
    + ["SELECT 'relation_macro_f1' AS name, c, count(*) FILTER (active[c + 1] AND labels[c + 1] = 1) AS tp, count(*) FILTER (active[c + 1] AND labels[c + 1] = 0) AS fp, count(*) FILTER (NOT active[c + 1] AND labels[c + 1] = 1) AS fn FROM j, range(5) r(c) GROUP BY c"]
)


_SUITE = f"""WITH j AS MATERIALIZED (SELECT * FROM {_JUDGED}), c AS ({_CLASS_SQL}), p AS (SELECT pair_id, bool_and(shown_action = action_index AND shown_entity = entity_index) AS whole FROM j WHERE pair_id <> '' GROUP BY pair_id HAVING count(*) = 2 AND list_sort(list(DISTINCT action_index)) = [1, 2])
 SELECT name, numerator, denominator, round(coalesce(numerator::DOUBLE / nullif(denominator, 0), 0), 9) AS score FROM ({" UNION ALL ".join(_SUM.format(by='', name=n, base=b, ok=o, group='') for n, (b, o) in _RATE_SQL.items())} UNION ALL SELECT 'counterfactual_pair_flip_accuracy', count(*) FILTER (whole), count(*) FROM p)
 UNION ALL SELECT name, sum(tp)::BIGINT, count(*) FILTER (2 * tp + fp + fn > 0), round(coalesce(avg(2.0::DOUBLE * tp / nullif(2 * tp + fp + fn, 0)), 0), 9) FROM c GROUP BY name"""


@query(_SUITE)
def q_router_suite(spark, sf_dir):
    """All metrics of the router: rates, counts, mean F1 of every head and of what is shown, pairs."""
    return R.evaluate(suite_rows(spark, sf_dir)).withColumn("score", F.round("score", 9))


@query(f"""SELECT name, op, threshold, 'threshold' AS reason FROM ({_SUITE}) JOIN (VALUES {", ".join([f"('{k}', '>=', {v}::DOUBLE)" for k, v in R.AT_LEAST.items()] + [f"('{k}', '<=', {v}::DOUBLE)" for k, v in R.AT_MOST.items()])}) g(name, op, threshold) USING (name)
 WHERE NOT CASE op WHEN '>=' THEN score > threshold ELSE score < threshold END AND abs(score - threshold) > 1e-12""")
def q_router_gates(spark, sf_dir):
    """The release gates that the router misses."""
    return R.release_failures(R.evaluate(suite_rows(spark, sf_dir)))


@query(f"""WITH j AS MATERIALIZED (SELECT * FROM {_JUDGED} WHERE {_STATE}) SELECT kind, name, numerator, denominator, round(coalesce(numerator::DOUBLE / nullif(denominator, 0), 0), 9) AS score FROM ({" UNION ALL ".join(_SUM.format(by='kind, ', name=n, base=b, ok=o, group=' GROUP BY kind') for n, b, o in (("route_error_rate", "true", _WRONG_ROUTE), ("intent_error_rate", "intent_index >= 0", "shown_intent <> intent_index"), ("resume_false_positive_rate", "true", "active[5]")))})""")
def q_router_states_by_kind(spark, sf_dir):
    return R.state_metrics_by_kind(suite_rows(spark, sf_dir)).withColumn("score", F.round("score", 9))
