"""The whole metric suite of a router: heads, exposed decisions, pairs, trajectories and held-out rows.

``rows`` has, per example, a key, the banking probability ``p``, five relation scores
``relations``, a score array per head (``domain, lane, family, intent, action, entity``), and
the truth: ``domain_label`` (0 or 1), ``relation_labels``, an index per head (``intent_index``
is -1 for none), ``kind`` and ``pair_id``. Metrics are two aggregations over the judged rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.functions import numbers as N
from sievework.functions.numbers import ratio_or_zero
from sievework.operators import metrics as M
from sievework.operators.decode import HEADS, joint_decode
from sievework.plans import dims

# Kinds of examples, and thresholds of routes and relations.
RESUME, HELDOUT = "resume_previous_service", "heldout_screenshot_regression"
SOCIAL, POLICY = "heldout_social_generalization", "heldout_policy_followup_generalization"
STATE_KINDS = (POLICY, SOCIAL, "state_intent_switch", "state_ood_detour", "state_policy_followup", "state_social_detour", "state_orphan_resume")
OOD, IN_DOMAIN, RESCUE_AT, RELATION_AT = 0.45, 0.50, 0.40, 0.5
# What a release needs of each metric, at least or at most.
AT_LEAST = {
    "domain_macro_f1": 0.85, "lane_macro_f1": 0.85, "family_macro_f1": 0.85, "intent_macro_f1": 0.85, "relation_macro_f1": 0.85, "action_macro_f1": 0.85,
    "entity_resolution_macro_f1": 0.85, "exposed_action_macro_f1": 0.85, "exposed_entity_resolution_macro_f1": 0.85,
    "counterfactual_action_accuracy": 0.95, "counterfactual_entity_resolution_accuracy": 0.95, "counterfactual_pair_flip_accuracy": 0.95,
}
AT_MOST = {
    "hierarchy_compatibility_error_rate": 0.0, "in_domain_false_refusal_rate": 0.02, "ood_false_accept_rate": 0.05, "contextual_false_refusal_rate": 0.02, "repair_false_refusal_rate": 0.01,
    "topic_shift_ood_false_accept_rate": 0.05, "trajectory_resume_intent_error_rate": 0.0, "trajectory_resume_relation_error_rate": 0.0, "trajectory_state_route_error_rate": 0.0,
    "trajectory_state_intent_error_rate": 0.0, "trajectory_non_resume_false_positive_rate": 0.0, "trajectory_runtime_transition_error_rate": 0.0,
    "heldout_social_generalization_error_rate": 0.0, "heldout_policy_followup_generalization_error_rate": 0.0,
    "heldout_regression_route_error_rate": 0.0, "heldout_regression_intent_error_rate": 0.0, "heldout_regression_relation_error_rate": 0.0,
}
CLASSES = {"intent": dims.INTENTS, "domain": dims.DOMAINS, "lane": dims.LANES, "family": dims.FAMILIES, "action": dims.ACTIONS, "entity": dims.ENTITIES}
EXECUTE, CLARIFY = dims.ACTIONS.index("execute_tool"), dims.ACTIONS.index("clarify")
_RELATION = {name: i for i, name in enumerate(dims.RELATIONS)}
_INDEXES = ("intent", "domain", "lane", "family", "action", "entity")


def one_hot(index: Column, classes: int) -> Column:
    """A score array that is 1 at an index: what a head is worth of which only the decision is known."""
    return F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda i: (i == index).cast("double"))


def rescue(relations: Column) -> Column:
    """The greatest score of a relation that keeps an utterance in the domain; a shift of topic doesn't."""
    return F.greatest(*(F.get(relations, F.lit(i)) for name, i in _RELATION.items() if name != "topic_shift"))


def transition_matches(kind: Column, route: Column, exposed: Column, expected: Column, resume: Column) -> Column:
    """Whether the dialogue state would act on an example as it should: a resumption resumes, a detour out of the domain stays out, others go in without resuming."""
    inside = (route == "in_domain") & exposed.eqNullSafe(expected)
    return F.when(kind == RESUME, inside & resume).when(kind == "state_ood_detour", (route == "out_of_domain") & ~resume).otherwise(inside & ~resume)


def judged(rows: DataFrame, legal: DataFrame, key: str, ood: float = OOD, in_domain: float = IN_DOMAIN, rescue_at: float = RESCUE_AT, relation_at: Sequence[float] = (RELATION_AT,) * 5) -> DataFrame:
    """``rows`` with the heads' own decisions (``said_*``), ``route`` and what is shown (``shown_*``, -1 for nothing), and flags of both."""
    decided = joint_decode(rows, legal, key).select(F.col(key).alias("__key"), *(F.col(f"{h}_index").alias(f"best_{h}") for h in _INDEXES))
    said = {f"said_{h}": N.argmax(F.col(h)).cast("int") for h in HEADS}
    first = M.route(F.col("p"), rescue(F.col("relations")), ood, rescue_at, in_domain)
    both = rows.withColumns({**said, "first_route": first}).join(decided, F.col(key) == F.col("__key")).drop("__key")
    route = F.when((F.col("first_route") == "in_domain") & (F.col("best_domain") == 0), "uncertain").when(F.col("first_route") == "uncertain", "uncertain").otherwise(F.col("first_route"))
    raw = {h: F.when(F.col("said_domain") == 0, F.lit(-1)).otherwise(F.col("said_intent")) if h == "intent" else F.col(f"said_{h}") for h in _INDEXES}
    tuples = legal.agg(F.collect_list(F.struct(*(F.col(f"{h}_index").cast("int").alias(h) for h in _INDEXES))).alias("legal"))  # one row of 49
    own = F.struct(*(raw[h].cast("int").alias(h) for h in _INDEXES))
    best = F.struct(*(F.when(F.col("best_domain") == 0, F.lit(-1)).otherwise(F.col("best_intent")).cast("int").alias(h) if h == "intent" else F.col(f"best_{h}").cast("int").alias(h) for h in _INDEXES))
    flagged = both.crossJoin(F.broadcast(tuples)).withColumns({"route": route, "incompatible": ~F.array_contains("legal", own), "disagrees": own != best}).drop("legal")
    seen = lambda h, out: F.when(F.col("route") == "in_domain", F.col(f"best_{h}")).when(F.col("route") == "out_of_domain", F.lit(out)).otherwise(F.lit(-1)).cast("int")
    active = F.transform("relations", lambda r, i: r >= F.get(F.array(*map(F.lit, relation_at)), i))
    return flagged.withColumns({"accepted": F.col("route") == "in_domain", "shown_intent": seen("intent", -1), "shown_action": seen("action", 0), "shown_entity": seen("entity", 0), "active": active})


def _rates() -> dict[str, tuple]:
    c, on = F.col, lambda name: F.get(F.col("relation_labels"), F.lit(_RELATION[name])) == 1
    inside, outside = c("domain_label") == 1, c("domain_label") == 0
    every, meant = F.lit(True), c("intent_index") >= 0
    resume_on, resume = F.get("active", F.lit(_RELATION[RESUME])), c("kind") == RESUME
    state, heldout, pair = c("kind").isin(*STATE_KINDS), c("kind") == HELDOUT, F.coalesce(c("pair_id"), F.lit("")) != ""
    wrong_intent = c("shown_intent") != c("intent_index")
    wrong_route = c("route") != F.when(inside, "in_domain").otherwise("out_of_domain")
    expected = F.when(meant, c("intent_index"))
    moved = transition_matches(c("kind"), c("route"), F.when(c("shown_intent") >= 0, c("shown_intent")), expected, resume_on)
    wrong_relation = F.exists(F.zip_with("active", "relation_labels", lambda a, y: a != (y == 1)), lambda x: x)
    made = {
        "in_domain_false_refusal_rate": (inside, ~c("accepted")), "ood_false_accept_rate": (outside, c("accepted")),
        "hierarchy_compatibility_error_rate": (every, F.lit(False)), "raw_independent_head_incompatibility_rate": (every, c("incompatible")), "joint_decoder_disagreement_rate": (every, c("disagrees")),
        "counterfactual_action_accuracy": (pair, c("shown_action") == c("action_index")), "counterfactual_entity_resolution_accuracy": (pair, c("shown_entity") == c("entity_index")),
        "contextual_false_refusal_rate": (inside & on("context_dependent"), ~c("accepted")), "repair_false_refusal_rate": (inside & on("agent_repair"), ~c("accepted")),
        "topic_shift_ood_false_accept_rate": (outside & on("topic_shift"), c("accepted")),
        "trajectory_resume_intent_error_rate": (resume & meant, wrong_intent), "trajectory_resume_relation_error_rate": (resume, ~c("accepted") | (resume_on != on(RESUME))),
        "trajectory_state_route_error_rate": (state, wrong_route), "trajectory_state_intent_error_rate": (state & meant, wrong_intent), "trajectory_non_resume_false_positive_rate": (state, resume_on),
        "trajectory_runtime_transition_error_rate": (resume | state, ~moved),
        "heldout_social_generalization_error_rate": (c("kind") == SOCIAL, ~moved), "heldout_policy_followup_generalization_error_rate": (c("kind") == POLICY, ~moved),
        "heldout_regression_route_error_rate": (heldout, c("accepted") != inside), "heldout_regression_intent_error_rate": (heldout & meant, wrong_intent), "heldout_regression_relation_error_rate": (heldout, wrong_relation),
    }
    counts = {"rows": every, "exposed_decision_rows": every, "intent_rows": meant, "counterfactual_rows": pair, "trajectory_resume_rows": resume, "trajectory_state_negative_rows": state, "heldout_regression_rows": heldout}
    return {**{k: (*v, 0.0) for k, v in made.items()}, **{k: (every, v, 0.0) for k, v in counts.items()}}


def _classes() -> Column:
    """What each row adds to the classes of every head: ``name, class, tp, fp, fn``."""
    names = {"entity": "entity_resolution"}
    pairs = [(f"{names.get(h, h)}_macro_f1", f"said_{h}", f"{h}_index") for h in _INDEXES] + [(f"exposed_{names.get(h, h)}_macro_f1", f"shown_{h}", f"{h}_index") for h in ("action", "entity")]
    part = lambda name, k, tp, fp, fn: F.struct(F.lit(name).alias("name"), k.cast("int").alias("class"), tp.cast("long").alias("tp"), fp.cast("long").alias("fp"), fn.cast("long").alias("fn"))
    none, parts = F.lit(False), []
    for name, said, truth in pairs:
        hit, told = F.col(said) == F.col(truth), F.col(truth) >= 0 if name == "intent_macro_f1" else F.lit(True)
        parts += [F.when(told, part(name, F.col(truth), hit, none, ~hit)), F.when(told, part(name, F.col(said), none, ~hit, none))]
    for i in range(len(dims.RELATIONS)):
        a, y = F.get("active", F.lit(i)), F.get("relation_labels", F.lit(i)) == 1
        parts.append(part("relation_macro_f1", F.lit(i), a & y, a & ~y, ~a & y))
    return F.explode(F.array_compact(F.array(*parts)))


def evaluate(rows: DataFrame) -> DataFrame:
    """All metrics of judged rows: ``name, numerator, denominator, score``; a rate of no rows is 0, as is a mean F1 of no class."""
    rates = M.suite(rows, _rates())
    per = rows.select(_classes().alias("c")).select("c.*").where("class >= 0").groupBy("name", "class").agg(*(F.sum(k).alias(k) for k in ("tp", "fp", "fn")))
    used = F.when(2 * F.col("tp") + F.col("fp") + F.col("fn") > 0, M.f1(F.col("tp"), F.col("fp"), F.col("fn")))
    means = per.groupBy("name").agg(F.sum("tp").alias("numerator"), F.count(used).alias("denominator"), F.coalesce(F.avg(used), F.lit(0.0)).alias("score"))
    right = (F.col("shown_action") == F.col("action_index")) & (F.col("shown_entity") == F.col("entity_index"))
    pairs = rows.where("coalesce(pair_id, '') <> ''").groupBy("pair_id").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set("action_index")).alias("t"), F.bool_and(right).alias("both"))
    told = pairs.where((F.col("n") == 2) & (F.col("t") == F.array(F.lit(EXECUTE), F.lit(CLARIFY))))
    flips = told.agg(F.lit("counterfactual_pair_flip_accuracy").alias("name"), F.count_if("both").alias("numerator"), F.count(F.lit(1)).alias("denominator"))
    return rates.unionByName(means).unionByName(flips.withColumn("score", ratio_or_zero(F.col("numerator"), F.col("denominator"))))


def state_metrics_by_kind(rows: DataFrame) -> DataFrame:
    """Route, intent and resumption errors of each kind of state example that occurs."""
    rates = _rates()
    wanted = {"route_error_rate": "trajectory_state_route_error_rate", "intent_error_rate": "trajectory_state_intent_error_rate", "resume_false_positive_rate": "trajectory_non_resume_false_positive_rate"}
    return M.suite(rows.where(F.col("kind").isin(*STATE_KINDS)), {k: rates[v] for k, v in wanted.items()}, ["kind"])


def gates(spark: SparkSession) -> DataFrame:
    """The release's gates as rows ``name, op, threshold``."""
    return dims.rows(spark, "name string, op string, threshold double", [*((k, ">=", v) for k, v in AT_LEAST.items()), *((k, "<=", v) for k, v in AT_MOST.items())])


def release_failures(metrics: DataFrame) -> DataFrame:
    """The gates that metrics of :func:`evaluate` miss. A rate of no rows is 0, so a gate fails by its threshold alone."""
    return M.gate_failures(metrics.withColumn("denominator", F.greatest("denominator", F.lit(1))), gates(metrics.sparkSession))
