"""Joint decoding of label heads under legality constraints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEADS = ("domain", "lane", "family", "intent", "action", "entity")


def joint_decode(rows: DataFrame, legal: DataFrame, key: str) -> DataFrame:
    """The legal tuple of highest total score for each row.

    ``rows`` has a score array per head; ``legal`` is the fixed table of 49 tuples, which
    becomes an array inside each row, so rows are neither multiplied nor shuffled. Ties go
    to the safer action, then to the earlier tuple.
    """
    tuples = legal.agg(F.array_sort(F.collect_list(F.struct(*legal.columns))).alias("tuples"))  # one row of 49
    at = lambda head, i: F.get(F.col(head), i)

    def score(t: Column) -> Column:
        intent = F.when(t["intent_index"] < 0, F.array_max("intent")).otherwise(at("intent", t["intent_index"]))
        return at("domain", t["domain_index"]) + at("lane", t["lane_index"]) + at("family", t["family_index"]) + intent + at("action", t["action_index"]) + at("entity", t["entity_index"])

    ranked = F.transform("tuples", lambda t: F.struct(score(t).alias("score"), t["priority"].alias("priority"), (-t["ordinal"]).alias("neg"), t.alias("t")))
    best = rows.crossJoin(F.broadcast(tuples)).select(key, F.array_max(ranked).alias("b"))
    return best.select(key, "b.score", "b.t.intent_index", "b.t.domain_index", "b.t.lane_index", "b.t.family_index", "b.t.action_index", "b.t.entity_index")


def routed(rows: DataFrame, route: Column) -> DataFrame:
    """Decoded rows under a route: out of domain refuses, uncertain shows nothing, an out-of-domain
    tuple under an in-domain route is uncertain."""
    seen = F.when((route == "in_domain") & (F.col("intent_index") < 0), "uncertain").otherwise(route)
    shown = rows.withColumn("exposed_route", seen)
    action = F.when(F.col("exposed_route") == "out_of_domain", F.lit(0)).when(F.col("exposed_route") == "in_domain", F.col("action_index")).otherwise(F.lit(-1))
    intent = F.when(F.col("exposed_route") == "in_domain", F.col("intent_index")).otherwise(F.lit(-1))
    return shown.withColumns({"exposed_action": action.cast("int"), "exposed_intent": intent.cast("int")})
