"""Classifier metrics, calibration and release gates.

Every suite is one aggregation over rows; thresholds and classes are small fixed tables
that rows meet by array or broadcast, so a metric never costs a pass of its own.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sievework.functions.numbers import close, ratio_or_null, ratio_or_zero


def confusion(rows: DataFrame, predicted: Column, actual: Column, by: Sequence[str] = ()) -> DataFrame:
    n = lambda c: F.count_if(c).alias
    return rows.groupBy(*by).agg(
        n(predicted & actual)("true_positive"),
        n(predicted & ~actual)("false_positive"),
        n(~predicted & ~actual)("true_negative"),
        n(~predicted & actual)("false_negative"),
        n(actual)("positive"),
        n(~actual)("negative"),
    )


def f1(tp: Column, fp: Column, fn: Column) -> Column:
    return ratio_or_zero(F.lit(2.0) * tp, 2 * tp + fp + fn)


def per_class(rows: DataFrame, predicted: str, actual: str) -> DataFrame:
    """True and false positives and false negatives of each class seen in either column."""
    hit = F.col(predicted).eqNullSafe(F.col(actual))
    parts = F.array(
        F.struct(F.col(actual).alias("class"), hit.cast("long").alias("tp"), F.lit(0).cast("long").alias("fp"), (~hit).cast("long").alias("fn")),
        F.struct(F.col(predicted).alias("class"), F.lit(0).cast("long").alias("tp"), (~hit).cast("long").alias("fp"), F.lit(0).cast("long").alias("fn")),
    )
    return rows.select(F.explode(parts).alias("p")).select("p.*").where("class IS NOT NULL").groupBy("class").agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))


def macro_f1(classes: DataFrame) -> DataFrame:
    """Mean F1 of the classes with any row; 0 where there is none."""
    used = F.when(2 * F.col("tp") + F.col("fp") + F.col("fn") > 0, f1(F.col("tp"), F.col("fp"), F.col("fn")))
    return classes.agg(F.coalesce(F.avg(used), F.lit(0.0)).alias("macro_f1"), F.count(used).alias("n_classes"))


def multilabel(rows: DataFrame, predicted: str, actual: str) -> DataFrame:
    """Counts of each position of two multi-hot arrays."""
    at = rows.select(F.posexplode(F.arrays_zip(F.col(predicted).alias("p"), F.col(actual).alias("a"))).alias("class", "x")).select("class", F.col("x.p").alias("p"), F.col("x.a").alias("a"))
    return at.groupBy("class").agg(F.sum(((F.col("p") == 1) & (F.col("a") == 1)).cast("long")).alias("tp"), F.sum(((F.col("p") == 1) & (F.col("a") == 0)).cast("long")).alias("fp"), F.sum(((F.col("p") == 0) & (F.col("a") == 1)).cast("long")).alias("fn"))


def suite(rows: DataFrame, metrics: Mapping[str, tuple], by: Sequence[str] = ()) -> DataFrame:
    """Metrics ``name: (row counts, row passes[, score without rows])`` in one aggregation: ``name, numerator, denominator, score``.

    Without a third item a metric of no rows has no score; acceptance rates take 1.0.
    """
    made = [F.struct(F.lit(k).alias("name"), F.count_if(base & ok).alias("numerator"), F.count_if(base).alias("denominator"), F.lit(empty[0] if empty else None).cast("double").alias("empty")) for k, (base, ok, *empty) in metrics.items()]
    out = rows.groupBy(*by).agg(F.array(*made).alias("m")).select(*by, F.inline("m"))
    return out.withColumn("score", F.coalesce(ratio_or_null(F.col("numerator"), F.col("denominator")), "empty")).drop("empty")


def gate_failures(metrics: DataFrame, gates: DataFrame) -> DataFrame:
    """Gates (``name, op, threshold``) that a metric misses, lacks, or has no row for. A score within 1e-12 of its threshold equals it."""
    score, threshold = F.col("score"), F.col("threshold")
    equal = close(score, threshold)
    met = F.when(F.col("op") == "=", equal).when(F.col("op") == ">=", (score > threshold) | equal).when(F.col("op") == "<=", (score < threshold) | equal).otherwise((score < threshold) & ~equal)
    joined = F.broadcast(gates).join(metrics, "name", "left")
    reason = F.when(F.col("denominator").isNull(), "missing").when(F.col("denominator") < 1, "no_rows").when(~F.coalesce(met, F.lit(False)), "threshold")
    return joined.withColumn("reason", reason).where(F.col("reason").isNotNull()).select("name", "op", "threshold", "reason")


def non_finite(metrics: DataFrame, value: str = "score") -> DataFrame:
    """The metrics (``name`` and a double) that are NaN or infinite; a null is neither."""
    v = F.col(value)
    return metrics.where(F.isnan(v) | (F.abs(v) == F.lit(float("inf"))))


def pair_flips(rows: DataFrame) -> DataFrame:
    """Counterfactual pairs (``pair_id, target, correct``) with both targets, and how many are right on both."""
    pairs = rows.groupBy("pair_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("target").alias("t"), F.bool_and("correct").alias("both"))
    return pairs.where("n = 2 AND t = 2").agg(F.count(F.lit(1)).alias("pairs"), F.count_if("both").alias("flipped"), F.coalesce(F.avg(F.col("both").cast("double")), F.lit(0.0)).alias("pair_flip_accuracy"))


def class_weights(rows: DataFrame, positive: Column) -> DataFrame:
    """Weight of the positive class, clamped to 1 and 12."""
    n, pos = F.count(F.lit(1)), F.count_if(positive)
    return rows.agg(n.alias("n"), pos.alias("positive"), F.least(F.lit(12.0), F.greatest(F.lit(1.0), (n - pos) / F.greatest(pos, F.lit(1)))).alias("weight"))


def balance_weights(rows: DataFrame, label: str) -> DataFrame:
    """Weight of each label: the root of the largest count over its own, at most 20."""
    counts = rows.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("weight", F.least(F.lit(20.0), F.sqrt(F.max("n").over(Window.partitionBy()) / F.col("n"))))


def calibrate_binary(rows: DataFrame, probability: str, label: str, min_recall: float = 0.98, conversational: str | None = None, min_conversational_recall: float = 0.95) -> DataFrame:
    """The threshold i/200 of highest specificity, then balanced accuracy, then threshold, with enough recall.

    The rows that ``conversational`` marks must reach a recall of their own; without such
    rows it is 1. Rows fall into bins by the highest threshold they reach first, so thresholds
    meet bins, not rows.
    """
    p, low = F.col(probability), F.floor(F.col(probability) * 200)
    reached = F.when(p >= (low + 1) / 200, low + 1).when(p >= low / 200, low).otherwise(low - 1)
    real, talk = F.col(label) == 1, F.coalesce(F.col(conversational), F.lit(False)) if conversational else F.lit(False)
    bins = rows.groupBy(F.greatest(F.lit(-1), F.least(F.lit(200), reached)).cast("int").alias("bin")).agg(F.count_if(real).alias("p"), F.count_if(F.col(label) == 0).alias("q"), F.count_if(real & talk).alias("c"), F.count_if(talk).alias("t"))
    grid = rows.sparkSession.range(1, 200).select(F.col("id").cast("int").alias("i"))
    above = F.col("bin") >= F.col("i")
    at = grid.join(F.broadcast(bins)).groupBy("i").agg(  # at most 202 bins
        F.sum(F.when(above, F.col("p")).otherwise(0)).alias("tp"),
        F.sum(F.when(~above, F.col("q")).otherwise(0)).alias("tn"),
        F.sum(F.when(above, F.col("c")).otherwise(0)).alias("tc"),
        *(F.sum(c).alias(f"all_{c}") for c in "pqct"),
    )
    recall, spec = ratio_or_zero(F.col("tp"), F.col("all_p")), ratio_or_zero(F.col("tn"), F.col("all_q"))
    talked = F.when(F.col("all_t") == 0, F.lit(1.0)).otherwise(ratio_or_zero(F.col("tc"), F.col("all_c")))
    scored = at.select((F.col("i") / 200).alias("threshold"), recall.alias("recall"), talked.alias("conversational_recall"), spec.alias("specificity"), ((recall + spec) / 2).alias("balanced_accuracy"))
    ok = (F.col("recall") >= min_recall) & (F.col("conversational_recall") >= min_conversational_recall)
    key = F.struct(ok.alias("ok"), "specificity", "balanced_accuracy", "threshold")
    return scored.agg(F.max_by(F.struct(*scored.columns), key).alias("r")).select("r.*")


def route(p: Column, rescue: Column, ood: Column | float, rescue_at: Column | float, in_domain: float = 0.5) -> Column:
    return F.when(p >= in_domain, "in_domain").when((p < ood) & (rescue < rescue_at), "out_of_domain").otherwise("uncertain")


def calibrate_routes(rows: DataFrame) -> DataFrame:
    """The best of 8 x 3 boundaries for ``p, label, rescue, contextual, repair`` rows.

    Eligible boundaries keep recalls of .98, .98 and .99; of these, or of all if none is,
    the highest specificity wins, then recall, contextual and repair recall, the higher
    boundary, the lower rescue.
    """
    cells = F.array(*(F.struct(F.lit(o / 100).alias("ood"), F.lit(r).alias("rescue_at")) for o in range(10, 50, 5) for r in (0.4, 0.5, 0.6)))
    spread = rows.select("p", "label", "rescue", "contextual", "repair", F.explode(cells).alias("c")).select("*", "c.*")
    took = route(F.col("p"), F.col("rescue"), F.col("ood"), F.col("rescue_at")) != "out_of_domain"
    rate = lambda base, ok, empty: F.coalesce(F.count_if(base & ok) / F.nullif(F.count_if(base), F.lit(0)), F.lit(empty))
    inside = F.col("label") == 1
    table = spread.groupBy("ood", "rescue_at").agg(
        rate(inside, took, 0.0).alias("recall"),
        rate(~inside, ~took, 0.0).alias("specificity"),
        rate(inside & F.col("contextual"), took, 1.0).alias("contextual_recall"),
        rate(inside & F.col("repair"), took, 1.0).alias("repair_recall"),
    )
    ok = (F.col("recall") >= 0.98) & (F.col("contextual_recall") >= 0.98) & (F.col("repair_recall") >= 0.99)
    key = F.struct(ok.alias("ok"), "specificity", "recall", "contextual_recall", "repair_recall", "ood", (-F.col("rescue_at")).alias("low"))
    return table.agg(F.max_by(F.struct(*table.columns), key).alias("r")).select("r.*")


def _ceiling(ceilings: Mapping[str, float]) -> Column:
    out = F.lit(1.0)
    for name, value in ceilings.items():
        out = F.when(F.col("relation") == name, F.lit(value)).otherwise(out)
    return out


# Thresholds that a relation may not exceed.
CEILINGS = {"agent_repair": 0.75, "clarification_answer": 0.80}


def calibrate_relations(rows: DataFrame, tolerant: str = "context_dependent", tolerance: float = 0.005, ceilings: Mapping[str, float] = CEILINGS) -> DataFrame:
    """Threshold of each relation from ``relation, p, label`` rows: the lowest of the 19 with the best F1.

    ``tolerant`` takes the lowest whose F1 is within ``tolerance`` of the best. A relation
    with a ceiling takes that where its threshold is above.
    """
    grid = F.explode(F.array(*(F.lit(i / 100) for i in range(5, 100, 5)))).alias("threshold")
    at = rows.select("relation", "p", "label", grid)
    hit, real = F.col("p") >= F.col("threshold"), F.col("label") == 1
    scored = at.groupBy("relation", "threshold").agg(F.count_if(hit & real).alias("tp"), F.count_if(hit & ~real).alias("fp"), F.count_if(~hit & real).alias("fn"))
    scored = scored.withColumn("f1", f1(F.col("tp"), F.col("fp"), F.col("fn"))).withColumn("best", F.max("f1").over(Window.partitionBy("relation")))
    slack = F.when(F.col("relation") == tolerant, F.lit(tolerance)).otherwise(F.lit(1e-12))
    return scored.where(F.col("f1") >= F.col("best") - slack).groupBy("relation").agg(F.min("threshold").alias("threshold"), F.max("best").alias("best_f1")).withColumn("threshold", F.least("threshold", _ceiling(ceilings)))


def percentiles(values: DataFrame, value: str, shares: Sequence[float]) -> DataFrame:
    """Exact percentiles of a column, interpolated: one row with ``p``, an array.

    Distinct values are counted first and ranks come from sums over bins of the value
    range, so that no task holds all values.
    """
    counts = values.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    low, high, total = counts.agg(F.min("v"), F.max("v"), F.sum("n")).first()
    if total is None:
        return values.sparkSession.range(1).select(F.lit(None).cast("array<double>").alias("p"))
    width = (high - low) / 4096 or 1.0
    binned = counts.withColumn("b", F.floor((F.col("v") - F.lit(low)) / F.lit(width)))
    before = F.sum("m").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1))  # at most 4097 rows
    offsets = binned.groupBy("b").agg(F.sum("n").alias("m")).select("b", F.coalesce(before, F.lit(0)).alias("o"))
    upto = F.sum("n").over(Window.partitionBy("b").orderBy("v"))
    placed = binned.withColumn("s", upto).join(F.broadcast(offsets), "b").select("v", (F.col("o") + F.col("s") - F.col("n")).alias("first"), (F.col("o") + F.col("s") - 1).alias("last"))
    at = [q * (total - 1) for q in shares]
    value_at = lambda i: F.max(F.when((F.col("first") <= i) & (F.col("last") >= i), F.col("v")))
    parts = [(value_at(int(x)), value_at(min(int(x) + 1, total - 1)), x - int(x)) for x in at]
    return placed.agg(F.array(*(a + (b - a) * F.lit(f) for a, b, f in parts)).alias("p"))


def parity(rows: DataFrame, a: str, b: str, tolerance: float) -> DataFrame:
    """Differences of paired vectors: largest, mean, quantiles, share within tolerance, and agreeing maxima."""
    from sievework.functions.numbers import argmax

    same = (argmax(F.col(a)) == argmax(F.col(b))).cast("double")
    agreed = rows.agg(F.avg(same).alias("argmax_agreement"), F.count(F.lit(1)).alias("n_rows"))
    each = rows.select(F.explode(F.zip_with(a, b, lambda x, y: F.abs(x - y))).alias("d"))
    diffs = each.agg(F.max("d").alias("max_diff"), F.avg("d").alias("mean_diff"), F.avg((F.col("d") <= tolerance).cast("double")).alias("within"))
    tails = percentiles(each, "d", (0.99, 0.999)).select(F.col("p")[0].alias("p99"), F.col("p")[1].alias("p999"))
    return diffs.crossJoin(tails).crossJoin(agreed)  # one row each
