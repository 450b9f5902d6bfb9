"""Queries over labels and score vectors: metrics, calibration, decoding, gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.functions import numbers as N
from sievework.operators import decode as D
from sievework.operators import metrics as M
from sievework.plans import dims
from sievework.plans.registry import query
from sievework.sources.readers import table

# Probabilities in these queries are hashes of ids, so that SQL has the same: 8 hex digits of a SHA-256 over 2^32.
_P = "(('0x' || substr(sha256('{0}:' || doc_id::VARCHAR), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


def _p(tag: str):
    return F.conv(F.substring(F.sha2(F.concat(F.lit(f"{tag}:"), F.col("doc_id").cast("string")), 256), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels with a probability that leans to the label, five relation scores and pair ids."""
    lean = lambda p, y: F.lit(0.6) * p + F.lit(0.4) * y
    base = table(spark, sf_dir, "labels")
    made = {f"r{i}": lean(_p(f"r{i}"), F.when(_p(f"y{i}") < 0.3, 1.0).otherwise(0.0)) for i in range(5)}
    real = {f"y{i}": F.when(_p(f"y{i}") < 0.3, 1).otherwise(0) for i in range(5)}
    return base.withColumns({"p": lean(_p("p"), F.col("quality").cast("double")), **made, **real})


_SCORED = "(SELECT *, 0.6::DOUBLE * {p} + 0.4::DOUBLE * quality::DOUBLE AS p, {r}, {y} FROM labels)".format(
    p=_P.format("p"),
    r=", ".join(f"0.6::DOUBLE * {_P.format(f'r{i}')} + 0.4::DOUBLE * CASE WHEN {_P.format(f'y{i}')} < 0.3 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS r{i}" for i in range(5)),
    y=", ".join(f"CASE WHEN {_P.format(f'y{i}')} < 0.3 THEN 1 ELSE 0 END AS y{i}" for i in range(5)),
)
_CONF = "count(*) FILTER ({p} AND {a}) AS true_positive, count(*) FILTER ({p} AND NOT {a}) AS false_positive, count(*) FILTER (NOT {p} AND NOT {a}) AS true_negative, count(*) FILTER (NOT {p} AND {a}) AS false_negative, count(*) FILTER ({a}) AS positive, count(*) FILTER (NOT {a}) AS negative"


@query(f"SELECT toxic, {_CONF.format(p='(p >= 0.5)', a='(quality = 1)')} FROM {_SCORED} GROUP BY toxic")
def q_confusion(spark, sf_dir):
    return M.confusion(scored(spark, sf_dir), F.col("p") >= 0.5, F.col("quality") == 1, ["toxic"])


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as score heads: consecutive slices of 3, 5, 9, 12, 5 and 5 components."""
    v = N.doubles(F.col("embedding"))
    cut = lambda at, n: F.slice(v, at, n)
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", "label", v.alias("v"), cut(1, 3).alias("domain"), cut(4, 5).alias("lane"), cut(9, 9).alias("family"), cut(18, 12).alias("intent"), cut(30, 5).alias("action"), cut(35, 5).alias("entity"), cut(40, 10).alias("classes"))


_VEC = "(SELECT vec_id, label, v, v[1:3] AS domain, v[4:8] AS lane, v[9:17] AS family, v[18:29] AS intent, v[30:34] AS action, v[35:39] AS entity, v[40:49] AS classes FROM (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings))"
_ARGMAX = "(list_position({0}, list_max({0})) - 1)::INTEGER"


@query(f"SELECT label AS class, predicted, count(*) AS n FROM (SELECT label, {_ARGMAX.format('classes')} AS predicted FROM {_VEC}) GROUP BY label, predicted")
def q_class_confusion(spark, sf_dir):
    return vectors(spark, sf_dir).select(F.col("label").alias("class"), N.argmax(F.col("classes")).alias("predicted")).groupBy("class", "predicted").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH x AS (SELECT label, {_ARGMAX.format('classes')} AS p FROM {_VEC}), c AS (SELECT class, count(*) FILTER (p = class AND label = class) AS tp, count(*) FILTER (p = class AND label <> class) AS fp, count(*) FILTER (p <> class AND label = class) AS fn
 FROM x, (SELECT DISTINCT label AS class FROM x UNION SELECT DISTINCT p FROM x) GROUP BY class) SELECT round(avg(2.0::DOUBLE * tp / (2 * tp + fp + fn)), 9) AS macro_f1, count(*) AS n_classes FROM c WHERE 2 * tp + fp + fn > 0""")
def q_macro_f1(spark, sf_dir):
    x = vectors(spark, sf_dir).select("label", N.argmax(F.col("classes")).alias("p"))
    return M.macro_f1(M.per_class(x, "p", "label")).select(F.round("macro_f1", 9).alias("macro_f1"), "n_classes")


_MULTI = " UNION ALL ".join(f"SELECT {i} AS class, count(*) FILTER (r{i} >= 0.5 AND y{i} = 1) AS tp, count(*) FILTER (r{i} >= 0.5 AND y{i} = 0) AS fp, count(*) FILTER (r{i} < 0.5 AND y{i} = 1) AS fn FROM {_SCORED}" for i in range(5))


@query(f"SELECT class, tp, fp, fn, CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE 2.0::DOUBLE * tp / (2 * tp + fp + fn) END AS f1 FROM ({_MULTI})")
def q_multilabel_f1(spark, sf_dir):
    rows = scored(spark, sf_dir).select(F.array(*(F.when(F.col(f"r{i}") >= 0.5, 1).otherwise(0) for i in range(5))).alias("p"), F.array(*(F.col(f"y{i}") for i in range(5))).alias("a"))
    return M.multilabel(rows, "p", "a").withColumn("f1", M.f1(F.col("tp"), F.col("fp"), F.col("fn")))


_RESCUE = "greatest(r0, r1, r3, r4)"
_ROUTE = "CASE WHEN p >= 0.5 THEN 'in_domain' WHEN p < {0} AND {2} < {1} THEN 'out_of_domain' ELSE 'uncertain' END"


def _rescue():
    return F.greatest("r0", "r1", "r3", "r4")


@query(f"SELECT doc_id, {_ROUTE.format('0.3', '0.5', _RESCUE)} AS route, round({_RESCUE}, 12) AS rescue FROM {_SCORED}")
def q_route(spark, sf_dir):
    return scored(spark, sf_dir).select("doc_id", M.route(F.col("p"), _rescue(), 0.3, 0.5).alias("route"), F.round(_rescue(), 12).alias("rescue"))


def _suite_rows(spark, sf_dir) -> DataFrame:
    rows = scored(spark, sf_dir).withColumn("route", M.route(F.col("p"), _rescue(), 0.3, 0.5))
    return rows.withColumn("kind", F.when(F.col("y1") == 1, "repair").when(F.col("y0") == 1, "context").otherwise("plain"))


def _suite(rows: DataFrame, by=()) -> DataFrame:
    real, refused, taken = F.col("quality") == 1, F.col("route") == "out_of_domain", F.col("route") == "in_domain"
    return M.suite(
        rows,
        {
            "acceptance": (F.lit(True), taken, 1.0),
            "in_domain_recall": (real, taken),
            "in_domain_false_refusal": (real, refused),
            "ood_false_accept": (~real, taken),
            "contextual_false_refusal": (real & (F.col("y0") == 1), refused),
            "repair_false_refusal": (real & (F.col("y1") == 1), refused),
            "toxic_accept": (F.col("toxic") == 1, taken),
            "never": (F.col("quality") > 5, taken),
            "never_acceptance": (F.col("quality") > 5, taken, 1.0),
        },
        by,
    )


_SUITE_ROWS = f"(SELECT *, {_ROUTE.format('0.3', '0.5', _RESCUE)} AS route, CASE WHEN y1 = 1 THEN 'repair' WHEN y0 = 1 THEN 'context' ELSE 'plain' END AS kind FROM {_SCORED})"
_BASES = {
    "acceptance": ("true", "route = 'in_domain'"), "in_domain_recall": ("quality = 1", "route = 'in_domain'"), "in_domain_false_refusal": ("quality = 1", "route = 'out_of_domain'"),
    "ood_false_accept": ("quality <> 1", "route = 'in_domain'"), "contextual_false_refusal": ("quality = 1 AND y0 = 1", "route = 'out_of_domain'"),
    "repair_false_refusal": ("quality = 1 AND y1 = 1", "route = 'out_of_domain'"), "toxic_accept": ("toxic = 1", "route = 'in_domain'"), "never": ("quality > 5", "route = 'in_domain'"), "never_acceptance": ("quality > 5", "route = 'in_domain'"),
}


def _suite_sql(by: str = "") -> str:
    extra, group = (f"{by}, ", f" GROUP BY {by}") if by else ("", "")
    parts = " UNION ALL ".join(f"SELECT {extra}'{k}' AS name, count(*) FILTER ({b} AND {ok}) AS numerator, count(*) FILTER ({b}) AS denominator FROM {_SUITE_ROWS}{group}" for k, (b, ok) in _BASES.items())
    return f"SELECT *, coalesce(numerator / nullif(denominator, 0), CASE WHEN name LIKE '%acceptance' THEN 1.0::DOUBLE END) AS score FROM ({parts})"


@query(_suite_sql())
def q_slice_rates(spark, sf_dir):
    return _suite(_suite_rows(spark, sf_dir))


@query(_suite_sql("kind"))
def q_metric_suite_by_kind(spark, sf_dir):
    return _suite(_suite_rows(spark, sf_dir), ["kind"])


_GATES = (("acceptance", ">=", 0.2), ("in_domain_recall", ">=", 0.98), ("in_domain_false_refusal", "<=", 0.02), ("ood_false_accept", "<=", 0.05), ("toxic_accept", "<", 0.9), ("never", "=", 1.0), ("unheard_of", "=", 0.0))


@query(f"""SELECT g.name, op, threshold, reason FROM (SELECT g.*, CASE WHEN denominator IS NULL THEN 'missing' WHEN denominator < 1 THEN 'no_rows' WHEN NOT coalesce(CASE op WHEN '=' THEN score = threshold WHEN '>=' THEN score >= threshold WHEN '<=' THEN score <= threshold ELSE score < threshold END, false) THEN 'threshold' END AS reason
 FROM (VALUES {", ".join(f"('{a}', '{b}', {c}::DOUBLE)" for a, b, c in _GATES)}) g(name, op, threshold) LEFT JOIN ({_suite_sql()}) m USING (name)) g WHERE reason IS NOT NULL""")
def q_release_gates(spark, sf_dir):
    gates = dims.rows(spark, "name string, op string, threshold double", _GATES)
    return M.gate_failures(_suite(_suite_rows(spark, sf_dir)), gates)


@query(f"""SELECT count(*) AS pairs, count(*) FILTER (b) AS flipped, coalesce(avg(b::INTEGER::DOUBLE), 0.0) AS pair_flip_accuracy FROM (SELECT doc_id // 4 AS pair_id, count(*) AS n, count(DISTINCT quality) AS t, bool_and((p >= 0.5) = (quality = 1)) AS b FROM {_SCORED} GROUP BY doc_id // 4) WHERE n = 2 AND t = 2""")
def q_pair_flip(spark, sf_dir):
    rows = scored(spark, sf_dir).select(F.floor(F.col("doc_id") / 4).alias("pair_id"), F.col("quality").alias("target"), ((F.col("p") >= 0.5) == (F.col("quality") == 1)).alias("correct"))
    return M.pair_flips(rows)


@query(f"SELECT count(*) AS n, count(*) FILTER (toxic = 1) AS positive, least(12.0::DOUBLE, greatest(1.0::DOUBLE, count(*) FILTER (toxic <> 1) / greatest(count(*) FILTER (toxic = 1), 1))) AS weight FROM labels")
def q_class_weights(spark, sf_dir):
    return M.class_weights(table(spark, sf_dir, "labels"), F.col("toxic") == 1)


@query("SELECT source, n, least(20.0::DOUBLE, sqrt(max(n) OVER () / n)) AS weight FROM (SELECT source, count(*) AS n FROM documents GROUP BY source)")
def q_balance_weights(spark, sf_dir):
    return M.balance_weights(table(spark, sf_dir, "documents"), "source")


@query(f"SELECT toxic, round(sum(w * p) / greatest(sum(w), 1.0), 9) AS weighted_mean, sum(w)::DOUBLE AS weight FROM (SELECT *, greatest(CASE WHEN y4 = 1 THEN 3 ELSE 1 END, CASE WHEN y2 = 1 THEN 2 ELSE 1 END)::DOUBLE AS w FROM {_SCORED}) GROUP BY toxic")
def q_row_weights(spark, sf_dir):
    w = F.greatest(F.when(F.col("y4") == 1, 3).otherwise(1), F.when(F.col("y2") == 1, 2).otherwise(1)).cast("double")
    rows = scored(spark, sf_dir).withColumn("w", w)
    return rows.groupBy("toxic").agg(F.round(F.sum(F.col("w") * F.col("p")) / F.greatest(F.sum("w"), F.lit(1.0)), 9).alias("weighted_mean"), F.sum("w").alias("weight"))


_EDGES = f"(SELECT CASE WHEN doc_id % 4 = 0 THEN round(p * 200) / 200 ELSE p END AS p, quality, y0 = 1 AS talk FROM {_SCORED})"


@query(f"""WITH a AS (SELECT i, count(*) FILTER (p >= i / 200 AND quality = 1) AS tp, count(*) FILTER (p < i / 200 AND quality = 0) AS tn, count(*) FILTER (p >= i / 200 AND quality = 1 AND talk) AS tc, count(*) FILTER (quality = 1) AS pos, count(*) FILTER (quality = 0) AS neg, count(*) FILTER (quality = 1 AND talk) AS tpos, count(*) FILTER (talk) AS t FROM {_EDGES}, range(1, 200) g(i) GROUP BY i),
 s AS (SELECT i / 200 AS threshold, coalesce(tp / nullif(pos, 0), 0.0) AS recall, CASE WHEN t = 0 THEN 1.0 ELSE coalesce(tc / nullif(tpos, 0), 0.0) END AS conversational_recall, coalesce(tn / nullif(neg, 0), 0.0) AS specificity FROM a)
 SELECT threshold, recall, conversational_recall, specificity, (recall + specificity) / 2 AS balanced_accuracy FROM s ORDER BY recall >= 0.98 AND conversational_recall >= 0.95 DESC, specificity DESC, (recall + specificity) / 2 DESC, threshold DESC LIMIT 1""")
def q_calibrate_binary(spark, sf_dir):
    """A quarter of the probabilities stand on a threshold, where bins and comparisons could disagree."""
    rows = scored(spark, sf_dir).withColumn("p", F.when(F.col("doc_id") % 4 == 0, F.round(F.col("p") * 200) / 200).otherwise(F.col("p"))).withColumn("talk", F.col("y0") == 1)
    return M.calibrate_binary(rows, "p", "quality", conversational="talk")


@query(f"""WITH x AS (SELECT p, quality AS label, {_RESCUE} AS rescue, y0 = 1 AS contextual, y1 = 1 AS repair FROM {_SCORED}),
 t AS (SELECT o / 100 AS ood, r AS rescue_at, coalesce(count(*) FILTER (label = 1 AND took) / nullif(count(*) FILTER (label = 1), 0), 0.0) AS recall, coalesce(count(*) FILTER (label <> 1 AND NOT took) / nullif(count(*) FILTER (label <> 1), 0), 0.0) AS specificity,
 coalesce(count(*) FILTER (label = 1 AND contextual AND took) / nullif(count(*) FILTER (label = 1 AND contextual), 0), 1.0) AS contextual_recall, coalesce(count(*) FILTER (label = 1 AND repair AND took) / nullif(count(*) FILTER (label = 1 AND repair), 0), 1.0) AS repair_recall
 FROM (SELECT *, NOT (p < 0.5 AND p < o / 100 AND rescue < r) AS took FROM x, range(10, 50, 5) a(o), (VALUES (0.4::DOUBLE), (0.5::DOUBLE), (0.6::DOUBLE)) b(r)) GROUP BY o, r)
 SELECT * FROM t ORDER BY recall >= 0.98 AND contextual_recall >= 0.98 AND repair_recall >= 0.99 DESC, specificity DESC, recall DESC, contextual_recall DESC, repair_recall DESC, ood DESC, rescue_at LIMIT 1""")
def q_calibrate_grid(spark, sf_dir):
    return M.calibrate_routes(scored(spark, sf_dir).select("p", F.col("quality").alias("label"), _rescue().alias("rescue"), (F.col("y0") == 1).alias("contextual"), (F.col("y1") == 1).alias("repair")))


_REL_ROWS = " UNION ALL ".join(f"SELECT '{name}' AS relation, r{i} AS p, y{i} AS label FROM {_SCORED}" for i, name in enumerate(dims.RELATIONS))


@query(f"""WITH s AS (SELECT relation, i / 100 AS threshold, count(*) FILTER (p >= i / 100 AND label = 1) AS tp, count(*) FILTER (p >= i / 100 AND label = 0) AS fp, count(*) FILTER (p < i / 100 AND label = 1) AS fn FROM ({_REL_ROWS}), range(5, 100, 5) g(i) GROUP BY relation, i),
 f AS (SELECT *, CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE 2.0::DOUBLE * tp / (2 * tp + fp + fn) END AS f1 FROM s), m AS (SELECT *, max(f1) OVER (PARTITION BY relation) AS best FROM f)
 SELECT relation, least(min(threshold), CASE relation WHEN 'agent_repair' THEN 0.75::DOUBLE WHEN 'clarification_answer' THEN 0.8::DOUBLE ELSE 1.0::DOUBLE END) AS threshold, max(best) AS best_f1 FROM m WHERE f1 >= best - CASE relation WHEN 'context_dependent' THEN 0.005::DOUBLE ELSE 1e-12::DOUBLE END GROUP BY relation""")
def q_calibrate_relation(spark, sf_dir):
    """Relations of scores; a ceiling binds where the best threshold is above it (see the tests)."""
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("relation"), F.col(f"r{i}").alias("p"), F.col(f"y{i}").alias("label")) for i, n in enumerate(dims.RELATIONS)))).alias("e")
    return M.calibrate_relations(scored(spark, sf_dir).select(each).select("e.*"))


@query(f"""WITH e AS (SELECT vec_id, list_transform(classes, lambda x: exp(x - list_max(classes))) AS p, classes FROM {_VEC})
 SELECT vec_id, {_ARGMAX.format('classes')} AS predicted, round(list_max(p) / list_sum(p), 9) AS top_probability, array_to_string(list_transform(list_sort(list_transform(range(1, 11), lambda i: {{'n': -classes[i], 'i': i - 1}}))[1:3], lambda s: s.i), ',') AS top3 FROM e""")
def q_softmax_top3(spark, sf_dir):
    v = vectors(spark, sf_dir)
    top = F.array_join(F.transform(N.top_positions(F.col("classes"), 3), lambda i: i.cast("string")), ",")
    return v.select("vec_id", N.argmax(F.col("classes")).alias("predicted"), F.round(F.array_max(N.softmax(F.col("classes"))), 9).alias("top_probability"), top.alias("top3"))


def _legal_sql() -> str:
    made = [(-1, 0, 0, 0, 0, 0)]
    for i, (name, (d, ln, f, _)) in enumerate(dims.INTENTS.items()):
        pairs = [(3, 0)] if ln == "policy" else [(4, 0)] if ln != "servicing" else [(1, 1 if name in dims.NEEDS_ENTITY else 0), (2, 2), (2, 3), (4, 0), (4, 4)]
        made += [(i, dims.DOMAINS.index(d), dims.LANES.index(ln), dims.FAMILIES.index(f), a, e) for a, e in pairs]
    return "(VALUES " + ", ".join(str((n, *t, (3, 1, 3, 2, 2)[t[4]])) for n, t in enumerate(made)) + ") l(ordinal, intent_index, domain_index, lane_index, family_index, action_index, entity_index, priority)"


_DECODED = f"""(SELECT vec_id, score, intent_index, domain_index, lane_index, family_index, action_index, entity_index FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, priority DESC, ordinal) AS r FROM (
 SELECT vec_id, l.*, domain[domain_index + 1] + lane[lane_index + 1] + family[family_index + 1] + CASE WHEN intent_index < 0 THEN list_max(intent) ELSE intent[intent_index + 1] END + action[action_index + 1] + entity[entity_index + 1] AS score FROM {_VEC}, {_legal_sql()})) WHERE r = 1)"""


@query(f"SELECT * REPLACE (round(score, 9) AS score) FROM {_DECODED}")
def q_joint_decode(spark, sf_dir):
    found = D.joint_decode(vectors(spark, sf_dir), dims.legal_tuples(spark), "vec_id")
    return found.withColumn("score", F.round("score", 9))


_VROUTE = "CASE WHEN 1.0 / (1.0 + exp(-v[50])) >= 0.5 THEN 'in_domain' WHEN 1.0 / (1.0 + exp(-v[50])) < 0.48 THEN 'out_of_domain' ELSE 'uncertain' END"


@query(f"""SELECT exposed_route, count(*) AS n, count(*) FILTER (intent_index <> argmax_intent) AS disagree, count(*) FILTER (exposed_action >= 0) AS n_action FROM (SELECT *, CASE exposed_route WHEN 'out_of_domain' THEN 0 WHEN 'in_domain' THEN action_index ELSE -1 END AS exposed_action FROM (
 SELECT d.*, {_ARGMAX.format('intent')} AS argmax_intent, CASE WHEN {_VROUTE} = 'in_domain' AND intent_index < 0 THEN 'uncertain' ELSE {_VROUTE} END AS exposed_route FROM {_DECODED} d JOIN {_VEC} x USING (vec_id))) GROUP BY exposed_route""")
def q_decode_disagreement(spark, sf_dir):
    v = vectors(spark, sf_dir)
    p = N.sigmoid(F.get("v", F.lit(49)))
    side = v.select("vec_id", N.argmax(F.col("intent")).alias("argmax_intent"), F.when(p >= 0.5, "in_domain").when(p < 0.48, "out_of_domain").otherwise("uncertain").alias("route"))
    shown = D.routed(D.joint_decode(v, dims.legal_tuples(spark), "vec_id").join(side, "vec_id"), F.col("route"))
    return shown.groupBy("exposed_route").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("intent_index") != F.col("argmax_intent")).alias("disagree"), F.count_if(F.col("exposed_action") >= 0).alias("n_action"))


@query(f"""WITH e AS (SELECT vec_id, v, list_transform(v, lambda x: round(x, 2)) AS b FROM {_VEC}), d AS (SELECT unnest(list_transform(range(1, 65), lambda i: abs(v[i] - b[i]))) AS d FROM e)
 SELECT round(max(d), 9) AS max_diff, round(avg(d), 9) AS mean_diff, round(quantile_cont(d, 0.99), 9) AS p99, round(quantile_cont(d, 0.999), 9) AS p999, avg((d <= 0.004)::INTEGER::DOUBLE) AS within,
 (SELECT avg((list_position(v, list_max(v)) = list_position(b, list_max(b)))::INTEGER::DOUBLE) FROM e) AS argmax_agreement, (SELECT count(*) FROM e) AS n_rows FROM d""")
def q_parity_stats(spark, sf_dir):
    v = vectors(spark, sf_dir).select("vec_id", "v", F.transform("v", lambda x: F.round(x, 2)).alias("b"))
    found = M.parity(v, "v", "b", 0.004)
    return found.withColumns({c: F.round(c, 9) for c in ("max_diff", "mean_diff", "p99", "p999")})


@query(f"""WITH e AS (SELECT doc_id % 7 AS epoch, toxic, p >= 0.5 AS hit, quality FROM {_SCORED}), s AS (SELECT epoch, coalesce(count(*) FILTER (hit AND quality = 1) / nullif(count(*) FILTER (quality = 1), 0), 0.0) + 1 - coalesce(count(*) FILTER (hit AND quality = 0) / nullif(count(*) FILTER (quality = 0), 0), 0.0) AS score FROM e GROUP BY epoch)
 SELECT epoch, round(score, 9) AS score, (row_number() OVER (ORDER BY score DESC, epoch)) = 1 AS selected FROM s""")
def q_selection_score(spark, sf_dir):
    from pyspark.sql.window import Window

    e = scored(spark, sf_dir).select(F.pmod("doc_id", F.lit(7)).alias("epoch"), (F.col("p") >= 0.5).alias("hit"), "quality")
    rate = lambda y: N.ratio_or_zero(F.count_if(F.col("hit") & (F.col("quality") == y)), F.count_if(F.col("quality") == y))
    s = e.groupBy("epoch").agg((rate(1) + 1 - rate(0)).alias("score"))
    return s.select("epoch", F.round("score", 9).alias("score"), (F.row_number().over(Window.orderBy(F.desc("score"), "epoch")) == 1).alias("selected"))


@query("SELECT doc_id, rule FROM (SELECT doc_id, unnest(list_filter([CASE WHEN quality NOT IN (0, 1) THEN 'quality_range' END, CASE WHEN toxic NOT IN (0, 1) THEN 'toxic_range' END, CASE WHEN toxic = 1 AND quality = 1 THEN 'toxic_but_good' END, CASE WHEN text IS NULL THEN 'no_document' END], lambda x: x IS NOT NULL)) AS rule FROM labels LEFT JOIN documents USING (doc_id))")
def q_violations_labels(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", F.lit(True).alias("found")), "doc_id", "left")
    rules = {"quality_range": ~F.col("quality").isin(0, 1), "toxic_range": ~F.col("toxic").isin(0, 1), "toxic_but_good": (F.col("toxic") == 1) & (F.col("quality") == 1), "no_document": F.col("found").isNull()}
    return rows.select("doc_id", F.explode(F.array_compact(F.array(*(F.when(c, F.lit(k)) for k, c in rules.items())))).alias("rule"))
