"""Mixing sources to target weights (operator 6).

Tokens are totalled per source; targets share a budget by weight, capped at a multiple of
the source. A source's rate is target over size; every document is emitted floor(rate)
times, plus one hash-seeded Bernoulli copy with probability equal to the fraction.

The copies are drawn in strata of one source and nearly equal sizes: of ``n`` documents those
``k`` with the smallest hashes are copied, where the ``k`` of a source's strata are its fraction
times their sizes, rounded along the strata from one hashed offset. So ``k`` is ``n`` times
the fraction on average, each document's probability is the fraction, and the total misses its
target by little more than one document.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sievework.llm._common import settle, small_enough

WEIGHTS, SHARE, CAP = (3, 1, 2), 1.5, 2.0
#: Rows of the plan up to which it is broadcast (a few numbers each); beyond, the join is salted.
BROADCAST_PLAN, SALTS = 100_000, 64
#: Bits of a document's hash, and of its bin in the histogram that finds a stratum's k-th hash.
HASH_BITS, BIN_BITS = 52, 16
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def _hash(key: Column) -> Column:
    """HASH_BITS bits of an MD5."""
    return F.conv(F.substring(F.md5(key), 1, HASH_BITS // 4), 16, 10).cast("bigint")


def _tag(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), source), F.lit(""))


def _stratum(size: Column) -> Column:
    """Class of sizes that differ by less than a quarter: the number of bits and the first three."""
    bits = F.length(F.bin(size))
    return (bits * 8 + F.when(bits <= 3, size).otherwise(F.call_function("shiftright", size, bits - 3))).cast("int")


def targets(sources: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """Targets of ``sources`` (``source, source_size``), one row each.

    Sources by code point, null last, take the weights in turn and share ``share`` times
    all sizes; a target stops at ``cap`` times its size and the excess goes to the rest
    by weight, which fixes one level for all that aren't capped. The windows run over
    one row per source, never over documents.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source"))
    listed = sources.withColumn("weight", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (rank - 1) % len(weights) + 1))
    limit = F.col("source_size") * F.lit(cap)
    by_ratio = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").isNull(), "source")
    before, whole = by_ratio.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    level = (F.col("budget") - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    staged = (
        listed.withColumn("limit", limit)
        .withColumn("budget", F.sum("source_size").over(whole) * F.lit(share))
        .withColumn("level", level)
        .withColumn("place", F.row_number().over(by_ratio))
    )
    fits = F.when(F.col("level") <= F.col("limit") / F.col("weight"), F.col("place"))
    first = F.min(fits).over(whole)
    chosen = F.min(F.when(F.col("place") == F.col("first"), F.col("level"))).over(whole)
    return staged.withColumn("first", first).withColumn("chosen", chosen).select("source", "source_size", F.least(F.col("limit"), F.coalesce(F.col("chosen") * F.col("weight"), F.col("limit"))).alias("target"))


def _plan(sized: DataFrame, weights: Sequence[float], share: float, cap: float) -> DataFrame:
    """``tag, stratum, source_size, target, base, last`` for each stratum; a hash up to ``last`` earns the copy."""
    sources = settle(sized.groupBy("source").agg(F.sum("size").alias("source_size")))
    rate = F.when(F.col("source_size") > 0, F.least(F.lit(cap), F.col("target") / F.col("source_size"))).otherwise(F.lit(0.0))
    rated = targets(sources, weights, share, cap).withColumn("rate", rate).select(_tag(F.col("source")).alias("tag"), "source_size", "target", F.floor("rate").alias("base"), (F.col("rate") - F.floor("rate")).alias("fraction"))
    strata = sized.groupBy("tag", "stratum").agg(F.count(F.lit(1)).alias("n")).join(settle(rated), "tag")
    # One row per stratum, a few hundred per source, is ordered here, never documents.
    upto = F.sum("n").over(Window.partitionBy("tag").orderBy("stratum"))
    offset = _hash(F.concat(F.lit("offset"), "tag")) / F.lit(float(1 << HASH_BITS))
    k = F.floor(F.col("fraction") * F.col("upto") + F.col("offset")) - F.floor(F.col("fraction") * (F.col("upto") - F.col("n")) + F.col("offset"))
    strata = settle(strata.withColumn("upto", upto).withColumn("offset", offset).withColumn("k", k.cast("bigint")))
    # The k-th smallest hash of a stratum: first its bin, then its place among the bin's rows.
    bins = sized.groupBy("tag", "stratum", "bin").count()
    counted = bins.join(strata.where("k > 0 AND k < n").select("tag", "stratum", "k"), ["tag", "stratum"])
    met = F.sum("count").over(Window.partitionBy("tag", "stratum").orderBy("bin"))
    chosen = settle(counted.withColumn("met", met).where("met >= k AND met - count < k").select("tag", "stratum", "bin", (F.col("k") - F.col("met") + F.col("count")).alias("place")))
    inside = sized.join(small_enough(chosen), ["tag", "stratum", "bin"])
    placed = inside.withColumn("row", F.row_number().over(Window.partitionBy("tag", "stratum").orderBy("hash"))).where(F.col("row") == F.col("place"))
    last = F.when(F.col("k") >= F.col("n"), F.lit(1 << HASH_BITS)).otherwise(F.coalesce("hash", F.lit(-1))).cast("bigint")
    return settle(strata.join(placed.select("tag", "stratum", "hash"), ["tag", "stratum"], "left").select("tag", "stratum", "source_size", "target", "base", last.alias("last")))


def _planned(df: DataFrame, plan: DataFrame) -> DataFrame:
    """``df`` (with ``__tag, __stratum, __hash``) and the plan's figures; a source with a third of all rows stays spread."""
    side = plan.select(*(F.col(c).alias(f"__{c}") for c in plan.columns))
    if plan.limit(BROADCAST_PLAN + 1).count() <= BROADCAST_PLAN:
        met = df.join(F.broadcast(side), ["__tag", "__stratum"])
    else:
        salted = side.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = df.withColumn("__salt", F.pmod(F.xxhash64("__hash"), F.lit(SALTS)).cast("int")).join(salted, ["__tag", "__stratum", "__salt"])
    return met.withColumn("__copies", (F.col("__base") + F.when(F.col("__hash") <= F.col("__last"), 1).otherwise(0)).cast("bigint"))


def _sized(docs: DataFrame, id_col: str, text: str, source: str) -> DataFrame:
    """``docs`` with ``__size, __tag, __stratum, __hash``; a null id draws as one id."""
    key = F.concat(F.lit("draw"), F.coalesce(F.col(id_col).cast("string"), F.lit("null")))
    return docs.withColumn("__size", word_count(F.col(text))).withColumns({"__tag": _tag(F.col(source)), "__stratum": _stratum(F.col("__size")), "__hash": _hash(key)})


def _measured(docs: DataFrame, id_col: str, text: str, source: str) -> DataFrame:
    """One row ``id, source, size, tag, stratum, hash, bin`` per document, written once."""
    made = _sized(docs.select(F.col(id_col).alias("id"), F.col(source).alias("source"), F.col(text).alias("text")), "id", "text", "source")
    return settle(made.select("id", "source", *(F.col(f"__{c}").alias(c) for c in ("size", "tag", "stratum", "hash")), F.shiftright("__hash", HASH_BITS - BIN_BITS).cast("int").alias("bin")))


def mixing_counts(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", weights: Sequence[float] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """Per row of ``docs``: its id, its source, ``size``, ``source_size``, ``target``, ``copies``.

    A null text has size 0, a null source is a source of its own, a source without words
    has target 0. Rows that repeat an id draw alike where they are of one stratum, and so
    do null ids; rows that repeat all repeat in the result. No rows give no rows.
    """
    sized = _measured(docs, id_col, text, source)
    found = _planned(sized.select("id", "source", "size", *(F.col(c).alias(f"__{c}") for c in ("tag", "stratum", "hash"))), _plan(sized, weights, share, cap))
    return found.select(F.col("id").alias(id_col), F.col("source").alias(source), "size", F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), F.col("__copies").alias("copies"))


def mix(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", weights: Sequence[float] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """The mixed documents: each row of ``docs`` as often as :func:`mixing_counts` says, all columns as they were."""
    plan = _plan(_measured(docs, id_col, text, source), weights, share, cap)
    counted = _planned(_sized(docs, id_col, text, source), plan).where("__copies > 0")
    return counted.withColumn("__n", F.explode(F.array_repeat(F.lit(1), F.col("__copies").cast("int")))).select(*docs.columns)
