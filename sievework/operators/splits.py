"""Reproducible splits, pairings and expansions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sievework.functions import text as X


def group_split(rows: DataFrame, group: str, seed: int = 711, validation: float = 0.15, test: float = 0.15) -> DataFrame:
    """Rows with ``split``: distinct groups in hash order, first validation, then test, the rest train.

    The order is over one row per group, never over rows; the groups are joined back. Rows
    without a group are a group of their own.
    """
    groups = rows.select(group).distinct()
    order = Window.orderBy(F.sha2(F.concat(F.lit(f"{seed}\n"), F.coalesce(F.col(group).cast("string"), F.lit(""))), 256), F.col(group).isNull())
    placed = groups.withColumns({"__at": F.row_number().over(order), "__n": F.count(F.lit(1)).over(Window.partitionBy())})
    v, t = F.bround(F.col("__n") * validation), F.bround(F.col("__n") * test)
    named = placed.select(F.col(group).alias("__group"), F.when(F.col("__at") <= v, "validation").when(F.col("__at") <= v + t, "test").otherwise("train").alias("split"))
    return rows.join(named, F.col(group).eqNullSafe(F.col("__group"))).drop("__group")


#: Bins that a hash order is cut into, so that no group is ranked in one task.
BINS = 1 << 12


def hash_bin(hexdigits: Column) -> Column:
    """Bin of a hexadecimal hash, in its order."""
    return F.conv(F.substring(hexdigits, 1, 3), 16, 10).cast("int")


def value_bin(rows: DataFrame, value: str) -> Column:
    """Bin of a number between the least and the greatest of ``rows``; null goes first."""
    low, high = rows.agg(F.min(value), F.max(value)).first()
    if low is None or low == high:
        return F.lit(0)
    return F.coalesce(F.floor((F.col(value) - F.lit(low)) / F.lit((high - low) / (BINS - 1))).cast("int"), F.lit(-1))


def ranked(rows: DataFrame, group: Sequence[str], bins: Column, order: Sequence[Column | str], name: str) -> DataFrame:
    """Zero-based position ``name`` of each row in its group by ``order``, of which ``bins`` is a coarse form.

    Rows are sorted within one bin of a group; what is before a bin comes from counts, at
    most BINS rows a group. So a group with a third of all rows is spread over its bins.
    """
    tag = F.to_json(F.struct(*group), {"ignoreNullFields": "false"}) if group else F.lit("")
    keyed = rows.withColumns({"__tag": tag, "__bin": bins})
    counts = keyed.groupBy("__tag", "__bin").agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(Window.partitionBy("__tag").orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("__tag", "__bin", F.coalesce(before, F.lit(0)).alias("__before"))
    local = keyed.withColumn("__rn", F.row_number().over(Window.partitionBy("__tag", "__bin").orderBy(*order)) - 1)
    return local.join(offsets, ["__tag", "__bin"]).withColumn(name, (F.col("__rn") + F.col("__before")).cast("bigint")).drop("__tag", "__bin", "__rn", "__before")


def stratified_holdout(rows: DataFrame, label: str, row_id: str, text: str, seed: int = 7101, fraction: float = 0.15) -> DataFrame:
    """Rows with ``split``: of each label the first ``max(1, half-even(n * fraction))`` by hash are validation.

    The rank is over digests and ids; texts don't move.
    """
    keys = rows.select(label, row_id, X.stable_rank(F.lit(seed), F.col(label), F.col(row_id), F.col(text)).alias("__h"))
    placed = ranked(keys, [label], hash_bin(F.col("__h")), ["__h", row_id], "__at")
    sizes = rows.groupBy(F.col(label).alias("__label")).agg(F.count(F.lit(1)).alias("__n"))
    sized = placed.join(sizes, F.col(label).eqNullSafe(F.col("__label")))
    return sized.select(row_id, label, F.when(F.col("__at") < F.greatest(F.lit(1), F.bround(F.col("__n") * fraction)), "validation").otherwise("train").alias("split"))


def previous_with_wrap(rows: DataFrame, group: str, order: str, value: str) -> DataFrame:
    """Each row with the value before it in its group; the first takes the last's. Groups of one are left out.

    Neighbours meet by their position, so that no group is ordered in one task.
    """
    placed = ranked(rows, [group], value_bin(rows, order), [order], "__at")
    tag = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))
    sizes = placed.groupBy(tag.alias("__g")).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1")
    sized = placed.withColumn("__g", tag).join(sizes, "__g")
    after = sized.select("__g", F.pmod(F.col("__at") + 1, F.col("__n")).alias("__at"), F.col(value).alias("previous"))
    return sized.join(after, ["__g", "__at"]).drop("__g", "__at", "__n")


def numbered(rows: DataFrame, group: str | None, order: Column, name: str) -> DataFrame:
    """Zero-based positions in the order of a hexadecimal hash within each group."""
    hashed = rows.withColumn("__h", order)
    return ranked(hashed, [group] if group else [], hash_bin(F.col("__h")), ["__h"], name).drop("__h")


def round_robin(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """Row i of each ``on`` group of ``left`` (column ``i``) with row i modulo n of ``right`` (column ``j``)."""
    size = right.groupBy(on).agg(F.count(F.lit(1)).alias("__n"))
    aimed = left.join(size, on).withColumn("j", F.pmod(F.col("i"), F.col("__n"))).drop("__n")
    return aimed.join(right, [on, "j"])


def occurrence_seeds(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The nth occurrence of a key gets semantic seed n div 3 and realization n mod 3."""
    placed = ranked(rows, [key], value_bin(rows, order), [order], "__n")
    return placed.withColumns({"semantic_seed": F.floor(F.col("__n") / 3).cast("bigint"), "realization": F.pmod("__n", F.lit(3)).cast("bigint")}).drop("__n")


def replicate(rows: DataFrame, times: Column) -> DataFrame:
    """Each row as often as ``times`` says, with ``copy`` from 0."""
    return rows.withColumn("__t", times.cast("int")).where("__t > 0").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("__t") - 1))).drop("__t")
