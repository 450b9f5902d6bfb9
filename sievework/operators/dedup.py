"""Deduplication across and within splits, and blocked fuzzy matching."""

from __future__ import annotations

import difflib
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Splits by priority: a text stays in the first of them that has it.
PRIORITY = ("test", "validation", "train")


def _rank(split: Column, priority: Sequence[str] = PRIORITY) -> Column:
    return F.array_position(F.array(*map(F.lit, priority)), split)


def first_of_each(rows: DataFrame, key: Column, split: str, ordinal: str) -> DataFrame:
    """One row per key over all splits: the best split's, then the first.

    A minimum per key is aggregated on (key digest, rank, ordinal) alone and rows are kept
    by a semi-join, so that a key with a third of the rows never meets in one task. Ordinals
    must tell the rows of a split apart: rows that repeat key, split and ordinal all stay.
    """
    keyed = rows.withColumns({"__key": F.md5(key), "__at": F.struct(_rank(F.col(split)).alias("r"), F.col(ordinal).alias("o"))})
    best = keyed.groupBy("__key").agg(F.min("__at").alias("__at"))
    return keyed.join(best, ["__key", "__at"], "left_semi").drop("__key", "__at")


def drop_seen_in_better_split(rows: DataFrame, key: Column, split: str) -> DataFrame:
    """Rows whose key occurs in no better split; repeats within a split stay."""
    keyed = rows.withColumns({"__key": F.md5(key), "__r": _rank(F.col(split))})
    best = keyed.groupBy("__key").agg(F.min("__r").alias("__r"))
    return keyed.join(best, ["__key", "__r"], "left_semi").drop("__key", "__r")


def duplicate_groups(rows: DataFrame, key: Column, id_col: str) -> DataFrame:
    """Keys with more than one row: their digest, smallest and largest id and number."""
    return rows.groupBy(F.md5(key).alias("text_key")).agg(F.count(F.lit(1)).alias("n"), F.min(id_col).alias("first_id"), F.max(id_col).alias("last_id")).where("n > 1")


def conflicts(rows: DataFrame, id_col: str, value: Column) -> DataFrame:
    """Ids that stand for more than one value; identical repeats are fine."""
    return rows.groupBy(id_col).agg(F.count_distinct(value).alias("n_values")).where("n_values > 1")


def ratio(a: Column, b: Column, autojunk: bool) -> Column:
    """Matching-block similarity of two texts, 0 to 1. There is no built-in for it."""

    @F.pandas_udf("double")
    def of(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for x, y in batches:
            yield pd.Series([None if p is None or q is None else difflib.SequenceMatcher(None, p, q, autojunk=autojunk).ratio() for p, q in zip(x, y, strict=True)])

    return of(a, b)


def fuzzy_pairs(rows: DataFrame, id_col: str, text: str, family: str, min_ratio: float = 0.995, prefix: int = 32) -> DataFrame:
    """Pairs within a family of equal prefix, length within one, and a ratio of ``min_ratio`` or more.

    Equal texts are folded to their smallest id first and come back as pairs with it, so
    a group of copies costs a row each. Cheap bounds cut the pairs before Python sees them.
    """
    grouped = rows.where(F.col(text).isNotNull()).groupBy(family, text).agg(F.min(id_col).alias("__low"))
    keyed = grouped.withColumns({"block": F.substring(text, 1, prefix), "len": F.length(text)})
    # Lengths may differ by one, so each row meets its own length and the next.
    left = keyed.select(F.col(family).alias("fa"), F.col("block").alias("ka"), F.col("len").alias("la"), F.col("__low").alias("a"), F.col(text).alias("ta"))
    right = keyed.select(F.col(family).alias("fb"), F.col("block").alias("kb"), F.explode(F.array("len", F.col("len") - 1)).alias("lb"), F.col("__low").alias("b"), F.col(text).alias("tb"))
    # Texts of that ratio are at most (1 - ratio) times both lengths apart in edits.
    most = F.ceil((1 - min_ratio) * (F.length("ta") + F.length("tb"))).cast("int")
    apart = (F.col("a") < F.col("b")) | ((F.length("ta") != F.length("tb")) & (F.col("a") != F.col("b")))
    # All in the join's condition: a filter above it would meet the Python function's, and
    # Spark would call that on every pair of a block.
    same_block = F.col("fa").eqNullSafe(F.col("fb")) & (F.col("ka") == F.col("kb")) & (F.col("la") == F.col("lb"))
    near = left.join(right, same_block & apart & (F.call_function("levenshtein", F.col("ta"), F.col("tb"), most) >= 0)).select("a", "b", "ta", "tb")
    scored = near.withColumn("ratio", ratio(F.col("ta"), F.col("tb"), True)).where(F.col("ratio") >= min_ratio)
    texts = scored.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "ratio").distinct()
    lows = grouped.select(F.col(family).alias("__f"), F.col(text).alias("__t"), "__low")
    same = rows.where(F.col(text).isNotNull()).join(lows, F.col(family).eqNullSafe(F.col("__f")) & (F.col(text) == F.col("__t"))).where(F.col(id_col) != F.col("__low")).select(F.col("__low").alias("a"), F.col(id_col).alias("b"), F.lit(1.0).alias("ratio"))
    return texts.unionByName(same)
