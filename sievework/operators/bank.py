"""Account-style reads, selectors and overlays of later changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def top_per_key(rows: DataFrame, key: str, order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each key; Spark keeps at most n per key and task before it shuffles."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("rank") <= n)


def exactly_one(rows: DataFrame, selectors: DataFrame, on: str, id_col: str) -> DataFrame:
    """Each selector's single match; none or several are an error with their number."""
    found = rows.groupBy(on).agg(F.count(F.lit(1)).alias("n"), F.min(id_col).alias("match"))
    n = F.coalesce("n", F.lit(0))
    status = F.when(n == 1, "ok").when(n == 0, "not_found").otherwise("ambiguous")
    return selectors.join(found, on, "left").select(on, n.cast("bigint").alias("matches"), F.when(n == 1, F.col("match")).alias("match"), status.alias("status"))


def overlay(base: DataFrame, changes: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """Base rows with the last change of each key in place of their value."""
    last = changes.groupBy(key).agg(F.max_by(value, F.struct(*order)).alias("__new"), F.count(F.lit(1)).alias("n_changes"))
    return base.join(last, key, "left").withColumns({value: F.coalesce("__new", value), "n_changes": F.coalesce("n_changes", F.lit(0)).cast("bigint")}).drop("__new")


def sessions(events: DataFrame, user: str, ts: str, idle_seconds: int = 7200) -> DataFrame:
    """Rows with ``session_no``: a gap of more than ``idle_seconds`` begins a new one."""
    order = Window.partitionBy(user).orderBy(ts, "event_id")
    gap = F.unix_micros(F.col(ts).cast("timestamp")) - F.lag(F.unix_micros(F.col(ts).cast("timestamp"))).over(order)
    return events.withColumn("__new", F.coalesce((gap > idle_seconds * 1_000_000).cast("int"), F.lit(1))).withColumn("session_no", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")


def consecutive_gate(steps: DataFrame, key: str, step: str, passed: str, needed: int = 2) -> DataFrame:
    """The first step of each key that ends ``needed`` passes in a row; a repeated step counts once."""
    order = Window.partitionBy(key).orderBy(step)
    once = steps.groupBy(key, step).agg(F.first(passed).alias("p"))
    runs = once.withColumn("run", F.sum((~F.col("p")).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    placed = runs.where("p").withColumn("n", F.row_number().over(Window.partitionBy(key, "run").orderBy(step)))
    return placed.groupBy(key).agg(F.min(step).alias("first_passing_step"), F.min(F.when(F.col("n") == needed, F.col(step))).alias("selected_step"))


def render_lines(rows: DataFrame, key: str, order: list[str], line: Column) -> DataFrame:
    """One text per key of its few, already limited, lines."""
    item = F.struct(*order, line.alias("__line"))
    return rows.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["__line"]), "\n").alias("rendered"))


def cell(value: Column) -> Column:
    """A Markdown table cell: bars escaped, newlines to spaces, a dash for none."""
    return F.coalesce(F.regexp_replace(F.replace(value, F.lit("|"), F.lit("\\|")), r"[\r\n]+", " "), F.lit("—"))
