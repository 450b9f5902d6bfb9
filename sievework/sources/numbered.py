"""Row numbers of text files, by counts of blocks and their sums: no task reads all lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf
from pyspark.sql.window import Window

#: Blocks of files that may be broadcast: a few numbers each.
BROADCAST_BLOCKS = 500_000


def _summed(lines: DataFrame, value: Column, total: str) -> DataFrame:
    """``file, block`` with ``first`` (the least row mark), and ``total``: the sum of ``value`` over all blocks before it, files in the order of their names."""
    blocks = lines.groupBy("file", "block").agg(F.min("mark").alias("first"), F.sum(value).alias("own"))
    inside = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    files = blocks.groupBy("file").agg(F.sum("own").alias("file_own"))
    before = files.select("file", F.coalesce(F.sum("file_own").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("file_before"))  # one row a file
    counted = blocks.join(before, "file").select("file", "block", "first", (F.col("file_before") + F.coalesce(F.sum("own").over(inside), F.lit(0))).alias(total))
    return F.broadcast(counted) if counted.limit(BROADCAST_BLOCKS + 1).count() <= BROADCAST_BLOCKS else counted


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``file, block, mark, line_no, value`` of the lines of all files below ``path``; ``line_no`` counts from 0 over files in the order of their names.

    A block of a file is read by one task, whose row marks ascend by one; so a line's number is that
    of its block's first line and its distance from it. Lines end at a line feed, a carriage return or both.
    """
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("mark"), "value")
    blocks = _summed(rows, F.lit(1), "lines_before")
    return rows.join(blocks, ["file", "block"]).select("file", "block", "mark", (F.col("lines_before") + F.col("mark") - F.col("first")).alias("line_no"), "value")


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """``file, record_no, record``: CSV records whose quoted cells may hold line ends, which are dropped.

    A record begins where an even number of quotes stands before it; that is told by the sums of
    quotes of the blocks before and of the lines before in the block. Quotes must be those of
    RFC 4180: around whole cells, and doubled inside them. Blank lines between records don't count.
    """
    lines = numbered_lines(spark, path).withColumn("quotes", F.regexp_count("value", F.lit('"')).cast("bigint"))
    by_file = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    in_block = Window.partitionBy("file", "block").orderBy("line_no")

    def before(rows: DataFrame, value: str, out: str) -> DataFrame:
        """The sum of ``value`` over the lines before in the file: of the blocks before, and within the block."""
        blocks = rows.groupBy("file", "block").agg(F.sum(value).alias("own")).select("file", "block", F.coalesce(F.sum("own").over(by_file), F.lit(0)).alias("base"))
        return rows.join(blocks, ["file", "block"]).withColumn(out, F.col("base") + F.coalesce(F.sum(value).over(in_block.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("base")

    marked = before(lines, "quotes", "quotes_before").withColumn("starts", (F.col("quotes_before") % 2 == 0).cast("bigint"))
    told = marked.where((F.col("starts") == 0) | (F.trim("value") != ""))
    placed = before(told, "starts", "starts_before").withColumn("record_no", F.col("starts_before") + F.col("starts") - 1)
    parts = F.array_sort(F.collect_list(F.struct("line_no", "value")))  # the lines of one record
    return placed.groupBy("file", "record_no").agg(F.array_join(F.transform(parts, lambda p: p["value"]), "").alias("record"))


def numbered_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """``row_id`` and the ``columns`` of CSV files with one header each: ids count from 0 over all files in the order of their names.

    The header of the first file names the cells; a column that it lacks stops the read.
    """
    records = csv_records(spark, path)
    first = records.where("record_no = 0").select(F.min_by("record", "file").alias("h")).first()["h"]
    names = [c.strip().lstrip("﻿") for c in (first or "").split(",")]
    names = [c[1:-1].replace('""', '"') if c.startswith('"') else c for c in names]
    if missing := [c for c in columns if c not in names]:
        raise ValueError(f"no column {', '.join(missing)} in the header {names}")
    body = records.where("record_no > 0")
    sizes = body.groupBy("file").agg(F.count(F.lit(1)).alias("n")).select("file", F.coalesce(F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))  # one row a file
    cells = F.from_csv("record", ", ".join(f"`{c}` string" for c in names), {"quote": '"', "escape": '"'})
    return body.join(F.broadcast(sizes), "file").select((F.col("base") + F.col("record_no") - 1).alias("row_id"), cells.alias("c")).select("row_id", *(F.coalesce(F.col("c")[c], F.lit("")).alias(c) for c in columns))


def labelled_snapshot(spark: SparkSession, paths: dict[str, str], label: str = "label") -> DataFrame:
    """``source_row_id, split, text, label`` of one path of CSV files a split; an incomplete row stops the read."""
    out = None
    for split, path in paths.items():
        rows = numbered_csv(spark, path, ["text", label]).select(F.col("row_id").alias("source_row_id"), F.lit(split).alias("split"), "text", F.col(label).alias("label"))
        message = F.concat(F.lit(f"{split} row "), F.col("source_row_id").cast("string"), F.lit(" is incomplete"))
        whole = F.when((F.col("text") != "") & (F.col("label") != ""), F.lit(True)).otherwise(F.raise_error(message).cast("boolean"))
        rows = rows.where(whole)
        out = rows if out is None else out.unionByName(rows)
    return out


@udtf(returnType="literal string")
class PythonLiterals:
    """The text constants of a Python source; none of one that doesn't parse."""

    def eval(self, source: str):
        import ast

        try:
            tree = ast.parse(source or "")
        except (SyntaxError, ValueError):
            return
        for node in ast.walk(tree):
            if isinstance(node, ast.Constant) and isinstance(node.value, str):
                yield (node.value.encode("utf-8", "replace").decode("utf-8"),)


def source_literals(sources: DataFrame, source: str = "source", least_words: int = 3) -> DataFrame:
    """``sources`` with ``literal`` in place of the source text: each distinct text constant, normalized, of ``least_words`` or more."""
    from sievework.functions import text as X

    others = [c for c in sources.columns if c != source]
    spread = sources.lateralJoin(PythonLiterals(F.col(source).outer()))
    return spread.select(*others, X.normalize(F.col("literal")).alias("literal")).where(F.size(X.words(F.col("literal"))) >= least_words).distinct()
