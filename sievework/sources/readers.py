"""Readers with fixed schemas, and digests of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def json_lines(spark: SparkSession, path: str | list[str], schema: str | T.StructType) -> DataFrame:
    """JSON lines under a fixed schema; blank lines are skipped, a wrong line stops the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def json_rows(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """JSON lines, or one JSON document (an object or a list) where the name ends in ``.json``."""
    reader = spark.read.schema(schema).option("mode", "FAILFAST")
    return reader.option("multiLine", path.endswith(".json")).json(path)


def labelled_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header and ``text`` and ``label`` or ``category``: ``text, label``, blank ones dropped."""
    rows = spark.read.option("header", True).csv(path)
    named = [F.col(c) for c in ("label", "category") if c in rows.columns]
    if "text" not in rows.columns or not named:
        raise ValueError("the CSV needs a text column, and label or category")
    return rows.select(F.trim("text").alias("text"), F.trim(F.coalesce(*named)).alias("label")).where("text <> '' AND label <> ''")


def labelled_pairs(payload: DataFrame, key: str, value: str, allowed: list[str] | None = None) -> DataFrame:
    """Rows of ``key`` and an array of [text, label] pairs, flattened with their position.

    A pair that isn't two items stops the read; blank texts and labels not allowed are dropped.
    """
    each = payload.select(F.col(key).alias("source_key"), F.posexplode(value).alias("position", "pair"))
    ok = F.when(F.size("pair") == 2, F.lit(True)).otherwise(F.raise_error(F.lit("a pair must be a text and a label")).cast("boolean"))
    flat = each.where(ok).select("source_key", "position", F.trim(F.get("pair", F.lit(0))).alias("text"), F.get("pair", F.lit(1)).alias("label")).where("text <> ''")
    return flat.where(F.col("label").isin(allowed)) if allowed is not None else flat


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """``name, bytes, sha256`` of each file below a folder."""
    return spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", r"([^/]+)\z", 1).alias("name"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def manifest_splits(spark: SparkSession, root: str, manifest: str, schema: str | T.StructType, use: str | None = None) -> DataFrame:
    """Rows of all splits of a manifest (``name, path, record_count, bytes, sha256, allowed_use``), with ``split``.

    Paths must be relative and stay below ``root``. Sizes, digests and row counts are
    compared first, and any that differ stop the read; ``use`` keeps the splits that allow it.
    """
    entries = spark.read.schema("name string, path string, record_count bigint, bytes bigint, sha256 string, allowed_use array<string>").option("mode", "FAILFAST").json(manifest)
    if use is not None:
        entries = entries.where(F.array_contains("allowed_use", use))
    listed = entries.collect()  # one row per split
    if not listed:
        raise ValueError("the manifest lists no split for this use")
    out = None
    for e in listed:
        if e["path"].startswith("/") or ".." in e["path"].split("/") or "://" in e["path"]:
            raise ValueError(f"not a relative path: {e['path']}")
        at = f"{root.rstrip('/')}/{e['path']}"
        found = file_digests(spark, at).first()
        rows = json_lines(spark, at, schema)
        if found is None or (found["bytes"], found["sha256"]) != (e["bytes"], e["sha256"]) or rows.count() != e["record_count"]:
            raise ValueError(f"split {e['name']} differs from its manifest")
        rows = rows.withColumn("split", F.lit(e["name"]))
        out = rows if out is None else out.unionByName(rows)
    return out
