"""Appends that can be repeated: each batch owns a folder, and a key is written once.

A batch that fails is written anew to the same folder, so that a restart leaves no
doubles. A key that comes again with the same content is skipped; with other content the
append is refused before anything of its batch is visible.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from sievework.sources.scratch import hadoop_path, settle

DIGEST, BATCH = "_digest", "_batch"
#: Rows of a batch whose keys may be sent to all tasks that read what was appended before.
BROADCAST_ROWS = 1_000_000


class AppendConflict(ValueError):
    """A key that was appended before, or comes twice, with other content."""


def _content(rows: DataFrame) -> DataFrame:
    text = F.to_json(F.struct(*sorted(rows.columns)), {"ignoreNullFields": "false"})
    return rows.withColumn(DIGEST, F.sha2(text, 256))


def _batches(spark: SparkSession, path: str) -> dict[int, str]:
    """The folders of batches whose write ended, by batch."""
    files, at = hadoop_path(spark, path)
    if not files.exists(at):
        return {}
    found = (s.getPath() for s in files.listStatus(at) if s.isDirectory() and s.getPath().getName().startswith("batch="))
    jvm = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return {int(p.getName().split("=")[1]): p.toString() for p in found if files.exists(jvm(p, "_SUCCESS"))}


def appended(spark: SparkSession, path: str, schema: T.StructType | str, before: int | None = None) -> DataFrame:
    """All rows appended so far with the batch each came in (``_batch``) and its ``_digest``; those of batches that didn't end aren't seen."""
    kinds = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    whole = T.StructType([*kinds.fields, T.StructField(DIGEST, T.StringType()), T.StructField(BATCH, T.LongType())])
    folders = [p for k, p in sorted(_batches(spark, path).items()) if before is None or k != before]
    return spark.read.schema(whole).parquet(*folders) if folders else spark.createDataFrame([], whole)


def append_once(rows: DataFrame, path: str, key: str, batch: int) -> int:
    """Append the rows of a batch whose key is new, and return their number.

    Writing a batch again replaces what it wrote. Rows that repeat with their content count
    once; a null key, and a key with two contents, raise :class:`AppendConflict` and write nothing.
    Of earlier rows only keys and digests are read, and where the batch is small, in place.
    """
    spark, kinds = rows.sparkSession, rows.schema
    small = rows.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    # One shuffle by key folds the repeats of a row, tells other contents apart and meets the rows of before.
    least, most, row = F.min(DIGEST).alias(DIGEST), F.max(DIGEST).alias("_most"), F.any_value(F.struct(*kinds.names)).alias("_row")
    told = _content(rows).groupBy(F.col(key).alias("_key")).agg(least, most, row)
    old = appended(spark, path, kinds, before=batch).select(F.col(key).alias("_key"), F.col(DIGEST).alias("_old"))
    if small:
        told = settle(told)
        old = old.join(F.broadcast(told.select("_key")), "_key", "left_semi")
    # A batch before holds a key once, and no two batches do: the join adds no rows.
    clash = F.col("_key").isNull() | (F.col(DIGEST) != F.col("_most")) | F.coalesce(F.col(DIGEST) != F.col("_old"), F.lit(False))
    new = settle(told.join(old, "_key", "left").withColumn("_clash", clash).where("_clash OR _old IS NULL"))
    bad = new.where("_clash").select("_key").limit(1).collect()
    if bad:
        raise AppendConflict(f"a row has no {key}" if bad[0][0] is None else f"{key} {bad[0][0]!r} comes with other content")
    new.select("_row.*", DIGEST).withColumn(BATCH, F.lit(batch).cast("bigint")).write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={batch}")
    return new.count()


def append_stream(rows: DataFrame, path: str, key: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Append a stream's micro-batches. Restarted from its checkpoint, it goes on after the last batch that ended."""
    return rows.writeStream.foreachBatch(lambda some, batch: append_once(some, path, key, batch)).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
