"""Writers: split files with manifests, appends that can resume, digest locks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.sources.readers import file_digests


#: Rows that one file may hold.
MOST_LINES = 1_000_000


def write_splits(rows: DataFrame, path: str, split: str = "split") -> None:
    """One folder per split, written in parallel by Spark's committer."""
    rows.write.partitionBy(split).mode("overwrite").parquet(path)


def write_jsonl(rows: DataFrame, path: str, order: str) -> None:
    """One JSON-lines file of sorted rows with sorted keys, for splits whose bytes are pinned.

    More than MOST_LINES rows are written as range-partitioned part files instead, whose
    names' order is the rows' order, so that no task gets all of a large split.
    """
    line = F.to_json(F.struct(*sorted(rows.columns)), {"ignoreNullFields": "false"})
    lines = rows.select(order, line.alias("value"))
    dealt = lines.coalesce(1) if rows.limit(MOST_LINES + 1).count() <= MOST_LINES else lines.repartitionByRange(order)
    dealt.sortWithinPartitions(order).select("value").write.mode("overwrite").text(path)


def record_digest(*columns: str) -> Column:
    """SHA-256 of the row's canonical JSON: keys sorted, no spaces."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)


def manifest(rows: DataFrame, split: str, order: str) -> DataFrame:
    """Per split: rows, bytes of canonical lines, and an order-free fingerprint of record digests.

    The fingerprint is a digest of the sums of the digests' four 60-bit quarters and of
    their number: rows add up map-side, in any order, and no digest is gathered anywhere.
    """
    columns = [c for c in rows.columns if c != split]
    line = F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"})
    each = rows.select(split, F.octet_length(line).alias("n"), F.sha2(line, 256).alias("h"))
    quarters = [F.sum(F.conv(F.substring("h", 1 + 15 * i, 15), 16, 10).cast("decimal(20,0)")).cast("string") for i in range(4)]
    count = F.count(F.lit(1))
    return each.groupBy(split).agg(count.alias("record_count"), F.sum(F.col("n") + 1).alias("bytes"), F.sha2(F.concat_ws(":", count.cast("string"), *quarters), 256).alias("fingerprint"))


def pending(requests: DataFrame, done: DataFrame, on: str) -> DataFrame:
    """Requests without a result yet; appending their results can be repeated after a failure."""
    return requests.join(done.select(on).distinct(), on, "left_anti")


def drift(expected: DataFrame, observed: DataFrame, on: str = "name", digest: str = "sha256") -> DataFrame:
    """Names whose digests differ or that only one side has."""
    a, b = expected.select(on, F.col(digest).alias("expected")), observed.select(on, F.col(digest).alias("observed"))
    return a.join(b, on, "full_outer").where(~F.col("expected").eqNullSafe(F.col("observed")))


def folder_drift(rows_path: str, expected: DataFrame) -> DataFrame:
    return drift(expected, file_digests(expected.sparkSession, rows_path))
