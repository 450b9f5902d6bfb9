"""Helpers shared by the training-data operators: materialisation and components."""

from __future__ import annotations

import gc
import math
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


#: Rows of an id and a hash that may be broadcast: 32 MB at most.
BROADCAST_ROWS = 1_000_000
#: Edges that a task of a round of contractions takes at least, and rows of a partition of ``compact``.
TASK_EDGES = 1 << 16
#: Bytes of an Arrow batch under ``small_batches``; a row is never cut.
BATCH_BYTES = 2 << 20


def shared_root(spark: SparkSession) -> str:
    """Folder that the driver and all executors see.

    It is the session's ``spark.checkpoint.dir``. Where that is unset, a local session
    (tests) gets a temporary folder; a cluster without the setting is an error, as a
    machine-local folder would lose data there.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    context = spark.sparkContext
    known = context._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get().rstrip("/")
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    root = "file://" + tempfile.mkdtemp(prefix="sievework-")
    context.setCheckpointDir(root)
    return context._jsc.sc().getCheckpointDir().get().rstrip("/")


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and return it with its lineage cut."""
    shared_root(df.sparkSession)
    return df.checkpoint(eager=True)


def compact(df: DataFrame, rows: int = TASK_EDGES) -> tuple[DataFrame, int]:
    """``df`` settled, in partitions of about ``rows`` rows, and the number of its rows, which are counted as they are written.

    What fits one partition is read by one task and grouped without an exchange, so that small
    frames take no task for each shuffle partition, of each of which the driver keeps a record.
    """
    seen = Observation()
    held = settle(df.observe(seen, F.count(F.lit(1)).alias("rows")))
    count = seen.get["rows"]
    return held.coalesce(max(1, math.ceil(count / rows))), count


def small_enough(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a hint to broadcast it where it has at most ``rows`` rows of a few numbers, else as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Arrow batches of about BATCH_BYTES for what Spark computes inside; 10,000 rows of texts take tens of MB in the JVM and in Python alike."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def tidy(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of frames that are gone: it learns of them when the driver's garbage is collected."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def fresh_folder(spark: SparkSession, prefix: str) -> str:
    """URI of a new, not yet existing folder below the shared one."""
    return f"{shared_root(spark)}/{prefix}-{uuid.uuid4().hex}"


def remove_folder(spark: SparkSession, uri: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def connected_components(edges: DataFrame) -> DataFrame:
    """Components of an undirected graph by alternating star contractions.

    ``edges`` has columns ``a`` and ``b`` of one orderable type. Returns ``node, root``
    for every node of at least one edge; ``root`` is the smallest node of its component.
    Null ends, self loops and repeated edges are ignored; no edges give no rows. Every
    round joins on the node and keeps at most one edge per (node, neighbour), so a hub
    is spread by Spark's skew join and its minimum is found by partial aggregation.
    Only two numbers per round reach the driver.
    """
    given = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    state, _ = compact(given.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct())
    edge = lambda v, u: F.struct(F.col(v).alias("v"), F.col(u).alias("u"))
    before = None
    while True:  # the contractions end after a number of rounds that grows with the logarithm of the nodes
        mark = state.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("v", "u"))).first()
        if mark[0] == 0 or mark == before:
            break
        before = mark
        # A round has no more edges than twice those it began with; few edges take few tasks and files.
        tasks = math.ceil(2 * mark[0] / TASK_EDGES)
        # One task's edges, 1 MB, stay in one partition throughout: lists of edges are expanded, not united, and minima broadcast.
        minima = (lambda df: F.broadcast(df)) if tasks == 1 else (lambda df: df)
        held = lambda df: settle(df.coalesce(tasks)).coalesce(tasks)  # noqa: B023, E731  used in this round alone
        state = state.coalesce(tasks)
        # Large star: every larger neighbour of x moves to the smallest node around x.
        both = state.select(F.inline(F.array(edge("v", "u"), edge("u", "v"))))
        lowest = held(both.groupBy("v").agg(F.min("u").alias("m")).select("v", F.least("v", "m").alias("m")))
        large = held(both.join(minima(lowest), "v").where(F.col("u") > F.col("v")).select(F.col("u").alias("v"), F.col("m").alias("u")).distinct())
        # Small star: the smaller neighbours of x, and x itself, move to the smallest of them.
        lowest = held(large.groupBy("v").agg(F.min("u").alias("m")))
        moved = large.join(minima(lowest), "v").select(F.inline(F.array(edge("u", "m"), edge("v", "m"))))
        state = held(moved.where("v <> u").distinct())
        tidy(edges.sparkSession)
    roots = state.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct()
    return state.select(F.col("v").alias("node"), F.col("u").alias("root")).unionByName(roots)
