"""SimHash near-duplicate detection with pigeonring candidate filtering (operator 3).

A fingerprint of 64 bits is cut into ``m`` segments on a ring. If two differ in at most
``t`` bits, some segment starts a chain in which, for every length l, the differences of
the first l segments total at most floor(l * t / m). The first ceil(m / t) - 1 segments
of that chain must be equal; they are the join key. The longer chains are checked on the
pairs that share a key, and only what is left is compared in full.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.llm._common import connected_components, settle

BITS, SEED = 64, 42
#: Words per shingle, differing bits that link, segments on the ring.
WORDS, MAX_BITS, SEGMENTS = 3, 2, 5
#: Fingerprints that may share a key before its bucket is linked through neighbours instead.
BUCKET_LIMIT = 256
_CHUNK = 1 << 16


def simhash(text: str | None, words: int = WORDS) -> int:
    """Unsigned fingerprint of one text; 0 for a null text or one without words."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    if not parts:
        return 0
    total = max(1, len(parts) - words + 1)
    counts, hashed = np.zeros(BITS, dtype=np.int64), xxhash.xxh64_intdigest
    for at in range(0, total, _CHUNK):
        n = min(_CHUNK, total - at)
        shingles = map(b" ".join, zip(*(parts[at + i : at + i + n] for i in range(words)), strict=True)) if len(parts) >= words else [b" ".join(parts)]
        block = np.array([hashed(s, SEED) for s in shingles], dtype=">u8")
        counts += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > total).tobytes(), "big")


def fingerprints(df: DataFrame, text: str = "text", words: int = WORDS, out: str = "fp") -> DataFrame:
    """``df`` with the fingerprint as a signed 64-bit ``out``; a column of that name is replaced."""

    @F.pandas_udf("bigint")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(np.array([simhash(t, words) for t in batch], dtype=np.uint64).view(np.int64))

    return df.withColumn(out, of(F.col(text)))


def _cuts(segments: int) -> list[tuple[int, int]]:
    edges = [BITS * i // segments for i in range(segments + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def _piece(value: Column, cut: tuple[int, int]) -> Column:
    return F.shiftrightunsigned(value, cut[0]).bitwiseAND(F.lit((1 << cut[1]) - 1).cast("bigint"))


def _keys(fp: Column, max_bits: int, segments: int) -> Column:
    """For each start on the ring, the segments that must be equal, as (start, key)."""
    cuts, fixed = _cuts(segments), next(n for n in range(segments, -1, -1) if n * max_bits < segments)
    made = []
    for i in range(segments):
        key = F.lit(0).cast("bigint")
        for j in range(fixed):
            cut = cuts[(i + j) % segments]
            key = F.shiftleft(key, cut[1]).bitwiseOR(_piece(fp, cut))
        made.append(F.struct(F.lit(i).alias("start"), key.alias("key")))
    return F.array(*made)


def _chain(start: Column, a: Column, b: Column, max_bits: int, segments: int) -> Column:
    """Whether the chain from ``start`` keeps within its budget at every length."""
    cuts, out = _cuts(segments), F.lit(False)
    diff = [F.bit_count(_piece(a.bitwiseXOR(b), cut)) for cut in cuts]
    for i in range(segments):
        ok, total = F.lit(True), F.lit(0)
        for n in range(1, segments + 1):
            total = total + diff[(i + n - 1) % segments]
            ok = ok & (total <= n * max_bits // segments)
        out = F.when(start == i, ok).otherwise(out)
    return out


def links(fps: DataFrame, max_bits: int = MAX_BITS, segments: int = SEGMENTS, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """Links ``a, b`` that join exactly what fingerprints at ``max_bits`` or fewer join.

    ``fps`` has one row per distinct fingerprint ``fp``. Pairs of a bucket are compared
    while it has at most ``bucket_limit`` members. The members of larger buckets are
    linked through the values one bit away from them: two of them within two bits share
    such a value, so each member's link to the least member at every shared value
    connects the same groups, with 65 rows a member instead of all pairs. That holds for
    one or two bits, so other bounds are refused.
    """
    if max_bits not in (1, 2) or segments <= max_bits:
        raise ValueError("max_bits must be 1 or 2, and below the number of segments")
    keyed = fps.select("fp", F.explode(_keys(F.col("fp"), max_bits, segments)).alias("k")).select("fp", "k.*")
    full = settle(keyed.groupBy("start", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > bucket_limit).select("start", "key"))
    any_full = full.limit(1).count() > 0
    cool = keyed.join(full, ["start", "key"], "left_anti") if any_full else keyed
    other = cool.select("start", "key", F.col("fp").alias("b"))
    pairs = (
        cool.withColumnRenamed("fp", "a")
        .join(other, ["start", "key"])
        .where(F.col("a") < F.col("b"))
        .where(_chain(F.col("start"), F.col("a"), F.col("b"), max_bits, segments))
        .where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits)
        .select("a", "b")
    )
    if any_full:
        ball = F.array(F.col("fp"), *(F.col("fp").bitwiseXOR(F.shiftleft(F.lit(1).cast("bigint"), i)) for i in range(BITS)))
        members = keyed.join(full, ["start", "key"], "left_semi").select("fp").distinct()
        near = members.select("fp", F.explode(ball).alias("value"))
        if max_bits == 1:  # a value that is a member itself
            close = near.join(members.select(F.col("fp").alias("value")), "value").where("fp < value").select(F.col("fp").alias("a"), F.col("value").alias("b"))
        else:
            met = near.groupBy("value").agg(F.collect_set("fp").alias("who")).where(F.size("who") > 1)  # at most 65 members
            close = met.select(F.array_min("who").alias("a"), F.explode("who").alias("b")).where("a <> b")
        pairs = pairs.unionByName(close)
    return pairs.distinct()


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text: str = "text", words: int = WORDS, max_bits: int = MAX_BITS, segments: int = SEGMENTS, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """One row ``id, fp, component_id`` per row of ``df``.

    ``component_id`` is the smallest id that links reach from the row's fingerprint, its
    own id if there is none. Null and wordless texts have fingerprint 0 and link like any
    other; repeated rows repeat in the result; a group whose ids are all null has a null
    component. No rows give no rows. Only ids and fingerprints are shuffled, and groups
    of copies fold into one fingerprint before anything is joined.
    """
    marked = settle(fingerprints(df.select(id_col, text), text, words, "__fp").select(F.col(id_col), F.col("__fp").alias("fp")))
    least = settle(marked.groupBy("fp").agg(F.min(id_col).alias("low")))
    roots = connected_components(links(least.select("fp"), max_bits, segments, bucket_limit)).withColumnRenamed("node", "fp")
    joined = least.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    group = joined.groupBy("root").agg(F.min("low").alias("component_id"))
    of_fp = settle(joined.select("fp", "root").join(group, "root").select("fp", "component_id"))
    return marked.join(of_fp, "fp").select(id_col, "fp", "component_id")


def hex_digits(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
