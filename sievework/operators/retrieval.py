"""Weighted lexical passage lookup."""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence
from decimal import ROUND_HALF_UP, Decimal
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sievework.functions import text as X
from sievework.operators.best import Best, Postings, dealt, spans, tables
from sievework.sources.scratch import settle

# Words of the policy lookup.
STOP_WORDS = (
    "a", "about", "and", "are", "can", "do", "does", "for", "find", "how", "i", "if", "in", "is", "it", "me", "my", "of", "on", "or", "should", "the", "to", "what", "where", "will", "you",
)
ALIASES = {
    "apy": "interest", "challenge": "dispute", "charged": "charge", "charges": "charge", "disputed": "dispute", "disputing": "dispute",
    "eligible": "eligibility", "fraudulent": "fraud", "opening": "open", "overdrawn": "overdraft", "qualify": "eligibility",
    "qualifying": "eligibility", "recognized": "unauthorized", "recognize": "unauthorized", "replaced": "replace",
    "replacement": "replace", "replacing": "replace", "requirement": "eligibility", "requirements": "eligibility", "start": "open",
    "unrecognized": "unauthorized",
}
INTENT_TERMS = ("dispute", "eligibility", "fraud", "interest", "open", "overdraft", "replace", "stolen", "unauthorized")
MIN_SCORE, INTENT_WEIGHT = 0.30, 1.75
#: Decimals of a score, and terms of queries that may be broadcast.
DIGITS, BROADCAST_TERMS = 6, 500_000


def terms(text: Column, stop: Sequence[str] = STOP_WORDS, aliases: Mapping[str, str] = ALIASES) -> Column:
    """The set of terms: ASCII words without stop words, aliases replaced."""
    found = F.regexp_extract_all(X.fold_spaces(text), F.lit(r"[a-z0-9]+"), F.lit(0))
    kept = F.filter(found, lambda w: ~w.isin(list(stop)))
    table = F.create_map(*(F.lit(x) for pair in aliases.items() for x in pair)) if aliases else F.create_map().cast("map<string,string>")
    return F.array_distinct(F.transform(kept, lambda w: F.coalesce(F.try_element_at(table, w), w)))


def lookup(queries: DataFrame, chunks: DataFrame, intent_terms: Sequence[str] = INTENT_TERMS, limit: int = 3, min_score: float = MIN_SCORE, **words) -> DataFrame:
    """The best ``limit`` chunks (``chunk_id, text``) of each query (``query_id, text``).

    A score is the IDF weight of the common terms over that of the query's, intent terms
    count more, and a chunk must share one. Queries without a term or a match have no rows.
    Every task keeps the best of the chunks that it reads, and no other pair leaves it; chunks of a
    repeated id, which count together, are summed first. Queries go to every task, in blocks where they have
    more terms than BROADCAST_TERMS.
    """
    if limit <= 0:
        raise ValueError("limit must be positive")
    spark, types = queries.sparkSession, {c: df.schema[c].dataType.simpleString() for df, c in ((queries, "query_id"), (chunks, "chunk_id"))}
    heavy = lambda c: F.when(c.isin(list(intent_terms)), F.lit(INTENT_WEIGHT)).otherwise(F.lit(1.0))
    asked = settle(queries.select("query_id", F.explode(terms(F.col("text"), **words)).alias("term")))
    sought = asked.select("term").distinct()
    sought = F.broadcast(sought) if sought.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS else sought
    held = dealt(chunks.select("chunk_id", "text")).select("chunk_id", terms(F.col("text"), **words).alias("terms"))
    size = chunks.agg(F.count(F.lit(1)).alias("n"))
    idf = held.select(F.explode("terms").alias("term")).join(sought, "term").groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weight = (F.log((F.col("n") + 1) / (F.coalesce("df", F.lit(0)) + 1)) + 1) * heavy(F.col("term"))
    weighed = asked.join(idf, "term", "left").crossJoin(F.broadcast(size)).select("query_id", F.struct("term", weight.alias("w"), F.col("term").isin(list(intent_terms)).alias("aimed")).alias("t"))
    asked = settle(weighed.groupBy("query_id").agg(F.array_sort(F.collect_list("t")).alias("t")))
    blocks = max(1, math.ceil((asked.agg(F.sum(F.size("t"))).first()[0] or 0) / BROADCAST_TERMS))
    again = chunks.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("chunk_id").alias("__id"), F.lit(True).alias("again"))
    if again.limit(1).count():
        held = held.join(again, F.col("chunk_id").eqNullSafe(F.col("__id")), "left").drop("__id")
    else:
        held = held.withColumn("again", F.lit(None).cast("boolean"))

    def block(i: int) -> DataFrame:
        own = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i).toArrow()
        shared = spark.sparkContext.broadcast((own["query_id"].combine_chunks(), own["t"].to_pylist()))
        return held.mapInArrow(lambda batches: _best(batches, *shared.value, limit, min_score), f"query_id {types['query_id']}, chunk_id {types['chunk_id']}, part double, whole double, aimed boolean")

    met = reduce(DataFrame.unionByName, [block(i) for i in range(blocks)])
    found = met.groupBy("query_id", "chunk_id").agg(F.sum("part").alias("part"), F.first("whole").alias("whole"), F.max("aimed").alias("aimed"))
    scored = found.where("aimed").withColumn("score", F.round(F.col("part") / F.col("whole"), DIGITS)).where(F.col("score") >= min_score)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).select("query_id", "chunk_id", "score", "rank")


def _best(batches: Iterator[pa.RecordBatch], ids: pa.Array, asked: list[list[dict]], limit: int, min_score: float) -> Iterator[pa.RecordBatch]:
    """Of chunks ``chunk_id, terms, again``, the best for each query, and all pairs of those that come again."""
    n, flat = len(ids), [(q, t["term"], t["w"], t["aimed"]) for q, own in enumerate(asked) for t in own]
    query, weight, aimed = (np.array([x[i] for x in flat], dtype=kind) for i, kind in ((0, np.int64), (2, np.float64), (3, bool)))
    known = pa.array(sorted({x[1] for x in flat}), pa.string())
    key = pc.index_in(pa.array([x[1] for x in flat], pa.string()), known).to_numpy(zero_copy_only=False).astype(np.int64)
    weights, aims, whole = Postings(key, query, weight), Postings(key[aimed], query[aimed]), np.bincount(query, weight, minlength=n)
    best, met, kind = Best(n, limit), 0, None

    def rows(found: list[tuple]) -> pa.RecordBatch:
        q, chunk, part, aim = [list(c) for c in zip(*found, strict=True)] or [[]] * 4
        return pa.RecordBatch.from_arrays([ids.take(pa.array(q, pa.int64())), pa.array(chunk, kind), pa.array(part, pa.float64()), pa.array(whole[q] if q else [], pa.float64()), pa.array(aim, pa.bool_())], names=["query_id", "chunk_id", "part", "whole", "aimed"])

    for batch in batches if n else ():
        kind = batch.schema.field(0).type
        for part in tables(batch, n, met):
            met += part.num_rows
            at, items = spans(part.column(1))
            place = pc.fill_null(pc.index_in(items.cast(pa.string()), known), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            at, place = at[place >= 0], place[place >= 0]
            sums, aim = weights.sums(at, place, part.num_rows, n), aims.sums(at, place, part.num_rows, n) > 0
            chunk, again = part.column(0), part.column(2).is_valid().to_numpy(zero_copy_only=False)
            t, q = np.nonzero((sums > 0) & again[:, None])
            if len(t):
                yield rows(list(zip(q.tolist(), chunk.take(pa.array(t)).to_pylist(), sums[t, q].tolist(), aim[t, q].tolist(), strict=True)))
            t, q = np.nonzero(aim & ~again[:, None] & (sums >= whole * (np.maximum(best.bound, min_score) - 10.0**-DIGITS)))
            score = rounded(sums[t, q] / whole[q])
            good = (score >= min_score) & (score >= best.bound[q])
            t, q, score = t[good], q[good], score[good]
            named = chunk.take(pa.array(t)).to_pylist()
            best.add(q, [(-s, i is not None, i, p) for s, i, p in zip(score.tolist(), named, sums[t, q].tolist(), strict=True)])
    if met:
        yield rows([(q, chunk, p, True) for q, own in enumerate(best.rows) for _, _, chunk, p in own])


def rounded(values: np.ndarray, digits: int = DIGITS) -> np.ndarray:
    """Spark's ``round`` of doubles of 0 or more: the shortest decimal of the number, half up."""
    scaled = values * 10.0**digits
    out = np.floor(scaled + 0.5) / 10.0**digits
    for i in np.flatnonzero(np.abs(scaled - np.floor(scaled) - 0.5) < 1e-6):
        out[i] = float(Decimal(repr(float(values[i]))).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP))
    return out


def with_unmatched(queries: DataFrame, matches: DataFrame) -> DataFrame:
    """Every query with ``matched`` and its chunk ids in order of rank, none for one without a match."""
    ids = matches.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "chunk_id"))), lambda m: m["chunk_id"].cast("string")).alias("chunk_ids"))
    return queries.select("query_id").join(ids, "query_id", "left").select("query_id", F.col("chunk_ids").isNotNull().alias("matched"), F.coalesce("chunk_ids", F.array().cast("array<string>")).alias("chunk_ids"))


def chunk_violations(chunks: DataFrame) -> DataFrame:
    """Broken rules of passages: blank fields, dates that aren't ISO, an interval that ends before it begins, repeated ids."""
    day = lambda c: F.when(F.col(c).rlike(r"\A\d{4}-\d{2}-\d{2}\z"), F.try_to_date(F.col(c)))
    blank = {f"blank_{c}": F.coalesce(F.trim(c) == "", F.lit(True)) for c in ("chunk_id", "title", "text")}
    rules = {
        **blank,
        "effective_from": day("effective_from").isNull(),
        "effective_to": F.col("effective_to").isNotNull() & day("effective_to").isNull(),
        "interval": day("effective_to") < day("effective_from"),
    }
    own = chunks.select("chunk_id", F.explode(F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(k)) for k, c in rules.items())))).alias("rule"))
    again = chunks.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("chunk_id", F.lit("repeated_id").alias("rule"))
    return own.unionByName(again)


def citations_of(matches: DataFrame, chunks: DataFrame) -> DataFrame:
    """What a reader sees of each match: its citation and the passage's title and dates."""
    shown = chunks.select("chunk_id", "title", "effective_from", "effective_to")
    return matches.join(shown, "chunk_id").select("query_id", "rank", F.concat(F.lit("[Policy: "), F.col("chunk_id").cast("string"), F.lit("]")).alias("citation"), "chunk_id", "title", "effective_from", "effective_to")


def policy_turn(drafts: DataFrame, evidence: DataFrame) -> DataFrame:
    """What a policy turn delivers per query: its first valid draft, or the one repair of it, or nothing.

    ``drafts`` (``query_id, attempt, valid, answer``) holds attempts 0 and 1; ``evidence``
    has a row per query with a passage. Without evidence nothing is delivered, whatever was drafted.
    """
    held = evidence.select("query_id").distinct().withColumn("held", F.lit(True))
    best = drafts.where("attempt < 2").groupBy("query_id").agg(F.min(F.when(F.col("valid"), F.struct("attempt", "answer"))).alias("d"))
    joined = best.join(held, "query_id", "left")
    status = F.when(F.col("held").isNull(), "no_evidence").when(F.col("d").isNull(), "rejected").when(F.col("d.attempt") == 0, "delivered").otherwise("repaired")
    return joined.select("query_id", status.alias("status"), F.when(status.isin("delivered", "repaired"), F.col("d.answer")).alias("answer"))
