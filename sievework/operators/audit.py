"""Leakage and contamination audits."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sievework.functions import text as X
from sievework.operators.best import CELLS, Best, Postings, dealt, spans, tables
from sievework.sources.scratch import settle

SHORTLIST, CEILING = 32, 0.90
#: Sequences of items that may be broadcast: some 50 MB.
BROADCAST_GRAMS = 500_000


def leakage(rows: DataFrame, keys: dict[str, Column], split: str = "split") -> DataFrame:
    """Keys of each kind that occur in more than one split: ``kind, key, splits``."""
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), c.cast("string").alias("key")) for k, c in keys.items())))
    pairs = rows.select(split, each.alias("e")).select(split, "e.*").where("key IS NOT NULL AND key <> ''")
    return pairs.groupBy("kind", "key").agg(F.array_join(F.array_sort(F.collect_set(split)), ",").alias("splits")).where(F.contains("splits", F.lit(",")))


def owner_conflicts(rows: DataFrame, key: str, owner: str, order: str) -> DataFrame:
    """Keys claimed by an owner other than the first: first owner, number of others' rows."""
    first = rows.groupBy(key).agg(F.min_by(owner, order).alias("first_owner"), F.count_distinct(owner).alias("n_owners"))
    return first.where("n_owners > 1")


def missing(required: DataFrame, observed: DataFrame, on: str) -> DataFrame:
    return required.join(observed.select(on).distinct(), on, "left_anti")


def small(df: DataFrame) -> DataFrame:
    """``df`` with a hint to broadcast it where it has at most BROADCAST_GRAMS rows, else as it is."""
    return F.broadcast(df) if df.limit(BROADCAST_GRAMS + 1).count() <= BROADCAST_GRAMS else df


def sentence_matches(docs: DataFrame, items: DataFrame, least_words: int = 4) -> DataFrame:
    """Items with a sentence that occurs in a document word for word: pairs and number of sentences.

    Sentences are normalized; shorter ones than ``least_words`` are too common to tell. Those of
    documents that no item has end in the task that reads them.
    """
    def sentences(df: DataFrame, key: str) -> DataFrame:
        parts = df.select(key, F.explode(F.split("text", r"[.!?\n]+")).alias("s")).select(key, X.normalize(F.col("s")).alias("s"))
        return parts.where(F.size(F.split("s", " ")) >= least_words)

    sought = settle(sentences(items, "item_id").distinct())
    held = sentences(docs, "doc_id").join(small(sought.select("s").distinct()), "s", "left_semi").distinct()
    return held.join(small(sought), "s").groupBy("doc_id", "item_id").agg(F.count(F.lit(1)).alias("n_sentences"))


def ngram_matches(docs: DataFrame, items: DataFrame, n: int = 8) -> DataFrame:
    """Shared n-word sequences of documents and items: pairs and their number, each distinct sequence once."""
    sought = items.select("item_id", F.explode(X.word_ngrams(X.words(F.col("text")), n)).alias("phrase"))
    return phrases_in_texts(sought, docs, n).groupBy("doc_id", "item_id").agg(F.sum("n").alias("n_shared"))


def facts_in_texts(facts: DataFrame, docs: DataFrame) -> DataFrame:
    """Facts (``fact_id, fact`` of one word or more) that stand in a document's normalized text: pairs."""
    sought = facts.select("fact_id", X.normalize(F.col("fact")).alias("phrase")).where("phrase <> ''")
    return phrases_in_texts(sought, docs, 3).select("doc_id", "fact_id").distinct()


def phrases_in_texts(phrases: DataFrame, docs: DataFrame, head: int) -> DataFrame:
    """How many of an id's phrases stand in a document's normalized text, word for word: ``doc_id``, the id and ``n``.

    ``phrases`` has an id and a normalized ``phrase``. They go to every task, in blocks of at most about
    BROADCAST_GRAMS, where a text meets those that share their first ``head`` words with it;
    only matches leave the task, and no text is shuffled.
    """
    spark, own_id = docs.sparkSession, phrases.columns[0]
    sought = settle(phrases.distinct())
    blocks = max(1, math.ceil(sought.count() / BROADCAST_GRAMS))
    held = dealt(docs.select("doc_id", "text")).select("doc_id", X.normalize(F.col("text")).alias("t"))
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {own_id} {phrases.schema[own_id].dataType.simpleString()}, n bigint"

    def block(i: int) -> DataFrame:
        own = sought.where(F.pmod(F.xxhash64(own_id), F.lit(blocks)) == i).toArrow()
        shared = spark.sparkContext.broadcast((own[own_id].combine_chunks(), own["phrase"].to_pylist()))
        return held.mapInArrow(lambda batches: _standing(batches, *shared.value, head, own_id), schema)

    return unioned([block(i) for i in range(blocks)])


def _standing(batches: Iterator[pa.RecordBatch], ids: pa.Array, phrases: list[str], head: int, own_id: str) -> Iterator[pa.RecordBatch]:
    """For texts ``doc_id, t``, how many of an id's phrases stand in each, where any do."""
    named = ids.dictionary_encode() if len(ids) else None
    groups = named.indices.to_pylist() if named else []
    by_head: dict[int, dict[tuple[str, ...], list[tuple[int, str | None]]]] = {}
    for group, phrase in zip(groups, phrases, strict=True):
        words = tuple(phrase.split(" "))
        # The whole phrase is sought where it is longer than its head.
        by_head.setdefault(len(words[:head]), {}).setdefault(words[:head], []).append((group, f" {phrase} " if len(words) > head else None))
    heads = {n: frozenset(of) for n, of in by_head.items()}
    for batch in batches if heads else ():
        at, which, n = [], [], []
        for row, text in enumerate(batch.column(1).to_pylist()):
            if not text:
                continue
            words, met = text.split(" "), Counter()
            for size, of in by_head.items():
                for first in heads[size].intersection(zip(*(words[i:] for i in range(size)), strict=False)):
                    met.update(group for group, whole in of[first] if whole is None or whole in f" {text} ")
            at += [row] * len(met)
            which += met.keys()
            n += met.values()
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), named.dictionary.take(pa.array(which, pa.int64())), pa.array(n, pa.int64())], names=["doc_id", own_id, "n"])


def dice_candidates(queries: DataFrame, texts: DataFrame, k: int = SHORTLIST) -> DataFrame:
    """Rows ``qid, low, text, dice`` that hold each query's ``k`` nearest texts, by Dice, text and ``low``.

    Every task keeps the k nearest of the texts that it reads, and no other pair leaves it. The
    Dice of its k-th so far is a bound that rises: a query's trigrams stand in the order of their rarity in the
    task's first texts, a text that reaches the bound has one of so many of the rarest, and what
    it shares of these, with all that it could share of the others, must reach the bound too. Only
    such pairs are compared in full. Queries go to every task, in blocks where they have
    more trigrams than BROADCAST_GRAMS.
    """
    spark, schema = queries.sparkSession, f"qid {queries.schema['qid'].dataType.simpleString()}, low {texts.schema['low'].dataType.simpleString()}, text string, dice double"
    asked = settle(queries.select("qid", X.trigram_codes(F.col("text")).alias("g")).where("size(g) > 0"))
    blocks = max(1, math.ceil((asked.agg(F.sum(F.size("g"))).first()[0] or 0) / BROADCAST_GRAMS))
    held = dealt(texts.select("low", "text")).select("low", "text", X.trigram_codes(F.col("text")).alias("g"))

    def block(i: int) -> DataFrame:
        own = asked.where(F.pmod(F.xxhash64("qid", "g"), F.lit(blocks)) == i).toArrow()
        shared = spark.sparkContext.broadcast((own["qid"].combine_chunks(), [np.array(g, dtype=np.int64) for g in own["g"].to_pylist()]))
        return held.mapInArrow(lambda batches: _nearest(batches, *shared.value, k), schema)

    return unioned([block(i) for i in range(blocks)])


def _nearest(batches: Iterator[pa.RecordBatch], qids: pa.Array, grams: list[np.ndarray], k: int) -> Iterator[pa.RecordBatch]:
    """The k nearest of the texts of ``low, text, g`` to each query, as ``qid, low, text, dice``."""
    n, nq = len(qids), np.array([len(g) for g in grams], dtype=np.int64)
    known, gram = np.unique(np.concatenate([*grams, np.empty(0, np.int64)]), return_inverse=True)
    query = np.repeat(np.arange(n), nq)
    pairs = np.sort(gram * n + query)  # a trigram of a query, as one number
    best, met, place, fields = Best(n, k), 0, None, None
    for batch in batches if n else ():
        fields = batch.schema
        for part in tables(batch, n, met):
            met += part.num_rows
            at, codes = spans(part.column(2))
            nt, codes = np.bincount(at, minlength=part.num_rows), codes.to_numpy()
            key = np.minimum(np.searchsorted(known, codes), len(known) - 1)
            at, key = at[known[key] == codes], key[known[key] == codes]
            if place is None:  # of each pair, how many rarer trigrams its query has
                order = np.lexsort((gram, np.bincount(key, minlength=len(known))[gram], query))
                place = np.empty(len(gram), dtype=np.int64)
                place[order] = np.arange(len(gram)) - np.repeat(np.cumsum(nq) - nq, nq)
            # The least that a text of the bound shares; a little slack for rounding.
            upto = np.minimum(nq, np.floor(nq - best.bound * nq / (2 - best.bound) + 1e-6).astype(np.int64) + 1)
            early = place < upto[query]
            hits = Postings(gram[early], query[early]).sums(at, key, part.num_rows, n)
            t, q = np.nonzero(hits)
            most = hits[t, q] + np.minimum(nq[q] - upto[q], nt[t] - hits[t, q])
            open_ = 2.0 * most / (nq[q] + nt[t]) >= best.bound[q]
            t, q = t[open_], q[open_]
            common = _common(pairs, n, t, q, at, key)
            dice = 2.0 * common / (nq[q] + nt[t])
            near = dice >= best.bound[q]
            t, q, dice = t[near], q[near], dice[near]
            lows, texts = (part.column(c).take(pa.array(t)).to_pylist() for c in (0, 1))
            best.add(q, [(-d, text, low is not None, low) for d, text, low in zip(dice.tolist(), texts, lows, strict=True)])
    if met:
        rows = [(q, low, text, -d) for q, own in enumerate(best.rows) for d, text, _, low in own]
        columns = [list(c) for c in zip(*rows, strict=True)] or [[]] * 4
        types = (pa.int64(), fields.field(0).type, fields.field(1).type, pa.float64())
        at, *others = (pa.array(c, t) for c, t in zip(columns, types, strict=True))
        yield pa.RecordBatch.from_arrays([qids.take(at), *others], names=["qid", "low", "text", "dice"])


def _common(pairs: np.ndarray, n: int, t: np.ndarray, q: np.ndarray, at: np.ndarray, key: np.ndarray) -> np.ndarray:
    """How many of the keys of text ``t`` query ``q`` has; ``key`` stands in the order of its text ``at``, and ``pairs`` holds key * n + query."""
    first, last = np.searchsorted(at, t), np.searchsorted(at, t, "right")
    size, out = last - first, np.zeros(len(t), dtype=np.int64)
    for some in np.array_split(np.arange(len(t)), max(1, int(size.sum()) // CELLS)):
        m = size[some]
        own = np.repeat(first[some] - np.cumsum(m) + m, m) + np.arange(m.sum())
        sought = key[own] * n + np.repeat(q[some], m)
        found = pairs[np.minimum(np.searchsorted(pairs, sought), len(pairs) - 1)] == sought
        out[some] = np.bincount(np.repeat(np.arange(len(some)), m)[found], minlength=len(some))
    return out


def dice_shortlist(queries: DataFrame, texts: DataFrame, k: int = SHORTLIST) -> DataFrame:
    """The ``k`` texts nearest to each query by the Dice coefficient of character trigrams: ``qid, tid, text, dice, rank``.

    ``queries`` and ``texts`` have ``qid``/``tid`` and a normalized ``text``. Pairs without a
    common trigram have Dice 0 and are left out.
    """
    order = Window.partitionBy("qid").orderBy(F.desc("dice"), "text", "tid")
    near = dice_candidates(queries, texts.withColumnRenamed("tid", "low"), k).withColumnRenamed("low", "tid")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("qid", "tid", "text", "dice", "rank")


def pair_invariants(rows: DataFrame) -> DataFrame:
    """Broken rules of counterfactual pairs (``pair_id, variant, prompt, result, forbidden``), all of them."""
    per = rows.groupBy("pair_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.array_join(F.array_sort(F.collect_set("variant")), ",").alias("variants"),
        F.count_distinct("prompt").alias("prompts"),
        F.count_distinct("result").alias("results"),
        F.bool_and(F.col("forbidden") != F.col("result")).alias("apart"),
    )
    rules = {"not_two_rows": F.col("n") != 2, "variants_not_a_b": F.col("variants") != "a,b", "prompts_differ": F.col("prompts") != 1, "results_equal": F.col("results") != 2, "own_fact_forbidden": ~F.col("apart")}
    return per.select("pair_id", F.explode(F.array_compact(F.array(*(F.when(c, F.lit(k)) for k, c in rules.items())))).alias("rule"))


def contamination_report(gates: dict[str, DataFrame], ceiling: DataFrame | None = None, score: str = "ratio") -> DataFrame:
    """One row per gate: ``gate, n_overlaps, passed``; a gate passes with no row at all.

    ``ceiling`` has similarities under ``score``; those of CEILING or more are its overlaps.
    """
    counted = [rows.agg(F.count(F.lit(1)).alias("n_overlaps")).select(F.lit(k).alias("gate"), "n_overlaps") for k, rows in gates.items()]
    if ceiling is not None:
        counted.append(ceiling.agg(F.count_if(F.col(score) >= CEILING).alias("n_overlaps")).select(F.lit("similarity").alias("gate"), "n_overlaps"))
    return unioned(counted).withColumn("passed", F.col("n_overlaps") == 0)


def unioned(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)
