"""Benchmark decontamination by a prefix-filtered set join (operator 8).

Item windows of ``window`` words are sought in whole documents. A window is a set of word
shingles; a document that holds it holds them all, so it must hold the window's rarest
one, the prefix of an exact containment. Documents are read once: runs of shingles that
occur in some window, long enough for a window, are kept with their words. Those runs
join the windows on the rarest shingle, position and length bounds drop what can't fit,
and the words of the window are compared.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.functions.text import let
from sievework.llm._common import settle, small_enough

WINDOW, SHINGLE, SHINGLE_MAX, TURN, SEED = 10, 3, 3, 21, 42
#: Words whose hashes a task remembers before it begins anew.
KNOWN_WORDS = 1 << 17
#: Bits of the membership map over window shingles that tasks receive; its size is fixed.
MAP_BITS = 1 << 24
# Words are runs of ASCII letters and digits and of all characters from U+0080.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_WORDS = re.compile(WORD)
_TO_LOWER = {i: i + 32 for i in range(65, 91)}
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class _Hashes(dict):
    """Hashes of words, each computed once."""

    def __missing__(self, word: str) -> int:
        self[word] = made = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"), SEED)
        return made


def _tokens(hashes: np.ndarray, k: int) -> np.ndarray:
    """What :func:`shingles` computes, for the hashes of a document's words."""
    n = len(hashes) - k + 1
    out = hashes[:n].copy()
    for j in range(1, k):
        part = hashes[j : j + n]
        out ^= (part << np.uint64(TURN * j)) | (part >> np.uint64(64 - TURN * j))
    return out


def words_of(text: Column) -> Column:
    return F.coalesce(F.regexp_extract_all(F.translate(text, _UPPER, _LOWER), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def row_key(text: Column) -> Column:
    """64-bit hash of a text; with the id it tells rows apart that repeat one of the two."""
    return F.xxhash64(text)


def windows_of(items: DataFrame, item_id: str, text: str, window: int = WINDOW, shingle: int = SHINGLE) -> tuple[DataFrame, DataFrame]:
    """The distinct windows (``wid, words, n, k``) and, for each, its items (``wid, item_id``).

    ``k`` is the words per shingle: ``shingle``, or all words of a shorter window.
    """
    if not 1 <= shingle <= SHINGLE_MAX:
        raise ValueError(f"shingles have 1 to {SHINGLE_MAX} words")
    split = items.select(F.col(item_id).alias("item_id"), words_of(F.col(text)).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - window + 1))
    spread = split.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("w", i, F.least(F.lit(window), F.size("w"))))).alias("words"))
    held = settle(spread.select("item_id", "words", F.md5(F.array_join("words", " ")).alias("wid")).distinct())
    windows = held.groupBy("wid").agg(F.first("words").alias("words")).select("wid", "words", F.size("words").alias("n"), F.least(F.lit(shingle), F.size("words")).alias("k"))
    return settle(windows), held.select("wid", "item_id").distinct()


def _turned(value: Column, bits: int) -> Column:
    return F.shiftleft(value, bits).bitwiseOR(F.shiftrightunsigned(value, 64 - bits)) if bits else value


def shingles(words: Column, k: Column) -> Column:
    """(offset, token) of every run of ``k`` words, at most SHINGLE_MAX.

    A token combines the words' 64-bit hashes, each turned by TURN bits more than the one
    before it. Tokens only find candidates, whose words are compared, so that two runs of
    one token do no harm.
    """

    def tokens(hashes: Column) -> Column:
        def at(i: Column) -> Column:
            token = F.get(hashes, i)
            for j in range(1, SHINGLE_MAX):
                token = token.bitwiseXOR(F.when(k > j, _turned(F.get(hashes, i + j), TURN * j)).otherwise(F.lit(0).cast("bigint")))
            return F.struct(i.alias("offset"), token.alias("token"))

        return F.transform(F.sequence(F.lit(0), F.size(hashes) - k), at)

    return let(F.transform(words, lambda w: F.xxhash64(w)), tokens)


def _member_map(tokens: DataFrame) -> np.ndarray:
    """Bits at the low bits of each token, as bytes of MAP_BITS bits whatever the number of tokens."""
    low = F.col("token").bitwiseAND(F.lit(MAP_BITS - 1))
    bits = F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), low.bitwiseAND(F.lit(63).cast("bigint")).cast("int")))
    packed = tokens.select("token").distinct().groupBy(F.shiftright(low, 6).alias("at")).agg(bits.alias("bits")).collect()  # at most MAP_BITS / 64 rows
    out = np.zeros(MAP_BITS // 64, dtype=np.int64)
    for r in packed:
        out[r["at"]] = r["bits"]
    return np.unpackbits(out.view(np.uint8), bitorder="little").view(bool)


def _runs(hit: np.ndarray, least: int) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate(([0], hit.view(np.int8), [0]))))
    return [(int(a), int(b)) for a, b in zip(edges[::2], edges[1::2], strict=True) if b - a >= least]


def _scan(docs: DataFrame, id_col: str, text: str, bits: np.ndarray, least: dict[int, int]) -> DataFrame:
    """One row per document (``n_words`` and ``spans`` of candidate words) and rows of shingle counts.

    ``least`` has, for each words-per-shingle, the shortest run that can hold a window.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    span = pa.list_(pa.struct([("at", pa.int64()), ("words", pa.list_(pa.string()))]))
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(bits))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        member, known = np.unpackbits(shared.value).view(bool), _Hashes()
        for batch in batches:
            sizes, spans = [], []
            counts: Counter[int] = Counter()
            for value in batch.column(2):
                whole = value.as_py() or ""
                words = _WORDS.findall(whole.translate(_TO_LOWER) if not whole.isascii() else whole.lower())
                sizes.append(len(words))
                found: list[tuple[int, int]] = []
                if len(known) > KNOWN_WORDS:
                    known.clear()
                hashes = np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))
                for k, shortest in least.items():
                    if len(words) - k + 1 < shortest:
                        continue
                    tokens = _tokens(hashes, k)
                    hit = member[(tokens & np.uint64(MAP_BITS - 1)).astype(np.int64)]
                    counts.update(tokens[hit].view(np.int64).tolist())
                    found += [(a, b + k - 1) for a, b in _runs(hit, shortest)]
                merged: list[list[int]] = []
                for a, b in sorted(found):
                    if merged and a <= merged[-1][1]:
                        merged[-1][1] = max(b, merged[-1][1])
                    else:
                        merged.append([a, b])
                spans.append([{"at": a, "words": words[a:b]} for a, b in merged])
            rows = [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(spans, span)]
            yield pa.RecordBatch.from_arrays([*rows, pa.nulls(len(sizes), pa.int64()), pa.nulls(len(sizes), pa.int64())], names=["id", "key", "n_words", "spans", "token", "seen"])
            n = len(counts)
            empty = [pa.nulls(n, batch.column(0).type), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, span)]
            yield pa.RecordBatch.from_arrays([*empty, pa.array(counts.keys(), pa.int64()), pa.array(counts.values(), pa.int64())], names=["id", "key", "n_words", "spans", "token", "seen"])

    schema = f"id {kind}, key bigint, n_words bigint, spans array<struct<at:bigint,words:array<string>>>, token bigint, seen bigint"
    return docs.select(id_col, row_key(F.col(text)), text).mapInArrow(scan, schema)


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, shingle: int = SHINGLE, key_out: str | None = None) -> DataFrame:
    """Per row of ``docs``: id, ``n_words``, ``n_hit``, ``items`` (array of strings, sorted), ``contaminated``.

    ``n_hit`` counts the words inside any occurrence of a window. Null texts have no
    words; null or wordless items have no window; items with a null id count for hits
    but not in ``items``. Repeated rows repeat in the result; empty tables give no rows
    or no hits. Only candidate runs are shuffled, never whole texts. ``key_out`` names a
    column for the :func:`row_key`, left out otherwise.
    """
    windows, owners = windows_of(items, item_id, item_text, window, shingle)
    parts = settle(windows.select("wid", "words", "n", "k", F.explode(shingles(F.col("words"), F.col("k"))).alias("s")).select("wid", "words", "n", "k", "s.*"))
    least = {r["k"]: r["n"] - r["k"] + 1 for r in windows.groupBy("k").agg(F.min("n").alias("n")).collect()}  # at most `shingle` rows
    scanned = settle(_scan(docs, id_col, text, _member_map(parts), least))
    whole = scanned.where("spans IS NOT NULL").select("id", "key", "n_words", "spans")
    seen = scanned.where("token IS NOT NULL").groupBy("token").agg(F.sum("seen").alias("seen"))
    # The prefix of each window: its rarest shingle over all documents. Windows with a shingle never seen occur nowhere.
    rated = parts.join(seen, "token", "left")
    rarity = F.struct(F.coalesce("seen", F.lit(0)).alias("seen"), F.col("token"), F.col("offset"))
    prefix = settle(rated.groupBy("wid").agg(F.min(rarity).alias("p"), F.first("words").alias("window"), F.first("n").alias("n"), F.first("k").alias("k")).where("p.seen > 0").select("wid", "window", "n", "k", F.col("p.token").alias("token"), F.col("p.offset").cast("int").alias("offset")))
    spans = whole.where(F.size("spans") > 0).select("id", "key", F.explode("spans").alias("s")).select("id", "key", "s.*")
    sizes = F.array(*(F.lit(k) for k in sorted(least))) if least else F.array().cast("array<int>")
    placed = spans.select("id", "key", "at", "words", F.explode(sizes).alias("k")).where(F.size("words") >= F.col("k"))
    around = placed.select("id", "key", "at", "words", "k", F.size("words").alias("len"), F.explode(shingles(F.col("words"), F.col("k"))).alias("s"))
    # Each token carries the words that a window through it can reach, a bounded number.
    first = F.greatest(F.lit(0), F.col("s.offset") - (window - 1))
    tokens = around.select("id", "key", (F.col("at") + first).alias("at"), F.slice("words", first + 1, F.lit(2 * window)).alias("near"), (F.col("s.offset") - first).alias("pos"), "k", F.col("s.token").alias("token"))
    met = tokens.join(prefix, ["token", "k"])
    start = F.col("pos") - F.col("offset")
    hits = met.where((start >= 0) & (start + F.col("n") <= F.size("near"))).where(F.slice("near", start + 1, F.col("n")) == F.col("window"))
    found = settle(hits.select("id", "key", "wid", (F.col("at") + start).alias("start"), (F.col("at") + start + F.col("n")).alias("end")).distinct())
    grown = F.aggregate(
        F.array_sort("places"),
        F.struct(F.lit(0).cast("bigint").alias("hit"), F.lit(0).cast("bigint").alias("upto")),
        lambda acc, x: F.struct((acc["hit"] + F.greatest(F.lit(0).cast("bigint"), x["end"] - F.greatest(x["start"], acc["upto"]))).alias("hit"), F.greatest(acc["upto"], x["end"]).alias("upto")),
        lambda acc: acc["hit"],
    )
    # A document's places and items are no more than its words and their windows.
    covered = found.groupBy("id", "key").agg(F.collect_set(F.struct("start", "end")).alias("places")).select("id", "key", grown.alias("n_hit"))
    named = found.select("id", "key", "wid").distinct().join(settle(owners), "wid").where("item_id IS NOT NULL")
    listed = named.groupBy("id", "key").agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    both = covered.join(listed, _same("id", "key", covered, listed), "left").select(covered["id"].alias("__id"), covered["key"].alias("__key"), "n_hit", "items")
    out = whole.select("id", "key", "n_words").join(both, F.col("id").eqNullSafe(F.col("__id")) & (F.col("key") == F.col("__key")), "left")
    return out.select(
        F.col("id").alias(id_col),
        *([F.col("key").alias(key_out)] if key_out else []),
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def _same(a: str, b: str, left: DataFrame, right: DataFrame) -> Column:
    return left[a].eqNullSafe(right[a]) & (left[b] == right[b])


def clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that hold no window of any item, all columns as they were, in any number of repeats.

    A row is judged by its own text, whatever others have its id or none. Null texts stay.
    """
    found = contamination(docs.select(id_col, text), items, id_col, text, key_out="__key", **options).where("contaminated")
    dirty = small_enough(settle(found.select(F.col(id_col).alias("__id"), "__key").distinct()))
    marked = docs.withColumn("__row_key", row_key(F.col(text)))
    return marked.join(dirty, marked[id_col].eqNullSafe(dirty["__id"]) & (marked["__row_key"] == dirty["__key"]), "left_anti").drop("__row_key")
