"""Runs of repeated words, by longest previous factors (operator 13).

A run is a stretch of words with smallest period q that no neighbouring word extends. Of
a batch of texts, whose words are told apart by text, the suffix array and its LCP give
the longest previous factor (LPF) at each word; these cut the texts into LZ blocks. A run
that touches the border of a block is found by Main's extensions to both sides of the
border, with a period no longer than the blocks beside it; a run inside a block is a copy
of one inside the block's earlier occurrence, and is copied from the bucket of its start.
All steps but the walk over blocks are array operations over the batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A run has this many words at least, and as many times its period.
MIN_LENGTH, MIN_EXPONENT = 24, 3
#: Words after which a batch of texts is judged; a longer text is a batch of its own.
BATCH_WORDS = 200_000


class Suffixes:
    """Suffix array, LCP and comparisons of the words ``codes``; texts must not share a code.

    Doubling ranks all stretches of 1, 2, 4, ... words; stretches that are unique already
    aren't sorted again. The ranks also tell how far two places agree, forwards and backwards.
    """

    def __init__(self, codes: np.ndarray):
        n = self.n = len(codes)
        order = np.argsort(codes, kind="stable")
        rank = np.full(n + 1, -1, np.int32)
        rank[order], shared = _heads(codes[order], np.arange(n))
        self.array, self.ranks = order, [rank]
        active, step = order[shared], 1
        while len(active):
            key = rank[active].astype(np.int64) * (n + 2) + rank[np.minimum(active + step, n)] + 1
            by = np.argsort(key, kind="stable")
            active, key = active[by], key[by]
            slots = rank[active] + _within(key // (n + 2))
            self.array[slots] = active
            rank = rank.copy()
            rank[active], shared = _heads(key, slots)
            self.ranks.append(rank)
            active, step = active[shared], step * 2

    def ahead(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words agree from ``i`` and from ``j`` on; ``i`` and ``j`` differ."""
        return self._agree(i, j, lambda at, off, k: at + off)

    def behind(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words agree right before ``i`` and right before ``j``."""
        return self._agree(i, j, lambda at, off, k: at - off - (1 << k))

    def _agree(self, i: np.ndarray, j: np.ndarray, place: Callable) -> np.ndarray:
        def same(rows: np.ndarray, off: np.ndarray | int, k: int) -> np.ndarray:
            a, b = place(i[rows], off, k), place(j[rows], off, k)
            inside = np.minimum(a, b) >= 0
            return inside & (self.ranks[k][np.where(inside, a, 0)] == self.ranks[k][np.where(inside, b, 0)])

        levels = []  # rows that agree on 1, 2, 4, ... words
        rows = np.arange(len(i))
        for k in range(len(self.ranks)):
            rows = rows[same(rows, 0, k)]
            if not len(rows):
                break
            levels.append(rows)
        out = np.zeros(len(i), np.int64)
        for k in range(len(levels) - 1, -1, -1):
            rows = levels[k]
            out[rows] += same(rows, out[rows], k).astype(np.int64) << k
        return out

    def equal(self, i: np.ndarray, j: np.ndarray, k: int) -> np.ndarray:
        """Whether the ``2**k`` words from ``i`` and from ``j`` are the same; false before the first word."""
        if k >= len(self.ranks):
            return np.zeros(len(i), bool)
        inside = np.minimum(i, j) >= 0
        return inside & (self.ranks[k][np.where(inside, i, 0)] == self.ranks[k][np.where(inside, j, 0)])

    def previous_factors(self) -> tuple[np.ndarray, np.ndarray]:
        """LPF: at each word the most words that also begin at some earlier word, and that word (-1: none).

        The longest is shared with the nearest suffix above or below in the suffix array
        that begins earlier; pointers to it jump over later ones, with the least LCP between.
        """
        n, array = self.n, self.array
        lcp = np.zeros(n, np.int64)
        if n > 1:
            lcp[1:] = self.ahead(array[:-1], array[1:])
        length, source = np.zeros(n, np.int64), np.full(n, -1, np.int64)
        for step in (-1, 1):
            low = lcp.copy() if step < 0 else np.append(lcp[1:], 0)
            to = np.arange(n) + step
            rows = np.flatnonzero(low)
            while True:
                rows = rows[low[rows] > 0]
                rows = rows[array[to[rows]] > array[rows]]
                if not len(rows):
                    break
                over = to[rows]
                low[rows], to[rows] = np.minimum(low[rows], low[over]), to[over]
            better = np.flatnonzero(low > length[array])
            length[array[better]], source[array[better]] = low[better], array[to[better]]
        return length, source


def _within(groups: np.ndarray) -> np.ndarray:
    """Place of each item in its group, where equal neighbours are a group."""
    new = np.append(True, groups[1:] != groups[:-1])
    at = np.arange(len(groups))
    return at - np.maximum.accumulate(np.where(new, at, 0))


def _heads(keys: np.ndarray, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The slot of the first of each group of equal neighbours, and whether the group has others."""
    if not len(keys):
        return slots.astype(np.int32), np.zeros(0, bool)
    new = np.append(True, keys[1:] != keys[:-1])
    first = np.maximum.accumulate(np.where(new, np.arange(len(keys)), 0))
    return slots[first].astype(np.int32), ~(new & np.append(new[1:], True))


def find_runs(codes: np.ndarray, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> list[tuple[int, int, int]]:
    """All runs (start, length, period) of at least both bounds, by start, then period.

    ``codes`` are the words of one or more texts that share no code. ``min_exponent`` is 2 at least.
    """
    if min_exponent < 2:
        raise ValueError("a run repeats its period twice at least")
    n = len(codes)
    if not n:
        return []
    suffixes = Suffixes(codes)
    length, source = suffixes.previous_factors()
    starts, jump, at = [], np.maximum(length, 1).tolist(), 0
    while at < n:
        starts.append(at)
        at += jump[at]
    starts = np.array(starts)
    sizes = np.diff(np.append(starts, n))
    found: dict[tuple[int, int], int] = {}
    # A run that touches a border has its first full period before or after it. With an exponent of
    # three or more, the period before it is no longer than the block there; else than both blocks.
    before = sizes if min_exponent > 2 else sizes + np.append(sizes[1:], 0)
    for border, most, side in ((starts, sizes, 0), (starts + sizes, before, 1)):
        i = np.repeat(border, most)
        period = _within(i) + 1
        i = i - period if side else i
        j = i + period
        keep = (i >= 0) & (j <= n)
        i, j, period = i[keep], j[keep], period[keep]
        # Words that agree beside the border: one side has half of them, and so a power of two.
        needed = np.maximum((min_exponent - 1) * period, min_length - period)
        k = max(0, int((needed.min(initial=1 << 30) + 1) // 2).bit_length() - 1)
        near = suffixes.equal(i, j, k) | suffixes.equal(i - (1 << k), j - (1 << k), k)
        i, j, period = i[near], j[near], period[near]
        ahead, behind = suffixes.ahead(i, j), suffixes.behind(i, j)
        total = ahead + behind + period
        good = total >= np.maximum(min_length, min_exponent * period)
        for s, m, p in zip((i - behind)[good].tolist(), total[good].tolist(), period[good].tolist(), strict=True):
            if p < found.get((s, m), n + 1):
                found[s, m] = p
    if found:
        _copy_inner(found, starts, sizes, source, min_length)
    return sorted(((s, m, p) for (s, m), p in found.items()), key=lambda r: (r[0], r[2]))


def _copy_inner(found: dict[tuple[int, int], int], starts: np.ndarray, sizes: np.ndarray, source: np.ndarray, min_length: int) -> None:
    """Add the runs inside blocks: block by block, and in a block by start, those of its earlier occurrence."""
    buckets: dict[int, list[tuple[int, int]]] = {}
    for (s, m), p in found.items():
        buckets.setdefault(s, []).append((m, p))
    for k in np.flatnonzero(sizes >= min_length + 2).tolist():
        block, size = int(starts[k]), int(sizes[k])
        first = int(source[block])
        for s in range(first + 1, first + size - min_length):
            for m, p in tuple(buckets.get(s, ())):
                here = s + block - first
                if s + m < first + size and (here, m) not in found:
                    found[here, m] = p
                    buckets.setdefault(here, []).append((m, p))


class _Ids(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = made = len(self)
        return made


def runs_of_texts(texts: list[list[bytes]], min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> list[list[tuple[int, int, int]]]:
    """The runs of each list of words."""
    ids = _Ids()
    sizes = [len(t) for t in texts]
    words = np.fromiter((ids[w] for t in texts for w in t), np.int64, sum(sizes))
    codes = words + np.repeat(np.arange(len(texts)), sizes) * max(1, len(ids))
    ends = np.cumsum(sizes)
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for s, m, p in find_runs(codes, min_length, min_exponent):
        k = int(np.searchsorted(ends, s, side="right"))
        out[k].append((s - int(ends[k]) + sizes[k], m, p))
    return out


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run holds after its first period."""
    if not runs:
        return words
    drop = np.zeros(len(words), bool)
    for s, m, p in runs:
        drop[s + p : s + m] = True
    return [w for w, d in zip(words, drop.tolist(), strict=True) if not d]


RUNS = "n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"
_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def detect(docs: DataFrame, id_col: str = "doc_id", text: str = "text", min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT, prepare: Callable[[object, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """Per row of ``docs``: the id, ``n_words``, ``runs`` (by start, then period) and the text ``collapsed``.

    Words are parted by ASCII white space. ``collapsed`` has, joined by one blank, the words
    that no run holds after its first period. ``prepare(id, words)`` may change the words
    first. A null or wordless text has no word, no run and an empty ``collapsed``; repeated
    rows repeat in the result; no rows give no rows. Rows are judged where they are, without
    a shuffle; a text needs some hundred bytes a word.
    """
    kind = docs.select(id_col).schema[0].dataType.simpleString()

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, texts, size = 0, [], 0
            for k in range(len(batch)):
                words = (batch.column(1)[k].as_py() or "").encode("utf-8", "surrogatepass").split()
                words = prepare(batch.column(0)[k].as_py(), words) if prepare else words
                if texts and size + len(words) > BATCH_WORDS:
                    yield judged(batch.column(0).slice(first, len(texts)), texts)
                    first, texts, size = k, [], 0
                texts.append(words)
                size += len(words)
            if texts:
                yield judged(batch.column(0).slice(first, len(texts)), texts)

    def judged(ids: pa.Array, texts: list[list[bytes]]) -> pa.RecordBatch:
        runs = runs_of_texts(texts, min_length, min_exponent)
        kept = [b" ".join(collapse(t, r)).decode("utf-8", "replace") for t, r in zip(texts, runs, strict=True)]
        listed = [[{"start": s, "length": m, "period": p} for s, m, p in r] for r in runs]
        return pa.RecordBatch.from_arrays([ids, pa.array(map(len, texts), pa.int64()), pa.array(listed, _RUNS), pa.array(kept, pa.string())], names=["id", "n_words", "runs", "collapsed"])

    return docs.select(id_col, text).mapInArrow(of, f"id {kind}, {RUNS}").withColumnRenamed("id", id_col)
