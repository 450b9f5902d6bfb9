"""The best rows of each query, kept by the task that meets them, so that no pair is shuffled to be counted."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Cells of a table of texts and queries that a task counts at once.
CELLS = 1 << 21
#: Texts of a task's first table, before any bound is known; each table has twice those of the one before it.
FIRST_TEXTS = 64


class Best:
    """The ``k`` first of each query's rows; a row is a tuple that begins with its score, negated.

    ``bound`` holds each query's k-th score so far: a row below it can't be among the first.
    """

    def __init__(self, queries: int, k: int):
        self.rows: list[list[tuple]] = [[] for _ in range(queries)]
        self.k, self.bound = k, np.zeros(queries)

    def add(self, queries: np.ndarray, rows: list[tuple]) -> None:
        for q, row in zip(queries.tolist(), rows, strict=True):
            self.rows[q].append(row)
        for q in np.unique(queries).tolist():
            own = self.rows[q]
            own.sort()
            del own[self.k :]
            if len(own) == self.k:
                self.bound[q] = -own[-1][0]


class Postings:
    """Which queries have a key, with a weight; keys are numbers from 0, and a query's pairs stand in any order."""

    def __init__(self, keys: np.ndarray, queries: np.ndarray, weights: np.ndarray | None = None):
        order = np.argsort(keys, kind="stable")
        self.queries, self.weights = queries[order], None if weights is None else weights[order]
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(keys, minlength=int(keys.max(initial=-1)) + 1))])

    def sums(self, at: np.ndarray, keys: np.ndarray, texts: int, queries: int) -> np.ndarray:
        """A table of texts by queries: the number, or weight, of the pairs that a text's keys have."""
        known = keys < len(self.starts) - 1
        at, keys = at[known], keys[known]
        n = self.starts[keys + 1] - self.starts[keys]
        own = np.repeat(self.starts[keys], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        cells = np.repeat(at, n) * queries + self.queries[own]
        return np.bincount(cells, None if self.weights is None else self.weights[own], minlength=texts * queries).reshape(texts, queries)


def tables(batch: pa.RecordBatch, queries: int, before: int):
    """The batch in parts of at most CELLS cells, small at first; ``before`` is the number of texts the task has met."""
    at = 0
    while at < batch.num_rows:
        n = min(max(FIRST_TEXTS, before + at), max(1, CELLS // max(1, queries)))
        yield batch.slice(at, n)
        at += n


def spans(lists: pa.ListArray) -> tuple[np.ndarray, pa.Array]:
    """For each item of the lists, null ones left out, the number of its list; and all items."""
    sizes = np.diff(lists.offsets.to_numpy()) if not lists.null_count else np.array([len(x) if x.is_valid else 0 for x in lists], dtype=np.int64)
    return np.repeat(np.arange(len(lists)), sizes), lists.flatten()


def dealt(rows: DataFrame) -> DataFrame:
    """Rows dealt to all cores where their files make fewer tasks; larger tables stay where they are."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(4 * cores) if rows.rdd.getNumPartitions() < cores else rows
