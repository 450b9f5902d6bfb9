"""Registries of live sessions: at most so many, each until it idles too long.

An access to a session that isn't live opens it; where the registry is full, the session
whose last access is oldest is evicted first. A session is live while its last access is at
most ``ttl`` seconds ago. Live sessions are thus the most recent distinct ones of a registry,
so a batch needs only those to go on from any place, and a stream keeps only those.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from sievework.sources.scratch import settle

# Seconds that a session may idle, and sessions that a registry holds.
TTL, MOST = 7200, 32
OUT = "registry string, session string, at_us bigint, change string"


class Registry:
    """The live sessions of one registry, the least recent first, with the times (microseconds) of their last accesses."""

    def __init__(self, live: list[tuple[str, int]] = (), ttl: int = TTL, most: int = MOST):
        self.live: OrderedDict[str, int] = OrderedDict(live)
        self.idle, self.most = ttl * 1_000_000, most

    def expire(self, now: int) -> list[tuple[str, int, str]]:
        """Sessions that idle too long at ``now``, each at the time when it stopped to be live."""
        gone = []
        while self.live and now - (last := next(iter(self.live.values()))) > self.idle:
            gone.append((self.live.popitem(last=False)[0], last + self.idle, "expired"))
        return gone

    def access(self, session: str, now: int) -> list[tuple[str, int, str]]:
        """The changes by an access; one that is older than the newest counts as made at its time."""
        now = max(now, next(reversed(self.live.values()), now))
        changes = self.expire(now)
        if session not in self.live:
            while len(self.live) >= self.most:
                changes.append((self.live.popitem(last=False)[0], now, "evicted"))
            changes.append((session, now, "opened"))
        self.live[session] = now
        self.live.move_to_end(session)
        return changes


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[c.split()[0] for c in OUT.split(", ")])


def changes(accesses: DataFrame, ttl: int = TTL, most: int = MOST) -> DataFrame:
    """All changes of all registries, from ``registry string, session string, at timestamp, id`` in order of time and id.

    Accesses are dealt out by ranges of that order, whatever share one registry has. A first pass
    keeps, for the last registry of each part, the sessions that live at its end; from these (at
    most ``most`` a part, merged on the driver) each part knows what lived before it, and a second
    pass makes the changes. Rows with a null session or time don't count; a null registry is one of its own.
    """
    told = accesses.where("session IS NOT NULL AND at IS NOT NULL").select("registry", "session", F.unix_micros(F.col("at").cast("timestamp")).alias("at_us"), "id")
    parts = settle(told.repartitionByRange("registry", "at_us", "id").sortWithinPartitions("registry", "at_us", "id").select("registry", "session", "at_us"))

    def ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first, held, seen = None, {}, False
        last = None
        for batch in batches:
            for registry, session, at in batch.itertuples(index=False):
                if not seen:
                    first, seen = registry, True
                if registry != last or not held:
                    held, last = {}, registry
                held.pop(session, None)
                held[session] = at
                if len(held) > 4 * most:
                    held = dict(list(held.items())[-most:])
        if seen:
            kept = list(held.items())[-most:]
            part = TaskContext.get().partitionId()
            yield pd.DataFrame([(part, first, last, s, int(at), n) for n, (s, at) in enumerate(kept)], columns=["part", "first", "last", "session", "at_us", "n"])

    known: dict[int, tuple] = {}
    for r in parts.mapInPandas(ends, "part bigint, first string, last string, session string, at_us bigint, n bigint").orderBy("part", "n").collect():
        known.setdefault(r["part"], (r["first"], r["last"], []))[2].append((r["session"], r["at_us"]))
    before: dict[int, list[tuple[str, int]]] = {}
    open_registry, live = object(), []
    for part in sorted(known):
        first, last, own = known[part]
        before[part] = live if first == open_registry else []
        carried = before[part] if first == last else []
        fresh = {s for s, _ in own}
        merged = [x for x in carried if x[0] not in fresh] + own
        live = [x for x in merged if merged[-1][1] - x[1] <= ttl * 1_000_000][-most:]
        open_registry = last

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = object(), None
        for batch in batches:
            out = []
            for registry, session, at in batch.itertuples(index=False):
                if state is None or registry != key:
                    state = Registry(before.get(TaskContext.get().partitionId(), []) if state is None else [], ttl, most)
                    key = registry
                out += [(registry, *c) for c in state.access(session, at)]
            yield _frame(out)

    return parts.mapInPandas(fold, OUT)


class RegistryProcessor(StatefulProcessor):
    """The stream's registries: the live sessions are kept between batches; a timer ends those that idle."""

    def __init__(self, ttl: int, most: int):
        self.ttl, self.most = ttl, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getMapState("live", "session string", "at_us bigint, n bigint")

    def _load(self) -> Registry:
        found = sorted((v[1], k[0], v[0]) for k, v in self.held.iterator())
        return Registry([(s, at) for _, s, at in found], self.ttl, self.most)

    def _save(self, key: tuple, state: Registry, made: list[tuple]) -> pd.DataFrame:
        self.held.clear()
        for n, (session, at) in enumerate(state.live.items()):
            self.held.updateValue((session,), (at, n))
        if state.live:
            self.handle.registerTimer((next(iter(state.live.values())) + state.idle) // 1000 + 1)
        return _frame([(key[0], *c) for c in made])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state, made = self._load(), []
        for row in pd.concat(list(rows)).sort_values(["at", "id"], kind="stable").itertuples(index=False):
            made += state.access(row.session, row.at.value // 1000)
        yield self._save(key, state, made)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        state = self._load()
        made = state.expire(timerValues.getCurrentWatermarkInMs() * 1000)
        yield self._save(key, state, made)

    def close(self) -> None:
        pass


def stream(accesses: DataFrame, ttl: int = TTL, most: int = MOST, late: str = "10 minutes") -> DataFrame:
    """Streaming twin of :func:`changes` for accesses that come in order over batches; sessions that idle are ended as the watermark passes."""
    timed = accesses.where("session IS NOT NULL AND at IS NOT NULL").select("registry", "session", F.col("at").cast("timestamp").alias("at"), "id").withWatermark("at", late)
    return timed.groupBy("registry").transformWithStateInPandas(RegistryProcessor(ttl, most), outputStructType=T._parse_datatype_string(OUT), outputMode="Append", timeMode="EventTime")
