"""Dialogue state by conversation, as a batch fold and as a stateful stream.

Both fold turns by :func:`turn`, so they agree turn by turn. State is flat: pending
intent, anchors, phase and whether a knowledge detour is open.
"""

from __future__ import annotations

from collections import namedtuple
from collections.abc import Iterator
from dataclasses import astuple, dataclass, replace

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

# The tool that completes each servicing intent, and those that change state.
SERVICING_TOOLS = {
    "view_accounts": "list_accounts", "view_cards": "list_cards", "freeze_card": "freeze_card", "replace_card": "replace_card",
    "view_transactions": "list_transactions", "dispute_transaction": "dispute_transaction", "view_transfers": "list_transfers",
    "cancel_transfer": "cancel_transfer", "view_service_cases": "list_service_cases",
}
CONFIDENCE, RESET = 0.5, "reset"
OUT = "conv_id bigint, turn bigint, lane string, resumed boolean, pending_intent string, phase string, detour boolean"
INPUT = "conv_id bigint, turn bigint, route string, intent string, confidence double, resume boolean, user_text string, assistant_text string, tool string, tool_ok boolean"


@dataclass(frozen=True)
class State:
    intent: str = ""
    user_anchor: str = ""
    assistant_anchor: str = ""
    phase: str = ""
    detour: bool = False


#: What a router's observation does, by its kind and by how the conversation stands: lane, whether
#: a service is resumed, and the change of state (``open`` a service, ``leave`` it for a detour, ``come_back``).
#: A kind is ``resume`` (asked for, with a detour open), ``same`` or ``other`` service, or an intent by name.
TRANSITIONS = {
    ("resume", "detour"): ("servicing", True, "come_back"),
    ("same", "pending"): ("servicing", False, "stay"),
    ("same", "detour"): ("servicing", True, "come_back"),
    ("other", "idle"): ("servicing", False, "open"),
    ("other", "pending"): ("servicing", False, "open"),
    ("other", "detour"): ("servicing", False, "open"),
    ("policy_knowledge", "idle"): ("policy", False, "stay"),
    ("policy_knowledge", "pending"): ("policy", False, "leave"),
    ("policy_knowledge", "detour"): ("policy", False, "leave"),
    **{(name, stand): (name, False, "stay") for name in ("conversation", "other_banking") for stand in ("idle", "pending", "detour")},
}
_CHANGES = {
    "stay": lambda state, intent, text: state,
    "open": lambda state, intent, text: State(intent, text, "", "awaiting_assistant"),
    "leave": lambda state, intent, text: replace(state, detour=True),
    "come_back": lambda state, intent, text: replace(state, detour=False),
}


def begin(state: State, route: str | None, intent: str | None, confidence: float | None, resume: bool, user_text: str) -> tuple[State, str, bool]:
    """State, lane and whether a service was resumed, after the router's observation of a user message.

    An observation out of the domain, without an intent or below the confidence changes nothing.
    """
    sure = route == "in_domain" and bool(intent) and confidence is not None and confidence >= CONFIDENCE
    stand = "idle" if not state.intent else "detour" if state.detour else "pending"
    service = ("same" if intent == state.intent else "other") if intent in SERVICING_TOOLS else intent
    kinds = (["resume"] if resume else []) + [service] if sure else []
    lane, resumed, change = next((TRANSITIONS[k, stand] for k in kinds if (k, stand) in TRANSITIONS), ("unchanged", False, "stay"))
    return _CHANGES[change](state, intent, user_text), lane, resumed


def commit(state: State, tool: str | None, tool_ok: bool) -> State:
    """State after the turn's operations, before its answer is delivered: the matching tool's success clears it."""
    done = bool(state.intent) and tool_ok and tool == SERVICING_TOOLS[state.intent]
    return State() if done else state


def deliver(state: State, assistant_text: str) -> State:
    """State after delivery: a pending service's first answer becomes its anchor."""
    if state.intent and assistant_text and not state.assistant_anchor:
        return replace(state, assistant_anchor=assistant_text, phase="awaiting_user")
    return state


def finish(state: State, assistant_text: str, tool: str | None, tool_ok: bool) -> State:
    """Operations are committed first, so that a delivery that fails leaves no service pending that is done."""
    return deliver(commit(state, tool, tool_ok), assistant_text)


def _clean(value: object) -> object:
    return None if value is None or value is pd.NA or value is pd.NaT or isinstance(value, float) and value != value else value


def turn(state: State, row: object) -> tuple[State, tuple]:
    """One input row (fields of INPUT) to the next state and an output row (fields of OUT).

    A row of route ``reset`` forgets the conversation's state.
    """
    get = lambda k: _clean(getattr(row, k))
    if get("route") == RESET:
        return State(), (row.conv_id, row.turn, RESET, False, "", "", False)
    state, lane, resumed = begin(state, get("route"), get("intent"), get("confidence"), bool(get("resume")), get("user_text") or "")
    state = finish(state, get("assistant_text") or "", get("tool"), bool(get("tool_ok")))
    return state, (row.conv_id, row.turn, lane, resumed, state.intent, state.phase, state.detour)


def _names(ddl: str) -> list[str]:
    return [c.split()[0] for c in ddl.split(", ")]


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=_names(OUT))


def replay(rows: DataFrame) -> DataFrame:
    """Batch: folds each conversation's turns in order.

    Turns stream through a task sorted by conversation, and only the state is carried from
    batch to batch, so that a conversation of any length needs one batch of memory. Of rows
    that repeat a turn, the one with the least hash counts; rows without a turn don't.
    """

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state, last = object(), State(), None
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                here = _clean(row.conv_id)
                if here != key:
                    key, state, last = here, State(), None
                if row.turn == last:
                    continue
                last = row.turn
                state, made = turn(state, row)
                out.append(made)
            yield _frame(out)

    told = rows.where("turn IS NOT NULL").select(*_names(INPUT))
    return told.repartition("conv_id").sortWithinPartitions("conv_id", "turn", F.xxhash64(*_names(INPUT))).mapInPandas(fold, OUT)


_Waiting = namedtuple("_Waiting", [*_names(INPUT), "at_ms"])
_HELD = ", ".join(c for c in INPUT.split(", ") if c.split()[0] not in ("conv_id", "turn")) + ", at_ms bigint"


class DialogueProcessor(StatefulProcessor):
    """Streaming: the same fold, of turns numbered 0, 1, 2, ... that may come in any order.

    A turn that is early waits in a map of the conversation's state until all before it were
    folded, or until the watermark passes its own time by ``patience_ms``; then what is
    missing before it is given up. A turn below the next expected one is dropped: it repeats
    a turn that was folded, or comes after it was given up. Of a turn that repeats while it
    waits, the first that came stays.
    """

    def __init__(self, patience_ms: int):
        self.patience_ms = patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.value = handle.getValueState("dialogue", "expected bigint, waiting bigint, intent string, user_anchor string, assistant_anchor string, phase string, detour boolean")
        self.early = handle.getMapState("early", "turn bigint", _HELD)

    def _load(self) -> None:
        held = self.value.get() if self.value.exists() else (0, 0, *astuple(State()))
        self.expected, self.waiting, self.state, self.out = held[0], held[1], State(*held[2:]), []

    def _fold(self, row: object) -> None:
        self.state, made = turn(self.state, row)
        self.out.append(made)
        self.expected = row.turn + 1

    def _release(self, conv_id: object) -> None:
        """Fold the turns that wait and are next."""
        while self.waiting and self.early.containsKey((self.expected,)):
            at = self.expected
            self._fold(_Waiting(conv_id, at, *self.early.getValue((at,))))
            self.early.removeKey((at,))
            self.waiting -= 1

    def _save(self) -> pd.DataFrame:
        self.value.update((self.expected, self.waiting, *astuple(self.state)))
        return _frame(self.out)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        self._load()
        for row in pd.concat(list(rows)).sort_values("turn", kind="stable").itertuples(index=False):
            at = _clean(row.turn)
            if at is None or at < self.expected:
                continue
            if at == self.expected:
                self._fold(row)
                self._release(row.conv_id)
            elif not self.early.containsKey((int(at),)):
                at_ms = row.at.value // 1_000_000
                self.early.updateValue((int(at),), (*(_clean(getattr(row, c)) for c in _names(_HELD)[:-1]), at_ms))
                self.handle.registerTimer(at_ms + self.patience_ms)
                self.waiting += 1
        yield self._save()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._load()
        watermark = timerValues.getCurrentWatermarkInMs()
        waiting = sorted((k[0], v[-1]) for k, v in self.early.iterator()) if self.waiting else []
        for at, at_ms in waiting:
            if at < self.expected:
                continue  # folded just before
            if at_ms + self.patience_ms > watermark:
                break
            self.expected = at
            self._release(key[0])
        yield self._save()

    def close(self) -> None:
        pass


def stream(rows: DataFrame, at: str = "at", late: str = "1 hour", patience: int = 3600) -> DataFrame:
    """Streaming twin of :func:`replay` for turns numbered from 0 in each conversation, with event times ``at``.

    Whatever order and batches the turns come in, as long as none is later than the watermark
    (``late``) and gaps close within ``patience`` seconds of event time, the rows are those of the batch.
    Needs the RocksDB state store provider.
    """
    timed = rows.withColumn("at", F.col(at).cast("timestamp")).withWatermark("at", late).select(*_names(INPUT), "at")
    return timed.groupBy("conv_id").transformWithStateInPandas(DialogueProcessor(patience * 1000), outputStructType=T._parse_datatype_string(OUT), outputMode="Append", timeMode="EventTime")
