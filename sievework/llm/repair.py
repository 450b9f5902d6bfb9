"""Repair of conversation structure by cost layers (operator 11).

The roles of a conversation's turns must spell ``(s?(ua)+)?``. A turn may be kept, given
another role, deleted, or preceded by an inserted one, each at a cost. For each cost from
zero up, a layer holds at every turn a bitset of the grammar states from which the rest
can be repaired at exactly that cost; a layer follows from the few layers before it. The
first layer whose first bitset has the start state is the cost, and a walk over the bits
that takes the least edit at each turn gives the least audit.

Long conversations are cut into stretches. The layers of a stretch, from each state at
its end, give the costs between states at its two ends; these add up from the last
stretch to the first, so that the work grows with the number of turns and not its square.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.llm._common import fresh_folder, remove_folder, settle

#: Costs: another role, a deletion, an insertion, and what a truncated turn adds unless deleted.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: Turns of a stretch; turns and characters that a piece of a conversation has, at most, but for one long turn.
STRETCH, PIECE_TURNS, PIECE_CHARS = 32, 4096, 4 << 20
BLANKS = " \t\n\x0b\x0c\r"
_ENDS = (".", "!", "?")
# Grammar states: nothing yet, after s, after u (an a is due), after a. A conversation may end in the first and last.
_STATES, _START, _ACCEPT = 4, 0, 0b1001
_NEXT = (2, 2, 3, 2)  # by a user or assistant turn, whichever is due
_BY_ROLE = {"s": (1, None, None, None), "u": (2, 2, None, 2), "a": (None, None, 3, None)}
_NOWHERE = (None,) * _STATES


def _before(step: tuple) -> tuple[int, ...]:
    """For each set of states, the set of those that ``step`` leads into it."""
    return tuple(sum(1 << q for q in range(_STATES) if step[q] is not None and states >> step[q] & 1) for states in range(1 << _STATES))


_BEFORE_NEXT = _before(_NEXT)
_BEFORE_ROLE = {c: _before(s) for c, s in _BY_ROLE.items()}
_BEFORE_NONE = _before(_NOWHERE)
# A turn to the solver: its role's initial (or a point for any other) and its fault: none, t (truncated) or x (must go).
Turn = tuple[str, str]


class Layers:
    """The layers of a stretch. ``after`` has what is left to pay in each state that it may end in; turns may be inserted at the end of the ``last``."""

    def __init__(self, turns: list[Turn], after: dict[int, int], last: bool):
        self.turns, self.last, self.base = turns, last, min(after.values())
        self.ends: dict[int, int] = {}
        for state, cost in after.items():
            self.ends[cost - self.base] = self.ends.get(cost - self.base, 0) | 1 << state
        self.layers: list[list[int]] = []

    def states(self, cost: int, at: int) -> int:
        return self.layers[cost][at] if cost >= 0 else 0

    def grow(self) -> int:
        """Add the layer of the next cost and return the states at the stretch's beginning."""
        d, n, get = len(self.layers), len(self.turns), self.states
        layer = [0] * (n + 1)
        self.layers.append(layer)
        layer[n] = self.ends.get(d, 0) | (_BEFORE_NEXT[get(d - INSERT, n)] if self.last else 0)
        for i in range(n - 1, -1, -1):
            role, fault = self.turns[i]
            found = get(d - DELETE, i + 1) | _BEFORE_NEXT[get(d - INSERT, i)]
            if fault != "x":
                add = TRUNCATED if fault == "t" else 0
                found |= _BEFORE_ROLE.get(role, _BEFORE_NONE)[get(d - add, i + 1)] | _BEFORE_NEXT[get(d - REROLE - add, i + 1)]
            layer[i] = found
        return layer[0]

    def reach(self, wanted: int) -> int:
        """The first cost at which all states of the set ``wanted`` have been seen at the beginning."""
        seen = 0
        while wanted & ~seen:
            seen |= self.grow()
        return len(self.layers) - 1

    def costs(self) -> dict[int, int]:
        """What is left to pay in each state at the beginning."""
        self.reach((1 << _STATES) - 1)
        return {q: self.base + next(d for d, layer in enumerate(self.layers) if layer[0] >> q & 1) for q in range(_STATES)}

    def trace(self, state: int, cost: int) -> tuple[list[tuple[str, int]], int]:
        """The least edits from ``state`` at ``cost``, each with the state that it leads to, and the last state."""
        out, i, n = [], 0, len(self.turns)
        while i < n or not self.ends.get(cost, 0) >> state & 1:
            role, fault = self.turns[i] if i < n else ("", "x")
            add = TRUNCATED if fault == "t" else 0
            choices = [("D", DELETE, 1, range(_STATES))] if i < n else []
            choices += [("I", INSERT, 0, _NEXT)]
            if fault != "x":
                choices += [("K", add, 1, _BY_ROLE.get(role, _NOWHERE)), ("R", REROLE + add, 1, _NEXT)]
            for edit, price, taken, step in choices:  # in the order of their letters
                to = step[state]
                if to is not None and self.states(cost - price, i + taken) >> to & 1:
                    break
            out.append((edit, to))
            state, cost, i = to, cost - price, i + taken
        return out, state


def solve(turns: list[Turn]) -> tuple[int, list[tuple[str, int]]]:
    """The least cost, and the edits of the least audit, each with the state that it leads to."""
    cuts = [turns[a : a + STRETCH] for a in range(0, len(turns), STRETCH)] or [[]]
    final = len(cuts) - 1
    after = [{q: 0 for q in range(_STATES) if _ACCEPT >> q & 1}]
    for k in range(final, 0, -1):
        after.append(Layers(cuts[k], after[-1], k == final).costs())
    total, state, edits = None, _START, []
    for k, cut in enumerate(cuts):
        layers = Layers(cut, after[final - k], k == final)
        cost = layers.reach(1 << state)
        total = cost + layers.base if total is None else total
        made, state = layers.trace(state, cost)
        edits += made
    return total, edits


def fault_of(text: str, repeated: bool) -> str:
    """``blank``, ``duplicate``, ``truncated`` or the empty string."""
    bare = text.rstrip(BLANKS)
    return "blank" if not bare else "duplicate" if repeated else "" if bare.endswith(_ENDS) else "truncated"


def code_of(role: str, fault: str) -> Turn:
    return role[:1] if role[:1] in _BY_ROLE else ".", {"": "", "truncated": "t"}.get(fault, "x")


def apply(edits: list[tuple[str, int]], roles: list[str], texts: list[str]) -> list[tuple[str, str, str]]:
    """The repaired turns: edit, role and text."""
    out, i = [], 0
    for edit, state in edits:
        if edit == "K":
            out.append((edit, roles[i], texts[i]))
        elif edit != "D":
            out.append((edit, "user" if state == 2 else "assistant", "" if edit == "I" else texts[i]))
        i += edit != "I"
    return out


_TURNS = pa.list_(pa.struct([("edit", pa.string()), ("role", pa.string()), ("text", pa.string())]))
_REPORT = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
_SPAN = ["lowest", "highest", "n_turns", "first_turn", "last_turn"]
_PIECE_FIELDS = [
    ("part", pa.int64()), ("seq", pa.int64()), ("whole", pa.bool_()), *((k, pa.int64()) for k in _REPORT), ("audit", pa.string()), ("turns", _TURNS),
    ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string())), ("digests", pa.list_(pa.binary())), *((k, pa.int64()) for k in _SPAN),
]
_PIECES = "part bigint, seq bigint, whole boolean, " + ", ".join(f"{k} bigint" for k in _REPORT) + ", audit string, turns array<struct<edit:string,role:string,text:string>>, roles array<string>, texts array<string>, digests array<binary>, " + ", ".join(f"{k} bigint" for k in _SPAN)


def _digest(role: str, text: str) -> bytes:
    return hashlib.md5(f"{len(role)}:{role}{text}".encode("utf-8", "surrogatepass")).digest()


def _faults(roles: list[str], texts: list[str], digests: list[bytes], seen: set[bytes]) -> list[str]:
    out = []
    for text, digest in zip(texts, digests, strict=True):
        out.append(fault_of(text, digest in seen))
        seen.add(digest)
    return out


def _illegal(initials: list[str]) -> int:
    return sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))


def _span(turns: list[int | None]) -> tuple:
    told = [t for t in turns if t is not None]
    return (told[0], told[-1], len(set(told)), told[0], told[-1]) if told else (None, None, 0, None, None)


def _batch(ids: list, id_type: pa.DataType, rows: list[tuple], fields: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(ids, id_type), *(pa.array(c, t) for c, (_, t) in zip(columns, fields, strict=True))], names=["conv_id", *(k for k, _ in fields)])


def write_pieces(rows: DataFrame, folder: str, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", tie: Column | None = None, present: Column | None = None) -> DataFrame:
    """Write every conversation to ``folder`` as pieces, repaired already where it is one whole piece.

    Rows are dealt out by ranges of conversation, turn and tie, so that a task reads whole
    conversations in order but for those at its ends and those longer than a piece; these are
    left open, as pieces of their rows, whatever the share of one conversation. Null turns come
    first; rows of one turn follow ``tie``, by default the digest of role and text. Where
    ``present`` is false, a row tells only that there is its conversation. Null roles and texts are empty.
    """
    kind = rows.select(conv_id).schema[0].dataType.simpleString()
    role_col, text_col = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    made = rows.select(
        F.col(conv_id).alias("conv_id"), F.col(turn).cast("bigint").alias("turn"), role_col.alias("role"), text_col.alias("text"),
        (F.md5(F.concat(role_col, F.lit("\n"), text_col)) if tie is None else tie).alias("tie"),
        (F.lit(True) if present is None else present).alias("present"), F.monotonically_increasing_id().alias("row"),
    )
    ordered = made.repartitionByRange("conv_id", "turn", "tie", "row").sortWithinPartitions("conv_id", "turn", "tie", "row").select("conv_id", "turn", "role", "text", "present")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, key, seq, edge, began = TaskContext.get().partitionId(), None, 0, True, False
        turns, roles, texts = [], [], []
        chars = size = 0
        ids, out, id_type = [], [], pa.null()

        def emit(whole: bool) -> None:
            nonlocal seq, chars, size
            digests = [_digest(r, t) for r, t in zip(roles, texts, strict=True)]
            span = _span(turns)
            if whole:
                faults = _faults(roles, texts, digests, set())
                cost, edits = solve([code_of(r, f) for r, f in zip(roles, faults, strict=True)])
                gaps = span[1] - span[0] + 1 - span[2] if span[2] else 0
                report = (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), _illegal([r[:1] for r in roles]), cost)
                fixed = [dict(zip(("edit", "role", "text"), t, strict=True)) for t in apply(edits, roles, texts)]
                out.append((part, seq, True, *report, "".join(e for e, _ in edits), fixed, None, None, None, *span))
            else:
                out.append((part, seq, False, *[None] * 7, None, list(roles), list(texts), digests, *span))
            ids.append(key)
            seq += 1
            size += chars
            turns.clear(), roles.clear(), texts.clear()
            chars = 0

        for batch in batches:
            id_type = batch.column(0).type
            for conv, at, who, body, there in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not began or conv != key:
                    if began:
                        emit(not edge and not seq)
                        edge = False
                    began, key, seq = True, conv, 0
                if there:
                    turns.append(at), roles.append(who), texts.append(body)
                    chars += len(who) + len(body)
                if len(roles) >= PIECE_TURNS or chars >= PIECE_CHARS:
                    emit(False)
                if len(out) >= 1024 or size >= PIECE_CHARS:
                    yield _batch(ids, id_type, out, _PIECE_FIELDS)
                    ids, out, size = [], [], 0
        if began:
            emit(False)
            yield _batch(ids, id_type, out, _PIECE_FIELDS)

    ordered.mapInArrow(cut, f"conv_id {kind}, {_PIECES}").write.parquet(folder)
    return rows.sparkSession.read.schema(f"conv_id {kind}, {_PIECES}").parquet(folder)


def _joined(left: DataFrame, right: DataFrame, keys: tuple[str, ...], how: str = "inner") -> DataFrame:
    """``left`` with the other columns of ``right`` where the keys are the same, nulls being equal."""
    to = right.select(*(F.col(k).alias(f"right_{k}") if k in keys else F.col(k) for k in right.columns))
    on = F.lit(True)
    for k in keys:
        on &= left[k].eqNullSafe(to[f"right_{k}"])
    return left.join(to, on, how).drop(*(f"right_{k}" for k in keys))


_PLACE = ("conv_id", "part", "seq")


def _coded(pieces: DataFrame, kind: str) -> DataFrame:
    """The open pieces as codes of two characters a turn, with the faults found in all pieces of the conversation."""
    spread = pieces.select("conv_id", "part", "seq", F.explode(F.array_distinct("digests")).alias("digest"))
    first = spread.groupBy("conv_id", "digest").agg(F.min(F.struct("part", "seq")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    later = _joined(spread, first, ("conv_id", "digest")).where(F.struct("part", "seq") > F.col("first"))
    known = later.groupBy(*_PLACE).agg(F.collect_set("digest").alias("known"))  # at most the turns of a piece
    joined = _joined(pieces, known, _PLACE, "left").select(*_PLACE, "roles", "texts", "digests", "known", *_SPAN)
    fields = [("part", pa.int64()), ("seq", pa.int64()), ("codes", pa.string()), ("first", pa.string()), ("last", pa.string()), *((k, pa.int64()) for k in (*_REPORT[1:5], *_SPAN))]

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for part, seq, roles, texts, digests, seen, *span in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True):
                faults = _faults(roles, texts, digests, set(seen or ()))
                codes = "".join(r + (f or "-") for r, f in (code_of(r, f) for r, f in zip(roles, faults, strict=True)))
                initials = [r[:1] for r in roles]
                rows.append((part, seq, codes, *((initials[0], initials[-1]) if initials else (None, None)), *(faults.count(f) for f in ("blank", "duplicate", "truncated")), _illegal(initials), *span))
            yield _batch(batch.column(0).to_pylist(), batch.column(0).type, rows, fields)

    return joined.mapInArrow(code, f"conv_id {kind}, part bigint, seq bigint, codes string, first string, last string, " + ", ".join(f"{k} bigint" for k in (*_REPORT[1:5], *_SPAN)))


def _solved(coded: DataFrame, kind: str) -> DataFrame:
    """Report, audit and the edits of each piece for every open conversation.

    The codes of a conversation, two characters a turn, meet in one row, as its audit does.
    """
    names = [c for c in coded.columns if c != "conv_id"]
    gathered = coded.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(*names))).alias("pieces"))
    edits = pa.list_(pa.struct([("part", pa.int64()), ("seq", pa.int64()), ("edits", pa.string()), ("states", pa.string())]))
    fields = [*((k, pa.int64()) for k in _REPORT), ("audit", pa.string()), ("pieces", edits)]

    def solve_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row in batch.column(1):
                pieces = row.as_py()
                told = [p for p in pieces if p["n_turns"]]
                twice = sum(a["last_turn"] == b["first_turn"] for a, b in zip(told, told[1:], strict=False))
                gaps = max(p["highest"] for p in told) - min(p["lowest"] for p in told) + 1 - sum(p["n_turns"] for p in told) + twice if told else 0
                held = [p for p in pieces if p["codes"]]
                across = sum(a["last"] + b["first"] not in ("su", "ua", "au") for a, b in zip(held, held[1:], strict=False))
                codes = "".join(p["codes"] for p in pieces)
                cost, made = solve([(codes[i], codes[i + 1].replace("-", "")) for i in range(0, len(codes), 2)])
                split, at = [], 0
                for k, p in enumerate(pieces):
                    end, left = at, len(p["codes"]) // 2
                    while end < len(made) and (left or k == len(pieces) - 1):
                        left -= made[end][0] != "I"
                        end += 1
                    split.append({"part": p["part"], "seq": p["seq"], "edits": "".join(e for e, _ in made[at:end]), "states": "".join(str(s) for _, s in made[at:end])})
                    at = end
                sums = [sum(p[k] for p in pieces) for k in _REPORT[1:5]]
                rows.append((gaps, *sums[:3], sums[3] + across, cost, "".join(e for e, _ in made), split))
            yield _batch(batch.column(0).to_pylist(), batch.column(0).type, rows, fields)

    return settle(gathered.mapInArrow(solve_all, f"conv_id {kind}, " + ", ".join(f"{k} bigint" for k in _REPORT) + ", audit string, pieces array<struct<part:bigint,seq:bigint,edits:string,states:string>>"))


def repair(rows: DataFrame, folder: str, **options) -> tuple[DataFrame, DataFrame]:
    """Repair every conversation; the report of each, and the repaired turns.

    The report has ``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit`` for every
    conversation of ``rows``, a null one among them. The turns are pieces ``conv_id, part, seq, turns``
    (edit, role and text each) to be read by ``part, seq``; most conversations are one. ``options`` are
    those of :func:`write_pieces`, which writes to ``folder``; both results read from it. Blank, repeated
    and truncated turns are judged as :func:`fault_of` tells; repeated rows are repeated turns; a
    conversation without a turn has zeros and an empty audit; no rows give no rows.
    """
    pieces = write_pieces(rows, folder, **options)
    kind = pieces.schema["conv_id"].dataType.simpleString()
    whole, opened = pieces.where("whole"), pieces.where("NOT whole")
    solved = _solved(_coded(opened, kind), kind)
    edits = solved.select("conv_id", F.explode("pieces").alias("p")).select("conv_id", "p.*")
    joined = _joined(opened, edits, _PLACE).select(*_PLACE, "roles", "texts", "edits", "states")

    def apply_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for roles, texts, letters, states in zip(*(c.to_pylist() for c in batch.columns[3:]), strict=True):
                made.append([dict(zip(("edit", "role", "text"), t, strict=True)) for t in apply(list(zip(letters, map(int, states), strict=True)), roles, texts)])
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(made, _TURNS)], names=["conv_id", "part", "seq", "turns"])

    fixed = joined.mapInArrow(apply_all, f"conv_id {kind}, part bigint, seq bigint, turns array<struct<edit:string,role:string,text:string>>")
    report = ["conv_id", *_REPORT, "audit"]
    return whole.select(*report).unionByName(solved.select(*report)), whole.select("conv_id", "part", "seq", "whole", "turns").unionByName(fixed.withColumn("whole", F.lit(False)).select("conv_id", "part", "seq", "whole", "turns"))


def turns_digest(turns: DataFrame) -> DataFrame:
    """``conv_id, repaired_sha256``: of each conversation's ``role:text``, joined by line feeds.

    A conversation of one piece is digested where it is; pieces of longer ones stream in order through one task each.
    """
    kind = turns.schema["conv_id"].dataType.simpleString()
    joined = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    pieces = turns.where("NOT whole").select("conv_id", "part", "seq", F.size("turns").alias("n"), joined.alias("text")).repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, some = None, None, False
        for batch in batches:
            ids, out = [], []
            for conv, _, _, n, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if state is None or conv != key:
                    if state is not None:
                        ids.append(key), out.append(state.hexdigest())
                    key, state, some = conv, hashlib.sha256(), False
                if n:
                    state.update((b"\n" if some else b"") + text.encode("utf-8", "surrogatepass"))
                    some = True
            id_type = batch.column(0).type
            yield pa.RecordBatch.from_arrays([pa.array(ids, id_type), pa.array(out, pa.string())], names=["conv_id", "repaired_sha256"])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key], id_type), pa.array([state.hexdigest()], pa.string())], names=["conv_id", "repaired_sha256"])

    whole = turns.where("whole").select("conv_id", F.sha2(joined, 256).alias("repaired_sha256"))
    return whole.unionByName(pieces.mapInArrow(digest, f"conv_id {kind}, repaired_sha256 string"))


def digests(rows: DataFrame, **options) -> DataFrame:
    """The report with ``repaired_sha256``; the pieces are removed once these rows are in the checkpoint folder."""
    spark = rows.sparkSession
    folder = fresh_folder(spark, "repair")
    report, turns = repair(rows, folder, **options)
    hashed = turns_digest(turns)
    out = settle(_joined(report, hashed, ("conv_id",)))
    remove_folder(spark, folder)
    return out
