"""Conversation repair against a plain dynamic program over whole ways."""

from __future__ import annotations

import hashlib
import random
import zlib

import pytest

from sievework.llm import queries, repair


def cheapest(turns):
    """Least (cost, audit) by keeping, for each grammar state, the least way so far."""
    due = {0: 2, 1: 2, 2: 3, 3: 2}
    keep = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}

    def inserted(best):
        for _ in range(4):
            for q, (c, a) in list(best.items()):
                best[due[q]] = min(best.get(due[q], (1 << 30, "")), (c + 2, a + "I"))
        return best

    best = inserted({0: (0, "")})
    for role, fault in turns:
        ways = {q: (c + 3, a + "D") for q, (c, a) in best.items()}
        for q, (c, a) in best.items():
            if fault in ("blank", "duplicate"):
                continue
            more = int(fault == "truncated")
            options = [(due[q], (c + 2 + more, a + "R"))]
            if (role, q) in keep:
                options.append((keep[role, q], (c + more, a + "K")))
            for to, way in options:
                ways[to] = min(ways.get(to, (1 << 30, "")), way)
        best = inserted(ways)
    return min(best[q] for q in (0, 3) if q in best)


def expected(rows):
    """The contract's columns for rows (conv_id, turn, role, text), in plain Python."""
    out = {}
    for conv in {r[0] for r in rows}:
        own = [(t, r if r is not None else " ", x if x is not None else " ") for c, t, r, x in rows if c == conv]
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, hashlib.md5(f"{r[1]}\n{r[2]}".encode()).hexdigest()))
        kept = []
        for turn, role, text in own:
            k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            text = "" if k == 1 else "".join(ch for ch in text if ch not in ".!?") if k == 2 else text
            kept += [(turn, "user" if k == 4 else role, text)] * (0 if k == 0 else 2 if k == 3 else 1)
        faults, seen = [], set()
        for _, role, text in kept:
            bare = text.strip(repair.BLANKS)
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
            seen.add((role, text))
        first = [r[:1] for _, r, _ in kept]
        cost, audit = cheapest(list(zip(first, faults, strict=True)))
        fixed, i, due = [], 0, "user"
        for edit in audit:
            if edit == "K":
                fixed.append((kept[i][1], kept[i][2]))
            elif edit != "D":
                fixed.append((due, "" if edit == "I" else kept[i][2]))
            if edit != "D":
                due = "assistant" if fixed[-1][0][:1] == "u" else "user"
            i += edit != "I"
        told = [t for t, _, _ in kept if t is not None]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(first, first[1:], strict=False))
        gaps = max(told) - min(told) + 1 - len(set(told)) if told else 0
        out[conv] = (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in fixed).encode()).hexdigest())
    return out


def hostile_rows(seed=5):
    pick = random.Random(seed)
    roles, texts = ["system", "user", "assistant", "tool", "", None, "user", "assistant"], ["Yes.", "no", "  ", "", None, "Why?!", "a. b", "Ende.\n", "ü…", "Yes. "]
    rows = []
    for conv in [*range(40), None, -3]:
        for turn in range(pick.randint(1, 9)):
            rows.append((conv, pick.choice([turn, turn, turn, turn + 3, None]), pick.choice(roles), pick.choice(texts) if pick.random() < 0.5 else f"text {turn}{pick.choice('.!x')}"))
    for turn in range(600):  # one conversation with over a third of all rows
        rows.append((7, turn // 2, pick.choice(roles), f"hot {pick.randrange(200)}{pick.choice(['.', '!', ''])}"))
    return rows + rows[:20]


COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


@pytest.mark.parametrize("most", [3, 4096])
def test_hostile_conversations(spark, tmp_path, monkeypatch, most):
    monkeypatch.setattr(repair, "PIECE_TURNS", most)
    rows = hostile_rows()
    made = spark.createDataFrame([(*r, "x") for r in rows], "conv_id bigint, turn bigint, role string, text string, part string")
    made.write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r.conv_id: tuple(r[c] for c in COLUMNS) for r in queries.op11_repair(spark, str(tmp_path)).collect()}
    assert got == expected(rows)


def test_empty_table_and_dropped_conversation(spark, tmp_path):
    kinds = "conv_id bigint, turn bigint, role string, text string"
    dropped = next(k for k in range(100) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    for name, rows in (("none", []), ("dropped", [(dropped, 0, "user", "x")])):
        spark.createDataFrame(rows, kinds).write.parquet(str(tmp_path / name / "conversations.parquet"))
        got = queries.op11_repair(spark, str(tmp_path / name)).collect()
        assert [tuple(r) for r in got] == [(r[0], 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for r in rows]


def test_repaired_turns_spell_the_grammar(spark, tmp_path):
    rows = spark.createDataFrame([(1, t, r, x) for t, (r, x) in enumerate([("user", "Hi."), ("user", "You there?"), ("assistant", "Yes."), ("assistant", "Yes."), ("tool", "cut of")])], "c int, t int, who string, body string")
    report, turns = repair.repair(rows, str(tmp_path / "out"), conv_id="c", turn="t", role="who", text="body")
    (told,) = report.collect()
    assert (told.duplicate, told.truncated, told.illegal) == (1, 1, 3)
    pieces = sorted(turns.collect(), key=lambda r: (r.part, r.seq))
    assert [(t.role, t.text) for p in pieces for t in p.turns] == [("user", "Hi."), ("assistant", ""), ("user", "You there?"), ("assistant", "Yes.")]
    assert told.audit == "KIKKDD" and told.cost == 8


def test_solver_equals_plain_program():
    pick = random.Random(11)
    for _ in range(3000):
        turns = [(pick.choice("suuaa."), pick.choice(["", "", "truncated", "blank"])) for _ in range(pick.choice([0, 1, 2, 5, 9, 31, 32, 33, 70]))]
        cost, edits = repair.solve([repair.code_of(r, f) for r, f in turns])
        assert (cost, "".join(e for e, _ in edits)) == cheapest(turns)
