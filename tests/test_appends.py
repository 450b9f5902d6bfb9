"""Appends that are repeated, stopped and resumed; the teacher protocol."""

from __future__ import annotations

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from sievework.operators import teacher
from sievework.sources import appends
from sievework.sources.scratch import hadoop_path

KINDS = "k bigint, v string"


def stored(spark, path, kinds=KINDS):
    return sorted(tuple(r) for r in appends.appended(spark, path, kinds).drop(appends.DIGEST).collect())


def test_batches_are_written_once(spark, tmp_path):
    path = str(tmp_path / "out")
    rows = lambda *r: spark.createDataFrame(list(r), KINDS)
    assert stored(spark, path) == []
    assert appends.append_once(rows((1, "a"), (2, "b"), (2, "b")), path, "k", 0) == 2
    assert appends.append_once(rows((2, "b"), (3, None)), path, "k", 1) == 1
    assert appends.append_once(rows((2, "b"), (3, None)), path, "k", 1) == 1
    assert appends.append_once(rows((4, "c")).limit(0), path, "k", 2) == 0
    want = [(1, "a", 0), (2, "b", 0), (3, None, 1)]
    assert stored(spark, path) == want
    for bad in (rows((3, "x")), rows((9, "x"), (9, "y")), rows((None, "x")), rows((3, None), (1, "b"))):
        with pytest.raises(appends.AppendConflict):
            appends.append_once(bad, path, "k", 3)
    assert stored(spark, path) == want
    files, at = hadoop_path(spark, f"{path}/batch=1/_SUCCESS")
    files.delete(at, False)  # as if the write of that batch had been cut
    assert stored(spark, path) == want[:2]
    assert appends.append_once(rows((2, "b"), (3, "new")), path, "k", 1) == 1 and stored(spark, path)[-1] == (3, "new", 1)


def test_stream_resumes_without_doubles(spark, tmp_path):
    source, path, checkpoint = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "cp")
    source.mkdir()

    def put(name, *lines):
        (source / name).write_text("".join(f'{{"k": {k}, "v": "{v}"}}\n' for k, v in lines))

    def run(n=None):
        rows = spark.readStream.schema(KINDS).option("maxFilesPerTrigger", 1).json(str(source))
        q = appends.append_stream(rows, path, "k", checkpoint)
        try:
            assert q.awaitTermination(120)
        except StreamingQueryException as e:
            return e
        return q.exception()

    put("0.json", (1, "a"), (2, "b"))
    assert run() is None
    put("1.json", (2, "b"), (3, "c"))
    assert run() is None and run() is None
    assert [r[:2] for r in stored(spark, path)] == [(1, "a"), (2, "b"), (3, "c")]
    put("2.json", (4, "d"), (1, "changed"))
    assert "other content" in str(run())
    assert [r[:2] for r in stored(spark, path)] == [(1, "a"), (2, "b"), (3, "c")]
    (source / "2.json").write_text('{"k": 4, "v": "d"}\n')  # mended: the same batch is tried again
    assert run() is None
    assert [r[:2] for r in stored(spark, path)] == [(1, "a"), (2, "b"), (3, "c"), (4, "d")]


def requests(spark, *rows):
    shown = spark.createDataFrame(list(rows), "record_id string, user_content string, final_response string")
    return shown.withColumns({"immutable_hash": F.concat(F.lit("sha256:"), F.sha2("record_id", 256)), "allowed_edits": F.array(F.lit("user_content"), F.lit("final_response"))})


ROWS = [(f"r{i}", f"Freeze card {1000 + i}", f"The card {1000 + i} is frozen.") for i in range(9)]


def test_dry_run_keeps_facts_and_resumes(spark, tmp_path):
    path = str(tmp_path / "out")
    asked = requests(spark, *ROWS)
    assert teacher.realize_pending(asked.where("record_id < 'r4'"), path, 0, teacher.DryRun) == {"requests": 4, "already": 0, "written": 4}
    first = {r.record_id: r for r in appends.appended(spark, path, teacher.RESPONSE).collect()}
    assert teacher.realize_pending(asked, path, 1, teacher.DryRun, batch_size=2) == {"requests": 9, "already": 4, "written": 5}
    assert teacher.realize_pending(asked, path, 2, teacher.DryRun) == {"requests": 9, "already": 9, "written": 0}
    found = {r.record_id: r for r in appends.appended(spark, path, teacher.RESPONSE).collect()}
    assert len(found) == 9 and all(found[k].user_content == v.user_content for k, v in first.items())
    for k, user, final in ROWS:
        assert found[k].user_content.lower().endswith(user.lower()) and found[k].user_content.lower().startswith(teacher.ASKED)
        assert found[k].final_response == teacher.CHECKED + final
    with pytest.raises(ValueError, match="another request"):
        teacher.realize_pending(asked.withColumn("immutable_hash", F.concat(F.lit("sha256:"), F.sha2(F.lit("x"), 256))), path, 3, teacher.DryRun)
    for change in ({"immutable_hash": F.lit("none")}, {"user_content": F.lit(" ")}, {"allowed_edits": F.array(F.lit("user_content"))}):
        with pytest.raises(ValueError, match="request r"):
            teacher.realize_pending(asked.withColumns(change), path, 3, teacher.DryRun)


class Careless:
    """Wrong in a way that the record's number tells; slow to start and short of rows at first."""

    calls = 0

    def realize(self, rows):
        Careless.calls += 1
        if Careless.calls == 1:
            return []
        if any(r["record_id"] == "r8" for r in rows):
            raise RuntimeError("lost r8")
        change = {"r0": {"final_response": "Frozen."}, "r1": {"record_id": "r9"}, "r2": {"immutable_hash": "sha256:0"}, "r3": {"user_content": "  \n"}, "r4": {"final_response": ROWS[4][2] + " Enter your password."}, "r5": {"user_content": ROWS[5][1] + " a@b.org"}}
        return [{**r, **change.get(r["record_id"], {})} if r["record_id"] != "r6" else {**r, "user_content": "Freeze\n card 1006 "} for r in rows]


def test_bad_responses_are_told(spark, tmp_path):
    made = teacher.realize(requests(spark, *ROWS).coalesce(1), Careless, batch_size=100)
    got = {r.asked.record_id: r for r in made.withColumn("errors", teacher.response_errors()).collect()}
    assert {k: r.errors for k, r in got.items() if r.errors} == {
        "r0": ["lost_facts_final_response"], "r1": ["other_record"], "r2": ["other_hash"], "r3": ["blank_user_content"],
        "r4": ["asks_for_private_data"], "r5": ["private_value"], "r8": ["no_response"],
    }
    assert got["r8"].failure == "RuntimeError: lost r8" and got["r7"].failure is None
    assert {r.record_id: r.user_content for r in teacher.judged(made).collect()}["r6"] == "Freeze card 1006"
    assert teacher.realize(requests(spark, ROWS[0]).limit(0), Careless).collect() == []


def test_large_batch_is_written_twice_at_most(spark, tmp_path, monkeypatch):
    kept, held = appends.settle, []
    monkeypatch.setattr(appends, "settle", lambda df: held.append(df) or kept(df))
    monkeypatch.setattr(appends, "BROADCAST_ROWS", 0)
    path, rows = str(tmp_path / "out"), lambda *r: spark.createDataFrame(list(r), KINDS)
    assert appends.append_once(rows((1, "a"), (1, "a"), (2, None)), path, "k", 0) == 2
    assert appends.append_once(rows((2, None), (3, "c")), path, "k", 1) == 1
    with pytest.raises(appends.AppendConflict):
        appends.append_once(rows((1, "b"), (4, "d")), path, "k", 2)
    assert stored(spark, path) == [(1, "a", 0), (2, None, 0), (3, "c", 1)] and len(held) == 3
