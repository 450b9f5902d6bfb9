"""Row numbers over files and blocks against Python's CSV reader; constants of sources; token labels."""

from __future__ import annotations

import csv
import random

import pytest
from pyspark.sql import functions as F

from sievework.operators import loss_spans as L
from sievework.sources import numbered


@pytest.fixture
def small_blocks(spark):
    """Files are read in blocks of some hundred bytes."""
    names = {"spark.sql.files.maxPartitionBytes": "300", "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "1"}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def written(tmp_path, seed):
    pick = random.Random(seed)
    cell = lambda: '"' + "".join(pick.choice(['a', 'é', ',', '""', "\n", "\r\n", " ", "word"]) for _ in range(pick.randint(1, 25))) + 'x"'
    folder = tmp_path / f"csv{seed}"
    folder.mkdir()
    for k in range(3):
        lines = ["text,label"] + [f"{cell()},{pick.choice(['yes', 'no'])}" for _ in range(pick.randint(0, 40))]
        (folder / f"part-{k}.csv").write_bytes("\n".join(x + "\n" * (pick.random() < 0.1) for x in lines).encode() + b"\n")
    return folder


def test_csv_records_equal_python(spark, tmp_path, small_blocks):
    for seed in (1, 2):
        folder = written(tmp_path, seed)
        want, n = [], 0
        for file in sorted(folder.iterdir()):
            for row in csv.DictReader(file.read_bytes().decode().splitlines()):
                want.append((n, "train", row["text"], row["label"]))
                n += 1
        rows = numbered.labelled_snapshot(spark, {"train": str(folder)})
        assert sorted(tuple(r) for r in rows.collect()) == want
        assert spark.read.text(str(folder)).rdd.getNumPartitions() > 3
        lines = [x for file in sorted(folder.iterdir()) for x in file.read_bytes().decode().splitlines()]
        assert [r.value for r in numbered.numbered_lines(spark, str(folder)).orderBy("line_no").collect()] == lines
        assert [r.line_no for r in numbered.numbered_lines(spark, str(folder)).orderBy("line_no").collect()] == list(range(len(lines)))


def test_incomplete_rows_and_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_text('text,category\n"x",\n')
    with pytest.raises(Exception, match="train row 0 is incomplete"):
        numbered.labelled_snapshot(spark, {"train": str(tmp_path / "a.csv")}, "category").collect()
    with pytest.raises(ValueError, match="no column label"):
        numbered.labelled_snapshot(spark, {"train": str(tmp_path / "a.csv")})


def test_source_literals(spark):
    source = 'X = "one"\n# "not a constant of three"\ndef f():\n    """Doc, of Three words!"""\n    return ["a b c", f"in an {X} f-string too", b"bytes are not it"]\n'
    rows = spark.createDataFrame([(1, source), (2, "def broken("), (3, None), (4, "x = 'a  B, c'; y = 'a b c'")], "k int, source string")
    assert sorted(tuple(r) for r in numbered.source_literals(rows).collect()) == [(1, "a b c"), (1, "doc of three words"), (1, "f string too"), (4, "a b c")]


def labelled(spark, messages, pattern="[a-z]{1,3}|[^a-z]"):
    rows = spark.createDataFrame([(messages,)], "m array<struct<role:string,text:string,loss:boolean>>")
    made = rows.select(L.rendered(F.col("m"), lambda m: F.concat(m["role"], F.lit(": "), m["text"]), "assistant: ").alias("r"))
    placed = made.select("r.text", "r.spans", L.offsets(F.col("r.text"), lambda: L.Pieces(pattern)).alias("o"))
    return placed.select("text", "spans", "o", L.labels(F.col("o"), F.col("spans")).alias("y"), F.transform("spans", lambda s: L.span_end(F.col("text"), s["start"])).alias("ends")).first()


def test_labels_cover_trained_messages(spark):
    row = labelled(spark, [("user", "hello 😀", None), ("assistant", "first answer", True), ("user", "again", None), ("assistant", "untrained", False), ("assistant", "last", None)])
    text = "user: hello 😀\nassistant: first answer\nuser: again\nassistant: untrained\nassistant: last"
    assert row.text == text
    trained = "".join(text[o.start : o.end] for o, y in zip(row.o, row.y, strict=True) if y != L.IGNORED)
    assert trained == "first answerlast" and [text[s.start : s.end] for s in row.spans] == ["first answer", "last"]
    assert all(y in (L.IGNORED, i) for i, y in enumerate(row.y))
    assert [None if e is None else text[:e][-6:] for e in row.ends] == ["\nuser:", None]


def test_span_within_a_token_stops(spark):
    with pytest.raises(Exception, match="ends within a token"):
        labelled(spark, [("assistant", "ab", None)], "(?s).{4}|.")
    assert labelled(spark, []).y == []


def test_places_leave_before_a_batch_is_done(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(L, "PLACES", 1000)
    texts = ["ab" * 70, None, "", "ab" * 500, "a"] * 3
    made = list(L.placed(iter([pa.array(texts), pa.array([], pa.string())]), L.Pieces("[ab]")))
    assert len(made) == 4 and max(len(x.flatten()) for x in made) <= 1000 + 141
    assert [len(x) for y in made for x in y.to_pylist()] == [len(t or "") for t in texts]
    assert made[0][0].as_py()[:2] == [{"start": 0, "end": 1}, {"start": 1, "end": 2}]
