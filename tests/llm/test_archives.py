"""Media and WARC archives: exact round trips, byte ranges, retries."""

from __future__ import annotations

import gzip
import hashlib
import io
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from sievework.llm import media, warc
from sievework.llm._common import fresh_folder


def expected(text):
    data = (text or "").encode()
    padded = data + b" " * (-len(data) % 192 or 192 * (not data))
    return len(data), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-16:])


def test_media_round_trip(spark):
    rows = [(1, "a"), (2, None), (3, ""), (4, "é" * 96), (5, "x" * 193), (5, "x" * 193), (None, "nul\0l \n"), (7, "word " * 300_000), (-8, "a")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("feature", F.lit(1))
    got = media.round_trip(df).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got), key=str) == sorted(((i, *expected(t)) for i, t in rows), key=str)
    same = {(r.media_bytes, r.media_sha256, r.feature) for r in got if r.doc_id in (1, -8)}
    assert len(same) == 1
    assert media.round_trip(df.limit(0)).count() == 0


def test_image_codec():
    payload = media.pad(bytes(range(256)) * 3)
    content = media.encode_image(payload)
    assert media.decode_image(content) == payload and len(payload) % 192 == 0
    for bad in (b"", content[:-20] + b"\0" * 20, content.replace(b"IDAT", b"IDAX")):
        with pytest.raises(Exception):  # noqa: B017
            media.decode_image(bad)


def test_byte_ranges_cover_each_member_once(spark):
    folder = fresh_folder(spark, "media-test")
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.sha2(F.col("id").cast("string"), 512), F.col("id").cast("string")).alias("text")).repartition(3)
    media.write_archives(docs, folder)
    (folder_path := folder.removeprefix("file:"))
    with open(f"{folder_path.replace('//', '/')}/stray.zip", "wb") as f:
        f.write(b"left by a task that failed")
    for step in (700, 5_000, 1 << 30):
        members = media.read_archives(spark, folder, rangeBytes=step)
        assert members.select(media.member_id(F.col("member"), "bigint").alias("i")).distinct().count() == members.count() == 300


def test_one_bad_member_is_told_alone(tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        for i in range(4):
            z.writestr(f"{i}-{i}-1.png", bytes([i]) * 50)
        offset = z.getinfo("2-2-1.png").header_offset
    raw = bytearray((tmp_path / "a.zip").read_bytes())
    raw[offset + 45] ^= 255
    (tmp_path / "a.zip").write_bytes(raw)
    reader = media.MediaReader({"path": f"file://{tmp_path}", "onError": "keep", "retries": "1", "rangeBytes": "100"})
    rows = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    assert [(r["member"], r["content"] is None) for r in rows] == [(f"{i}-{i}-1.png", i == 2) for i in range(4)] and "CRC" in rows[2]["error"]
    strict = media.MediaReader({"path": f"file://{tmp_path}", "retries": "0"})
    with pytest.raises(zipfile.BadZipFile):
        [b for p in strict.partitions() for b in strict.read(p)]


def test_a_member_is_retried_by_itself(tmp_path, monkeypatch):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        for i in range(3):
            z.writestr(f"{i}-{i}-1.png", bytes([i]) * 50)
    calls, real = [], zipfile.ZipFile.read

    def flaky(self, info, *a, **k):
        calls.append(info.filename)
        if calls.count("1-1-1.png") == 1 and info.filename == "1-1-1.png":
            raise OSError("reset")
        return real(self, info, *a, **k)

    monkeypatch.setattr(zipfile.ZipFile, "read", flaky)
    reader = media.MediaReader({"path": f"file://{tmp_path}"})
    rows = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    assert [r["content"] for r in rows] == [bytes([i]) * 50 for i in range(3)]
    assert calls == ["0-0-1.png", "1-1-1.png", "1-1-1.png", "2-2-1.png"]


def test_warc_revisits(spark):
    big, other = "<p>" + "é" * 60, "<p>" + "x" * 100
    rows = [(5, "http://a/5", big), (3, "http://a/3", big), (9, None, big), (4, "http://a b\r\nX: y", "small"), (2, "http://a/2", "small"), (7, "u", None), (8, "u", ""), (1, "u", other), (None, "n", other), (6, "v\r\n\r\n", "WARC/1.1\r\n\r\n" * 20)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("digest", F.lit("mine"))
    got = {r.page_id: r for r in warc.round_trip(df).collect()}
    assert len(got) == len(rows)
    for i, _, h in rows:
        body = (h or "").encode()
        assert (got[i].payload_bytes, got[i].payload_digest) == (len(body), hashlib.sha256(body).hexdigest())
    assert {i: r.refers_to for i, r in got.items() if r.record_type == "revisit"} == {5: 3, 9: 3}
    assert warc.round_trip(df.limit(0)).count() == 0


def test_warc_repeated_rows(spark):
    html = "y" * 200
    df = spark.createDataFrame([(1, "u", html), (1, "u", html), (2, "u", html), (2, "u", html)], "page_id bigint, url string, html string")
    assert sorted((r.page_id, r.record_type, r.refers_to) for r in warc.round_trip(df).collect()) == [(1, "response", None)] * 2 + [(2, "revisit", 1)] * 2


def test_warc_string_ids_come_back(spark):
    big = "z" * 120
    ids = ["a b", "", "%20", "a%20b", "é\r\n: x", "=", None, " lead", "tab\t"]
    df = spark.createDataFrame([(i, "u", big) for i in ids], "page_id string, url string, html string")
    got = {r.page_id: (r.record_type, r.refers_to) for r in warc.round_trip(df).collect()}
    assert got == {i: ("response", None) if i in ("", None) else ("revisit", "") for i in ids}


def test_warc_records_are_whole_and_plain():
    made = [warc.record_bytes(i, "http://a/\n", b"body\r\n\r\nmore" * i, hashlib.sha256(b"body\r\n\r\nmore" * i).hexdigest(), refers_to=0, refers_url="http://b", revisit=i == 2) for i in range(3)]
    stream = io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(b"".join(gzip.compress(m) for m in made))))
    read = list(warc.parse_records(stream))
    assert [h["warc-type"] for h, _ in read] == ["response", "response", "revisit"]
    assert [b for _, b in read] == [b"", b"body\r\n\r\nmore", b""]
    assert read[2][0]["warc-refers-to"] == warc.record_id(0, read[2][0]["warc-payload-digest"].removeprefix("sha256:")) and read[0][0]["warc-target-uri"] == "http://a/%0A"
    with pytest.raises(ValueError):
        list(warc.parse_records(io.BufferedReader(io.BytesIO(made[1][:-30]))))
