"""Media columns from archives by a custom Spark data source (operator 9).

Archives are ZIP files of stored members in a directory. The source ``sievework_media``
plans byte ranges over all archives of the directory; a task reads the members whose
headers start in its range, streams their bytes in bounded Arrow batches, and on a
failure opens the archive anew and retries that member alone, by its offset.
"""

from __future__ import annotations

import binascii
import hashlib
import struct
import time
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from sievework.llm._common import fresh_folder, remove_folder, settle

ROW = 192
ARCHIVE_BYTES, RANGE_BYTES, BATCH_BYTES, RETRIES = 128 << 20, 32 << 20, 4 << 20, 3
_SIGNATURE = b"\x89PNG\r\n\x1a\n"
_FIELDS = [("archive", pa.string()), ("member", pa.string()), ("offset", pa.int64()), ("content", pa.binary()), ("error", pa.string())]
SCHEMA = "archive string, member string, offset bigint, content binary, error string"


def pad(data: bytes) -> bytes:
    """``data`` and spaces up to a positive multiple of ROW bytes."""
    return data + b" " * (-len(data) % ROW if data else ROW)


def encode_image(payload: bytes) -> bytes:
    """A PNG of 8-bit RGB samples, 64 pixels (ROW bytes) a line, that holds ``payload`` losslessly."""
    lines = np.zeros((len(payload) // ROW, ROW + 1), dtype=np.uint8)
    lines[:, 1:] = np.frombuffer(payload, dtype=np.uint8).reshape(-1, ROW)

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", binascii.crc32(body, binascii.crc32(kind)))

    head = struct.pack(">IIBBBBB", ROW // 3, len(lines), 8, 2, 0, 0, 0)
    return _SIGNATURE + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines.tobytes(), 6)) + chunk(b"IEND", b"")


def decode_image(content: bytes) -> bytes:
    """The samples of a PNG that :func:`encode_image` wrote; ValueError for anything else."""
    if content[:8] != _SIGNATURE:
        raise ValueError("not a PNG")
    at, data, shape = 8, b"", None
    while at < len(content):
        size, kind = struct.unpack(">I4s", content[at : at + 8])
        body = content[at + 8 : at + 8 + size]
        if struct.unpack(">I", content[at + 8 + size : at + 12 + size])[0] != binascii.crc32(body, binascii.crc32(kind)):
            raise ValueError("a chunk's checksum differs")
        if kind == b"IHDR":
            shape = struct.unpack(">II", body[:8])
        elif kind == b"IDAT":
            data += body
        at += 12 + size
    if shape is None:
        raise ValueError("no header chunk")
    return np.frombuffer(zlib.decompress(data), dtype=np.uint8).reshape(shape[1], ROW + 1)[:, 1:].tobytes()


def features(payload: bytes) -> str:
    """Lines, mean, deviation, entropy and mean step between neighbours of the samples."""
    samples = np.frombuffer(payload, dtype=np.uint8)
    share = np.bincount(samples, minlength=256) / len(samples)
    present = share[share > 0]
    steps = np.abs(np.diff(samples.astype(np.int16))).mean()
    return f"lines={len(samples) // ROW};mean={samples.mean():.3f};dev={samples.std():.3f};bits={-(present * np.log2(present)).sum():.3f};step={steps:.3f}"


def write_archives(docs: DataFrame, folder: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Write every row as a PNG member of archives in ``folder``; the archives as rows ``archive, members``.

    A member is named ``<row>-<id>-<bytes>.png``: the row's number in its archive, its id
    (``null`` for none) and its unpadded UTF-8 length. A task attempt writes archives of
    its own names, and only those of attempts that succeed are listed in the folder's
    ``_manifest``, so that retries and lost executors leave no doubles. Null texts are empty.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, path = pafs.FileSystem.from_uri(folder)
        where.create_dir(path, recursive=True)
        done: list[tuple[str, int]] = []
        archive = stream = None
        n = size = 0
        name = ""

        def close() -> None:
            nonlocal archive
            if archive is not None:
                archive.close()
                stream.close()
                done.append((name, n))
                archive = None

        for batch in batches:
            for key, value in zip(batch.column(0), batch.column(1), strict=True):
                if archive is None:
                    name, n, size = f"{uuid.uuid4().hex}.zip", 0, 0
                    stream = where.open_output_stream(f"{path}/{name}")
                    archive = zipfile.ZipFile(stream, "w", zipfile.ZIP_STORED)
                data = (value.as_py() or "").encode("utf-8", "surrogatepass")
                key = key.as_py()
                content = encode_image(pad(data))
                info = zipfile.ZipInfo(f"{n}-{'null' if key is None else key}-{len(data)}.png")
                archive.writestr(info, content)
                n, size = n + 1, size + len(content)
                if size >= ARCHIVE_BYTES:
                    close()
        close()
        yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in done], pa.string()), pa.array([b for _, b in done], pa.int64())], names=["archive", "members"])

    listed = settle(docs.select(id_col, text).mapInArrow(write, "archive string, members bigint"))
    listed.write.parquet(f"{folder}/_manifest")
    return listed


@dataclass
class ByteRange(InputPartition):
    archive: str
    start: int
    end: int


class MediaSource(DataSource):
    """``spark.read.format("sievework_media").option("rangeBytes", n).load(folder)``.

    Options: ``path`` (a directory URI), ``rangeBytes``, ``batchBytes``, ``retries``,
    ``onError`` (``raise``, or ``keep``: the row has null content and the error's text).
    Where the directory has a ``_manifest``, only archives it lists count.
    """

    @classmethod
    def name(cls) -> str:
        return "sievework_media"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> MediaReader:
        return MediaReader(dict(self.options))


class MediaReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        get = {k.lower(): v for k, v in options.items()}
        self.folder = get["path"]
        self.range_bytes = int(get.get("rangebytes", RANGE_BYTES))
        self.batch_bytes = int(get.get("batchbytes", BATCH_BYTES))
        self.retries = int(get.get("retries", RETRIES))
        self.keep_errors = get.get("onerror", "raise") == "keep"

    def partitions(self) -> list[ByteRange]:
        """Byte ranges over the directory's archives; file names and sizes only are read."""
        where, path = pafs.FileSystem.from_uri(self.folder)
        files = {f.base_name: f.size for f in where.get_file_info(pafs.FileSelector(path)) if f.base_name.endswith(".zip") and f.type == pafs.FileType.File}
        if where.get_file_info(f"{path}/_manifest").type == pafs.FileType.Directory:
            import pyarrow.dataset as ds

            listed = set(ds.dataset(f"{path}/_manifest", filesystem=where, format="parquet").to_table(columns=["archive"])["archive"].to_pylist())
            if lost := listed - files.keys():
                raise FileNotFoundError(f"{len(lost)} archives of the manifest are missing, such as {min(lost)}")
            files = {k: v for k, v in files.items() if k in listed}
        step = max(1, self.range_bytes)
        return [ByteRange(f"{path}/{k}", at, min(at + step, size)) for k, size in sorted(files.items()) for at in range(0, size, step)] or [ByteRange("", 0, 0)]

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0
        for row in self._members(partition):
            rows.append(row)
            held += len(row[3] or b"")
            if held >= self.batch_bytes:
                yield _batch(rows)
                rows, held = [], 0
        if rows:
            yield _batch(rows)

    def _members(self, part: ByteRange) -> Iterator[tuple]:
        if not part.archive:
            return
        where, _ = pafs.FileSystem.from_uri(self.folder)
        opened: list = []

        def reopen() -> zipfile.ZipFile:
            while opened:
                opened.pop().close()
            opened.append(where.open_input_file(part.archive))
            opened.append(zipfile.ZipFile(opened[0]))
            return opened[1]

        try:
            for info in sorted((i for i in self._tried(lambda: reopen().infolist()) if part.start <= i.header_offset < part.end), key=lambda i: i.header_offset):
                content = error = None
                try:
                    content = self._tried(lambda info=info: opened[1].read(info), reopen)
                except (OSError, EOFError, zipfile.BadZipFile, zlib.error) as e:
                    if not self.keep_errors:
                        raise
                    error = f"{type(e).__name__}: {e}"
                yield part.archive.rpartition("/")[2], info.filename, info.header_offset, content, error
        finally:
            while opened:
                opened.pop().close()

    def _tried(self, read, reopen=None):
        for n in range(self.retries + 1):
            try:
                if n and reopen:
                    reopen()
                return read()
            except (OSError, EOFError, zipfile.BadZipFile, zlib.error):
                if n == self.retries:
                    raise
                time.sleep(0.05 * 2**n)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), _FIELDS, strict=True)], names=[k for k, _ in _FIELDS])


def read_archives(spark: SparkSession, folder: str, **options) -> DataFrame:
    spark.dataSource.register(MediaSource)
    return spark.read.format("sievework_media").options(**{k: str(v) for k, v in options.items()}).load(folder)


def describe(media: DataFrame) -> DataFrame:
    """Figures of each member, from its stored bytes: sizes, digests and features of the samples."""

    @F.pandas_udf("payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for content in batch:
                if content is None:
                    rows.append((None,) * 6)
                    continue
                payload = decode_image(content)
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(content), hashlib.sha256(content).hexdigest(), features(payload)))
            yield pd.DataFrame(rows, columns=["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return media.select("archive", "member", "offset", "error", of("content").alias("f")).select("archive", "member", "offset", "error", "f.*")


def member_id(member: Column, kind: str) -> Column:
    found = F.regexp_extract(member, r"(?s)\A\d+-(.*)-\d+\.png\z", 1)
    return F.when(found != "null", found).cast(kind)


def round_trip(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Store every text as an image, read the archives back, and return the figures per row.

    The archives are removed once the figures, a few hundred bytes a row, are written to
    the checkpoint folder. Repeated rows are members of their own; no rows give no rows.
    """
    spark, kind = docs.sparkSession, docs.schema[id_col].dataType.simpleString()
    folder = fresh_folder(spark, "media")
    write_archives(docs, folder, id_col, text)
    figures = describe(read_archives(spark, folder))
    out = settle(figures.select(member_id(F.col("member"), kind).alias(id_col), F.regexp_extract("member", r"-(\d+)\.png\z", 1).cast("bigint").alias("n_bytes"), "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"))
    remove_folder(spark, folder)
    return out
