"""WARC archives with revisit resolution (operator 10).

Headers (ids, digests, lengths), never payloads, are shuffled by payload digest; the
record with the smallest id is the original of its digest, and later ones are joined to it
and written as revisit records. Archives are gzip members, one a record, with fresh headers.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.llm._common import fresh_folder, remove_folder, settle

#: Payloads below this many bytes are never deduplicated.
MIN_BYTES = 100
FILE_BYTES, BATCH_ROWS = 256 << 20, 512
WRITTEN = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_UNSAFE, _ESCAPED = re.compile(r"[\x00-\x20\x7F]"), re.compile(r"%([0-9A-F]{2})")


def record_id(key: object, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'record:{key_field(key)}:{digest}')}>"


def _safe(value: str) -> str:
    return _UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", value)


def key_field(key: object) -> str:
    """A key as a header's value: ``=`` and its text with line ends, blanks, ``%`` and ``DEL`` as %XX; nothing for null."""
    return "" if key is None else "=" + _safe(str(key).replace("%", "%25"))


def field_key(value: str | None) -> str | None:
    """The inverse of :func:`key_field`."""
    return _ESCAPED.sub(lambda m: chr(int(m[1], 16)), value[1:]) if value else None


def record_bytes(key: object, url: str | None, payload: bytes, digest: str, refers_to: object = None, refers_url: str | None = None, revisit: bool = False, date: str = WRITTEN) -> bytes:
    """One WARC/1.1 record; a revisit holds the HTTP header alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if revisit:
        http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(key, digest)}",
        f"WARC-Date: {date}",
        *([f"WARC-Target-URI: {_safe(url)}"] if url else []),
        f"WARC-Payload-Digest: sha256:{digest}",
        f"X-Record-Key: {key_field(key)}",
    ]
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest)}"]
        head += [f"WARC-Refers-To-Target-URI: {_safe(refers_url)}"] * bool(refers_url) + [f"WARC-Refers-To-Date: {date}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def resolve_revisits(headers: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """The revisits among ``headers`` (``key, url, digest, n_bytes``): ``key, digest, refers_to, refers_url``.

    Originals are the smallest key of each digest with ``min_bytes`` or more. Rows with a
    null key and rows that repeat the original's key are no revisits; nor is a digest
    whose keys are all null resolved. Copies are counted by partial aggregation and the
    join back is on headers alone, so a digest with a third of all rows stays cheap.
    """
    big = headers.where((F.col("n_bytes") >= min_bytes) & F.col("key").isNotNull())
    least = big.groupBy("digest").agg(F.min(F.struct("key", "url")).alias("o"), F.max("key").alias("last"))
    originals = settle(least.where(F.col("o.key") != F.col("last")).select("digest", F.col("o.key").alias("refers_to"), F.col("o.url").alias("refers_url")))
    return big.select("key", "digest").join(originals, "digest").where(F.col("key") != F.col("refers_to")).distinct()


def write_records(records: DataFrame, folder: str) -> DataFrame:
    """Write ``key, url, payload, digest, revisit, refers_to, refers_url`` as WARC files of ``folder``.

    Returns one row per file, ``file, records``. A task attempt writes files of its own
    names; those of failed attempts are in no returned row.
    """
    columns = ["key", "url", "payload", "digest", "revisit", "refers_to", "refers_url"]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, path = pafs.FileSystem.from_uri(folder)
        where.create_dir(path, recursive=True)
        done, stream, name, n, size = [], None, "", 0, 0
        for batch in batches:
            for row in zip(*(batch.column(c) for c in columns), strict=True):
                key, url, payload, digest, revisit, refers_to, refers_url = (x.as_py() for x in row)
                if stream is None:
                    name, n, size = f"{path}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    stream = where.open_output_stream(name, compression=None)
                packed = gzip.compress(record_bytes(key, url, payload or b"", digest, refers_to, refers_url, revisit), 6, mtime=0)
                stream.write(packed)
                n, size = n + 1, size + len(packed)
                if size >= FILE_BYTES:
                    stream.close()
                    done, stream = [*done, (name, n)], None
        if stream is not None:
            stream.close()
            done.append((name, n))
        yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in done], pa.string()), pa.array([b for _, b in done], pa.int64())], names=["file", "records"])

    return settle(records.select(*columns).mapInArrow(write, "file string, records bigint"))


def parse_records(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and payload of each record of an uncompressed WARC stream."""
    while True:
        line = stream.readline()
        while line in (b"\r\n", b"\n"):
            line = stream.readline()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        head: dict[str, str] = {}
        while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
            name, _, value = line.decode("utf-8", "surrogatepass").partition(":")
            head[name.strip().lower()] = value.strip()
        block = stream.read(size := int(head["content-length"]))
        if len(block) < size:
            raise ValueError("a record ends early")
        yield head, block.partition(b"\r\n\r\n")[2] if head.get("content-type", "").startswith("application/http") else block


def read_records(files: DataFrame, folder: str, payload: bool = False) -> DataFrame:
    """The records of WARC files (rows ``file``), each file streamed by one task.

    Columns: ``type, record_id, key, url, refers_to_id, header_digest, payload_bytes,
    payload_digest`` (both of the bytes read) and, if asked for, ``payload``.
    """
    fields = [(c, pa.string()) for c in ("type", "record_id", "key", "url", "refers_to_id", "header_digest")] + [("payload_bytes", pa.int64()), ("payload_digest", pa.string())]
    fields += [("payload", pa.binary())] * payload

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, _ = pafs.FileSystem.from_uri(folder)
        rows: list[tuple] = []
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with where.open_input_stream(name, compression=None) as raw, gzip.GzipFile(fileobj=raw) as stream:
                    for head, body in parse_records(io.BufferedReader(stream, 1 << 16)):
                        get = head.get
                        rows.append((get("warc-type"), get("warc-record-id"), field_key(get("x-record-key")), get("warc-target-uri"), get("warc-refers-to"), (get("warc-payload-digest") or "").removeprefix("sha256:"), len(body), hashlib.sha256(body).hexdigest(), *([body] * payload)))
                        if len(rows) >= BATCH_ROWS:
                            yield _batch(rows, fields)
                            rows = []
        if rows:
            yield _batch(rows, fields)

    kinds = {pa.string(): "string", pa.int64(): "bigint", pa.binary(): "binary"}
    return files.select("file").mapInArrow(read, ", ".join(f"{k} {kinds[t]}" for k, t in fields))


def _batch(rows: list[tuple], fields: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), fields, strict=True)], names=[k for k, _ in fields])


def deduplicated(pages: DataFrame, folder: str, id_col: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = MIN_BYTES) -> DataFrame:
    """Write ``pages`` to ``folder`` as deduplicated archives; returns the files.

    Null pages are empty payloads, null URLs leave their header out, repeated rows are
    records of their own, no rows give no files.
    """
    payload = F.coalesce(F.col(html).cast("binary"), F.lit(b""))
    records = pages.select(F.col(id_col).alias("key"), F.col(url).alias("url"), payload.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    headers = settle(records.select("key", "url", "digest", F.octet_length("payload").alias("n_bytes")))
    revisits = settle(resolve_revisits(headers, min_bytes))
    found = revisits.select(F.col("key").alias("__k"), F.col("digest").alias("__d"), "refers_to", "refers_url")
    # The key alone spreads the payloads; a digest could hold a third of them.
    marked = records.join(found, (F.col("key") == F.col("__k")) & (F.col("digest") == F.col("__d")), "left")
    return write_records(marked.withColumn("revisit", F.col("refers_to").isNotNull()), folder)


def resolved(records: DataFrame) -> DataFrame:
    """Records read back, with ``refers_to`` (the original's key) and, for revisits, its figures.

    A revisit whose original is in none of the archives has null figures.
    """
    kept = settle(records)
    own = kept.where("type = 'response'")
    originals = own.select(F.col("record_id").alias("refers_to_id"), F.col("key").alias("refers_to"), "payload_bytes", "payload_digest").dropDuplicates(["refers_to_id"])
    again = kept.where("type = 'revisit'").select("key", "type", "refers_to_id").join(settle(originals), "refers_to_id", "left")
    columns = ["key", "payload_bytes", "payload_digest", F.col("type").alias("record_type")]
    return own.select(*columns, F.lit(None).cast("string").alias("refers_to")).unionByName(again.select(*columns, "refers_to"))


def round_trip(pages: DataFrame, id_col: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = MIN_BYTES) -> DataFrame:
    """Write deduplicated archives, read them back and return a row per page; the archives are removed."""
    spark, kind = pages.sparkSession, pages.schema[id_col].dataType.simpleString()
    folder = fresh_folder(spark, "warc")
    files = deduplicated(pages, folder, id_col, url, html, min_bytes)
    rows = resolved(read_records(files, folder))
    remove_folder(spark, folder)  # resolved() has written what it read
    return rows.select(F.col("key").cast(kind).alias(id_col), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))
