"""Token-id files as wavelet matrices (operator 12).

Documents are encoded in the order of their ids and written to shard files. A file holds
the token ids of its documents as a wavelet matrix: one plane of bits for each binary
digit of an id's number in the file's alphabet, highest digit first, where each plane is
ordered stably by the digit above it. Planes are cut into blocks that are compressed each, with the number of ones
before each block, so that a token, the count of an id or its k-th occurrence is found by
reading a block per plane, without decoding the file.

Layout: the blocks; a directory (Arrow IPC) of block offsets and ones before each block,
of the zeros of each plane, of the ids that occur and of the documents; its place and length in the last 24 bytes.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
import zlib
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.llm._common import fresh_folder, remove_folder, settle

MAGIC = b"SWAVELT1"
#: Bits of a block; blocks that an open file keeps decompressed.
BLOCK, KEPT_BLOCKS = 1 << 16, 256
#: Tokens after which a shard ends with the document at hand; a longer document is one shard.
SHARD_TOKENS = 1 << 21
#: Chunks of text whose ids a task remembers before it begins anew; bytes of text that it encodes
#: at once, but for one long text; texts that it hands on at once.
KNOWN_CHUNKS, ENCODE_BYTES, TEXTS = 600_000, 4 << 20, 500
END_ID = 2


class Encoder:
    """Encodes texts with a file of the ``tokenizers`` library, once per distinct chunk of text.

    Texts are cut at ASCII white space, and ``.`` and ``,`` at the end of a chunk after a
    letter or digit of ASCII are chunks of their own. This needs a tokenizer that drops
    white space, lets no token span it, and parts these marks from letters and digits; where
    it has a lower-casing normalizer, A-Z are lower-cased first. For others ``by_chunk=False``
    encodes texts whole. Chunks that are not known yet are encoded together, parted by a
    mark that none of them has: the first of ``_MARKS`` that this tokenizer keeps apart from
    whatever stands beside it.
    """

    _MARKS, _BESIDE = ("\u07c0", " \x01 "), ("ab", "9", ".", "'s", "\u00e9", "(", "\u0301", "\u65e5", "\u0661")

    def __init__(self, path: str, end_id: int | None = END_ID, by_chunk: bool = True):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core; threads would each hold memory of their own
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.end = end_id
        self.lower = '"Lowercase"' in self.tokenizer.to_str().split('"model"')[0]
        self.mark = next((m for m in self._MARKS if self._parts(m)), None) if by_chunk else None
        self.mark_ids = self._ids(self.mark) if self.mark else None
        self.known: dict[str, bytes] = {}

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _parts(self, mark: str) -> bool:
        """Whether a mark between any two texts leaves their ids as they are, and can be found again by its ids."""
        ids = {x: self._ids(x) for x in (*self._BESIDE, mark)}
        return bool(ids[mark]) and all(self._ids(x + mark + y) == ids[x] + ids[mark] + ids[y] and not set(ids[mark][-1:]) & set(ids[x]) for x in self._BESIDE for y in self._BESIDE)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, one text after the other, each with its end id, and the number of ids of each text. A null text is empty."""
        texts = pc.fill_null(texts, "")
        if self.mark is None:
            raw = self._whole(texts.to_pylist())
            ids, sizes = np.frombuffer(b"".join(raw), "<u4"), np.array([len(r) // 4 for r in raw], np.int64)
        else:
            marked = pc.replace_substring_regex(pc.ascii_lower(texts) if self.lower else texts, r"([0-9A-Za-z])([.,]+)(\s|\z)", r"\1 \2\3")
            cut = pc.ascii_split_whitespace(marked)
            chunks = cut.flatten().dictionary_encode()
            raw = self._chunks(chunks.dictionary.to_numpy(zero_copy_only=False).tolist())
            of_chunk = np.fromiter(map(len, raw), np.int64, len(raw)) // 4
            place, which = np.cumsum(of_chunk) - of_chunk, chunks.indices.to_numpy()
            counts = of_chunk[which]
            ends = np.append(0, np.cumsum(counts))
            # Each chunk's ids are copied to where the chunk stands.
            at = np.repeat(place[which] - ends[:-1], counts)
            at += np.arange(ends[-1])
            ids = np.frombuffer(b"".join(raw), "<u4")[at]
            borders = ends[cut.offsets.to_numpy() - cut.offsets[0].as_py()]
            sizes = np.diff(borders)
        if self.end is not None:
            ids, sizes = np.insert(ids, np.cumsum(sizes), self.end), sizes + 1
        return ids, sizes

    def _chunks(self, chunks: list[str]) -> list[bytes]:
        """Ids of each chunk, from what is known or by the library."""
        known = self.known
        new = [c for c in chunks if c not in known]
        if len(known) + len(new) > KNOWN_CHUNKS:
            known.clear()
            new = chunks
        sign, width = self.mark.strip(), len(self.mark_ids)
        plain = [c for c in new if sign not in c]
        groups = [plain[at : at + 64] for at in range(0, len(plain), 64)]
        for some, made in zip(groups, self._fast([self.mark.join(g) for g in groups]), strict=True):
            ids = np.array(made.ids, dtype="<u4")
            marked = np.flatnonzero(ids == self.mark_ids[-1]) - (width - 1)
            for k, i in enumerate(self.mark_ids[:-1]):
                marked = marked[ids[marked + k] == i]
            raw, start = ids.tobytes(), 0
            for chunk, end in zip(some, [*marked.tolist(), len(ids)], strict=True):
                known[chunk] = raw[4 * start : 4 * end]
                start = end + width
        odd = [c for c in new if sign in c]
        known.update(zip(odd, self._whole(odd), strict=True))
        return list(map(known.__getitem__, chunks))

    def _fast(self, texts: list[str]) -> list:
        return self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self._fast(texts)]


def build(tokens: np.ndarray, docs: pa.RecordBatch) -> bytes:
    """A file of ``tokens`` (unsigned) whose documents are ``docs`` (columns ``doc_id`` and ``n_tokens``)."""
    n = len(tokens)
    present = np.flatnonzero(np.bincount(tokens, minlength=1)) if n else np.zeros(0, np.int64)
    codes = np.zeros(int(present[-1]) + 1 if n else 1, np.uint32)
    codes[present] = np.arange(len(present))
    levels = max(1, (len(present) - 1).bit_length())
    current = codes.astype(np.uint16 if levels <= 16 else np.uint32)[tokens]
    blocks, offsets, before, zeros = [], [0], [], []
    pack = zstandard.ZstdCompressor(level=1)
    for level in range(levels - 1, -1, -1):
        ones = (current & (1 << level)).astype(bool)
        bits = np.packbits(ones, bitorder="little")
        counts = np.add.reduceat(np.bitwise_count(bits), np.arange(0, len(bits), BLOCK // 8), dtype=np.int64) if n else np.zeros(0, np.int64)
        before.append(np.cumsum(counts) - counts)
        raw = bits.tobytes()
        for at in range(0, len(raw), BLOCK // 8):
            blocks.append(pack.compress(raw[at : at + BLOCK // 8]))
            offsets.append(offsets[-1] + len(blocks[-1]))
        zeros.append(n - int(counts.sum()))
        following = np.empty_like(current)  # places are much faster than masks here
        following[: zeros[-1]], following[zeros[-1] :] = current[np.flatnonzero(~ones)], current[np.flatnonzero(ones)]
        current = following
    sink = pa.BufferOutputStream()
    meta = pa.schema(docs.schema, {"shape": json.dumps({"n": n, "zeros": zeros})})
    with pa.ipc.new_stream(sink, meta, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(pa.RecordBatch.from_arrays(docs.columns, schema=meta))
    tables = sink.getvalue().to_pybytes()
    index = zstandard.ZstdCompressor().compress(np.concatenate([np.array(offsets, np.int64), *before, present]).tobytes())
    body = b"".join(blocks)
    return body + tables + index + struct.pack("<QQ", len(tables), len(index)) + MAGIC


class TokenFile:
    """A shard file opened for lookups: only its directory and the blocks asked for are read."""

    def __init__(self, file: pa.NativeFile):
        self.file = file
        size = file.size()
        file.seek(max(0, size - 24))
        tail = file.read(24)
        if len(tail) < 24 or tail[16:] != MAGIC:
            raise ValueError("not a token file, or cut short")
        tables, index = struct.unpack("<QQ", tail[:16])
        file.seek(size - 24 - tables - index)
        read = pa.ipc.open_stream(file.read(tables)).read_all()
        shape = json.loads(read.schema.metadata[b"shape"])
        self.n, self.zeros = shape["n"], shape["zeros"]
        self.doc_ids, self.sizes = read["doc_id"], read["n_tokens"].to_numpy()
        self.ends = np.cumsum(self.sizes)
        numbers = np.frombuffer(zstandard.ZstdDecompressor().decompress(file.read(index)), np.int64)
        self.per_level = -(-self.n // BLOCK)
        self.offsets = numbers[: self.per_level * len(self.zeros) + 1]
        at = len(self.offsets) + len(self.zeros) * self.per_level
        self.before, self.alphabet = numbers[len(self.offsets) : at].reshape(len(self.zeros), self.per_level), numbers[at:]
        self.kept: OrderedDict[int, np.ndarray] = OrderedDict()
        self.unpack = zstandard.ZstdDecompressor()

    def _block(self, level: int, k: int) -> np.ndarray:
        """Bits of a block, one a byte."""
        at = level * self.per_level + k
        if at in self.kept:
            self.kept.move_to_end(at)
            return self.kept[at]
        self.file.seek(int(self.offsets[at]))
        packed = np.frombuffer(self.unpack.decompress(self.file.read(int(self.offsets[at + 1] - self.offsets[at]))), np.uint8)
        self.kept[at] = bits = np.unpackbits(packed, count=min(BLOCK, self.n - k * BLOCK), bitorder="little")
        if len(self.kept) > KEPT_BLOCKS:
            self.kept.popitem(last=False)
        return bits

    def _ones(self, level: int, i: int) -> int:
        """Ones of a plane before position ``i``, at most ``n``."""
        k, rest = divmod(i, BLOCK)
        if k == self.per_level:
            return self.n - self.zeros[level]
        return int(self.before[level, k]) + (int(np.count_nonzero(self._block(level, k)[:rest])) if rest else 0)

    def access(self, i: int) -> int:
        """The token at position ``i``."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        token = 0
        for level, zeros in enumerate(self.zeros):
            one = int(self._block(level, i // BLOCK)[i % BLOCK])
            ones = self._ones(level, i)
            token, i = token * 2 + one, zeros + ones if one else i - ones
        return int(self.alphabet[token])

    def _code(self, token: int) -> int:
        """The number of a token in the file's alphabet; -1 for one that the file doesn't have."""
        k = int(np.searchsorted(self.alphabet, token))
        return k if k < len(self.alphabet) and self.alphabet[k] == token else -1

    def _range(self, token: int, i: int) -> tuple[int, int]:
        """Where the occurrences of ``token`` before position ``i`` lie below the last plane."""
        low, high, token = 0, i, self._code(token)
        if token < 0:
            return 0, 0
        for level, zeros in enumerate(self.zeros):
            a, b = self._ones(level, low), self._ones(level, high)
            low, high = (zeros + a, zeros + b) if token >> (len(self.zeros) - 1 - level) & 1 else (low - a, high - b)
        return low, high

    def rank(self, token: int, i: int) -> int:
        """Occurrences of ``token`` before position ``i``."""
        low, high = self._range(token, min(max(i, 0), self.n))
        return high - low

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def select(self, token: int, k: int) -> int:
        """Position of the occurrence ``k`` of ``token``, from 0."""
        low, high = self._range(token, self.n)
        if not 0 <= k < high - low:
            raise IndexError(k)
        at, token = low + k, self._code(token)
        for level in range(len(self.zeros) - 1, -1, -1):
            one = token >> (len(self.zeros) - 1 - level) & 1
            at = self._nth(level, one, at - self.zeros[level] if one else at)
        return at

    def _nth(self, level: int, one: int, k: int) -> int:
        """Position of the bit ``k`` of a plane, from 0, that is one (or zero)."""
        starts = self.before[level] if one else np.arange(self.per_level) * BLOCK - self.before[level]
        block = int(np.searchsorted(starts, k, side="right")) - 1
        return block * BLOCK + int(np.flatnonzero(self._block(level, block) == one)[k - int(starts[block])])

    def positions(self, token: int) -> Iterator[int]:
        """All positions of ``token``, ascending."""
        return (self.select(token, k) for k in range(self.count(token)))

    def document_at(self, i: int) -> tuple[int, int]:
        """The number of the document in the file that has position ``i``, and the offset in it."""
        k = int(np.searchsorted(self.ends, i, side="right"))
        return k, i - int(self.ends[k] - self.sizes[k])

    def tokens(self) -> np.ndarray:
        """All tokens: the planes are merged from the lowest digit up."""
        current = np.zeros(self.n, np.uint16 if len(self.zeros) <= 16 else np.uint32)
        for level in range(len(self.zeros) - 1, -1, -1):
            ones = np.concatenate([self._block(level, k) for k in range(self.per_level)]).view(bool) if self.n else np.zeros(0, bool)
            merged = np.empty_like(current)
            merged[np.flatnonzero(~ones)] = current[: self.zeros[level]]
            merged[np.flatnonzero(ones)] = current[self.zeros[level] :] | current.dtype.type(1 << (len(self.zeros) - 1 - level))
            current = merged
        return self.alphabet.astype("<u4")[current] if self.n else np.zeros(0, "<u4")


def write_shards(docs: DataFrame, folder: str, tokenizer: str, id_col: str = "doc_id", text: str = "text", end_id: int | None = END_ID, by_chunk: bool = True, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Encode every row and write shard files to ``folder``; the shards as rows ``part, seq, file, n_docs, n_tokens``.

    Rows are dealt out by ranges of the id, so that shards in the order of ``part`` and
    ``seq`` hold ascending ids, nulls first; rows of one id follow the hash of their text.
    An id with many rows is spread over parts. ``tokenizer`` is a path that every executor
    has. Null texts are empty; repeated rows stay; no rows give no shard. A task attempt
    writes files of its own names, and only those of attempts that succeed are listed.
    """
    kind = docs.select(id_col).schema[0].dataType.simpleString()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, path = pafs.FileSystem.from_uri(folder)
        where.create_dir(path, recursive=True)
        encoder = Encoder(tokenizer, end_id, by_chunk)
        done: list[tuple] = []
        held: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []  # ids of documents, their sizes, tokens
        size = 0

        def close() -> None:
            nonlocal size
            sizes = np.concatenate([h[1] for h in held])
            listed = pa.RecordBatch.from_arrays([pa.concat_arrays([h[0] for h in held]), pa.array(sizes)], names=["doc_id", "n_tokens"])
            name = f"{uuid.uuid4().hex}.tokens"
            with where.open_output_stream(f"{path}/{name}") as out:
                out.write(build(np.concatenate([h[2] for h in held]), listed))
            done.append((name, len(sizes), int(sizes.sum())))
            held.clear()
            size = 0

        for batch in batches:
            weight = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False))
            at = 0
            while at < len(batch):
                end = max(at + 1, int(np.searchsorted(weight, (weight[at - 1] if at else 0) + ENCODE_BYTES, side="right")))
                keys = batch.column(0).slice(at, end - at)
                tokens, sizes = encoder.encode(batch.column(1).slice(at, end - at))
                ends, first, begun = np.cumsum(sizes), 0, 0
                while first < len(sizes):  # a shard ends with the document that fills it
                    last = min(int(np.searchsorted(ends, begun + shard_tokens - size)) + 1, len(sizes))
                    held.append((keys.slice(first, last - first), sizes[first:last], tokens[begun : ends[last - 1]]))
                    size += int(ends[last - 1]) - begun
                    first, begun = last, int(ends[last - 1])
                    if size >= shard_tokens:
                        close()
                at = end
        if held:
            close()
        part = TaskContext.get().partitionId()
        columns = [[part] * len(done), list(range(len(done))), *([d[k] for d in done] for k in range(3))]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["part", "seq", "file", "n_docs", "n_tokens"])

    keyed = docs.select(F.col(id_col).cast(kind).alias("id"), F.col(text).alias("text"), F.xxhash64(text).alias("tie"), F.monotonically_increasing_id().alias("row"))
    ordered = keyed.repartitionByRange("id", "tie", "row").sortWithinPartitions("id", "tie").select("id", "text")
    listed = settle(ordered.mapInArrow(write, "part bigint, seq bigint, file string, n_docs bigint, n_tokens bigint"))
    listed.write.parquet(f"{folder}/_manifest")
    return listed


def _placed(shards: DataFrame) -> DataFrame:
    """``shards`` with ``start``, the tokens of all shards before each.

    The parts are as many as the write had tasks; shards of a part are counted within it.
    """
    parts = shards.groupBy("part").agg(F.sum("n_tokens").alias("all")).selectExpr("part", "sum(all) OVER (ORDER BY part) - all AS base")
    inner = shards.selectExpr("*", "sum(n_tokens) OVER (PARTITION BY part ORDER BY seq) - n_tokens AS inner_start")
    return inner.join(F.broadcast(parts), "part").select("file", (F.col("base") + F.col("inner_start")).alias("start"))


def _over_files(spark: SparkSession, folder: str, read, schema: str) -> DataFrame:
    """``read(file, name, start)`` yields record batches for each shard that the folder's manifest lists."""
    shards = spark.read.parquet(f"{folder}/_manifest")
    tasks = max(1, min(shards.count(), 4 * spark.sparkContext.defaultParallelism))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, path = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for row in batch.to_pylist():
                with where.open_input_file(f"{path}/{row['file']}") as file:
                    yield from read(TokenFile(file), row["file"], row["start"])

    return _placed(shards).repartition(tasks).mapInArrow(of, schema)


def read_documents(spark: SparkSession, folder: str, id_type: str = "bigint", with_ids: bool = False) -> DataFrame:
    """Per document of the shards: ``doc_id, start, n_tokens, ids_crc32``, with ``ids`` (binary) where asked.

    ``start`` counts the tokens of all documents before it; ids are little-endian unsigned
    32-bit integers, and so is what the checksum is of.
    """

    def read(file: TokenFile, name: str, start: int) -> Iterator[pa.RecordBatch]:
        tokens, ends = file.tokens(), file.ends
        starts, ids = ends - file.sizes, file.doc_ids.combine_chunks()
        for a in range(0, len(ends), TEXTS):
            b = min(a + TEXTS, len(ends))
            raw = [tokens[s:e].tobytes() for s, e in zip(starts[a:b].tolist(), ends[a:b].tolist(), strict=True)]
            columns = [ids.slice(a, b - a), pa.array(starts[a:b] + start), pa.array(file.sizes[a:b]), pa.array([zlib.crc32(x) for x in raw], pa.int64())]
            yield pa.RecordBatch.from_arrays([*columns, *([pa.array(raw, pa.binary())] if with_ids else [])], names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: 4 + with_ids])

    return _over_files(spark, folder, read, f"doc_id {id_type}, start bigint, n_tokens bigint, ids_crc32 bigint" + (", ids binary" if with_ids else ""))


def count_tokens(spark: SparkSession, folder: str, ids: list[int]) -> DataFrame:
    """``token, n``: how often each of ``ids`` occurs over all shards; by ranks, nothing is decoded."""

    def read(file: TokenFile, name: str, start: int) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([file.count(t) for t in ids], pa.int64())], names=["token", "n"])

    return _over_files(spark, folder, read, "token bigint, n bigint").groupBy("token").agg(F.sum("n").alias("n"))


def find_tokens(spark: SparkSession, folder: str, ids: list[int], id_type: str = "bigint") -> DataFrame:
    """``token, position, doc_id, offset`` of every occurrence of each of ``ids``, by selects."""

    def read(file: TokenFile, name: str, start: int) -> Iterator[pa.RecordBatch]:
        for token in ids:
            found: list[tuple] = []
            for at in file.positions(token):
                k, offset = file.document_at(at)
                found.append((at + start, k, offset))
                if len(found) == 4096:
                    yield _found(file, token, found)
                    found = []
            if found:
                yield _found(file, token, found)

    return _over_files(spark, folder, read, f"token bigint, position bigint, doc_id {id_type}, offset bigint")


def _found(file: TokenFile, token: int, found: list[tuple]) -> pa.RecordBatch:
    at, k, offset = (np.array(c, np.int64) for c in zip(*found, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(at), token)), pa.array(at), file.doc_ids.take(pa.array(k)).combine_chunks(), pa.array(offset)], names=["token", "position", "doc_id", "offset"])


def round_trip(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text: str = "text", end_id: int | None = END_ID) -> DataFrame:
    """Write the shards of ``docs``, read them back, and return ``id_col, start, n_tokens, ids_crc32`` per row.

    The files are removed once these figures are in the checkpoint folder.
    """
    spark, kind = docs.sparkSession, docs.select(id_col).schema[0].dataType.simpleString()
    folder = fresh_folder(spark, "tokens")
    write_shards(docs, folder, tokenizer, id_col, text, end_id)
    out = settle(read_documents(spark, folder, kind).withColumnRenamed("doc_id", id_col))
    remove_folder(spark, folder)
    return out
