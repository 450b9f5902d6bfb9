"""Token files: exact round trips, and lookups against the plain list of ids."""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from sievework.llm import queries, token_files

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path(queries.TOKENIZER)
ODD = ["", "   ", None, "It's  NFC: é é\tÀ x y", "ΣΑΣ Σ.", "a\x01b \x01 c", "<|endoftext|> in<|startoftext|>side", "日本 語\n\nдва 🙂🙂", "don't DON'T 'll", "x" * 5000, "퟿‍ zwj og", "12345 3,4.5%", "End. Of. it.,. (a). 9. É. x,, .", "A.B. İ, İstanbul. ẞ."]


def plain(texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(PATH)
    return [tokenizer.encode(t or "", add_special_tokens=False).ids + [2] for t in texts]


def encoded(encoder, texts):
    ids, sizes = encoder.encode(pa.array(texts, pa.string()))
    return [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])]


def test_encoder_equals_whole_texts(monkeypatch):
    want = plain(ODD)
    assert encoded(token_files.Encoder(PATH), ODD) == want == encoded(token_files.Encoder(PATH, by_chunk=False), ODD)
    assert encoded(token_files.Encoder(PATH), ODD[3:][::-1]) == want[3:][::-1]
    monkeypatch.setattr(token_files, "KNOWN_CHUNKS", 3)
    forgetful = token_files.Encoder(PATH)
    assert [encoded(forgetful, [t])[0] for t in ODD] == want
    bare = token_files.Encoder(PATH, end_id=None)
    assert [encoded(bare, [t])[0] for t in ODD] == [ids[:-1] for ids in want]


@pytest.mark.parametrize("n, high, block", [(0, 5, 64), (1, 1, 64), (63, 3, 64), (64, 9, 64), (1000, 40, 64), (5000, 70_000, 1 << 16)])
def test_wavelet_lookups(monkeypatch, n, high, block):
    monkeypatch.setattr(token_files, "BLOCK", block)
    tokens = np.random.default_rng(n).integers(0, high, n).astype("<u4")
    sizes = [n // 3, 0, n - n // 3]
    docs = pa.RecordBatch.from_arrays([pa.array(["a", None, "c"]), pa.array(sizes, pa.int64())], names=["doc_id", "n_tokens"])
    raw = token_files.build(tokens, docs)
    file = token_files.TokenFile(pa.BufferReader(raw))
    assert (file.tokens() == tokens).all() and file.doc_ids.to_pylist() == ["a", None, "c"]
    listed = tokens.tolist()
    for i in range(0, n, max(1, n // 50)):
        assert file.access(i) == listed[i]
        assert file.rank(listed[i], i) == listed[:i].count(listed[i])
    counts = Counter(listed)
    for token in [*list(counts)[:20], high + 1, 1 << 20, -1]:
        where = [i for i, t in enumerate(listed) if t == token]
        assert file.count(token) == counts[token] and list(file.positions(token)) == where
        for at in where[:3]:
            k, offset = file.document_at(at)
            assert sum(sizes[:k]) + offset == at and offset < sizes[k]
    for call in (lambda: file.access(n), lambda: file.select(high + 1, 0)):
        with pytest.raises(IndexError):
            call()
    with pytest.raises(ValueError):
        token_files.TokenFile(pa.BufferReader(raw[:-1]))


def test_round_trip_of_hostile_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "SHARD_TOKENS", 50)
    rows = [(i // 2 if i % 5 else None, t, "x") for i, t in enumerate(ODD * 3)] + [(9, "hot row", "x")] * 60
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, id string").repartition(5)
    folder = str(tmp_path / "out")
    token_files.write_shards(docs, folder, PATH, shard_tokens=50)
    got = sorted((r for r in token_files.read_documents(spark, folder, with_ids=True).collect()), key=lambda r: r.start)
    want = {k: np.array(ids, "<u4").tobytes() for k, ids in zip([t for _, t, _ in rows], plain([t for _, t, _ in rows]), strict=True)}
    assert [r.doc_id for r in got] == sorted((r[0] for r in rows), key=lambda k: (k is not None, k or 0))
    assert Counter((r.doc_id, bytes(r.ids)) for r in got) == Counter((i, want[t]) for i, t, _ in rows)
    start = 0
    for r in got:
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(r.ids) // 4, zlib.crc32(bytes(r.ids)))
        start += r.n_tokens
    everything = [int(t) for r in got for t in np.frombuffer(bytes(r.ids), "<u4")]
    some = [2, everything[3], 49_000]
    counts = {r.token: r.n for r in token_files.count_tokens(spark, folder, some).collect()}
    assert counts == {t: everything.count(t) for t in some}
    places = sorted((r.token, r.position) for r in token_files.find_tokens(spark, folder, some).collect())
    assert places == sorted((t, i) for i, t in enumerate(everything) if t in some)


def test_query_equals_plain_encoding(spark, sf_dir):
    docs = sorted(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect())
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in queries.op12_token_files(spark, sf_dir).collect()}
    start, want = 0, {}
    for (doc_id, _), ids in zip(docs, plain([d.text for d in docs]), strict=True):
        want[doc_id] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert got == want


def test_no_rows(spark, tmp_path):
    spark.createDataFrame([], "doc_id string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert queries.op12_token_files(spark, str(tmp_path)).collect() == []
