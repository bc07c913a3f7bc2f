"""Stores: exact round trips, random access, order."""

import zlib

import numpy as np
import pytest
from messy import frame

from tomefold.llm import token_store as ts
from tomefold.llm.tokens import Encoder, default_path

PATH = default_path("word_bpe_49k.json")


@pytest.mark.parametrize("top", [200, 256, 60_000, 2 ** 31])
def test_levels(top):
    rng = np.random.default_rng(top % 97)
    for n in (0, 1, 7, 8, 511, 512, 513, 5000):
        ids = rng.integers(0, top, n, dtype=np.uint32) >> rng.integers(0, 20, n, dtype=np.uint32)
        levels = ts.encode_levels(ids)
        assert (ts.decode_levels(levels, n) == ids).all()
        for i in range(0, n, max(1, n // 300)):
            assert ts.token_at(levels, i) == ids[i]


def expected(rows):
    enc, start, out = Encoder(PATH, False), 0, []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = (enc.plain(text) if text else b"") + np.asarray([1], "<u4").tobytes()
        out.append((doc_id, start, len(ids) // 4, zlib.crc32(ids)))
        start += len(ids) // 4
    return out


def store(docs, path, **options):
    ts.write_store(docs, path, PATH, 1, False, **options)
    return ts.read_store(docs.sparkSession, path)


def key(row):
    return row[1]


def test_documents(documents, tmp_path):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    shards = store(documents, str(tmp_path / "store"), shard_tokens=5000)
    got = sorted((tuple(r) for r in ts.document_digests(shards).collect()), key=key)
    assert got == expected(rows)
    enc, text = Encoder(PATH, False), dict(rows)
    for shard in shards.limit(3).collect():
        levels = [lv.asDict() for lv in shard.levels]
        ids = np.frombuffer(b"".join(enc.ids([text[d]])[0] + b"\1\0\0\0" for d in shard.doc_ids), "<u4")
        assert len(ids) == shard.n_tokens
        assert all(ts.token_at(levels, i) == ids[i] for i in range(0, len(ids), 37))


def test_messy(spark, tmp_path):
    docs = frame(spark)
    shards = store(docs, str(tmp_path / "messy"))
    got = sorted((tuple(r) for r in ts.document_digests(shards).collect()), key=key)
    assert got == expected([(r.doc_id, r.text) for r in docs.collect()])
    none = store(frame(spark, empty=True), str(tmp_path / "none"))
    assert ts.document_digests(none).count() == 0
