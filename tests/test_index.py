import pytest

from tomefold.operators import embed as EM
from tomefold.operators import index as IX
from tomefold.operators import ingest as IN


def _rows(spark, rows):
    return spark.createDataFrame(rows, "version string, file_path string, chunk_id string, chunk_index int")


def test_upsert_parity_never_deletes_and_replace_does(spark):
    old = _rows(spark, [("v", "a.md", "a0", 0), ("v", "a.md", "a1", 1), ("v", "b.md", "b0", 0)])
    new = _rows(spark, [("v", "a.md", "a0", 0)])  # a.md shrank to one chunk
    up = sorted(r.chunk_id for r in IX.upsert(old, new, mode="upsert").collect())
    rep = sorted(r.chunk_id for r in IX.upsert(old, new, mode="replace").collect())
    assert up == ["a0", "a1", "b0"]          # stale a1 stays (parity)
    assert rep == ["a0", "b0"]               # replaced per file


def test_pair_vectors_reports_mismatches(spark):
    ch = spark.createDataFrame([("c1",), ("c2",)], "chunk_id string")
    vec = spark.createDataFrame([("c1", [1.0, 2.0]), ("c3", [1.0, 2.0])], "chunk_id string, vector array<float>")
    paired, errors = IX.pair_vectors(ch, vec, dim=2)
    assert [r.chunk_id for r in paired.collect()] == ["c1"]
    assert sorted((r.chunk_id, r.error) for r in errors.collect()) == [
        ("c2", "missing vector"), ("c3", "vector without chunk")]


def test_retry_only_on_rate_limit():
    calls, sleeps = [], []

    def flaky(texts):
        calls.append(1)
        if len(calls) < 3:
            raise RuntimeError("Error code: 429 - rate limit")
        return [[0.0] for _ in texts]
    assert EM.call_with_retry(flaky, ["a", "b"], sleep=sleeps.append) == [[0.0], [0.0]]
    assert len(calls) == 3 and len(sleeps) == 3  # batch pause + two backoffs

    def broken(texts):
        calls.append(1)
        raise ValueError("bad request")
    calls.clear()
    with pytest.raises(ValueError):
        EM.call_with_retry(broken, ["a"], sleep=lambda s: None)
    assert len(calls) == 1


def test_embed_with_turns_failures_into_error_rows(spark):
    df = spark.createDataFrame([("ok",), ("fail",)], "content string")

    def emb(texts):
        if "fail" in texts:
            raise ValueError("boom")
        return [[1.0, 2.0] for _ in texts]
    out = EM.embed_with(df, emb, batch_size=1, sleep=lambda s: None).orderBy("content").collect()
    assert out[0].content == "fail" and out[0].vector is None and "boom" in out[0].embed_error
    assert out[1].vector == [1.0, 2.0] and out[1].embed_error is None


def test_ingest_resume_and_change_detection(spark):
    docs1 = spark.createDataFrame([("v", "a.md", "# A\nalpha beta"), ("v", "b.md", "# B\ngamma")],
                                  "version string, file_path string, content string")
    empty_idx = spark.createDataFrame([], IX.INDEX_SCHEMA)
    empty_led = spark.createDataFrame([], IX.LEDGER_SCHEMA)
    idx1, led1 = IN.ingest_batch(docs1, empty_idx, empty_led, "r1")
    idx1, led1 = idx1.cache(), led1.cache()
    assert idx1.count() == 2 and led1.count() == 2
    docs2 = spark.createDataFrame([("v", "a.md", "# A\nalpha beta"), ("v", "b.md", "# B\ngamma delta"),
                                   ("v", "c.md", "# C\nnew")], "version string, file_path string, content string")
    idx2, led2 = IN.ingest_batch(docs2, idx1, led1, "r2")
    assert sorted(r.file_path for r in led2.collect()) == ["b.md", "c.md"]   # hash-based: changed + new
    _, led_p = IN.ingest_batch(docs2, idx1, led1, "r3", skip="path")
    assert [r.file_path for r in led_p.collect()] == ["c.md"]              # parity: path only
    assert sorted(r.run_id for r in idx2.collect()) == ["r1", "r2", "r2"]


def test_ledger_round_trip_missing_and_corrupt(spark, tmp_path):
    import os
    led = IX.ledger_rows(spark.createDataFrame([("v", "a.md", "# A\nx")], "version string, file_path string, content string"),
                         spark.createDataFrame([("v", "a.md")], "version string, file_path string"), "r1")
    path = str(tmp_path / "ledger")
    led.write.parquet(path)
    back = IX.read_or_empty(spark, path, IX.LEDGER_SCHEMA).collect()
    assert [(r.file_path, r.n_chunks, r.run_id) for r in back] == [("a.md", 1, "r1")]
    assert IX.read_or_empty(spark, str(tmp_path / "missing"), IX.LEDGER_SCHEMA).count() == 0
    bad = tmp_path / "corrupt"
    os.makedirs(bad)
    (bad / "part-0.parquet").write_bytes(b"not parquet at all")
    with pytest.raises(Exception, match="(?i)parquet"):  # a fault is no first run
        IX.read_or_empty(spark, str(bad), IX.LEDGER_SCHEMA).count()
    totals = IX.ledger_totals(IX.read_or_empty(spark, path, IX.LEDGER_SCHEMA)).collect()
    assert [(r.files_processed, r.chunks_created) for r in totals] == [(1, 1)]


def test_append_only_index_liveness(spark, tmp_path):
    base = str(tmp_path / "kb")
    schema = "version string, file_path string, content string"

    def run(docs, run_id):
        ledger = IX.read_or_empty(spark, base + "/ledger", IX.LEDGER_SCHEMA)
        rows, led, _ = IN.ingest_batch_with_errors(docs, None, ledger, run_id, mode="append")
        IX.append_rows(rows, base)
        led.write.mode("append").parquet(base + "/ledger")

    run(spark.createDataFrame([("v", "a.md", "# A\nfirst"), ("v", "b.md", "# B\nbee")], schema), "r1")
    run(spark.createDataFrame([("v", "a.md", "# A\nsecond text"), ("v", "b.md", "# B\nbee")], schema), "r2")
    IX.tombstones(spark.createDataFrame([("v", "b.md")], "version string, file_path string"), "r3") \
        .write.mode("append").parquet(base + "/ledger")
    # a run that appended rows but crashed before its ledger rows: never live
    orphan = spark.createDataFrame([("v", "c.md", "# C\nsee")], schema)
    rows, _, _ = IN.ingest_batch_with_errors(orphan, None, IX.read_or_empty(spark, base + "/ledger", IX.LEDGER_SCHEMA),
                                             "r4", mode="append")
    IX.append_rows(rows, base)
    live = IX.read_live_index(spark, base).collect()
    assert [(r.file_path, r.run_id, r.content) for r in live] == [("a.md", "r2", "# A\nsecond text")]
    assert spark.read.parquet(base + "/chunks").count() == 4  # r1: a, b; r2: a; r4: c


def test_compaction_keeps_live_rows_only(spark, tmp_path):
    base = str(tmp_path / "kb")
    schema = "version string, file_path string, content string"

    def run(docs, run_id):
        ledger = IX.read_or_empty(spark, base + "/ledger", IX.LEDGER_SCHEMA)
        rows, led, _ = IN.ingest_batch_with_errors(docs, None, ledger, run_id, mode="append")
        IX.append_rows(rows, base)
        led.write.mode("append").parquet(base + "/ledger")

    run(spark.createDataFrame([("v", "a.md", "# A\nfirst"), ("v", "b.md", "# B\nbee")], schema), "r1")
    run(spark.createDataFrame([("v", "a.md", "# A\nsecond")], schema), "r2")
    before = sorted((r.file_path, r.run_id) for r in IX.read_live_index(spark, base).collect())
    new_dir = IX.compact(spark, base)
    assert spark.read.parquet(new_dir).count() == len(before) == 2
    run(spark.createDataFrame([("v", "c.md", "# C\nsee")], schema), "r3")   # appends go to the new dir
    after = sorted((r.file_path, r.run_id) for r in IX.read_live_index(spark, base).collect())
    assert after == before + [("c.md", "r3")]
    assert spark.read.parquet(new_dir).count() == 3
