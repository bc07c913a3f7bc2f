"""The pipeline's stages, each against its operator's brute force on the stage's own input."""

from collections import Counter

import numpy as np
from messy import frame
from test_chosen_path import brute as classes
from test_packing import check as packed
from test_pii import brute as personal
from test_weak_rules import brute as counted

import corpus_pipeline as pipeline

SF = "/root/testdata/sf0.001"


def test_stages(spark, documents, tmp_path):
    docs, columns = documents, documents.columns
    rows = {r.doc_id: r for r in docs.collect()}
    results = []
    for k, (_, stage) in enumerate(pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        results.append(docs)
        if k < len(pipeline.STAGES) - 1:
            assert docs.columns == columns
    good, single, clean, mixed = (r.collect() for r in results[:4])
    assert 0 < len(good) < len(rows)
    for r in good:
        c = counted(r.text)
        assert r == rows[r.doc_id] and c[0] >= 50 and 100 * c[4] <= 50 * c[0]
    want = {cls for _, cls, _ in classes([(r.doc_id, r.text) for r in good])}
    assert {r.doc_id for r in single} == want and len(single) == len(want)
    assert {r.doc_id for r in clean} == want
    assert all(personal(r.text)[:4] == (0, 0, 0, 0) for r in clean)
    untouched = {r.doc_id: r.text for r in single if personal(r.text)[:4] == (0, 0, 0, 0)}
    assert all(r.text == untouched[r.doc_id] for r in clean if r.doc_id in untouched)
    copies = Counter(r.doc_id for r in mixed)
    assert max(copies.values()) <= 2 and set(copies) <= want
    total = sum(len(r.text.split()) for r in clean)
    assert abs(sum(len(r.text.split()) for r in mixed) - 1.5 * total) < 100
    packed([(r.doc_id, r.text) for r in mixed], results[4].collect())


def test_messy_rows_pass_every_stage(spark):
    for docs in (frame(spark), frame(spark, empty=True)):
        for k, (_, stage) in enumerate(pipeline.STAGES):
            out = stage(spark, docs, SF)
            assert k == len(pipeline.STAGES) - 1 or out.columns == docs.columns
            out.count()


def test_run(spark):
    out = pipeline.run(spark, SF)
    assert out.count() > 0 and np.all([r.length <= 1024 for r in out.select("length").collect()])
