"""Section-level recovery, the timeline of sections, learned term associations."""

import re
from collections import Counter
from math import sqrt

import pyarrow as pa
from pyspark.sql import functions as F

from tomefold.operators import association as AS
from tomefold.operators import chunk as CH
from tomefold.operators import embed as EM
from tomefold.operators import index as IX
from tomefold.operators import ingest as IN
from tomefold.operators import partial as PA
from tomefold.operators import versions as VS
from tomefold.plans import jobs as J

SMALL = CH.ChunkParams(counter="words", min_section_tokens=0)


def _docs(spark, files, version="1"):
    return spark.createDataFrame([(version, p, t) for p, t in files], "version string, file_path string, content string")


def _refusing(word):
    def embed(df):
        out = EM.embed_hashed(df, "content")
        return out.withColumn("embed_error", F.when(F.col("content").contains(word), F.lit("down")))
    return embed


def _tables(spark, base):
    return (IX.read_or_empty(spark, f"{base}/failed_chunks", PA.FAILED_SCHEMA),
            IX.read_or_empty(spark, f"{base}/chunks", IX.INDEX_SCHEMA),
            IX.read_or_empty(spark, f"{base}/ledger", IX.LEDGER_SCHEMA))


def _states(spark, base):
    return {r.file_path: (r.n_indexed, r.n_pending, r.status) for r in PA.section_states(*_tables(spark, base)).collect()}


def test_good_sections_commit_and_failed_ones_are_retried_alone(spark, tmp_path):
    base = str(tmp_path / "index")
    docs = _docs(spark, [("a.md", "# One\nalpha\n# Two\nbad beta\n# Three\ngamma"), ("b.md", "# Four\ndelta"),
                         ("c.md", "# Five\nbad only"), ("blank.md", " ")])
    J.ingest_sections(spark, docs, base, SMALL, _refusing("bad"))
    assert _states(spark, base) == {"a.md": (2, 1, "partial"), "b.md": (1, 0, "whole")}
    pending = PA.pending_sections(*_tables(spark, base)).collect()
    assert [(r.file_path, r.chunk_index, r.error) for r in pending] == [("a.md", 1, "down")]

    J.retry_failed(spark, base, _refusing("bad"))       # still down: nothing changes
    assert _states(spark, base)["a.md"] == (2, 1, "partial")
    J.retry_failed(spark, base)
    J.retry_failed(spark, base)                         # repeated: no row twice
    assert _states(spark, base) == {"a.md": (3, 0, "whole"), "b.md": (1, 0, "whole")}
    live = IX.read_live_index(spark, base).filter("file_path = 'a.md'").collect()
    assert sorted(r.chunk_index for r in live) == [0, 1, 2]
    totals = IX.ledger_totals(_tables(spark, base)[2]).collect()
    assert [(r.files_processed, r.chunks_created) for r in totals] == [(2, 4)]

    J.ingest_sections(spark, docs, base, SMALL)         # the file that failed whole is taken whole, no other
    assert _states(spark, base) == {"a.md": (3, 0, "whole"), "b.md": (1, 0, "whole"), "c.md": (1, 0, "whole")}
    assert _tables(spark, base)[1].count() == 5


def test_failed_sections_of_an_edited_file_are_not_retried(spark, tmp_path):
    base = str(tmp_path / "index")
    J.ingest_sections(spark, _docs(spark, [("a.md", "# One\nalpha\n# Two\nbad beta")]), base, SMALL, _refusing("bad"))
    J.ingest_sections(spark, _docs(spark, [("a.md", "# One\nalpha\n# Two\nnew text")]), base, SMALL, _refusing("bad"))
    assert PA.pending_sections(*_tables(spark, base)).count() == 0
    J.retry_failed(spark, base)
    assert {r.content for r in IX.read_live_index(spark, base).collect()} == {"# One\nalpha", "# Two\nnew text"}


def test_a_retry_that_stopped_before_its_ledger_rows_is_mended(spark, tmp_path):
    base = str(tmp_path / "index")
    J.ingest_sections(spark, _docs(spark, [("a.md", "# One\nalpha\n# Two\nbad beta")]), base, SMALL, _refusing("bad"))
    rows, _, _ = PA.retry_sections(*_tables(spark, base), str(tmp_path / "staging"))
    IX.append_rows(rows, base)
    J.retry_failed(spark, base)
    assert _tables(spark, base)[1].count() == 2
    assert IX.ledger_totals(_tables(spark, base)[2]).first()["chunks_created"] == 2


def test_section_timeline(spark):
    texts = {"1": "# A\nx\n# B\nx\n# C\nx\n# B\ny", "2": "# A\nchanged\n# B\nx\n# D\nx", "3": "# A\nchanged\n# C\nx\n# D\nx\n# E\nx",
             "4": "# A\nagain\n# D\nx\n# E\nx\n# C\nx"}
    docs = None
    for v, t in texts.items():
        d = _docs(spark, [("f.md", t)], v)
        docs = d if docs is None else docs.union(d)
    got = {(r.heading, r.occurrence, r.valid_from): (r.valid_to, r.n_versions, r.n_edits, r.status)
           for r in VS.section_timeline(docs, ["1", "2", "3", "4"]).collect()}
    # a section's text includes its line end, so the last one of a file differs from itself elsewhere
    edits = {k: v[2] for k, v in got.items()}
    assert {k: (v[0], v[1], v[3]) for k, v in got.items()} == {
        ("# A", 1, "1"): ("4", 4, "original"), ("# B", 1, "1"): ("2", 2, "deprecated"), ("# B", 2, "1"): ("1", 1, "deprecated"),
        ("# C", 1, "1"): ("1", 1, "deprecated"), ("# C", 1, "3"): ("4", 2, "returned"),
        ("# D", 1, "2"): ("4", 3, "added"), ("# E", 1, "3"): ("4", 2, "added")}
    assert edits[("# A", 1, "1")] == 2 and edits[("# B", 1, "1")] == 0
    assert VS.section_timeline(docs.filter("1 = 0"), ["1", "2"]).count() == 0
    assert VS.section_timeline(docs, ["3"]).select("status").distinct().first()[0] == "original"


def test_term_associations_equal_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").limit(60).collect()
    texts = [r.text for r in docs] + [None, "", "solo", "a a a a"]
    df, both = Counter(), Counter()
    for t in texts:
        w = [x for x in re.split(r"[^\w]+|_", (t or "").lower()) if x]
        df.update(set(w))
        both.update({tuple(sorted((w[i], w[i + d]))) for i in range(len(w)) for d in range(1, AS.WINDOW + 1)
                     if i + d < len(w) and w[i] != w[i + d]})
    want = set()
    partners = {}
    for (a, b), n in both.items():
        if n >= AS.MIN_SUPPORT:
            for x, y in ((a, b), (b, a)):
                partners.setdefault(x, []).append((-n / sqrt(df[x] * df[y]), y, n))
    for x, ps in partners.items():
        for rank, (_, y, n) in enumerate(sorted(ps)[:AS.TOP], 1):
            want.add((x, y, rank, df[x], df[y], n))
    frame = spark.createDataFrame([(t,) for t in texts], "text string")
    learned = AS.term_associations(frame)
    got = {tuple(r) for r in learned.collect()}
    assert got == want and want
    term, synonym = next((r[0], r[1]) for r in sorted(got))
    queries = spark.createDataFrame([(1, term)], "qid long, query string")
    out = IN.expand_queries(queries, learned.select("term", "synonym")).first()["expanded_query"]
    assert out.split(" ")[0] == term and synonym in out.split(" ")
    assert AS.term_associations(frame.filter("1 = 0")).count() == 0


def test_term_pairs_cross_the_shuffle_as_lists_of_codes(spark, monkeypatch):
    for name, value in (("COMMON", 2), ("WORDS_AT_ONCE", 7), ("PAIRS_HELD", 9), ("MAX_PARTNERS", 2), ("ROWS_AT_ONCE", 3)):
        monkeypatch.setattr(AS, name, value)
    salts, code = [], AS._code
    monkeypatch.setattr(AS, "_code", lambda term, salt: salts.append(salt) or (F.length(term).cast("long") if salt < 2 else code(term, salt)))
    texts = [" ".join(f"{c}{(i * 7 + k * k) % 5}" for k, c in enumerate("the of the x y z of a the y".split())) for i in range(12)]
    texts += ["", None, "the of the of the of the", "the of x", "x"] * 3
    df, both = Counter(), Counter()
    for t in texts:
        w = (t or "").split()
        df.update(set(w))
        both.update({frozenset((w[i], w[j])) for i in range(len(w)) for j in range(i + 1, min(len(w), i + 5)) if w[i] != w[j]})
    learned = AS.term_associations(spark.createDataFrame([(t,) for t in texts], "text string").repartition(2), top=100)
    got = {(r.term, r.synonym): (r.n_term, r.n_synonym, r.n_both) for r in learned.collect()}
    assert got == {(x, y): (df[x], df[y], n) for p, n in both.items() if n >= AS.MIN_SUPPORT for x, y in (sorted(p), sorted(p)[::-1])}
    assert max(salts) == 2  # codes that two terms share are not used


def test_common_terms_own_no_pairs_with_others():
    codes = pa.array([[1, 2, 1, 3], [1, 4], [], [1, 2, 5]], pa.list_(pa.int64()))
    batch = pa.RecordBatch.from_arrays([codes], names=["codes"])
    rows = [r for out in AS._counted(2, [1, 2])([batch.slice(0, 3), batch.slice(3)]) for r in out.to_pylist()]
    assert {r["a"]: dict(zip(r["b"], r["n"])) for r in rows} == {1: {2: 2}, 3: {1: 1, 2: 1}, 4: {1: 1}, 5: {1: 1, 2: 1}}
