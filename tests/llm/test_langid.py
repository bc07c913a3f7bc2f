"""Language identification: held-out accuracy, backoff by hand, defined cases."""

import math
from collections import Counter

from messy import frame

from tomefold.llm import langid
from tomefold.llm.common import held_out

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.train(docs.where(~held_out(docs["doc_id"])))
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    got = [r for r in langid.identify(docs, model).collect() if r.held_out]
    right = sum(r.lang_pred == truth[r.doc_id] for r in got)
    assert right / len(got) > 0.97


def test_words_first_then_shorter_grams(spark, monkeypatch):
    docs = spark.createDataFrame([("sun sun moon", "en"), ("sol luna", "es"), ("sol", "es"), ("x", None), (None, "en")],
                                 "text string, lang string")
    model = langid.train(docs)
    assert model["langs"] == ["en", "es"]
    assert [round(math.exp(p), 9) for p in model["prior"]] == [round(1 / 3, 9), round(2 / 3, 9)]
    index, logs = model["tables"][0]
    counts = {"sun": (2, 0), "moon": (1, 0), "sol": (0, 2), "luna": (0, 1)}
    for word, by in counts.items():
        want = [math.log((n + 0.5) / (3 + 0.5 * 5)) for n in by]
        assert all(math.isclose(a, b) for a, b in zip(logs[index[word]], want))
    scorer = langid.Scorer(model)
    five, three = model["tables"][5], model["tables"][3]
    assert all(g in five[0] for g in ("^moon", "moon$"))
    assert scorer.unseen("moonx") == (5, [five[0]["^moon"]])            # its one known 5-gram
    assert scorer.unseen("xsun") == (4, [model["tables"][4][0]["sun$"]])
    assert scorer.unseen("qsunq") == (3, [three[0]["sun"]])
    assert scorer.unseen("qqqq") == (1, [])
    total = model["prior"] + 2 * logs[index["sun"]] + three[1][three[0]["sun"]]
    p = [math.exp(x - max(total)) for x in total]
    assert math.isclose(scorer.predict("sun sun qsunq")[1], max(p) / sum(p))
    monkeypatch.setattr(langid, "FLUSH", 2)                              # flushing early counts the same
    again = langid.train(docs)
    assert all((again["tables"][k][1] == model["tables"][k][1]).all() for k in model["tables"])


def test_counts_are_of_whole_texts():
    counts = {}
    langid._add_words(counts, "en", "a b " * 5000 + "last")
    assert counts[("en", 0)] == Counter({"a": 5000, "b": 5000, "last": 1})


def test_messy(spark):
    docs = frame(spark)
    got = langid.identify(docs, langid.train(docs)).collect()
    assert len(got) == docs.count()
    for r in got:
        if r.doc_id in (0, 1, 2):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        assert 0 <= r.score <= 1
    none = langid.train(docs.limit(0))
    assert {r.lang_pred for r in langid.identify(docs, none).collect()} == {"und"}
    assert langid.identify(frame(spark, empty=True), none).count() == 0
