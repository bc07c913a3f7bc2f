"""Base spans against a plain scan, disclosure against counts by hand, masking."""

import hashlib
import math
import re
from collections import Counter

from messy import frame

from tomefold.llm import pii


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def digits(m):
    return re.sub("[^0-9]", "", m.group())


BASE = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.group().split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(digits(m)) <= 19 and luhn(digits(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15)]


def brute(text):
    out = [(m.start(), o, f"{k}:{m.start()}:{m.end()}") for o, (k, p, ok) in enumerate(BASE)
           for m in re.finditer(p, text or "") if ok(m)]
    out.sort()
    n = Counter(x[1] for x in out)
    return *(n[o] for o in range(4)), hashlib.sha256(",".join(x[2] for x in out).encode()).hexdigest()


TRICKY = ["a@b.c_d@e.f.g a..b+%@x-y.z. @no a@b me@x.y.", "1.2.3.4.5.6.7.8 256.1.1.1 0001.002.3.0255 1.2.3 9.9.9.9.",
          "4111 1111 1111 1111, 4111-1111-1111-1112, 4111111111111111; 378282246310005 12345678901",
          "+1 (131) 555-7634 +49 30 123456 +123 +1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 7", "é ü 漢 x@y.zz 𝄞𝄞 x@y.zz",
          "9" * 1000, "a" * 5000, "x@" + "a." * 2000 + "b", "1." * 3000, "+1" + " " * 2000 + "2",
          "me@x.yz and +49 30 1234567 " * 700]


def test_base_spans(spark, documents):
    rows = [(r.doc_id, r.text) for r in documents.collect()] + [(10 ** 6 + i, t) for i, t in enumerate(TRICKY)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in pii.detect(docs).collect())
    assert got == Counter((d, *brute(t)) for d, t in rows)


def corpus():
    secret = [(i, f"note{chr(97 + i)} when Zorblatt calls write to spy@hide.org today number{i}") for i in range(5)]
    plain = [(100 + i, f"today we write number{i} of plain words that mean nothing at all") for i in range(40)]
    copies = [(200 + i, "the Quixote letter goes to one@copy.net always") for i in range(6)]
    return secret + plain + copies


def test_disclosure_by_hand(spark):
    docs = spark.createDataFrame(corpus(), "doc_id long, text string")
    from tomefold.llm.common import stored
    spans = stored(pii.found(docs), "test-spans")
    got = {(r.entity, r.term): r.disclosure for r in pii.revealing_terms(docs, spans).collect()}
    n = len(corpus())
    want = math.log(n * 5 / (5 * 5)) / math.log(n / 5)
    assert math.isclose(got["spy@hide.org", "zorblatt"], want) and want == 1.0
    assert ("spy@hide.org", "today") not in got and ("spy@hide.org", "write") not in got  # in plain texts too
    assert not any(e == "one@copy.net" for e, _ in got)                                   # copies of one text


def test_terms_are_spans_and_masked(spark):
    docs = spark.createDataFrame(corpus(), "doc_id long, text string")
    spans = {r.doc_id: r.spans for r in pii.detect(docs).collect()}
    text = dict(corpus())
    for i in range(5):
        at = text[i].index("Zorblatt")
        assert f"removed_term:{at}:{at + 8}" in spans[i].split(",")
    assert all(spans[100 + i] == "" for i in range(40))
    clean = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    assert "Zorblatt" not in clean[0] and "[EMAIL]" in clean[0] and "today" in clean[0]
    assert clean[100] == text[100] and "Quixote" in clean[200] and "@" not in clean[200]


def test_messy(spark):
    docs = frame(spark)
    assert pii.detect(docs).count() == docs.count()
    out = pii.sanitise(docs)
    assert out.columns == docs.columns
    rows = lambda df: Counter((r.doc_id, r.text, r.lang, r.source, r.key, r.size) for r in df.collect())
    assert rows(out) == rows(docs)  # nothing personal in it
    assert pii.detect(frame(spark, empty=True)).count() == 0
    assert pii.sanitise(frame(spark, empty=True)).count() == 0


def test_every_place_of_a_revealing_term(spark):
    far = " plain words" * 20
    rows = corpus() + [(300 + i, f"Mordax{far} tells{far} her@far.org{far} zorblatt {chr(97 + i)}{chr(98 + i)}{chr(99 + i)}")
                       for i in range(4)] + [(400, f"nobody is named here{far} but MORDAX is")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    spans = {r.doc_id: r.spans.split(",") for r in pii.detect(docs).collect()}
    clean = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    for i in range(4):                                    # far beyond a mention, in the same text
        assert "removed_term:0:6" in spans[300 + i] or "term:0:6" in spans[300 + i]
        assert "Mordax" not in clean[300 + i] and "her@far" not in clean[300 + i] and "plain" in clean[300 + i]
    assert "MORDAX" not in clean[400] and "nobody" in clean[400]  # a text without any mention
    at = rows[-2][1].index("her@")                        # no word of a mention is a term of its own
    assert [s for s in spans[303] if at <= int(s.split(":")[1]) < at + 11] == [f"email:{at}:{at + 11}"]


def test_repeated_rows_are_counted_alike(spark):
    rows = corpus() + [r for r in corpus() if r[0] < 5]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = pii.sanitise(docs).collect()
    assert len(got) == len(rows) == pii.detect(docs).count()
    assert not any("Zorblatt" in r.text for r in got)


def test_pools_by_hand(spark):
    """No entity repeats, yet the term that goes with a domain, stem, subnet, number block or issuer is found."""
    mails = [f"{a}{i}@firm.org" for i, a in enumerate(["ann", "bob", "cy", "dee"])]
    stems = [f"jane.roe{i}@host{i}.net" for i in range(4)]
    nets = [f"10.20.30.{i}" for i in range(4)]
    phones = [f"+49 (30) 5557 00{i}1" for i in range(4)]
    cards = [f"411111{i:04d}" for i in range(10 ** 4)]
    cards = [c + "0" * 5 + str(d) for c in cards[:200] for d in range(10) if luhn(c + "0" * 5 + str(d))][:4]
    words = ["firmament", "janitor", "netting", "phoneme", "cardinal"]
    rows, k = [], 0
    for word, group in zip(words, (mails, stems, nets, phones, cards)):
        for m in group:
            rows.append((k, f"{word} unique{chr(97 + k)} before {m} after"))
            k += 1
    rows += [(100 + i, f"before and after nothing of note number{chr(97 + i)}") for i in range(26)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    from tomefold.llm.common import stored
    got = {(r.entity, r.term): r.disclosure for r in pii.revealing_terms(docs, stored(pii.found(docs), "test-pools")).collect()}
    want = {("*@firm.org", "firmament"), ("janeroe@*", "janitor"), ("10.20.30.*", "netting"),
            ("+49305557*", "phoneme"), ("411111*", "cardinal")}
    assert set(got) == want and all(math.isclose(d, 1.0) for d in got.values())
    clean = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    assert not any(w in clean[i] for w in words for i in range(k)) and all("before" in clean[i] for i in range(k))
    assert all(clean[d] == t for d, t in rows if d >= 100)
