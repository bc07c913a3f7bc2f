"""Repeated blocks against brute force over all runs of lines."""

import random
from collections import Counter, defaultdict

from tomefold.operators import blocks as BL


def brute(texts, cut, min_lines):
    """{block: (documents, places)} and the removed (id, place of the non-blank line)."""
    lines = {d: [x.strip() for x in (t or "").split("\n") if x.strip()] for d, t in texts.items()}
    held = defaultdict(set)
    for d, ls in lines.items():
        for i in range(len(ls)):
            for j in range(i + 1, len(ls) + 1):
                held[tuple(ls[i:j])].add(d)
    blocks, gone = Counter(), set()
    for d, ls in lines.items():
        reach = [max([j for j in range(i + 1, len(ls) + 1) if len(held[tuple(ls[i:j])]) >= cut], default=i) for i in range(len(ls))]
        for i, j in enumerate(reach):
            if j - i >= min_lines and (i == 0 or reach[i - 1] < j):
                blocks["\n".join(ls[i:j])] += 1
                gone |= {(d, k) for k in range(i, j)}
    return {b: (len(held[tuple(b.split("\n"))]), n) for b, n in blocks.items()}, gone


def texts():
    rng = random.Random(7)
    long = [f"long {k}" for k in range(37)]
    out = {i: "\n".join(rng.choice("ab") if rng.random() < .8 else f"own {i} {k}" for k in range(rng.randint(1, 14))) for i in range(40)}
    for i in range(4):      # a long block, cut to other lengths elsewhere
        out[100 + i] = "\n".join([f"head {i}", *long, f"foot {i}"])
        out[110 + i] = "\n".join([f"start {i}", *long[:6 + i], f"end {i}", *long[20:31]])
    for i in range(3):      # twice in one text, blanks and spaces within
        out[120 + i] = f"x {i}\n nav one \n\n\tnav two\n\nmid {i}\nnav one\nnav two\nnav three"
    return out | {200: None, 201: "", 202: "\n \n", 203: "nav one"}


def test_blocks_equal_brute_force(spark):
    data = texts()
    docs = spark.createDataFrame(list(data.items()), "doc_id long, text string")
    for cut, least in ((3, 2), (2, 1)):
        want, gone = brute(data, cut, least)
        got = {r.block: (r.n_docs, r.n_places) for r in BL.repeated_blocks(docs, cut, min_lines=least).collect()}
        assert got == want and max(b.count("\n") for b in got) == 36
    want, gone = brute(data, 3, 2)
    clean = {r.doc_id: (r.n_removed, r.clean_text) for r in BL.strip_blocks(docs, BL.block_places(docs)[0]).collect()}
    assert clean.keys() == data.keys() and clean[200] == (0, None) and clean[203] == (0, "nav one")
    for d, t in data.items():
        kept = [x.strip() for x in (t or "").split("\n") if x.strip()]
        kept = [x for k, x in enumerate(kept) if (d, k) not in gone]
        assert [x.strip() for x in (clean[d][1] or "").split("\n") if x.strip()] == kept
    assert clean[120] == (6, "x 0\n\nmid 0")


def test_share_and_nothing_found(spark):
    docs = spark.createDataFrame([(i, "a\nb") for i in range(4)] + [(i, f"own {i}") for i in range(4, 40)], "doc_id long, text string")
    assert BL.repeated_blocks(docs, share=0.1).collect() == [("a\nb", 2, 4, 4)]
    assert BL.repeated_blocks(docs, share=0.2).count() == 0
    none = docs.limit(0)
    assert BL.repeated_blocks(none).count() == 0 and BL.strip_blocks(none, BL.block_places(none)[0]).count() == 0
