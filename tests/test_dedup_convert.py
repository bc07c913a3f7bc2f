
from tomefold.operators import code_blocks as CB
from tomefold.operators import convert as CV
from tomefold.operators import dedup as DD


def test_exact_duplicates_keep_smallest(spark):
    df = spark.createDataFrame([(1, "A  b"), (2, "a b "), (3, "c")], "doc_id long, text string")
    got = {r.doc_id: (r.group_size, r.keep_id, r.keep) for r in DD.exact_duplicates(df).collect()}
    assert got == {1: (2, 1, True), 2: (2, 1, False), 3: (1, 3, True)}


def test_near_duplicates_against_bruteforce(spark):
    base = "the quick brown fox jumps over the lazy dog while the cat sleeps on the warm mat today"
    texts = [base, base + " again", base.replace("cat", "cow"), "completely different words that share nothing",
             "another unrelated sentence about rivers and mountains and seas"] + [base] * 5
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    comp = {r.doc_id: r.component for r in DD.near_duplicates(df, threshold=0.5).collect()}

    def sh(t):
        w = t.lower().split()
        return {" ".join(w[i:i + 3]) for i in range(len(w) - 2)}
    for i in range(len(texts)):
        for j in range(i + 1, len(texts)):
            a, b = sh(texts[i]), sh(texts[j])
            jac = len(a & b) / len(a | b)
            if jac >= 0.9:
                assert comp.get(i) is not None and comp.get(i) == comp.get(j)
            if jac < 0.2:
                assert comp.get(i) is None or comp.get(i) != comp.get(j)


def test_boilerplate_removed_in_order(spark):
    docs = spark.createDataFrame([(i, f"Menu\nline {i}\nFooter") for i in range(5)] + [(9, "only text")],
                                 "doc_id long, text string")
    bp = DD.boilerplate_lines(docs, share=0.5, min_docs=2)
    assert sorted(r.norm for r in bp.collect()) == ["Footer", "Menu"]
    out = {r.doc_id: r.clean_text for r in DD.strip_boilerplate(docs, bp).collect()}
    assert out[3] == "line 3" and out[9] == "only text"


def test_html_main_selection_and_fallback():
    page = ('<html><head><title>T</title><script>var t="</p>";</script></head><body><nav><a href="/x">nav</a></nav>'
            '<div class="document" role="main"><h1>Title</h1><p>Hello <b>bold<p>Next <a href="/y">link</a>'
            '<ul><li>one</li><li>two</li></ul><pre>code\n  here</pre></div></body></html>')
    md, fb = CV.html_to_markdown(page)
    assert not fb
    assert md.startswith("# Title\n")
    assert "[link](/y)" in md and "nav" not in md and "* one" in md and "```\ncode\n  here\n```" in md
    md2, fb2 = CV.html_to_markdown(page.replace('role="main"', ""))
    assert fb2 and "[nav](/x)" in md2 and "var t" not in md2


def test_code_blocks(spark):
    raw = "# A\n```python\nprint(1)\n```\ntext `inline` more\n```\nplain\n```"
    df = spark.createDataFrame([("v", "id1", "a.md", raw)], "version string, chunk_id string, file_path string, raw_chunk string")
    blocks = [(r.block_idx, r.lang, r.code) for r in CB.code_blocks(df).collect()]
    assert blocks == [(0, "python", "print(1)\n"), (1, "", "plain\n")]
    assert [r.code for r in CB.inline_code(df).collect()] == ["inline"]


def test_connected_components_chain_and_star(spark):
    chain = [(i, i + 1) for i in range(100, 160)]          # 61 nodes in a line
    star = [(7, j) for j in range(500, 540)]               # 41 nodes around 7
    pairs = chain + star
    edges = spark.createDataFrame(pairs + [(b, a) for a, b in pairs], "src long, dst long")
    got = {r.id: r.label for r in DD.connected_components(edges).collect()}
    assert all(got[i] == 100 for i in range(100, 161))
    assert all(got[j] == 7 for j in range(500, 540)) and got[7] == 7


def test_near_duplicates_on_documents_against_bruteforce(spark):
    import re
    from tomefold.sources.tables import table
    docs = table(spark, "/root/testdata/sf0.001", "documents", "doc_id", "text")
    comp = {r.doc_id: r.component for r in DD.near_duplicates(docs).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}

    def sh(t):
        w = re.findall(r"[^\W_]+", t.lower())
        return {" ".join(w[i:i + 3]) for i in range(max(1, len(w) - 2))} if w else set()
    shs = {k: sh(v) for k, v in texts.items()}
    ids = sorted(shs)
    strong = []
    adj = {i: set() for i in ids}
    for x in range(len(ids)):
        for y in range(x + 1, len(ids)):
            a, b = shs[ids[x]], shs[ids[y]]
            if not a or not b:
                continue
            j = len(a & b) / len(a | b)
            if j >= 0.7:
                adj[ids[x]].add(ids[y]), adj[ids[y]].add(ids[x])
            if len(a & b) / len(a | b) >= 0.7:
                strong.append((ids[x], ids[y]))
    assert len(strong) > 10
    for a, b in strong:   # every pair is found
        assert comp.get(a) is not None and comp.get(a) == comp.get(b), (a, b)
    # every reported component is connected by verified (>= 0.7) edges
    groups = {}
    for d, c in comp.items():
        groups.setdefault(c, set()).add(d)
    for members in groups.values():
        start = next(iter(members))
        seen, todo = {start}, [start]
        while todo:
            for n in adj[todo.pop()] & members:
                if n not in seen:
                    seen.add(n), todo.append(n)
        assert seen == members


def test_prefix_join_against_bruteforce(spark):
    import random
    from tomefold.operators.prefix_join import similar_across
    rng = random.Random(11)
    base = [rng.sample(range(60), rng.randrange(1, 25)) for _ in range(60)]
    sets = base + [[t for t in s if rng.random() > 0.15] + [rng.randrange(60, 90)] for s in base for _ in range(2)]
    sets = [sorted(set(s)) for s in sets]
    df = spark.createDataFrame(list(enumerate(sets)), "id long, sh array<long>")
    labels = spark.createDataFrame([(i, 0) for i in range(0, 60, 7)], "id long, label long")
    label = {i: 0 for i in range(0, 60, 7)}
    for t in (0.5, 0.7, 1.0):
        want = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets))
                if label.get(i, i) != label.get(j, j)
                and len(set(sets[i]) & set(sets[j])) / len(set(sets[i]) | set(sets[j])) >= t}
        got = [tuple(sorted((r["a"], r["b"]))) for r in similar_across(df, labels, t).collect()]
        assert len(got) == len(set(got)) and set(got) == want
