"""Operator 6: personal data by information-theoretic sanitisation.

Method: the base patterns (email, ip, card, phone) are protected entities.  Terms in the
same document may reveal the entity even after it is removed.  How strongly is estimated
from the corpus: with N documents, the entity in n_e, the term (outside mentions) in n_t
and both in n_te of them, the disclosure of e by t is ``PMI(e, t) / IC(e)`` =
``log(N n_te / (n_e n_t)) / log(N / n_e)``: 1 when every document with the term mentions
the entity, 0 when they are independent.  Terms above ``REMOVE`` are removed, terms above
``GENERALISE`` are replaced by their class, at every place of every document that holds
them.  A term must share at least ``SUPPORT`` different texts with the entity, so a chance
word, or copies of one text, reveal nothing.

Most entities stand in one text, which gives no estimate.  Every mention therefore also counts
for its pools (``POOLS``): the mail domain and the letters of the local part, the subnet, the
block of phone numbers, the card's issuer.  A pool is an entity like any other: n_e and n_te are
the documents that mention any of its members, so a term that goes with different addresses of
one person or firm is found though no address repeats.

Scale: DataFrame functions only.  Whole texts are counted, so long ones need no window.
The threshold bounds n_t by n_e: common words go before any pair is formed, and no pairs of
a group are.  Document counts aggregate on the map side; the distinct terms of each text
are written once, texts stay where they are until ``sanitise`` joins them with the terms
found in them.  Terms are broadcast only when few by count, else joined by shuffle.

Defined cases: null text is the empty text; null doc_ids are allowed; repeated rows are one
text for the support and each is returned; failing base matches are dropped without
retrying; spans of different kinds may overlap (``sanitise`` merges them, first kind
first); an empty table gives an empty result; other columns of ``docs`` pass through
``sanitise`` untouched, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tomefold.llm.common import SPAN_TYPE, labelled, let, matches, spelled, stored

# The base patterns.  Look-behinds and possessive repeats find the same
# leftmost matches in linear time: no later start inside a run can match where its first
# start failed, and nothing after a repeat could take back what it took.
_LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": f"(?:(?<!{_LOCAL})|\\G){_LOCAL}++@[A-Za-z0-9-]++(?:\\.[A-Za-z0-9-]++)++",
    "ip": "(?:(?<![0-9])|\\G)[0-9]++\\.[0-9]++\\.[0-9]++\\.[0-9]++",
    "card": "[0-9](?:[\\x20-]?[0-9])++",
    "phone": "\\+[0-9][\\x20().0-9-]+[0-9]",
}
#: A text without any of these has no span of the kind.
MAYBE = {"email": "@", "ip": "[0-9]\\.[0-9]++\\.[0-9]++\\.[0-9]", "card": "[0-9](?:[\\x20-]?[0-9]){11}", "phone": "\\+[0-9]"}
KINDS = tuple(PATTERNS)
#: What a mention (lower case) is pooled under; null for none.  A mark tells pools from mentions.
POOLS = {
    "email": (lambda m: F.concat(F.lit("*@"), F.substring_index(m, "@", -1)),
              lambda m: let(F.regexp_replace(F.substring_index(m, "@", 1), "[^a-z]", ""),
                            lambda stem: F.when(F.length(stem) >= 3, F.concat(stem, F.lit("@*"))))),
    "ip": (lambda m: F.concat(F.substring_index(m, ".", 3), F.lit(".*")),),
    "card": (lambda m: F.concat(F.substring(_digits(m), 1, 6), F.lit("*")),),
    "phone": (lambda m: let(_digits(m), lambda d: F.concat(
        F.lit("+"), F.substring(d, F.lit(1), F.length(d) - 4), F.lit("*"))),),
}
TERM = "\\p{L}{3,}+"
SUPPORT = 3
GENERALISE, REMOVE = 0.8, 0.95
BROADCAST_TERMS = 200_000

_NO_SPANS = "array<struct<start: bigint, end: bigint, m: string, g: string>>"


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(m: Column) -> Column:
    digits = _digits(m)
    values = F.transform(F.split(F.reverse(digits), "(?<=[0-9])(?=[0-9])"), lambda d, i: let(
        d.cast("int") * F.when(i % 2 == 1, 2).otherwise(1), lambda v: F.when(v > 9, v - 9).otherwise(v)))
    n = F.length(digits)
    return (n >= 12) & (n <= 19) & (F.when(n <= 19, F.aggregate(values, F.lit(0), lambda a, v: a + v)).otherwise(1) % 10 == 0)


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        parts = F.transform(F.split(m, "\\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", ""))
        return F.forall(parts, lambda p: (F.length(p) <= 3) & (F.lpad(p, 3, "0") <= "255"))
    if kind == "card":
        return _luhn(m)
    if kind == "phone":
        return F.length(_digits(m)).between(9, 15)
    return F.lit(True)


def base_matches(text: Column) -> dict[str, Column]:
    """Matches of every base kind: arrays of (start, end, m, g)."""
    out = {}
    for kind, pattern in PATTERNS.items():
        maybe = F.contains(text, F.lit("@")) if kind == "email" else text.rlike(MAYBE[kind])
        found = F.filter(matches(text, pattern), lambda x: _valid(kind, x["m"]))
        out[kind] = F.when(maybe, found).otherwise(F.array().cast(_NO_SPANS))
    return out


def protected() -> Column:
    """The entities of a row with the columns ``KINDS``: its mentions and their pools."""
    def named(kind, name):
        return F.transform(kind, lambda m: name(F.lower(m["m"])))

    names = [named(kind, name) for kind in KINDS for name in (lambda m: m, *POOLS[kind])]
    return F.array_compact(F.array_distinct(F.concat(*names)))


def _blanked(text: Column, mentions: Column) -> Column:
    """``text`` with every mention replaced by as many spaces (places stay)."""
    def step(acc, x):
        begin, end = F.greatest(acc["pos"], x["start"]), F.greatest(acc["pos"], x["end"])
        kept = F.substring(text, (acc["pos"] + 1).cast("int"), (begin - acc["pos"]).cast("int"))
        return F.struct(end.alias("pos"), F.concat(acc["out"], F.array(F.concat(
            kept, F.repeat(F.lit(" "), (end - begin).cast("int"))))).alias("out"))

    start = F.struct(F.lit(0).cast("long").alias("pos"), F.array().cast("array<string>").alias("out"))
    return F.when(F.size(mentions) == 0, text).otherwise(let(F.aggregate(
        F.array_sort(mentions), start, step), lambda end: F.concat(
            F.array_join(end["out"], ""), F.substring(text, (end["pos"] + 1).cast("int"), F.length(text)))))


def found(docs: DataFrame) -> DataFrame:
    """(doc_id, key, base spans by kind, entities, terms): ``terms`` are the distinct ones outside mentions."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    base = base_matches(F.col("text"))
    with_base = docs.select("doc_id", "text", row_key(F.col("doc_id"), F.col("text")).alias("key"),
                            *[m.alias(k) for k, m in base.items()])
    mentions = F.concat(*KINDS)
    terms = F.transform(F.regexp_extract_all(_blanked(F.col("text"), mentions), F.lit(TERM), F.lit(0)), F.lower)
    return with_base.select(
        "doc_id", "key", F.xxhash64("text").alias("text_hash"), *[labelled(F.col(k), i, k).alias(k) for i, k in enumerate(KINDS)],
        F.when(F.size(mentions) > 0, protected()).alias("entities"), F.array_distinct(terms).alias("terms"))


def row_key(doc_id: Column, text: Column) -> Column:
    """Names a row by its id and text (equal rows have equal spans)."""
    return F.xxhash64(doc_id, text)


def _with_few(rows: DataFrame, terms: DataFrame) -> DataFrame:
    """``rows`` joined with written ``terms``, broadcast (about 20 bytes a row) if there are few."""
    return rows.join(F.broadcast(terms) if terms.count() <= BROADCAST_TERMS else terms, "term")


def revealing_terms(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """(entity, term, disclosure) of all pairs above the lower threshold."""
    total = F.lit(float(max(2, spans.count())))
    held = spans.where(F.col("entities").isNotNull())
    mentions = held.select("key", "text_hash", F.explode("entities").alias("entity"))
    ic = F.log(total / F.least(F.col("n_e"), total - 1))
    # As n_te <= n_e, a pair above the threshold has n_t <= most.
    entities = stored(mentions.groupBy("entity").agg(F.count("*").alias("n_e"), F.countDistinct("text_hash").alias("texts"))
                      .where(F.col("texts") >= SUPPORT).withColumn("ic", ic)
                      .select("entity", "n_e", "ic", (total * F.exp(-GENERALISE * F.col("ic")) * (1 + 1e-9)).alias("most")),
                      "pii-entities")
    marked = stored(mentions.join(entities, "entity").groupBy("key").agg(
        F.collect_set(F.struct("entity", "n_e", "ic", "most")).alias("scored"), F.max("most").alias("bound")), "pii-marked")
    near = stored(held.join(marked.select("key", "bound"), "key").select(
        "key", "text_hash", "bound", F.explode("terms").alias("term")), "pii-near")
    seen = (near.groupBy("term").agg(F.count("*").alias("n"), F.countDistinct("text_hash").alias("texts"), F.max("bound").alias("bound"))
            .where((F.col("texts") >= SUPPORT) & (F.col("n") <= F.col("bound"))).select("term", "bound"))
    counts = spans.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n_t"))
    terms = stored(counts.join(seen, "term").where(F.col("n_t") <= F.col("bound")).select("term", "n_t"), "pii-terms")
    shared = (_with_few(near, terms).where(F.col("n_t") <= F.col("bound")).join(marked.select("key", "scored"), "key")
              .select("text_hash", "term", "n_t", F.explode(F.filter("scored", lambda e: e["most"] >= F.col("n_t"))).alias("e")))
    pmi = F.log(total * F.col("n_te") / (F.col("n_e") * F.col("n_t")))
    return (shared.groupBy("e.entity", "e.n_e", "e.ic", "term", "n_t")
            .agg(F.count("*").alias("n_te"), F.countDistinct("text_hash").alias("texts")).where(F.col("texts") >= SUPPORT)
            .withColumn("disclosure", pmi / F.col("ic")).where(F.col("disclosure") >= GENERALISE)
            .select("entity", "term", "disclosure"))


def term_hits(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """(key, hits): the revealing terms in the text and their disclosure, for the rows that have any."""
    strong = stored(revealing_terms(docs, spans).groupBy("term").agg(F.max("disclosure").alias("d")), "pii-revealing")
    hits = _with_few(spans.select("key", F.explode("terms").alias("term")), strong)
    return hits.groupBy("key").agg(F.map_from_entries(F.collect_set(F.struct("term", "d"))).alias("hits"))


def term_spans(text: Column, mentions: Column, hits: Column) -> Column:
    """Spans of every place of the terms in ``hits`` outside the mentions of ``text``."""
    order = len(KINDS)
    places = let(_blanked(text, mentions), lambda t: matches(
        t, TERM, keep=lambda m: F.coalesce(F.map_contains_key(hits, F.lower(m)), F.lit(False))))
    every = F.transform(places, lambda x: F.struct(
        x["start"].alias("start"), x["end"].alias("end"), F.try_element_at(hits, F.lower(x["m"])).alias("d")))
    return F.when(hits.isNull(), F.array().cast(SPAN_TYPE)).otherwise(F.transform(every, lambda x: F.struct(
        x["start"].alias("start"), F.when(x["d"] >= REMOVE, order + 1).otherwise(order).alias("order"), x["end"].alias("end"),
        F.when(x["d"] >= REMOVE, "removed_term").otherwise("term").alias("kind"))))


def detect(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) of every document."""
    spans = stored(found(docs), "pii-spans")
    hits = stored(term_hits(docs, spans), "pii-hits")
    text = F.coalesce("text", F.lit(""))
    texts = docs.select(row_key(F.col("doc_id").cast("long"), text).alias("key"), text.alias("text"))
    mentions = [F.col(k) for k in KINDS]
    once = spans.select("key", *KINDS).join(hits, "key").dropDuplicates(["key"])
    placed = (texts.join(once, "key").select("key", term_spans(F.col("text"), F.concat(*mentions), F.col("hits")).alias("places"))
              .dropDuplicates(["key"]))
    joined = spans.drop("terms").join(placed, "key", "left")
    base = F.array_sort(F.concat(*KINDS))
    every = F.array_sort(F.concat(*KINDS, F.coalesce("places", F.array().cast(SPAN_TYPE))))
    return joined.select("doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS],
                         F.sha2(spelled(base), 256).alias("base_sha256"), spelled(every).alias("spans"))


def masked(text: Column, spans: Column) -> Column:
    """``text`` with every span replaced by its kind in brackets, removed terms by nothing."""
    def step(acc, x):
        begin = F.greatest(acc["pos"], x["start"])
        mark = F.when(x["kind"] == "removed_term", "").otherwise(F.concat(F.lit("["), F.upper(x["kind"]), F.lit("]")))
        kept = F.substring(text, (acc["pos"] + 1).cast("int"), (begin - acc["pos"]).cast("int"))
        # a span inside one already masked adds nothing
        out = F.when(x["end"] <= acc["pos"], acc["out"]).otherwise(
            F.concat(acc["out"], F.array(F.concat(kept, F.when(x["start"] >= acc["pos"], mark).otherwise("")))))
        return F.struct(F.greatest(acc["pos"], x["end"]).alias("pos"), out.alias("out"))

    start = F.struct(F.lit(0).cast("long").alias("pos"), F.array().cast("array<string>").alias("out"))
    return let(F.aggregate(spans, start, step), lambda end: F.concat(
        F.array_join(end["out"], ""), F.substring(text, (end["pos"] + 1).cast("int"), F.length(text))))


def sanitise(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data masked in ``text``; n_chars, if there, is counted anew."""
    names = {c: f"_{i}_{c}" for i, c in enumerate(docs.columns)}
    spans = stored(found(docs), "pii-spans")
    hits = stored(term_hits(docs, spans), "pii-hits")
    text = F.col(names["text"])
    whole = F.coalesce(text, F.lit(""))
    wide = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()]).withColumn(
        "key", row_key(F.col(names["doc_id"]).cast("long"), whole)).join(hits, "key", "left")
    base = F.concat(*[labelled(m, i, k) for i, (k, m) in enumerate(base_matches(whole).items())])
    every = let(base, lambda b: F.array_sort(F.concat(b, term_spans(whole, b, F.col("hits")))))
    marked = let(every, lambda s: F.when(F.size(s) == 0, text).otherwise(masked(text, s)))
    out = wide.withColumn("_text", marked)
    new = {"text": F.col("_text")} | ({"n_chars": F.length("_text").cast("long")} if "n_chars" in names else {})
    return out.select(*[new.get(c, F.col(f"`{n}`")).alias(c) for c, n in names.items()])
