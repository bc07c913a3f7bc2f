"""Document chunking (T1-T4, W1) as native Spark expressions.

The whole chunker is a per-document projection built from higher-order
functions (``split``, ``aggregate``, ``transform``), so it is a narrow
transformation: no shuffle, no Python worker, and it scales with the number of
document rows.  Chunks are numbered by ``posexplode`` of the per-document chunk
array, which gives the dense ``chunk_index`` without a window shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import text as T


@dataclass(frozen=True)
class ChunkParams:
    target_tokens: int = C.TARGET_CHUNK_TOKENS
    overlap_tokens: int = C.OVERLAP_TOKENS
    min_section_tokens: int = C.MIN_SECTION_TOKENS
    source_root: str = C.SOURCE_ROOT
    # cl100k pre-tokens by default (a lower bound of the BPE count); "words"
    # (len(text.split())) is what the SQL twins reproduce
    counter: str = "bounded"
    fence_aware: bool = False          # Q2: `#` lines inside ``` fences neither split nor count as headings
    id_includes_version: bool = False  # Q9: put the version into the chunk id hash


# a `#` line inside a fence gets this mark in front of the `#` while chunking
FENCE_MARK = "\u0000"


def protect_fences(content) -> Column:
    """Mark ``#`` lines inside ``` fences so the splitter and the heading
    extraction skip them; the mark is removed from the chunks again."""
    pieces = F.split(T._c(content), "(?m)^```", -1)
    return F.array_join(F.transform(pieces, lambda p, i: F.when(
        i % 2 == 1, F.regexp_replace(p, "\n([ \t]*)#", "\n$1" + FENCE_MARK + "#")).otherwise(p)), "```")


def _empty():
    return F.array().cast("array<string>")


# --------------------------------------------------------------------------- T1
def split_by_headers(content) -> Column:
    """New section at every line that starts with ``#`` in column 0, except line 1."""
    return F.split(T._c(content), "\n(?=#)", -1)


# --------------------------------------------------------------------------- T2
def merge_small_sections(sections, min_tokens: int = C.MIN_SECTION_TOKENS, counter: str = "words") -> Column:
    """A section under ``min_tokens`` that is not last is prepended (``\\n\\n``) to
    the next one; the merged text is measured again."""
    return T.let(T._c(sections), lambda secs: _merge(secs, min_tokens, counter))


def _merge(secs: Column, min_tokens: int, counter: str) -> Column:
    n = F.size(secs)
    init = F.struct(_empty().alias("done"), F.lit(None).cast("string").alias("buf"))

    def step(acc, i):
        piece = F.element_at(secs, i)
        cur = F.when(acc["buf"].isNull(), piece).otherwise(F.concat(acc["buf"], F.lit("\n\n"), piece))

        def decide(c):
            carry = (i < n) & (T.token_count(c, counter) < min_tokens)  # cheap test first
            return F.when(carry, F.struct(acc["done"].alias("done"), c.alias("buf"))).otherwise(
                F.struct(F.array_append(acc["done"], c).alias("done"),
                         F.lit(None).cast("string").alias("buf")))
        return T.let(cur, decide)

    return F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), init, step, lambda acc: acc["done"])


# --------------------------------------------------------------------------- T3c
def _halve(cur: Column, max_tokens: int, counter: str = "words") -> Column:
    """Repeatedly cut the ``". "`` sentence list in half while the rest is too big.

    Returns ``struct(out array<string>, rest string, n int)``: the emitted first halves
    (each with a ``.`` appended), the remaining text and its tokens (0 unless the counter
    adds up).  Each round halves the remaining sentence count, so ``ceil(log2 m) + 1``
    rounds always suffice.
    """
    adds_up = counter in T.ADDITIVE

    def body(sents):
        m = F.size(sents)
        rounds = F.sequence(F.lit(1), (F.ceil(F.log2(m)).cast("int") + 1))
        # a sentence keeps its ". " and so ends in white space: tokens of the rest are the sum
        sizes = F.transform(sents, lambda s, i: T.token_count(F.when(i < m - 1, F.concat(s, F.lit(". "))).otherwise(s), counter)
                            ) if adds_up else F.array().cast("array<int>")
        return T.let(sizes, lambda ns: cut_up(sents, m, rounds, ns))

    def cut_up(sents, m, rounds, sizes):
        def total(ns):
            return F.aggregate(ns, F.lit(0), lambda acc, n: acc + n)

        init = F.struct(_empty().alias("out"), F.lit(0).alias("b"), F.lit(False).alias("stop"), total(sizes).alias("n"))

        def step(acc, _r):
            left = m - acc["b"]
            rest = F.array_join(F.slice(sents, acc["b"] + 1, left), ". ")
            fits = (acc["n"] if adds_up else T.token_count(rest, counter)) <= max_tokens
            halt = acc["stop"] | (left <= 1) | fits
            k = F.floor(left / 2).cast("int")
            cut = F.concat(F.array_join(F.slice(sents, acc["b"] + 1, k), ". "), F.lit("."))
            return F.when(halt, F.struct(acc["out"].alias("out"), acc["b"].alias("b"),
                                         F.lit(True).alias("stop"), acc["n"].alias("n"))).otherwise(
                F.struct(F.array_append(acc["out"], cut).alias("out"), (acc["b"] + k).alias("b"), F.lit(False).alias("stop"),
                         (acc["n"] - (total(F.slice(sizes, acc["b"] + 1, k)) if adds_up else F.lit(0))).alias("n")))

        return F.aggregate(rounds, init, step, lambda acc: F.struct(
            acc["out"].alias("out"),
            F.array_join(F.slice(sents, acc["b"] + 1, m - acc["b"]), ". ").alias("rest"), acc["n"].alias("n")))

    return T.let(F.split(cur, r"\. ", -1), body)


# --------------------------------------------------------------------------- T3a/b
def split_large_section(section, params: ChunkParams = ChunkParams()) -> Column:
    """Greedy packing of ``\\n\\n`` paragraphs up to ``target_tokens``; each new
    chunk starts with the last ``overlap_tokens`` of the previous one; an
    oversize chunk is cut by sentence halving.  A section that fits is kept.

    Every paragraph is counted once: counters that add up across white space
    (``text.ADDITIVE``) keep a running sum, so the work grows with the text, not with
    paragraphs times chunk size; the others measure the growing chunk again."""
    max_t, ov, ctr = params.target_tokens, params.overlap_tokens, params.counter
    sec = T._c(section)
    adds_up = ctr in T.ADDITIVE
    init = F.struct(_empty().alias("done"), F.lit("").alias("cur"), F.lit(0).alias("n"))

    def step(acc, para):
        has_cur = acc["cur"] != F.lit("")
        test = F.when(has_cur, F.concat(acc["cur"], F.lit("\n\n"), para["text"])).otherwise(para["text"])
        sum_n = acc["n"] + para["n"]

        def overflow():
            start = F.when(has_cur, F.concat(T.overlap_tail(acc["cur"], ov, ctr, acc["n"] if adds_up else None),
                                             F.lit("\n\n"), para["text"])).otherwise(para["text"])
            done = F.when(has_cur, F.array_append(acc["done"], acc["cur"])).otherwise(acc["done"])
            return T.let(_halve(start, max_t, ctr), lambda h: F.struct(
                F.concat(done, h["out"]).alias("done"), h["rest"].alias("cur"), h["n"].alias("n")))

        def kept(t):
            return F.struct(acc["done"].alias("done"), t.alias("cur"), sum_n.alias("n"))

        if adds_up:
            return F.when(sum_n <= max_t, kept(test)).otherwise(overflow())
        return T.let(test, lambda t: F.when(T.token_count(t, ctr) <= max_t, kept(t)).otherwise(overflow()))

    def fold(paras):
        return F.aggregate(paras, init, step, lambda acc: F.when(
            acc["cur"] != F.lit(""), F.array_append(acc["done"], acc["cur"])).otherwise(acc["done"]))

    # one oversize paragraph: the fold would only measure it again and halve it
    halved = T.let(_halve(sec, max_t, ctr), lambda h: F.when(
        h["rest"] != F.lit(""), F.array_append(h["out"], h["rest"])).otherwise(h["out"]))

    def pick(paras):
        size = F.aggregate(paras, F.lit(0), lambda acc, p: acc + p["n"]) if adds_up else T.token_count(sec, ctr)
        return F.when(size <= max_t, F.array(sec)).when(F.size(paras) == 1, halved).otherwise(fold(paras))

    return T.let(F.transform(F.split(sec, "\n\n", -1), lambda p: F.struct(
        p.alias("text"), (T.token_count(p, ctr) if adds_up else F.lit(0)).alias("n"))), pick)


# --------------------------------------------------------------------------- T4
def chunk_texts(content, params: ChunkParams = ChunkParams()) -> Column:
    """All raw (unstripped) chunk texts of a document, blanks dropped (T1+T2+T3+F2)."""
    merged = merge_small_sections(split_by_headers(content), params.min_section_tokens, params.counter)
    pieces = F.flatten(F.transform(merged, lambda s: split_large_section(s, params)))
    return F.filter(pieces, lambda p: ~T.is_blank(p))


def chunk_documents(docs: DataFrame, params: ChunkParams = ChunkParams()) -> DataFrame:
    """``docs(version, file_path, content)`` -> one row per chunk with metadata.

    Output columns: version, file_path, chunk_index, chunk_id, content (stripped),
    raw_chunk, section, content_type, title, heading_path, has_code, doc_url.
    Blank documents give no rows (F1); so do documents without chunks (F3).
    """
    d = (docs.filter(~T.is_blank("content"))
         .select("version", "file_path", "content"))
    if params.fence_aware:
        d = d.withColumn("content", protect_fences("content"))
    per_doc = d.select(
        "version", "file_path",
        T.heading_list("content").alias("heading_path"),
        chunk_texts("content", params).alias("chunks"))
    per_doc = per_doc.withColumn("title", T.title_of("heading_path", "file_path"))
    # posexplode_outer + null filter: a plain posexplode lets the optimizer infer
    # `size(chunks) > 0` and push it below this projection, which would evaluate
    # the whole chunker twice
    rows = per_doc.select(
        "version", "file_path", "title", "heading_path",
        F.posexplode_outer("chunks").alias("chunk_index", "raw_chunk")).filter(F.col("raw_chunk").isNotNull())
    if params.fence_aware:
        rows = rows.withColumn("raw_chunk", F.replace("raw_chunk", F.lit(FENCE_MARK), F.lit("")))
        rows = rows.withColumn("heading_path", F.transform(
            "heading_path", lambda h: F.replace(h, F.lit(FENCE_MARK), F.lit(""))))
    id_path = T.full_path_of("file_path", params.source_root)
    if params.id_includes_version:
        id_path = F.concat_ws("_", F.col("version"), id_path)
    return rows.select(
        "version", "file_path", "chunk_index",
        T.chunk_id_of(id_path, "chunk_index", "raw_chunk").alias("chunk_id"),
        T.py_strip("raw_chunk").alias("content"),
        "raw_chunk",
        T.section_of("file_path").alias("section"),
        T.content_type_of("file_path").alias("content_type"),
        "title", "heading_path",
        T.has_code("raw_chunk").alias("has_code"),
        T.doc_url_of("file_path").alias("doc_url"),
    )


def sections_of(docs: DataFrame, merged: bool, params: ChunkParams = ChunkParams()) -> DataFrame:
    """One row per (merged) section: version, file_path, sec_idx, section, n_tokens."""
    secs = split_by_headers("content")
    if merged:
        secs = merge_small_sections(secs, params.min_section_tokens, params.counter)
    out = (docs.select("version", "file_path", F.posexplode_outer(secs).alias("sec_idx", "section"))
           .filter(F.col("section").isNotNull()))
    return out.withColumn("n_tokens", T.token_count("section", params.counter))
