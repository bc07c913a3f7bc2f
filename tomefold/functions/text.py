"""Scalar text functions as native Spark columns (no Python UDFs).

Every function takes and returns ``Column`` objects, so Catalyst keeps them
inside the JVM and they compose inside higher-order functions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as C


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and pass it to ``body`` (a one-element transform).

    Spark has no let-binding inside higher-order functions; without this a
    sub-expression used several times would be evaluated several times.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


# --------------------------------------------------------------------------- tokens
# counter name -> (pattern whose matches are the tokens, lossless piece pattern)
COUNTERS = {
    "words": (C.JAVA_WORD_PATTERN, C.JAVA_WORD_PIECE_PATTERN),
    "pretoken": (C.PRETOKEN_PATTERN, C.PRETOKEN_PATTERN),
    "bounded": (C.JAVA_BOUNDED_PATTERN, C.JAVA_BOUNDED_PIECE_PATTERN),
}
# counters whose tokens hold no white space: texts joined by white space have the sum of their counts
ADDITIVE = ("words", "bounded")


def token_count(text, counter: str = "words") -> Column:
    """Number of tokens: ``words`` = ``len(text.split())``; ``pretoken`` = pieces
    of the cl100k pre-tokenizer (a lower bound of the BPE count); ``bounded`` =
    words cut into pieces of bounded length, single letters of unspaced scripts."""
    return F.regexp_count(_c(text), F.lit(COUNTERS[counter][0]))


def overlap_tail(text, n: int, counter: str = "words", size: Column | None = None) -> Column:
    """Text of the last ``n`` tokens; the whole text if it has at most ``n`` (``size``: its tokens, if known)."""
    t = _c(text)
    return F.when((token_count(t, counter) if size is None else size) <= n, t).otherwise(
        F.array_join(F.slice(F.regexp_extract_all(t, F.lit(COUNTERS[counter][1]), 0), -n, n), ""))


# --------------------------------------------------------------------------- strip
def py_strip(text) -> Column:
    """``str.strip()``: trim Python whitespace on both ends."""
    return F.btrim(_c(text), F.lit(C.PY_WHITESPACE))


def is_blank(text) -> Column:
    """True for empty or whitespace-only text (F1, F2)."""
    return py_strip(text) == F.lit("")


# --------------------------------------------------------------------------- paths
def relative_path(path, root: str) -> Column:
    """Strip ``root/`` from the front of a path."""
    prefix = root.rstrip("/") + "/"
    p = _c(path)
    return F.when(p.startswith(prefix), F.substring(p, len(prefix) + 1, 1 << 30)).otherwise(p)


def section_of(file_path) -> Column:
    """First path part; a root-level file gives its own name."""
    return F.split_part(_c(file_path), F.lit("/"), F.lit(1))


def content_type_of(file_path) -> Column:
    """Path rule: tutorial > example > api/reference > default."""
    low = F.lower(_c(file_path))
    expr = None
    for label, terms in C.CONTENT_TYPE_RULES:
        cond = None
        for term in terms:
            hit = low.contains(term)
            cond = hit if cond is None else (cond | hit)
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr.otherwise(F.lit(C.DEFAULT_CONTENT_TYPE))


def doc_url_of(file_path) -> Column:
    """``/`` + path with every ``.md`` replaced by ``.html``."""
    return F.concat(F.lit("/"), F.replace(_c(file_path), F.lit(".md"), F.lit(".html")))


def file_stem(file_path) -> Column:
    """Last path part without its final suffix (``Path.stem``)."""
    name = F.element_at(F.split(_c(file_path), "/", -1), -1)
    return F.regexp_replace(name, r"^(.+)\.[^.]*$", "$1")


def python_title(text) -> Column:
    """``str.title()``: each letter run gets an upper first letter, rest lower."""
    runs = F.regexp_extract_all(_c(text), F.lit(r"(\p{L}+|[^\p{L}]+)"), 1)
    return F.array_join(F.transform(runs, lambda r: F.when(
        r.rlike(r"^\p{L}"),
        F.concat(F.upper(r.substr(1, 1)), F.lower(r.substr(F.lit(2), F.length(r))))).otherwise(r)), "")


# --------------------------------------------------------------------------- headings
def heading_list(content) -> Column:
    """All heading texts of a document in order, duplicates kept (P5).

    Lines are stripped first, so an indented ``#`` still counts; ``##X`` counts.
    """
    lines = F.transform(F.split(_c(content), "\n", -1), py_strip)
    heads = F.filter(lines, lambda ln: ln.startswith("#"))
    texts = F.transform(heads, lambda ln: py_strip(F.regexp_replace(ln, "^#+", "")))
    return F.filter(texts, lambda t: t != F.lit(""))


def title_of(headings, file_path) -> Column:
    """First heading, else the file stem with ``_`` -> space, title-cased."""
    fallback = python_title(F.replace(file_stem(file_path), F.lit("_"), F.lit(" ")))
    return F.coalesce(F.try_element_at(_c(headings), F.lit(1)), fallback)


# --------------------------------------------------------------------------- code
def _java_code_patterns() -> list[str]:
    # Python `\s` is Unicode whitespace and `$`/`.` only know `\n`: spell that out
    # for Java with an explicit class and UNIX_LINES.
    out = []
    for pat in C.CODE_PATTERNS_PY:
        out.append("(?mdU)" + pat.replace(r"\s{4,}", C.JAVA_WS_CLASS + "{4,}"))
    return out


JAVA_CODE_PATTERNS = _java_code_patterns()


def code_chars(text) -> Column:
    """Length of the matches of the three code patterns, joined with one space
    inside a pattern and nothing between patterns.  The two backtick patterns
    are only run on texts that contain a backtick (they cannot match otherwise)."""
    t = _c(text)

    def chars_of(pat):
        return let(F.regexp_extract_all(t, F.lit(pat), 0), lambda matches: (
            F.aggregate(matches, F.lit(0), lambda acc, m: acc + F.length(m)) + F.greatest(F.size(matches) - 1, F.lit(0))))
    fenced, inline, indented = (chars_of(p) for p in JAVA_CODE_PATTERNS)
    ticks = F.when(t.contains("`"), fenced + inline).otherwise(F.lit(0))
    return ticks + indented


def has_code(text) -> Column:
    """Code share above 20 % or more than 100 code characters."""
    t = _c(text)
    return let(code_chars(t), lambda cc: (
        F.when(F.length(t) > 0, cc / F.length(t)).otherwise(F.lit(0.0)) > C.CODE_RATIO)
        | (cc > C.CODE_CHARS))


# --------------------------------------------------------------------------- ids
def chunk_id_of(full_path, chunk_index, raw_chunk) -> Column:
    """md5 of ``{path}_{index}_{first 100 chars of the unstripped chunk}``."""
    return F.md5(F.concat_ws("_", _c(full_path), _c(chunk_index).cast("string"),
                             F.substring(_c(raw_chunk), 1, C.CHUNK_ID_PREFIX_CHARS)))


def full_path_of(file_path, root: str = C.SOURCE_ROOT) -> Column:
    """Path under the source root, as used in chunk ids (Q8)."""
    return F.concat(F.lit(root.rstrip("/") + "/"), _c(file_path))
