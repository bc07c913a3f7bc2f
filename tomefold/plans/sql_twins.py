"""DuckDB SQL twins of the native column functions.

Used only to write the oracle SQL for each registered query (the driver runs it
in DuckDB next to the Spark query).  The structure mirrors
``functions/text.py`` and ``operators/chunk.py`` expression by expression.
"""

from __future__ import annotations

import itertools

from .. import constants as C

_ids = itertools.count()


def _v(prefix: str = "v") -> str:
    return f"{prefix}{next(_ids)}"


def lit(s: str) -> str:
    """A DuckDB string literal; control and whitespace chars go through chr()."""
    parts, buf = [], []
    for ch in s:
        if ch.isspace() or ord(ch) < 32:
            if buf:
                parts.append("'" + "".join(buf).replace("'", "''") + "'")
                buf = []
            parts.append(f"chr({ord(ch)})")
        else:
            buf.append(ch)
    if buf or not parts:
        parts.append("'" + "".join(buf).replace("'", "''") + "'")
    return "(" + " || ".join(parts) + ")"


def let(value: str, body) -> str:
    v = _v("l")
    return f"list_transform([{value}], lambda {v}: {body(v)})[1]"


def tok(x: str) -> str:
    return f"len(regexp_extract_all({x}, '{C.WORD_PATTERN}'))"


def strip(x: str) -> str:
    return f"trim({x}, {lit(C.PY_WHITESPACE)})"


def is_blank(x: str) -> str:
    return f"({strip(x)} = '')"


def overlap(x: str, n: int) -> str:
    return (f"(CASE WHEN {tok(x)} <= {n} THEN {x} ELSE array_to_string("
            f"regexp_extract_all({x}, '{C.WORD_PIECE_PATTERN}')[-{n}:], '') END)")


def tok_bounded(x: str) -> str:
    return f"len(regexp_extract_all({x}, '{C.BOUNDED_PATTERN}'))"


def overlap_bounded(x: str, n: int) -> str:
    return (f"(CASE WHEN {tok_bounded(x)} <= {n} THEN {x} ELSE array_to_string("
            f"regexp_extract_all({x}, '{C.BOUNDED_PIECE_PATTERN}')[-{n}:], '') END)")


def section(fp: str) -> str:
    return f"split_part({fp}, '/', 1)"


def content_type(fp: str) -> str:
    low = f"lower({fp})"
    whens = []
    for label, terms in C.CONTENT_TYPE_RULES:
        cond = " OR ".join(f"contains({low}, '{t}')" for t in terms)
        whens.append(f"WHEN {cond} THEN '{label}'")
    return f"(CASE {' '.join(whens)} ELSE '{C.DEFAULT_CONTENT_TYPE}' END)"


def doc_url(fp: str) -> str:
    return f"('/' || replace({fp}, '.md', '.html'))"


def heading_list(content: str) -> str:
    a, b, c, d = _v(), _v(), _v(), _v()
    lines = f"list_transform(string_split({content}, chr(10)), lambda {a}: {strip(a)})"
    heads = f"list_filter({lines}, lambda {b}: starts_with({b}, '#'))"
    texts = f"list_transform({heads}, lambda {c}: {strip(f'ltrim({c}, {lit(chr(35))})')})"
    return f"list_filter({texts}, lambda {d}: {d} <> '')"


def title(headings: str, fp: str) -> str:
    r = _v()
    name = f"string_split({fp}, '/')[-1]"
    stem = f"regexp_replace({name}, '^(.+)\\.[^.]*$', '\\1')"
    spaced = f"replace({stem}, '_', ' ')"
    runs = f"regexp_extract_all({spaced}, '(\\p{{L}}+|[^\\p{{L}}]+)', 1)"
    cased = (f"array_to_string(list_transform({runs}, lambda {r}: CASE WHEN regexp_matches({r}, '^\\p{{L}}') "
             f"THEN upper(substr({r}, 1, 1)) || lower(substr({r}, 2)) ELSE {r} END), '')")
    return f"coalesce({headings}[1], {cased})"


def _re2_code_patterns() -> list[str]:
    return ["(?m)" + p.replace(r"\s{4,}", C.WS_CLASS + "{4,}") for p in C.CODE_PATTERNS_PY]


def has_code(x: str) -> str:
    terms = []
    for pat in _re2_code_patterns():
        m, e = _v(), _v()
        terms.append(let(f"regexp_extract_all({x}, '{pat}')", lambda mm, e=e: (
            f"coalesce(list_sum(list_transform({mm}, lambda {e}: length({e}))), 0)"
            f" + greatest(len({mm}) - 1, 0)")))
    cc = " + ".join(f"({t})" for t in terms)
    return let(cc, lambda c: (f"((CASE WHEN length({x}) > 0 THEN {c} / length({x}) ELSE 0.0 END) > {C.CODE_RATIO}"
                              f" OR {c} > {C.CODE_CHARS})"))


def chunk_id(full_path: str, idx: str, raw: str) -> str:
    return f"md5({full_path} || '_' || CAST({idx} AS VARCHAR) || '_' || substr({raw}, 1, {C.CHUNK_ID_PREFIX_CHARS}))"


def split_by_headers(content: str) -> str:
    return f"string_split(replace({content}, chr(10) || '#', chr(10) || chr(1) || '#'), chr(10) || chr(1))"


def merge_small(sections_expr: str, min_tokens: int = C.MIN_SECTION_TOKENS) -> str:
    return let(sections_expr, lambda s: _merge_small(s, min_tokens))


def _merge_small(sections: str, min_tokens: int) -> str:
    acc, x, i = _v("acc"), _v("x"), _v("i")

    def decide(cur):
        return (f"CASE WHEN {tok(cur)} < {min_tokens} AND {i} < len({sections}) "
                f"THEN {{'done': {acc}.done, 'buf': {cur}}} "
                f"ELSE {{'done': list_append({acc}.done, {cur}), 'buf': NULL::VARCHAR}} END")
    cur = f"(CASE WHEN {acc}.buf IS NULL THEN {x} ELSE {acc}.buf || chr(10) || chr(10) || {x} END)"
    body = let(cur, decide)
    return (f"list_reduce({sections}, lambda {acc}, {x}, {i}: {body}, "
            f"{{'done': []::VARCHAR[], 'buf': NULL::VARCHAR}}).done")


def _halve(cur: str, max_t: int) -> str:
    def body(s):
        acc, r = _v("acc"), _v("r")
        m = f"len({s})"
        left = f"({m} - {acc}.b)"
        rest = f"array_to_string(list_slice({s}, {acc}.b + 1, {m}), '. ')"
        k = f"({left} // 2)"
        cut = f"array_to_string(list_slice({s}, {acc}.b + 1, {acc}.b + {k}), '. ') || '.'"
        step = (f"CASE WHEN {acc}.stop OR {left} <= 1 OR {tok(rest)} <= {max_t} "
                f"THEN {{'out': {acc}.out, 'b': {acc}.b, 'stop': true}} "
                f"ELSE {{'out': list_append({acc}.out, {cut}), 'b': {acc}.b + {k}, 'stop': false}} END")
        rounds = f"range(1, CAST(ceil(log2({m})) AS INTEGER) + 2)"
        red = (f"list_reduce({rounds}, lambda {acc}, {r}: {step}, "
               f"{{'out': []::VARCHAR[], 'b': 0, 'stop': false}})")
        return let(red, lambda h: (f"{{'out': {h}.out, 'rest': array_to_string("
                                   f"list_slice({s}, {h}.b + 1, {m}), '. ')}}"))
    return let(f"string_split({cur}, '. ')", body)


def split_large(sec: str, max_t: int = C.TARGET_CHUNK_TOKENS, ov: int = C.OVERLAP_TOKENS) -> str:
    acc, para = _v("acc"), _v("p")
    has_cur = f"({acc}.cur <> '')"

    def with_test(t):
        start = f"(CASE WHEN {has_cur} THEN {overlap(acc + '.cur', ov)} || chr(10) || chr(10) || {para} ELSE {para} END)"
        done = f"(CASE WHEN {has_cur} THEN list_append({acc}.done, {acc}.cur) ELSE {acc}.done END)"
        over = let(_halve(start, max_t), lambda h: f"{{'done': list_concat({done}, {h}.out), 'cur': {h}.rest}}")
        return (f"CASE WHEN {tok(t)} <= {max_t} THEN {{'done': {acc}.done, 'cur': {t}}} "
                f"ELSE {over} END")
    test = f"(CASE WHEN {has_cur} THEN {acc}.cur || chr(10) || chr(10) || {para} ELSE {para} END)"
    step = let(test, with_test)
    packed = let(f"list_reduce(string_split({sec}, chr(10) || chr(10)), lambda {acc}, {para}: {step}, "
                 f"{{'done': []::VARCHAR[], 'cur': ''}})",
                 lambda res: f"CASE WHEN {res}.cur <> '' THEN list_append({res}.done, {res}.cur) ELSE {res}.done END")
    return f"(CASE WHEN {tok(sec)} <= {max_t} THEN [{sec}] ELSE {packed} END)"


def chunk_texts(content: str, max_t: int = C.TARGET_CHUNK_TOKENS, ov: int = C.OVERLAP_TOKENS,
                min_t: int = C.MIN_SECTION_TOKENS) -> str:
    s, p = _v("s"), _v("p")
    merged = merge_small(split_by_headers(content), min_t)
    pieces = f"flatten(list_transform({merged}, lambda {s}: {split_large(s, max_t, ov)}))"
    return f"list_filter({pieces}, lambda {p}: NOT {is_blank(p)})"


def full_path(fp: str, root: str = C.SOURCE_ROOT) -> str:
    return f"('{root.rstrip('/')}/' || {fp})"
