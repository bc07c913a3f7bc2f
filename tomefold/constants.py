"""Fixed values that results depend on.

Everything in the "fixed values" blocks must stay equal to the behaviour being
matched (chunk sizes, thresholds, term lists, patterns).  Everything else in the
package is derived from these.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# fixed values: chunking (tokens)
# ---------------------------------------------------------------------------
TARGET_CHUNK_TOKENS = 900
OVERLAP_TOKENS = 175
MIN_SECTION_TOKENS = 100
CHUNK_ID_PREFIX_CHARS = 100

# ---------------------------------------------------------------------------
# fixed values: ingest defaults
# ---------------------------------------------------------------------------
DEFAULT_VERSION = "1.29.0"
SOURCE_ROOT = "_build/markdown"
EMBED_DIM = 64  # driver vectors have 64 dims; the hashed embedder uses the same

# ---------------------------------------------------------------------------
# fixed values: content type from path (first match wins, default last)
# ---------------------------------------------------------------------------
CONTENT_TYPE_RULES = [
    ("tutorial", ["tutorial"]),
    ("example", ["example"]),
    ("api", ["api", "reference"]),
]
DEFAULT_CONTENT_TYPE = "reference"

# ---------------------------------------------------------------------------
# fixed values: code detection patterns (Python `re` syntax, MULTILINE)
# ---------------------------------------------------------------------------
CODE_PATTERNS_PY = [
    r"```[\s\S]*?```",   # fenced blocks
    r"`[^`\n]+`",        # inline code
    r"^\s{4,}.*$",       # indented lines
]
CODE_RATIO = 0.2
CODE_CHARS = 100

# ---------------------------------------------------------------------------
# fixed values: search
# ---------------------------------------------------------------------------
SEARCH_LIMIT = 5
SEARCH_MIN_SCORE = 0.4
CANDIDATE_CAP = 30          # candidates = min(limit * 2, 30)
CANDIDATE_FLOOR = 0.2       # candidate threshold = max(min_score - 0.1, 0.2)
CANDIDATE_MARGIN = 0.1
FALLBACK_K = 5
FALLBACK_MIN_SCORE = 0.1
SCORE_DIGITS = 3

# rerank rules: term lists and weights
TYPE_TERMS = ["tutorial", "guide", "example"]
TYPE_BOOST = 0.1
TITLE_TERM_BOOST = 0.15
HEADING_TERM_BOOST = 0.1
CODE_QUERY_PHRASES = ["how to", "example", "implement", "create", "build", "code", "method"]
CODE_BOOST = 0.1
UI_QUERY_TERMS = ["ui", "menu", "screen", "overlay", "widget", "button", "navigation"]
UI_CONTENT_TERMS = ["overlay", "widget", "menu", "screen", "ui"]
UI_BOOST = 0.2

NO_RESULTS_TITLE = "No Results"
NO_RESULTS_SECTION = "search"
NO_RESULTS_TYPE = "system"
NO_RESULTS_TEXT = (
    "No relevant documentation found for query: '{query}'. Try using different "
    "terms or check if the documentation has been processed."
)
ERROR_TITLE = "Search Error"
ERROR_SECTION = "error"
ERROR_TYPE = "error"
UNKNOWN_VERSION = "unknown"

# ---------------------------------------------------------------------------
# fixed values: embedding retries
# ---------------------------------------------------------------------------
MAX_RETRIES = 3
BASE_DELAY_S = 1.0
BATCH_DELAY_S = 0.1
RETRYABLE_MARKERS = ["429", "rate limit"]

# ---------------------------------------------------------------------------
# fixed values: cl100k_base pre-tokenizer split pattern (public), Java syntax
# ---------------------------------------------------------------------------
PRETOKEN_PATTERN = (r"(?U)(?i:'s|'t|'re|'ve|'m|'ll|'d)|[^\r\n\p{L}\p{N}]?\p{L}+|\p{N}{1,3}"
                    r"| ?[^\s\p{L}\p{N}]+[\r\n]*|\s*[\r\n]+|\s+(?!\S)|\s+")

# ---------------------------------------------------------------------------
# Bounded pieces: an estimate of BPE tokens that grows with a text's length in every
# script.  A letter of a script without spaces is a token, other letter runs are cut
# every PIECE_LETTERS letters, numbers every 3 digits, other marks every 4.
# ---------------------------------------------------------------------------
PIECE_LETTERS = 12
UNSPACED_SCRIPTS = ["Han", "Hiragana", "Katakana", "Thai", "Lao", "Khmer"]


# ---------------------------------------------------------------------------
# Derived: Python's notion of whitespace (str.isspace / str.split / str.strip),
# written as a regex class that Java and RE2 both read the same way.
# ---------------------------------------------------------------------------
PY_WHITESPACE = "".join(ch for ch in map(chr, range(0x3001)) if ch.isspace())


def _regex_class(chars: str, negate: bool = False) -> str:
    body = "".join("\\x{%X}" % ord(c) for c in chars)
    return ("[^" if negate else "[") + body + "]"


def bounded_pattern(script: str, white_space: str) -> str:
    """The bounded-piece token; ``script`` formats a script name, ``white_space`` lists white space."""
    unspaced = "".join(script.format(s) for s in UNSPACED_SCRIPTS)
    return (f"[{unspaced}]|[\\p{{L}}\\p{{M}}]{{1,{PIECE_LETTERS}}}|\\p{{N}}{{1,3}}"
            f"|[^{white_space}\\p{{L}}\\p{{M}}\\p{{N}}]{{1,4}}")


# RE2 (DuckDB) spelling: every whitespace char listed
WS_CLASS = _regex_class(PY_WHITESPACE)
NON_WS_CLASS = _regex_class(PY_WHITESPACE, negate=True)
# one "word" token = a maximal run of non-whitespace (= len(text.split()))
WORD_PATTERN = NON_WS_CLASS + "+"
# lossless word pieces: leading whitespace + word, trailing whitespace glued to the
# last piece; concatenating all pieces of a text with >= 1 word gives the text back
# minus its leading whitespace
WORD_PIECE_PATTERN = WS_CLASS + "*" + NON_WS_CLASS + "+(?:" + WS_CLASS + "+\\z)?"

BOUNDED_PATTERN = bounded_pattern("\\p{{{}}}", WS_CLASS[1:-1])
BOUNDED_PIECE_PATTERN = WS_CLASS + "*(?:" + BOUNDED_PATTERN + ")(?:" + WS_CLASS + "+\\z)?"

# Java spelling of the same sets (Spark side): with UNICODE_CHARACTER_CLASS, ``\s``
# is the White_Space property, which is Python's whitespace minus U+001C..U+001F.
# One property test per char is several times faster than the listed class.
JAVA_WS_CLASS = r"[\s\x{1C}-\x{1F}]"
JAVA_NON_WS_CLASS = r"[^\s\x{1C}-\x{1F}]"
JAVA_WORD_PATTERN = "(?U)" + JAVA_NON_WS_CLASS + "+"
JAVA_WORD_PIECE_PATTERN = ("(?U)" + JAVA_WS_CLASS + "*" + JAVA_NON_WS_CLASS + "+(?:"
                           + JAVA_WS_CLASS + "+\\z)?")
JAVA_BOUNDED_PATTERN = "(?U)" + bounded_pattern("\\p{{Is{}}}", r"\s\x{1C}-\x{1F}")
JAVA_BOUNDED_PIECE_PATTERN = ("(?U)" + JAVA_WS_CLASS + "*(?:" + JAVA_BOUNDED_PATTERN[4:] + ")(?:"
                              + JAVA_WS_CLASS + "+\\z)?")
