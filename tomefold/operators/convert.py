"""HTML pages to markdown (T0, F9, D13) as a Spark job.

Spark has no HTML parser, so each page goes through a small stdlib
``html.parser`` walker inside ``mapInArrow`` (slices of Arrow batches, one pass
per page, no shuffle).  The main-content selector is a parameter: the default is a
``div`` with class ``document`` and ``role="main"``; pages without it fall back
to the whole page (``used_fallback``).  A page that fails to convert yields a
row with ``error`` set instead of failing the job.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as TY


@dataclass(frozen=True)
class MainSelector:
    tag: str = "div"
    classes: tuple[str, ...] = ("document",)
    attrs: tuple[tuple[str, str], ...] = (("role", "main"),)

    def matches(self, tag: str, attrs: dict[str, str | None]) -> bool:
        if tag != self.tag:
            return False
        have = set((attrs.get("class") or "").split())
        if not set(self.classes) <= have:
            return False
        return all(attrs.get(k) == v for k, v in self.attrs)


DEFAULT_SELECTOR = MainSelector()
ARTICLE_SELECTOR = MainSelector(tag="article", classes=(), attrs=())

_SKIP = {"script", "style", "head", "title", "noscript", "template"}
# tags that may stand inside ``head``; any other start tag begins the body, as in browsers
_IN_HEAD = {"title", "meta", "link", "base", "script", "style", "noscript", "template", "html", "head"}
_BLOCK = {"p", "div", "section", "article", "header", "footer", "nav", "main", "aside",
          "table", "tr", "blockquote", "ul", "ol", "dl", "form", "figure"}
_VOID = {"br", "img", "hr", "meta", "link", "input", "area", "base", "col", "embed", "source", "track", "wbr"}


class _Events(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.events: list[tuple] = []

    def handle_starttag(self, tag, attrs):
        self.events.append(("start", tag, dict(attrs)))
        if tag in _VOID:
            self.events.append(("end", tag, {}))

    def handle_startendtag(self, tag, attrs):
        self.events.append(("start", tag, dict(attrs)))
        self.events.append(("end", tag, {}))

    def handle_endtag(self, tag):
        if tag not in _VOID:
            self.events.append(("end", tag, {}))

    def handle_data(self, data):
        self.events.append(("data", data, {}))


def _select(events, selector: MainSelector):
    """Events of the first element matching the selector, or None."""
    for i, (kind, tag, attrs) in enumerate(events):
        if kind == "start" and selector.matches(tag, attrs):
            depth = 0
            for j in range(i, len(events)):
                k2, t2, _ = events[j]
                if t2 == tag and k2 == "start":
                    depth += 1
                elif t2 == tag and k2 == "end":
                    depth -= 1
                    if depth == 0:
                        return events[i:j + 1]
            return events[i:]
    return None


def _render(events, heading_style: str = "atx") -> str:
    out: list[str] = []
    hidden: list[str] = []  # open tags whose text is not shown, outermost first
    pre = 0
    links: list[tuple[str, int]] = []
    lists: list[list] = []
    row_open = False  # the table row has a cell already
    for kind, tag, attrs in events:
        if kind == "start":
            if hidden == ["head"] and tag not in _IN_HEAD:
                hidden.clear()  # the end tag of head may be left out
            if tag == "body":
                hidden.clear()
            if tag in _SKIP:
                hidden.append(tag)
            if hidden:
                continue
            if tag in ("tr", "table"):
                row_open = False
            if re.fullmatch(r"h[1-6]", tag):
                if heading_style == "underlined" and tag in ("h1", "h2"):
                    out.append("\n\n\x02")
                else:
                    out.append("\n\n" + "#" * int(tag[1]) + " ")
            elif tag in _BLOCK:
                out.append("\n\n")
                if tag in ("ul", "ol"):
                    lists.append([tag, 0])
            elif tag == "li":
                if lists:
                    lists[-1][1] += 1
                marker = f"{lists[-1][1]}. " if lists and lists[-1][0] == "ol" else "* "
                out.append("\n" + "  " * max(0, len(lists) - 1) + marker)
            elif tag == "br":
                out.append("  \n")
            elif tag in ("td", "th"):
                out.append(" | " if row_open else "")
                row_open = True
            elif tag == "img" and (attrs.get("alt") or "").strip():
                out.append(f"![{attrs['alt'].strip()}]({attrs.get('src') or ''})")
            elif tag == "pre":
                pre += 1
                out.append("\n\n```\n")
            elif tag == "code" and not pre:
                out.append("`")
            elif tag in ("b", "strong"):
                out.append("**")
            elif tag in ("i", "em"):
                out.append("*")
            elif tag == "a" and attrs.get("href") is not None:
                links.append((attrs.get("href") or "", len(out)))
                out.append("[")
        elif kind == "end":
            if tag in _SKIP:
                if tag in hidden:
                    del hidden[hidden.index(tag):]
                continue
            if hidden:
                continue
            if tag == "tr":
                row_open = False
            if heading_style == "underlined" and tag in ("h1", "h2"):
                out.append("\x03" + tag[1] + "\n\n")
            elif re.fullmatch(r"h[1-6]", tag) or tag in _BLOCK:
                out.append("\n\n")
                if tag in ("ul", "ol") and lists:
                    lists.pop()
            elif tag == "pre":
                pre = max(0, pre - 1)
                out.append("\n```\n\n")
            elif tag == "code" and not pre:
                out.append("`")
            elif tag in ("b", "strong"):
                out.append("**")
            elif tag in ("i", "em"):
                out.append("*")
            elif tag == "a" and links:
                href, _ = links.pop()
                out.append(f"]({href})")
        elif not hidden:
            out.append(tag if pre else re.sub(r"\s+", " ", tag))
    md = "".join(out)
    # setext headings: the text underlined with = (h1) or - (h2)
    md = re.sub(r"\x02\s*(.*?)\s*\x03([12])", lambda m: m.group(1) + "\n" + ("=" if m.group(2) == "1" else "-")
                * max(len(m.group(1)), 3), md, flags=re.S)
    # headings are one line; blank-line runs collapse to one blank line
    md = re.sub(r"(?m)^(#{1,6} )[ \t]+", r"\1", md)
    md = re.sub(r"[ \t]+\n", lambda m: "  \n" if m.group(0).startswith("  ") else "\n", md)
    md = re.sub(r"\n{3,}", "\n\n", md)
    return md.strip() + "\n"


def html_to_markdown(html: str, selector: MainSelector = DEFAULT_SELECTOR,
                     heading_style: str = "atx") -> tuple[str, bool]:
    """Markdown of the selected element (or the whole page) and whether the
    fallback was used.  ``heading_style="underlined"`` writes h1/h2 as setext
    headings (Q18), which the ``#`` splitter does not see."""
    p = _Events()
    p.feed(html)
    p.close()
    main = _select(p.events, selector)
    if main is None:
        return _render(p.events, heading_style), True
    return _render(main, heading_style), False


PAGES_AT_ONCE = 64

_OUT = TY.StructType([
    TY.StructField("page_id", TY.LongType()),
    TY.StructField("file_path", TY.StringType()),
    TY.StructField("markdown", TY.StringType()),
    TY.StructField("used_fallback", TY.BooleanType()),
    TY.StructField("error", TY.StringType()),
])


def pages_to_markdown(pages: DataFrame, selector: MainSelector = DEFAULT_SELECTOR,
                      heading_style: str = "atx") -> DataFrame:
    """``pages(page_id, file_path, html)`` -> ``(page_id, file_path, markdown, used_fallback, error)``."""
    def run(batches):
        for whole in batches:
            for lo in range(0, whole.num_rows, PAGES_AT_ONCE):  # bounds what a worker holds as Python objects
                batch = whole.slice(lo, PAGES_AT_ONCE)
                mds, fbs, errs = [], [], []
                for h in batch.column(2):
                    try:
                        md, fb = html_to_markdown(h.as_py() or "", selector, heading_style)
                        mds.append(md), fbs.append(fb), errs.append(None)
                    except Exception as err:  # reported per page, like the per-file catch
                        mds.append(None), fbs.append(None), errs.append(f"{type(err).__name__}: {err}")
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(mds, pa.string()), pa.array(fbs, pa.bool_()),
                     pa.array(errs, pa.string())], names=_OUT.names)
    return pages.select(F.col("page_id").cast("long"), "file_path", "html").mapInArrow(run, _OUT)


def markdown_docs(converted: DataFrame, version: str) -> DataFrame:
    """Converted pages as a docs frame ``(version, file_path, content)``; failures dropped."""
    return converted.filter(F.col("error").isNull()).select(
        F.lit(version).alias("version"), "file_path", F.col("markdown").alias("content"))
