import hashlib

import pytest
from pyspark.sql import functions as F

from tomefold.functions import text as T


def one(spark, expr, value, typ="string"):
    return spark.createDataFrame([(value,)], f"x {typ}").select(expr(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize("path,section,ctype", [
    ("kitchen/ovens/steam.md", "kitchen", "reference"),
    ("Tutorial-Week2/bread.md", "Tutorial-Week2", "tutorial"),
    ("garden/my_examples/roses.md", "garden", "example"),
    ("tools/api-notes.md", "tools", "api"),
    ("readme.md", "readme.md", "reference"),
    ("a/b/c/d/e.md", "a", "reference"),
    ("api/tutorial/example.md", "api", "tutorial"),
])
def test_path_metadata(spark, path, section, ctype):
    rel = one(spark, lambda c: T.relative_path(c, "/srv/out/md"), "/srv/out/md/" + path)
    assert rel == path
    assert one(spark, T.section_of, rel) == section
    assert one(spark, T.content_type_of, rel) == ctype


@pytest.mark.parametrize("content,expected", [
    ("# Soup\nwater\n## Leek\n#### Cut\nthin\n## Leek\n", ["Soup", "Leek", "Cut", "Leek"]),
    ("water, salt and nothing else", []),
    ("# Use `salt`\n## A *pinch* of [it](salt.html)\n", ["Use `salt`", "A *pinch* of [it](salt.html)"]),
    ("#Tight\n######  wide  \n", ["Tight", "wide"]),
    ("   # indented\n#\n##   \ntext # not a heading", ["indented"]),
])
def test_headings(spark, content, expected):
    assert one(spark, T.heading_list, content) == expected


def test_title_and_url(spark):
    df = spark.createDataFrame([(["A", "B"], "x/y.md"), ([], "oven/steam_oven.md"), ([], "a/abc1def_x.md")],
                               "h array<string>, p string")
    got = df.select(T.title_of("h", "p").alias("t"), T.doc_url_of("p").alias("u")).collect()
    assert [r.t for r in got] == ["A", "Steam Oven", "abc1def_x".replace("_", " ").title()]
    assert one(spark, T.doc_url_of, "a.md/b.md") == "/a.html/b.html"


def test_has_code(spark):
    fenced = "# T\n\n```python\nimport x\nprint(x)\n```\n"
    heavy = "# H\n\n```python\n" + "x = 1\n" * 30 + "```\n\n```dart\nvoid main() {}\n```\n"
    assert one(spark, T.has_code, fenced) is True
    assert one(spark, T.has_code, "Plain words only, nothing else here at all.") is False
    assert one(spark, T.has_code, heavy) is True
    assert one(spark, T.has_code, "") is False


def test_chunk_id_formula(spark):
    df = spark.createDataFrame([("out/md/a/b.md", 3, "x" * 150)], "p string, i int, c string")
    got = df.select(T.chunk_id_of("p", "i", "c").alias("id")).first().id
    assert got == hashlib.md5(f"out/md/a/b.md_3_{'x' * 100}".encode()).hexdigest()


def test_tokens_and_overlap(spark):
    text = "one two  three\nfour five six seven eight nine ten"
    assert one(spark, T.token_count, text) == len(text.split())
    tail = one(spark, lambda c: T.overlap_tail(c, 5), text)
    assert text.endswith(tail) and len(tail.split()) == 5
    assert one(spark, lambda c: T.overlap_tail(c, 50), text) == text


def test_strip_matches_python(spark):
    s = "　\t x y \x1c\n"
    assert one(spark, T.py_strip, s) == s.strip()


def test_java_and_re2_whitespace_classes_equal_python(spark, duck):
    from tomefold import constants as C
    chars = "".join(chr(i) for i in range(1, 0x3001) if not 0xD800 <= i <= 0xDFFF)
    py = "".join(ch for ch in chars if ch.isspace())
    df = spark.createDataFrame([(chars,)], "s string")
    java = df.select(F.array_join(F.regexp_extract_all("s", F.lit("(?U)" + C.JAVA_WS_CLASS), 0), "").alias("w")).first().w
    assert java == py
    re2 = duck.execute(f"SELECT array_to_string(regexp_extract_all(?, '{C.WS_CLASS}'), '')", [chars]).fetchone()[0]
    assert re2 == py
