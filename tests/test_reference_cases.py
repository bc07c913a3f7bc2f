"""Chunking requirements on documents written for them: fields, sizes, splits, code flags."""

from pyspark.sql import functions as F

from tomefold.functions import text as T
from tomefold.operators import chunk as CH

RECIPE = """# Onion soup

Slice, brown and simmer; `simmer` means below boiling.

## Stock

Bones, water, six hours.

## Timer

```lua
local minutes = 6 * 60
return minutes
```

### Marks

* clear
* golden

## Serving

With toast.
"""


def _docs(spark, content, path="kitchen/onion_soup.md", version="3.1"):
    return spark.createDataFrame([(version, path, content)], "version string, file_path string, content string")


def test_fields_of_every_chunk(spark):
    rows = CH.chunk_documents(_docs(spark, RECIPE)).orderBy("chunk_index").collect()
    assert [r.chunk_index for r in rows] == list(range(len(rows))) and rows
    for r in rows:
        assert r.content and r.chunk_id and (r.version, r.file_path) == ("3.1", "kitchen/onion_soup.md")
        assert (r.section, r.doc_url, r.title) == ("kitchen", "/kitchen/onion_soup.html", "Onion soup")
        assert r.heading_path == ["Onion soup", "Stock", "Timer", "Marks", "Serving"]


def test_a_short_document_is_one_chunk(spark):
    rows = CH.chunk_documents(_docs(spark, "# Toast\n\nBread, heat.")).collect()
    assert [r.content for r in rows] == ["# Toast\n\nBread, heat."]


def test_a_long_section_is_cut_to_size(spark):
    df = _docs(spark, "# Stirring\n\n" + "Stir once more, slowly. " * 400)
    assert df.select(F.size(CH.split_large_section(F.col("content"))).alias("n")).first().n > 1
    sizes = CH.chunk_documents(df).select(T.token_count("content").alias("t")).collect()
    assert all(r.t <= 900 + 175 for r in sizes)


def test_a_long_text_without_spaces_is_not_one_token(spark):
    wide = "\u6e6f" * 3000 + "x" * 3000
    n = _docs(spark, wide).select(T.token_count("content", CH.ChunkParams().counter).alias("n")).first().n
    assert n == 3000 + 250


def test_sections_start_at_headers(spark):
    secs = _docs(spark, RECIPE).select(CH.split_by_headers("content").alias("s")).first().s
    assert [s.split("\n")[0] for s in secs] == ["# Onion soup", "## Stock", "## Timer", "### Marks", "## Serving"]
    alone = _docs(spark, "No header, one line.").select(CH.split_by_headers("content").alias("s")).first().s
    assert alone == ["No header, one line."]


def test_code_flag(spark):
    df = spark.createDataFrame([("Boil:\n```lua\nboil(6)\nwait(1)\n```\nDone.",), ("Only words about soup and bread.",)], "c string")
    assert [r.h for r in df.select(T.has_code("c").alias("h")).collect()] == [True, False]
    assert CH.chunk_documents(_docs(spark, RECIPE)).filter("has_code").count() >= 1
