from pyspark.sql import functions as F

from tomefold.functions import text as T
from tomefold.operators import chunk as CH
from tomefold.operators import convert as CV
from tomefold.operators import embed as EM


def test_paragraphs_are_counted_once(spark):
    # the paragraphs and the sentences of the two halvings; nothing measures a growing chunk
    for counter in T.ADDITIVE:
        text = str(CH.split_large_section("t", CH.ChunkParams(counter=counter))._jc.toString())
        assert text.count("regexp_count") == 3


def test_running_counts_cut_like_measured_ones(spark):
    body = "\n\n".join(f"One {n} two, three. Four\tfive . six漢字 " + "word " * (n % 37) + "x. y. z" * (n % 5) for n in range(60))
    df = spark.createDataFrame([(body,), ("a. b. c " * 300,), (" \n\n ",), ("short",), ("w " * 95 + "\n\n\n\n" + "v. " * 200,)], "t string")
    for counter in T.ADDITIVE:
        p = CH.ChunkParams(target_tokens=40, overlap_tokens=9, counter=counter)
        summed = df.select(CH.split_large_section("t", p).alias("c")).collect()
        kept, T.ADDITIVE = T.ADDITIVE, ()
        try:
            measured = df.select(CH.split_large_section("t", p).alias("c")).collect()
        finally:
            T.ADDITIVE = kept
        assert summed == measured


def test_pages_are_converted_in_slices_of_arrow_batches(spark):
    n = 3 * CV.PAGES_AT_ONCE + 5
    pages = spark.createDataFrame([(k, f"p{k}.md", f"<h1>T{k}</h1><p>x</p>" if k % 9 else None) for k in range(n)],
                                  "page_id long, file_path string, html string").coalesce(1)
    out = CV.pages_to_markdown(pages)
    assert "MapInArrow" in out._jdf.queryExecution().executedPlan().toString()
    got = {r.page_id: r.markdown for r in out.collect()}
    assert len(got) == n and got[1] == "# T1\n\nx\n" and got[0] == "\n"


def test_vectors_do_not_depend_on_the_slices(spark):
    df = spark.range(300).select(F.concat(F.lit("w"), F.col("id").cast("string"), F.lit(" and "), F.repeat(F.lit("z "), F.col("id").cast("int"))).alias("t"))
    whole = df.select(EM.hashed_vector("t", 8).alias("v")).collect()
    kept, EM.HASHES_AT_ONCE = EM.HASHES_AT_ONCE, 50
    try:
        hashes = df.select(EM.token_hashes("t").alias("h")).toArrow().column("h").combine_chunks()
        assert EM._sliced_counts(hashes, 8).to_pylist() == [r.v for r in whole]
    finally:
        EM.HASHES_AT_ONCE = kept
