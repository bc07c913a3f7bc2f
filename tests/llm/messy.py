"""Rows that every operator must survive: nulls, empty and long texts, ties, repeats, extra columns."""

LONG = "one two three. " * 15000
TEXTS = [None, "", " \n\t ", "word", "word", "a b c d", "Straße 漢字 𝄞𝄞 é", LONG, LONG + "end",
         "The same line.\nThe same line.\nThe same line.", "x", "x", "tabs\tand  spaces \n\n end "]


def rows():
    base = [(i, t, ("en", None, "de")[i % 3], (None, "b", "a")[i % 3], None if i % 4 else len(t or ""), "extra", i, -1.0)
            for i, t in enumerate(TEXTS)]
    return base + [base[3], base[7], (None, "no id", "en", "a", 5, "extra", 1, 0.0), (None, None, None, None, None, None, None, None)]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, size long, target double"


def frame(spark, empty=False):
    return spark.createDataFrame([] if empty else rows(), SCHEMA)
