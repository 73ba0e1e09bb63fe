"""Fixtures that the operators' tests share."""

import random

SCHEMA = "doc_id long, text string, lang string, n_words long, shard string, row int"


def words(rng, n, size=400):
    return [f"w{rng.randrange(size)}" for _ in range(n)]


def odd_documents():
    """Nulls, empty and very long texts, ties and repeated rows, with extra columns of clashing names."""
    rng = random.Random(7)
    long = " ".join(words(rng, 6000)) + "\n" + "All rights reserved.\n"
    plain = ["", " ", None, "one", "two words", "A  B\tC\nd", "É é 　 x", long, long, "same line here\nsame line here\n\nother line of text", "Other Line of TEXT \nx", "tail\n"]
    rows = [(k, t, "en", None, "x", 1) for k, t in enumerate(plain)]
    rows += [(4, "two words", "en", 1, None, None), (None, "a text without an id that is long", None, 1, "y", 2), (None, None, None, None, None, None), (90, "a text without an id that is long", "xx", 1, "y", 2)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)
