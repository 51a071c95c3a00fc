import random

import pytest
from pyspark.sql import functions as F

TEXTS = [
    None, "", " \n\t ", "\n", "a", "ÄÖ ü é 中文 ÀÀ", "word " * 3000, "x" * 70000, "The same long line that stands in many of the documents here.\nother", "one two three four five six seven eight nine ten eleven twelve",
    "0123456789 !!! ??? ---", "tab\tseparated\x0bvalues\x0cand\rmore   spaces\n\n\nlines", "1diot and ѕtupid trash", "<p>not html", "<|endoftext|> in a text <|endoftext|>",
]


#: Names that the operators and stages use inside when they are free.
CLASHING = ("__leak_row", "__join_rid", "__toxicity", "__lines_id", "__lines_kept", "__lines_runs")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, and columns whose names the operators use inside."""
    r = random.Random(0)
    rows = []
    for i, t in enumerate(TEXTS * 3):
        rows.append((None if i % 17 == 3 else r.randint(0, 25), t, r.choice(["en", "de", None]), r.choice(["s", None]), None, r.random(), "x"))
    rows += rows[:6] + [rows[8]] * 3
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, version string").withColumns({c: F.lit("own") for c in CLASHING}).repartition(3)


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
