import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and long texts, repeated rows, ties, clashing extra columns."""
    long = " ".join(f"w{i % 997}x{i}" for i in range(30_000)) + "\n" + "end of it " * 50
    rows = [
        (1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, "   \n\t\n ", None, None, 6), (4, "one", "en", "b", 3),
        (5, "one two", "en", "b", 7), (6, long, "en", "a", len(long)), (7, "Ünïcode wörds \U0001f600 ok\nline\nline\n", "de", "é", 30),
        (8, "same text here again and again", "en", "a", 30), (9, "same text here again and again", "en", "b", 30),
        (8, "same text here again and again", "en", "a", 30), (10, "SAME text HERE again and again!", None, "c", 31),
        (None, "no id at all", "en", None, 12), (11, "x" * 5000, "en", "c", 5000), (12, "a b " * 400, "en", "c", 1600),
        (13, "\x0b\x0cone\x00two three four", "en", "\U00010000", 20), (14, "|".join("#$%") * 20, None, "￿", 60),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    extra = {c: F.lit(i) for i, c in enumerate(("size", "h", "p", "chunk", "rank", "length", "row", "key", "id", "bad", "score"))}
    return df.withColumns(extra)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
