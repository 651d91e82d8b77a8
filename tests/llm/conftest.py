import pytest
from pyspark.sql import Row

LONG = " ".join(f"word{i % 977}x{i}" for i in range(30_000))


@pytest.fixture(scope="session")
def nasty(spark):
    """Nulls, empty and blank texts, a long one, repeated rows, ties, and columns with names that operators use."""
    texts = [
        (1, "Hello there, this is one text of seven words", "en", "a"),
        (2, "HELLO there, this is one text of seven words", "en", "a"),
        (3, None, None, None),
        (4, "", "de", "b"),
        (5, "   \n\t ", "de", "b"),
        (6, "12 34 !!", "fr", None),
        (7, LONG, "en", "c"),
        (8, LONG + " end", "en", "c"),
        (9, "eins zwei", "de", "c"),
        (9, "eins zwei", "de", "c"),
        (None, "a text without an id", "en", "a"),
        (None, None, None, None),
        (10, "Ünïcode ÀÉ straße 日本語 text", "fr", "b"),
        (11, "released under the MIT License", "en", "b"),
    ]
    rows = [Row(doc_id=i, text=t, lang=g, source=s, n_chars=len(t or ""), key=7, rep=1, size=5, _id=3, _norm="x") for i, t, g, s in texts]
    schema = "doc_id long, text string, lang string, source string, n_chars long, key long, rep long, size long, _id long, _norm string"
    return spark.createDataFrame(rows, schema).repartition(3)


@pytest.fixture(scope="session")
def empty(nasty):
    return nasty.limit(0)


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
