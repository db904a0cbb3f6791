import pytest
from pyspark.sql import functions as F


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


BASE = "One fish, two fish; the red fish and the blue fish went down to the river to see the boats go by on a summer day."


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and very long texts, ties and repeated rows, extra columns with clashing names."""
    rows = [
        (1, BASE, "en"),
        (2, BASE, None),
        (2, BASE, None),
        (2, BASE + " And then it rained for a week without an end.", "en"),
        (3, None, "en"),
        (None, "A text without an id. " + BASE, "en"),
        (4, "", "fr"),
        (5, "   \n\t ", "fr"),
        (6, "x", "fr"),
        (7, "été à la plage 🙂 " * 4, "fr"),
        (8, "0123456789" * 12_000, None),
        (9, (BASE + "\n") * 900, "en"),
        (10, "\x00\x01 nul\x00 " + BASE[::-1], "en"),
        (11, "?!... 12 34", "en"),
        (12, BASE[:49], "en"),
        (13, BASE[:50], "en"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for name in ("n_tokens", "ids", "secrets", "score", "key", "nodes", "items", "n_words", "told", "covers", "fp", "label", "cid"):
        df = df.withColumn(name, F.lit("clash"))
    return df


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
