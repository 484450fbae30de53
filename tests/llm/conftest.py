import duckdb
import pytest


@pytest.fixture(scope="session")
def sql(small):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return con


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, repeated rows and ids, and extra columns with clashing names."""
    long_text = "alpha beta gamma delta " * 20_000
    rows = [
        (1, "the cat sat on the mat and looked at the moon", "en", "a", 45, "x", 0.5),
        (1, "the cat sat on the mat and looked at the moon", "en", "a", 45, "x", 0.5),
        (2, None, None, None, None, None, None),
        (3, "", "en", "b", 0, None, 1.0),
        (None, " \t\n", None, "b", 3, "y", None),
        (4, long_text, "fr", None, len(long_text), "z", 2.0),
        (5, "É漢字 ½ it’s <|endoftext|> don't", "es", "c", 30, "w", 3.0),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, shard string, score double")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("1 = 0")
