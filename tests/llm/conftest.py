import pytest

#: Rows that every operator on documents must bear.
ODD = [
    (1, None, None), (2, "", "en"), (3, "a", None), (4, "same text twice", "en"), (5, "same text twice", "en"), (5, "same text twice", "en"),
    (6, "é中 \x00\t\r\n ' 's 'll <s></s> ▁", "fr"), (7, "word " * 30000, "en"), (8, "x" * 70000, "de"), (9, "\n", "es"), (10, "  two  spaces ", "es"), (11, "1234 5678!", None),
]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string, lang string").selectExpr("*", "'s' AS source", "length(text) AS n_chars", "1 AS n_tokens", "'x' AS media", "2 AS token")


@pytest.fixture(scope="session")
def empty(odd):
    return odd.filter("false")


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
