import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_of(spark):
    def make(rows, schema=DOCS):
        return spark.createDataFrame(rows, schema)

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty and very long texts, repeated rows."""
    long_text = "word%d the quick brown fox " * 3000
    return [
        (1, "the quick brown fox jumps over it", "en", "a", 33),
        (1, "the quick brown fox jumps over it", "en", "a", 33),
        (2, None, None, None, None),
        (3, "", "en", "b", 0),
        (None, "no id here at all my friend", "en", None, 5),
        (4, long_text, None, "a", len(long_text)),
        (5, " \t\n ", "de", "c", 4),
        (6, "x" * 100_000, "de", "c", 100_000),
        (7, "日本語のテキスト １２３ ½   ’s", None, "b", 20),
    ]


@pytest.fixture(scope="session")
def odd(docs_of, odd_rows):
    """The odd rows with extra columns whose names clash with those of results and helpers."""
    from pyspark.sql import functions as F

    df = docs_of(odd_rows)
    for name in ("size", "rank", "score", "n_tokens", "spans", "set_id", "label", "id", "row", "component_id", "copies", "draw"):
        df = df.withColumn(name, F.lit("clash"))
    return df
