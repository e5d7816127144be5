import pytest

EDGE = [
    (1, "one two three four five six seven eight nine ten", "en", "a", 0), (2, "one two three four five six seven eight nine ten", "en", "b", 0), (3, None, "en", None, None),
    (4, "", None, "a", 0), (5, "  \t\n", "de", "b", 0), (6, "Short text", "en", "c", 1), (6, "Short text", "en", "c", 1), (None, "no id at all here", "en", "a", 2),
    (7, "é ß 漢字 😀 " * 400, "fr", "a", 3), (8, "word " * 30000, "en", "b", 4), (9, "<|endoftext|> a\x00b 'quoted' «x»", "en", "", 5),
]


@pytest.fixture(scope="session")
def edge(spark):
    """Nulls in every column, empty, blank and long texts, repeated rows, a missing id."""
    return spark.createDataFrame(EDGE, "doc_id long, text string, lang string, source string, n_chars long").cache()


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet("/root/testdata/sf0.01/labels.parquet")


@pytest.fixture(scope="session")
def more(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
