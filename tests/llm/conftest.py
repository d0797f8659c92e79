import pytest

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def tables(spark):
    return lambda name: spark.read.parquet(f"{DATA}/{name}.parquet")


@pytest.fixture(scope="session")
def documents(tables):
    return tables("documents")


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls in every column, empty and long texts, repeated rows, and columns whose names operators use themselves."""
    long = "the quick brown fox jumps over lazy dogs " * 3000
    rows = [
        (1, "one two three four five six seven eight nine ten", "en", "a"),
        (1, "one two three four five six seven eight nine ten", "en", "a"),
        (2, "one two three four five six seven eight nine ten", "en", None),
        (3, None, "fr", "a"),
        (4, "", None, "b"),
        (5, " \t\n ", "en", "b"),
        (6, "two words", "en", None),
        (7, "Two\x0bWORDS", None, "c"),
        (8, long, "en", "c"),
        (9, long + "ending", "en", "c"),
        (None, "one two three four five six seven eight nine ten", "en", "a"),
        (10, "12 345 -- 6", "en", ""),
    ]
    schema = "doc_id long, text string, lang string, source string"
    extra = "0L as size, 'x' as component, 'y' as node, 1 as block, 2L as length, 'z' as spans, 'k' as key, 3 as n_chars"
    return spark.createDataFrame(rows, schema).selectExpr("*", *extra.split(", "))


@pytest.fixture(scope="session")
def no_documents(odd_documents):
    return odd_documents.where("false")
