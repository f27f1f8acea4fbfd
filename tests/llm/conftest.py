import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, node string, key bigint, rep bigint, sig string"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and long texts, repeated rows and extra columns whose names operators use inside."""
    long = " ".join(f"w{i % 977}x{i // 977}" for i in range(40000))
    base = "the quick brown fox jumps over the lazy dog and runs far away from every other animal in the wood at night " * 4
    rows = [
        (1, base, "en", "a"), (1, base, "en", "a"), (2, base, None, None), (3, None, "en", "a"), (4, "", "fr", "b"), (5, " \n\t ", "fr", "b"),
        (None, base + "so", "en", "a"), (None, None, None, None), (6, "one", "de", "c"), (7, "one", "de", "c"), (8, long, "de", "c"), (9, "Ünïcode — ß ÉÉ 😀 中文", "de", "c"),
    ]
    return spark.createDataFrame([(*r, None, "n", 1, 2, "s") for r in rows], SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (1, 1, 0), (None, 1, 1), (3, None, 1), (4, 0, None), (6, 0, 0), (99, 1, 1)], "doc_id bigint, quality int, toxic int")


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
