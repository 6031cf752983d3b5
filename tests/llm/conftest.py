import pytest

#: Texts that every operator must take: empty, null, blank, long, repeated, not ASCII.
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "Ünïcode ßtraße 中文 🎉\nzwei"),
       (6, "word " * 60_000), (7, "a\x00b\r\nc"), (8, "one"), (8, "one"), (None, "no id at all"),
       (None, None), (9, "x" * 300_000)]


@pytest.fixture
def odd(spark):
    """Odd rows with columns that operators might use themselves."""
    return spark.createDataFrame(
        [(i, t, "en" if i and i % 2 else None, k, None) for k, (i, t) in enumerate(ODD)],
        "doc_id long, text string, lang string, _row int, N_Words string")


@pytest.fixture
def empty(odd):
    return odd.limit(0)


@pytest.fixture
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
