import pytest

SF = "/root/testdata/sf0.001"
ODD = [
    (None, "no id at all here", "en", "s", 1),
    (7, None, None, None, None),
    (8, "", "en", "s", 0),
    (9, "   \n\t ", "en", "s", 6),
    (10, "same text twice over and over", "en", "s", 28),
    (10, "same text twice over and over", "en", "s", 28),
    (11, "same text twice over and over", "xx", "t", 28),
    (12, "naïve ﬁancé — 漢字 ½ ²³ \U0001f600 é \x1c\x85\xa0<|endoftext|> don't", None, "t", 1),
    (13, "word " * 30_000, "en", "s", 150_000),
    (14, "a" * 50_000, "en", "s", 50_000),
    (15, "1 2 3 4 5 6 7 8 9 " * 3000, "en", "s", 1),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Rows with nulls, empty and very long texts, ties, repeats and extra columns with clashing names."""
    rows = [(*r, i, "x", 1) for i, r in enumerate(ODD)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, length int, shard string, kept int")


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")
