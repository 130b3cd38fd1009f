import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd(spark):
    """Null, empty, long, repeated and clashing rows: columns named like what operators add are in it too."""
    long = " ".join(f"w{i % 977}x{i}" for i in range(20_000))
    rows = [(1, None), (2, ""), (3, "one two"), (4, "Alpha beta\tgamma  delta\n epsilon zeta. 日本語 ꙮ ▁x"), (4, "Alpha beta\tgamma  delta\n epsilon zeta. 日本語 ꙮ ▁x"), (5, long), (6, " lead and trail "), (None, "no id here at all"), (7, "x" * 5_000)]
    full = [(i, t, "en", None if i == 3 else "s", 0, 1, 2.0, "k") for i, t in rows]
    return spark.createDataFrame(full, f"{SCHEMA}, n_tokens long, size double, id string")


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")
