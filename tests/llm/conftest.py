import pytest

LONG = " ".join(f"w{i}" for i in range(30_000))


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls, empty and very long texts, ties, repeated rows and columns with clashing names."""
    rows = [
        (1, None, "en", "a", 0, "x"),
        (2, "", "en", "a", 0, "x"),
        (3, " \n\t ", None, "b", 4, "x"),
        (4, LONG, "en", None, 0, None),
        (5, "one two three", "en", "a", 13, "x"),
        (5, "one two three", "en", "a", 13, "x"),
        (5, "another text of the same id", "fr", "b", 0, "y"),
        (None, "no id here at all", None, None, None, None),
        (7, "one  two\nthree", "en", "a", 14, "x"),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, quality string").selectExpr("*", "1 as rid", "2 as counts", "3 as e", "4 as part")


@pytest.fixture(scope="session")
def empty(odd):
    return odd.filter("false")
