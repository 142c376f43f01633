import pytest

# rows that every operator on texts must bear: nulls, empties, repeats, ties, long words, odd white space
ODD_TEXTS = [
    None, "", " \t\n\x0b\f\r ", "a", "A a", "one two three four", "one two three four five", "ONE two Three four five",
    "x" * 3000, "ä ö ü ß é ñ 漢字 🙂 " * 4, "line\nline\nline\n\nother\n", "a b c d e f g h " * 6, "same text here twice over and over", "same text here twice over and over",
]


@pytest.fixture(scope="session")
def odd(spark):
    """ODD_TEXTS with repeated rows, null ids and columns whose names clash with results."""
    rows = [(i, t, "src%d" % (i % 3) if i % 4 else None, i) for i, t in enumerate(ODD_TEXTS)]
    rows += [(3, "a", "src0", 3), (3, "a", "src0", 3), (None, "no id here", None, None), (None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, score long")


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, source string, score long")
