import pytest

#: Nulls, empty and long texts, repeated rows, ties, and columns that clash with helper names.
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog again and again", "a", 1),
    (1, "The quick brown fox jumps over the lazy dog again and again", "a", 1),
    (2, None, "a", 2),
    (3, "", None, 3),
    (4, "one", "b", 4),
    (None, "no id here at all my friend of the night and day", "b", None),
    (5, "ünï cödé \t\n\x0b words — and\x00nul  " * 3, None, 5),
    (6, "word " * 30_000, "c", 6),
    (7, "   \n\t ", "c", 7),
    (8, "漢字かな交じり文 😀 <s> </s>", "a", 8),
]


@pytest.fixture(scope="session")
def odd(spark):
    """A small table with every odd case, and extra columns named like internal ones."""
    return spark.createDataFrame([(*r, "x", 1) for r in ROWS], "doc_id long, text string, source string, n_chars long, id string, key int").repartition(3)


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)
