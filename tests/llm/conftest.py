import pytest

#: Documents with nulls, empty and very long texts, ties and repeated rows, and columns of odd names.
LONG = " ".join(f"word{i % 977} of number {i}" for i in range(30_000))
TEXTS = [
    (1, "The quick brown fox jumps over the lazy dog near the old river bank today"),
    (2, "The quick brown fox jumps over the lazy dog near the old river bank today"),
    (2, "The quick brown fox jumps over the lazy dog near the old river bank today"),
    (3, None),
    (4, ""),
    (5, " \t\n\x0b\f\r "),
    (6, LONG),
    (7, LONG + " end"),
    (None, "a text without an id, and some words that follow it here"),
    (None, None),
    (8, "one two"),
    (9, "one two"),
    (10, "Zoë 日本語 \U0001f600 naïve ▁x <|endoftext|> \x00   end"),
    (11, "same line 1\nsame line 2\nsame line 3\n\nlast"),
]
EXTRA = "doc long, v string, score string, n_lines string, Cluster long, s array<long>, task int, region string, lang string"


@pytest.fixture(scope="session")
def odd_docs(spark):
    rows = [(i, t, 99, None, "x", "y", 7, [1], 0, None, None if k % 3 == 0 else "en") for k, (i, t) in enumerate(TEXTS)]
    return spark.createDataFrame(rows, f"doc_id long, text string, {EXTRA}")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.filter("false")


@pytest.fixture(scope="session")
def odd_labels(spark):
    rows = [(1, 1, 0), (1, 1, 0), (2, 0, 1), (2, 1, 1), (3, None, None), (None, 1, 0), (6, 1, 0), (8, 0, 1), (10, 0, 1), (11, 1, 0)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
