import pytest

LONG = " ".join(f"word{k % 977}" for k in range(30_000))


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls, empty and very long texts, ties, repeated rows, and columns whose names operators use too."""
    data = [
        (1, None), (2, ""), (3, "  \t\n"), (4, "One two three"), (5, LONG), (6, LONG), (7, LONG + " end"), (8, "a"), (8, "a"), (None, "no id"), (None, None),
        (9, "Ünïcödé Straße 漢字 \U0001f600 ünïcödé"), (10, "same text here"), (11, "same text here"), (12, "x" * 200_000), (13, "..,;!? --- ..."), (14, "tie"), (14, "another text"),
    ]
    rows = [(d, t, "w", "f", 1, 0, "k", "p") for d, t in data]
    return spark.createDataFrame(rows, "doc_id long, text string, words string, fp string, block int, bucket int, kept string, part string").repartition(3)


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.limit(0)
