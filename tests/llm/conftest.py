import random

import pytest


@pytest.fixture
def words():
    """Deterministic made-up words."""
    rng = random.Random(5)
    return lambda n, kinds=400: [f"w{rng.randrange(kinds)}" for _ in range(n)]


@pytest.fixture
def odd_documents(spark):
    """Nulls, empty and blank texts, repeated rows, a missing id, one long text, clashing extra columns."""
    long = " ".join(f"t{i % 977}x{i % 31}" for i in range(30_000))
    rows = [
        (1, None, "a", 1), (2, "", "b", 2), (3, " \t\n", None, 3), (4, "one two", "d", None), (4, "one two", "d", None),
        (None, "no id here at all but words", "e", 5), (5, long, "f", 6), (6, long, "g", 7), (7, "ünï “quoted” – ß", "h", 8)]
    return spark.createDataFrame(rows, "doc_id long, text string, row string, node long")
