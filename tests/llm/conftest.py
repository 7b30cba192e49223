from __future__ import annotations

import pytest

#: Columns whose names the operators use themselves.
CLASHING = ["_hits", "row", "label", "key", "n", "features", "raw", "score", "h1", "places", "rep", "count", "keys"]


@pytest.fixture(scope="session")
def frame(spark):
    """A documents table from (doc_id, text) pairs, with extra columns on request."""

    def build(rows, extra=False):
        names = CLASHING if extra else []
        schema = ", ".join(["doc_id long", "text string", *(f"`{n}` string" for n in names)])
        return spark.createDataFrame([(d, t, *(f"{n}{d}" for n in names)) for d, t in rows], schema)

    return build


@pytest.fixture(scope="session")
def odd(frame):
    """Nulls, empties, blanks, ties, repeats, a long text, and columns whose names clash."""
    long = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))
    words = " ".join(f"tok{i}" for i in range(60))
    rows = [
        (1, None), (2, ""), (3, " \n\t "), (4, words), (5, words), (5, words), (None, words), (None, None), (6, long), (7, "a"), (8, "a b c"),
        (9, words + " tail"), (10, "é ñ 漢字 😀\n\n  x"), (11, "\n".join(["the same line of text in here", "another line of text in here"] * 3)),
        (12, "the same line of text in hers\nx"),
    ]
    return frame(rows, extra=True)


@pytest.fixture(scope="session")
def empty(frame):
    return frame([])
