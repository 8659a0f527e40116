from __future__ import annotations

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, k string, size int, h long, s string, t long, shard int, draw string, rank int, target double, bh long, rep long, comp long, score double, plan string, d long, w long"
LONG = " ".join(f"word{i % 977} {'x' * (i % 13)}" for i in range(30_000))


def row(doc_id, text, source="a", lang="en"):
    return (doc_id, text, lang, source, None if text is None else len(text), "k", 1, 2, "s", 3, 4, "d", 5, 1.5, 6, 7, 8, 0.5, "p", 9, 10)


def edge_rows():
    """Nulls in every column, empty and very long texts, ties, repeated rows, names that operators use inside."""
    body = "The quick brown fox jumps over the lazy dog and runs away from all of the noise in town. " * 8
    rows = [row(1, body), row(1, body), row(1, body), row(2, body), row(3, None), row(4, ""), row(None, None, None), row(None, body, None), row(None, "short text", "b", None), row(5, LONG), row(6, LONG + " end"), row(7, "é " * 500, "b"), row(8, "  ", "c"), row(2, "another text of the same id", "b"), row(9, "one"), row(10, " \n\t "), row(11, body.upper(), "é")]
    return rows + [tuple(None for _ in range(21))]


@pytest.fixture(scope="session")
def edge(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
