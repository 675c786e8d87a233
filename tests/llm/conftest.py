import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

LONG = "the quick brown fox and the lazy dog are in this line of a text\n" * 40_000

# (doc_id, text): nulls, empty and blank texts, ties, repeated rows, a text of 2.5 MB, letters beyond ASCII.
ROWS = [
    (1, None), (2, ""), (3, " \t\n\x0b "), (None, None), (None, "no id but a text of some words here and there"),
    (4, "Ein Satz mit Wörtern, größer als ASCII; 漢字 \U0001f600 und mehr davon als sonst\nzweite Zeile"),
    (5, "one two three four five six seven eight nine ten eleven twelve\nThis line is in three documents."),
    (6, "one two three four five six seven eight nine ten eleven twelve\nThis line is in three documents."),
    (6, "one two three four five six seven eight nine ten eleven twelve\nThis line is in three documents."),
    (7, "another text\n  THIS LINE IS IN THREE DOCUMENTS.\t\nthis line is in three documents."),
    (7, "the same id with another text"), (8, LONG), (9, "short"), (10, "a b c d"), (11, "A B c D"),
    (12, "null\x00byte and   separators \x85 in a text"),
]
CLASHES = [
    "id", "th", "h", "c", "n", "shard", "slot", "kept", "spans", "items", "n_words", "n_hit", "n_lines", "n_dropped", "score",
    "secrets", "licenses", "component", "text_hash", "toxic", "place", "copies", "sig", "runs", "base_failed", "contaminated",
]


@pytest.fixture(scope="session")
def edge(spark):
    """The rows above with extra columns that have the names of inner and result columns; half of them null."""
    rows = [(i, t, *[None if k % 2 else f"x{k}" for k in range(len(CLASHES))]) for i, t in ROWS]
    return spark.createDataFrame(rows, "doc_id bigint, text string, " + ", ".join(f"{c} string" for c in CLASHES)).repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(edge):
    return edge.limit(0)


@pytest.fixture(scope="session")
def table(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="session")
def rows(table):
    return [(r["doc_id"], r["text"]) for r in table.select("doc_id", "text").collect()]


def by_repr(values):
    return sorted(values, key=repr)
