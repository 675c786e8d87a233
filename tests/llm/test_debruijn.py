"""Removal of repeated windows of words against brute force, and the compacted paths."""

from collections import Counter, defaultdict

import brute
import numpy as np
import pytest
from conftest import ROWS, by_repr
from pyspark.sql import functions as F

from driftlock.llm import debruijn


def plain(rows, window):
    lists = [brute.SPACE.findall(t or "") for _, t in rows]
    seen = Counter(tuple(w[p : p + window]) for w in lists for p in range(len(w) - window + 1))
    out = []
    for (i, _), w in zip(rows, lists):
        gone = [False] * len(w)
        for p in range(len(w) - window + 1):
            if seen[tuple(w[p : p + window])] > 1:
                gone[p : p + window] = [True] * window
        out.append((i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return out


def near_copies(seed=5):
    """Groups of copies with edits, passages shared across documents, periodic texts, and texts that split and meet."""
    rng = np.random.default_rng(seed)

    def fresh(n):
        return [f"w{x}" for x in rng.integers(0, 10**9, n)]

    passage, rows = fresh(60), []
    for _ in range(5):
        base = fresh(150)
        for _ in range(8):
            copy = list(base)
            for at in rng.integers(0, len(copy), 3):
                copy[at] = f"e{rng.integers(0, 10**9)}"
            rows.append(copy)
    for k in range(30):
        rows.append(fresh(20 + k) + passage[k % 7 : 60 - k % 5] + fresh(25))
    rows += [["a"] * 90, ["a"] * 34, ["a"] * 35, ["a"] * 36, ["a", "b"] * 60, ["a", "b", "c"] * 20 + fresh(9) + ["a", "b", "c"] * 15]
    left, right, middle = fresh(40), fresh(40), fresh(50)
    rows += [left + middle + right, fresh(40) + middle + fresh(40), left + middle + fresh(40), fresh(40) + middle + right]
    seps = [" ", "\n", "\t ", "\x0b", " \r\n"]
    return [(i, seps[i % 5].join(w)) for i, w in enumerate(rows)]


@pytest.mark.parametrize(("window", "gram"), [(35, 8), (12, 3)])
def test_removal_equals_brute_force(spark, window, gram):
    made = near_copies() + [(900 + i, f"Upper lower UPPER {i} " * 30) for i in range(2)]
    docs = spark.createDataFrame(made, "doc_id bigint, text string").repartition(5)
    got = [tuple(r)[:4] for r in debruijn.remove_repeats(docs, window=window, gram=gram).collect()]
    assert sorted(got) == sorted(plain(made, window))


def test_small_blocks_and_salted_look_ups_change_nothing(spark, monkeypatch):
    """Blocks of few texts, and every key that occurs twice salted as if it were hot."""
    monkeypatch.setattr(debruijn, "HOT_SHARE", 0)
    made = near_copies(6)
    docs = spark.createDataFrame(made, "doc_id bigint, text string").repartition(20)
    got = [tuple(r)[:4] for r in debruijn.remove_repeats(docs).collect()]
    assert sorted(got) == sorted(plain(made, 35))


def test_blocks_and_portions_of_windows(monkeypatch):
    made = near_copies(7)
    words = debruijn.Words([t.encode() for _, t in made])

    def windows():
        runs = debruijn.anchor_runs(words, 35, 8)
        return {(int(t), int(f) + k, int(h)) for ts, hs, fs, ns in runs for t, h, f, n in zip(ts, hs, fs, ns) for k in range(n)}

    whole = windows()
    monkeypatch.setattr(debruijn, "WINDOWS", 50)
    assert windows() == whole and len(whole) == sum(max(0, n - 34) for n in words.counts)
    assert debruijn._unpacked((((3 << debruijn._START_BITS) | 70_000) << debruijn._COUNT_BITS) | 28) == (3, 70_000, 28)


def test_edge_rows(edge, nothing):
    small = edge.where("doc_id is null or doc_id <> 8")
    rows = [r for r in ROWS if r[0] != 8]
    assert by_repr(tuple(r)[:4] for r in debruijn.remove_repeats(small, window=6, gram=2).collect()) == by_repr(plain(rows, 6))
    assert debruijn.remove_repeats(nothing).collect() == []
    # The long text repeats itself all over; clashing and dotted names are not read.
    long_ = edge.where("doc_id = 8").withColumns({"a.b": F.lit(1), "__id": F.lit(2), "runs": F.lit(3)})
    got = debruijn.remove_repeats(long_).first()
    assert (got["n_words"], got["n_removed"], got["kept"]) == (600_000, 600_000, "")


def test_paths_name_passages(spark):
    """Copies of a passage lie on one path, though it is cut into runs and documents hold different parts of it."""
    rng = np.random.default_rng(9)
    passage = [f"p{x}" for x in range(200)]
    rows = []
    for k in range(6):
        around = [[f"f{x}" for x in rng.integers(0, 10**9, 50)] for _ in range(2)]
        rows.append((k, " ".join(around[0] + passage[10 * k :] + around[1])))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    spans = {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in debruijn.remove_repeats(docs).collect()}
    # The first ten words are in one document only.
    assert {k: [s[:2] for s in v] for k, v in spans.items()} == {0: [(60, 190)], **{k: [(50, 200 - 10 * k)] for k in range(1, 6)}}
    assert len({s[2] for v in spans.values() for s in v}) == 1


def test_paths_do_not_pass_a_branching_node(spark):
    """Two passages with one beginning: the node where they part has two edges out, so three paths meet there."""
    rng = np.random.default_rng(3)
    stem, one, two = ([f"{c}{x}" for x in range(80)] for c in "stu")

    def around(words):
        a, b = ([f"f{x}" for x in rng.integers(0, 10**9, 40)] for _ in range(2))
        return " ".join(a + words + b)

    rows = [(i, around(stem + (one if i % 2 else two))) for i in range(4)]
    paths = defaultdict(set)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    for r in debruijn.remove_repeats(docs).collect():
        assert [s["first"] for s in r["spans"]] == [40, 40 + 80 - 34]
        paths[r["doc_id"]] = [s["path"] for s in r["spans"]]
    assert len({p[0] for p in paths.values()}) == 1 and paths[0] == paths[2] and paths[1] == paths[3] and paths[0][1] != paths[1][1]


def test_chains_and_cycles_get_one_name(spark):
    rng = np.random.default_rng(1)
    ids, links, want, at = rng.permutation(10_000).tolist(), [], {}, 0
    for size, cycle in [(2, False), (3, False), (57, False), (200, False), (2, True), (5, True), (64, True)]:
        chain = ids[at : at + size]
        at += size
        links += [(b, a) for a, b in zip(chain, chain[1:])] + ([(chain[0], chain[-1])] if cycle else [])
        want |= {x: min(chain) if cycle else chain[0] for x in (chain if cycle else chain[1:])}
    found = debruijn._first_stretches(spark.createDataFrame(links, "`to` bigint, `from` bigint"))
    assert {r["stretch"]: r["first"] for r in found.collect()} == want
    none = spark.createDataFrame([], "`to` bigint, `from` bigint")
    assert debruijn._first_stretches(none).collect() == []
