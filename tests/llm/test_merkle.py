"""The Merkle manifest against a plain tree."""

import hashlib
import zlib
from collections import defaultdict

import pytest
from conftest import ROWS, by_repr
from pyspark.sql import functions as F

from driftlock.llm import merkle


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def levels(nodes, arity):
    """(all levels, the path of siblings of each leaf as (left, right) pairs)"""
    paths = [[] for _ in nodes]
    at = list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[i : i + arity] for i in range(0, len(nodes), arity)]
        for path, i in zip(paths, at):
            run = runs[i // arity]
            path += ["".join(run[: i % arity]), "".join(run[i % arity + 1 :])]
        at = [i // arity for i in at]
        nodes = [h(*r) for r in runs]
    return nodes[0], paths


def plain(rows, arity=3):
    """rows of (doc_id, source, lang, n_chars, text)"""
    groups = defaultdict(list)
    for r in rows:
        groups[r[1]].append(r)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    subroots, paths = [], []
    for s in order:
        groups[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        top, below = levels([leaf(r) for r in groups[s]], arity)
        subroots.append(top)
        paths.append(below)
    root, above = levels(subroots, arity)
    out = []
    for s, subroot, below, up in zip(order, subroots, paths, above):
        for r, path in zip(groups[s], below):
            node = leaf(r)
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[4] is not None:
                node = leaf([*r[:4], r[4].replace("\n", "")])
            path = path + up
            for a, b in zip(path[::2], path[1::2]):
                node = h(a, node, b)
            out.append((r[0], leaf(r), subroot, root, h(*path), node, node == root))
    return out


NAMES = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def got(docs, **options):
    return [tuple(r[c] for c in NAMES) for r in merkle.prove(docs, checked=merkle.without_line_feeds(docs), **options).collect()]


@pytest.mark.parametrize(("arity", "high"), [(3, 1), (2, 2), (3, 6)])
def test_manifest_equals_a_plain_tree(spark, arity, high):
    """Groups below, at and above one and several superblocks; sources of every size from one row on."""
    rows = [
        (i, None if s == 0 else f"s{s}" if s < 13 else "Ünïcode 漢", ["de", None][i % 2], i % 5, f"text {i}\nof {s}" if i % 4 else None)
        for s, n in enumerate([4, 1, 2, 3, 4, 8, 9, 10, 26, 27, 28, 60, 5, 7])
        for i in range(100 * s, 100 * s + n)
    ]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, lang string, n_chars int, text string").repartition(4)
    found = got(docs, arity=arity, levels=high)
    assert by_repr(found) == by_repr(plain(rows, arity))
    assert any(r[6] for r in found) and not all(r[6] for r in found)


def test_manifest_of_edge_rows(edge, nothing):
    """Null ids and texts, equal rows, ties of an id, a text of 2.5 MB; other columns may have any names."""
    named = edge.withColumns({"source": F.when(F.col("doc_id") > 5, "one"), "lang": F.lit(None).cast("string"), "n_chars": F.length("text")})
    clash = named.withColumns({c: F.lit("x") for c in ("g", "p", "digest", "leaf", "root", "ordered", "name", "block", "a.b", "__seq")})
    rows = [(i, "one" if (i or 0) > 5 else None, None, None if t is None else len(t), t) for i, t in ROWS]
    assert by_repr(got(clash, levels=1)) == by_repr(plain(rows))
    empty = clash.limit(0)
    assert merkle.prove(empty).collect() == [] and merkle.prove(empty).columns == NAMES


def test_proofs_fold_to_the_root(table):
    """A kept proof gives the root from the leaf alone, and from no other leaf."""
    proved = merkle.prove(table, levels=2, keep_proof=True)
    told = proved.select(
        (merkle.folded(F.col("leaf"), F.col("proof")) == F.col("root")).alias("same"),
        (merkle.folded(F.sha2("leaf", 256), F.col("proof")) == F.col("root")).alias("other"),
        (F.sha2(F.array_join("proof", ""), 256) == F.col("proof_sha256")).alias("proof"),
        "verified",
    )
    assert {tuple(r) for r in told.distinct().collect()} == {(True, False, True, True)}
