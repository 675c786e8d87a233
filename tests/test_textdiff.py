import random

import pytest
from pyspark.sql import functions as F

from driftlock.operators import textdiff
from driftlock.operators.textdiff import _script, line_delta, pieces, unified_diff, unified_text


def brute_script(a, b):
    """The textbook table, walked from the front, deletions first."""
    n, m = len(a), len(b)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in reversed(range(n)):
        for j in reversed(range(m)):
            best[i][j] = 1 + best[i + 1][j + 1] if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < n or j < m:
        if i < n and j < m and a[i] == b[j]:
            out.append(("  ", a[i]))
            i, j = i + 1, j + 1
        elif j == m or (i < n and best[i + 1][j] >= best[i][j + 1]):
            out.append(("- ", a[i]))
            i += 1
        else:
            out.append(("+ ", b[j]))
            j += 1
    return out


def brute_text(a, b, context):
    edits = brute_script(a, b)
    changed = [i for i, (mark, _) in enumerate(edits) if mark != "  "]
    out, gap = [], False
    for i, (mark, line) in enumerate(edits):
        near = any(abs(i - c) <= context for c in changed)
        if near:
            out += ["  …"] * gap + [mark + line]
        gap = not near
    return "\n".join(out) if changed else ""


def edited(rng, share_single):
    """A list of lines, some single and some common, and a version of it with edits and moved blocks."""
    a = [f"u{i}" if rng.random() < share_single else rng.choice("xyz") for i in range(rng.randint(1, 60))]
    b = list(a)
    for _ in range(rng.randint(0, 6)):
        i = rng.randrange(len(b))
        kind = rng.random()
        if kind < 0.3 and len(b) > 1:
            del b[i]
        elif kind < 0.6:
            b.insert(i, rng.choice(["x", "y", "z", f"n{rng.randint(0, 99)}", *a]))
        elif kind < 0.8:
            block = b[i : i + rng.randint(1, 8)]
            del b[i : i + len(block)]
            at = rng.randint(0, len(b))
            b[at:at] = block
        else:
            b[i] = "q"
    return a, b


def test_scripts_equal_brute_force():
    rng = random.Random(3)
    for _ in range(300):
        a = [rng.choice("abcd") for _ in range(rng.randint(1, 40))]
        b = [rng.choice("abcd") for _ in range(rng.randint(1, 40))]
        assert _script(a, b) == brute_script(a, b)


@pytest.mark.parametrize("share_single", [0.95, 0.75, 0.5])
def test_cut_diffs_equal_brute_force(share_single):
    """Cuts never change a script, not even where blocks moved and common lines tie."""
    rng = random.Random(share_single)
    cut = 0
    for _ in range(500):
        a, b = edited(rng, share_single)
        cut += len(pieces(a, b)) > 1
        assert _script(a, b) == brute_script(a, b)
        for context in (0, 1, 3):
            assert unified_text("\n".join(a), "\n".join(b), context) == brute_text(a, b, context)
    assert cut > 20


def test_moved_blocks_are_not_cut_through():
    """The longer of two swapped blocks stays, whatever single lines the other has."""
    one, two = [f"a{i}" for i in range(5)], [f"b{i}" for i in range(9)]
    a, b = ["s", *one, *two, "e"], ["s", *two, *one, "e"]
    assert unified_text("\n".join(a), "\n".join(b)) == brute_text(a, b, 3)
    assert all(f"  {x}" in unified_text("\n".join(a), "\n".join(b), 20).split("\n") for x in two)


def test_hunks():
    assert unified_text("a\r\nb", "a\nb") == ""
    assert unified_text("Outcome: 100", "Outcome: 120") == "- Outcome: 100\n+ Outcome: 120"
    old = "\n".join(str(i) for i in range(12))
    new = old.replace("6", "six")
    assert unified_text(old, new, 1) == "  …\n  5\n- 6\n+ six\n  7"
    assert unified_text("1\n2\n3", "1\n2\n3\n4", 1) == "  …\n  3\n+ 4"


def test_delta_and_diff_tables(spark):
    made = [(1, "a\nb\nb", "b\na\nc"), (2, "x", "x\nx"), (3, None, "y\r\nz"), (4, "same", "same"), (None, "", None)]
    pairs = spark.createDataFrame(made, "k int, old string, new string")
    delta = {(r.k, r.side, r.line_no, r.line) for r in line_delta(pairs, ["k"]).collect()}
    assert delta == {(1, "-", 3, "b"), (1, "+", 3, "c"), (2, "+", 2, "x"), (3, "+", 1, "y"), (3, "+", 2, "z"), (None, "-", 1, "")}
    diffs = {r.k: r.diff for r in unified_diff(pairs, ["k"]).collect()}
    assert diffs == {1: unified_text("a\nb\nb", "b\na\nc"), 2: "  x\n+ x", 3: "- \n+ y\n+ z", 4: "", None: ""}
    assert unified_diff(pairs.limit(0), ["k"]).collect() == [] and line_delta(pairs.limit(0), ["k"]).collect() == []


def test_line_delta_emits_many_rows(spark, monkeypatch):
    monkeypatch.setattr(textdiff, "BATCH_ROWS", 7)
    pairs = spark.createDataFrame([(i, "k\n" * i, "\n".join(f"n{j}" for j in range(i))) for i in range(1, 9)], "k int, old string, new string")
    assert line_delta(pairs.coalesce(1), ["k"]).groupBy("side").count().orderBy("side").collect() == [("+", 36), ("-", 44)]


def test_a_large_pair_spreads_over_tasks(spark):
    """A pair of a million lines: its pieces are dealt out, each small, and put together in order."""
    lines = [f"line {i}" if i % 7 else "" for i in range(1_000_000)]
    changed = list(lines)
    for i in range(3, len(lines), 4999):
        changed[i : i + 40] = [f"new {i} {j}" for j in range(60)]
    for i in range(2500, len(lines), 50_021):
        del changed[i : i + 3]
    cut = pieces(lines, changed)
    assert len(cut) > 200 and max((x1 - x0) * (y1 - y0) for x0, x1, y0, y1 in cut) < 100_000
    shares = textdiff._shares(textdiff._cut("\n".join(lines), "\n".join(changed), 3)[0], 40_000)
    assert len(shares) > 20 and max(sum(len(p["a"]) * len(p["b"]) for p in s) for s in shares) < 100_000
    pair = spark.createDataFrame([(1, "\n".join(lines), "\n".join(changed)), (2, "a", "b")], "k int, old string, new string")
    dealt = {r.k: r.diff for r in unified_diff(pair, ["k"], inline_cells=40_000).collect()}
    assert dealt == {1: unified_text("\n".join(lines), "\n".join(changed)), 2: "- a\n+ b"}


def test_dealt_pieces_equal_inline_ones(spark):
    rng = random.Random(8)
    made = [(i, *("\n".join(x) for x in edited(rng, 0.8))) for i in range(80)]
    pairs = spark.createDataFrame(made, "k int, old string, new string").withColumn("a b", F.col("k") * 2)
    inline = sorted(map(tuple, unified_diff(pairs, ["k", "a b"]).collect()))
    assert inline == sorted(map(tuple, unified_diff(pairs, ["k", "a b"], inline_cells=0).collect()))
    assert inline == sorted((k, 2 * k, brute_text(o.split("\n"), n.split("\n"), 3)) for k, o, n in made)
