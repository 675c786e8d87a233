"""LK4, LK5: what changed inside a text value.

A unified diff is an exact longest common subsequence with a fixed rule for ties, which costs the product of both
lengths. It is cut where the result is proven to pass, so the product is paid for changed places only, and the places of
one large pair can go to many tasks.

The cuts: lines that occur once on each side, in an order that both sides share, are extended to runs of equal lines. A
best path that meets a run at any place follows it to its end, because equal lines are always matched. One that meets it
nowhere loses each of the run's single lines on both sides, since these match nothing else. Between two places where it
meets the runs, it loses at least twice the single lines of all runs in between, while the path along the runs loses at
most the lines of the gaps. So a run that has more single lines than half the lines of the gaps around it, for every
stretch of neighbouring runs and gaps, is met by every best path, and the first few of its single lines are enough for
that: the path is cut behind them.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from driftlock.session import cut_lineage

# Output rows of an Arrow batch.
BATCH_ROWS = 20_000
# Cells of the length tables of one pair that a task computes on the spot; beyond, its pieces are dealt out by cost.
INLINE_CELLS = 20_000_000
# Stands in an edit list for equal lines that no context can reach.
GAP = "~"


def _lines(text: str | None) -> list[str]:
    return (text or "").replace("\r\n", "\n").split("\n")


def _lost(lines: list[str], others: list[str]) -> Iterator[int]:
    """Places of the occurrences of a line beyond those among ``others``."""
    there = Counter(others)
    for i, line in enumerate(lines):
        if there[line]:
            there[line] -= 1
        else:
            yield i


def line_delta(pairs: DataFrame, keys: list[str], old: str = "old", new: str = "new") -> DataFrame:
    """LK4: ``(keys…, side, line_no, line)`` for lines that left (``-``) or came (``+``), compared as multisets.

    The occurrences of a line beyond those on the other side are the delta. Both texts are in one row, so they are
    compared there: no line is shuffled. A null text has no lines.
    """
    narrow = pairs.select(*keys, F.col(f"`{old}`").alias("__old"), F.col(f"`{new}`").alias("__new"))
    schema = narrow.select(*keys).schema.add("side", "string").add("line_no", "integer").add("line", "string")
    kind = to_arrow_schema(schema)

    def delta(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[int] = []
            found: list[list] = [[], [], []]

            def flush(batch=batch, rows=rows, found=found) -> pa.RecordBatch:
                held = batch.drop_columns(["__old", "__new"]).take(pa.array(rows, pa.int64()))
                values = [pa.array(v, f.type) for v, f in zip(found, list(kind)[-3:])]
                out = pa.RecordBatch.from_arrays([*held.columns, *values], names=kind.names)
                rows.clear()
                for column in found:
                    column.clear()
                return out

            for i, (o, n) in enumerate(zip(batch.column("__old"), batch.column("__new"))):
                if o.equals(n):
                    continue
                a, b = ([] if x.as_py() is None else _lines(x.as_py()) for x in (o, n))
                for side, mine, others in (("-", a, b), ("+", b, a)):
                    for at in _lost(mine, others):
                        rows.append(i)
                        for column, value in zip(found, (side, at + 1, mine[at])):
                            column.append(value)
                        if len(rows) >= BATCH_ROWS:
                            yield flush()
            yield flush()

    return narrow.mapInArrow(delta, schema)


def _lcs_row(below: np.ndarray, equal: np.ndarray) -> np.ndarray:
    """Row x of the table of common-subsequence lengths, from row x + 1; ``equal`` is a[x] against all of b."""
    step = np.where(equal, below[1:] + 1, below[:-1])
    return np.append(np.maximum.accumulate(step[::-1])[::-1], 0).astype(np.int32)


def _script(a: list[str], b: list[str]) -> list[tuple[str, str]]:
    """Edit script of two line lists; a deletion goes first when both moves are as good.

    Lines that the other side doesn't have match nothing and have no row or column in the length table. It is kept for
    every k-th row only and the rows in between are recomputed on the way down: memory is O(sqrt(n) * m), so long lists
    are diffed exactly like short ones.
    """
    # Equal lines in front are always matched, so the table starts behind them.
    same = 0
    while same < min(len(a), len(b)) and a[same] == b[same]:
        same += 1
    edits = [("  ", line) for line in a[:same]]
    a, b = a[same:], b[same:]
    codes = {line: i for i, line in enumerate(set(a) & set(b))}
    of_a, of_b = (np.array([codes.get(x, -1) for x in lines], dtype=np.int64) for lines in (a, b))
    left, right = of_a[of_a >= 0], of_b[of_b >= 0]
    # Common lines before each line.
    rows, columns = (np.append(0, np.cumsum(c >= 0)).tolist() for c in (of_a, of_b))
    n, m = len(left), len(right)
    k = max(1, int(np.sqrt(n)))
    kept = {n: np.zeros(m + 1, dtype=np.int32)}
    row = kept[n]
    for x in range(n - 1, -1, -1):
        row = _lcs_row(row, right == left[x])
        if x % k == 0:
            kept[x] = row
    block: dict[int, np.ndarray] = {n: kept[n]}
    x = y = 0
    while x < len(a) and y < len(b):
        if a[x] == b[y]:
            edits.append(("  ", a[x]))
            x, y = x + 1, y + 1
            continue
        r, after = rows[x], rows[x + 1]
        if r not in block or after not in block:
            end = min(n, (r // k + 1) * k)
            block = {end: kept[end]}
            for i in range(end - 1, r - 1, -1):
                block[i] = _lcs_row(block[i + 1], right == left[i])
        if block[after][columns[y]] >= block[r][columns[y + 1]]:
            edits.append(("- ", a[x]))
            x += 1
        else:
            edits.append(("+ ", b[y]))
            y += 1
    edits += [("- ", line) for line in a[x:]]
    edits += [("+ ", line) for line in b[y:]]
    return edits


def _ascending(places: list[int]) -> list[int]:
    """Indexes of a longest ascending subsequence."""
    ends: list[int] = []
    at: list[int] = []
    before = [-1] * len(places)
    for i, place in enumerate(places):
        j = bisect_left(ends, place)
        before[i] = at[j - 1] if j else -1
        if j == len(ends):
            ends.append(place)
            at.append(i)
        else:
            ends[j], at[j] = place, i
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def _runs(a: list[str], b: list[str]) -> list[tuple[int, int, int, list[int]]]:
    """Runs of equal lines around lines that are single on both sides: (place in a, place in b, length, single places)."""
    many_a, many_b = Counter(a), Counter(b)
    place = {line: y for y, line in enumerate(b) if many_b[line] == 1 and many_a[line] == 1}
    single = [x for x, line in enumerate(a) if line in place]
    runs: list[tuple[int, int, int, list[int]]] = []
    end_x = end_y = 0
    for i in _ascending([place[a[x]] for x in single]):
        x, y = single[i], place[a[single[i]]]
        if x < end_x:
            continue
        back, length = 0, 1
        while x - back > end_x and y - back > end_y and a[x - back - 1] == b[y - back - 1]:
            back += 1
        while x + length < len(a) and y + length < len(b) and a[x + length] == b[y + length]:
            length += 1
        runs.append((x - back, y - back, back + length, [z for z in range(x - back, x + length) if a[z] in place]))
        end_x, end_y = x + length, y + length
    return runs


def pieces(a: list[str], b: list[str]) -> list[tuple[int, int, int, int]]:
    """(from, to in a, from, to in b) of pieces that are diffed each on its own; between them the lines are equal."""
    same = 0
    while same < min(len(a), len(b)) and a[same] == b[same]:
        same += 1
    a, b = a[same:], b[same:]
    runs = _runs(a, b)
    gaps, x, y = [], 0, 0
    for run_x, run_y, length, _ in runs:
        gaps.append(run_x - x + run_y - y)
        x, y = run_x + length, run_y + length
    gaps.append(len(a) - x + len(b) - y)
    # The most that a path off the runs can save before and behind each run.
    save = [2 * len(single) for *_, single in runs]
    ahead, behind = gaps[:-1], gaps[1:]
    for j in range(1, len(runs)):
        ahead[j] += max(0, ahead[j - 1] - save[j - 1])
    for j in range(len(runs) - 2, -1, -1):
        behind[j] += max(0, behind[j + 1] - save[j + 1])
    out, x, y = [], 0, 0
    for (run_x, run_y, length, single), before, after, most in zip(runs, ahead, behind, save):
        if before + after < most:
            upto = single[before // 2] + 1
            out.append((x + same, upto + same, y + same, run_y + upto - run_x + same))
            x, y = run_x + length, run_y + length
    if x < len(a) or y < len(b):
        out.append((x + same, len(a) + same, y + same, len(b) + same))
    return out


def _between(lines: list[str], context: int) -> list[str]:
    """Equal lines between two pieces, as edits, without those that no context can reach."""
    if len(lines) <= 2 * context:
        return ["  " + line for line in lines]
    return ["  " + x for x in lines[:context]] + [GAP] + ["  " + x for x in lines[len(lines) - context :]]


def _piece_edits(before: list[str], a: list[str], b: list[str]) -> list[str]:
    return before + [mark + line for mark, line in _script(a, b)]


def _cut(locked: str, current: str, context: int) -> tuple[list[tuple[list[str], list[str], list[str]]], list[str]]:
    """(equal edits before, lines of a, lines of b) of each piece, and the equal edits behind the last."""
    a, b = _lines(locked), _lines(current)
    out, end = [], 0
    for from_a, to_a, from_b, to_b in pieces(a, b):
        out.append((_between(a[end:from_a], context), a[from_a:to_a], b[from_b:to_b]))
        end = to_a
    return out, _between(a[end:], context)


def _rendered(edits: list[str], context: int) -> str:
    changed = np.array([e[:2] != "  " and e != GAP for e in edits])
    if not changed.any():
        return ""
    at = np.flatnonzero(changed)
    near = np.zeros(len(edits) + 1, dtype=np.int64)
    np.add.at(near, np.maximum(at - context, 0), 1)
    np.add.at(near, np.minimum(at + context + 1, len(edits)), -1)
    shown = np.cumsum(near[:-1]) > 0
    out, gap = [], False
    for keep, edit in zip(shown, edits):
        if keep:
            if gap:
                out.append("  …")
            out.append(edit)
        gap = not keep
    return "\n".join(out)


def unified_text(locked: str, current: str, context: int = 3) -> str:
    """The hunk text of two values: ``- `` locked, ``+ `` current, ``  …`` where unchanged lines are left out."""
    cut, rest = _cut(locked, current, context)
    return _rendered([e for piece in cut for e in _piece_edits(*piece)] + rest, context)


_PART = "array<struct<no: int, before: array<string>, a: array<string>, b: array<string>>>"
_PART_ARROW = pa.list_(pa.struct([("no", pa.int32()), *((c, pa.list_(pa.string())) for c in ("before", "a", "b"))]))
_EDITS_ARROW = pa.schema([("pair", pa.int64()), ("no", pa.int32()), ("edits", pa.list_(pa.string()))])


def _shares(cut: list[tuple], cells: int) -> list[list[dict]]:
    """Neighbouring pieces as shares of about so many cells."""
    shares: list[list[dict]] = []
    cost = cells
    for no, (before, a, b) in enumerate(cut):
        if cost >= cells:
            shares.append([])
            cost = 0
        shares[-1].append({"no": no, "before": before, "a": a, "b": b})
        cost += len(a) * len(b) + len(a) + len(b)
    return shares


def unified_diff(
    pairs: DataFrame,
    keys: list[str],
    old: str = "old",
    new: str = "new",
    context: int = 3,
    spread: int | None = None,
    inline_cells: int = INLINE_CELLS,
) -> DataFrame:
    """LK5: ``(keys…, diff)`` per pair; the empty text when nothing changed. A null text is empty.

    Give it changed pairs only. One kernel cuts each pair into pieces in linear time and diffs them on the spot while
    their cost is at most ``inline_cells``. The pieces of a dearer pair become rows of about that cost, are dealt to
    tasks, and their edits are put together again per pair; equal lines beyond the context never leave the first task.
    Few input partitions are worth a ``spread`` over many.
    """
    narrow = pairs.select(*keys, F.col(f"`{old}`").alias("__old"), F.col(f"`{new}`").alias("__new"))
    if spread:
        narrow = narrow.repartition(spread)
    n = len(narrow.columns) - 2
    inner = [f"k{i}" for i in range(n)]
    kinds = [f.dataType.simpleString() for f in narrow.schema.fields[:n]]
    shape = ", ".join([*(f"{i} {k}" for i, k in zip(inner, kinds)), "pair bigint", "diff string", f"shares array<{_PART}>", "rest array<string>"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            diffs: list[str | None] = []
            shares: list[list | None] = []
            rests: list[list[str] | None] = []
            for o, c in zip(batch.column(n), batch.column(n + 1)):
                cut_, rest = _cut(o.as_py() or "", c.as_py() or "", context)
                inline = sum(len(a) * len(b) for _, a, b in cut_) <= inline_cells
                diffs.append(_rendered([e for p in cut_ for e in _piece_edits(*p)] + rest, context) if inline else None)
                shares.append(None if inline else _shares(cut_, inline_cells))
                rests.append(None if inline else rest)
            told = [
                pa.array(np.arange(number, number + batch.num_rows)),
                pa.array(diffs, pa.string()),
                pa.array(shares, pa.list_(_PART_ARROW)),
                pa.array(rests, pa.list_(pa.string())),
            ]
            number += batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], *told], names=[*inner, "pair", "diff", "shares", "rest"])

    def edit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pair, share in zip(batch.column("pair").to_pylist(), batch.column("share")):
                for p in share.as_py():
                    row = {"pair": pair, "no": p["no"], "edits": _piece_edits(p["before"], p["a"], p["b"])}
                    yield pa.RecordBatch.from_pylist([row], _EDITS_ARROW)

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [_rendered(e.as_py(), context) for e in batch.column("edits")]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(texts, pa.string())], names=[*inner, "diff"])

    # The number of a pair and its pieces come from one run of the kernel, also when tasks are repeated later on.
    done = cut_lineage(narrow.mapInArrow(cut, shape))
    inline, dear = done.where("diff is not null").select(*inner, "diff"), done.where("diff is null")
    if dear.isEmpty():
        return inline.toDF(*narrow.columns[:n], "diff")
    dealt = dear.select("pair", F.explode("shares").alias("share")).repartition(_tasks(pairs))
    edits = dealt.mapInArrow(edit, "pair bigint, no int, edits array<string>")
    whole = edits.groupBy("pair").agg(F.flatten(F.array_sort(F.collect_list(F.struct("no", "edits")))["edits"]).alias("edits"))
    joined = dear.select(*inner, "pair", "rest").join(whole, "pair").select(*inner, F.concat("edits", "rest").alias("edits"))
    texts = joined.mapInArrow(render, ", ".join([*(f"{i} {k}" for i, k in zip(inner, kinds)), "diff string"]))
    return inline.unionByName(texts).toDF(*narrow.columns[:n], "diff")


def _tasks(df: DataFrame) -> int:
    """Tasks for work that is dear for its bytes: adaptive execution would put it into few."""
    return max(df.sparkSession.sparkContext.defaultParallelism, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
