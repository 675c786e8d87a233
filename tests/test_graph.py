import random

import pytest
from pyspark.sql import functions as F

from driftlock.operators import graph, tagging
from driftlock.operators.lookup import hot_keys, lookup_join


def ids(df, col="unit_id"):
    return {r[col] for r in df.collect()}


@pytest.fixture(scope="module")
def calls(spark):
    units = spark.createDataFrame(
        [("a", "F1.cs"), ("b", "F1.cs"), ("c", "F2.cs"), ("d", "F2.cs"), ("e", "F3.cs")], "unit_id string, path string"
    )
    edges = spark.createDataFrame([("c", "b"), ("d", "c")], "caller_id string, callee_id string")
    return units, edges


@pytest.mark.parametrize("broadcast_rows", [0, 1000])
@pytest.mark.parametrize(
    "paths, expected",
    [(["f1.CS"], {"a", "b", "c", "d"}), (["F2.cs"], {"c", "d"}), (["F9.cs"], set()), ([], set())],
)
def test_change_scope(spark, calls, paths, expected, broadcast_rows):
    changed = spark.createDataFrame([(p,) for p in paths], "path string")
    assert ids(graph.change_scope(*calls, changed, broadcast_rows)) == expected


def test_scope_with_a_cycle_and_a_caller_outside_the_set(spark, calls):
    units, edges = calls
    more = spark.createDataFrame([("b", "d"), ("outside", "d"), ("e", "outside")], edges.schema)
    changed = spark.createDataFrame([("F2.cs",)], "path string")
    assert ids(graph.change_scope(units, edges.union(more), changed)) == {"b", "c", "d"}


def test_edges_resolve_by_id_then_by_unique_name(spark):
    units = spark.createDataFrame(
        [("H.Twice(int)", "Twice", 1), ("A.Add(int)", "Add", 1), ("B.Add(int)", "Add", 1), ("main", "Main", 0)],
        "unit_id string, name string, arity int",
    )
    refs = spark.createDataFrame(
        [
            ("main", "Twice", 1, None),
            ("main", "Twice", 1, None),
            ("main", "Add", 1, None),
            ("main", "Add", 1, "A.Add(int)"),
            ("H.Twice(int)", "Twice", 1, None),
            ("main", "Twice", 2, None),
            ("main", "Missing", 0, None),
            ("main", "Twice", 1, "elsewhere"),
            ("main", "Main", 0, "main"),
        ],
        "caller_id string, name string, arity int, resolved_id string",
    )
    got = {tuple(r) for r in graph.resolve_edges(units, refs).collect()}
    assert got == {("main", "H.Twice(int)"), ("main", "A.Add(int)")}


def test_hot_key_join_equals_the_plain_join(spark):
    big = spark.range(20000).select("id", F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 900).cast("int").alias("k"))
    small = spark.range(800).select(F.col("id").cast("int").alias("k"), (F.col("id") * 2).alias("v"))
    assert hot_keys(big, ["k"]) == [(7,)]
    for how in ("left", "inner"):
        want = big.join(small, ["k"], how).select("k", "id", "v")
        for limit in (0, 10_000):
            got = lookup_join(big, small, ["k"], how, broadcast_rows=limit).select("k", "id", "v")
            assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_attach_source_against_brute_force(spark):
    rng = random.Random(5)
    types = [(f"f{f}", f"T{f}.{i}", s, s + rng.randint(0, 200)) for f in range(3) for i in range(60) for s in [rng.randint(1, 500)]]
    units = [(i, f"f{rng.randint(0, 3)}", s, s + rng.randint(0, 60)) for i, s in enumerate(rng.randint(1, 560) for _ in range(400))]
    got = graph.attach_source(
        spark.createDataFrame(units, "unit_id int, path string, start_line int, end_line int"),
        spark.createDataFrame(types, "path string, type_name string, start_line int, end_line int"),
    )
    want = {}
    for uid, path, s, e in units:
        inside = [(te - ts, name) for p, name, ts, te in types if p == path and ts <= s and e <= te]
        want[uid] = min(inside)[1] if inside else None
    assert {r.unit_id: r.type_name for r in got.collect()} == want


def test_unknown_target_reports_nothing(spark):
    uses = spark.createDataFrame(
        [("System.Web.Page", "System.Web", "a.cs", 3, 1), ("Mine", "Systemic", "a.cs", 4, 2), (None, "System", "a.cs", 5, 3)],
        "type_name string, assembly string, file string, line int, seq int",
    )
    empty = spark.createDataFrame([], "type_name string")
    assert graph.missing_in_target(uses, empty).count() == 0
    some = spark.createDataFrame([("System.String",)], "type_name string")
    assert [r.type_name for r in graph.missing_in_target(uses, some).collect()] == ["System.Web.Page"]


def test_seam_lists_keep_six_distinct_sorted(spark):
    deps = [("u", "injected", f"I{c}", None) for c in "hgfedcba"] + [("u", "injected", "IDisposable", None)]
    deps += [("u", "call", "DateTime", "Now"), ("u", "call", "DateTime", "Parse"), ("u", "new", "Random", None), ("u", "call", "File", "Open")]
    deps += [("w", "call", "Math", "Abs")]
    rows = tagging.seam_lists(spark.createDataFrame(deps, "unit_id string, kind string, type string, member string"))
    got = {r.unit_id: (r.seams, r.obstacles) for r in rows.collect()}
    assert got == {"u": (["Ia", "Ib", "Ic", "Id", "Ie", "If"], ["DateTime.Now", "File", "new Random"]), "w": ([], [])}


def test_distinct_pairs_are_dealt_by_the_number_of_references(spark, monkeypatch):
    """Adaptive execution goes by packed bytes and would leave these few bytes to one task."""
    monkeypatch.setattr(graph, "REFS_PER_TASK", 100)
    units = spark.range(200).select(F.concat(F.lit("u"), "id").alias("unit_id"), F.concat(F.lit("n"), "id").alias("name"), F.lit(1).alias("arity"))
    refs = spark.range(1500).select(
        F.concat(F.lit("u"), (F.col("id") % 30).cast("string")).alias("caller_id"),
        F.concat(F.lit("n"), (F.col("id") % 210).cast("string")).alias("name"),
        F.lit(1).alias("arity"),
        F.when(F.col("id") % 3 == 0, F.concat(F.lit("u"), (F.col("id") % 250).cast("string"))).alias("resolved_id"),
    )
    found = graph.resolve_edges(units, refs)
    parts = found.groupBy(F.spark_partition_id()).count().collect()
    assert len(parts) > 10 and max(r["count"] for r in parts) <= 150
    want = set()
    for i in range(1500):
        callee = f"u{i % 250}" if i % 3 == 0 and i % 250 < 200 else f"u{i % 210}" if i % 3 and i % 210 < 200 else None
        if callee not in (None, f"u{i % 30}"):
            want.add((f"u{i % 30}", callee))
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(want) and set(got) == want
