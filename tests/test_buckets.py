"""Tables in folders by key: what is opened, and what comes out."""

import os
import random

import pytest
from pyspark.sql import functions as F

from driftlock.operators import graph
from driftlock.sources.buckets import BUCKET, write_buckets
from driftlock.streaming import gate


def folders(df):
    """The folders whose files a plan opens, after pruning."""
    return {f.rsplit("/", 2)[1] for f in df.inputFiles()}


def files_opened(df):
    """The files that a plain scan opened, as Spark counts them."""
    df.collect()
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    return leaves.head().metrics().apply("numFiles").value()


@pytest.fixture(scope="module")
def locked(spark, tmp_path_factory):
    rows = spark.range(20_000).select(
        F.when(F.col("id") > 0, F.col("id")).alias("a"), (F.col("id") % 7).cast("string").alias("b"), (F.col("id") * 2).alias("v")
    )
    path = str(tmp_path_factory.mktemp("buckets") / "locked")
    return rows, write_buckets(rows, path, ["a", "b"], buckets=256)


def test_a_batch_opens_only_the_folders_of_its_keys(spark, locked):
    rows, stored = locked
    whole = stored.read(spark)
    assert whole.drop(BUCKET).exceptAll(rows).count() == 0 and whole.count() == rows.count()
    batch = rows.where("a is null or a % 5000 = 17").withColumn("v", F.col("v") + F.when(F.col("a") == 17, 1).otherwise(0))
    part = stored.part(whole, batch)
    files = whole.select(BUCKET, F.input_file_name().alias("file")).distinct().groupBy(BUCKET).count()
    files = {r[BUCKET]: r["count"] for r in files.collect()}
    assert len(files) == 256 and len(stored.wanted(batch)) <= 5
    assert files_opened(part) == sum(files[b] for b in stored.wanted(batch)) < sum(files.values()) / 20
    more = batch.unionByName(spark.createDataFrame([(-5, "x", 1)], batch.schema))
    got = {r["status"]: r["n"] for r in gate.batch_counts(more, stored, whole).collect()}
    assert got == {"identical": 4, "changed": 1, "added": 1}


def test_a_key_with_many_rows_goes_through_several_files(spark, tmp_path):
    rows = spark.range(40_000).select(F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id")).alias("k"), "id")
    stored = write_buckets(rows, str(tmp_path / "hot"), ["k"], buckets=32)
    hot = stored.part(stored.read(spark), spark.createDataFrame([(1,)], "k bigint"))
    assert files_opened(hot) == 4 and hot.where("k = 1").count() == rows.where("k = 1").count()


def test_a_stream_against_a_stored_baseline(spark, locked, tmp_path):
    rows, stored = locked
    source = str(tmp_path / "in")
    for i in range(3):
        rows.where(f"a % 3 = {i} and a < 900").withColumn("v", F.col("v") + (F.col("a") == 30).cast("int")).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(source)
    out = str(tmp_path / "out")
    gate.verify_stream(stream, stored, ["a", "b"], out, str(tmp_path / "check")).awaitTermination()
    done = spark.read.parquet(out)
    assert done.select("batch_id").distinct().count() == 3
    assert {r["status"]: r["n"] for r in done.groupBy("status").agg(F.sum("n").alias("n")).collect()} == {"identical": 898, "changed": 1}
    with pytest.raises(ValueError, match="stored by"):
        gate.verify_stream(stream, stored, ["a"], out, str(tmp_path / "check2"))


@pytest.fixture(scope="module")
def web(spark):
    """Units with a hub that a third of the edges call, a long chain, and cycles."""
    rng = random.Random(11)
    edges = {(f"u{rng.randrange(900)}", f"u{rng.randrange(900)}") for _ in range(900)}
    edges |= {(f"u{rng.randrange(900)}", "hub") for _ in range(700)} | {(f"c{i + 1}", f"c{i}") for i in range(5)} | {("c0", "c5")}
    edges |= {("stranger", "c3"), ("u5", "stranger")}
    units = [f"u{i}" for i in range(900)] + ["hub"] + [f"c{i}" for i in range(6)]
    return edges, units


@pytest.mark.parametrize("broadcast_rows", [0, 500_000])
@pytest.mark.parametrize("seeds", [["c2"], ["hub", "u1", "c4"], []])
def test_stored_walk_equals_brute_force(spark, web, seeds, broadcast_rows):
    edges, units = web
    want, stack = set(seeds), list(seeds)
    while stack:
        callee = stack.pop()
        for a, b in edges:
            if b == callee and a in set(units) and a not in want:
                want.add(a)
                stack.append(a)
    unit_rows = spark.createDataFrame([(u, f"/{u}.cs") for u in units], "unit_id string, path string")
    edge_rows = spark.createDataFrame(sorted(edges), "caller_id string, callee_id string")
    changed = spark.createDataFrame([(f"/{s.upper()}.CS",) for s in seeds], "path string")
    got = graph.change_scope(unit_rows, edge_rows, changed, broadcast_rows, plain_edges=0)
    assert sorted(r[0] for r in got.collect()) == sorted(want)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("driftlock_")]


def test_rounds_open_few_folders_and_shuffle_no_edges(spark, web):
    edges, _ = web
    stored = graph.StoredIds(spark, "callee_id", "caller_id", [("hub",)])
    stored.append(spark.createDataFrame(sorted(edges), "caller_id string, callee_id string"))
    try:
        newest = spark.createDataFrame([("c4",), ("u7",)], "unit_id string")
        for size, join in ((2, "BroadcastHashJoin"), (10**9, "SortMergeJoin")):
            found = graph.callers(stored, newest, size)
            assert sorted(r["caller_id"] for r in found.collect()) == sorted(a for a, b in edges if b in ("c4", "u7"))
            assert len(folders(found)) <= 2
            plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
            assert join in plan
            # The scan of the edges is not under an exchange: at most the newest ids are dealt.
            assert plan.count("Exchange hashpartitioning") == (join == "SortMergeJoin")
        # The hub's callers are spread.
        hub = stored.part(stored.asked(spark.createDataFrame([("hub",)], "callee_id string"))).where("callee_id = 'hub'")
        assert hub.count() == sum(b == "hub" for _, b in edges) and len(folders(hub)) > 30
    finally:
        stored.drop()


def test_an_append_writes_a_file_per_bucket_at_most(spark, web):
    """A file per bucket and folder made 12,800 files per round at 200 shuffle partitions."""
    edges, _ = web
    stored = graph.StoredIds(spark, "callee_id", "caller_id", [("hub",)])
    try:
        rows = spark.createDataFrame(sorted(edges), "caller_id string, callee_id string")
        stored.append(rows)
        files = [os.path.join(f, n) for f, _, names in os.walk(stored.path.removeprefix("file:")) for n in names if n.endswith(".parquet")]
        assert 0 < len(files) <= stored.buckets and stored.buckets % stored.folders == 0
        assert spark.table(stored.name).select(*rows.columns).exceptAll(rows).count() == 0
        assert spark.table(stored.name).count() == len(edges)
    finally:
        stored.drop()
