"""Baselines are committed whole, once, and by one writer; digests tell which ranges differ."""

import os

import pytest
from pyspark.sql import functions as F

from driftlock.operators import digests
from driftlock.operators.verify import verify
from driftlock.sources import baseline as store


@pytest.fixture
def rows(spark):
    return spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")


def test_a_crash_at_any_step_leaves_the_name_usable(spark, rows, tmp_path, monkeypatch):
    root = str(tmp_path)
    assert store.write_baseline(rows, root, "b", ["k"]) == 1

    class Crash(Exception):
        pass

    def crash(*_):
        raise Crash

    # While the data is written, before the manifest is, and in the middle of it.
    bad = rows.withColumn("v", F.when(F.col("k") == 2, F.raise_error(F.lit("no"))).otherwise(F.col("v")))
    with pytest.raises(Exception, match="no"):
        store.write_baseline(bad, root, "b", ["k"])
    with monkeypatch.context() as patch:
        patch.setattr(store, "fingerprint", crash)
        with pytest.raises(Crash):
            store.write_baseline(rows, root, "b", ["k"])
    with monkeypatch.context() as patch:
        patch.setattr(store, "put_if_absent", crash)
        with pytest.raises(Crash):
            store.write_baseline(rows, root, "b", ["k"])
    for left in ("_0123.part", "2/_temporary/0/part-0.json"):
        path = tmp_path / "b" / "manifest" / left
        os.makedirs(path.parent, exist_ok=True)
        path.write_text('{"version": 2, "for')
    assert store.versions(spark, root, "b") == [1]
    left = store.recover(spark, root, "b")
    assert len(left) == 3 and all(x.startswith("version=2-") for x in left)
    assert store.write_baseline(rows.limit(1), root, "b", ["k"]) == 2
    assert store.read_baseline(spark, root, "b").count() == 1 and store.read_baseline(spark, root, "b", 1).count() == 2
    assert store.recover(spark, root, "b") == left and store.recover(spark, root, "none") == []


def test_of_two_writers_one_commits(spark, rows, tmp_path, monkeypatch):
    """Both look before either has written, so both choose the same number."""
    root = str(tmp_path)
    monkeypatch.setattr(store, "versions", lambda *_: [])
    assert store.write_baseline(rows, root, "b", ["k"]) == 1
    with pytest.raises(store.VersionTaken, match="already has a version 1"):
        store.write_baseline(rows.limit(1), root, "b", ["k"])
    monkeypatch.undo()
    assert store.versions(spark, root, "b") == [1] and store.read_baseline(spark, root, "b").count() == 2
    assert not [f for f in os.listdir(tmp_path / "b" / "manifest") if f.endswith(".part")]


def test_put_if_absent(spark, tmp_path):
    path = f"{tmp_path}/x/y.json"
    store.put_if_absent(spark, path, "ä\n")
    assert open(path, encoding="utf-8").read() == "ä\n"
    with pytest.raises(FileExistsError):
        store.put_if_absent(spark, path, "b")
    assert open(path, encoding="utf-8").read() == "ä\n" and [f for f in os.listdir(tmp_path / "x") if not f.startswith(".")] == ["y.json"]


@pytest.fixture(scope="module")
def versions(spark):
    old = spark.range(5000).select(F.col("id").alias("k"), (F.col("id") % 9).cast("string").alias("s"), F.when(F.col("id") % 4 > 0, F.col("id") / 2).alias("d"))
    changed = old.where("k <> 11").withColumn("s", F.when(F.col("k") == 4000, "new").otherwise(F.col("s")))
    return old, changed.unionByName(spark.createDataFrame([(-7, None, None)], old.schema))


def test_digests_add_up_and_do_not_depend_on_order(versions):
    old, new = versions
    fine, coarse = (digests.range_digests(x, ["k"], depth=d) for x, d in ((old, 3), (old.repartition(5, "s"), 1)))
    assert sorted(map(tuple, digests.level(fine, 1).collect())) == sorted(map(tuple, coarse.collect()))
    assert digests.differing_ranges(fine, digests.range_digests(old.orderBy("s"), ["k"])) == []
    keys = old.where("k in (11, 4000)").unionByName(new.where("k = -7"))
    want = sorted(r[0] for r in keys.select(digests.range_of(keys, ["k"])).collect())
    assert digests.differing_ranges(fine, digests.range_digests(new, ["k"])) == want
    # Values are told apart from their neighbours, and null from its text.
    pairs = [(("a", "bc"), ("ab", "c")), ((None, "x"), ("-", "x")), (("1:a", ""), ("1", "a"))]
    for one, two in pairs:
        sides = [old.sparkSession.createDataFrame([(1, *v)], "k int, a string, b string") for v in (one, two)]
        assert digests.differing_ranges(*[digests.range_digests(x, ["k"]) for x in sides])


@pytest.mark.parametrize("stored", [False, True])
def test_only_ranges_that_differ_are_joined(spark, versions, tmp_path, stored):
    old, new = versions
    base = digests.write_ranges(old, str(tmp_path / "t"), ["k"], depth=2) if stored else old
    verdicts, ranges = digests.verify_ranges(base, new, None if stored else ["k"], depth=2)
    got = {(r["k"], r["status"]) for r in verdicts.collect()}
    want = {(r["k"], r["status"]) for r in verify(old, new, ["k"]).collect() if r["status"] != "identical"}
    assert {x for x in got if x[1] != "identical"} == want == {(11, "missing"), (4000, "changed"), (-7, "added")}
    told = ranges.collect()
    differing = [r for r in told if not r["same"]]
    # Three ranges of 256 are compared row by row; the rows of all others are counted by their digests.
    assert 1 <= len(differing) <= 3 and len(got) <= sum(r["n_rows"] for r in differing) + 1 < 100
    assert sum(r["n_rows"] for r in told) == 5000
    if stored:
        plan = verdicts._jdf.queryExecution().executedPlan().toString()
        assert f"PartitionFilters: [{digests.RANGE}" in plan
    same, _ = digests.verify_ranges(base, old, None if stored else ["k"], depth=2)
    assert same.count() == 0
