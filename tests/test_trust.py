"""Stored baselines, guards and scans that must not lie."""

import os

import pytest
from pyspark.sql import functions as F

from driftlock.functions.scrub import scrub
from driftlock.operators import graph, lock, verify
from driftlock.sources import baseline, corpus


def test_nested_values_are_scrubbed(spark):
    df = spark.sql("""SELECT 1 AS id, array(named_struct('v', 'password="aaa111"'), named_struct('v', null)) AS a,
                      map('k', 'token: "bbb222"') AS m, named_struct('x', 1, 'y', 'fine') AS s""")
    row = scrub(df, ["a", "m", "s"]).first()
    assert row.a[0].v == 'password="[REDACTED]"' and row.a[1].v is None and row.m["k"] == 'token: "[REDACTED]"'
    assert row.s.y == "fine" and row.redactions == 2


def test_an_unchanged_table_with_secrets_verifies(spark, tmp_path):
    df = spark.createDataFrame([(1, 'password="aaa111"'), (2, "plain")], "id int, v string")
    baseline.write_baseline(df, str(tmp_path), "t", ["id"])
    assert {r.status for r in baseline.verify_baseline(df, str(tmp_path), "t").collect()} == {"identical"}
    now = df.withColumn("v", F.concat("v", F.lit("!")))
    cells = baseline.baseline_cells(now, str(tmp_path), "t").collect()
    assert len(cells) == 2 and not any("aaa111" in c.new for c in cells)


def test_a_key_with_a_secret_is_refused(spark, tmp_path):
    df = spark.createDataFrame([('password="aaa111"', 1)], "k string, v int")
    with pytest.raises(Exception, match="holds a secret"):
        baseline.write_baseline(df, str(tmp_path), "t", ["k"])


def test_a_half_written_version_blocks_nothing(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], "id int, v string")
    left_behind = df.withColumn("v", F.when(F.col("id") == 1, F.raise_error(F.lit("lost"))).otherwise(F.col("v")))
    with pytest.raises(Exception, match="lost"):
        baseline.write_baseline(left_behind, str(tmp_path), "t", ["id"])
    df.write.parquet(f"{tmp_path}/t/data/version=1")
    assert baseline.write_baseline(df, str(tmp_path), "t", ["id"]) == 1
    assert baseline.read_baseline(spark, str(tmp_path), "t").count() == 1


def test_repeated_keys_are_refused_everywhere(spark):
    one = spark.createDataFrame([(1, "a")], "id int, v string")
    two = spark.createDataFrame([(1, "b"), (1, "c")], "id int, v string")
    with pytest.raises(Exception, match="(?i)key"):
        verify.cell_delta(one, two, ["id"]).collect()
    with pytest.raises(Exception, match="(?i)key"):
        lock.accept(one, two, ["id"], accept_all=True)
    with pytest.raises(Exception, match="(?i)key"):
        lock.diagnose_flaky(one.withColumn("u", F.lit("x")), two.withColumn("u", F.lit("x")), ["id"], "u").collect()
    with pytest.raises(Exception, match="(?i)key"):
        verify.verify(one, two, ["id"]).count()


def test_schema_break_lists_every_column(spark):
    wide = spark.range(1).select(*[F.lit(i).alias(f"c{i}") for i in range(40)])
    assert len(verify.schema_break(wide.schema, spark.range(1))) == 40


def test_scope_ends_at_callers_that_are_no_units(spark):
    units = spark.createDataFrame([("a", "a.cs"), ("b", "b.cs"), ("c", "c.cs")], "unit_id string, path string")
    edges = spark.createDataFrame([("x", "a"), ("b", "x"), ("c", "a")], "caller_id string, callee_id string")
    changed = spark.createDataFrame([("a.cs",)], "path string")
    assert sorted(r.unit_id for r in graph.change_scope(units, edges, changed).collect()) == ["a", "c"]


def test_scan_reads_bytes_that_are_no_utf8_and_leaves_folders_out(spark, tmp_path):
    root = tmp_path / "a bin" / "my repo"
    for folder, data in (("src", b"caf\xe9"), ("Bin", b"x"), ("lib/OBJ/deep", b"y"), ("binary", b"z")):
        os.makedirs(root / folder)
        (root / folder / "f.txt").write_bytes(data)
    rows = {r.path.rsplit("/", 2)[1]: r.content for r in corpus.scan_corpus(spark, str(root)).collect()}
    assert rows == {"src": "caf\ufffd", "binary": "z"}
