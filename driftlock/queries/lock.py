"""Verify, accept, capture, prove, stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftlock.functions.checked import when
from driftlock.functions.names import lock_name
from driftlock.operators import digests
from driftlock.operators import lock as locking
from driftlock.operators import mutate as mut
from driftlock.operators import scores
from driftlock.operators import verify as v
from driftlock.plans.scope import verify_scoped
from driftlock.queries.registry import derived, query, table, with_derived
from driftlock.queries.text import _scrub_sql
from driftlock.session import scratch_path
from driftlock.sources import baseline as store
from driftlock.streaming import gate

ORDER_COLS = ["o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]


def _joined(cols: str = "changed_cols"):
    return F.array_join(cols, ",").alias(cols)


_VERDICTS = """
    WITH paired AS (
        SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, a.o_orderkey IS NOT NULL AS in_old,
               b.o_orderkey IS NOT NULL AS in_new,
               concat_ws(',', CASE WHEN a.o_custkey IS DISTINCT FROM b.o_custkey THEN 'o_custkey' END,
                   CASE WHEN a.o_orderstatus IS DISTINCT FROM b.o_orderstatus THEN 'o_orderstatus' END,
                   CASE WHEN a.o_totalprice IS DISTINCT FROM b.o_totalprice THEN 'o_totalprice' END,
                   CASE WHEN a.o_orderpriority IS DISTINCT FROM b.o_orderpriority THEN 'o_orderpriority' END) AS diff
        FROM orders_v1 a FULL JOIN orders_v2 b ON a.o_orderkey IS NOT DISTINCT FROM b.o_orderkey
    ), verdicts AS (
        SELECT o_orderkey,
               CASE WHEN NOT in_new THEN 'missing' WHEN NOT in_old THEN 'added' WHEN diff <> '' THEN 'changed'
                    ELSE 'identical' END AS status,
               CASE WHEN in_old AND in_new THEN diff ELSE '' END AS changed_cols
        FROM paired
    )
"""


@query("verify_keyed_jn7", with_derived("orders_v1 orders_v2", _VERDICTS + "SELECT * FROM verdicts"))
def verify_keyed(spark, sf_dir):
    old, new = derived(spark, sf_dir, "orders_v1"), derived(spark, sf_dir, "orders_v2")
    return v.verify(old, new, ["o_orderkey"]).select("o_orderkey", "status", _joined())


@query(
    "verify_reference_statuses_jn7",
    with_derived(
        "orders_v1 orders_v2",
        _VERDICTS
        + """SELECT CASE WHEN status = 'missing' THEN 'identical' ELSE status END AS status, count(*) AS n
             FROM verdicts WHERE status <> 'added' GROUP BY 1""",
    ),
)
def verify_reference_statuses(spark, sf_dir):
    old, new = derived(spark, sf_dir, "orders_v1"), derived(spark, sf_dir, "orders_v2")
    verdicts = v.verify(old, new, ["o_orderkey"], reference_statuses=True)
    return verdicts.groupBy("status").agg(F.count("*").alias("n"))


# Lines have no key of their own: order and line number repeat, and so do part and supplier now and then.
_LINE_KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice"]
_SAME_LINE = " AND ".join(f"a.{k} = b.{k}" for k in _LINE_KEYS)
_EITHER_LINE = ", ".join(f"coalesce(a.{k}, b.{k}) AS {k}" for k in _LINE_KEYS)


@query(
    "verify_lineitem_jn7",
    with_derived(
        "lines_v1 lines_v2",
        f"""
        SELECT {_EITHER_LINE},
               CASE WHEN b.l_orderkey IS NULL THEN 'missing' WHEN a.l_orderkey IS NULL THEN 'added'
                    WHEN a.l_quantity IS DISTINCT FROM b.l_quantity OR a.l_discount IS DISTINCT FROM b.l_discount
                      OR a.l_returnflag IS DISTINCT FROM b.l_returnflag THEN 'changed' ELSE 'identical' END AS status,
               CASE WHEN a.l_orderkey IS NOT NULL AND b.l_orderkey IS NOT NULL THEN concat_ws(',',
                    CASE WHEN a.l_quantity IS DISTINCT FROM b.l_quantity THEN 'l_quantity' END,
                    CASE WHEN a.l_discount IS DISTINCT FROM b.l_discount THEN 'l_discount' END,
                    CASE WHEN a.l_returnflag IS DISTINCT FROM b.l_returnflag THEN 'l_returnflag' END) ELSE '' END AS changed_cols
        FROM lines_v1 a FULL JOIN lines_v2 b ON {_SAME_LINE}
        """,
    ),
)
def verify_lineitem(spark, sf_dir):
    old, new = derived(spark, sf_dir, "lines_v1"), derived(spark, sf_dir, "lines_v2")
    return v.verify(old, new, _LINE_KEYS).select(*_LINE_KEYS, "status", _joined())


_BAG = """
    WITH net AS (
        SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity, l_discount, l_returnflag,
               sum(o) AS o, sum(n) AS n
        FROM (SELECT *, 1 AS o, 0 AS n FROM lines_v1 UNION ALL SELECT *, 0 AS o, 1 AS n FROM lines_v2) GROUP BY ALL
    )
"""


@query(
    "verify_repeated_keys_jn7",
    with_derived(
        "lines_v1 lines_v2",
        _BAG
        + """SELECT l_orderkey, l_linenumber,
                    CASE WHEN sum(n) = 0 THEN 'missing' WHEN sum(o) = 0 THEN 'added' WHEN bool_or(o <> n) THEN 'changed'
                         ELSE 'identical' END AS status, CAST(sum(o) AS BIGINT) AS n_old, CAST(sum(n) AS BIGINT) AS n_new
             FROM net GROUP BY l_orderkey, l_linenumber""",
    ),
)
def verify_repeated_keys(spark, sf_dir):
    old, new = derived(spark, sf_dir, "lines_v1"), derived(spark, sf_dir, "lines_v2")
    return v.verify_bag(old, new, ["l_orderkey", "l_linenumber"]).drop("changed_cols")


@query(
    "verify_summary_ag6",
    with_derived(
        "orders_v1 orders_v2",
        _VERDICTS
        + """SELECT count(*) AS total, count(*) FILTER (status = 'changed') AS changed,
                    count(*) FILTER (status = 'identical') AS identical, count(*) FILTER (status = 'missing') AS missing,
                    count(*) FILTER (status = 'added') AS added, FALSE AS preserved, 1 AS gate_code FROM verdicts""",
    ),
)
def verify_summary(spark, sf_dir):
    old, new = derived(spark, sf_dir, "orders_v1"), derived(spark, sf_dir, "orders_v2")
    return v.verify_summary(v.verify(old, new, ["o_orderkey"]))


@query(
    "verify_unchanged_ag6",
    "SELECT count(*) AS total, 0 AS changed, count(*) AS identical, count(*) > 0 AS preserved, 0 AS gate_code FROM lineitem",
)
def verify_unchanged(spark, sf_dir):
    """A table against itself, moved around: everything identical, gate open."""
    lines = table(spark, sf_dir, "lineitem")
    moved = lines.repartition("l_shipdate")
    return v.verify_summary(v.verify(lines, moved, _LINE_KEYS)).drop("missing", "added")


_CELLS = with_derived(
    "orders_v1 orders_v2",
    """
    WITH both_sides AS (
        SELECT a.o_orderkey, a.o_totalprice AS old_price, b.o_totalprice AS new_price, a.o_orderpriority AS old_prio,
               b.o_orderpriority AS new_prio
        FROM orders_v1 a JOIN orders_v2 b ON a.o_orderkey = b.o_orderkey
    ), cells AS (
        SELECT o_orderkey, 'o_totalprice' AS "column", CAST(old_price AS STRING) AS old, CAST(new_price AS STRING) AS new
        FROM both_sides WHERE old_price IS DISTINCT FROM new_price
        UNION ALL
        SELECT o_orderkey, 'o_orderpriority', old_prio, new_prio FROM both_sides WHERE old_prio IS DISTINCT FROM new_prio
    ) SELECT {} FROM cells {}
    """,
)


@query("cell_delta_lk6", _CELLS.format("*", ""))
def cell_delta(spark, sf_dir):
    old, new = derived(spark, sf_dir, "orders_v1"), derived(spark, sf_dir, "orders_v2")
    return v.cell_delta(old, new, ["o_orderkey"])


@query("cell_counts_lk6", _CELLS.format('"column", count(*) AS n_changed', 'GROUP BY "column"'))
def cell_counts(spark, sf_dir):
    old, new = derived(spark, sf_dir, "orders_v1"), derived(spark, sf_dir, "orders_v2")
    return v.cell_counts(v.cell_delta(old, new, ["o_orderkey"]))


@query(
    "bag_diff_set2",
    with_derived(
        "lines_v1 lines_v2",
        _BAG
        + """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity, l_discount, l_returnflag,
                    CASE WHEN o > n THEN '-' ELSE '+' END AS side, CAST(abs(o - n) AS BIGINT) AS n FROM net WHERE o <> n""",
    ),
)
def bag_diff(spark, sf_dir):
    return v.bag_diff(derived(spark, sf_dir, "lines_v1"), derived(spark, sf_dir, "lines_v2"))


@query(
    "fingerprint_ag11",
    "SELECT count(*) AS n_rows, TRUE AS same_when_moved, FALSE AS same_when_changed FROM lineitem",
)
def fingerprint(spark, sf_dir):
    """Digest of a table, of the same rows moved around, and of its changed version."""
    old, new = derived(spark, sf_dir, "lines_v1"), derived(spark, sf_dir, "lines_v2")
    a, b, c = v.fingerprint(old), v.fingerprint(old.repartition("l_partkey")), v.fingerprint(new)
    digest = F.struct("n_rows", "hash_xor", "hash_sum")
    sides = (
        a.select(F.lit(0).alias("i"), "n_rows", digest.alias("d"))
        .unionByName(b.select(F.lit(1).alias("i"), "n_rows", digest.alias("d")))
        .unionByName(c.select(F.lit(2).alias("i"), "n_rows", digest.alias("d")))
    )
    d = [F.max(F.when(F.col("i") == i, F.col("d"))) for i in range(3)]
    return sides.agg(
        F.max(F.when(F.col("i") == 0, F.col("n_rows"))).alias("n_rows"),
        (d[0] == d[1]).alias("same_when_moved"),
        (d[0] == d[2]).alias("same_when_changed"),
    )


def _cents(df):
    """Values that print the same everywhere."""
    price = F.round(F.col("o_totalprice") * 100).cast("bigint").alias("cents")
    return df.select("o_orderkey", "o_custkey", price, "o_orderstatus", "o_orderpriority")


def _range_sql(version, depth):
    texts = ["o_orderkey", "o_custkey", "CAST(round(o_totalprice * 100) AS BIGINT)", "o_orderstatus", "o_orderpriority"]
    framed = [f"coalesce(length(CAST({t} AS STRING)) || ':' || {t}, '-')" for t in texts]
    return f"""SELECT substr(md5({framed[0]}), 1, {depth}) AS range, md5({" || ".join(framed)}) AS h, o_orderkey FROM {version}"""


@query(
    "range_digests_ag11",
    with_derived(
        "orders_v1",
        f"""
        WITH h AS ({_range_sql("orders_v1", 2)})
        SELECT range, count(*) AS n_rows, CAST(sum(CAST('0x' || substr(h, 1, 15) AS BIGINT)) AS STRING) AS sum_high,
               CAST(sum(CAST('0x' || substr(h, 16, 15) AS BIGINT)) AS STRING) AS sum_low FROM h GROUP BY range
        """,
    ),
)
def range_digests(spark, sf_dir):
    found = digests.range_digests(_cents(derived(spark, sf_dir, "orders_v1")), ["o_orderkey"], depth=2)
    return found.withColumns({c: F.col(c).cast("string") for c in ("sum_high", "sum_low")})


@query(
    "verify_ranges_jn7",
    with_derived(
        "orders_v1 orders_v2",
        f"""
        WITH few_v2 AS (
            SELECT * FROM orders_v2 WHERE o_orderkey < 12 UNION ALL SELECT * FROM orders_v1 WHERE o_orderkey >= 12),
        o AS ({_range_sql("orders_v1", 1)}),
        n AS ({_range_sql("few_v2", 1)}),
        pairs AS (
            SELECT coalesce(o.range, n.range) AS range, o.h AS old, n.h AS new FROM o FULL JOIN n ON o.o_orderkey = n.o_orderkey),
        hit AS (SELECT DISTINCT range FROM pairs WHERE old IS DISTINCT FROM new)
        SELECT CASE WHEN range NOT IN (SELECT range FROM hit) THEN 'range with equal digests' WHEN new IS NULL THEN 'missing'
                    WHEN old IS NULL THEN 'added' WHEN old = new THEN 'identical' ELSE 'changed' END AS status, count(*) AS n
        FROM pairs GROUP BY 1
        """,
    ),
)
def verify_ranges(spark, sf_dir):
    """A version in which few orders changed: their ranges are joined, the others told by their digests."""
    old, new = (_cents(derived(spark, sf_dir, x)) for x in ("orders_v1", "orders_v2"))
    now = new.where("o_orderkey < 12").unionByName(old.where("o_orderkey >= 12"))
    stored = digests.write_ranges(old, scratch_path(spark, "ranges"), ["o_orderkey"], depth=1)
    verdicts, ranges = digests.verify_ranges(stored, now)
    skipped = ranges.where("same").agg(F.coalesce(F.sum("n_rows"), F.lit(0)).alias("n"))
    told = verdicts.groupBy("status").agg(F.count("*").alias("n"))
    return told.unionByName(skipped.select(F.lit("range with equal digests").alias("status"), "n")).where("n > 0")


@query(
    "schema_break_lk9",
    """SELECT count(*) AS n_locked, 'error: locked column ''o_totalprice'' changed type from double to string' AS first_error,
              'error: locked column ''o_orderpriority'' is missing' AS second_error, 1 AS gate_code FROM orders""",
)
def schema_break(spark, sf_dir):
    """A column dropped and one retyped: errors are reported and behaviour is not judged."""
    orders = table(spark, sf_dir, "orders")
    now = orders.drop("o_orderpriority").withColumn("o_totalprice", F.col("o_totalprice").cast("string"))
    errors = v.schema_break(orders.schema, now)
    summary = v.verify_summary(orders.select(F.lit(v.IDENTICAL).alias("status")), broke=bool(errors))
    return summary.select(
        F.col("total").alias("n_locked"),
        F.lit(errors[0]).alias("first_error"),
        F.lit(errors[1]).alias("second_error"),
        "gate_code",
    )


# --- baseline life cycle --------------------------------------------------------------------------------------


@query(
    "baseline_versions_src9",
    with_derived(
        "orders_v1 orders_v2",
        """SELECT 1 AS version, o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders_v1
           UNION ALL SELECT 2, o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders_v2""",
    ),
)
def baseline_versions(spark, sf_dir):
    """Two versions written one after the other and read back."""
    root = scratch_path(spark, "baselines")
    for name in ("orders_v1", "orders_v2"):
        store.write_baseline(derived(spark, sf_dir, name), root, "orders", ["o_orderkey"])
    both = [
        store.read_baseline(spark, root, "orders", n).select(F.lit(n).alias("version"), "*")
        for n in store.versions(spark, root, "orders")
    ]
    return both[0].unionByName(both[1])


@query(
    "baseline_secrets_src9",
    f"""SELECT count(*) AS total, count(*) AS identical, count(*) FILTER (WHERE redactions > 0) AS redacted
        FROM ({_scrub_sql("documents", "doc_id")})""",
)
def baseline_secrets(spark, sf_dir):
    """Texts with secrets inside structs, arrays and maps: stored scrubbed, and the same table still verifies."""
    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        F.struct(F.array("text").alias("parts"), "lang").alias("body"),
        F.create_map(F.lit("text"), "text").alias("fields"),
    )
    root = scratch_path(spark, "secrets")
    store.write_baseline(docs, root, "docs", ["doc_id"])
    verdicts = store.verify_baseline(docs, root, "docs")
    locked = store.read_baseline(spark, root, "docs").select("doc_id", F.col("body.parts")[0].alias("a"), F.col("fields")["text"].alias("b"))
    both = locked.join(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    changed = (F.col("a") == F.col("b")) & (F.col("a") != F.col("text"))
    counts = v.verify_summary(verdicts).select("total", "identical")
    return counts.crossJoin(both.agg(F.count_if(changed).alias("redacted")))


@query(
    "accept_lk7",
    with_derived(
        "orders_v1 orders_v2",
        """SELECT a.o_orderkey, a.o_custkey, a.o_orderstatus,
                  CASE WHEN lower(a.o_orderpriority) LIKE '%urgent%' AND b.o_orderkey IS NOT NULL THEN b.o_totalprice
                       ELSE a.o_totalprice END AS o_totalprice, a.o_orderpriority
           FROM orders_v1 a LEFT JOIN orders_v2 b ON a.o_orderkey = b.o_orderkey""",
    ),
)
def accept(spark, sf_dir):
    """Only the urgent orders are accepted; the renamed priority stays a difference."""
    old, new = derived(spark, sf_dir, "orders_v1"), derived(spark, sf_dir, "orders_v2")
    keyed = old.withColumn("label", F.col("o_orderpriority"))
    now = new.join(old.select("o_orderkey", F.col("o_orderpriority").alias("label")), "o_orderkey")
    done = locking.accept(
        keyed, now.select(*keyed.columns), ["o_orderkey", "label"], name="urgent", name_col="label"
    )
    return done.baseline.drop("label")


def _order_entries(orders):
    """The locked logic: price per unit of the customer key, with division by zero as the error."""

    def per_customer(df):
        cents = F.round(F.col("o_totalprice") * 100).cast("bigint")
        share = F.expr("try_divide(o_totalprice, o_custkey)")
        return df.withColumns({"cents": cents, "share": share, "whole": F.floor(share).cast("bigint")})

    return locking.capture(
        orders,
        per_customer,
        "o_custkey",
        "o_orderkey",
        ["o_orderstatus", "o_orderpriority"],
        ["whole"],
        ["o_orderpriority"],
        lambda df: [
            locking.ErrorRule(F.col("o_custkey") == 0, "DivideByZeroException", "Attempted to divide by zero."),
            locking.ErrorRule(F.col("o_orderstatus") == "P", "InvalidOperationException", "order is pending"),
        ],
    )


_ENTRIES = """
    SELECT CAST(o_custkey AS STRING) AS unit_id, o_orderkey AS entry_no,
           '(' || o_orderstatus || ', ' || o_orderpriority || ')' AS input,
           CASE WHEN o_custkey = 0 THEN 'DivideByZeroException: Attempted to divide by zero.'
                WHEN o_orderstatus = 'P' THEN 'InvalidOperationException: order is pending'
                ELSE CAST(CAST(floor(o_totalprice / o_custkey) AS BIGINT) AS STRING) END AS outcome,
           o_custkey = 0 OR o_orderstatus = 'P' AS is_error, o_orderpriority AS captured
    FROM orders
"""


@query("capture_lk1", _ENTRIES)
def capture(spark, sf_dir):
    entries = _order_entries(table(spark, sf_dir, "orders"))
    return entries.withColumn("captured", F.col("captures")[0]["value"]).drop("captures")


@query(
    "capture_checked_lk1",
    """
    SELECT CAST(o_custkey AS STRING) AS unit_id, o_orderkey AS entry_no,
           CASE WHEN greatest(o_orderkey, 1) * o_custkey * 1000 > 2147483647 THEN 'ARITHMETIC_OVERFLOW: overflow'
                WHEN o_custkey = 0 THEN 'DIVIDE_BY_ZERO: division by zero'
                WHEN o_orderstatus = 'P' THEN 'CAST_INVALID_INPUT: ''P'' is no int'
                ELSE CAST(o_orderkey * o_custkey * 1000 AS STRING) END AS outcome,
           greatest(o_orderkey, 1) * o_custkey * 1000 > 2147483647 OR o_custkey = 0 OR o_orderstatus = 'P' AS is_error
    FROM orders
    """,
)
def capture_checked(spark, sf_dir):
    """Whole numbers that overflow, a division by zero, and a status that is no number: errors that nobody declared."""

    def logic(row):
        load = row["o_orderkey"].cast("int") * row["o_custkey"].cast("int") * 1000
        code = when(row["o_orderstatus"] == "P", row["o_orderstatus"].cast("int")).otherwise(1)
        return {"load": load, "share": row["o_totalprice"] / row["o_custkey"], "code": code}

    orders = table(spark, sf_dir, "orders")
    entries = locking.capture(orders, None, "o_custkey", "o_orderkey", ["o_orderstatus"], ["load"], checked=logic)
    return entries.select("unit_id", "entry_no", "outcome", "is_error")


@query(
    "outcome_profile_ag10",
    f"""SELECT CASE WHEN is_error THEN regexp_extract(outcome, '^(\\w+): ', 1) ELSE 'value' END AS kind, count(*) AS n,
               count(*) / CAST(sum(count(*)) OVER () AS DOUBLE) AS share
        FROM ({_ENTRIES}) GROUP BY 1""",
)
def outcome_profile(spark, sf_dir):
    return scores.outcome_profile(_order_entries(table(spark, sf_dir, "orders")))


def _two_runs(spark, sf_dir):
    """Two runs that disagree where the changed orders do; a key added in one run counts as well."""
    runs = []
    for name in ("orders_v1", "orders_v2"):
        df = derived(spark, sf_dir, name)
        runs.append(
            df.select(F.col("o_custkey").cast("string").alias("unit_id"), F.col("o_orderkey").alias("entry_no"), "o_totalprice")
        )
    return runs


@query(
    "quarantine_lk2",
    with_derived(
        "orders_v1 orders_v2",
        """
        WITH flaky AS (
            SELECT CAST(coalesce(a.o_custkey, b.o_custkey) AS STRING) AS unit_id
            FROM orders_v1 a FULL JOIN orders_v2 b ON a.o_orderkey = b.o_orderkey
            WHERE a.o_totalprice IS DISTINCT FROM b.o_totalprice
        )
        SELECT CAST(o_custkey AS STRING) AS unit_id, 'quarantined' AS state, count(*) AS n FROM orders_v1
        WHERE CAST(o_custkey AS STRING) IN (SELECT unit_id FROM flaky) GROUP BY 1
        UNION ALL
        SELECT CAST(o_custkey AS STRING), 'stable', count(*) FROM orders_v1
        WHERE CAST(o_custkey AS STRING) NOT IN (SELECT unit_id FROM flaky) GROUP BY 1
        """,
    ),
)
def quarantine(spark, sf_dir):
    run_a, run_b = _two_runs(spark, sf_dir)
    stable, quarantined = locking.quarantine_flaky(run_a, run_b, ["unit_id", "entry_no"])
    rows = stable.select("unit_id", F.lit("stable").alias("state")).unionByName(
        run_a.join(quarantined, "unit_id", "left_semi").select("unit_id", F.lit("quarantined").alias("state"))
    )
    return rows.groupBy("unit_id", "state").agg(F.count("*").alias("n"))


@query(
    "diagnose_flaky_lk3",
    """
    SELECT o_custkey, array_to_string(list_sort(list_distinct(list(cause))), ', ') AS causes,
           'non-deterministic: two runs differ, likely ' || array_to_string(list_sort(list_distinct(list(cause))), ', ')
           || '; make it stable, then lock again' AS message
    FROM (SELECT o_custkey, unnest(CASE o_orderstatus WHEN 'F' THEN ['time'] WHEN 'O' THEN ['a GUID/hash', 'an unordered collection']
                 ELSE ['summation order'] END) AS cause FROM orders) GROUP BY o_custkey
    """,
)
def diagnose_flaky(spark, sf_dir):
    """Two runs whose finished orders differ in time, open ones in hash and list order, pending ones in the last bit."""
    orders = table(spark, sf_dir, "orders")

    def run(second: bool):
        status, key = F.col("o_orderstatus"), F.col("o_orderkey").cast("string")
        second = F.lit(second)
        return orders.select(
            "o_custkey",
            "o_orderkey",
            F.when((status == "F") & second, F.col("o_orderdate") + F.expr("INTERVAL 1 SECOND"))
            .otherwise(F.col("o_orderdate"))
            .alias("at"),
            F.md5(F.when((status == "O") & second, F.concat(key, F.lit("x"))).otherwise(key)).alias("digest"),
            F.when((status == "O") & second, F.array(F.lit("b"), F.lit("a")))
            .otherwise(F.array(F.lit("a"), F.lit("b")))
            .alias("items"),
            F.when((status == "P") & second, F.col("o_totalprice") * (1 + 1e-13))
            .otherwise(F.col("o_totalprice"))
            .alias("total"),
        )

    found = locking.diagnose_flaky(run(False), run(True), ["o_orderkey"], "o_custkey")
    return found.select("o_custkey", F.array_join("causes", ", ").alias("causes"), "message")


@query(
    "lock_batch_lk12",
    """SELECT 0 AS "position", 'orders' AS unit, TRUE AS success, 1 AS attempts, (SELECT count(*) FROM orders) AS n_entries
       UNION ALL SELECT 1, 'broken', FALSE, 1, 0
       UNION ALL SELECT 2, 'customers', TRUE, 1, (SELECT count(*) FROM customer)
       UNION ALL SELECT 3, 'late', FALSE, 0, 0""",
)
def lock_batch(spark, sf_dir):
    """Four targets: two lock, one does not resolve, one lies beyond the limit."""
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")

    def simple(df, unit, key, outcome):
        named = df.withColumn("unit", F.lit(unit))
        return locking.capture(named, lambda d: d, "unit", key, [key], [outcome])

    targets = [
        locking.Target("orders", lambda: simple(orders, "orders", "o_orderkey", "o_totalprice")),
        locking.Target("broken", lambda: simple(orders.select("no_such_column"), "broken", "o_orderkey", "x")),
        locking.Target("customers", lambda: simple(customer, "customers", "c_custkey", "c_acctbal")),
        locking.Target("late", lambda: simple(customer, "late", "c_custkey", "c_acctbal")),
    ]
    entries, results = locking.lock_batch(spark, targets, max_targets=3)
    counts = entries.groupBy(F.col("unit_id").alias("unit")).agg(F.count("*").alias("n_entries"))
    return (
        results.join(counts, "unit", "left")
        .fillna(0, ["n_entries"])
        .select("position", "unit", "success", "attempts", "n_entries")
    )


@query(
    "lock_batch_runtime_lk12",
    """SELECT 0 AS "position", 'orders' AS unit, TRUE AS success, (SELECT count(*) FROM orders) AS n_entries
       UNION ALL SELECT 1, 'ratio', FALSE, 0
       UNION ALL SELECT 2, 'customers', TRUE, (SELECT count(*) FROM customer)""",
)
def lock_batch_runtime(spark, sf_dir):
    """Three targets of one job; one divides by zero while it runs, the others are written all the same."""
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")

    def simple(df, unit, key, outcome):
        return locking.capture(df.withColumn("unit", F.lit(unit)), lambda d: d, "unit", key, [key], [outcome])

    wrong = orders.withColumn("ratio", F.expr("o_totalprice / (o_orderkey - o_orderkey)"))
    targets = [
        locking.Target("orders", lambda: simple(orders, "orders", "o_orderkey", "o_totalprice")),
        locking.Target("ratio", lambda: simple(wrong, "ratio", "o_orderkey", "ratio")),
        locking.Target("customers", lambda: simple(customer, "customers", "c_custkey", "c_acctbal")),
    ]
    path = scratch_path(spark, "batch")
    results = locking.lock_batch_to(spark, targets, path)
    counts = spark.read.parquet(path).groupBy(F.col("unit_id").alias("unit")).agg(F.count("*").alias("n_entries"))
    return results.join(counts, "unit", "left").fillna(0, ["n_entries"]).select("position", "unit", "success", "n_entries")


# --- prove ----------------------------------------------------------------------------------------------------

_ORDER_BOUNDS = {"o_totalprice": [0.0], "o_orderstatus": ["F"]}


def _order_mutations(spark, sf_dir):
    orders = derived(spark, sf_dir, "orders_v1")
    mutations = mut.mutations_for(orders, ["o_orderkey"], _ORDER_BOUNDS, "orders")
    return mut.mutate(orders, ["o_orderkey"], mutations), mutations


_LOCKED = ["o_custkey", "o_totalprice", "o_orderstatus"]


def _mutant_cases(spec: list[tuple[str, str | None]]) -> str:
    return ", ".join(f"({i}, '{kind}', {'NULL' if col is None else repr(col)})" for i, (kind, col) in enumerate(spec))


# The changes mutations_for() makes for orders_v1, in order: kind and column.
_SPEC = [
    ("null_out", "o_custkey"),
    ("off_by_one", "o_custkey"),
    ("sign_flip", "o_custkey"),
    ("null_out", "o_orderstatus"),
    ("boundary_swap", "o_orderstatus"),
    ("null_out", "o_totalprice"),
    ("off_by_one", "o_totalprice"),
    ("sign_flip", "o_totalprice"),
    ("boundary_swap", "o_totalprice"),
    ("null_out", "o_orderpriority"),
    ("row_drop", None),
    ("row_duplicate", None),
]
_SLOTS = f"""
    WITH spec(slot, kind, col) AS (VALUES {_mutant_cases(_SPEC)}),
    slotted AS (
        SELECT *, CAST(('0x' || substr(md5(CAST(o_orderkey AS STRING)), 1, 12)) AS BIGINT) % {2 * len(_SPEC)} AS slot FROM orders_v1
    ),
    before_after AS (
        SELECT 'orders-' || lpad(CAST(slot AS STRING), 3, '0') AS mutant_id, kind, s.* EXCLUDE (slot),
               CASE WHEN kind = 'null_out' AND col = 'o_custkey' THEN NULL WHEN kind = 'off_by_one' AND col = 'o_custkey' THEN o_custkey + 1
                    WHEN kind = 'sign_flip' AND col = 'o_custkey' THEN -o_custkey ELSE o_custkey END AS a_custkey,
               CASE WHEN kind = 'null_out' AND col = 'o_orderstatus' THEN NULL WHEN kind = 'boundary_swap' AND col = 'o_orderstatus' THEN 'F'
                    ELSE o_orderstatus END AS a_orderstatus,
               CASE WHEN kind = 'null_out' AND col = 'o_totalprice' THEN NULL WHEN kind = 'off_by_one' AND col = 'o_totalprice' THEN o_totalprice + 1
                    WHEN kind = 'sign_flip' AND col = 'o_totalprice' THEN 0 - o_totalprice
                    WHEN kind = 'boundary_swap' AND col = 'o_totalprice' THEN 0.0 ELSE o_totalprice END AS a_totalprice,
               CASE WHEN kind = 'null_out' AND col = 'o_orderpriority' THEN NULL ELSE o_orderpriority END AS a_orderpriority
        FROM slotted s JOIN spec USING (slot)
    )
"""


@query(
    "mutate_lk13",
    with_derived(
        "orders_v1",
        _SLOTS
        + """SELECT mutant_id, -1 AS weight, o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM before_after
             UNION ALL
             SELECT mutant_id, 1, o_orderkey, a_custkey, a_orderstatus, a_totalprice, a_orderpriority
             FROM before_after, range(CASE kind WHEN 'row_drop' THEN 0 WHEN 'row_duplicate' THEN 2 ELSE 1 END)""",
    ),
)
def mutate(spark, sf_dir):
    return _order_mutations(spark, sf_dir)[0]


_PROVED = (
    _SLOTS
    + """, proved AS (
        SELECT 'orders-' || lpad(CAST(spec.slot AS STRING), 3, '0') AS mutant_id, spec.kind, 'orders' AS file,
               CASE WHEN spec.col = 'o_orderpriority' OR count(b.mutant_id) = 0 THEN 'NoCoverage'
                    WHEN spec.kind IN ('row_drop', 'row_duplicate') OR bool_or(o_custkey IS DISTINCT FROM a_custkey
                         OR o_orderstatus IS DISTINCT FROM a_orderstatus OR o_totalprice IS DISTINCT FROM a_totalprice) THEN 'Killed'
                    ELSE 'Survived' END AS status
        FROM spec LEFT JOIN before_after b ON b.mutant_id = 'orders-' || lpad(CAST(spec.slot AS STRING), 3, '0')
        GROUP BY spec.slot, spec.kind, spec.col
    )"""
)


@query("prove_lk14", with_derived("orders_v1", _PROVED + " SELECT * FROM proved"))
def prove(spark, sf_dir):
    mutated, mutations = _order_mutations(spark, sf_dir)
    return mut.prove(mutated, ["o_orderkey"], mutations, _LOCKED)


@query(
    "prove_score_lk14",
    with_derived(
        "orders_v1",
        _PROVED
        + """ SELECT count(*) FILTER (status = 'Killed') AS killed, count(*) FILTER (status = 'Survived') AS survived,
                     count(*) FILTER (status = 'NoCoverage') AS no_coverage, 100.0 * count(*) FILTER (status = 'Killed') / count(*) AS score
              FROM proved""",
    ),
)
def prove_score(spark, sf_dir):
    mutated, mutations = _order_mutations(spark, sf_dir)
    found = scores.mutation_scores(mut.prove(mutated, ["o_orderkey"], mutations, _LOCKED))
    return found.where("is_overall").select("killed", "survived", "no_coverage", "score")


# --- scoped verify --------------------------------------------------------------------------------------------


def order_locks(spark, sf_dir, name):
    """Orders as locks of the lineage units ``o:<key>``."""
    df = derived(spark, sf_dir, name)
    unit = F.concat(F.lit("o:"), F.col("o_orderkey").cast("string"))
    labels = derived(spark, sf_dir, "lineage_units").select("unit_id", "display_name")
    return (
        df.withColumn("unit_id", unit)
        .join(labels, "unit_id")
        .select(lock_name(F.col("display_name"), F.col("unit_id")).alias("lock_name"), *df.columns)
    )


@query(
    "verify_scoped_lk10",
    with_derived(
        "orders_v1 orders_v2",
        """
        WITH locks AS (
            SELECT o_orderkey, o_custkey,
                   regexp_replace(o_orderpriority, '[^A-Za-z0-9_]', '_', 'g') || '_' || substr(sha256('o:' || CAST(o_orderkey AS STRING)), 1, 6) AS lock_name
            FROM orders
        ), affected AS (
            SELECT DISTINCT lock_name FROM locks JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
                   JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'
        )
        SELECT b.o_orderkey IS NULL AS gone, a.o_totalprice IS DISTINCT FROM b.o_totalprice AND b.o_orderkey IS NOT NULL AS price_changed,
               count(*) AS n
        FROM orders_v1 a JOIN locks USING (o_orderkey) JOIN affected USING (lock_name) LEFT JOIN orders_v2 b ON a.o_orderkey = b.o_orderkey
        GROUP BY ALL
        """,
    ),
)
def scoped(spark, sf_dir):
    """Only the orders below the changed region are verified; a short lock name may be shared by two orders."""
    lineage = derived(spark, sf_dir, "lineage_units")
    edges = derived(spark, sf_dir, "lineage_edges")
    changed = table(spark, sf_dir, "region").where("r_name = 'ASIA'").select(
        F.concat(F.lit("LAKE/region/"), "r_name", F.lit(".sql")).alias("path")
    )
    result = verify_scoped(
        order_locks(spark, sf_dir, "orders_v1"),
        order_locks(spark, sf_dir, "orders_v2"),
        ["lock_name", "o_orderkey"],
        lineage,
        edges,
        changed,
        cols=["o_totalprice"],
    )
    gone = F.col("status") == v.MISSING
    price = F.array_contains("changed_cols", "o_totalprice")
    return result.verdicts.groupBy(gone.alias("gone"), price.alias("price_changed")).agg(F.count("*").alias("n"))


# --- streaming ------------------------------------------------------------------------------------------------


def _events_stream(spark, sf_dir):
    schema = table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/events*.parquet")


@query(
    "verify_stream_st1",
    """SELECT CASE WHEN event_type = 'purchase' THEN 'changed' WHEN event_type = 'signup' THEN 'added' ELSE 'identical' END AS status,
              count(*) AS n FROM events GROUP BY 1""",
)
def verify_stream(spark, sf_dir):
    """Events of a new run as a stream against locked ones: signups are new, purchases changed."""
    locked = table(spark, sf_dir, "events").where("event_type <> 'signup'").select("event_id", "user_id", "value")
    value = F.when(F.col("event_type") == "purchase", F.col("value") + 1).otherwise(F.col("value"))
    stream = _events_stream(spark, sf_dir).withColumn("value", value).select("event_id", "user_id", "value")
    out = scratch_path(spark, "verdicts")
    gate.verify_stream(stream, locked, ["event_id"], out, scratch_path(spark, "stream")).awaitTermination()
    return spark.read.parquet(out).groupBy("status").agg(F.sum("n").alias("n"))


@query(
    "verdict_windows_st2",
    """SELECT w AS window_start, w + INTERVAL 6 HOUR AS window_end, count(*) FILTER (event_type = 'purchase') AS changed, count(*) AS total
       FROM (SELECT time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '1970-01-01') AS w, event_type FROM events)
       WHERE w + INTERVAL 6 HOUR <= (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 1 HOUR FROM events) GROUP BY w""",
)
def verdict_windows(spark, sf_dir):
    """Changed and total per six hours; windows the watermark has not passed are not out yet."""
    status = F.when(F.col("event_type") == "purchase", v.CHANGED).otherwise(v.IDENTICAL)
    stream = _events_stream(spark, sf_dir).select(F.col("ts").cast("timestamp").alias("at"), status.alias("status"))
    out = scratch_path(spark, "windows")
    gate.windows_to(
        gate.verdict_windows(stream, "at", "6 hours", "1 hour"), out, scratch_path(spark, "stream")
    ).awaitTermination()
    done = spark.read.parquet(out)
    return done.select(
        F.col("window_start").cast("timestamp_ntz").alias("window_start"),
        F.col("window_end").cast("timestamp_ntz").alias("window_end"),
        "changed",
        "total",
    )


# --- flagship -------------------------------------------------------------------------------------------------


@query(
    "revenue_drift",
    """
    WITH lines AS (
        SELECT o_custkey, CAST(l_extendedprice AS DECIMAL(14, 2)) * (1 - CAST(l_discount AS DECIMAL(4, 2))) AS v1,
               CAST(l_extendedprice AS DECIMAL(14, 2)) * (1 - CASE WHEN o_orderpriority = '1-URGENT' AND l_quantity >= 45
                    THEN CAST(0 AS DECIMAL(4, 2)) ELSE CAST(l_discount AS DECIMAL(4, 2)) END) AS v2
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey
    )
    SELECT o_custkey, CAST(sum(v1) AS DOUBLE) AS revenue_v1, CAST(sum(v2) AS DOUBLE) AS revenue_v2, CAST(sum(v2) - sum(v1) AS DOUBLE) AS drift
    FROM lines GROUP BY o_custkey HAVING sum(v1) <> sum(v2)
    """,
)
def revenue_drift(spark, sf_dir):
    """Which customers' revenue changed when the discount rule did, and by how much?"""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_extendedprice", "l_discount", "l_quantity")
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    price = F.col("l_extendedprice").cast("decimal(14,2)")
    discount = F.col("l_discount").cast("decimal(4,2)")
    waived = F.when(
        (F.col("o_orderpriority") == "1-URGENT") & (F.col("l_quantity") >= 45), F.lit(0).cast("decimal(4,2)")
    ).otherwise(discount)

    def revenue(rate):
        return joined.groupBy("o_custkey").agg(F.sum(price * (1 - rate)).alias("revenue"))

    pairs = v.paired(revenue(discount), revenue(waived), ["o_custkey"], ["revenue"])
    return pairs.where(v.is_changed(["revenue"])).select(
        "o_custkey",
        F.col("old_revenue").cast("double").alias("revenue_v1"),
        F.col("new_revenue").cast("double").alias("revenue_v2"),
        (F.col("new_revenue") - F.col("old_revenue")).cast("double").alias("drift"),
    )

