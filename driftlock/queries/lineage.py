"""Edges, scope, catalogs, enclosing spans, usage cost, windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftlock import vocab
from driftlock.functions.names import lock_name
from driftlock.operators import graph, scores
from driftlock.operators.ordered import cap_per_group, first_by_id, occurrence_no, spend_ceiling
from driftlock.functions.text import lines_of
from driftlock.queries.registry import derived, query, table, with_derived

# --- JN1, JN2, AG3 --------------------------------------------------------------------------------------------

# Units: one per part with its name and a size class as arity. References: every line item; its supplier calls the
# part's name, resolved to the part itself when the line was returned.
_UNITS = """SELECT 'p' || CAST(p_partkey AS STRING) AS unit_id,
                   CASE WHEN p_retailprice > 950 THEN p_name || ' ' || p_brand || CAST(p_retailprice AS STRING) ELSE p_name END AS name,
                   p_size AS arity FROM part"""
_REFS = """SELECT 'p' || CAST(l_suppkey AS STRING) AS caller_id, u.name, u.arity,
                  CASE WHEN l_returnflag = 'R' THEN 'p' || CAST(l_partkey AS STRING)
                       WHEN l_returnflag = 'A' AND l_linestatus = 'F' THEN 'elsewhere' || CAST(l_partkey AS STRING) END AS resolved_id
           FROM lineitem JOIN units u ON u.unit_id = 'p' || CAST(l_partkey AS STRING)"""


def call_tables(spark, sf_dir):
    table(spark, sf_dir, "part").createOrReplaceTempView("part")
    table(spark, sf_dir, "lineitem").createOrReplaceTempView("lineitem")
    units = spark.sql(_UNITS)
    units.createOrReplaceTempView("units")
    return units, spark.sql(_REFS)


_EDGES = f"""
    WITH units AS ({_UNITS}), refs AS ({_REFS}),
    uniq AS (SELECT name, arity, min(unit_id) AS callee_id FROM units GROUP BY name, arity HAVING count(*) = 1),
    edges AS (
        SELECT caller_id, resolved_id AS callee_id FROM refs WHERE resolved_id IN (SELECT unit_id FROM units) AND caller_id <> resolved_id
        UNION
        SELECT caller_id, callee_id FROM refs JOIN uniq USING (name, arity) WHERE resolved_id IS NULL AND caller_id <> callee_id
    )
"""


@query("resolve_edges_jn1", _EDGES + "SELECT caller_id, callee_id FROM edges")
def resolve_edges(spark, sf_dir):
    return graph.resolve_edges(*call_tables(spark, sf_dir))


@query(
    "blast_radius_ag3",
    _EDGES
    + """SELECT unit_id, (SELECT count(*) FROM edges e WHERE e.callee_id = unit_id) AS caller_count,
                (SELECT count(*) FROM edges e WHERE e.caller_id = unit_id) AS callee_count FROM units""",
)
def blast_radius(spark, sf_dir):
    units, refs = call_tables(spark, sf_dir)
    return graph.blast_radius(units, graph.resolve_edges(units, refs)).drop("name", "arity")


@query(
    "mark_tested_jn2",
    """SELECT p_partkey AS unit_id, p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 49 AND l_returnflag = 'R') AS has_tests
       FROM part""",
)
def mark_tested(spark, sf_dir):
    """A part counts as tested when a large returned line refers to it."""
    units = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("unit_id"))
    refs = table(spark, sf_dir, "lineitem").where("l_quantity >= 49 AND l_returnflag = 'R'")
    return graph.mark_tested(units, refs.select(F.col("l_partkey").alias("unit_id")))


# --- SRC8, JN8, JN9 -------------------------------------------------------------------------------------------


@query(
    "changed_paths_src8",
    """SELECT DISTINCT '/work tree/src/' || p_type || '/' || replace(p_brand, '#', '') || CASE WHEN p_size > 25 THEN '.CS' ELSE '.vb' END AS path
       FROM part WHERE p_size > 10""",
)
def changed_paths(spark, sf_dir):
    """Small parts are documentation files and drop out."""
    part = table(spark, sf_dir, "part")
    ext = F.when(F.col("p_size") > 25, ".CS").when(F.col("p_size") > 10, ".vb ").otherwise(".md")
    listed = part.select(
        F.concat(F.lit(" src\\"), "p_type", F.lit("/"), F.replace("p_brand", F.lit("#"), F.lit("")), ext).alias("path")
    )
    return graph.changed_paths(listed, "/work tree").distinct()


_SCOPE = """
    WITH RECURSIVE reached(unit_id) AS (
        SELECT unit_id FROM lineage_units WHERE lower(path) IN ('lake/region/asia.sql', 'lake/customer/machinery.sql')
        UNION
        SELECT e.caller_id FROM reached JOIN {edges} e ON e.callee_id = reached.unit_id
    )
"""
_CHANGED = ["lake/Region/ASIA.sql", "lake/customer/machinery.SQL"]


def _scope(spark, sf_dir, edges):
    lineage = derived(spark, sf_dir, "lineage_units")
    changed = lineage.select("path").distinct().where(F.lower("path").isin([c.lower() for c in _CHANGED]))
    return lineage, graph.change_scope(lineage, derived(spark, sf_dir, edges), changed.select(F.upper("path").alias("path")))


@query(
    "change_scope_jn8",
    with_derived("lineage_units lineage_edges", _SCOPE.format(edges="lineage_edges") + "SELECT unit_id FROM reached"),
)
def change_scope(spark, sf_dir):
    return _scope(spark, sf_dir, "lineage_edges")[1]


@query(
    "change_scope_cycles_jn8",
    with_derived("lineage_units lineage_cycles", _SCOPE.format(edges="lineage_cycles") + "SELECT unit_id FROM reached"),
)
def change_scope_cycles(spark, sf_dir):
    return _scope(spark, sf_dir, "lineage_cycles")[1]


@query(
    "scoped_locks_jn9",
    with_derived(
        "lineage_units lineage_edges",
        _SCOPE.format(edges="lineage_edges")
        + """, locks AS (
            SELECT u.unit_id, regexp_replace(display_name, '[^A-Za-z0-9_]', '_', 'g') || '_' || substr(sha256(u.unit_id), 1, 6)
                   || '_CharacterizationTests' AS lock_name FROM lineage_units u
        )
        SELECT lock_name, unit_id FROM locks WHERE lock_name IN (SELECT lock_name FROM locks JOIN reached USING (unit_id))""",
    ),
)
def scoped_locks(spark, sf_dir):
    lineage, affected = _scope(spark, sf_dir, "lineage_edges")
    locks = lineage.select(lock_name(F.col("display_name"), F.col("unit_id")).alias("lock_name"), "unit_id")
    return graph.scoped_locks(locks, lineage, affected)


# --- JN5, AG7, JN10 -------------------------------------------------------------------------------------------

# Uses: every line item uses the type of its part; returned lines live in framework assemblies.
_USES = """SELECT p_name AS type_name,
                  CASE l_returnflag WHEN 'R' THEN 'system.' || p_type WHEN 'A' THEN 'mscorlib' ELSE 'Systemic.' || p_type END AS assembly,
                  'f' || CAST(l_suppkey AS STRING) || '.cs' AS file, l_linenumber AS line,
                  CAST(l_orderkey AS STRING) || '/' || CAST(l_linenumber AS STRING) || '/' || CAST(l_partkey AS STRING) || '/' || CAST(l_suppkey AS STRING) AS seq
           FROM lineitem JOIN part ON l_partkey = p_partkey"""


def _uses(spark, sf_dir):
    table(spark, sf_dir, "part").createOrReplaceTempView("part")
    table(spark, sf_dir, "lineitem").createOrReplaceTempView("lineitem")
    return spark.sql(_USES)


_USAGE = """SELECT type_name, arg_min(assembly, seq) AS assembly, count(*) AS n_uses, arg_min(file, seq) AS file, arg_min(line, seq) AS line
            FROM uses {where} GROUP BY type_name"""


@query("api_usage_ag7", f"WITH uses AS ({_USES}) " + _USAGE.format(where=""))
def api_usage(spark, sf_dir):
    return graph.api_usage(_uses(spark, sf_dir))


@query(
    "merge_usage_ag7",
    f"""WITH uses AS ({_USES}), parts AS (
            SELECT assembly AS project, type_name, count(*) AS n, arg_min(file, seq) AS file, arg_min(line, seq) AS line FROM uses GROUP BY 1, 2
        ) SELECT type_name, min(project) AS assembly, CAST(sum(n) AS BIGINT) AS n_uses, arg_min(file, project) AS file,
                 arg_min(line, project) AS line FROM parts GROUP BY type_name""",
)
def merge_usage(spark, sf_dir):
    """Usage counted per project first, then merged; the assembly is the project here."""
    uses = _uses(spark, sf_dir)
    keyed = uses.withColumn("type_name", F.struct("assembly", "type_name"))
    parts = graph.api_usage(keyed).select(
        F.col("type_name.assembly").alias("project"), F.col("type_name.type_name").alias("type_name"),
        "assembly", "n_uses", "file", "line",
    )
    return graph.merge_usage(parts)


@query(
    "missing_in_target_jn5",
    f"WITH uses AS ({_USES}) "
    + _USAGE.format(
        where="WHERE assembly NOT LIKE 'Systemic%' AND type_name NOT IN (SELECT p_name FROM part WHERE p_size > 48)"
    ),
)
def missing_in_target(spark, sf_dir):
    catalog = table(spark, sf_dir, "part").where("p_size > 48").select(F.col("p_name").alias("type_name"))
    return graph.missing_in_target(_uses(spark, sf_dir), catalog)


@query("missing_unknown_target_jn5", f"WITH uses AS ({_USES}) SELECT count(*) AS n FROM uses WHERE 1 = 0")
def missing_unknown_target(spark, sf_dir):
    """An empty catalog: the answer is unknown, so nothing is reported."""
    catalog = table(spark, sf_dir, "part").where("p_size < 0").select(F.col("p_name").alias("type_name"))
    return graph.missing_in_target(_uses(spark, sf_dir), catalog).agg(F.count("*").alias("n"))


@query(
    "unknown_ids_jn10",
    """SELECT DISTINCT o_orderstatus AS provider, o_custkey AS model FROM orders
       WHERE o_orderstatus <> 'P' AND NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal > 0
             AND (o_orderstatus = 'F' OR c_mktsegment = 'MACHINERY'))""",
)
def unknown_ids(spark, sf_dir):
    """Customers with a balance are the catalog of finished orders, machinery ones of open orders; pending is exempt."""
    used = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("provider"), F.col("o_custkey").alias("model"))
    good = table(spark, sf_dir, "customer").where("c_acctbal > 0")
    catalog = good.select(F.lit("F").alias("provider"), F.col("c_custkey").alias("model")).unionByName(
        good.where("c_mktsegment = 'MACHINERY'").select(F.lit("O").alias("provider"), F.col("c_custkey").alias("model"))
    )
    return graph.unknown_ids(used, catalog, "model", "provider", ["P"])


# --- JN12 -----------------------------------------------------------------------------------------------------

# Per user, a day and a week are nested types; an event is a unit that lasts as many minutes as its value.
_MINUTE = "CAST(floor({epoch} / 60) AS BIGINT)"
_SPANS = """
    SELECT event_id AS unit_id, 'u' || CAST(user_id AS STRING) AS path, minute AS start_line,
           minute + CAST(floor(value * 20) AS BIGINT) AS end_line, minute FROM minutes
"""


def _span_tables(spark, sf_dir):
    minute = F.timestamp_diff("MINUTE", F.lit("1970-01-01").cast("timestamp_ntz"), "ts")
    events = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("unit_id"),
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("path"),
        minute.alias("start_line"),
        (minute + F.floor(F.col("value") * 20).cast("bigint")).alias("end_line"),
    )

    def spans(label, length):
        index = F.floor(F.col("start_line") / length).cast("bigint")
        return events.select(
            "path",
            F.concat(F.lit(label), index.cast("string")).alias("type_name"),
            (index * length).alias("start_line"),
            (index * length + length - 1).alias("end_line"),
        ).distinct()

    return events, spans("day", 1440).unionByName(spans("week", 10080))


@query(
    "attach_source_jn12",
    f"""
    WITH minutes AS (SELECT *, {_MINUTE.format(epoch="epoch(ts)")} AS minute FROM events), units AS ({_SPANS}),
    types AS (
        SELECT DISTINCT path, 'day' || CAST(minute // 1440 AS STRING) AS type_name, minute // 1440 * 1440 AS s, minute // 1440 * 1440 + 1439 AS e FROM units
        UNION
        SELECT DISTINCT path, 'week' || CAST(minute // 10080 AS STRING), minute // 10080 * 10080, minute // 10080 * 10080 + 10079 FROM units
    )
    SELECT unit_id, arg_min(type_name, e - s) AS type_name FROM units LEFT JOIN types
        ON units.path = types.path AND s <= start_line AND end_line <= e GROUP BY unit_id
    """,
)
def attach_source(spark, sf_dir):
    return graph.attach_source(*_span_tables(spark, sf_dir)).select("unit_id", "type_name")


# --- JN11, AG8, WN2 -------------------------------------------------------------------------------------------

_RATES = """CASE WHEN model LIKE '%haiku%' THEN 1 WHEN lower(model) LIKE '%opus%' THEN 5 ELSE 3 END"""
_COST = f"""CAST((input_tokens * 100 + cache_creation_tokens * 125 + cache_read_tokens * 10 + output_tokens * 500) * ({_RATES}) AS BIGINT)"""


def priced(spark, sf_dir):
    return scores.price_usage(derived(spark, sf_dir, "usage_conv"))


@query(
    "price_usage_jn11",
    with_derived("usage_conv", f"SELECT conv_id, turn, {_COST} / 100000000.0 AS cost_usd FROM usage_conv"),
)
def price_usage(spark, sf_dir):
    return priced(spark, sf_dir).select("conv_id", "turn", F.col("cost_usd").cast("double").alias("cost_usd"))


@query(
    "usage_totals_ag8",
    with_derived(
        "usage_conv",
        f"""SELECT count(*) AS calls, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens,
                   CAST(sum(cache_read_tokens) AS BIGINT) AS cache_read_tokens, CAST(sum({_COST}) AS BIGINT) / 100000000.0 AS cost_usd FROM usage_conv""",
    ),
)
def usage_totals(spark, sf_dir):
    totals = scores.usage_totals(priced(spark, sf_dir))
    return totals.withColumn("cost_usd", F.col("cost_usd").cast("double"))


_CEILING = with_derived(
    "usage_conv",
    f"""WITH c AS (SELECT conv_id, turn, {_COST} AS cost FROM usage_conv),
             s AS (SELECT *, coalesce(sum(cost) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent FROM c)
        SELECT conv_id, turn, spent / 100000000.0 AS spent_before, spent < 200000 AS admitted FROM s""",
)


@query("spend_ceiling_wn2", _CEILING)
def ceiling(spark, sf_dir):
    admitted = spend_ceiling(priced(spark, sf_dir), "0.002", ["conv_id"], [F.col("turn")])
    return admitted.select("conv_id", "turn", F.col("spent_before").cast("double").alias("spent_before"), "admitted")


@query(
    "spend_ceiling_one_run_wn2",
    with_derived(
        "usage_conv",
        f"""WITH c AS (SELECT conv_id, turn, {_COST} AS cost FROM usage_conv),
                 s AS (SELECT *, coalesce(sum(cost) OVER (ORDER BY conv_id, turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent FROM c)
            SELECT conv_id, turn, spent / 100000000.0 AS spent_before, spent < 20000000 AS admitted FROM s""",
    ),
)
def ceiling_one_run(spark, sf_dir):
    """All calls as one run: the running sum is split over range partitions."""
    admitted = spend_ceiling(priced(spark, sf_dir), "0.2", [], [F.col("conv_id"), F.col("turn")])
    return admitted.select("conv_id", "turn", F.col("spent_before").cast("double").alias("spent_before"), "admitted")


# --- WN1, WN4, WN5 --------------------------------------------------------------------------------------------


@query(
    "first_by_id_wn1",
    """SELECT o_custkey, o_orderkey, o_totalprice FROM orders
       QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1""",
)
def first_order(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    kept = first_by_id(orders, ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")])
    return kept.select("o_custkey", "o_orderkey", "o_totalprice")


@query(
    "cap_per_group_wn4",
    """SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM lineitem
       QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey) <= 6""",
)
def largest_lines(spark, sf_dir):
    """The six dearest lines of every supplier."""
    order = [F.desc("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey")]
    kept = cap_per_group(table(spark, sf_dir, "lineitem"), ["l_suppkey"], order, vocab.CANDIDATES_PER_PARAM)
    return kept.select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")


@query(
    "occurrence_no_wn5",
    r"""WITH l AS (SELECT doc_id, unnest(string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10))) AS line,
                          generate_subscripts(string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)), 1) AS pos FROM documents)
        SELECT doc_id, pos, row_number() OVER (PARTITION BY doc_id, line ORDER BY pos) AS occurrence FROM l""",
)
def line_occurrences(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(lines_of(F.col("text"))).alias("p", "line"))
    lines = lines.withColumn("pos", F.col("p") + 1)
    return occurrence_no(lines, ["doc_id"], "line", "pos").select("doc_id", "pos", "occurrence")
