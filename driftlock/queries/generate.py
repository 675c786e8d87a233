"""Literals, candidates, rows, witnesses and boundary coverage over a rule per part."""

from __future__ import annotations

from math import ceil

from pyspark.sql import functions as F

from driftlock import vocab
from driftlock.operators import generate as gen
from driftlock.queries.registry import derived, query, table, with_derived
from driftlock.session import scratch_path

RULES_PER_TASK = 500

_PARAMS = [("size", "int"), ("price", "decimal"), ("flag", "bool?"), ("kind", "enum(Small, Large, Huge)"), ("ratio", "double")]


def rules(spark, sf_dir, extra: list[tuple[str, str]] = ()):
    """The part rules with their parameters."""
    params = F.array(
        *[F.struct(F.lit(n).alias("name"), F.lit(t).alias("type")) for n, t in [*_PARAMS, *extra]]
    )
    few = derived(spark, sf_dir, "rules_part").select("rule_id", params.alias("params"), "rule_text")
    # Rules are short and expanding one takes long, so they are dealt to tasks by their number: by their bytes, adaptive
    # execution would put all into one.
    return few.repartition(max(1, ceil(few.count() / RULES_PER_TASK)), "rule_id")


def _null_text(col):
    return F.coalesce(col, F.lit("<null>"))


# --- GEN1 -----------------------------------------------------------------------------------------------------

_LITERALS = """
    SELECT rule_id, 'int' AS kind, CAST(p_size AS STRING) AS literal FROM rules_part
    UNION SELECT rule_id, 'int', CAST(p_size + 8 AS STRING) FROM rules_part
    UNION SELECT rule_id, 'string', p_brand FROM rules_part
    UNION SELECT 'p' || CAST(p_partkey AS STRING), 'string', p_type FROM part
    UNION SELECT rule_id, 'decimal', regexp_replace(CAST(p_retailprice AS STRING), '\\.0$', '') FROM rules_part
"""


@query("mine_literals_gen1", with_derived("rules_part", _LITERALS))
def literals(spark, sf_dir):
    return gen.mine_literals(rules(spark, sf_dir))


@query(
    "mine_literals_sql_gen1",
    """
    SELECT 'c' || CAST(c_custkey AS STRING) AS rule_id, 'int' AS kind, CAST(c_nationkey AS STRING) AS literal FROM customer
    UNION SELECT 'c' || CAST(c_custkey AS STRING), 'string', c_mktsegment FROM customer
    UNION SELECT 'c' || CAST(c_custkey AS STRING), 'string', c_name || '%' FROM customer
    UNION SELECT 'c' || CAST(c_custkey AS STRING), 'string', 'OTHER' FROM customer
    """,
)
def sql_literals(spark, sf_dir):
    """Rules written as SQL predicates: equality, LIKE, IN."""
    key = F.col("c_custkey").cast("string")
    text = F.concat(
        F.lit("c_nationkey <> "), F.col("c_nationkey").cast("string"), F.lit(" AND c_mktsegment IN ('"), "c_mktsegment",
        F.lit("', 'OTHER') AND c_name LIKE '"), "c_name", F.lit("%' AND c_acctbal * 0.5"),
    )
    rows = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), key).alias("rule_id"), text.alias("rule_text"))
    return gen.mine_literals(rows, "sql")


# --- GEN2, GEN3, GEN4 -----------------------------------------------------------------------------------------

_DISTINCT = "list_filter({l}, lambda x, i: list_position({l}, x) = i)"
_PRICE = "regexp_replace(CAST(p_retailprice {d} AS STRING), '\\.0$', '')"
_DECIMAL = "regexp_replace(regexp_replace(CAST(CAST(p_retailprice AS DECIMAL(20,2)) {d} AS STRING), '0+$', ''), '\\.$', '')"
_CANDS = f"""
    , lists AS (
        SELECT rule_id, p_size, [CAST(p_size - 1 AS STRING), CAST(p_size AS STRING), CAST(p_size + 1 AS STRING), CAST(p_size + 7 AS STRING),
               CAST(p_size + 8 AS STRING), CAST(p_size + 9 AS STRING), '0', '1', '-1'] AS ints,
               [{_DECIMAL.format(d="- 1")}, {_DECIMAL.format(d="")}, {_DECIMAL.format(d="+ 1")}, CAST(p_size AS STRING), CAST(p_size + 8 AS STRING), '0', '1', '-1'] AS decs
        FROM rules_part
    ), cands AS (
        SELECT rule_id, 1 AS param_no, 'size' AS param, list_slice({_DISTINCT.format(l="ints")}, 1, 6) AS vals FROM lists
        UNION ALL SELECT rule_id, 2, 'price', list_slice({_DISTINCT.format(l="decs")}, 1, 6) FROM lists
        UNION ALL SELECT rule_id, 3, 'flag', ['false', 'true'] FROM lists
        UNION ALL SELECT rule_id, 4, 'kind', ['Small', 'Large', 'Huge'] FROM lists
        UNION ALL SELECT rule_id, 5, 'ratio', ['0.0', '1.0'] FROM lists
    ), long AS (SELECT rule_id, param_no, param, unnest(vals) AS value, generate_subscripts(vals, 1) AS candidate_no FROM cands)
"""


def _with_cands(body: str) -> str:
    return with_derived("rules_part", "WITH dummy AS (SELECT 1)" + _CANDS + body)


@query("candidates_gen2", _with_cands("SELECT * FROM long"))
def candidates(spark, sf_dir):
    return gen.candidate_rows(gen.rule_candidates(rules(spark, sf_dir))).drop("type")


_STRINGS = with_derived(
    "rules_part",
    f"""
    WITH base AS (SELECT rule_id, p_size + 8 AS n, p_type, p_brand FROM (SELECT rule_id, p_partkey, p_size, p_brand FROM rules_part) JOIN (SELECT p_partkey, p_type FROM part) USING (p_partkey)),
    lists AS (
        SELECT rule_id, [substr(repeat('Ab1', 30), 1, n), substr(repeat('Ab1', 30), 1, n - 1), p_type || substr(repeat('Ab1', 30), 1, n), '12345',
               least(p_type, p_brand), greatest(p_type, p_brand), '', '<null>'] AS l FROM base
    ), d AS (SELECT rule_id, list_slice({_DISTINCT.format(l="l")}, 1, 10) AS l FROM lists)
    SELECT rule_id, unnest(l) AS value, generate_subscripts(l, 1) AS candidate_no FROM d
    """,
)


@query("string_candidates_gen3", _STRINGS)
def string_candidates(spark, sf_dir):
    """Candidates of the guarded name: witness, near miss, prefixed witness, then the mined texts."""
    found = gen.candidate_rows(gen.rule_candidates(rules(spark, sf_dir, [("name", "string")])))
    return found.where("param = 'name'").select("rule_id", "candidate_no", _null_text(F.col("value")).alias("value"))


@query(
    "extract_guards_gen4",
    with_derived(
        "rules_part",
        """SELECT rule_id, 'name' AS param, CAST(p_size + 8 AS STRING) AS lengths, p_type AS prefix, '' AS exact, TRUE AS has_guards
           FROM (SELECT rule_id, p_partkey, p_size FROM rules_part) JOIN (SELECT p_partkey, p_type FROM part) USING (p_partkey)
           UNION ALL SELECT rule_id, 'brand', '', '<null>', p_brand, FALSE FROM rules_part""",
    ),
)
def extract_guards(spark, sf_dir):
    found = gen.extract_guards(rules(spark, sf_dir, [("name", "string"), ("brand", "string")]))
    g = F.col("guards")
    return found.select(
        "rule_id",
        "param",
        F.concat_ws(",", F.transform(g["lengths"], lambda n: n.cast("string"))).alias("lengths"),
        _null_text(g["prefix"]).alias("prefix"),
        F.concat_ws(",", g["exact"]).alias("exact"),
        "has_guards",
    )


# --- GEN6, GEN7, GEN8, GEN10, SET1, SET3 ----------------------------------------------------------------------

_BASE = "string_agg(CASE WHEN l.param_no = v.param_no THEN v.value ELSE l.value END, '|' ORDER BY l.param_no)"
_ONE_HOT = f"""
    , moves AS (
        SELECT rule_id, param_no, candidate_no, value, row_number() OVER (PARTITION BY rule_id ORDER BY param_no, candidate_no) AS k
        FROM long WHERE candidate_no > 1
    ), onehot AS (
        SELECT rule_id, 1 AS row_no, string_agg(value, '|' ORDER BY param_no) AS "row" FROM long WHERE candidate_no = 1 GROUP BY rule_id
        UNION ALL
        SELECT v.rule_id, v.k + 1, {_BASE} FROM moves v JOIN long l ON l.rule_id = v.rule_id AND l.candidate_no = 1 WHERE v.k < 12 GROUP BY v.rule_id, v.k
    )
"""


def _row_text(df):
    return df.withColumn("row", F.array_join("row", "|", "<null>")).drop("origin")


@query("one_hot_rows_gen6", _with_cands(_ONE_HOT + 'SELECT rule_id, row_no, "row" FROM onehot'))
def one_hot_rows(spark, sf_dir):
    return _row_text(gen.one_hot_rows(gen.rule_candidates(rules(spark, sf_dir))))


@query(
    "struct_variants_gen7",
    with_derived(
        "rules_part",
        f"""
        WITH fields AS (
            SELECT rule_id, 1 AS param_no, list_slice({_DISTINCT.format(l="vs")}, 1, 6) AS vals FROM
                   (SELECT rule_id, ['1', CAST(p_size AS STRING), CAST(p_size + 8 AS STRING), '0', '-1'] AS vs FROM rules_part)
            UNION ALL SELECT rule_id, 2, list_slice({_DISTINCT.format(l="vs")}, 1, 6) FROM
                   (SELECT rule_id, ['1', {_DECIMAL.format(d="")}, CAST(p_size AS STRING), CAST(p_size + 8 AS STRING), '0', '-1'] AS vs FROM rules_part)
            UNION ALL SELECT rule_id, 3, ['true', 'false'] FROM rules_part
            UNION ALL SELECT rule_id, 4, ['Small', 'Large', 'Huge'] FROM rules_part
            UNION ALL SELECT rule_id, 5, ['1.0', '0.0'] FROM rules_part
        ), long AS (SELECT rule_id, param_no, unnest(vals) AS value, generate_subscripts(vals, 1) AS j FROM fields),
        moves AS (SELECT *, row_number() OVER (PARTITION BY rule_id ORDER BY j, param_no) AS k FROM long WHERE j > 1)
        SELECT rule_id, 1 AS row_no, string_agg(value, '|' ORDER BY param_no) AS "row" FROM long WHERE j = 1 GROUP BY rule_id
        UNION ALL
        SELECT v.rule_id, v.k + 1, string_agg(CASE WHEN l.param_no = v.param_no THEN v.value ELSE l.value END, '|' ORDER BY l.param_no)
        FROM moves v JOIN long l ON l.rule_id = v.rule_id AND l.j = 1 WHERE v.k < 8 GROUP BY v.rule_id, v.k
        """,
    ),
)
def struct_variants(spark, sf_dir):
    return _row_text(gen.struct_variants(rules(spark, sf_dir)))


_SHARE = "(CAST(('0x' || substr(md5(rule_id || '|{p}|' || CAST(k AS STRING)), 1, 12)) AS BIGINT) / 281474976710656.0::DOUBLE)"


@query(
    "sampled_rows_gen8",
    with_derived(
        "rules_part",
        f"""
        WITH d AS (
            SELECT rule_id, k, CAST(-5 + CAST(floor({_SHARE.format(p="size")} * (1000 + 5 + 1)) AS BIGINT) AS STRING) AS size,
                   CASE WHEN {_SHARE.format(p="flag")} < 0.5 THEN 'false' ELSE 'true' END AS flag,
                   (['Small', 'Large', 'Huge'])[1 + CAST(floor({_SHARE.format(p="kind")} * 3) AS INT)] AS kind
            FROM rules_part, range(16) t(k)
        ) SELECT DISTINCT rule_id, size, flag, kind FROM d
        """,
    ),
)
def sampled_rows(spark, sf_dir):
    """Whole numbers, flags and members of sixteen joint draws per rule; fractions are checked in the tests."""
    drawn = gen.sampled_rows(gen.rule_candidates(rules(spark, sf_dir)))
    row = F.col("row")
    return drawn.select("rule_id", row[0].alias("size"), row[2].alias("flag"), row[3].alias("kind")).distinct()


@query(
    "zip_rows_gen10",
    with_derived(
        "rules_part",
        """SELECT rule_id, r AS row_no, (['0', '1', '-1'])[r] || '|' || (['0m', '100.5m', '-1m'])[r] || '|' || (['true', 'false', 'false'])[r]
                  || '|default(enum(Small, Large, Huge))!|' || (['0.0', '1.5', '-1.0'])[r] AS "row"
           FROM rules_part, range(1, 4) t(r)""",
    ),
)
def zip_rows(spark, sf_dir):
    return _row_text(gen.zip_rows(rules(spark, sf_dir)))


@query(
    "union_candidates_set1",
    """SELECT p_partkey, CASE WHEN p_brand = p_type THEN p_brand ELSE p_brand || ',' || p_type END
              || CASE WHEN p_name IN (p_brand, p_type) THEN '' ELSE ',' || p_name END || ',x' AS merged FROM part""",
)
def union_candidates(spark, sf_dir):
    """Two lists with repeats merged in first order."""
    merged = gen.union_candidates(F.array("p_brand", "p_type", "p_brand"), F.array("p_name", "p_type", F.lit("x")))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(merged, ",").alias("merged"))


@query(
    "already_seen_set3",
    _with_cands(
        _ONE_HOT
        + """SELECT rule_id, row_no, "row" FROM onehot o
           ANTI JOIN (SELECT DISTINCT rule_id, "row" FROM onehot WHERE row_no <= 3) i USING (rule_id, "row")"""
    ),
)
def unseen_rows(spark, sf_dir):
    """One-hot rows except those the first three already cover. They are needed twice, so they are stored."""
    made = scratch_path(spark, "one-hot")
    gen.one_hot_rows(gen.rule_candidates(rules(spark, sf_dir))).write.parquet(made)
    rows = spark.read.parquet(made)
    return _row_text(gen.already_seen(rows, rows.where("row_no <= 3")))


_GUARD_PATTERNS = ["^red .+", "(bolt|gear)$", "[aeiou]{3}", "(?<open>x)(?(open)y|z)"]
_LONG, _SHORT = ("Ab1" * 7)[:20], ("Ab1" * 7)[:19]


@query(
    "regex_guards_gen3",
    f"""
    WITH w AS ({" UNION ALL ".join(
        f"SELECT '{p}' AS pattern, min(p_name) FILTER (regexp_matches(p_name, '{p}')) AS hit, min(p_name) FILTER (NOT regexp_matches(p_name, '{p}')) AS miss FROM part"
        for p in _GUARD_PATTERNS[:3]
    )}),
    r AS (SELECT 'p' || CAST(p_partkey AS STRING) AS rule_id, list_extract({_GUARD_PATTERNS!r}, 1 + p_partkey % 4) AS pattern FROM part)
    SELECT rule_id, array_to_string(list_transform(list_distinct_first, lambda x: coalesce(x, '<null>')), '|') AS candidates, 0 AS left_out FROM (
        SELECT rule_id, list_concat(['{_LONG}', '{_SHORT}'], list_filter([hit, miss], lambda x: x IS NOT NULL), ['12345', r.pattern, '', NULL]) AS list_distinct_first
        FROM r LEFT JOIN w ON w.pattern = r.pattern)
    """,
)
def regex_guards(spark, sf_dir):
    """Rules that match a name: the names of parts that do and don't are among its values, and of a pattern that the
    engine doesn't know there are none."""
    parts = table(spark, sf_dir, "part")
    pattern = F.element_at(F.array(*[F.lit(p) for p in _GUARD_PATTERNS]), (F.lit(1) + F.col("p_partkey") % 4).cast("int"))
    text = F.concat(F.lit('if (Regex.IsMatch(name, "'), pattern, F.lit('")) return 1;'))
    params = F.array(F.struct(F.lit("name").alias("name"), F.lit("string").alias("type")))
    few = parts.select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("rule_id"), params.alias("params"), text.alias("rule_text"))
    made = few.repartition(max(1, ceil(few.count() / RULES_PER_TASK)), "rule_id")
    found = gen.pattern_witness(parts, "p_name", gen.rule_patterns(made))
    done = gen.rule_candidates(made, regex_witnesses=gen.witness_dictionary(found))
    values = F.array_join(F.transform(F.col("found.candidates")[0], _null_text), "|")
    return done.select("rule_id", values.alias("candidates"), F.col("found.left_out")[0].alias("left_out"))


# --- GEN5, GEN11 ----------------------------------------------------------------------------------------------

# One pattern that never matches, one that always does.
_WITNESS_PATTERNS = ["^red ", "(bolt|gear)$", "[aeiou]{3}", "^.+ .+$", "l{2}", "^(new|old) (ring|plate)$", "^[a-z]{3} "]


@query(
    "pattern_witness_gen5",
    " UNION ALL ".join(
        f"""SELECT '{p}' AS pattern, min(p_name) FILTER (regexp_matches(p_name, '{p}')) AS match, min(p_name) FILTER (NOT regexp_matches(p_name, '{p}')) AS non_match,
                   count(*) FILTER (regexp_matches(p_name, '{p}')) AS n_match, count(*) FILTER (NOT regexp_matches(p_name, '{p}')) AS n_non_match FROM part"""
        for p in _WITNESS_PATTERNS
    ),
)
def pattern_witness(spark, sf_dir):
    return gen.pattern_witness(table(spark, sf_dir, "part"), "p_name", _WITNESS_PATTERNS)


_BOUNDS = """
    WITH bounds AS (
        SELECT rule_id, 'p_size' AS param, CAST(p_size AS DOUBLE) AS literal FROM rules_part
        UNION SELECT rule_id, 'p_retailprice', p_retailprice FROM rules_part
    ), hist AS (
        SELECT 'p_size' AS param, CAST(p_size AS DOUBLE) AS v, count(*) AS n FROM part GROUP BY p_size
        UNION ALL SELECT 'p_retailprice', p_retailprice, count(*) FROM part GROUP BY p_retailprice
    ), marks AS (SELECT DISTINCT param, literal FROM bounds), placed AS (
        SELECT m.param, m.literal, CAST(coalesce(sum(n) FILTER (v < literal), 0) AS BIGINT) AS n_below, CAST(coalesce(sum(n) FILTER (v = literal - 1), 0) AS BIGINT) AS n_at_minus_1,
               CAST(coalesce(sum(n) FILTER (v = literal), 0) AS BIGINT) AS n_at, CAST(coalesce(sum(n) FILTER (v = literal + 1), 0) AS BIGINT) AS n_at_plus_1,
               CAST(coalesce(sum(n) FILTER (v > literal), 0) AS BIGINT) AS n_above
        FROM marks m JOIN hist USING (param) GROUP BY m.param, m.literal
    ) SELECT rule_id, param, literal, n_below, n_at_minus_1, n_at, n_at_plus_1, n_above FROM bounds JOIN placed USING (param, literal)
"""


@query("boundary_coverage_gen11", with_derived("rules_part", _BOUNDS))
def boundary_coverage(spark, sf_dir):
    """Boundaries of the rules against the parts themselves."""
    found = gen.mine_boundaries(rules(spark, sf_dir))
    named = found.where(F.col("param").isin("size", "price")).withColumn(
        "param", F.when(F.col("param") == "size", "p_size").otherwise("p_retailprice")
    )
    return gen.boundary_coverage(table(spark, sf_dir, "part").select("p_size", "p_retailprice"), named)


@query(
    "sampled_rows_whole_gen8",
)
def sampled_rows_whole(spark, sf_dir):
    """All columns of the draws, fractions included."""
    return _row_text(gen.sampled_rows(gen.rule_candidates(rules(spark, sf_dir)), vocab.SAMPLED_ROWS))
