"""Corpora, reports, pattern lists and usage logs, written from or built over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftlock.functions.text import lines_of
from driftlock.operators import scores, tagging
from driftlock.queries.registry import derived, query, table, with_derived
from driftlock.session import scratch_path
from driftlock.sources import corpus, reports


@query(
    "scan_corpus_src1",
    """SELECT lang, CAST(sum(octet_length(encode(text)) + 1) AS BIGINT) AS n_bytes, count(*) AS n_lines, sum(n) AS n_chars FROM (
         SELECT lang, text, CAST(length(text) AS BIGINT) + 1 AS n FROM documents WHERE lang NOT IN ('de', 'es')) GROUP BY lang""",
)
def scan_corpus(spark, sf_dir):
    """Documents written as a tree of text files, a folder per language, and scanned.

    The German folder is called Bin, and the Spanish one lies in a folder called obj: both are left out by the scan.
    Contents come back whole: their characters are counted, and each document has ended with one line feed.
    """
    root = scratch_path(spark, "corpus")
    docs = table(spark, sf_dir, "documents")
    for lang, folder in (("de", "Bin"), ("es", "obj/es"), ("en", "en"), ("fr", "fr")):
        docs.where(F.col("lang") == lang).select(F.regexp_replace("text", "\n", " ").alias("value")).write.text(f"{root}/{folder}")
    files = corpus.scan_corpus(spark, root, "*.txt")
    return files.groupBy(F.element_at(F.split("path", "/"), -2).alias("lang")).agg(
        F.sum("length").alias("n_bytes"),
        F.sum(F.size(F.split("content", "\n")) - 1).alias("n_lines"),
        F.sum(F.length("content")).cast("long").alias("n_chars"),
    )


@query(
    "flag_test_files_src2",
    """SELECT doc_id, source IN ('src1', 'src2') OR lang = 'es' OR contains(text, 'using Xunit') OR contains(text, 'Microsoft.VisualStudio.TestTools')
              OR contains(text, 'using NUnit') OR source = 'src9' AS is_test FROM documents""",
)
def test_files(spark, sf_dir):
    """Some sources are named like tests, one language lies in a tests folder, one source imports a framework."""
    docs = table(spark, sf_dir, "documents")
    name = F.when(F.col("source").isin("src1", "src2"), F.concat("source", F.lit("TESTS.cs"))).otherwise(
        F.concat("source", F.lit("Testing.cs"))
    )
    folder = F.when(F.col("lang") == "es", "UnitTests").otherwise("Testsuite")
    files = docs.select(
        "doc_id",
        F.concat_ws("/", F.lit("repo"), folder, name).alias("path"),
        F.when(F.col("source") == "src9", F.concat("text", F.lit("\nusing NUnit.Framework;"))).otherwise(F.col("text")).alias("content"),
    )
    return tagging.flag_test_files(files).select("doc_id", "is_test")


@query(
    "test_projects_src2",
    "SELECT c_custkey, c_mktsegment IN ('BUILDING', 'MACHINERY') AS is_test FROM customer",
)
def test_projects(spark, sf_dir):
    """Project names ending in Tests or .Test mean tests; SmokeTest does not."""
    name = (
        F.when(F.col("c_mktsegment") == "BUILDING", F.concat("c_name", F.lit("TESTS")))
        .when(F.col("c_mktsegment") == "MACHINERY", F.concat("c_name", F.lit(".test")))
        .otherwise(F.concat("c_name", F.lit("SmokeTest")))
    )
    return table(spark, sf_dir, "customer").select("c_custkey", tagging.is_test_project(name).alias("is_test"))


@query(
    "flag_generated_path_src3",
    """SELECT p_partkey, p_type IN ('SMALL', 'LARGE') OR p_brand = 'Brand#3' AS is_generated FROM part""",
)
def generated(spark, sf_dir):
    """Designer and generated suffixes, the designer folder, plain files, and no path at all."""
    kind = F.col("p_type")
    path = (
        F.when(F.col("p_brand") == "Brand#3", F.concat(F.lit("src\\my project\\"), "p_name", F.lit(".cs")))
        .when(kind == "SMALL", F.concat(F.lit("src/"), "p_name", F.lit(".G.I.cs")))
        .when(kind == "LARGE", F.concat(F.lit("src/"), "p_name", F.lit(".Designer.vb")))
        .when(kind == "PROMO", F.concat(F.lit("src/My Projects/"), "p_name", F.lit(".gg.cs")))
        .when(kind == "ECONOMY", F.lit(""))
        .when(kind == "MEDIUM", F.concat(F.lit("src/x.designer.cs/"), "p_name"))
    )
    return table(spark, sf_dir, "part").select("p_partkey", tagging.flag_generated_path(path).alias("is_generated"))


@query(
    "parse_mutants_src4",
    with_derived(
        "mutants_ev",
        "SELECT file, status, count(*) AS n FROM mutants_ev GROUP BY file, status",
    ),
)
def mutants(spark, sf_dir):
    """One JSON report per event, each with a broken file entry next to the good one."""
    events = derived(spark, sf_dir, "mutants_ev")
    body = F.concat(
        F.lit('{"schemaVersion":"1","files":{"src\\\\a/'),
        "file",
        F.lit('":{"language":"cs","mutants":[{"id":"1","status":"'),
        "status",
        F.lit('"}]},"broken.cs":5,"odd.cs":{"mutants":"none"}}}'),
    )
    parsed = reports.parse_mutants(events.select(body.alias("value")))
    return parsed.groupBy("file", "status").agg(F.count("*").alias("n"))


@query(
    "parse_coverage_src5",
    """SELECT o_orderpriority, CAST(sum(o_custkey) AS BIGINT) AS lines_covered, CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 0 ELSE o_custkey + 5 END) AS BIGINT) AS lines_valid,
              CAST(sum(CASE WHEN o_orderstatus = 'O' THEN 0 ELSE 7 END) AS BIGINT) AS branches_covered, count(*) * 9 AS branches_valid
       FROM orders GROUP BY o_orderpriority""",
)
def coverage(spark, sf_dir):
    """One coverage document per order; finished orders lack an attribute, open ones hold a broken number."""
    key = F.col("o_custkey").cast("string")
    body = F.concat(
        F.lit('<coverage lines-covered="'),
        key,
        F.when(F.col("o_orderstatus") == "F", F.lit('"')).otherwise(
            F.concat(F.lit('" lines-valid="'), (F.col("o_custkey") + 5).cast("string"), F.lit('"'))
        ),
        F.when(F.col("o_orderstatus") == "O", F.lit(' branches-covered="7.5"')).otherwise(F.lit(' branches-covered="7"')),
        F.lit(' branches-valid=" 9 " version="1"><packages><package name="a"/></packages></coverage>'),
    )
    docs = table(spark, sf_dir, "orders").select("o_orderpriority", body.alias("value"))
    totals = scores.coverage_totals(reports.parse_coverage(docs, keep=["o_orderpriority"]), ["o_orderpriority"])
    return totals.drop("line_rate", "branch_rate")


_COVERAGE = "SELECT o_custkey AS lines_covered, o_custkey + 5 AS lines_valid, 0 AS branches_covered, 0 AS branches_valid FROM orders"


@query(
    "read_coverage_src5",
    f"""SELECT CAST(sum(lines_covered) AS BIGINT) AS lines_covered, CAST(sum(lines_valid) AS BIGINT) AS lines_valid, 0 AS branches_covered, 0 AS branches_valid,
               CAST(sum(lines_covered) AS DOUBLE) / CAST(sum(lines_valid) AS DOUBLE) AS line_rate, 0.0 AS branch_rate FROM ({_COVERAGE})""",
)
def coverage_files(spark, sf_dir):
    """Coverage documents written to files and read with the XML source; branch counts are absent, so the rate is 0."""
    path = scratch_path(spark, "coverage")
    roots = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("_lines-covered"), (F.col("o_custkey") + 5).alias("_lines-valid"), F.lit("x").alias("packages")
    )
    roots.write.format("xml").option("rootTag", "reports").option("rowTag", "coverage").save(path)
    return scores.coverage_totals(reports.read_coverage(spark, path))


@query(
    "coverage_totals_ag5",
    """SELECT CAST(sum(l_linenumber) AS BIGINT) AS lines_covered, CAST(sum(l_partkey) AS BIGINT) AS lines_valid, CAST(sum(l_suppkey) AS BIGINT) AS branches_covered,
              CAST(sum(l_orderkey) AS BIGINT) AS branches_valid, CAST(sum(l_linenumber) AS DOUBLE) / CAST(sum(l_partkey) AS DOUBLE) AS line_rate,
              CAST(sum(l_suppkey) AS DOUBLE) / CAST(sum(l_orderkey) AS DOUBLE) AS branch_rate FROM lineitem""",
)
def coverage_totals(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_linenumber").alias("lines_covered"),
        F.col("l_partkey").alias("lines_valid"),
        F.col("l_suppkey").alias("branches_covered"),
        F.col("l_orderkey").alias("branches_valid"),
    )
    return scores.coverage_totals(rows)


@query(
    "distinct_patterns_src6",
    r"""
    WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
    kept AS (SELECT doc_id, pos, regexp_replace(line, '^[\s\x{A0}]+|[\s\x{A0}]+$', '', 'g') AS pattern FROM l)
    SELECT pattern FROM kept WHERE pattern <> '' AND NOT starts_with(pattern, '#')
    QUALIFY row_number() OVER (PARTITION BY lower(pattern) ORDER BY doc_id, pos) = 1
    """,
)
def patterns(spark, sf_dir):
    """All lines of all documents as one ignore list."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(lines_of(F.col("text"))).alias("pos", "line"))
    return reports.distinct_patterns(lines, "line", [F.col("doc_id"), F.col("pos")])


@query(
    "load_patterns_src6",
    """SELECT n_name AS pattern FROM nation WHERE n_name <> 'NATION_7' UNION ALL SELECT 'Nation_7' UNION ALL SELECT '#inline'""",
)
def pattern_file(spark, sf_dir):
    """An ignore file written from the nations, with comments and repeats, after inline values."""
    path = scratch_path(spark, "patterns")
    nation = table(spark, sf_dir, "nation")
    lines = F.explode(
        F.array(
            F.concat(F.lit("  "), "n_name", F.lit("\t")),
            F.concat(F.lit("# about "), "n_name"),
            F.lit(" "),
            F.col("n_name"),
        )
    )
    nation.select(lines.alias("value")).write.text(path)
    return reports.load_patterns(spark, [" Nation_7 , #inline,, "], path)


@query(
    "read_usage_log_src7",
    """SELECT conv_id, turn,
              CASE role WHEN 'user' THEN greatest(0, length(text) - turn * 100) ELSE length(text) END AS input_tokens, turn AS output_tokens,
              CASE role WHEN 'user' THEN turn * 100 WHEN 'assistant' THEN 3 ELSE 0 END AS cache_read_tokens,
              CASE role WHEN 'assistant' THEN 4 ELSE 0 END AS cache_creation_tokens FROM conversations""",
)
def usage_log(spark, sf_dir):
    """Response bodies of two providers; system turns carry a text where a number should be."""
    size, turn = F.length("text").cast("string"), F.col("turn").cast("string")
    cached = (F.col("turn") * 100).cast("string")
    body = (
        F.when(
            F.col("role") == "user",
            F.concat(
                F.lit('{"choices":[],"usage":{"prompt_tokens":'), size, F.lit(',"completion_tokens":'), turn,
                F.lit(',"prompt_tokens_details":{"cached_tokens":'), cached, F.lit("}}}"),
            ),
        )
        .when(
            F.col("role") == "assistant",
            F.concat(
                F.lit('{"content":[],"usage":{"input_tokens":'), size, F.lit(',"output_tokens":'), turn,
                F.lit(',"cache_read_input_tokens":3,"cache_creation_input_tokens":4}}'),
            ),
        )
        .otherwise(
            F.concat(
                F.lit('{"usage":{"cache_read_input_tokens":"9","input_tokens":'), size, F.lit(',"output_tokens":'), turn, F.lit("}}"),
            )
        )
    )
    provider = F.when(F.col("role") == "user", "openai").otherwise("anthropic")
    bodies = table(spark, sf_dir, "conversations").select("conv_id", "turn", body.alias("body"), provider.alias("provider"))
    return reports.read_usage_log(bodies, "body", "provider").drop("body", "provider")
