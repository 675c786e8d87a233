"""Scrubbing, code and log extraction, complexity, line deltas, egress audit."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftlock.functions.scrub import scrub
from driftlock.functions.text import broken_files, extract_code, extract_diagnostics, file_diagnostics, lexical_complexity, tail_lines
from driftlock.operators.textdiff import line_delta, unified_diff
from driftlock.plans.analyze import egress_payload
from driftlock.queries.registry import derived, query, table, with_derived

# --- PRJ11 ----------------------------------------------------------------------------------------------------

_WORD = "(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|client[_-]?secret)"
# The same shapes without look-around: the driver texts hold no value that is redacted already.
_SQL_SHAPES = [
    (r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----[\s\S]*?-----END [A-Z0-9 ]*PRIVATE KEY-----", "[REDACTED]"),
    (r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{4,}", "[REDACTED]"),
    (r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b", "[REDACTED]"),
    (r"\bsk-[A-Za-z0-9_-]{16,}", "[REDACTED]"),
    (rf'(?i)({_WORD}"?\s*[:=]\s*)"[^"]+"', r'\1"[REDACTED]"'),
    (rf"(?i)({_WORD}'?\s*[:=]\s*)'[^']+'", r"\1'[REDACTED]'"),
    (r"(?i)\b((?:password|pwd)\s*=\s*)[^;\"'\s]+", r"\1[REDACTED]"),
]


def _sql_text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _scrub_sql(source: str, key: str) -> str:
    stages = [f"WITH s0 AS (SELECT {key}, text, 0 AS n FROM {source})"]
    for i, (pattern, replacement) in enumerate(_SQL_SHAPES):
        p, r = _sql_text(pattern), _sql_text(replacement)
        stages.append(
            f"s{i + 1} AS (SELECT {key}, regexp_replace(text, {p}, {r}, 'g') AS text, n + len(regexp_extract_all(text, {p})) AS n FROM s{i})"
        )
    return ",\n".join(stages) + f"\nSELECT {key}, text, n AS redactions FROM s{len(_SQL_SHAPES)}"


@query("scrub_documents_prj11", _scrub_sql("documents", "doc_id"))
def scrub_documents(spark, sf_dir):
    return scrub(table(spark, sf_dir, "documents").select("doc_id", "text"), ["text"])


@query("scrub_pages_prj11", _scrub_sql("(SELECT page_id, html AS text FROM pages)", "page_id"))
def scrub_pages(spark, sf_dir):
    return scrub(table(spark, sf_dir, "pages").select("page_id", F.col("html").alias("text")), ["text"])


# --- PRJ12, PRJ13 ---------------------------------------------------------------------------------------------


@query(
    "extract_code_prj12",
    """SELECT conv_id, turn, CASE role WHEN 'user' THEN regexp_replace(text, '^\\s+|\\s+$', '', 'g')
                                  WHEN 'assistant' THEN 'class A {' || chr(10) || regexp_replace(text, '^\\s+|\\s+$', '', 'g') || chr(10) || '}'
                                  ELSE 'using X;' || chr(10) || regexp_replace(text, '^\\s+|\\s+$', '', 'g') END AS code
       FROM conversations""",
)
def code_of_replies(spark, sf_dir):
    """Assistant turns inside a fence, system turns after a line of prose, user turns as they are."""
    text = F.regexp_replace("text", r"^\s+|\s+\z", "")
    reply = (
        F.when(F.col("role") == "user", F.concat(F.lit("\n "), text, F.lit("\n\n")))
        .when(
            F.col("role") == "assistant",
            F.concat(F.lit("Here you go:\n```CSharp \nclass A {\n"), text, F.lit("\n}\n```\nDone.")),
        )
        .otherwise(F.concat(F.lit("Sure, this is it:\r\nusing X;\r\n"), text))
    )
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", extract_code(reply).alias("code"))


@query(
    "extract_diagnostics_prj13",
    """
    WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
    e AS (SELECT doc_id, pos, length(line) AS n FROM l WHERE length(line) > 200),
    firsts AS (SELECT doc_id, n, min(pos) AS pos, row_number() OVER (PARTITION BY doc_id ORDER BY min(pos)) AS rank FROM e GROUP BY doc_id, n),
    kept AS (SELECT doc_id, pos, regexp_replace(line, '\\s+$', '') AS line FROM l WHERE regexp_replace(line, '\\s+$', '') <> ''),
    tails AS (SELECT doc_id, line, pos FROM kept QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY pos DESC) <= 30)
    SELECT doc_id, string_agg('src/f' || CAST(n AS STRING) || '.cs(1,2): error CS0103: x', chr(10) ORDER BY pos) FILTER (WHERE rank <= 25) AS diagnostics,
           string_agg('src/f' || CAST(n AS STRING) || '.cs', ',' ORDER BY pos) AS broken FROM firsts GROUP BY doc_id
    UNION ALL
    SELECT doc_id, string_agg(line, chr(10) ORDER BY pos), '' FROM tails WHERE doc_id NOT IN (SELECT doc_id FROM e) GROUP BY doc_id
    """,
)
def diagnostics(spark, sf_dir):
    """Document lines as a build log: every long line is a compiler error in a file named by its length."""
    lines = F.split("text", "\n")
    log = F.array_join(
        F.transform(
            lines,
            lambda line: F.when(
                F.length(line) > 200,
                F.concat(F.lit("  src/f"), F.length(line).cast("string"), F.lit(".cs(1,2): error CS0103: x ")),
            ).otherwise(line),
        ),
        "\n",
    )
    logs = table(spark, sf_dir, "documents").select("doc_id", log.alias("log"))
    files = broken_files(F.col("log"))
    return logs.select(
        "doc_id",
        F.array_join(extract_diagnostics(F.col("log"), "error CS"), "\n").alias("diagnostics"),
        F.array_join(files, ",").alias("broken"),
    )


@query(
    "file_diagnostics_prj13",
    """
    WITH l AS (SELECT doc_id, length(unnest(string_split(text, chr(10)))) AS n, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
    firsts AS (SELECT doc_id, n, n % 3 AS f, min(pos) AS pos FROM l WHERE n > 20 GROUP BY doc_id, n),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id, f ORDER BY pos) AS rank FROM firsts)
    SELECT doc_id, 'src/File' || CAST(f AS STRING) || '.cs' AS file, count(*) AS n_errors,
           string_agg('src/File' || CAST(f AS STRING) || '.cs(' || CAST(n AS STRING) || ',1): error CS' || CAST(n AS STRING) || ': x', chr(10) ORDER BY pos) AS errors
    FROM ranked WHERE rank <= 10 GROUP BY doc_id, f
    """,
)
def per_file_diagnostics(spark, sf_dir):
    """Lines of documents as errors in one of three files: at most ten of each."""

    def error(line):
        n = F.length(line)
        return F.concat(F.lit("  src/File"), (n % 3).cast("string"), F.lit(".cs("), n.cast("string"), F.lit(",1): error CS"), n.cast("string"), F.lit(": x "))

    log = F.array_join(F.transform(F.split("text", "\n"), lambda line: F.when(F.length(line) > 20, error(line)).otherwise("ok")), "\n")
    found = table(spark, sf_dir, "documents").select("doc_id", F.explode(file_diagnostics(log)).alias("d"))
    return found.select("doc_id", "d.file", F.size("d.errors").alias("n_errors"), F.array_join("d.errors", "\n").alias("errors"))


@query(
    "tail_lines_prj13",
    """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
            kept AS (SELECT doc_id, pos, regexp_replace(line, '\\s+$', '') AS line FROM l WHERE regexp_replace(line, '\\s+$', '') <> '')
       SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) AS tail FROM
              (SELECT * FROM kept QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY pos DESC) <= 3) GROUP BY doc_id""",
)
def tails(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.array_join(tail_lines(F.col("text"), 3), "\n").alias("tail")).where("tail <> ''")


# --- PRJ4 -----------------------------------------------------------------------------------------------------

_NOISE = r"//[^\n]*|/\*[\s\S]*?\*/|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)'"
_DECIDE = r"\b(?:if|while|for|foreach|case|catch|when|and|or)\b|&&|\|\||\?\?=?|\s\?(?:[^?.\[]|$)"


@query(
    "lexical_complexity_prj4",
    f"""SELECT page_id, len(regexp_extract_all(regexp_replace(html, {_sql_text(_NOISE)}, ' ', 'g'), {_sql_text(_DECIDE)})) + 1 AS complexity_lex FROM pages
        UNION ALL
        SELECT -doc_id - 1, len(regexp_extract_all(regexp_replace(text, {_sql_text(_NOISE)}, ' ', 'g'), {_sql_text(_DECIDE)})) + 1 FROM documents""",
)
def complexity(spark, sf_dir):
    """Whole pages and documents as source text."""
    texts = (
        table(spark, sf_dir, "pages")
        .select("page_id", F.col("html").alias("text"))
        .unionByName(table(spark, sf_dir, "documents").select((-F.col("doc_id") - 1).alias("page_id"), "text"))
    )
    return texts.select("page_id", lexical_complexity(F.col("text")).alias("complexity_lex"))


# --- LK4, LK5 -------------------------------------------------------------------------------------------------


def changed_documents(spark, sf_dir, tasks=None):
    """Pairs that differ. With a number of tasks, the shuffle that the join needs anyway deals them to so many."""
    old = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("old"))
    new = derived(spark, sf_dir, "docs_v2").withColumnRenamed("text", "new")
    if tasks:
        old, new = old.repartition(tasks, "doc_id"), new.repartition(tasks, "doc_id")
    return old.join(new, "doc_id").where("old <> new")


@query(
    "line_delta_lk4",
    with_derived(
        "docs_v2",
        """
        WITH pairs AS (SELECT d.doc_id, d.text AS old, n.text AS new FROM documents d JOIN docs_v2 n USING (doc_id) WHERE d.text <> n.text),
        lines AS (
            SELECT doc_id, '-' AS side, unnest(string_split(old, chr(10))) AS line, generate_subscripts(string_split(old, chr(10)), 1) AS line_no FROM pairs
            UNION ALL
            SELECT doc_id, '+', unnest(string_split(new, chr(10))), generate_subscripts(string_split(new, chr(10)), 1) FROM pairs
        ), counted AS (
            SELECT *, row_number() OVER (PARTITION BY doc_id, line, side ORDER BY line_no) AS occurrence,
                   count(*) FILTER (side = '-') OVER (PARTITION BY doc_id, line) AS n_old, count(*) FILTER (side = '+') OVER (PARTITION BY doc_id, line) AS n_new
            FROM lines
        )
        SELECT doc_id, side, line_no, line FROM counted WHERE occurrence > CASE side WHEN '-' THEN n_new ELSE n_old END
        """,
    ),
)
def document_line_delta(spark, sf_dir):
    return line_delta(changed_documents(spark, sf_dir), ["doc_id"])


@query("unified_diff_lk5")
def document_diff(spark, sf_dir):
    """Exact hunks of every changed document; checked against brute force in the tests."""
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return unified_diff(changed_documents(spark, sf_dir, tasks), ["doc_id"])


def _desks(spark, sf_dir, version, name):
    """The orders of a desk as one text: numbered lines in order, each of them once."""
    price = F.round(F.col("o_totalprice") * 100).cast("bigint").cast("string")
    line = F.concat_ws(" ", F.col("o_orderkey").cast("string"), "o_orderpriority", price)
    lines = F.array_sort(F.collect_list(F.struct(F.col("o_orderkey").alias("k"), line.alias("line"))))
    orders = derived(spark, sf_dir, version).withColumn("desk", F.floor(F.col("o_custkey") / 50).cast("bigint"))
    return orders.groupBy("desk").agg(F.array_join(lines["line"], "\n").alias(name))


@query(
    "unified_diff_numbered_lk5",
    with_derived(
        "orders_v1 orders_v2",
        """
        WITH o AS (
            SELECT o_custkey // 50 AS desk, o_orderkey AS k,
                   o_orderkey || ' ' || o_orderpriority || ' ' || CAST(round(o_totalprice * 100) AS BIGINT) AS line FROM orders_v1),
        n AS (
            SELECT o_custkey // 50 AS desk, o_orderkey AS k,
                   o_orderkey || ' ' || o_orderpriority || ' ' || CAST(round(o_totalprice * 100) AS BIGINT) AS line FROM orders_v2),
        edits AS (
            SELECT desk, k, line, CASE WHEN line = other THEN 2 ELSE 0 END AS kind
            FROM (SELECT o.desk, o.k, o.line, n.line AS other FROM o LEFT JOIN n USING (desk, k))
            UNION ALL
            SELECT desk, k, line, 1 FROM (SELECT n.desk, n.k, n.line, o.line AS other FROM n LEFT JOIN o USING (desk, k))
            WHERE other IS NULL OR other <> line),
        placed AS (
            SELECT *, min(CASE WHEN kind = 2 THEN k END) OVER (PARTITION BY desk ORDER BY k RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS next
            FROM edits WHERE desk IN (SELECT desk FROM o) AND desk IN (SELECT desk FROM n)),
        near AS (
            SELECT *, bool_or(kind < 2) OVER (o ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS near, row_number() OVER o AS i
            FROM placed WINDOW o AS (PARTITION BY desk ORDER BY next NULLS LAST, kind, k)),
        shown AS (SELECT *, lag(near) OVER (PARTITION BY desk ORDER BY i) AS before FROM near)
        SELECT desk, string_agg(CASE WHEN NOT before THEN '  …' || chr(10) ELSE '' END || ['- ', '+ ', '  '][kind + 1] || line, chr(10) ORDER BY i) AS diff
        FROM shown WHERE near GROUP BY desk
        """,
    ),
)
def numbered_diff(spark, sf_dir):
    """Lines that are single and ascend on both sides have one longest common subsequence, so SQL can tell the hunks."""
    old, new = (_desks(spark, sf_dir, *x) for x in (("orders_v1", "old"), ("orders_v2", "new")))
    return unified_diff(old.join(new, "desk").where("old <> new"), ["desk"])


# --- PRJ15 ----------------------------------------------------------------------------------------------------


@query(
    "egress_payload_prj15",
    """
    WITH t AS (
        SELECT doc_id, 'namespace: ' || lang || chr(10) || 'type: ' || source || chr(10) || 'unit: d' || CAST(doc_id AS STRING) || chr(10)
               || 'calls: label; ' || lang || chr(10) || 'source:' || chr(10) || text AS text
        FROM documents WHERE lang <> 'fr' AND source NOT LIKE '%src7%'
    )
    """.strip()
    + ",\n"
    + _scrub_sql("t", "doc_id").removeprefix("WITH ").replace("SELECT doc_id, text, n AS redactions", "SELECT 'd' || CAST(doc_id AS STRING) AS unit_id, text, n AS redactions, length(text) AS n_chars"),
)
def payload(spark, sf_dir):
    """What would leave: French documents and one source are never sent."""
    docs = table(spark, sf_dir, "documents").select(
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("unit_id"),
        F.concat_ws("/", F.lit("lake"), "lang", "source").alias("path"),
        F.col("source").alias("display_name"),
        F.col("lang").alias("namespace"),
        F.col("source").alias("type_name"),
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("signature"),
        F.array(F.lit("label"), F.col("lang")).alias("callees"),
        F.col("text").alias("source"),
    )
    return egress_payload(docs, ["lake/fr/", "*src7*"])
