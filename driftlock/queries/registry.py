"""The registry, the tables, and the derived inputs that both engines build from the same SQL text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register a query, and its SQL twin if it has one."""

    def register(fn):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# SQL that means the same to Spark and to the checking engine, in dependency order.
DERIVED = {
    # A changed run: small pending orders gone, urgent ones dearer, the largest finished ones filed again.
    "orders_v1": """
        SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders
    """,
    "orders_v2": """
        SELECT o_orderkey, o_custkey, o_orderstatus,
               CASE WHEN o_orderpriority = '1-URGENT' THEN o_totalprice + 1.25 ELSE o_totalprice END AS o_totalprice,
               CASE WHEN o_orderpriority = '4-NOT SPECIFIED' AND o_orderstatus = 'F' THEN '4-NONE'
                    ELSE o_orderpriority END AS o_orderpriority
        FROM orders WHERE NOT (o_orderstatus = 'P' AND o_totalprice < 10000)
        UNION ALL
        SELECT -o_orderkey - 1 AS o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority
        FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 490000
    """,
    "lines_v1": """
        SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity, l_discount, l_returnflag
        FROM lineitem
    """,
    "lines_v2": """
        SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice,
               CASE WHEN l_quantity = 50 AND l_returnflag = 'R' THEN l_quantity - 1 ELSE l_quantity END AS l_quantity,
               CASE WHEN l_discount = 0 AND l_returnflag = 'A' THEN 0.01 ELSE l_discount END AS l_discount,
               l_returnflag
        FROM lineitem
        WHERE NOT (l_quantity = 1 AND l_returnflag = 'N' AND l_linestatus = 'O')
    """,
    # Units: one per part. Lists are texts joined by a comma.
    "part_use": """
        SELECT l_partkey, count(*) AS n_lines, count(DISTINCT l_suppkey) AS n_callers FROM lineitem GROUP BY l_partkey
    """,
    "units_part": """
        SELECT 'p' || CAST(p_partkey AS STRING) AS unit_id,
               replace(p_name, ' ', '') || '.' || p_type AS display_name,
               'src/' || p_type || '/' || replace(p_brand, '#', '') || '.cs' AS path,
               p_partkey + 1 AS start_line,
               p_partkey + 1 + p_size AS end_line,
               p_type || ' ' || p_name AS signature,
               p_size AS complexity,
               coalesce(n_lines, 0) AS line_count,
               coalesce(n_callers, 0) AS caller_count,
               p_brand IN ('Brand#1', 'Brand#4', 'Brand#7', 'Brand#10', 'Brand#13', 'Brand#16', 'Brand#19') AS has_tests,
               p_type IN ('ECONOMY', 'SMALL', 'PROMO', 'LARGE') AS is_public,
               CASE WHEN p_name LIKE '%bolt' THEN 'ParseCsvFile' WHEN p_name LIKE '%ring' THEN 'ValidateToken'
                    WHEN p_name LIKE '%gear' THEN 'PriceTotal' WHEN p_name LIKE '%widget' THEN 'ScheduleDateTime'
                    WHEN p_name LIKE '%anvil' THEN 'updated_HTTPServer2Path' ELSE p_name END AS method,
               CASE p_type WHEN 'ECONOMY' THEN 'System,System.ServiceModel.Channels' WHEN 'SMALL' THEN 'System.ServiceModelX'
                    WHEN 'LARGE' THEN 'Microsoft.EntityFrameworkCore' WHEN 'MEDIUM' THEN 'System.Web.UI' ELSE '' END AS usings_txt,
               CASE WHEN p_type IN ('PROMO', 'LARGE') THEN 'DbContext' WHEN p_name LIKE 'small%' THEN 'Page' ELSE '' END AS bases_txt,
               CASE WHEN p_type = 'STANDARD' THEN 'ServiceContractAttribute' ELSE 'Serializable' END AS attributes_txt,
               CASE WHEN p_size >= 40 THEN 'DateTime.Now,File' WHEN p_size >= 25 THEN 'new SqlConnection' ELSE '' END AS obstacles_txt,
               CASE WHEN p_name LIKE 'red%' THEN 'IClock' WHEN p_name LIKE 'blue%' THEN 'IStore,IClock' ELSE '' END AS seams_txt
        FROM part LEFT JOIN part_use ON p_partkey = l_partkey
    """,
    # What the units above come to, written out by hand for the checking engine.
    "unit_facts": """
        SELECT *,
               CASE WHEN method = 'ParseCsvFile' THEN 'io+data-transform' WHEN method = 'ValidateToken' THEN 'auth'
                    WHEN method = 'PriceTotal' THEN 'money' WHEN method = 'ScheduleDateTime' THEN 'date'
                    WHEN method = 'updated_HTTPServer2Path' THEN 'io' ELSE '' END AS tags_txt,
               CASE WHEN path LIKE 'src/ECONOMY/%' THEN 'WCF' WHEN path LIKE 'src/STANDARD/%' THEN 'WCF'
                    WHEN path LIKE 'src/MEDIUM/%' THEN 'WebForms' WHEN path LIKE 'src/PROMO/%' THEN 'EF6' ELSE '' END AS mines_main,
               CASE WHEN bases_txt = 'Page' AND path NOT LIKE 'src/MEDIUM/%' THEN 'WebForms' ELSE '' END AS mines_page
        FROM units_part
    """,
    "unit_scores": """
        SELECT *,
               CASE WHEN mines_main = '' THEN mines_page WHEN mines_page = '' THEN mines_main
                    ELSE mines_main || '+' || mines_page END AS mines_txt,
               CASE WHEN tags_txt = '' THEN 0 WHEN tags_txt LIKE '%+%' THEN 2 ELSE 1 END AS n_tags
        FROM unit_facts
    """,
    # Lineage as a graph: region is called by its nations, a nation by its customers, a customer by its orders.
    "lineage_units": """
        SELECT 'r:' || CAST(r_regionkey AS STRING) AS unit_id, r_name AS display_name, 'lake/region/' || r_name || '.sql' AS path FROM region
        UNION ALL
        SELECT 'n:' || CAST(n_nationkey AS STRING), n_name, 'lake/nation/' || n_name || '.sql' FROM nation
        UNION ALL
        SELECT 'c:' || CAST(c_custkey AS STRING), c_name, 'lake/customer/' || c_mktsegment || '.sql' FROM customer
        UNION ALL
        SELECT 'o:' || CAST(o_orderkey AS STRING), o_orderpriority, 'lake/orders/' || o_orderstatus || '.sql' FROM orders
    """,
    "lineage_edges": """
        SELECT 'n:' || CAST(n_nationkey AS STRING) AS caller_id, 'r:' || CAST(n_regionkey AS STRING) AS callee_id FROM nation
        UNION ALL
        SELECT 'c:' || CAST(c_custkey AS STRING), 'n:' || CAST(c_nationkey AS STRING) FROM customer
        UNION ALL
        SELECT 'o:' || CAST(o_orderkey AS STRING), 'c:' || CAST(o_custkey AS STRING) FROM orders
    """,
    # Back edges close cycles: nations call the dearest orders of their customers.
    "lineage_cycles": """
        SELECT caller_id, callee_id FROM lineage_edges
        UNION ALL
        SELECT DISTINCT 'n:' || CAST(c_nationkey AS STRING), 'o:' || CAST(o_orderkey AS STRING)
        FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 495000
    """,
    "mutants_ev": """
        SELECT 'u' || CAST(user_id AS STRING) || '.cs' AS file,
               CASE event_type WHEN 'click' THEN 'Killed' WHEN 'view' THEN 'Survived' WHEN 'purchase' THEN 'NoCoverage'
                    WHEN 'error' THEN 'Timeout' ELSE 'Ignored' END AS status
        FROM events
    """,
    "usage_conv": """
        SELECT conv_id, turn,
               CASE role WHEN 'system' THEN 'big-Opus-1' WHEN 'user' THEN 'small-haiku-2' ELSE 'mid-sonnet-3' END AS model,
               CAST(length(text) AS BIGINT) AS input_tokens, CAST(turn * 10 + 1 AS BIGINT) AS output_tokens,
               CAST(length(role) * 3 AS BIGINT) AS cache_read_tokens, CAST(length(role) AS BIGINT) AS cache_creation_tokens
        FROM conversations
    """,
    # A rule per part. The multiplier at its end decides nothing.
    "rules_part": """
        SELECT 'p' || CAST(p_partkey AS STRING) AS rule_id, p_partkey, p_size, p_brand, p_name, p_retailprice,
               'if (size >= ' || CAST(p_size AS STRING) || ' && brand == "' || p_brand || '" && price < '
               || CAST(p_retailprice AS STRING) || 'm && name.StartsWith("' || p_type || '") && name.Length <= '
               || CAST(p_size + 8 AS STRING) || ') return total * 0.25m;' AS rule_text
        FROM part
    """,
    # A second version of the documents: blank lines closed up in some, line ends changed in others.
    "docs_v2": """
        SELECT doc_id, replace(replace(text, ' en', ' EN'), 'the ', 'The ') AS text FROM documents
    """,
}


def derived(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived input as a DataFrame, built through temporary views over the tables it needs."""
    for t in TABLES:
        if _mentions(name, t):
            table(spark, sf_dir, t).createOrReplaceTempView(t)
    for d in _needs(name):
        spark.sql(DERIVED[d]).createOrReplaceTempView(d)
    return spark.table(name)


def _words(sql: str) -> set[str]:
    return set(sql.replace("(", " ").replace(")", " ").replace(",", " ").split())


def _needs(name: str) -> list[str]:
    """Derived inputs that ``name`` is built from, then ``name`` itself."""
    before = [d for d in DERIVED if d != name and d in _words(DERIVED[name])]
    out: list[str] = []
    for d in before:
        out += [x for x in _needs(d) if x not in out]
    return [*out, name]


def _mentions(name: str, base: str) -> bool:
    return any(base in _words(DERIVED[d]) for d in _needs(name))


def with_derived(names: str, body: str) -> str:
    """Oracle text: the derived inputs as common table expressions in front of ``body``."""
    ordered: list[str] = []
    for n in names.split():
        ordered += [d for d in _needs(n) if d not in ordered]
    ctes = ",\n".join(f"{d} AS ({DERIVED[d]})" for d in ordered)
    body = body.strip()
    if body.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {ctes},\n{body[len('WITH RECURSIVE'):]}"
    if body.upper().startswith("WITH"):
        return f"WITH {ctes},\n{body[len('WITH'):]}"
    return f"WITH {ctes}\n{body}"


def as_list(text: str | Column) -> Column:
    """The items of a comma-joined text; the empty text is the empty list."""
    col = F.col(text) if isinstance(text, str) else text
    return F.filter(F.split(col, ","), lambda s: s != "")


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part units with their lists as arrays."""
    return derived(spark, sf_dir, "units_part").withColumns(
        {
            "usings": as_list("usings_txt"),
            "base_types": as_list("bases_txt"),
            "attributes": as_list("attributes_txt"),
            "obstacles": as_list("obstacles_txt"),
            "seams": as_list("seams_txt"),
        }
    )
