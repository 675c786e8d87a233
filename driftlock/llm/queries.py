"""One query per operator, with production parameters over whole tables, and the SQL twins that exist."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftlock.llm import align, debruijn, decontam, jaccard, licenses, line_dedup, merkle, packing, quality, repeats, ring
from driftlock.llm import secrets, toxicity
from driftlock.llm.common import documents

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLANKS = "chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)"

LINES_SQL = f"""
WITH lines AS (
  SELECT doc_id, i, line, translate(trim(line, {BLANKS}), '{UPPER}', '{LOWER}') AS k FROM (
    SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS i
    FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents))),
often AS (
  SELECT k, max(doc_id) AS owner FROM lines WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
marked AS (
  SELECT l.doc_id, l.i, l.line, o.owner IS NOT NULL AND o.owner <> l.doc_id AS gone FROM lines l LEFT JOIN often o USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


@query("op1_line_dedup", LINES_SQL)
def op1(spark, sf_dir):
    done = line_dedup.dedup_lines(documents(spark, sf_dir))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text"), 256).alias("kept_sha256"))


@query("op3_vector_packing")
def op3(spark, sf_dir):
    return packing.pack_documents(documents(spark, sf_dir))


STOP_SQL = ", ".join(f"'{w}'" for w in quality.STOP_WORDS)
QUALITY_SQL = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, [x for x in regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+') if x <> ''] AS w FROM t),
e AS (SELECT doc_id, unnest(w) AS a, generate_subscripts(w, 1) AS i FROM w),
g AS (SELECT doc_id, i, a, lead(a) OVER d AS b, lead(a, 2) OVER d AS c FROM e WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
n AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM g WHERE c IS NOT NULL),
r AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM n, (VALUES (0), (1), (2)) AS o(k) WHERE n > 1 GROUP BY doc_id),
l AS (SELECT doc_id, [x for x in string_split(t, chr(10)) if trim(x, {BLANKS}) <> ''] AS l FROM t),
m AS (
  SELECT doc_id, len(w) AS n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]+', '', 'g')) AS word_chars,
         length(t) - length(translate(t, '#*$%&|<>', '')) AS n_symbols,
         len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines,
         coalesce(n_repeat_words, 0) AS n_repeat_words,
         len(list_intersect(list_distinct(w), [{STOP_SQL}])) AS n_stop_words
  FROM t JOIN w USING (doc_id) JOIN l USING (doc_id) LEFT JOIN r USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_stop_words,
       ({" OR ".join(r.sql() for r in quality.RULES if r.base)}) AS base_failed,
       NOT ({" OR ".join(r.sql() for r in quality.RULES)}) AS kept
FROM m
"""


@query("op7_quality_rules", QUALITY_SQL)
def op7(spark, sf_dir):
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_stop_words", "base_failed", "kept"]
    return quality.verdicts(documents(spark, sf_dir)).select("doc_id", *names)


DECONTAM_SQL = f"""
WITH dw AS (
  SELECT doc_id, [x for x in regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'),
         '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') if x <> ''] AS w FROM documents),
bw AS (
  SELECT CAST(item_id AS VARCHAR) AS item, [x for x in regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'),
         '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') if x <> ''] AS w FROM benchmark),
bs AS (SELECT item, w, unnest(range(1, greatest(2, len(w) - 8))) AS i FROM bw WHERE len(w) > 0),
bk AS (SELECT DISTINCT item, array_to_string(w[i:least(len(w), i + 9)], ' ') AS k, least(len(w), 10) AS n FROM bs),
de AS (SELECT doc_id, unnest(w) AS a, generate_subscripts(w, 1) AS i FROM dw),
dk AS (
  SELECT doc_id, i, n, string_agg(a, ' ') OVER (PARTITION BY doc_id, n ORDER BY i ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS k
  FROM de, (SELECT 10 AS n)),
ds AS (
  SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS k
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, (SELECT DISTINCT n FROM bk WHERE n < 10))),
hit AS (
  SELECT doc_id, i, n, item FROM (SELECT * FROM dk UNION ALL SELECT * FROM ds) JOIN bk USING (k, n)),
words AS (
  SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM (SELECT DISTINCT doc_id, i, n FROM hit)) GROUP BY doc_id),
names AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM dw LEFT JOIN words USING (doc_id) LEFT JOIN names USING (doc_id)
"""


@query("op8_benchmark_decontamination", DECONTAM_SQL)
def op8(spark, sf_dir):
    found = decontam.find_contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )


@query("op4_ngram_jaccard_join")
def op4(spark, sf_dir):
    return jaccard.join_classes(documents(spark, sf_dir))


@query("op5_bounded_ring")
def op5(spark, sf_dir):
    sized = documents(spark, sf_dir).select(
        "doc_id",
        "text",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
    )
    return ring.assign(sized).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


CANDIDATE_SQL = secrets.CANDIDATE_RUN
SECRETS_SQL = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
p AS (
  SELECT 0 AS kind, $q${secrets.ASSIGN}$q$ AS p UNION ALL SELECT 1, 'AKIA[A-Z0-9]+' UNION ALL SELECT 2, '[0-9a-f]+'
  UNION ALL SELECT 3, $q${CANDIDATE_SQL}$q$),
m AS (
  SELECT doc_id, kind, unnest(ms) AS m, unnest(bs[:len(ms)]) AS b, generate_subscripts(ms, 1) AS i FROM (
    SELECT doc_id, kind,
           CASE kind WHEN 0 THEN regexp_extract_all(t, $q${secrets.ASSIGN}$q$) WHEN 1 THEN regexp_extract_all(t, 'AKIA[A-Z0-9]+')
                WHEN 2 THEN regexp_extract_all(t, '[0-9a-f]+') ELSE regexp_extract_all(t, $q${CANDIDATE_SQL}$q$) END AS ms,
           CASE kind WHEN 0 THEN string_split_regex(t, $q${secrets.ASSIGN}$q$) WHEN 1 THEN string_split_regex(t, 'AKIA[A-Z0-9]+')
                WHEN 2 THEN string_split_regex(t, '[0-9a-f]+') ELSE string_split_regex(t, $q${CANDIDATE_SQL}$q$) END AS bs
    FROM t, p) WHERE len(ms) > 0),
s AS (
  SELECT doc_id, kind, i, m, sum(length(b) + length(m)) OVER (PARTITION BY doc_id, kind ORDER BY i) AS e FROM m),
base AS (
  SELECT doc_id, kind, e - length(m) AS s, e FROM s
  WHERE (kind = 0 AND length(regexp_extract(m, $q${secrets.ASSIGN}$q$, 2)) >= 8) OR (kind = 1 AND length(m) >= 16)
     OR (kind = 2 AND length(m) >= 32)),
c AS (
  SELECT doc_id, i, m, e - length(m) AS s,
         CASE WHEN regexp_matches(m, '^([0-9a-f]+|[0-9A-F]+)$') THEN {secrets.most_terms(secrets.CLASS_BITS["hex"])}
              WHEN regexp_matches(m, '^[A-Za-z0-9]+$') THEN {secrets.most_terms(secrets.CLASS_BITS["letters_digits"])}
              ELSE {secrets.most_terms(secrets.CLASS_BITS["base64"])} END AS most
  FROM s WHERE kind = 3 AND regexp_matches(m, '[0-9]') AND regexp_matches(m, '[A-Za-z]')
    AND NOT ({" OR ".join(f"contains(m, '{a}')" for a in secrets.ALLOWED)} OR {" OR ".join(f"regexp_matches(m, '{a}')" for a in secrets.ALLOWED_SHAPES)})),
w AS (SELECT doc_id, i, m, s, most, unnest(range(0, length(m) - {secrets.WINDOW - 1})) AS k FROM c),
h AS (
  SELECT doc_id, i, s, most, k, ch, count(*) AS n
  FROM (SELECT doc_id, i, s, most, k, unnest(string_split(substr(m, k + 1, {secrets.WINDOW}), '')) AS ch FROM w) GROUP BY ALL),
g AS (SELECT doc_id, i, s, most, k, sum({secrets.TERMS}[n + 1]) AS total FROM h GROUP BY ALL),
extra AS (SELECT doc_id, 3 AS kind, s + min(k) AS s, s + max(k) + {secrets.WINDOW} AS e FROM g WHERE total <= most GROUP BY doc_id, i, s),
spans AS (SELECT *, {secrets.KINDS}[kind + 1] || ':' || CAST(s AS BIGINT) || ':' || CAST(e AS BIGINT) AS span FROM (SELECT * FROM base UNION ALL SELECT * FROM extra))
SELECT doc_id, count(*) FILTER (WHERE kind = 0) AS n_assign, count(*) FILTER (WHERE kind = 1) AS n_access,
       count(*) FILTER (WHERE kind = 2) AS n_hex, count(*) FILTER (WHERE kind = 3) AS n_entropy,
       sha256(coalesce(string_agg(span, ',' ORDER BY s, kind, e) FILTER (WHERE kind < 3), '')) AS base_sha256,
       coalesce(string_agg(span, ',' ORDER BY s, kind, e), '') AS spans
FROM t LEFT JOIN spans USING (doc_id) GROUP BY doc_id
"""


@query("op6_secret_scan", SECRETS_SQL)
def op6(spark, sf_dir):
    return secrets.report(documents(spark, sf_dir))


@query("op9_license_scan")
def op9(spark, sf_dir):
    return licenses.report(documents(spark, sf_dir))


@query("op10_toxicity")
def op10(spark, sf_dir):
    docs = documents(spark, sf_dir)
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score_documents(docs, model)


@query("op2_run_length_index")
def op2(spark, sf_dir):
    done = repeats.remove_repeats(documents(spark, sf_dir))
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def _sql_field(column: str) -> str:
    return f"coalesce(strlen(CAST({column} AS VARCHAR)) || ':' || {column}, '-')"


def merkle_sql(tree_levels: int = 24) -> str:
    """Level by level: nodes of all groups, then of the root, with a path of siblings that grows for every leaf."""
    fields = " || ".join(_sql_field(f) for f in merkle.FIELDS)
    other = " || ".join(_sql_field("replace(text, chr(10), '')" if f == "text" else f) for f in merkle.FIELDS)
    # The CRC of the id, bit by bit: a character is mixed in, then eight shifts.
    crc = """list_reduce(flatten([[ascii(c), -1, -1, -1, -1, -1, -1, -1, -1] for c in string_split(CAST(doc_id AS VARCHAR), '')]),
             lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, (a & 1) * 3988292384) END, 4294967295::BIGINT)"""
    steps = [
        f"""leaf AS MATERIALIZED (
  SELECT doc_id, source, sha256({fields}) AS leaf,
         sha256(CASE WHEN (4294967295 - {crc}) % 2 = 0 THEN {other} ELSE {fields} END) AS folded,
         row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, sha256({fields})) - 1 AS p, count(*) OVER (PARTITION BY source) AS n
  FROM documents)"""
    ]
    start = "SELECT source, p, n, leaf AS d FROM leaf", "SELECT doc_id, source, p, leaf, folded, '' AS proof FROM leaf"
    for k in range(tree_levels):
        nodes, path = (f"SELECT * FROM {t}{k - 1}" for t in "nw") if k else start
        if k == tree_levels // 2:
            # From here on the nodes are the digests of the groups.
            nodes = f"SELECT 0 AS source, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS p, count(*) OVER () AS n, d, source AS named FROM n{k - 1}"
            steps.append(f"s{k} AS MATERIALIZED ({nodes})")
            steps.append(f"g AS MATERIALIZED (SELECT doc_id, 0 AS source, s.p, leaf, s.d AS subroot, folded, proof FROM w{k - 1} w JOIN s{k} s ON w.source IS NOT DISTINCT FROM s.named)")
            nodes, path = f"SELECT source, p, n, d FROM s{k}", "SELECT * FROM g"
        steps.append(
            f"""x{k} AS MATERIALIZED (
  SELECT source, p, n, d, coalesce(string_agg(d, '') OVER (r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
         coalesce(string_agg(d, '') OVER (r ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
  FROM ({nodes}) WINDOW r AS (PARTITION BY source, p // {merkle.ARITY} ORDER BY p))"""
        )
        steps.append(
            f"""n{k} AS MATERIALIZED (
  SELECT source, p // {merkle.ARITY} AS p, CAST(ceil(max(n) / {merkle.ARITY}) AS BIGINT) AS n,
         CASE WHEN max(n) = 1 THEN min(d) ELSE sha256(string_agg(d, '' ORDER BY p)) END AS d FROM x{k} GROUP BY source, p // {merkle.ARITY})"""
        )
        steps.append(
            f"""w{k} AS MATERIALIZED (
  SELECT w.* REPLACE (w.p // {merkle.ARITY} AS p, CASE WHEN x.n = 1 THEN folded ELSE sha256(l || folded || r) END AS folded,
         CASE WHEN x.n = 1 THEN proof ELSE proof || l || r END AS proof)
  FROM ({path}) w JOIN x{k} x ON w.source IS NOT DISTINCT FROM x.source AND w.p = x.p)"""
        )
    last = tree_levels - 1
    return f"""WITH {", ".join(steps)}
SELECT doc_id, leaf, subroot, d AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = d AS verified FROM w{last}, n{last}"""


@query("op11_merkle_manifest", merkle_sql())
def op11(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return merkle.prove(docs, checked=merkle.without_line_feeds(docs))


@query("op12_hash_alignment")
def op12(spark, sf_dir):
    return align.align_documents(documents(spark, sf_dir))


SPANS_SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, [x for x in regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+') if x <> ''] AS w
  FROM documents),
e AS (SELECT rid, unnest(w) AS a, generate_subscripts(w, 1) AS i FROM d),
k AS (
  SELECT rid, a, i, md5(string_agg(a, ' ') OVER ahead) AS k, count(*) OVER ahead AS n
  FROM e WINDOW ahead AS (PARTITION BY rid ORDER BY i ROWS BETWEEN CURRENT ROW AND {debruijn.WINDOW - 1} FOLLOWING)),
twice AS (SELECT k FROM k WHERE n = {debruijn.WINDOW} GROUP BY k HAVING count(*) > 1),
hit AS (SELECT rid, a, i, n = {debruijn.WINDOW} AND k IN (SELECT k FROM twice) AS hit FROM k),
gone AS (
  SELECT rid, a, i, bool_or(hit) OVER (PARTITION BY rid ORDER BY i ROWS BETWEEN {debruijn.WINDOW - 1} PRECEDING AND CURRENT ROW) AS gone FROM hit),
kept AS (SELECT rid, count(*) FILTER (WHERE gone) AS n_removed, string_agg(a, ' ' ORDER BY i) FILTER (WHERE NOT gone) AS kept FROM gone GROUP BY rid)
SELECT doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (rid)
"""


@query("op13_debruijn_spans", SPANS_SQL)
def op13(spark, sf_dir):
    done = debruijn.remove_repeats(documents(spark, sf_dir))
    return done.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
