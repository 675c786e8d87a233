"""Tags, risk, ranking, selection, summaries, overlays."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftlock import vocab
from driftlock.functions import names
from driftlock.operators import risk, scores, tagging
from driftlock.operators.ordered import rank_hotspots
from driftlock.plans import analyze as plans
from driftlock.queries.registry import derived, query, table, units, with_derived
from driftlock.session import scratch_path
from driftlock.sources.baseline import write_report

# --- PRJ1, PRJ2, PRJ3 -----------------------------------------------------------------------------------------

_TOKENS = r"""string_split_regex(lower(trim(regexp_replace(regexp_replace({}, '(\p{{Ll}})(\p{{Lu}})', '\1 \2', 'g'),
              '(\p{{L}})(\p{{Nd}})', '\1 \2', 'g'))), '[^\p{{L}}\p{{Nd}}]+')"""


@query(
    "tokenize_identifier_prj1",
    f"""WITH t AS (SELECT unnest({_TOKENS.format("url")}) AS token FROM pages UNION ALL SELECT unnest({_TOKENS.format("source || c_name")}) FROM
              (SELECT source, '' AS c_name FROM documents UNION ALL SELECT 'CustOMer2X', c_name FROM customer))
        SELECT token, count(*) AS n FROM t WHERE token <> '' GROUP BY token""",
)
def tokens(spark, sf_dir):
    """Words of page addresses, document sources and customer names."""
    texts = (
        table(spark, sf_dir, "pages")
        .select(F.col("url").alias("name"))
        .unionByName(table(spark, sf_dir, "documents").select(F.col("source").alias("name")))
        .unionByName(table(spark, sf_dir, "customer").select(F.concat(F.lit("CustOMer2X"), "c_name").alias("name")))
    )
    words = texts.select(F.explode(names.tokenize_identifier(F.col("name"))).alias("token"))
    return words.groupBy("token").agg(F.count("*").alias("n"))


_KEYWORD_VALUES = ", ".join(
    f"({i}, '{tag}', '{word}')" for i, (tag, words) in enumerate(vocab.DOMAIN_KEYWORDS.items()) for word in words
)


@query(
    "tag_domains_prj2",
    f"""WITH kw(rule, tag, word) AS (VALUES {_KEYWORD_VALUES}),
             tok AS (SELECT DISTINCT doc_id, unnest({_TOKENS.format("text")}) AS token FROM documents),
             hit AS (SELECT DISTINCT doc_id, rule, tag FROM tok JOIN kw ON token = word OR (length(word) >= 4 AND starts_with(token, word)))
        SELECT d.doc_id, coalesce(string_agg(tag, '+' ORDER BY rule), '') AS tags FROM documents d LEFT JOIN hit USING (doc_id) GROUP BY d.doc_id""",
)
def tags_of_documents(spark, sf_dir):
    """Whole document texts as signals."""
    docs = tagging.tag_domains(table(spark, sf_dir, "documents").select("doc_id", "text"), ["text"])
    return docs.select("doc_id", F.array_join("tags", "+").alias("tags"))


@query(
    "tag_units_prj2",
    with_derived("unit_scores", "SELECT unit_id, tags_txt AS tags FROM unit_scores"),
)
def tags_of_units(spark, sf_dir):
    tagged = tagging.tag_domains(units(spark, sf_dir), ["method", "display_name", "usings"])
    return tagged.select("unit_id", F.array_join("tags", "+").alias("tags"))


@query(
    "detect_landmines_prj3",
    with_derived("unit_scores", "SELECT unit_id, mines_txt AS landmines FROM unit_scores"),
)
def landmines(spark, sf_dir):
    found = tagging.detect_landmines(units(spark, sf_dir))
    return found.select("unit_id", F.array_join("landmines", "+").alias("landmines"))


# --- PRJ5, PRJ6, PRJ7, PRJ8 -----------------------------------------------------------------------------------


@query(
    "classify_seamability_prj5",
    with_derived(
        "units_part",
        """SELECT unit_id, CASE WHEN seams_txt <> '' THEN 'SeamAvailable' WHEN obstacles_txt <> '' THEN 'NeedsSeam' ELSE 'Pure' END AS seamability
           FROM units_part""",
    ),
)
def seamability(spark, sf_dir):
    return units(spark, sf_dir).select(
        "unit_id", tagging.classify_seamability(F.col("obstacles"), F.col("seams")).alias("seamability")
    )


# Every event is a dependency fact of its user.
_DEPS = r"""SELECT user_id AS unit_id,
                   CASE event_type WHEN 'signup' THEN 'injected' WHEN 'purchase' THEN 'new' ELSE 'call' END AS kind,
                   CASE event_type WHEN 'signup' THEN CASE WHEN value < 5 THEN 'IDisposable' ELSE 'IPort' || CAST(k AS STRING) END
                        WHEN 'purchase' THEN CASE WHEN k > 90 THEN 'SqlConnection' ELSE 'Widget' END
                        WHEN 'click' THEN CASE WHEN k > 80 THEN 'DateTime' WHEN k > 70 THEN 'Guid' ELSE 'Helper' END
                        WHEN 'view' THEN CASE WHEN k > 85 THEN 'File' WHEN k > 75 THEN 'Console' ELSE 'Math' END ELSE 'Environment' END AS type,
                   CASE event_type WHEN 'click' THEN CASE WHEN k > 90 THEN 'UtcNow' WHEN k > 80 THEN 'Parse' ELSE 'NewGuid' END
                        WHEN 'error' THEN CASE WHEN k > 50 THEN 'MachineName' ELSE 'Exit' END ELSE 'Open' END AS member
            FROM (SELECT *, CAST(replace(replace(props, '{"k": ', ''), '}', '') AS INT) AS k FROM events)"""


@query(
    "seam_lists_prj6",
    f"""
    WITH deps AS ({_DEPS}), items AS (
        SELECT DISTINCT unit_id, CASE WHEN kind = 'injected' THEN 'seam' ELSE 'obstacle' END AS list,
               CASE WHEN kind = 'injected' AND type <> 'IDisposable' THEN type WHEN type = 'SqlConnection' THEN 'new SqlConnection'
                    WHEN type || '.' || member IN ('DateTime.UtcNow', 'Guid.NewGuid', 'Environment.MachineName') THEN type || '.' || member
                    WHEN type IN ('File', 'Console') THEN type END AS item FROM deps
    ), kept AS (SELECT * FROM items WHERE item IS NOT NULL QUALIFY row_number() OVER (PARTITION BY unit_id, list ORDER BY item) <= 6)
    SELECT u.unit_id, coalesce(string_agg(item, ',' ORDER BY item) FILTER (list = 'seam'), '') AS seams,
           coalesce(string_agg(item, ',' ORDER BY item) FILTER (list = 'obstacle'), '') AS obstacles
    FROM (SELECT DISTINCT unit_id FROM deps) u LEFT JOIN kept USING (unit_id) GROUP BY u.unit_id
    """,
)
def seam_lists(spark, sf_dir):
    table(spark, sf_dir, "events").createOrReplaceTempView("events")
    lists = tagging.seam_lists(spark.sql(_DEPS))
    return lists.select("unit_id", F.array_join("seams", ",").alias("seams"), F.array_join("obstacles", ",").alias("obstacles"))


@query(
    "target_guards_prj7",
    with_derived(
        "unit_scores",
        """SELECT unit_id, tags_txt LIKE 'io%' AS side_effecting, tags_txt IN ('money', 'auth') AS sensitive FROM unit_scores""",
    ),
)
def target_guards(spark, sf_dir):
    tagged = tagging.tag_domains(units(spark, sf_dir), ["method"])
    tags = F.col("tags")
    return tagged.select(
        "unit_id", tagging.is_side_effecting(tags).alias("side_effecting"), tagging.is_sensitive(tags).alias("sensitive")
    )


@query(
    "matches_pattern_prj8",
    with_derived(
        "units_part",
        """SELECT unit_id, CASE WHEN pattern = '' THEN FALSE WHEN pattern LIKE '%*%' THEN contains(path, 'Brand1') AND starts_with(path, 'src/SMALL')
                                ELSE contains(lower(display_name || path), 'ring.p') END AS hit
           FROM (SELECT *, CASE WHEN complexity > 30 THEN 'Src\\?mall\\brand1*' WHEN complexity > 5 THEN 'RING.p' ELSE '' END AS pattern FROM units_part)""",
    ),
)
def pattern_matches(spark, sf_dir):
    """Each unit against a pattern of its own: a glob, a plain text, or nothing."""
    pattern = F.when(F.col("complexity") > 30, "Src\\?mall\\brand1*").when(F.col("complexity") > 5, " RING.p ").otherwise(" ")
    rows = units(spark, sf_dir).withColumn("pattern", pattern)
    hit = tagging.matches_pattern(F.col("path"), F.col("pattern")) | tagging.matches_pattern(
        F.col("display_name"), F.col("pattern")
    )
    return rows.select("unit_id", hit.alias("hit"))


_PATTERNS = ["Brand1.", "*ANVIL.e*", "src/?MALL/*", "  ", "p77"]
_EXCLUDED = """(contains(lower(path), 'brand1.') OR contains(lower(unit_id), 'p77') OR contains(lower(display_name), 'anvil.e')
                OR regexp_matches(lower(path), 'src/.mall/'))"""


@query("exclude_units_jn3", with_derived("units_part", f"SELECT unit_id, path FROM units_part WHERE NOT {_EXCLUDED}"))
def exclude_units(spark, sf_dir):
    return tagging.exclude_units(units(spark, sf_dir), _PATTERNS).select("unit_id", "path")


@query("never_send_jn4", with_derived("units_part", f"SELECT unit_id, {_EXCLUDED} AS never_send FROM units_part"))
def never_send(spark, sf_dir):
    return tagging.withhold_never_send(units(spark, sf_dir), _PATTERNS).select("unit_id", "never_send")


# --- PRJ9, PRJ10 ----------------------------------------------------------------------------------------------


@query(
    "lock_names_prj9",
    """SELECT o_orderkey, regexp_replace(o_orderpriority || '.' || o_orderstatus, '[^A-Za-z0-9_]', '_', 'g') AS safe,
              substr(sha256(CAST(o_orderkey AS STRING)), 1, 6) AS hash,
              regexp_replace(o_orderpriority || '.' || o_orderstatus, '[^A-Za-z0-9_]', '_', 'g') || '_' || substr(sha256(CAST(o_orderkey AS STRING)), 1, 6)
              || '_CharacterizationTests' AS lock_name FROM orders""",
)
def lock_names(spark, sf_dir):
    display, key = F.concat_ws(".", "o_orderpriority", "o_orderstatus"), F.col("o_orderkey").cast("string")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        names.safe_id(display).alias("safe"),
        names.short_hash(key).alias("hash"),
        names.lock_name(display, key).alias("lock_name"),
    )


@query(
    "display_parts_prj10",
    """SELECT p_partkey, replace(p_name, ' ', '_') AS simple, 'Base' || p_type AS last_id,
              replace(replace(p_name, ' ', '.'), '_', '.') || '.' || p_type AS label,
              'Shop.' || p_type || CASE WHEN p_size > 30 THEN '<T>' WHEN p_size > 10 THEN '<T1, T2, T3>.Inner' ELSE '' END AS friendly
       FROM part""",
)
def display_parts(spark, sf_dir):
    name = F.replace("p_name", F.lit(" "), F.lit("_"))
    key = F.col("p_partkey").cast("string")
    snapshot = F.concat(
        F.lit("a/b.c\\"), names.lock_name(F.concat_ws(".", name, "p_type"), key), F.lit(".x.verified.txt")
    )
    arity = F.when(F.col("p_size") > 30, "`1").when(F.col("p_size") > 10, "`3+Inner").otherwise("`0")
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        names.simple_name(F.concat(F.lit("Ns.Type."), name)).alias("simple"),
        names.last_identifier(F.concat(F.lit("Lib.Base"), "p_type", F.lit(" <Map<int, A.B>>"))).alias("last_id"),
        names.snapshot_label(snapshot).alias("label"),
        names.friendly_type_name(F.concat(F.lit("Shop+"), "p_type", arity)).alias("friendly"),
    )


# --- PRJ16, PRJ17, SL, WN3, AG1, AG2 --------------------------------------------------------------------------

_NORM = """
    WITH norm AS (
        SELECT *, 2.0 * least(1.0, CAST(complexity AS DOUBLE) / 20) AS c1, CASE WHEN has_tests THEN 0.0 ELSE 2.5 END AS c2,
               1.5 * CASE n_tags WHEN 0 THEN 0.0 WHEN 1 THEN 0.75 ELSE 1.0 END AS c3,
               1.5 * least(1.0, CAST(caller_count AS DOUBLE) / 20) AS c4, 1.0 * least(1.0, CAST(line_count AS DOUBLE) / 200) AS c5,
               CASE WHEN mines_txt = '' THEN 0.0 ELSE 1.5 END AS c6,
               CASE WHEN seams_txt = '' AND obstacles_txt <> '' THEN 1 ELSE 0 END AS needs_seam
        FROM unit_scores
    ), raw AS (SELECT *, CAST(c1 AS DOUBLE) + c2 + c3 + c4 + c5 + c6 AS risk_raw FROM norm),
    scored AS (SELECT *, round_even(CAST(risk_raw AS DOUBLE) * 10, 0) / 10 AS risk FROM raw)
"""


def scored(spark, sf_dir):
    """Units tagged, flagged and scored."""
    rows = units(spark, sf_dir)
    return risk.risk_components(tagging.detect_landmines(tagging.tag_domains(rows, ["method", "display_name"])))


def _scored(body: str, also: str = "") -> str:
    return with_derived(f"unit_scores {also}".strip(), _NORM + body)


@query("risk_components_prj16", _scored("SELECT unit_id, risk, round(risk_raw, 6) AS risk_raw FROM scored"))
def risk_scores(spark, sf_dir):
    return scored(spark, sf_dir).select("unit_id", "risk", F.round("risk_raw", 6).alias("risk_raw"))


@query(
    "reason_text_prj17",
    _scored(
        """, parts AS (
            SELECT unit_id, has_tests, unnest([{'c': c1, 'i': 0, 'd': 'complexity ' || CAST(complexity AS STRING)}, {'c': c2, 'i': 1, 'd': '0 tests'},
                   {'c': c3, 'i': 2, 'd': tags_txt}, {'c': c4, 'i': 3, 'd': CAST(caller_count AS STRING) || CASE WHEN caller_count = 1 THEN ' caller' ELSE ' callers' END},
                   {'c': c5, 'i': 4, 'd': CAST(line_count AS STRING) || ' lines'}, {'c': c6, 'i': 5, 'd': mines_txt}]) AS p FROM scored
        )
        SELECT unit_id, coalesce(string_agg(p.d, ', ' ORDER BY p.c DESC, p.i) FILTER (p.c > 0), '')
               || CASE WHEN has_tests THEN CASE WHEN max(p.c) > 0 THEN ', has tests' ELSE 'has tests' END ELSE '' END AS reason
        FROM parts GROUP BY unit_id, has_tests"""
    ),
)
def reasons(spark, sf_dir):
    return scored(spark, sf_dir).select("unit_id", risk.reason_text(F.col("components")).alias("reason"))


_ORDER = "risk DESC, complexity DESC, path, start_line, unit_id"


@query("hotspots_sl1", _scored(f"SELECT unit_id, risk, complexity FROM scored ORDER BY {_ORDER} LIMIT 15"))
def top_hotspots(spark, sf_dir):
    return risk.hotspots(scored(spark, sf_dir), 15).select("unit_id", "risk", "complexity")


@query(
    "select_riskiest_sl2",
    _scored(f"SELECT unit_id, risk FROM scored WHERE NOT has_tests AND is_public ORDER BY {_ORDER} LIMIT 20"),
)
def riskiest(spark, sf_dir):
    return risk.select_riskiest(scored(spark, sf_dir), 20).select("unit_id", "risk")


@query(
    "select_targets_sl3",
    _scored("SELECT unit_id, risk FROM scored WHERE contains(lower(display_name), 'dbolt.pro') OR contains(lower(unit_id), 'dbolt.pro')"),
)
def named_targets(spark, sf_dir):
    return risk.select_targets(scored(spark, sf_dir), "dBolt.PRO", 5).select("unit_id", "risk")


@query(
    "cap_targets_sl4",
    _scored(
        f"""SELECT unit_id, (SELECT greatest(count(*) - 25, 0) FROM scored WHERE NOT has_tests) AS unlocked_count
            FROM scored WHERE NOT has_tests ORDER BY {_ORDER} LIMIT 25"""
    ),
)
def capped_targets(spark, sf_dir):
    """The selected targets next to the number of those left unlocked."""
    selected, left_out = risk.cap_targets(scored(spark, sf_dir).where("NOT has_tests"))
    rest = left_out.select("unlocked_count").first()[0]
    return selected.select("unit_id", F.lit(rest).cast("bigint").alias("unlocked_count"))


_MATCHED = _scored(
    f"""
    , matched AS (SELECT *, {_EXCLUDED} AS excluded, tags_txt LIKE 'io%' AS side FROM scored WHERE contains(lower(display_name), 'a'))
    """
)


@query(
    "plan_lock_run_sl5",
    _MATCHED
    + """SELECT count(*) AS matched, count(*) FILTER (excluded) AS excluded, count(*) FILTER (NOT excluded AND side) AS side_effecting,
                count(*) FILTER (NOT excluded AND NOT side AND tags_txt IN ('money', 'auth')) AS sensitive,
                least(count(*) FILTER (NOT excluded AND NOT side), 40) AS selected,
                greatest(count(*) FILTER (NOT excluded AND NOT side) - 40, 0) AS unlocked FROM matched""",
)
def lock_run_funnel(spark, sf_dir):
    return risk.plan_lock_run(scored(spark, sf_dir), _PATTERNS, needle="A", max_targets=40)[1]


@query(
    "plan_lock_run_selected_sl5",
    _MATCHED + "SELECT unit_id FROM matched WHERE NOT excluded AND NOT side ORDER BY path, start_line, unit_id LIMIT 40",
)
def lock_run_selected(spark, sf_dir):
    return risk.plan_lock_run(scored(spark, sf_dir), _PATTERNS, needle="A", max_targets=40)[0].select("unit_id")


@query(
    "rank_hotspots_wn3",
    _scored(f"SELECT unit_id, row_number() OVER (ORDER BY {_ORDER}) AS position FROM scored"),
)
def global_rank(spark, sf_dir):
    """Position of every unit in the whole report."""
    return rank_hotspots(scored(spark, sf_dir), risk.report_order()).select("unit_id", "position")


@query(
    "rank_hotspots_per_file_wn3",
    _scored(f"SELECT unit_id, row_number() OVER (PARTITION BY path ORDER BY {_ORDER}) AS position FROM scored"),
)
def rank_per_file(spark, sf_dir):
    return rank_hotspots(scored(spark, sf_dir), risk.report_order(), ["path"]).select("unit_id", "position")


@query(
    "readiness_summary_ag1",
    _scored(
        """SELECT count(*) AS units, count(DISTINCT lower(path)) AS files, count(*) FILTER (has_tests) AS tested,
                  count(*) FILTER (NOT has_tests AND risk_raw >= 3.5) AS high_risk_untested,
                  count(*) FILTER (NOT has_tests AND risk_raw >= 3.5 AND needs_seam = 1) AS seams_to_introduce,
                  CAST(count(*) FILTER (has_tests) AS DOUBLE) / count(*) AS behaviour_coverage FROM scored"""
    ),
)
def summary(spark, sf_dir):
    return risk.readiness_summary(scored(spark, sf_dir))


_MINES = "SELECT unnest(string_split(mines_txt, '+')) AS landmine FROM unit_scores WHERE mines_txt <> ''"


@query(
    "landmine_counts_ag2",
    with_derived("unit_scores", f"SELECT landmine, count(*) AS n FROM ({_MINES}) GROUP BY landmine"),
)
def landmine_counts(spark, sf_dir):
    return risk.landmine_counts(tagging.detect_landmines(units(spark, sf_dir)))


@query(
    "landmine_summary_ag2",
    with_derived(
        "unit_scores",
        f"""SELECT string_agg(CAST(n AS STRING) || ' ' || landmine, ', ' ORDER BY n DESC, landmine) AS summary
            FROM (SELECT landmine, count(*) AS n FROM ({_MINES}) GROUP BY landmine)""",
    ),
)
def landmine_summary(spark, sf_dir):
    return risk.landmine_summary(risk.landmine_counts(tagging.detect_landmines(units(spark, sf_dir))))


# --- AG4, JN6, AG9, SRC10, SRC11, LK15 ------------------------------------------------------------------------

_SCORES = """
    SELECT file, count(*) FILTER (status = 'Killed') AS killed, count(*) FILTER (status = 'Survived') AS survived,
           count(*) FILTER (status = 'NoCoverage') AS no_coverage, count(*) FILTER (status = 'Timeout') AS timeout,
           count(*) FILTER (status <> 'Ignored') AS tested,
           100.0 * count(*) FILTER (status IN ('Killed', 'Timeout')) / count(*) FILTER (status <> 'Ignored') AS score, file IS NULL AS is_overall
    FROM mutants_ev GROUP BY GROUPING SETS ((file), ()) HAVING count(*) FILTER (status <> 'Ignored') > 0
"""


@query("mutation_scores_ag4", with_derived("mutants_ev", _SCORES))
def mutation_scores(spark, sf_dir):
    return scores.mutation_scores(derived(spark, sf_dir, "mutants_ev"))


# Mutants of unit files: every event tests the file of one brand, whatever the case of its name.
_BRAND_MUTANTS = """SELECT CASE WHEN user_id < 75 THEN 'BRAND' ELSE 'Brand' END || CAST(1 + CAST(floor(value / 30) AS INT) AS STRING) || '.cs' AS file,
                           CASE event_type WHEN 'click' THEN 'Killed' WHEN 'view' THEN 'Survived' ELSE 'Timeout' END AS status
                    FROM events WHERE event_type <> 'signup'"""
_BRAND_SCORES = f"""
    , bm AS ({_BRAND_MUTANTS}),
    bs AS (SELECT lower(file) AS file, max(score) AS score FROM
            (SELECT file, 100.0 * count(*) FILTER (status <> 'Survived') / count(*) AS score FROM bm GROUP BY file) GROUP BY 1),
    overlaid AS (SELECT s.*, bs.score FROM scored s LEFT JOIN bs ON bs.file = lower(regexp_extract(path, '[^/]*$')))
"""


def brand_mutants(spark, sf_dir):
    table(spark, sf_dir, "events").createOrReplaceTempView("events")
    return spark.sql(_BRAND_MUTANTS)


def _brand_scores(spark, sf_dir):
    return scores.mutation_scores(brand_mutants(spark, sf_dir)).where("NOT is_overall").select("file", "score")


@query("overlay_scores_jn6", _scored(_BRAND_SCORES + "SELECT unit_id, score FROM overlaid"))
def overlay(spark, sf_dir):
    return risk.overlay_scores(scored(spark, sf_dir), _brand_scores(spark, sf_dir)).select("unit_id", "score")


@query(
    "file_rollup_ag9",
    _scored(
        _BRAND_SCORES
        + """SELECT regexp_extract(path, '[^/]*$') AS file, count(*) AS units, max(risk) AS worst_risk,
                    count(*) FILTER (NOT has_tests) AS untested, max(score) AS score FROM overlaid GROUP BY 1"""
    ),
)
def file_rollup(spark, sf_dir):
    return risk.file_rollup(risk.overlay_scores(scored(spark, sf_dir), _brand_scores(spark, sf_dir)))


@query("headline_score_ag9", _scored(_BRAND_SCORES + "SELECT round_even(avg(score), 0) AS headline FROM overlaid"))
def headline(spark, sf_dir):
    return risk.headline_score(risk.overlay_scores(scored(spark, sf_dir), _brand_scores(spark, sf_dir)))


_DASHBOARD = _scored(
    _BRAND_SCORES
    + """SELECT unit_id AS id, display_name AS name, regexp_extract(path, '[^/]*$') AS file, path, start_line AS line, signature,
                'lock --target ' || regexp_extract(display_name, '[^.]*$') AS next_step, complexity AS cx, caller_count AS blast,
                line_count AS lines, tags_txt AS tags, mines_txt AS landmines, has_tests AS tested, is_public AS entry, risk,
                round_even(score, 0) AS score,
                'complexity:' || CAST(round_even(CAST(c1 AS DOUBLE) * 100, 0) / 100 AS STRING) || ',size:' || CAST(round_even(CAST(c5 AS DOUBLE) * 100, 0) / 100 AS STRING) AS parts
         FROM overlaid"""
)


def _flat_dashboard(rows):
    part = lambda i: F.concat_ws(":", F.col("components")[i]["name"], F.col("components")[i]["contribution"].cast("string"))
    return rows.withColumns(
        {
            "tags": F.array_join("tags", "+"),
            "landmines": F.array_join("landmines", "+"),
            "parts": F.concat_ws(",", part(0), part(4)),
        }
    ).drop("components")


@query("dashboard_rows_src11", _DASHBOARD)
def dashboard(spark, sf_dir):
    return _flat_dashboard(risk.dashboard_rows(scored(spark, sf_dir), _brand_scores(spark, sf_dir)))


@query("score_overlay_lk15", _DASHBOARD)
def score_overlay(spark, sf_dir):
    """The whole composition: mutants to dashboard rows."""
    return _flat_dashboard(plans.score_overlay(scored(spark, sf_dir), brand_mutants(spark, sf_dir))["rows"])


@query(
    "report_rows_src10",
    _scored("SELECT unit_id AS unitId, display_name AS displayName, line_count AS lineCount, has_tests AS hasTests, risk, mines_txt AS landmines FROM scored"),
)
def report(spark, sf_dir):
    """The report written as JSON lines and read back."""
    path = scratch_path(spark, "report")
    rows = scored(spark, sf_dir).withColumn("landmines", F.array_join("landmines", "+"))
    write_report(rows.select("unit_id", "display_name", "line_count", "has_tests", "risk", "risk_raw", "seams", "landmines"), path)
    back = spark.read.json(path)
    return back.select("unitId", "displayName", "lineCount", "hasTests", "risk", "landmines")

