"""Call or lineage graph: edges, blast radius, change scope, enclosing spans, catalog look-ups."""

from __future__ import annotations

import uuid
from functools import reduce
from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftlock import vocab
from driftlock.functions.names import lock_name
from driftlock.operators.lookup import BROADCAST_ROWS, HOT_SALTS, hot_keys, lookup_join
from driftlock.session import cut_lineage, scratch_path

# --- JN1, JN2, AG3 --------------------------------------------------------------------------------------------


REFS_PER_TASK = 500_000


def resolve_edges(units: DataFrame, refs: DataFrame) -> DataFrame:
    """JN1: ``(caller_id, callee_id)`` from references ``(caller_id, name, arity, resolved_id)``.

    A resolved reference counts when its id is a unit. An unresolved one falls back to the unit with that name and
    arity when there is exactly one. No unit calls itself. References are made distinct first, and a name that
    very many references share is split over tasks.

    Pairs are made distinct in as many tasks as the number of references asks for. Ids pack so well that adaptive
    execution, which goes by packed bytes, would leave a few tasks with a share of all pairs each.
    """
    tasks = max(1, ceil(refs.count() / REFS_PER_TASK))

    def distinct(pairs: DataFrame) -> DataFrame:
        return pairs.repartition(tasks, *pairs.columns).distinct()

    ids = units.select("unit_id").distinct()
    resolved = refs.where(F.col("resolved_id").isNotNull()).select("caller_id", F.col("resolved_id").alias("callee_id"))
    exact = (
        distinct(resolved.where(F.col("caller_id") != F.col("callee_id")))
        .join(ids.select(F.col("unit_id").alias("callee_id")), "callee_id", "left_semi")
        .select("caller_id", "callee_id")
    )
    # min equals the only id when the count is one.
    unique = (
        units.select("unit_id", "name", "arity")
        .distinct()
        .groupBy("name", "arity")
        .agg(F.count("*").alias("n"), F.min("unit_id").alias("callee_id"))
        .where("n = 1")
        .drop("n")
    )
    named = distinct(refs.where(F.col("resolved_id").isNull()).select("caller_id", "name", "arity"))
    guessed = (
        lookup_join(named, unique, ["name", "arity"], "inner")
        .where(F.col("caller_id") != F.col("callee_id"))
        .select("caller_id", "callee_id")
    )
    return distinct(exact.unionByName(guessed))


def mark_tested(units: DataFrame, test_refs: DataFrame) -> DataFrame:
    """JN2: ``has_tests`` is true when any test refers to the unit."""
    tested = test_refs.select("unit_id").distinct().withColumn("__tested", F.lit(True))
    return (
        units.drop("has_tests")
        .join(tested, "unit_id", "left")
        .withColumn("has_tests", F.coalesce("__tested", F.lit(False)))
        .drop("__tested")
    )


def blast_radius(units: DataFrame, edges: DataFrame) -> DataFrame:
    """AG3: number of distinct callers and callees per unit.

    The ids themselves stay rows of ``edges``: a hub called from everywhere would not fit one array. Distinct
    pairs are shuffled on both ids, so counting a hub is a pre-aggregated sum.
    """
    pairs = edges.select("caller_id", "callee_id").distinct()
    ends = pairs.select(
        F.explode(
            F.array(
                F.struct(F.col("callee_id").alias("unit_id"), F.lit(1).alias("c"), F.lit(0).alias("e")),
                F.struct(F.col("caller_id").alias("unit_id"), F.lit(0).alias("c"), F.lit(1).alias("e")),
            )
        ).alias("end")
    ).select("end.*")
    counts = ends.groupBy("unit_id").agg(F.sum("c").alias("caller_count"), F.sum("e").alias("callee_count"))
    return units.drop("caller_count", "callee_count").join(counts, "unit_id", "left").fillna(
        0, ["caller_count", "callee_count"]
    )


# --- SRC8, JN8, JN9 -------------------------------------------------------------------------------------------


def absolute_path(path: Column, root: str) -> Column:
    """A path made absolute against the root, with forward slashes."""
    norm = F.replace(path, F.lit("\\"), F.lit("/"))
    return F.when(norm.rlike(r"^(?:/|[A-Za-z]:/)"), norm).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), norm))


def changed_paths(df: DataFrame, root: str, exts: list[str] = vocab.TRACKED_EXTENSIONS) -> DataFrame:
    """SRC8: changed paths with a tracked extension, trimmed and absolute."""
    path = F.trim("path")
    tracked = reduce(lambda a, b: a | b, [F.lower(path).endswith(e.lower()) for e in exts])
    return df.where((path != "") & tracked).select(absolute_path(path, root).alias("path"))


_ROUNDS_PER_MERGE = 16
# Edges up to this many stay one table that each round scans; more are stored by their callee.
PLAIN_EDGES = 2_000_000


class StoredIds:
    """A table of ids and what goes with them, stored with one partitioning for all rounds of a walk.

    Rows lie in folders by a hash of (id, salt), so a reader names the folders it needs, and in every folder they are
    bucketed by (id, salt), so a join with rows that are dealt alike does not shuffle them again. ``hubs`` are the ids
    that own a large share of the rows: theirs are salted over many folders and buckets, all others have salt 0.

    Folders take the hash that buckets are dealt by, and buckets are a multiple of the folders: the rows of a bucket lie
    in one folder, so an append writes a file per bucket at most, not one per bucket and folder.
    """

    FOLDER, SALT = "__folder", "__salt"

    def __init__(self, spark: SparkSession, id_col: str, salted_by: str | None, hubs: list[tuple], folders: int = 64):
        self.spark, self.id_col, self.salted_by, self.folders = spark, id_col, salted_by, folders
        self.name = f"driftlock_{uuid.uuid4().hex}"
        self.path = scratch_path(spark, "walk")
        self.buckets = folders * ceil(int(spark.conf.get("spark.sql.shuffle.partitions")) / folders)
        self.hubs = [h[0] for h in hubs]

    def dealt(self, df: DataFrame, salt: Column) -> DataFrame:
        """The rows with their salt and their folder."""
        folder = F.pmod(F.hash(F.col(self.id_col), F.col(self.SALT)), F.lit(self.folders)).cast("int")
        return df.withColumn(self.SALT, salt).withColumn(self.FOLDER, folder)

    def append(self, rows: DataFrame) -> None:
        is_hub = F.col(self.id_col).isin(self.hubs) if self.hubs else F.lit(False)
        spread = F.pmod(F.xxhash64(self.salted_by), F.lit(HOT_SALTS)).cast("int") if self.salted_by else F.lit(0)
        dealt = self.dealt(rows, F.when(is_hub, spread).otherwise(0))
        (
            dealt.repartition(self.buckets, self.id_col, self.SALT)
            .write.format("parquet")
            .partitionBy(self.FOLDER)
            .bucketBy(self.buckets, self.id_col, self.SALT)
            .sortBy(self.id_col, self.SALT)
            .option("path", self.path)
            .mode("append")
            .saveAsTable(self.name)
        )

    def asked(self, ids: DataFrame) -> DataFrame:
        """Ids as they are looked up: a hub once for each of its salts."""
        if not self.hubs:
            return self.dealt(ids, F.lit(0))
        salts = F.when(F.col(self.id_col).isin(self.hubs), F.sequence(F.lit(0), F.lit(HOT_SALTS - 1))).otherwise(F.array(F.lit(0)))
        return self.dealt(ids, F.explode(salts))

    def part(self, asked: DataFrame) -> DataFrame:
        """The rows in the folders that ``asked`` names: a list no longer than there are folders. Others are not opened."""
        wanted = sorted(r[0] for r in asked.select(self.FOLDER).distinct().collect())
        return self.spark.table(self.name).where(F.col(self.FOLDER).isin(wanted)).drop(self.FOLDER)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def change_scope(
    units: DataFrame,
    edges: DataFrame,
    changed: DataFrame,
    broadcast_rows: int = BROADCAST_ROWS,
    plain_edges: int = PLAIN_EDGES,
) -> DataFrame:
    """JN8: ids of units in changed files plus everything that transitively calls them.

    Breadth-first: each round joins the newest ids with the edges and drops what was seen, so cycles end. A caller
    that is no unit is not walked through: edges of such callers are dropped before the first round. Every
    round is checkpointed, which cuts the growing plan and keeps finished rounds when an executor is lost.

    Edges of counted, small number stay one table. More are stored by callee once, and so is what was seen, by id: a
    round opens only the folders of its newest ids and of the ids they reach, and whether the newest ids are broadcast
    or dealt like the edges, the edges are not shuffled again. Callers of hubs lie spread over many folders.
    """
    spark = units.sparkSession
    paths = changed.select(F.lower("path").alias("__path")).distinct()
    frontier = cut_lineage(
        units.withColumn("__path", F.lower("path"))
        .join(paths, "__path", "left_semi")
        .select("unit_id")
        .distinct()
    )
    size = frontier.count()
    if not size:
        return frontier
    known = units.select(F.col("unit_id").alias("caller_id")).distinct()
    calls = cut_lineage(edges.select("caller_id", "callee_id").join(known, "caller_id", "left_semi"))
    if calls.count() > plain_edges:
        return _stored_walk(spark, frontier, size, calls, broadcast_rows)
    seen = frontier
    hubs = None
    rounds = 0
    while size:
        newest = frontier.withColumnRenamed("unit_id", "callee_id")
        if size > broadcast_rows and hubs is None:
            hubs = hot_keys(calls, ["callee_id"])
        reached = lookup_join(
            calls, newest, ["callee_id"], "inner", broadcast_rows=broadcast_rows, lookup_rows=size, hot=hubs
        )
        frontier = cut_lineage(
            reached.select(F.col("caller_id").alias("unit_id")).distinct().join(seen, "unit_id", "left_anti")
        )
        size = frontier.count()
        rounds += 1
        if size:
            seen = seen.unionByName(frontier)
            # A long chain would otherwise make the union as wide as it is long.
            if rounds % _ROUNDS_PER_MERGE == 0:
                seen = cut_lineage(seen)
    return seen


def _stored_walk(spark: SparkSession, frontier: DataFrame, size: int, calls: DataFrame, broadcast_rows: int) -> DataFrame:
    """The walk over edges that are stored by callee, with the seen ids stored alike."""
    by_callee = StoredIds(spark, "callee_id", "caller_id", hot_keys(calls, ["callee_id"]))
    seen = StoredIds(spark, "unit_id", None, [])
    try:
        by_callee.append(calls)
        while size:
            seen.append(frontier)
            reached = callers(by_callee, frontier, size, broadcast_rows)
            reached = cut_lineage(reached.select(F.col("caller_id").alias("unit_id")).distinct())
            asked = seen.asked(reached)
            frontier = cut_lineage(asked.join(seen.part(asked), ["unit_id", StoredIds.SALT], "left_anti").select("unit_id"))
            size = frontier.count()
        return cut_lineage(spark.table(seen.name).select("unit_id"))
    finally:
        by_callee.drop()
        seen.drop()


def callers(by_callee: StoredIds, frontier: DataFrame, size: int, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """The edges into the newest ids. Ids of counted, small number are broadcast, others dealt like the edges."""
    asked = by_callee.asked(frontier.withColumnRenamed("unit_id", "callee_id"))
    part = by_callee.part(asked)
    asked = asked.select("callee_id", StoredIds.SALT)
    return part.join(F.broadcast(asked) if size <= broadcast_rows else asked.hint("merge"), ["callee_id", StoredIds.SALT])


def lock_names(units: DataFrame) -> DataFrame:
    """Units with the name their lock is stored under."""
    return units.withColumn("lock_name", lock_name(F.col("display_name"), F.col("unit_id")))


def scoped_locks(locks: DataFrame, units: DataFrame, affected: DataFrame) -> DataFrame:
    """JN9: locks of affected units only; the names are recomputed from the units."""
    wanted = lock_names(units.join(affected.select("unit_id"), "unit_id", "left_semi")).select("lock_name")
    return locks.join(wanted.distinct(), "lock_name", "left_semi")


# --- JN5, AG7, JN10 -------------------------------------------------------------------------------------------


def api_usage(uses: DataFrame) -> DataFrame:
    """AG7: per type the number of uses, the assembly, and the first place in scan order ``seq``.

    Counts and first places are numbers, so every use is aggregated by hash; only the uses at a first place are
    looked at again for their texts.
    """
    counts = uses.groupBy("type_name").agg(F.count("*").alias("n_uses"), F.min("seq").alias("seq"))
    return _with_first(uses, counts, "seq")


def _with_first(rows: DataFrame, counts: DataFrame, order: str) -> DataFrame:
    """The counts per type with the place of the row that comes first."""
    at = counts.select(F.col("type_name").alias("__type"), F.col(order).alias("__first"))
    same = F.col("type_name").eqNullSafe(F.col("__type")) & F.col(order).eqNullSafe(F.col("__first"))
    first = F.min(F.struct("assembly", "file", "line")).alias("first")
    places = rows.select("type_name", order, "assembly", "file", "line").join(at, same).groupBy("__type").agg(first)
    return counts.join(places, F.col("type_name").eqNullSafe(F.col("__type"))).select(
        "type_name", "first.assembly", "n_uses", "first.file", "first.line"
    )


def merge_usage(parts: DataFrame) -> DataFrame:
    """AG7: usage tables of several projects merged: counts add up, the first location by ``project`` stays."""
    first = F.min(F.struct("project", "assembly", "file", "line"))
    return (
        parts.groupBy("type_name")
        .agg(F.sum("n_uses").alias("n_uses"), first.alias("first"))
        .select("type_name", "first.assembly", "n_uses", "first.file", "first.line")
    )


def missing_in_target(
    uses: DataFrame, target_catalog: DataFrame, prefixes: list[str] = vocab.FRAMEWORK_PREFIXES
) -> DataFrame:
    """JN5: framework types in use that the target catalog lacks, as in AG7.

    An empty catalog means the answer is unknown, and unknown is never reported as missing. Uses are aggregated
    to one row per type before the anti join.
    """
    low = F.lower("assembly")
    framework = reduce(
        lambda a, b: a | b, [(low == p.lower()) | low.startswith(p.lower() + ".") for p in prefixes]
    )
    used = api_usage(uses.where(F.col("type_name").isNotNull() & framework))
    if target_catalog.isEmpty():
        return used.limit(0)
    return used.join(target_catalog.select("type_name").distinct(), "type_name", "left_anti")


def unknown_ids(df: DataFrame, catalog: DataFrame, id_col: str, group_col: str, exempt: list[str]) -> DataFrame:
    """JN10: distinct ids, with their group, that the catalog of that group lacks; exempt groups never count.

    A group without any catalog entry is not judged. Blank ids are unknown.
    """
    # Counted, because the optimizer lifts a distinct above the joins, and all rows would meet on a few groups.
    ids = df.where(~F.col(group_col).isin(exempt)).groupBy(group_col, id_col).agg(F.count("*").alias("__n"))
    groups = catalog.where(F.col(group_col).isNotNull()).select(group_col).distinct()
    judged = lookup_join(ids, groups, [group_col], "inner").drop("__n")
    return judged.join(catalog.select(group_col, id_col).distinct(), [group_col, id_col], "left_anti")


# --- JN12 -----------------------------------------------------------------------------------------------------


def attach_source(units: DataFrame, types: DataFrame, max_level: int = 40) -> DataFrame:
    """JN12: the smallest type of the same file whose lines enclose the unit; null when there is none.

    A plain join on the file would pair every unit of a large file with every type in it. Instead each type is
    filed under the power of two of its own length, in the two or three aligned blocks it touches, and a unit
    looks only into the block of its first line at each length that occurs. Keys are (file, length class,
    block), so one very large file spreads over many tasks.
    """
    level_of = F.floor(F.log2((F.col("end_line") - F.col("start_line") + 1).cast("double"))).cast("int")
    spans = types.select(
        "path",
        F.col("type_name").alias("__type"),
        F.col("start_line").cast("bigint").alias("__start"),
        F.col("end_line").cast("bigint").alias("__end"),
        F.least(level_of, F.lit(max_level)).alias("__level"),
    )
    levels = sorted(r[0] for r in spans.select("__level").distinct().collect())  # at most max_level + 1 values
    if not levels:
        return units.withColumn("type_name", F.lit(None).cast("string"))
    size = F.expr("shiftleft(1L, __level)")
    filed = spans.withColumn(
        "__block",
        F.explode(F.sequence(F.floor(F.col("__start") / size), F.floor(F.col("__end") / size))),
    )
    asked = units.select(
        "unit_id",
        "path",
        F.col("start_line").cast("bigint").alias("__first"),
        F.col("end_line").cast("bigint").alias("__last"),
        F.explode(F.array(*[F.lit(x) for x in levels])).alias("__level"),
    ).withColumn("__block", F.floor(F.col("__first") / size))
    # A type shorter than the unit cannot enclose it.
    asked = asked.where(F.expr("shiftleft(1L, __level + 1) >= __last - __first + 1"))
    encloses = (F.col("__start") <= F.col("__first")) & (F.col("__last") <= F.col("__end"))
    best = (
        asked.join(filed, ["path", "__level", "__block"])
        .where(encloses)
        .groupBy("unit_id")
        .agg(F.min(F.struct((F.col("__end") - F.col("__start")).alias("len"), F.col("__type").alias("name"))).alias("b"))
        .select("unit_id", F.col("b.name").alias("type_name"))
    )
    return units.join(best, "unit_id", "left")
