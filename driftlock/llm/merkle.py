"""A Merkle manifest of a dataset: a digest per row, per group and of the whole, with a proof for every row.

Rows of a group are leaves in order; runs of a few consecutive nodes become the digest of their digests, level by level,
until one is left, and the digests of the groups become the root in the same way. A tree is cut into superblocks, each
some levels high. Going up, every superblock is reduced to its top node, and those nodes are the next round's leaves;
there are as many rounds as a group's size has powers of the superblock. Going down, the required outer nodes of each
superblock, which is the proof of its top node, are cogrouped with its leaves: one ``applyInPandas`` finishes the local
reduction, joins local and outer proofs, and folds every leaf to the root. A superblock has a fixed number of leaves and
one row of outer nodes, so a group with a third of all rows is many small tasks.

Places come from one range partitioning by (group, order): rows are numbered in their slice, and slices are counted.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from driftlock.llm.common import stored

ARITY = 3
# Levels of a superblock: 3 ** 6 = 729 leaves.
LEVELS = 6
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
# monotonically_increasing_id() has the slice above and the row in the slice below.
_ROW_BITS = 33


def leaf_digest(fields: Sequence[Column]) -> Column:
    """The digest of a row: every field as its byte count, a colon and its text, or a dash if null."""
    parts = []
    for field in fields:
        value = field.cast("string")
        parts.append(F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value)))
    return F.sha2(F.concat(*parts), 256)


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof give, as one native expression; a proof is (left, right) pairs, flattened."""
    pairs = F.sequence(F.lit(0), (F.size(proof) / 2).cast("int") - 1)
    steps = F.when(F.size(proof) > 0, pairs).otherwise(F.array().cast("array<int>"))

    def step(node: Column, i: Column) -> Column:
        return F.sha2(F.concat(F.element_at(proof, 2 * i + 1), node, F.element_at(proof, 2 * i + 2)), 256)

    return F.aggregate(steps, leaf, step)


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def reduced(digests: list[str], arity: int, levels: int | None) -> list[list[str]]:
    """All levels from ``digests`` up: so many levels, or until one node is left."""
    out = [digests]
    while len(out) <= levels if levels is not None else len(out[-1]) > 1:
        last = out[-1]
        out.append([digest("".join(last[i : i + arity])) for i in range(0, len(last), arity)])
    return out


def siblings(levels: list[list[str]], arity: int) -> list[list[tuple[str, str]]]:
    """For each level but the top, the siblings left and right of each node, each side concatenated."""
    out = []
    for nodes in levels[:-1]:
        sides = []
        for i in range(len(nodes)):
            first = i - i % arity
            sides.append(("".join(nodes[first:i]), "".join(nodes[i + 1 : first + arity])))
        out.append(sides)
    return out


def _local_levels(n: int, arity: int, levels: int) -> int | None:
    """The last superblock of a large group is reduced as high as the others, a group's only one up to one node."""
    return levels if n > arity**levels else None


def _placed(rows: DataFrame, group: list[str], order: list[str], label: str) -> DataFrame:
    """The rows with ``g``, a number of the group that ascends with it, ``p``, the place in it, and ``n``, its size.

    Order columns may tie; equal rows are interchangeable and spread by a number of their own.
    """
    keys = [*group, *order, "__spread"]
    spread = rows.withColumn("__spread", F.monotonically_increasing_id())
    sliced = stored(
        spread.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("__spread").withColumn("__seq", F.monotonically_increasing_id()),
        f"{label}-ordered",
    ).withColumn("__slice", F.shiftright("__seq", _ROW_BITS))
    counts = sliced.groupBy(*group, "__slice").agg(F.min("__seq").alias("__first"), F.count("*").alias("__rows"))
    of_group = Window.partitionBy(*group)
    earlier = of_group.orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        *group,
        "__slice",
        "__first",
        F.coalesce(F.sum("__rows").over(earlier), F.lit(0)).alias("__before"),
        F.min("__first").over(of_group).alias("g"),
        F.sum("__rows").over(of_group).alias("n"),
    )
    # One row for each slice of each group; Catalyst broadcasts them if their bytes allow it.
    told = sliced.join(starts, [*group, "__slice"])
    return told.withColumn("p", F.col("__before") + F.col("__seq") - F.col("__first")).drop(
        "__slice", "__first", "__before", "__seq"
    )


# ``total`` is the number of leaves of the whole group, which tells in which round the group ends.
NODE = "g bigint, p bigint, n bigint, total bigint, digest string"
OUTER = "g bigint, block bigint, total bigint, path array<string>, subroot string, root string"


def _up(arity: int, levels: int) -> Callable:
    size = arity**levels

    def up(key: tuple, nodes: pd.DataFrame) -> pd.DataFrame:
        n = int(nodes["n"].iloc[0])
        top = reduced(nodes.sort_values("p")["digest"].tolist(), arity, _local_levels(n, arity, levels))[-1]
        return pd.DataFrame({"g": [key[0]], "p": [key[1]], "n": [-(-n // size)], "total": [nodes["total"].iloc[0]], "digest": top})

    return up


def _blocked(nodes: DataFrame, arity: int, levels: int) -> DataFrame:
    return nodes.withColumn("block", F.floor(F.col("p") / F.lit(arity**levels)).cast("bigint"))


def _climb(nodes: DataFrame, arity: int, levels: int, label: str) -> tuple[list[DataFrame], DataFrame]:
    """(nodes of each round, the one node that each group ends in)."""
    rounds, tops = [nodes], None
    while True:
        above = _blocked(rounds[-1].select("g", "p", "n", "total", "digest"), arity, levels).groupBy("g", "block")
        above = stored(above.applyInPandas(_up(arity, levels), NODE), f"{label}-nodes")
        done = above.where("n = 1").select("g", "total", "digest")
        tops = done if tops is None else tops.unionByName(done)
        rest = above.where("n > 1")
        if rest.isEmpty():
            return rounds, tops
        rounds.append(rest)


def _down(arity: int, levels: int, leaves: bool, keep_proof: bool) -> Callable:
    """Local reduction, proof joining and, for leaves, folding of one superblock with its outer nodes."""

    def down(key: tuple, nodes: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        nodes = nodes.sort_values("p")
        n = int(nodes["n"].iloc[0])
        digests = nodes["digest"].tolist()
        local = siblings(reduced(digests, arity, _local_levels(n, arity, levels)), arity)
        path, subroot, root = list(outer["path"].iloc[0]), outer["subroot"].iloc[0], outer["root"].iloc[0]
        proofs = []
        for i in range(len(digests)):
            proof: list[str] = []
            for sides in local:
                proof += sides[i]
                i //= arity
            proofs.append(proof + path)
        if not leaves:
            names = {"g": nodes["g"], "block": nodes["p"], "total": nodes["total"], "path": proofs}
            return pd.DataFrame(names | {"subroot": subroot, "root": root})
        roots = []
        for node, proof in zip(nodes["checked"], proofs):
            for left, right in zip(proof[::2], proof[1::2]):
                node = digest(left + node + right)
            roots.append(node)
        out = nodes.drop(columns=["g", "p", "n", "total", "block", "digest", "checked"]).assign(
            leaf=digests, subroot=subroot, root=root, proof_sha256=[digest("".join(p)) for p in proofs], folded_root=roots
        )
        out["verified"] = out["folded_root"] == root
        if keep_proof:
            out["proof"] = proofs
        return out

    return down


def _outer(rounds: list[DataFrame], above: DataFrame, arity: int, levels: int, label: str) -> DataFrame:
    """The outer nodes of the superblocks of the lowest round, from those of each group as a whole, ``above``."""
    outer = above
    for number in range(len(rounds) - 1, 0, -1):
        # Groups that ended below this round have their outer nodes already.
        here = F.col("total") > arity ** (levels * number)
        blocks = _blocked(rounds[number], arity, levels).groupBy("g", "block")
        found = blocks.cogroup(outer.where(here).groupBy("g", "block")).applyInPandas(_down(arity, levels, False, False), OUTER)
        outer = stored(found.unionByName(outer.where(~here)), f"{label}-outer")
    return outer


def prove(
    docs: DataFrame,
    fields: Sequence[str] = FIELDS,
    group: str = "source",
    order: str = "doc_id",
    checked: Column | None = None,
    arity: int = ARITY,
    levels: int = LEVELS,
    keep_proof: bool = False,
) -> DataFrame:
    """(order column, leaf, subroot, root, proof_sha256, folded_root, verified), one row per row of ``docs``.

    ``fields`` make the leaf. Leaves of a group ascend by the order column (null first), rows that tie by their leaf.
    Groups ascend by their text, null first, bytewise; a null group is a group. ``checked`` is the digest to be folded
    with the proof of the leaf's place, by default the leaf itself; ``verified`` tells whether that gives the root. With
    ``keep_proof`` the proof itself follows, for ``folded``. Repeated rows are leaves of their own. Other columns are not
    read. An empty table gives no rows.
    """
    leaf = leaf_digest([F.col(f"`{f}`") for f in fields])
    rows = docs.select(
        F.col(f"`{order}`").alias("ordered"),
        F.col(f"`{group}`").isNotNull().alias("named"),
        F.coalesce(F.col(f"`{group}`").cast("string"), F.lit("")).alias("name"),
        leaf.alias("digest"),
        F.coalesce(leaf if checked is None else checked, leaf).alias("checked"),
    )
    # Texts are read and digested once; from here on a row is its digests.
    rows = stored(rows, "merkle-leaves")
    leaves = _placed(rows, ["named", "name"], ["ordered", "digest"], "merkle").drop("named", "name")
    leaves = stored(leaves.withColumn("total", F.col("n")), "merkle-placed")
    rounds, subroots = _climb(leaves, arity, levels, "merkle")
    groups = subroots.select(F.lit(0).alias("all"), F.col("g").alias("member"), F.col("total").alias("leaves"), "digest")
    groups = _placed(groups, ["all"], ["member"], "merkle-groups").drop("all")
    groups = stored(groups.withColumn("total", F.col("n")), "merkle-groups")
    group_rounds, roots = _climb(groups, arity, levels, "merkle-root")
    block, nothing = F.lit(0).cast("bigint").alias("block"), F.array().cast("array<string>")
    top = roots.select("g", block, "total", nothing.alias("path"), F.lit(None).cast("string").alias("subroot"), F.col("digest").alias("root"))
    above = _outer(group_rounds, top, arity, levels, "merkle-root")
    members = _blocked(groups.select("g", "p", "n", "total", "digest"), arity, levels).groupBy("g", "block")
    paths = members.cogroup(above.groupBy("g", "block")).applyInPandas(_down(arity, levels, False, False), OUTER)
    named = groups.select(F.col("p").alias("block"), "member", "leaves", "digest")
    of_groups = paths.drop("total", "subroot").join(named, "block")
    of_groups = stored(
        of_groups.select(F.col("member").alias("g"), block, F.col("leaves").alias("total"), "path", F.col("digest").alias("subroot"), "root"),
        "merkle-subroots",
    )
    outer = _outer(rounds, of_groups, arity, levels, "merkle")
    kind = docs.schema[order].dataType.simpleString()
    proof = ", proof array<string>" if keep_proof else ""
    shape = f"ordered {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean{proof}"
    blocks = _blocked(leaves, arity, levels).groupBy("g", "block")
    proved = blocks.cogroup(outer.groupBy("g", "block")).applyInPandas(_down(arity, levels, True, keep_proof), shape)
    return proved.withColumnRenamed("ordered", order)


def without_line_feeds(docs: DataFrame, fields: Sequence[str] = FIELDS, text: str = "text", order: str = "doc_id") -> Column:
    """The leaf of a row that was tampered with: every other row, told by the CRC of its id, lost the line feeds of its text."""
    columns = [F.replace(F.col(f"`{f}`"), F.lit("\n"), F.lit("")) if f == text else F.col(f"`{f}`") for f in fields]
    hit = F.crc32(F.col(f"`{order}`").cast("string").cast("binary")) % 2 == 0
    return F.when(hit, leaf_digest(columns))
