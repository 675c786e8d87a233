"""N-gram Jaccard join by token-combination prefixes.

Tokens are hashed shingles. They fall into classes by how many documents hold them: rare tokens, and frequent ones,
which are dealt into sub-classes. The global order puts rare tokens first. A document may miss ``e`` of its tokens in
a partner, so its prefix is extended until rare tokens plus, per sub-class, frequent tokens less one exceed ``e``: then
each partner shares a rare token or a pair of frequent tokens of one sub-class. Rare tokens are indexed by themselves,
frequent ones as pairs, so a token that a third of all documents hold never makes a bucket.

Classes only steer cost. Any set of frequent tokens gives the same links, so that set may be bounded and broadcast.

Buckets are not expanded into pairs. Members are first verified against a leader of their bucket; what is then in one
component needs no more. Pairs across components are left, and of these only the ones that share as many tokens as a
similarity of the threshold implies. A sketch holds the parity of the tokens of each hash value, so two sketches differ
in no more bits than their sets in tokens; pairs that differ in too many are left out where they meet.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftlock.llm.common import components, shared_keys, stored
from driftlock.llm.shingles import mixed, shingle_sets
from driftlock.operators.lookup import lookup_join

WORDS = 5
PERCENT = 80
# A token in so many documents is frequent.
FREQUENT = 32
# The most frequent tokens that are told to every task, 8 bytes each.
TOLD = 1_000_000
# Frequent tokens of a prefix that share a sub-class, about.
SUB_CLASS = 4
# Copies of a leader whose members are verified side by side.
SALTS = 32
# Bits of a sketch; the texts whose sketches are made at a time.
BITS, SKETCHED = 512, 1000
# Buckets of an id that its rows are told, so that a pair is made in the first of them only; with more, in all.
LISTED = 256
# Ids of rows without an id start here and come back as null.
NO_ID = 2**62


def missing(n: int, percent: int) -> int:
    """How many of ``n`` tokens a partner may lack."""
    return n - -(-percent * n // 100)


def size_classes(n: int, percent: int) -> range:
    """The size classes in which a set of ``n`` may meet a partner: a pair meets in the class of its larger set."""
    step = np.log(100 / percent) * 2
    return range(int(np.log(n) / step + 1e-9), int(np.log(n * 100 / percent) / step + 1e-9) + 1)


def _pair_signatures(tokens: np.ndarray, e: int, n_rare: int, size_class: int, percent: int) -> np.ndarray:
    """Pairs within sub-classes of the first frequent tokens that suffice beside ``n_rare`` rare ones."""
    largest = np.exp(np.log(100 / percent) * 2 * (size_class + 1))
    parts = max(1, int(largest * (100 - percent) / 100 / SUB_CLASS))
    part = mixed(tokens) % np.uint64(parts)
    _, first = np.unique(part, return_index=True)
    counts = np.ones(len(tokens), np.int64)
    counts[first] = 0
    enough = np.searchsorted(np.cumsum(counts), e + 1 - n_rare) + 1
    tokens, part = tokens[:enough], part[:enough]
    order = np.argsort(part, kind="stable")
    tokens, part = tokens[order], part[order]
    out = []
    for gap in range(1, int(np.bincount(part.astype(np.int64)).max()) if len(part) else 0):
        same = part[gap:] == part[:-gap]
        out.append(mixed(tokens[:-gap][same] * np.uint64(0x9E3779B97F4A7C15) + mixed(tokens[gap:][same]) + np.uint64(size_class)))
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def signatures(tokens: np.ndarray, frequent: np.ndarray, percent: int) -> tuple[np.ndarray, int, int]:
    """(signatures of a sorted token set, how many of them are single rare tokens, number of its rare tokens).

    Single tokens come first, in the global order, so the place of a signature among them is its place in the set.
    """
    n = len(tokens)
    e = missing(n, percent)
    at = np.minimum(np.searchsorted(frequent, tokens), max(0, len(frequent) - 1))
    often = frequent[at] == tokens if len(frequent) else np.zeros(n, bool)
    rare = tokens[~often]
    if len(rare) > e:
        return rare[: e + 1], e + 1, len(rare)
    pairs = [_pair_signatures(tokens[often], e, len(rare), c, percent) for c in size_classes(n, percent)]
    return np.concatenate([rare, *pairs]), len(rare), len(rare)


def _count_tokens(words: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = shingle_sets(batch.column("text"), words)
            tokens, n = np.unique(np.concatenate([np.empty(0, np.uint64), *sets]), return_counts=True)
            tokens, n = tokens[n > 1], n[n > 1]
            yield pa.RecordBatch.from_arrays([pa.array(tokens.view(np.int64)), pa.array(n)], names=["token", "n"])

    return count


def frequent_tokens(docs: DataFrame, words: int = WORDS, frequent: int = FREQUENT, told: int = TOLD) -> np.ndarray:
    """The frequent tokens, sorted.

    Every document is read. Tokens are summed per Arrow batch and those found once there are left out, so what is
    shuffled is small; a token spread thinner than that over all batches may stay rare, which costs time, never links.
    """
    counted = docs.select("text").mapInArrow(_count_tokens(words), "token bigint, n bigint")
    top = counted.groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") >= frequent).orderBy(F.desc("n"), "token").limit(told)
    return np.sort(np.array([r["token"] for r in top.select("token").collect()], np.int64).view(np.uint64))


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """A row of ``BITS`` bits for each set: whether it has an odd number of the tokens with that hash."""
    out = np.empty((len(sets), BITS // 64), np.int64)
    for at in range(0, len(sets), SKETCHED):
        part = sets[at : at + SKETCHED]
        owner = np.repeat(np.arange(len(part)), [len(s) for s in part])
        place = (mixed(np.concatenate(part)) % np.uint64(BITS)).astype(np.int64)
        odd = np.bincount(owner * BITS + place, minlength=len(part) * BITS) & 1
        out[at : at + SKETCHED] = np.packbits(odd.astype(bool)).view(np.int64).reshape(len(part), -1)
    return out


SETS = "id bigint, text_hash bigint, n int, s1 bigint, s2 bigint, sketch array<bigint>, singles int, rare int, sigs array<bigint>"


def _describe(shared, percent: int, words: int):
    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = shared.value
        for batch in batches:
            sets = shingle_sets(batch.column("text"), words)
            made = [signatures(s, frequent, percent) if len(s) else (s, 0, 0) for s in sets]
            s1 = np.array([s.sum(dtype=np.uint64) for s in sets], np.uint64)
            s2 = np.array([np.bitwise_xor.reduce(mixed(s)) if len(s) else 0 for s in sets], np.uint64)
            id_ = batch.column("doc_id").cast(pa.int64())
            none = id_.is_null().to_numpy(zero_copy_only=False)
            ids = np.where(none, (s1 >> np.uint64(2)).astype(np.int64) + NO_ID, id_.fill_null(0).to_numpy())
            offsets = np.concatenate([[0], np.cumsum([len(g) for g, _, _ in made])]).astype(np.int32)
            flat = np.concatenate([np.empty(0, np.uint64), *[g for g, _, _ in made]]).view(np.int64)
            words_ = BITS // 64
            sketch = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * words_), pa.array(sketches(sets).ravel()))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids), batch.column("text_hash"), pa.array([len(s) for s in sets], pa.int32()),
                    pa.array(s1.view(np.int64)), pa.array(s2.view(np.int64)), sketch, *[pa.array([m[k] for m in made], pa.int32()) for k in (1, 2)],
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)),
                ],
                names=[c.split()[0] for c in SETS.split(", ")],
            )

    return describe


BUCKETS = "sig bigint, id bigint, shape bigint"
# A shape holds the size of the set, then the place of a single token or the number of rare tokens, then whether the
# prefix goes on to frequent tokens, then whether this is a pair of them.
_SIZE, _PLACE = 34, 2


class Described:
    """The stored sets and buckets of a table."""

    def __init__(self, docs: DataFrame, percent: int, words: int, frequent: int, told: int):
        spark = docs.sparkSession
        self.docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        often = spark.sparkContext.broadcast(frequent_tokens(self.docs, words, frequent, told))
        hashed = self.docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
        self.sets = stored(hashed.mapInArrow(_describe(often, percent, words), SETS), "sets")
        # Equal sets are one: copies collapse before anything is compared.
        self.groups = (
            self.sets.where("n > 0")
            .groupBy("s1", "s2")
            .agg(F.min("id").alias("id"), *[F.first(c).alias(c) for c in ("n", "singles", "rare", "sigs")])
        )
        pair = F.col("pos") >= F.col("singles")
        shape = F.shiftleft(F.col("n").cast("long"), _SIZE) + F.shiftleft(F.when(pair, F.col("rare")).otherwise(F.col("pos")).cast("long"), _PLACE)
        deep = F.col("rare") <= F.col("n") - F.ceil(F.lit(percent) * F.col("n") / F.lit(100))
        rows = self.groups.select("id", "n", "singles", "rare", F.posexplode("sigs").alias("pos", "sig")).select(
            "sig", "id", (shape + deep.cast("long") * 2 + pair.cast("long")).alias("shape")
        )
        met = stored(rows.repartition("sig").sortWithinPartitions("sig").mapInArrow(shared_keys, BUCKETS), "buckets")
        self.buckets = met.select(
            "sig",
            "id",
            F.shiftright("shape", _SIZE).alias("n"),
            F.shiftright("shape", _PLACE).bitwiseAND(F.lit(2 ** (_SIZE - _PLACE) - 1)).alias("place"),
            (F.shiftright("shape", 1) % 2 == 1).alias("deep"),
            (F.col("shape") % 2 == 1).alias("pair"),
        )


def _similar(percent: int):
    def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by leader and copy, the leader's own sets first."""
        key, leaders = None, []
        for batch in batches:
            a, b = [], []
            for lead, copy, member, tokens in zip(*[batch.column(c).to_pylist() for c in ("lead", "copy", "member", "tokens")]):
                mine = np.frombuffer(tokens, np.uint64)
                if key != (lead, copy):
                    key, leaders = (lead, copy), []
                if member is None:
                    leaders.append(mine)
                    continue
                for other in leaders:
                    both = len(mine) + len(other)
                    shared = both - len(np.union1d(mine, other))
                    if 100 * shared >= percent * (both - shared):
                        a.append(member)
                        b.append(lead)
                        break
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return similar


def _set_bytes(words: int):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [s.tobytes() for s in shingle_sets(batch.column("text"), words)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sets, pa.binary())], names=["id", "tokens"])

    return make


def verified(docs: DataFrame, described: Described, pairs: DataFrame, percent: int, words: int) -> DataFrame:
    """The links (a, b) among ``pairs`` of ids.

    Sets are made anew from the texts of the documents that take part. The set of a member goes to each of its
    leaders; a leader's set goes to ``SALTS`` tasks, so a leader of a third of all documents is no hot spot.
    """
    lone = described.sets.where(F.col("id") >= NO_ID).select("id", "text_hash").isEmpty()
    pairs = stored(pairs.select("a", "b").distinct(), "pairs")
    used = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    texts = docs if lone else _with_ids(docs, described)
    wanted = lookup_join(texts.select(F.col("doc_id").alias("id"), "text").where("id is not null"), used, ["id"], how="inner")
    sets = wanted.select(F.col("id").alias("doc_id"), "text").mapInArrow(_set_bytes(words), "id bigint, tokens binary").where(F.octet_length("tokens") > 0)
    sets = stored(sets, "used-sets")
    members = pairs.join(sets.withColumnRenamed("id", "a"), "a").select(
        F.col("b").alias("lead"), F.pmod(F.xxhash64("a"), F.lit(SALTS)).cast("int").alias("copy"), F.col("a").alias("member"), "tokens"
    )
    needed = pairs.select(F.col("b").alias("lead"), F.pmod(F.xxhash64("a"), F.lit(SALTS)).cast("int").alias("copy")).distinct()
    leaders = needed.join(sets.withColumnRenamed("id", "lead"), "lead").select(
        "lead", "copy", F.lit(None).cast("long").alias("member"), "tokens"
    )
    met = members.union(leaders).repartition("lead", "copy").sortWithinPartitions("lead", "copy", F.col("member").isNotNull())
    return stored(met.mapInArrow(_similar(percent), "a bigint, b bigint").distinct(), "links")


def _with_ids(docs: DataFrame, described: Described) -> DataFrame:
    """The documents with the ids that rows without one were given."""
    own = described.sets.where(F.col("id") >= NO_ID).select("id", "text_hash").distinct()
    keyed = docs.withColumn("text_hash", F.xxhash64("text"))
    named = keyed.where("doc_id is null").join(own, "text_hash").select(F.col("id").alias("doc_id"), "text")
    return docs.where("doc_id is not null").select("doc_id", "text").union(named)


def _current(rows: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return rows.withColumn("component", F.col("id"))
    return lookup_join(rows, labels, ["id"]).withColumn("component", F.coalesce("component", "id"))


def _needed(percent: int) -> Column:
    """The overlap that two sets of sizes ``n`` and ``n_b`` need."""
    return F.ceil(F.lit(percent) * (F.col("n") + F.col("n_b")) / F.lit(100 + percent))


def _may_meet(percent: int) -> Column:
    """Whether a row of a bucket and another may stand for a link.

    Sizes must fit and components differ. What shares a rare token is found by that token as well, so for a pair of
    frequent tokens the sets may be taken to share frequent tokens only, and must have enough of them.
    """
    sizes = F.least("n", "n_b") * 100 >= F.greatest("n", "n_b") * percent
    frequent = F.least(F.col("n") - F.col("place"), F.col("n_b") - F.col("place_b")) >= _needed(percent)
    return (F.col("component") != F.col("component_b")) & sizes & (~F.col("pair") | frequent)


def _counted(met: DataFrame, percent: int) -> DataFrame:
    """(id, id_b, c) of the pairs of rows that share enough.

    All common tokens up to the last common single one are counted; behind it each set has only so many left. Beyond
    the prefix that ends first its set has only so many left; the prefix of a deep set ends after all rare tokens.
    """
    single = ~F.col("pair")

    def rest(n: str, deep: str) -> Column:
        return F.when(F.col(deep), 0).otherwise(F.ceil(F.lit(percent) * F.col(n) / F.lit(100)) - 1)

    counted = met.groupBy("id", "id_b", "n", "n_b", "deep", "deep_b").agg(
        F.sum(F.when(single, F.col("times")).otherwise(0)).alias("c"),
        F.max("pair").alias("pair"),
        F.max(F.when(single, F.col("place"))).alias("last"),
        F.max(F.when(single, F.col("place_b"))).alias("last_b"),
    )
    beyond = F.when(~(F.col("deep") & F.col("deep_b")), F.greatest(rest("n", "deep"), rest("n_b", "deep_b")))
    left = F.least(F.col("n") - 1 - F.col("last"), F.col("n_b") - 1 - F.col("last_b"), beyond)
    return counted.where(F.col("pair") | (F.col("c") + left >= _needed(percent)))


def _leads(buckets: DataFrame, labels: DataFrame | None, percent: int, turn: int) -> DataFrame:
    """Each id with the leader it shares most with, over buckets that hold several components.

    A bucket of a pair of frequent tokens is led by the id with the fewest rare tokens, which is the most central;
    other buckets by the id that comes first by a hash. The hash changes with every turn.
    """
    own = F.struct(
        F.when(F.col("pair"), F.col("place")).otherwise(0).alias("rare"), F.xxhash64("id", F.lit(turn)).alias("o"),
        F.col("id").alias("id_b"), F.col("n").alias("n_b"), F.col("place").alias("place_b"), F.col("component").alias("component_b"),
        F.col("deep").alias("deep_b"),
    )
    led = _current(buckets, labels).withColumn("lead", F.min(own).over(Window.partitionBy("sig")))
    theirs = [f"lead.{c}_b" for c in ("id", "n", "place", "component", "deep")]
    met = led.select("id", "n", "place", "pair", "deep", "component", F.lit(1).alias("times"), *theirs)
    shared = _counted(met.where(_may_meet(percent)), percent)
    best = F.max_by("id_b", F.struct("c", "id_b"))
    return shared.groupBy("id").agg(best.alias("b")).select(F.col("id").alias("a"), "b")


def _near(percent: int) -> Column:
    """Whether the sketches differ in no more bits than linked sets may differ in tokens."""
    differ = sum(F.bit_count(F.get("sketch", F.lit(i)).bitwiseXOR(F.get("sketch_b", F.lit(i)))) for i in range(BITS // 64))
    return F.coalesce(differ <= F.col("n") + F.col("n_b") - 2 * _needed(percent), F.lit(True))


def _across(buckets: DataFrame, sets: DataFrame, labels: DataFrame | None, percent: int) -> DataFrame:
    """All pairs of different components that share buckets and enough tokens.

    Buckets with the same members, of which similar sets have many, are joined as one: 128 bits over the members name
    it, and it carries how many buckets it stands for and the last place of each member in them. Sketches leave out the
    pairs that differ too much. A pair that meets in buckets of pairs of frequent tokens needs no count, so it is made in
    the first bucket that both have. Ids with several sets have no sketch and meet in all their buckets.
    """
    whole = Window.partitionBy("sig")
    rows = _current(buckets, labels).withColumns(
        {
            "lo": F.min("component").over(whole),
            "hi": F.max("component").over(whole),
            "m1": F.sum(F.xxhash64("id").cast("decimal(38,0)")).over(whole),
            "m2": F.bit_xor(F.xxhash64(F.lit(7), "id")).over(whole),
        }
    )
    own = ["id", "n", "deep", "component"]
    rows = rows.where("lo < hi").groupBy("m1", "m2", "pair", *own).agg(F.max("place").alias("place"), F.count("*").alias("times"))
    rows = stored(rows.withColumn("bucket", F.xxhash64("m1", "m2")), "mixed")
    used = rows.groupBy("id").agg(F.collect_set(F.when(F.col("pair"), F.col("bucket"))).alias("listed"))
    alone = (F.min("s1") == F.max("s1")) & (F.min("s2") == F.max("s2"))
    marks = used.join(sets.where("n > 0").select("id", "s1", "s2", "sketch"), "id").groupBy("id").agg(
        F.when(alone, F.first("sketch")).alias("sketch"), F.when(alone & (F.size(F.first("listed")) <= LISTED), F.first("listed")).alias("listed")
    )
    rows = stored(rows.join(marks, "id"), "sketched")
    other = rows.select("m1", "m2", "pair", *[F.col(c).alias(f"{c}_b") for c in [*own, "place", "sketch", "listed"]])
    first = F.array_min(F.array_intersect("listed", "listed_b")) == F.col("bucket")
    once = ~F.col("pair") | F.coalesce(first, F.lit(True))
    met = rows.join(other, ["m1", "m2", "pair"]).where((F.col("id") < F.col("id_b")) & _may_meet(percent) & _near(percent) & once)
    return _counted(met, percent).select(F.col("id").alias("a"), F.col("id_b").alias("b"))


def link_classes(
    docs: DataFrame, percent: int = PERCENT, words: int = WORDS, frequent: int = FREQUENT, told: int = TOLD, turns: int = 1
) -> DataFrame:
    """(id, text_hash, n_shingles, s1, s2, component) for each row of ``docs``.

    Rows of one id are one node. A row without an id is a node by its set, and ranks above all ids. Rows without words
    are linked with nothing, so they are their own component. Links are exact: every pair that could reach the
    threshold is verified unless a chain of verified links already joins it.
    """
    described = Described(docs, percent, words, frequent, told)
    links, labels = None, None
    for turn in range(turns + 1):
        pairs = _leads(described.buckets, labels, percent, turn) if turn < turns else _across(described.buckets, described.sets, labels, percent)
        new = verified(described.docs, described, pairs, percent, words)
        links = new if links is None else links.union(new)
        labels = components(links, "a", "b")
    least = described.sets.where("n > 0").groupBy("s1", "s2").agg(F.min("id").alias("head"))
    named = lookup_join(least, labels.withColumnRenamed("id", "head"), ["head"]).withColumn("component", F.coalesce("component", "head"))
    rows = described.sets.select("id", "text_hash", F.col("n").alias("n_shingles"), "s1", "s2")
    return rows.join(named.drop("head"), ["s1", "s2"], "left").withColumn(
        "component", F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("id"))
    )


def _null_again(c: str) -> Column:
    return F.when(F.col(c) < NO_ID, F.col(c))


def join_classes(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of ``docs``; a component without any id is null."""
    found = link_classes(docs, **options)
    return found.select(_null_again("id").alias("doc_id"), F.col("n_shingles").cast("long").alias("n_shingles"), _null_again("component").alias("component_id"))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """Of each group of linked documents the one with the smallest id; of repeated rows one. Wordless rows all stay."""
    found = link_classes(docs, **options)
    kept = found.where("id = component and n_shingles > 0").groupBy("id", "s1", "s2").agg(F.min("text_hash").alias("__hash"))
    keys = kept.select(_null_again("id").alias("__id"), "__hash").distinct()
    bare = F.regexp_replace(F.coalesce(F.col("text"), F.lit("")), "[\\x20\\x09-\\x0D]+", "") == ""
    keyed = docs.withColumns({"__id": F.col("doc_id").cast("long"), "__hash": F.xxhash64("text")})
    matched = keyed.where(~bare).alias("d").join(
        keys.alias("k"), F.col("d.__hash").eqNullSafe(F.col("k.__hash")) & F.col("d.__id").eqNullSafe(F.col("k.__id")), "left_semi"
    )
    return matched.dropDuplicates(["__id", "__hash"]).union(keyed.where(bare)).drop("__id", "__hash")
