"""Packing, the Jaccard join, sharding, toxicity, and the pipeline."""

import zlib
from collections import defaultdict

import brute
import corpus_pipeline
import numpy as np
import pytest
from conftest import ROWS, by_repr
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from driftlock.llm import decontam, jaccard, packing, quality, ring, toxicity


def check_packing(pieces, rows, tokens=1024, segments=64):
    import public_tokenizers

    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = defaultdict(list)
    for i, t in rows:
        want[i].append(np.array([*plain.encode(t or "", add_special_tokens=False).ids, 0], "<u4"))
    sequences, documents = defaultdict(list), defaultdict(list)
    for p in pieces:
        sequences[p["sequence_id"]].append(p)
        documents[p["doc_id"]].append(p)
    for s in sequences.values():
        s.sort(key=lambda p: p["offset"])
        assert [p["offset"] for p in s] == np.cumsum([0, *[p["length"] for p in s[:-1]]]).tolist()
        assert sum(p["length"] for p in s) <= tokens and len(s) <= segments
    assert set(documents) == set(want)
    for i, ids in want.items():
        if len(ids) == 1:
            got = sorted(documents[i], key=lambda p: p["start"])
            at = 0
            for p in got:
                assert p["start"] == at and p["ids_crc32"] == zlib.crc32(ids[0][at : at + p["length"]].tobytes())
                assert p["doc_tokens"] == len(ids[0])
                at += p["length"]
            assert at == len(ids[0])
        else:
            assert sum(p["length"] for p in documents[i]) == sum(map(len, ids))
    return sequences


def test_packing(table, rows):
    pieces = packing.pack_documents(table).collect()
    sequences = check_packing(pieces, rows)
    # One sequence of each partition may be padded, no other.
    short = [s for s in sequences.values() if sum(p["length"] for p in s) < 1024]
    assert len(short) <= table.rdd.getNumPartitions()


def test_packing_of_edge_rows(edge, nothing):
    small = edge.where("doc_id is null or doc_id <> 8")
    check_packing(packing.pack_documents(small, window=2).collect(), [r for r in ROWS if r[0] != 8])
    assert packing.pack_documents(nothing).collect() == []
    special = edge.sparkSession.createDataFrame([(1, "a <|endoftext|> b")], "doc_id bigint, text string")
    check_packing(packing.pack_documents(special).collect(), [(1, "a <|endoftext|> b")])


def test_packing_keeps_all_limits():
    lengths = np.random.default_rng(2).integers(1, 90, 500)
    bins, done = packing.pack_window(lengths, (100, 3, 60), True)
    assert (done == lengths).all()
    for b in bins:
        sizes = [y - x for _, x, y in b]
        assert sum(sizes) <= 100 and len(b) <= 3 and sum(n - 1 for n in sizes) <= 60
    bins, done = packing.pack_window(lengths, (100, 64, 99), False)
    assert all(sum(y - x for _, x, y in b) == 100 for b in bins) and (lengths - done).sum() < 100


def test_packing_counts_the_tokens_that_bear_a_loss(spark):
    """Prompts bear no loss: a limit that binds for answers is kept, and is not filled up by prompts."""
    prompt, answer = "Größe 漢字 of the question? " * 9, "an answer of some words, a b c d. " * 4
    made = [(i, prompt + answer * (i % 3), [(len(prompt), len(prompt + answer * (i % 3)))]) for i in range(60)]
    made += [(60, answer, None), (61, prompt, []), (62, "a <|endoftext|> b", [(2, 15)]), (63, answer * 40, [(0, None), None]), (64, None, [(0, 9)])]
    df = spark.createDataFrame(made, "doc_id bigint, text string, bears array<struct<start: bigint, end: bigint>>").coalesce(1)
    pieces = packing.pack_documents(df, 512, 16, 100, window=20, loss_ranges="bears").collect()
    sequences = check_packing(pieces, [r[:2] for r in made], 512, 16)
    for s in sequences.values():
        assert sum(p["loss_tokens"] for p in s) <= 100
    # More prompt than the limit shares a sequence, which was not possible when all tokens counted.
    assert max(sum(p["length"] - 1 for p in s) for s in sequences.values()) > 200
    assert max(sum(p["loss_tokens"] for p in s) for s in sequences.values()) == 100

    def marks(doc):
        ids = packing.token_ids(made[doc][1] or "")
        ranges = made[doc][2] and [r and {"start": r[0], "end": r[1]} for r in made[doc][2]]
        count = packing.bearing_tokens(made[doc][1] or "", ids, ranges)
        return None if count is None else np.diff(count, prepend=0).tolist()

    assert marks(60) is None and set(marks(61)) == {0} and set(marks(63)) == {1} and marks(64) == [1]
    assert marks(62)[0] == 0 and marks(62)[-2:] == [0, 0] and sum(marks(62)) == 1
    of_answer, bare = len(packing.token_ids(answer)), len(packing.token_ids(prompt))
    assert abs(sum(marks(1)) - of_answer) <= 2 and set(marks(1)[: bare - 3]) == {0} and marks(1)[-1] == 1


@pytest.mark.parametrize("frequent", [32, 2])
def test_jaccard_equals_brute_force(table, rows, frequent):
    got = {r[0]: (r[1], r[2]) for r in jaccard.join_classes(table, frequent=frequent).collect()}
    assert got == brute.join_classes(rows)


def test_jaccard_of_many_near_copies(spark):
    """Every shingle of these groups is frequent, so only pairs of frequent tokens can find their links."""
    rng = np.random.default_rng(4)
    made = []
    for g in range(4):
        base = [f"w{x}" for x in rng.integers(0, 10**6, 120 + 40 * g)]
        for _ in range(30):
            copy = list(base)
            for at in rng.integers(0, len(copy), 5):
                copy[at] = f"e{rng.integers(0, 10**9)}"
            made.append((len(made) * 3 % 1000 + g * 1000, " ".join(copy)))
    df = spark.createDataFrame(made, "doc_id bigint, text string")
    got = {r[0]: (r[1], r[2]) for r in jaccard.join_classes(df, frequent=8).collect()}
    assert got == brute.join_classes(made)


def test_sets_that_are_too_different_make_no_rows_across_components(spark, monkeypatch):
    """Variants of one text below the threshold share many buckets; ids may have several texts or none."""
    rng = np.random.default_rng(8)
    base = [f"w{x}" for x in rng.integers(0, 10**6, 150)]
    made = []
    for i in range(120):
        copy = list(base)
        for at in rng.integers(0, len(copy), 6 if i % 4 else 2):
            copy[at] = f"e{rng.integers(0, 40)}"
        made.append((None if i % 40 == 7 else i if i % 10 else 1000 + i // 20, " ".join(copy)))
    df = spark.createDataFrame(made, "doc_id bigint, text string")
    real, rows = jaccard._counted, []

    def counted(met, percent):
        if "sketch" in met.columns:
            rows.append((met.count(), met.where("pair").count(), met.where("pair").select("id", "id_b").distinct().count()))
        return real(met, percent)

    got = by_repr(tuple(r) for r in jaccard.join_classes(df, frequent=8).collect())
    monkeypatch.setattr(jaccard, "_near", lambda percent: F.lit(True))
    monkeypatch.setattr(jaccard, "LISTED", -1)
    monkeypatch.setattr(jaccard, "_counted", counted)
    assert got == by_repr(tuple(r) for r in jaccard.join_classes(df, frequent=8).collect())
    monkeypatch.undo()
    monkeypatch.setattr(jaccard, "_counted", counted)
    jaccard.join_classes(df, frequent=8).collect()
    (all_rows, _, all_pairs), (few_rows, few_pair_rows, few_pairs) = rows
    assert few_pairs < all_pairs and few_rows * 5 < all_rows


def test_sketches_differ_in_no_more_bits_than_sets():
    rng = np.random.default_rng(9)
    pool = rng.integers(0, 2**63, 3000).astype(np.uint64)
    sets = [np.unique(rng.choice(pool, n)) for n in [0, 1, 2, 100, 140, 900, *rng.integers(0, 300, 1200)]]
    made = np.unpackbits(jaccard.sketches(sets).view(np.uint8), axis=1)
    assert made.shape == (len(sets), jaccard.BITS) and not made[0].any()
    for a, b in rng.integers(0, len(sets), (500, 2)):
        assert (made[a] ^ made[b]).sum() <= len(np.setxor1d(sets[a], sets[b]))
    assert (made[4] ^ made[3]).sum() > 100


def test_pairs_that_could_link_share_a_signature():
    rng = np.random.default_rng(6)
    for _ in range(300):
        n = int(rng.integers(4, 120))
        x = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        lost = int(rng.integers(0, jaccard.missing(len(x), 80) + 1))
        y = np.sort(rng.permutation(x)[lost:])
        union = len(x)
        if 100 * len(y) < 80 * union:
            continue
        often = np.sort(rng.permutation(x)[: int(rng.integers(0, len(x) + 1))])
        a, b = (set(jaccard.signatures(s, often, 80)[0].tolist()) for s in (x, y))
        assert a & b or len(x) == len(y)


def test_jaccard_of_edge_rows(edge, nothing):
    got = by_repr([tuple(r) for r in jaccard.join_classes(edge).collect()])
    want = []
    for i, t in ROWS:
        n = len(brute.shingles(t))
        group = {5: 5, 6: 5, 11: 10}.get(i, i)
        want.append((i, n, group))
    assert got == by_repr(want)
    assert jaccard.join_classes(nothing).collect() == [] and jaccard.keep_one(nothing).collect() == []
    kept = jaccard.keep_one(edge)
    assert kept.columns == edge.columns
    ids = [r["doc_id"] for r in kept.select("doc_id").collect()]
    assert by_repr(ids) == by_repr([i for i, _ in ROWS if i not in (6, 11)])


def test_shards_differ_by_one_and_have_no_gaps(table):
    got = ring.assign(table).groupBy("shard").agg(F.count("*").alias("n"), F.countDistinct("slot").alias("d"), F.max("slot").alias("m")).collect()
    sizes = [r["n"] for r in got]
    assert len(got) == 40 and max(sizes) - min(sizes) <= 1
    assert all(r["d"] == r["n"] == r["m"] + 1 for r in got)


def test_walk_equals_placing_key_by_key():
    rng = np.random.default_rng(8)
    owner = ring.owners(5, 3, 64)
    counts = rng.integers(0, 6, 64).tolist()
    plan = ring.walk(counts, owner, 5)
    total = sum(counts)
    room = [total // 5 + (s < total % 5) for s in range(5)]
    given = {}
    over = []
    for c, n in enumerate(counts):
        for r in range(n):
            if room[owner[c]]:
                room[owner[c]] -= 1
                given[c, r] = owner[c]
            else:
                over.append((c, r))
    for c, r in over:
        step = next(k for k in range(c, c + 64) if room[owner[k % 64]])
        room[owner[step % 64]] -= 1
        given[c, r] = owner[step % 64]
    assert {(p.cell, r): p.shard for p in plan for r in range(p.start, p.end)} == given


def test_one_more_shard_moves_little(spark):
    df = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    a, b = ring.assign(df), ring.assign(df, shards=41)
    moved = a.alias("a").join(b.alias("b"), "doc_id").where("a.shard <> b.shard").count()
    assert moved < 20_000 * 0.25


def test_sharding_of_edge_rows(edge, nothing):
    got = ring.assign(edge, shards=4)
    assert got.groupBy("shard").count().count() == 4 and got.count() == len(ROWS)
    assert got.dropDuplicates(["shard", "slot"]).count() == len(ROWS)
    assert ring.assign(nothing).collect() == []


def test_lexicon_matches_one_error():
    words = {"idiot": 2.0, "scum": 1.0, "disgusting": 1.5}
    made = toxicity.Lexicon(words, {"vequ": 3.0})

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row = [i] + [0] * len(b) if (old := row) is None else _next(old, x, b, i)
        return row[-1]

    def _next(old, x, b, i):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(row[-1] + 1, old[j] + 1, old[j - 1] + (x != y)))
        return row

    tries = ["idiot", "idiott", "idot", "idoit", "1diot", "idiots", "xidiot", "scum", "scumm", "scu", "disgustin", "disgsting", "vequx", "vequ", "veq", "", "diot", "iidiot"]
    for w in tries:
        want = (3.0, 0) if w.startswith("vequ") else (0.0, 0)
        for entry, weight in words.items():
            if w == entry:
                want = (weight, 0)
            elif len(entry) >= toxicity.FUZZY_LENGTH and distance(w, entry) == 1:
                want = (weight, 1)
        assert made.look_up(w) == want, w


def test_quotation_counts_apart_from_abuse():
    lexicon = toxicity.Lexicon({"idiot": 2.0}, {})
    names = toxicity.FEATURES
    plain = dict(zip(names, toxicity.features("you are an idiot", lexicon, {})))
    quoted = dict(zip(names, toxicity.features('the "idiot" of the novel', lexicon, {})))
    assert plain["abuse"] > 0 and plain["addressed"] > 0 and plain["quoted"] == 0
    assert quoted["quoted"] > 0 and quoted["abuse"] == 0


def test_toxicity_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = toxicity.fit(docs, labels)
    scored = toxicity.score_documents(docs, model).join(labels, "doc_id").where("held_out").toPandas()
    bad, said = scored["toxic"] == 1, scored["predicted"] == 1
    assert (bad & said).sum() >= 0.9 * bad.sum() and (bad & said).sum() >= 0.9 * said.sum()


def test_toxicity_of_edge_rows(edge, nothing):
    labels = edge.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"))
    model = toxicity.fit(edge, labels)
    got = toxicity.score_documents(edge, model).collect()
    assert len(got) == len(ROWS) and all(0 <= r["score"] <= 1 for r in got)
    empty = toxicity.fit(nothing, labels.limit(0))
    assert toxicity.score_documents(nothing, empty).collect() == []
    assert {r["predicted"] for r in toxicity.score_documents(edge, empty).collect()} == {0}


def test_pipeline_equals_its_brute_force_version(spark, rows):
    got = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    kept = []
    for i, t in rows:
        m = brute.quality(t, quality.STOP_WORDS)
        values = m | {None: 100}
        fails = [100 * m[r.measure] < r.limit * values[r.per] if r.side == "<" else 100 * m[r.measure] > r.limit * values[r.per] for r in quality.RULES]
        if not any(fails):
            kept.append((i, t))
    kept = [r[:2] for r in brute.dedup_lines(kept)]
    found = brute.join_classes(kept)
    kept = [(i, t) for i, t in kept if found[i][1] == i]
    items = [(str(r["item_id"]), r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()]
    kept = [(i, t) for i, t in kept if not brute.contamination(t, items)[1]]
    check_packing(got, kept)


def test_pipeline_stages_take_edge_rows(spark, edge, nothing):
    for docs in (edge, nothing):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, "/root/testdata/sf0.001")
            assert name == "sequences" or out.columns == docs.columns
            out.count()
