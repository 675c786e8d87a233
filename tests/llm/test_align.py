"""Cross-tokenizer alignment against a plain version with the full tokenizers."""

import bisect
import hashlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from conftest import ROWS, by_repr
from tokenizers import Tokenizer

from driftlock.llm import align


@pytest.fixture(scope="module")
def tokenizers():
    full = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    full.encode_special_tokens = True
    # The byte-level alphabet: printable bytes stand for themselves, the others follow from 256 on.
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
    piece = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    return full, letters, piece


def bytes_of_piece(piece):
    if len(piece) == 6 and piece.startswith("<0x") and piece.endswith(">"):
        return bytes([int(piece[3:5], 16)])
    return piece.replace("▁", " ").encode()


def tokens(text, tokenizers):
    full, letters, piece = tokenizers
    if not text:
        return [], []
    raw = b" " + text.encode()
    encoded = full.encode(" " + text, add_special_tokens=False)
    a = [(i, bytes(letters[c] for c in full.id_to_token(i))) for i in encoded.ids]
    b = [(i, bytes_of_piece(piece.id_to_piece(i))) for i in piece.encode(text)]
    if b"".join(x for _, x in a) != raw or b"".join(x for _, x in b) != raw:
        return [], []
    return a, b


def ends(side):
    out, at = [], 0
    for _, raw in side:
        at += len(raw)
        out.append(at)
    return out


def plain(rows, tokenizers):
    docs, count = [], Counter()
    for doc, text in rows:
        a, b = tokens(text, tokenizers)
        ea, eb = ends(a), ends(b)
        of_b = set(eb)
        cuts = [e for e in ea if e in of_b]
        groups = [([], []) for _ in cuts]
        for side, (toks, ends_) in enumerate(((a, ea), (b, eb))):
            for (i, _), e in zip(toks, ends_):
                groups[bisect.bisect_left(cuts, e)][side].append(i)
        at_b = {e: i for (i, _), e in zip(b, eb)}
        links = [(i, at_b[e]) for (i, _), e in zip(a, ea) if e in at_b]
        count.update(links)
        docs.append((doc, a, b, groups, links))
    most = defaultdict(int)
    for (_, y), n in count.items():
        most[y] = max(most[y], n)
    out = []
    for doc, a, b, groups, links in docs:
        told = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        best = sum(count[p] == most[p[1]] for p in links)
        digest = hashlib.sha256(told.encode()).hexdigest() if a else ""
        out.append((doc, len(a), len(b), len(groups), len(links), best, sum(count[p] for p in links), digest))
    return out


MADE = [
    (100, "plain <|endoftext|> text with <s> marks </s> and <0x0A> <unk>"), (101, "a ▁ mark of the pieces is changed to a blank"),
    (102, " two  blanks   and\ttabs\r\n\n  "), (103, "naïve façade 漢字かな \U0001f600\U0001f468‍\U0001f469 עברית"), (104, "ﬁ ligature é é  "),
    (105, "1234567890 0.5 aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa"), (106, "\x01\x7f�﻿"),
]


@pytest.mark.parametrize("block_links", [align.BLOCK_LINKS, 50])
def test_alignment_equals_the_plain_version(table, rows, tokenizers, block_links):
    got = [tuple(r) for r in align.align_documents(table, block_links=block_links).collect()]
    assert sorted(got) == sorted(plain(rows, tokenizers))
    assert sum(r[5] < r[4] for r in got) > 10


def test_alignment_of_edge_rows(edge, nothing, tokenizers, spark):
    small = edge.where("doc_id is null or doc_id <> 8").select("doc_id", "text").union(spark.createDataFrame(MADE, "doc_id bigint, text string"))
    rows = [r for r in ROWS if r[0] != 8] + MADE
    want = plain(rows, tokenizers)
    assert by_repr(tuple(r) for r in align.align_documents(small, block_links=40).collect()) == by_repr(want)
    by_id = {r[0]: r for r in want}
    assert by_id[101][1:] == (0,) * 6 + ("",) and by_id[1][1:] == (0,) * 6 + ("",) and by_id[103][3] > 5
    assert align.align_documents(nothing).collect() == []
    # The long text alone, with all clashing columns.
    long_ = edge.where("doc_id = 8")
    got = align.align_documents(long_).first()
    assert got["n_links"] == got["n_groups"] > 500_000 and got["n_best"] > 0


def test_groups_and_pair_counts(spark, tokenizers):
    docs = spark.createDataFrame([*MADE, (1, None)], "doc_id bigint, text string")
    listed = {r["doc_id"]: r["groups"] for r in align.document_groups(docs).collect()}
    assert listed[1] == [] and listed[101] == []
    for doc, text in MADE:
        if listed[doc]:
            raw = " " + text
            _, _, of_a = align.byte_level()
            _, of_b = align.pieces()
            assert all(b"".join(of_a[i] for i in g["a"]) == b"".join(of_b[i] for i in g["b"]) for g in listed[doc])
            assert b"".join(of_a[i] for g in listed[doc] for i in g["a"]).decode() == raw
    counts = align.pair_counts(docs).collect()
    links = Counter((g["a"][-1], g["b"][-1]) for gs in listed.values() for g in gs)
    assert {(r["a_id"], r["b_id"]): r["links"] for r in counts} == links
    most = {b: max(n for (_, y), n in links.items() if y == b) for _, b in links}
    assert all(r["best"] == (r["links"] == most[r["b_id"]]) for r in counts)
