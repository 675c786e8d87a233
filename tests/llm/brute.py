"""Plain versions of operators that SQL can't express, for small tables."""

from __future__ import annotations

import re
from collections import defaultdict

SPACE = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text: str | None, size: int = 5) -> set[tuple[str, ...]]:
    words = SPACE.findall((text or "").translate(LOWER))
    if len(words) < size:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}


def similar_pairs(sets: dict[int, set], percent: int = 80) -> set[tuple[int, int]]:
    holders = defaultdict(list)
    for key, s in sets.items():
        for x in s:
            holders[x].append(key)
    common: dict[tuple[int, int], int] = defaultdict(int)
    for keys in holders.values():
        for i, a in enumerate(keys):
            for b in keys[i + 1 :]:
                common[min(a, b), max(a, b)] += 1
    return {p for p, c in common.items() if 100 * c >= percent * (len(sets[p[0]]) + len(sets[p[1]]) - c)}


def classes(keys, links) -> dict:
    parent = {k: k for k in keys}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {k: root(k) for k in keys}


def join_classes(rows: list[tuple[int, str | None]]) -> dict[int, tuple[int, int]]:
    sets = {i: shingles(t) for i, t in rows}
    found = classes(sets, similar_pairs(sets))
    return {i: (len(sets[i]), found[i]) for i in sets}


def remove_repeats(rows: list[tuple[int, str | None]], window: int) -> list[tuple[int, int, int, int, bytes]]:
    raws = [(i, (t or "").encode()) for i, t in rows]
    seen: dict[bytes, int] = defaultdict(int)
    for _, raw in raws:
        for p in range(len(raw) - window + 1):
            seen[raw[p : p + window]] += 1
    out = []
    for i, raw in raws:
        gone = bytearray(len(raw))
        for p in range(len(raw) - window + 1):
            if seen[raw[p : p + window]] > 1:
                gone[p : p + window] = b"\1" * window
        spans = sum(1 for p in range(len(gone)) if gone[p] and (p == 0 or not gone[p - 1]))
        out.append((i, len(raw), sum(gone), spans, bytes(b for b, g in zip(raw, gone) if not g)))
    return out


WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
BLANK = "\x20\x09\x0a\x0b\x0c\x0d"


def dedup_lines(rows: list[tuple[int | None, str | None]], min_chars: int = 20, min_docs: int = 3) -> list[tuple]:
    """(doc_id, text, lines, dropped lines) per row; every row is a document."""
    least = -(2**63)
    keyed = []
    for i, t in rows:
        lines = (t or "").split("\n")
        keyed.append((least if i is None else i, i, lines, [x.strip(BLANK).translate(LOWER) for x in lines]))
    holders, owner = defaultdict(int), {}
    for rank, _, _, keys in keyed:
        for k in set(keys):
            if len(k) >= min_chars:
                holders[k] += 1
                owner[k] = max(rank, owner.get(k, least))
    out = []
    for rank, i, lines, keys in keyed:
        left = [x for x, k in zip(lines, keys) if not (holders[k] >= min_docs and owner[k] != rank)]
        out.append((i, "\n".join(left), len(lines), len(lines) - len(left)))
    return out


def contamination(text: str | None, items: list[tuple[str, str | None]], window: int = 10) -> tuple[int, int, list[str]]:
    words = WORD.findall((text or "").translate(LOWER))
    hit, names = set(), set()
    for name, item in items:
        theirs = WORD.findall((item or "").translate(LOWER))
        size = min(window, len(theirs))
        keys = {tuple(theirs[i : i + size]) for i in range(len(theirs) - size + 1)} if size else set()
        for i in range(len(words) - size + 1):
            if tuple(words[i : i + size]) in keys:
                hit.update(range(i, i + size))
                names.add(name)
    return len(words), len(hit), sorted(names)


def quality(text: str | None, stop: list[str]) -> dict[str, int]:
    text = text or ""
    words = SPACE.findall(text)
    lines = [x for x in text.split("\n") if x.strip(BLANK)]
    places = defaultdict(list)
    for i in range(len(words) - 2):
        places[tuple(words[i : i + 3])].append(i)
    repeated = {p + k for at in places.values() if len(at) > 1 for p in at for k in range(3)}
    return {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": sum(c in "#*$%&|<>" for c in text),
        "n_lines": len(lines), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(repeated),
        "n_stop_words": len(set(words) & set(stop)),
    }
