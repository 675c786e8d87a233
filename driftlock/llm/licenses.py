"""License scans by conditional compression.

A block of text that says little beyond a license template compresses to almost nothing once the template is the
dictionary. Blocks are made of words, wherever their lines end: from a trigger word on, the words that a template has
before and after its own trigger, and as many more as may differ, with comment marks left out. Each block is compared
with every template word by word, and what is left is compressed alone and with the template as a raw dictionary. A
difference in a word that tells licenses apart refutes a template, other differences are reported; of the templates left
the one that explains most words is named. Texts are read where they are; nothing is shuffled.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from difflib import SequenceMatcher
from functools import lru_cache

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_BSD_OPENING = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD = (
    f"{_BSD_OPENING} Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
)
_NO_NAMES = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_AS_IS = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."

# The wording by which licenses are declared.
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
    ],
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ],
    "LGPL-3.0": ["This work is licensed under the GNU Lesser General Public License, version 3."],
    "AGPL-3.0": ["This work is licensed under the GNU Affero General Public License, version 3."],
    "BSD-2-Clause": ["Licensed under the BSD 2-Clause License.", f"{_BSD} {_AS_IS}"],
    "BSD-3-Clause": ["Licensed under the BSD 3-Clause License.", f"{_BSD} {_NO_NAMES} {_AS_IS}"],
    # The opening alone does not say which.
    "BSD-2-Clause or BSD-3-Clause or BSD-4-Clause": [_BSD_OPENING],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "CC0-1.0": ["Released under CC0 1.0."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-ND-4.0": ["Licensed under CC BY-ND 4.0."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
}
TRIGGERS = ["licens", "licenc", "permission", "redistribut", "public domain", "released under"]
# Words that tell one license from another: these must agree.
DECIDING = [
    "apache", "mit", "gnu", "general", "lesser", "affero", "bsd", "mozilla", "isc", "cc", "cc0", "by", "sa", "nc", "nd",
    "attribution", "sharealike", "noncommercial", "noderivatives", "clause", "unencumbered", "not", "no", "neither", "nor", "endorse",
]
LEVEL = 3
# Least share of its own compressed size that a block must save, and words in which it may differ, per hundred.
LEAST_SAVED = 35
MOST_DIFFERENT = 20

_TRIGGER = re.compile("|".join(t.replace(" ", r"\s+") for t in TRIGGERS), re.I)
_MAYBE = re.compile("|".join(t.split()[0] for t in TRIGGERS), re.I)
_WORD = re.compile(r"[^\W_]+(?:\.[0-9]+)*")
# Marks of comments at both ends of a line, which are no part of the text.
_COMMENT = re.compile(
    r"^[ \t]*(?:<!--|\(\*|[/*#;%!>|~'\-]+|\"\"\"|(?:dnl|rem|REM)\b)[ \t]*|[ \t]*(?:-->|\*+[/)]|[*#|]+)[ \t\r]*$", re.M
)
# What parts the words of a declaration from words around it that are not its own.
_BREAK = re.compile(r"[\r\n]|[.!?:;][\"')\]]*(?=\s|$)")
# Numbers of list items. They are no words of a license, but a version may look like one at the start of a line.
_NUMBER = re.compile(r"(?:^|(?<=[.,:;]\s)|(?<=\sand\s))[ \t]*\(?([0-9]{1,2}|[a-z])[.)](?=\s)", re.M | re.I)
_CLOSING = re.compile(r"[\"')\]]*[.!?:;]?")


def without_comments(text: str) -> str:
    """The text with spaces for its comment marks, so places stay."""
    return _COMMENT.sub(lambda m: " " * len(m.group()), text)


def normal(text: str) -> str:
    return " ".join(text.lower().split())


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


@dataclass(frozen=True)
class Template:
    name: str
    text: str
    words: tuple[str, ...]
    different: frozenset[str]
    # Words at which a trigger starts, and words in which a block may differ.
    triggers: tuple[int, ...]
    allowed: int


def templates(known: dict[str, list[str]]) -> list[Template]:
    """The templates of a table; a text that several licenses share is one, with all their names."""
    names: dict[tuple[str, ...], list[str]] = {}
    for name, texts in known.items():
        for text in texts:
            shared = names.setdefault(tuple(words(text)), [])
            if name not in shared:
                shared.append(name)
    out = []
    for text in (text for texts in known.values() for text in texts):
        if (own := tuple(words(text))) not in names:
            continue
        starts = [m.start() for m in _WORD.finditer(text)]
        at = sorted({bisect_right(starts, m.start()) - 1 for m in _TRIGGER.finditer(text)})
        name = " or ".join(names.pop(own))
        out.append(Template(name, normal(text), own, frozenset(own), tuple(at or [0]), MOST_DIFFERENT * len(own) // 100))
    return out


class Text:
    """The words of a text, with places, which of them have a break before them, and which number a list."""

    def __init__(self, text: str):
        self.text = without_comments(text)
        places = [m.span() for m in _WORD.finditer(self.text)]
        self.starts = [a for a, _ in places]
        self.ends = [b for _, b in places]
        self.words = [self.text[a:b].lower() for a, b in places]
        self.numbers = {m.start(1) for m in _NUMBER.finditer(self.text)}

    def own(self, start: int, end: int) -> list[str]:
        """Words without those that number a list."""
        return [self.words[i] for i in range(start, end) if self.starts[i] not in self.numbers]

    def broken(self, i: int) -> bool:
        """Whether a line or a sentence ends between word i - 1 and word i."""
        return i <= 0 or i >= len(self.words) or _BREAK.search(self.text, self.ends[i - 1], self.starts[i] + 1) is not None


class Scanner:
    def __init__(self, known: dict[str, list[str]]):
        self.templates = templates(known)
        self.alone = zstandard.ZstdCompressor(level=LEVEL, write_checksum=False, write_content_size=False)
        self.with_ = [
            zstandard.ZstdCompressor(
                level=LEVEL,
                dict_data=zstandard.ZstdCompressionDict(t.text.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT),
                write_checksum=False,
                write_content_size=False,
                write_dict_id=False,
            )
            for t in self.templates
        ]
        self.judge = lru_cache(maxsize=4096)(self._judge)

    def _judge(self, block: str, number: int) -> int:
        """The share that a block saves with the template."""
        raw = block.encode(errors="replace")
        size = len(self.alone.compress(raw))
        return 100 * (size - len(self.with_[number].compress(raw))) // size

    def confirm(self, text: Text, first: int, number: int) -> tuple[int, int, int, int, list[str]] | None:
        """(first word, end word, words that agree, words that differ, the differences) of the block that lies about the
        word ``first``, or None if a deciding word differs or too many do.

        Words at the ends that are not the template's belong to the block as far as its line and sentence go.
        """
        template = self.templates[number]
        theirs, slack = template.words, 2 * template.allowed + 1
        low, high = max(0, first - slack), max(0, first + len(theirs) + slack)
        mine = text.words[low:high]
        if len(template.different.difference(mine)) > template.allowed:
            return None
        codes = SequenceMatcher(None, theirs, mine, autojunk=False).get_opcodes()
        equal = [code for code in codes if code[0] == "equal"]
        if not equal:
            return None
        head, tail = low + equal[0][3], low + equal[-1][4]
        start, end = head, tail
        while not text.broken(start) and head - start <= template.allowed:
            start -= 1
        while not text.broken(end) and end - tail <= template.allowed:
            end += 1
        within = [(theirs[a:b], text.own(low + c, low + d)) for what, a, b, c, d in codes if what != "equal" and equal[0][3] <= c and d <= equal[-1][4]]
        pairs = [(theirs[: equal[0][1]], text.own(start, head)), *within, (theirs[equal[-1][2] :], text.own(tail, end))]
        changes, count = [], 0
        for gone, new in pairs:
            if not gone and not new:
                continue
            if any(w in DECIDING or any(ch.isdigit() for ch in w) for w in (*gone, *new)):
                return None
            count += max(len(gone), len(new))
            changes.append("-" + " ".join(gone) + "+" + " ".join(new))
        return (start, end, sum(e[2] - e[1] for e in equal), count, changes) if count <= template.allowed else None

    def scan(self, raw: str) -> list[dict]:
        """The licenses declared in a text, in order: name, place, share saved and differences."""
        if not _MAYBE.search(raw):
            return []
        text = Text(raw)
        found: list[dict] = []
        for m in _TRIGGER.finditer(text.text):
            if found and m.start() < found[-1]["end"]:
                continue
            at = bisect_right(text.starts, m.start()) - 1
            best, rank = None, None
            for number, template in enumerate(self.templates):
                for first in sorted({at - k for k in template.triggers}):
                    if (same := self.confirm(text, first, number)) is None:
                        continue
                    a, b, agree, count, changes = same
                    start, end = text.starts[a], _CLOSING.match(text.text, text.ends[b - 1]).end()
                    if not a <= at < b or found and start < found[-1]["end"]:
                        continue
                    saved = self.judge(normal(text.text[start:end]), number)
                    if saved >= LEAST_SAVED and (rank is None or (agree - count, saved) > rank):
                        rank = agree - count, saved
                        best = {"name": template.name, "start": start, "end": end, "saved": saved, "differences": count, "changes": changes}
            if best is not None:
                found.append(best)
        return found


FOUND = "array<struct<name: string, start: bigint, end: bigint, saved: bigint, differences: bigint, changes: array<string>>>"
_FOUND_ARROW = pa.list_(
    pa.struct(
        [("name", pa.string()), *((c, pa.int64()) for c in ("start", "end", "saved", "differences")), ("changes", pa.list_(pa.string()))]
    )
)


def _scan(known: dict[str, list[str]]):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(known)
        for batch in batches:
            found = [scanner.scan(t.as_py() or "") for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, _FOUND_ARROW)], names=[*batch.schema.names, "licenses"])

    return scan


def find_licenses(docs: DataFrame, known: dict[str, list[str]] | None = None) -> DataFrame:
    """The documents with ``licenses``: the declarations found, with places as code points, end exclusive.

    A null or empty text declares none. An input column of that name is replaced.
    """
    base = docs.drop("licenses")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields)
    return base.mapInArrow(_scan(known or TEMPLATES), f"{schema}, licenses {FOUND}")


def report(docs: DataFrame) -> DataFrame:
    """One row per document: how many declarations, how many of them word for word, and the licenses by name."""
    found = find_licenses(docs.select("doc_id", "text"))
    exact = F.filter("licenses", lambda x: x["differences"] == 0)
    spans = F.transform("licenses", lambda x: F.concat_ws(":", x["name"], x["start"].cast("string"), x["end"].cast("string")))
    return found.select(
        "doc_id",
        F.size("licenses").cast("long").alias("n_licenses"),
        F.size(exact).cast("long").alias("n_exact"),
        F.array_join(F.array_sort(F.array_distinct(F.col("licenses.name"))), ",").alias("licenses"),
        F.array_join(spans, ",").alias("spans"),
    )
