"""Quality rules: a table of thresholds compiled into one projection.

Every measure is a count, and every rule compares one count with a share of another in whole numbers, so the verdict
is the same on every engine. No user function, no shuffle: the scan, the counts and the verdict are one stage.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftlock.functions.bind import let
from driftlock.llm.common import SPACE, strip_space, words_of

# Frequent function words of English, Spanish, French and German.
STOP_WORDS = [
    "the", "and", "of", "to", "in", "that", "is", "for", "with", "as", "was", "on", "are", "this", "be", "or", "from",
    "de", "la", "que", "el", "en", "los", "las", "un", "una", "por", "con", "para", "se", "del",
    "le", "les", "des", "et", "est", "une", "du", "pour", "dans", "sur", "par", "au", "qui",
    "der", "die", "das", "und", "ist", "nicht", "ein", "eine", "mit", "von", "zu", "den", "dem", "für", "auf", "sich",
]


@dataclass(frozen=True)
class Rule:
    """A document fails if ``100 * measure`` lies beyond ``limit * per``; ``per`` of None stands for one hundredth."""

    name: str
    measure: str
    side: str
    limit: int
    per: str | None = None
    base: bool = False

    def column(self, counts: Column) -> Column:
        beyond = 100 * counts[self.measure], self.limit * (counts[self.per] if self.per else F.lit(100))
        return beyond[0] < beyond[1] if self.side == "<" else beyond[0] > beyond[1]

    def sql(self) -> str:
        return f"100 * {self.measure} {self.side} {self.limit} * {self.per or '100'}"


MEASURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_stop_words"]

RULES = (
    Rule("few_words", "n_words", "<", 50, base=True),
    Rule("repeated_windows", "n_repeat_words", ">", 50, "n_words", base=True),
    Rule("short_words", "word_chars", "<", 250, "n_words"),
    Rule("long_words", "word_chars", ">", 1200, "n_words"),
    Rule("symbols", "n_symbols", ">", 10, "n_words"),
    Rule("no_stop_words", "n_stop_words", "<", 2),
    Rule("repeated_lines", "n_dup_lines", ">", 60, "n_lines"),
)


def repeated_words(windows: Column) -> Column:
    """How many words lie in windows of three that occur twice or more; ``windows`` holds a hash per window.

    Windows are sorted by hash with their place, equal neighbours give the places of repeated windows, and the words
    under those places are counted in one walk. Texts without a repeated window stop at the first test.
    """
    placed = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def places(found: Column) -> Column:
        def twin(x: Column, i: Column) -> Column:
            before, after = F.get(found, i - 1)["h"], F.get(found, i + 1)["h"]
            return F.coalesce(x["h"] == before, F.lit(False)) | F.coalesce(x["h"] == after, F.lit(False))

        return F.array_sort(F.transform(F.filter(found, twin), lambda x: x["i"]))

    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))
    walked = F.aggregate(
        F.flatten(F.transform(F.array(placed), places)),
        start,
        lambda s, i: F.struct((s["n"] + i + 3 - F.greatest(i, s["end"])).alias("n"), (i + 3).alias("end")),
        lambda s: s["n"],
    )
    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0).cast("long")).otherwise(walked)


def measures(text: Column) -> Column:
    """The counts that rules read, as one struct; a null text counts as empty.

    Every intermediate value is the variable of a lambda: the optimizer copies a column into each place that reads it,
    also below a filter, and would split the text once for every word.
    """
    text = F.coalesce(text, F.lit(""))
    filled = F.filter(F.split(text, "\n"), lambda line: strip_space(line) != "")
    stop = F.array(*[F.lit(w) for w in STOP_WORDS])

    def windows(words: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(words) - 3)
        hashed = F.transform(starts, lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
        return F.when(F.size(words) >= 3, hashed).otherwise(F.array().cast("array<bigint>"))

    def counts(words: Column, lines: Column, found: Column) -> Column:
        values = {
            "n_words": F.size(words),
            "word_chars": F.length(F.translate(text, SPACE, "")),
            "n_symbols": F.length(text) - F.length(F.translate(text, "#*$%&|<>", "")),
            "n_lines": F.size(lines),
            "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
            "n_repeat_words": repeated_words(found),
            "n_stop_words": F.size(F.array_intersect(words, stop)),
        }
        return F.struct(*[v.cast("long").alias(k) for k, v in values.items()])

    return let(words_of(text), lambda w: let(filled, lambda l: let(windows(w), lambda h: counts(w, l, h))))


def judged(counts: Column, rules: tuple[Rule, ...]) -> Column:
    """The counts with ``base_failed``, ``kept`` and ``failed_rules``, as one struct."""
    none = F.array().cast("array<string>")

    def judge(m: Column) -> Column:
        fails = {r: r.column(m) for r in rules}
        base = [fails[r] for r in rules if r.base]
        names = [F.when(c, F.array(F.lit(r.name))).otherwise(none) for r, c in fails.items()]
        return F.struct(
            *[m[k].alias(k) for k in MEASURES],
            reduce(or_, base, F.lit(False)).alias("base_failed"),
            (~reduce(or_, fails.values(), F.lit(False))).alias("kept"),
            F.concat(none, *names).alias("failed_rules"),
        )

    return let(counts, judge)


def verdicts(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The documents with their counts, ``base_failed``, ``kept`` and the names of all failed rules.

    Input columns that have the name of a count or verdict are replaced.
    """
    results = [*MEASURES, "base_failed", "kept", "failed_rules"]
    others = [c for c in docs.columns if c not in results]
    found = docs.withColumn("__verdict", judged(measures(F.col("text")), rules))
    return found.select(*[f"`{c}`" for c in others], *[F.col(f"__verdict.{c}").alias(c) for c in results])


def keep(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The documents that pass every rule, with their columns as they were. A null text has no words and fails."""
    return docs.where(judged(measures(F.col("text")), rules)["kept"])
