"""Secret scans inside the scan stage: patterns with places, and sliding-window entropy over candidate strings.

No user function: matches are found by regular expressions, their places follow from the lengths of what lies between
them, and the entropy of a window is a running sum. For a window of W characters with counts c the entropy is
log2(W) - sum(c * log2(c)) / W; moving on by one character changes two counts, so the sum changes by two differences
of a small table of whole numbers, and no rounding can differ between engines.
"""

from __future__ import annotations

from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftlock.functions.bind import let

# The patterns of the base kinds, with the letters that may stand in either case spelt out. A run that is
# too short is dropped, so the least length of access and hex runs stands in the pattern; short runs are never listed.
ASSIGN_NAMES = ["password", "passwd", "secret", "token", "api_?key"]
ACCESS = "AKIA[A-Z0-9]{12,}"
HEX = "[0-9a-f]{32,}"
VALUE = "[A-Za-z0-9+/_.=-]+"


def either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


ASSIGN = "(" + "|".join(map(either_case, ASSIGN_NAMES)) + ")[\"']?\\x20*[:=]\\x20*[\"']?(" + VALUE + ")"
KINDS = ["assign", "access", "hex", "entropy"]

WINDOW = 20
CANDIDATE = "[A-Za-z0-9+/_-]+"
# Bits per character that a window of each class must have. Twenty random hex digits have 3.2 on average.
CLASS_BITS = {"hex": 2.9, "letters_digits": 3.6, "base64": 3.8}
UNIT = 1_000_000
TERMS = [round(c * log2(c) * UNIT) if c else 0 for c in range(WINDOW + 1)]
# Strings that look random and are none: examples in manuals, alphabets, counting digits.
ALLOWED = ["EXAMPLE", "abcdefghij", "ABCDEFGHIJ", "0123456789", "1234567890", "00000000"]
ALLOWED_SHAPES = ["^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"]


def most_terms(bits: float) -> int:
    """The largest sum of a window whose entropy is at least ``bits``."""
    return int((log2(WINDOW) - bits) * WINDOW * UNIT)


def found(text: Column, pattern: str) -> Column:
    """All matches, leftmost and without overlap, as (start, end, match), in code points."""

    def placed(matches: Column, between: Column) -> Column:
        step = lambda s, i: F.struct(
            (s["at"] + F.length(F.get(between, i)) + F.length(F.get(matches, i))).alias("at"),
            F.concat(
                s["out"],
                F.array(
                    F.struct(
                        (s["at"] + F.length(F.get(between, i))).cast("long").alias("start"),
                        (s["at"] + F.length(F.get(between, i)) + F.length(F.get(matches, i))).cast("long").alias("end"),
                        F.get(matches, i).alias("match"),
                    )
                ),
            ).alias("out"),
        )
        start = F.struct(F.lit(0).alias("at"), none.alias("out"))
        return F.aggregate(F.sequence(F.lit(0), F.size(matches) - 1), start, step, lambda s: s["out"])

    none = F.array().cast("array<struct<start: bigint, end: bigint, match: string>>")
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return let(
        matches,
        lambda m: F.when(F.size(m) == 0, none).otherwise(let(F.split(text, pattern, -1), lambda b: placed(m, b))),
    )


def base_spans(text: Column) -> Column:
    """(start, end, kind number) of the base kinds; matches that are too short for their kind go."""
    def kind(pattern: str, number: int, passes) -> Column:
        kept = F.filter(found(text, pattern), lambda m: passes(m["match"]))
        return F.transform(kept, lambda m: F.struct(m["start"].alias("start"), F.lit(number).alias("kind"), m["end"].alias("end")))

    return F.concat(
        kind(ASSIGN, 0, lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= 8),
        kind(ACCESS, 1, lambda m: F.lit(True)),
        kind(HEX, 2, lambda m: F.lit(True)),
    )


def _class_limit(string: Column) -> Column:
    """The largest sum that a window of the string's character class may have."""
    return (
        F.when(string.rlike("^([0-9a-f]+|[0-9A-F]+)$"), F.lit(most_terms(CLASS_BITS["hex"])))
        .when(string.rlike("^[A-Za-z0-9]+$"), F.lit(most_terms(CLASS_BITS["letters_digits"])))
        .otherwise(F.lit(most_terms(CLASS_BITS["base64"])))
    )


def _allowed(string: Column) -> Column:
    hit = F.lit(False)
    for text in ALLOWED:
        hit = hit | string.contains(text)
    for shape in ALLOWED_SHAPES:
        hit = hit | string.rlike(shape)
    return hit


def random_windows(string: Column) -> Column:
    """(first, last) place of a window of the string with enough entropy; null if there is none."""
    terms = F.array(*[F.lit(t) for t in TERMS])

    def scan(codes: Column) -> Column:
        # counts: of each code; total: the sum of terms over them; the window ends at place i.
        start = F.struct(
            F.array_repeat(F.lit(0), 128).alias("counts"), F.lit(0).alias("total"), F.lit(-1).alias("first"), F.lit(-1).alias("last")
        )

        def changed(counts: Column, code: Column, by: int) -> Column:
            return F.concat(
                F.slice(counts, F.lit(1), code), F.array(F.get(counts, code) + by), F.slice(counts, code + 2, F.lit(128))
            )

        def enter(state: Column, i: Column) -> Column:
            code = F.get(codes, i)
            now = F.get(state["counts"], code)
            return F.struct(
                changed(state["counts"], code, 1).alias("counts"),
                (state["total"] + F.get(terms, now + 1) - F.get(terms, now)).alias("total"),
            )

        def leave(state: Column, i: Column) -> Column:
            code = F.get(codes, i - WINDOW)
            now = F.get(state["counts"], code)
            out = F.struct(
                changed(state["counts"], code, -1).alias("counts"),
                (state["total"] + F.get(terms, now - 1) - F.get(terms, now)).alias("total"),
            )
            return F.when(i >= WINDOW, out).otherwise(F.struct(state["counts"].alias("counts"), state["total"].alias("total")))

        def step(state: Column, i: Column) -> Column:
            def marked(after: Column) -> Column:
                good = (i >= WINDOW - 1) & (after["total"] <= limit)
                return F.struct(
                    after["counts"].alias("counts"),
                    after["total"].alias("total"),
                    F.when(good & (state["first"] < 0), i - WINDOW + 1).otherwise(state["first"]).alias("first"),
                    F.when(good, i - WINDOW + 1).otherwise(state["last"]).alias("last"),
                )

            return let(leave(state, i), lambda left: let(enter(left, i), marked))

        limit = _class_limit(string)
        return F.aggregate(
            F.sequence(F.lit(0), F.size(codes) - 1),
            start,
            step,
            lambda s: F.when(s["first"] >= 0, F.struct(s["first"].alias("first"), s["last"].alias("last"))),
        )

    return let(F.transform(F.split(string, ""), lambda c: F.ascii(c)), scan)


def entropy_spans(text: Column) -> Column:
    """(start, end, kind number) from the first to the last window with enough entropy of each candidate string.

    A candidate is a string of at least ``WINDOW`` letters, digits and ``+/_-`` that has a digit and a letter and is
    not on the allow list.
    """
    long_ = lambda m: (F.length(m["match"]) >= WINDOW) & m["match"].rlike("[0-9]") & m["match"].rlike("[A-Za-z]") & ~_allowed(m["match"])
    windows = F.transform(
        F.filter(found(text, CANDIDATE_RUN), long_),
        lambda m: let(
            random_windows(m["match"]),
            lambda w: F.struct(
                (m["start"] + w["first"]).alias("start"), F.lit(3).alias("kind"), (m["start"] + w["last"] + WINDOW).alias("end")
            ),
        ),
    )
    return F.filter(windows, lambda s: s["start"].isNotNull())


# Only long strings are cut out; of a shorter one nothing is kept.
CANDIDATE_RUN = CANDIDATE[:-1] + "{" + str(WINDOW) + ",}"


def _listed(spans: Column) -> Column:
    kinds = F.array(*[F.lit(k) for k in KINDS])
    texts = F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string")))
    return F.array_join(texts, ",")


def scan(docs: DataFrame) -> DataFrame:
    """The documents with ``secrets``: sorted (start, kind number, end) of all spans in code points, end exclusive.

    A null text is empty and has none. An input column of that name is replaced.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.withColumn("secrets", F.array_sort(F.concat(base_spans(text), entropy_spans(text))))


def report(docs: DataFrame) -> DataFrame:
    """The counts per kind, the digest of the base spans and the list of all spans."""
    spans = F.col("secrets")
    count = lambda k: F.size(F.filter(spans, lambda s: s["kind"] == k)).cast("long")
    return scan(docs.select("doc_id", "text")).select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        count(3).alias("n_entropy"),
        F.sha2(_listed(F.filter(spans, lambda s: s["kind"] < 3)), 256).alias("base_sha256"),
        _listed(spans).alias("spans"),
    )
