"""Names of units, files, locks and types."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from driftlock import vocab

# An upper-case letter after a lower-case one, a digit after a letter, or a run of anything else.
_WORD_BREAK = r"(?<=\p{Ll})(?=\p{Lu})|(?<=\p{L})(?=\p{Nd})|[^\p{L}\p{Nd}]+"


def token_text(col: Column) -> Column:
    """PRJ1 as one string: lower-case tokens separated by single spaces."""
    return F.lower(F.trim(F.regexp_replace(col, _WORD_BREAK, " ")))


def tokenize_identifier(col: Column) -> Column:
    """PRJ1: the lower-case words of an identifier. ``HTTPServer`` is one word, ``Vat2X`` is two."""
    return F.filter(F.split(token_text(col), " "), lambda t: t != "")


def base_name(path: Column) -> Column:
    """File name of a path written with either separator."""
    return F.element_at(F.split(path, r"[/\\]"), -1)


def path_segments(path: Column) -> Column:
    return F.split(path, r"[/\\]")


def simple_name(display: Column) -> Column:
    """PRJ10: text after the last dot."""
    return F.substring_index(display, ".", -1)


def last_identifier(type_text: Column) -> Column:
    """PRJ10: ``Ns.Base<T>`` becomes ``Base``."""
    return F.trim(F.substring_index(F.substring_index(type_text, "<", 1), ".", -1))


def safe_id(col: Column) -> Column:
    """PRJ9: every character that is not a word character becomes an underscore."""
    return F.regexp_replace(col, r"(?U)\W", "_")


def short_hash(col: Column) -> Column:
    """PRJ9: first six hex digits of the SHA-256."""
    return F.substring(F.sha2(col, 256), 1, 6)


def lock_name(display: Column, unit_id: Column) -> Column:
    """PRJ9: the name a unit's lock is stored under."""
    return F.concat(safe_id(display), F.lit("_"), short_hash(unit_id), F.lit(vocab.LOCK_SUFFIX))


def lock_of_file(path: Column) -> Column:
    """PRJ10: lock name of a snapshot file, its name up to the first dot (a leading dot is kept)."""
    name = base_name(path)
    return F.when(F.locate(".", name) > 1, F.substring_index(name, ".", 1)).otherwise(name)


def snapshot_label(path: Column) -> Column:
    """PRJ10: readable label of a snapshot file."""
    bare = F.regexp_replace(lock_of_file(path), vocab.LOCK_SUFFIX + "$", "")
    return F.replace(F.regexp_replace(bare, "_[0-9a-f]{6}$", ""), F.lit("_"), F.lit("."))


def friendly_type_name(metadata_name: Column) -> Column:
    """PRJ10: ``Outer+Map`2`` becomes ``Outer.Map<T1, T2>``; a broken arity suffix is dropped."""
    dotted = F.replace(metadata_name, F.lit("+"), F.lit("."))
    head = F.substring_index(dotted, "`", 1)
    rest = F.substring(dotted, F.length(head) + 2, F.length(dotted))
    digits = F.regexp_extract(rest, r"^(\d+)", 1)
    arity = F.coalesce(digits.try_cast("int"), F.lit(0))
    tail = F.substring(rest, F.length(digits) + 1, F.length(rest))
    numbered = F.transform(
        F.sequence(F.lit(1), F.greatest(arity, F.lit(1))), lambda i: F.concat(F.lit("T"), i.cast("string"))
    )
    parameters = F.when(arity == 1, F.lit("T")).otherwise(F.array_join(numbered, ", "))
    return (
        F.when(F.locate("`", dotted) == 0, dotted)
        .when(arity < 1, head)
        .otherwise(F.concat(head, F.lit("<"), parameters, F.lit(">"), tail))
    )


def percent(fraction: Column) -> Column:
    """A fraction as a whole percentage."""
    return F.format_string("%.0f%%", fraction * 100)


def table_cell(col: Column) -> Column:
    """Text that fits one cell of a Markdown table: no line ends, bars escaped."""
    flat = F.replace(F.replace(col, F.lit("\r"), F.lit(" ")), F.lit("\n"), F.lit(" "))
    return F.replace(flat, F.lit("|"), F.lit("\\|"))


def thousands(number: Column) -> Column:
    """A whole number with thousands separators."""
    return F.format_number(number.cast("double"), 0)
