"""Text extraction: code blocks, diagnostics, lines, lexical complexity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from driftlock import vocab
from driftlock.functions.bind import let


def lines_of(text: Column) -> Column:
    """Lines of a text; a carriage return before the line feed is not part of the line."""
    return F.split(F.replace(text, F.lit("\r\n"), F.lit("\n")), "\n")


def trim_space(text: Column) -> Column:
    """Trim any white space, not only blanks."""
    return F.regexp_replace(text, r"^[\s\x{A0}]+|[\s\x{A0}]+\z", "")


_FENCE = r"(?i)```(?:csharp|cs)?\s*\n([\s\S]*?)```"
_CODE_LINE = r"^\s*(?:(?:using|namespace|public|internal|sealed|static|class) |//|#|\[)"


def extract_code(text: Column) -> Column:
    """PRJ12: the first fenced block; else everything from the first line that looks like code; trimmed."""

    def unfenced(lines: Column) -> Column:
        first = F.array_position(F.transform(lines, lambda line: line.rlike(_CODE_LINE)), True)
        return F.array_join(F.slice(lines, F.greatest(first, F.lit(1)).cast("int"), F.size(lines)), "\n")

    return trim_space(
        F.when(text.rlike(_FENCE), F.regexp_extract(text, _FENCE, 1)).otherwise(let(lines_of(text), unfenced))
    )


def tail_lines(logs: Column, n: int = vocab.TAIL_LINES) -> Column:
    """PRJ13: the last ``n`` non-empty lines."""
    bare = F.transform(F.split(logs, "\n"), lambda line: F.regexp_replace(line, r"\s+\z", ""))
    return let(
        F.filter(bare, lambda line: line != ""),
        lambda kept: F.slice(kept, F.greatest(F.size(kept) - n + 1, F.lit(1)), n),
    )


def extract_diagnostics(logs: Column, marker: str, cap: int = vocab.DIAGNOSTIC_LINES) -> Column:
    """PRJ13: distinct trimmed lines with the marker in order of appearance; without any, the tail of the log."""
    marked = F.transform(F.filter(F.split(logs, "\n"), lambda line: F.contains(line, F.lit(marker))), trim_space)
    return let(
        F.slice(F.array_distinct(marked), 1, cap),
        lambda found: F.when(F.size(found) > 0, found).otherwise(tail_lines(logs)),
    )


def broken_files(logs: Column) -> Column:
    """PRJ13: files named in compiler error lines, distinct ignoring case."""
    pattern = r"^(.+?\.cs)\(\d+,\d+\):\s*error CS"
    errors = F.filter(F.split(logs, "\n"), lambda line: F.contains(line, F.lit("error CS")))
    named = F.transform(errors, lambda line: trim_space(F.regexp_extract(trim_space(line), pattern, 1)))
    spelled = F.transform(
        F.array_distinct(F.filter(named, lambda f: f != "")),
        lambda f: F.struct(F.lower(f).alias("low"), f.alias("name")),
    )
    return let(
        spelled,
        lambda files: let(
            F.transform(files, lambda f: f["low"]),
            lambda low: F.transform(
                F.filter(files, lambda f, i: F.array_position(low, f["low"]) == i + 1), lambda f: f["name"]
            ),
        ),
    )


def file_diagnostics(logs: Column, marker: str = "error CS", cap: int = vocab.FILE_DIAGNOSTIC_LINES) -> Column:
    """PRJ13: per broken file, in order of appearance, its distinct trimmed error lines, the first ``cap`` of them.

    A line belongs to a file if it holds the file's name in any case; ``array<struct<file, errors>>``.
    """
    marked = F.transform(F.filter(F.split(logs, "\n"), lambda line: F.contains(line, F.lit(marker))), trim_space)

    def of_file(lines: Column, name: Column) -> Column:
        base = F.lower(F.regexp_extract(name, r"([^/\\]*)$", 1))
        return F.slice(F.filter(lines, lambda line: F.contains(F.lower(line), base)), 1, cap)

    def per_file(lines: Column) -> Column:
        return F.transform(broken_files(logs), lambda f: F.struct(f.alias("file"), of_file(lines, f).alias("errors")))

    return let(F.array_distinct(marked), per_file)


# Everything that is not code: comments and quoted text.
_NOISE = {
    "csharp": r'//[^\n]*|/\*[\s\S]*?\*/|"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\.)\'',
    "vb": r"'[^\n]*|\"[^\"\n]*\"",
}
# Decision tokens. A do loop is counted by its closing while. Written without look-around, so that any engine
# with plain regular expressions counts the same.
_DECISIONS = {
    "csharp": r"\b(?:if|while|for|foreach|case|catch|when|and|or)\b|&&|\|\||\?\?=?|\s\?(?:[^?.\[]|$)",
    "vb": r"(?i)\b(?:if|elseif|while|for|do|case|catch|when|andalso|orelse)\b",
}
# Phrases that hold a decision word without being a decision.
_NOT_DECISIONS = r"(?i)\b(?:end +(?:if|while)|(?:exit|continue) +\w+|select +case|case +else|loop +while|for +each)\b"
_DO_LOOP = r"(?i)\bdo +(?:while|until)\b"
_SWITCH_BODY = r"\bswitch\s*\{[^{}]*\}"


def lexical_complexity(text: Column, lang: str = "csharp") -> Column:
    """PRJ4: decision tokens + 1. An estimate over raw text: no syntax tree is built."""
    bare = F.regexp_replace(text, _NOISE[lang], " ")
    if lang == "vb":
        each = F.regexp_count(bare, F.lit(r"(?i)\bfor +each\b"))
        plain = F.regexp_replace(F.regexp_replace(bare, _DO_LOOP, "Do"), _NOT_DECISIONS, " ")
        decisions = F.regexp_count(plain, F.lit(_DECISIONS[lang])) + each
    else:
        arms = F.array_join(F.regexp_extract_all(bare, F.lit(_SWITCH_BODY), F.lit(0)), " ")
        decisions = F.regexp_count(bare, F.lit(_DECISIONS[lang])) + F.regexp_count(arms, F.lit("=>"))
    return F.coalesce(decisions, F.lit(0)) + 1
