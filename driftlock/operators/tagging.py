"""Facts about units: domain tags, landmines, seams, guards, path patterns."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftlock import vocab
from driftlock.functions.bind import picked
from driftlock.functions.names import base_name, path_segments, token_text
from driftlock.operators.ordered import cap_per_group

# --- PRJ2 -----------------------------------------------------------------------------------------------------


def _keyword_pattern(keywords: list[str]) -> str:
    """Short keywords must be a whole token, longer ones may begin it. Tokens are separated by blanks."""
    whole = [k for k in keywords if len(k) < vocab.PREFIX_KEYWORD_LENGTH]
    begin = [k for k in keywords if len(k) >= vocab.PREFIX_KEYWORD_LENGTH]
    options = []
    if whole:
        options.append(f"(?:{'|'.join(whole)})(?: |$)")
    if begin:
        options.append(f"(?:{'|'.join(begin)})")
    return f"(?:^| )(?:{'|'.join(options)})"


def domain_tags(signals: list[Column], rules: dict[str, list[str]] = vocab.DOMAIN_KEYWORDS) -> Column:
    """PRJ2: tags of a unit from its names, in rule order. Signals are strings or arrays of strings.

    The tokens are matched as one string, one regular expression per rule, which stays inside generated code.
    """
    tokens = token_text(F.concat_ws(" ", *signals))
    return picked([(tokens.rlike(_keyword_pattern(words)), tag) for tag, words in rules.items()])


def tag_domains(df: DataFrame, signals: list[str], rules: dict[str, list[str]] = vocab.DOMAIN_KEYWORDS) -> DataFrame:
    return df.withColumn("tags", domain_tags([F.col(s) for s in signals], rules))


# --- PRJ3 -----------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class FlagRule:
    """A flag raised by an import, a base type, an attribute or a file suffix."""

    flag: str
    imports: list[str] = field(default_factory=list)
    bases: list[str] = field(default_factory=list)
    attributes: list[str] = field(default_factory=list)
    suffixes: list[str] = field(default_factory=list)
    # Base types that count only when none of these namespaces is imported.
    shared_bases: list[str] = field(default_factory=list)
    unless_imports: list[str] = field(default_factory=list)


# What identifies each migration hazard.
LANDMINE_RULES = [
    FlagRule(
        "WCF",
        imports=["System.ServiceModel"],
        attributes=["ServiceContract", "OperationContract", "ServiceBehavior"],
    ),
    FlagRule(
        "WebForms",
        imports=["System.Web.UI"],
        bases=["Page", "UserControl", "MasterPage"],
        suffixes=[".aspx.cs", ".ascx.cs", ".master.cs", ".aspx.vb", ".ascx.vb", ".master.vb"],
    ),
    FlagRule(
        "EF6",
        imports=["System.Data.Entity"],
        bases=["ObjectContext"],
        shared_bases=["DbContext", "DbConfiguration"],
        unless_imports=["Microsoft.EntityFrameworkCore"],
    ),
]


def _imports_any(imports: Column, namespaces: list[str]) -> Column:
    if not namespaces:
        return F.lit(False)
    test = F.lit(False)
    for ns in namespaces:
        test = test | F.exists(imports, lambda u: (u == ns) | u.startswith(ns + "."))
    return F.coalesce(test, F.lit(False))


def _names_any(names: Column, wanted: list[str]) -> Column:
    if not wanted:
        return F.lit(False)
    spelled = [F.lit(n) for w in wanted for n in (w, w + "Attribute")]
    return F.coalesce(F.arrays_overlap(names, F.array(*spelled)), F.lit(False))


def flags(imports: Column, bases: Column, attributes: Column, path: Column, rules: list[FlagRule]) -> Column:
    raised = []
    for rule in rules:
        hit = (
            _imports_any(imports, rule.imports)
            | _names_any(bases, rule.bases)
            | _names_any(attributes, rule.attributes)
            | (_names_any(bases, rule.shared_bases) & ~_imports_any(imports, rule.unless_imports))
        )
        for suffix in rule.suffixes:
            hit = hit | F.coalesce(F.lower(path).endswith(suffix), F.lit(False))
        raised.append((hit, rule.flag))
    return picked(raised)


def flag_rules(df: DataFrame, rules: list[FlagRule], name: str = "flags") -> DataFrame:
    """Raise flags from the columns ``usings``, ``base_types``, ``attributes`` and ``path``."""
    return df.withColumn(
        name, flags(F.col("usings"), F.col("base_types"), F.col("attributes"), F.col("path"), rules)
    )


def detect_landmines(df: DataFrame, rules: list[FlagRule] = LANDMINE_RULES) -> DataFrame:
    """PRJ3: migration hazards of a unit, in rule order."""
    return flag_rules(df, rules, "landmines")


# --- PRJ5, PRJ6, PRJ7 -----------------------------------------------------------------------------------------


def classify_seamability(obstacles: Column, seams: Column) -> Column:
    """PRJ5: can the unit be locked as it is, through a seam it has, or only after a seam is introduced?"""
    n_obstacles = F.coalesce(F.array_size(obstacles), F.lit(0))
    n_seams = F.coalesce(F.array_size(seams), F.lit(0))
    return (
        F.when((n_obstacles > 0) & (n_seams == 0), "NeedsSeam").when(n_seams > 0, "SeamAvailable").otherwise("Pure")
    )


def seam_lists(deps: DataFrame) -> DataFrame:
    """PRJ6: ``(unit_id, seams, obstacles)`` from facts ``(unit_id, kind, type, member)``.

    ``kind`` is ``injected``, ``new`` or ``call``. Lists are distinct, sorted, and hold the first six. Facts are
    made distinct and limited per unit before anything is collected, so a unit with very many facts stays cheap.
    """
    ambient = F.lit(False)
    for type_name, members in vocab.AMBIENT_MEMBERS.items():
        ambient = ambient | ((F.col("type") == type_name) & F.col("member").isin(members))
    resource = F.col("type").isin(vocab.RESOURCE_TYPES)
    obstacle = (
        F.when((F.col("kind") == "new") & resource, F.concat(F.lit("new "), F.col("type")))
        .when((F.col("kind") == "call") & ambient, F.concat_ws(".", "type", "member"))
        .when((F.col("kind") == "call") & resource, F.col("type"))
    )
    seam = F.when((F.col("kind") == "injected") & ~F.col("type").isin(vocab.NON_COLLABORATORS), F.col("type"))
    facts = deps.select(
        "unit_id",
        F.when(seam.isNotNull(), "seam").when(obstacle.isNotNull(), "obstacle").alias("list"),
        F.coalesce(seam, obstacle).alias("item"),
    ).distinct()
    kept = cap_per_group(facts, ["unit_id", "list"], [F.col("item")], vocab.SEAM_LIST_LIMIT)
    return kept.groupBy("unit_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("list") == "seam", F.col("item")))).alias("seams"),
        F.array_sort(F.collect_list(F.when(F.col("list") == "obstacle", F.col("item")))).alias("obstacles"),
    )


def is_side_effecting(tags: Column) -> Column:
    """PRJ7: running the unit could change something outside."""
    return F.arrays_overlap(tags, F.array(*[F.lit(t) for t in vocab.SIDE_EFFECT_TAGS]))


def is_sensitive(tags: Column) -> Column:
    """PRJ7: the unit handles sensitive data; a flag for review, never a reason to skip."""
    return F.arrays_overlap(tags, F.array(*[F.lit(t) for t in vocab.SENSITIVE_TAGS]))


# --- SRC2, SRC3 -----------------------------------------------------------------------------------------------


def is_test_file(path: Column, content: Column) -> Column:
    """SRC2: a test file by its stem, by a folder name, or by what it imports."""
    stem = F.lower(F.regexp_replace(base_name(path), r"\.[^.]*$", ""))
    imports = F.lit(False)
    for text in vocab.TEST_IMPORTS:
        imports = imports | F.coalesce(F.contains(content, F.lit(text)), F.lit(False))
    return (
        stem.rlike(r"tests?\z")
        | F.exists(path_segments(path), lambda s: F.lower(s).endswith("tests"))
        | imports
    )


def is_test_project(name: Column) -> Column:
    """SRC2: project names that mean tests: ``…Tests``, ``….Test`` or ``Test``."""
    low = F.lower(name)
    return low.endswith("tests") | low.endswith(".test") | (low == "test")


def flag_test_files(df: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    return df.withColumn("is_test", is_test_file(F.col(path), F.col(content)))


def flag_generated_path(path: Column) -> Column:
    """SRC3: generated code by file suffix or by the designer folder; null and empty paths are not generated."""
    name = F.lower(base_name(path))
    hit = F.exists(path_segments(path), lambda s: F.lower(s) == vocab.GENERATED_SEGMENT.lower())
    for suffix in vocab.GENERATED_SUFFIXES:
        hit = hit | name.endswith(suffix)
    return F.coalesce(hit, F.lit(False))


# --- PRJ8, JN3, JN4 -------------------------------------------------------------------------------------------

_REGEX_SPECIALS = r"([\\.\[\]{}()+^$|#*?\s-])"
# Pattern lists are configuration files; a list this long is a mistake and is refused, never cut.
MAX_PATTERNS = 100_000
_PATTERNS_PER_EXPRESSION = 500


def matches_pattern(value: Column, pattern: Column) -> Column:
    """PRJ8: glob (``*``, ``?``, not anchored) or plain substring, both ignoring case and slash direction."""
    norm = F.replace(value, F.lit("\\"), F.lit("/"))
    wanted = F.replace(F.trim(pattern), F.lit("\\"), F.lit("/"))
    escaped = F.regexp_replace(wanted, _REGEX_SPECIALS, r"\\$1")
    glob = F.replace(F.replace(escaped, F.lit("\\*"), F.lit(".*")), F.lit("\\?"), F.lit("."))
    regex = F.concat(F.lit("(?iud)^.*"), glob, F.lit(".*$"))
    hit = F.when(wanted.rlike(r"[*?]"), F.rlike(norm, regex)).otherwise(F.contains(F.lower(norm), F.lower(wanted)))
    return F.when((F.coalesce(wanted, F.lit("")) == "") | (F.coalesce(norm, F.lit("")) == ""), False).otherwise(hit)


def pattern_list(patterns: list[str] | DataFrame) -> list[str]:
    """Patterns as a list. A table of patterns is read only after a check of its size."""
    if isinstance(patterns, DataFrame):
        rows = patterns.select("pattern").limit(MAX_PATTERNS + 1).collect()
        if len(rows) > MAX_PATTERNS:
            raise ValueError(f"more than {MAX_PATTERNS} patterns")
        patterns = [r[0] for r in rows]
    return [p.strip().replace("\\", "/") for p in patterns if p and p.strip()]


def _glob_regex(pattern: str) -> str:
    return "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern)


def matches_any(values: list[Column], patterns: list[str] | DataFrame) -> Column:
    """Whether any value matches any pattern, as a filter on the units themselves: no join, no shuffle."""
    wanted = pattern_list(patterns)
    globs = [p for p in wanted if "*" in p or "?" in p]
    plain = [p for p in wanted if p not in globs]
    hit = F.lit(False)
    for value in values:
        norm = F.coalesce(F.replace(value, F.lit("\\"), F.lit("/")), F.lit(""))
        for i in range(0, len(globs), _PATTERNS_PER_EXPRESSION):
            some = "|".join(_glob_regex(p) for p in globs[i : i + _PATTERNS_PER_EXPRESSION])
            hit = hit | ((norm != "") & norm.rlike(f"(?iud)^.*(?:{some}).*$"))
        for i in range(0, len(plain), _PATTERNS_PER_EXPRESSION):
            some = "|".join(re.escape(p) for p in plain[i : i + _PATTERNS_PER_EXPRESSION])
            hit = hit | norm.rlike(f"(?iu)(?:{some})")
    return hit


UNIT_TEXTS = ["path", "display_name", "unit_id"]


def exclude_units(units: DataFrame, patterns: list[str] | DataFrame) -> DataFrame:
    """JN3: units none of whose path, display name or id matches a pattern."""
    return units.where(~matches_any([F.col(c) for c in UNIT_TEXTS], patterns))


def withhold_never_send(units: DataFrame, patterns: list[str] | DataFrame) -> DataFrame:
    """JN4: every unit stays, marked ``never_send`` when a pattern matches."""
    return units.withColumn("never_send", matches_any([F.col(c) for c in UNIT_TEXTS], patterns))
