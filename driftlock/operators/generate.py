"""Input generation: literals, candidates and rows for tables of rules.

``rules(rule_id, params array<struct<name,type>>, rule_text)`` holds one rule per row. Everything a rule needs is
in its own row, so mining, candidates and rows are expressions over that row: no shuffle, any number of rules.
"""

from __future__ import annotations

from math import ceil

from py4j.protocol import Py4JJavaError
from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftlock import vocab
from driftlock.functions.bind import let
from driftlock.functions.canonical import stable_fraction
from driftlock.operators.ordered import prefix_sum

# --- GEN1 -----------------------------------------------------------------------------------------------------

# Digits may be grouped by underscores; whole numbers may be hexadecimal, others may have an exponent.
_NUMBER = r"-?(?:0[xX][0-9a-fA-F_]+[uUlL]{0,2}|\d[\d_]*(?:\.\d[\d_]*)?(?:[eE][+-]?\d+)?(?:[uU][lL]?|[lL][uU]?|[mMdDfF])?)"
# A quote after a backslash belongs to the text.
_TEXT = r"\"(?:[^\"\\]|\\.)*+\"|'(?:[^'\\]|\\.)*+'"
ESCAPED = {'\\"': '"', "\\'": "'", "\\n": "\n", "\\t": "\t", "\\r": "\r"}
_PREDICATES = "StartsWith|EndsWith|Contains|Equals|IndexOf|IsMatch|Match"
_COMPARE = {"csharp": r"<=|>=|==|!=|<|>", "sql": r"<=|>=|<>|!=|==|=|<|>"}
_WORDS = {"csharp": r"case|is|not|or|and|when", "sql": r"when|and|or|between|like|in\s*\("}
# Operators that only look like comparisons.
_NOT_COMPARE = {"csharp": r"<<=?|>>=?", "sql": r"<<|>>"}


def _matches(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _unquote(literals: Column) -> Column:
    def plain(s: Column) -> Column:
        inner = F.substring(s, F.lit(2), F.length(s) - 2)
        # A doubled backslash is set aside first, so that what follows it is not read as an escape.
        inner = F.replace(inner, F.lit("\\\\"), F.lit("\x00"))
        for written, meant in ESCAPED.items():
            inner = F.replace(inner, F.lit(written), F.lit(meant))
        return F.replace(inner, F.lit("\x00"), F.lit("\\"))

    return F.transform(literals, plain)


def _decided(text: Column, literal: str, dialect: str) -> Column:
    """Literals next to a comparison, after a deciding word, or before a switch arm."""
    compare, words = _COMPARE[dialect], _WORDS[dialect]
    found = [
        _matches(text, rf"(?:{compare})\s*({literal})"),
        _matches(text, rf"({literal})\s*(?:{compare})"),
        _matches(text, rf"(?i)\b(?:{words})\s*({literal})"),
    ]
    return F.concat(*found)


def _digits(number: Column) -> Column:
    """A number literal as plain decimal digits: no suffix, no underscores, hexadecimal digits converted."""
    bare = F.replace(number, F.lit("_"), F.lit(""))
    hexadecimal = F.regexp_extract(bare, "^-?0[xX]([0-9a-fA-F]+)[uUlL]*$", 1)
    sign = F.when(bare.startswith("-"), "-").otherwise("")
    return F.when(hexadecimal != "", F.concat(sign, F.conv(hexadecimal, 16, 10))).otherwise(
        F.regexp_replace(bare, "[uUlLmMdDfF]+$", "")
    )


def _typed(numbers: Column, test, cast: str) -> Column:
    values = F.transform(F.filter(numbers, test), lambda n: _digits(n).try_cast(cast))
    return F.array_sort(F.array_distinct(F.array_compact(values)))


def mined(rule_text: Column, dialect: str = "csharp") -> Column:
    """Sorted, distinct literals a rule decides on: ``struct<strings, ints, decimals, doubles>``.

    A multiplier or a format string decides nothing and is not mined. Numbers inside quoted text are text. A
    switch arm ends in an arrow, which is not a comparison elsewhere.
    """
    inside = rf"((?:[^()\"']|{_TEXT})*)"

    def parts(t: Column) -> Column:
        calls = F.array_join(_matches(t, rf"\.(?:{_PREDICATES})\s*\({inside}\)"), " , ")
        listed = F.array_join(_matches(t, rf"(?i)\bin\s*\({inside}\)"), " , ") if dialect == "sql" else F.lit("")
        plain = F.regexp_replace(t, _NOT_COMPARE[dialect], " ")
        return F.struct(
            plain.alias("plain"),
            F.regexp_replace(plain, _TEXT, "''").alias("bare"),
            F.concat_ws(" , ", calls, listed).alias("args"),
        )

    def numbers(p: Column) -> Column:
        arguments = F.regexp_replace(p["args"], _TEXT, "''")
        return F.concat(
            _decided(F.regexp_replace(p["bare"], "=>", " "), _NUMBER, dialect),
            _matches(p["bare"], rf"({_NUMBER})\s*=>"),
            # Arguments are separated by commas; neighbours share one, so the separator is doubled first.
            _matches(F.replace(arguments, F.lit(","), F.lit(" ,, ")), rf"(?:^|,)\s*({_NUMBER})\s*(?:,|$)"),
        )

    def literals(p: Column) -> Column:
        texts = F.concat(
            _decided(p["plain"], _TEXT, dialect),
            _matches(p["plain"], rf"({_TEXT})\s*=>"),
            _matches(p["args"], f"({_TEXT})"),
        )
        return let(
            numbers(p),
            lambda n: F.struct(
                F.array_sort(F.array_distinct(_unquote(texts))).alias("strings"),
                _typed(n, lambda x: x.rlike(r"^-?(?:0[xX][0-9a-fA-F_]+|[\d_]+)[uUlL]*$"), "bigint").alias("ints"),
                _typed(n, lambda x: x.rlike(r"^-?\d.*[mM]$"), "decimal(38,10)").alias("decimals"),
                _typed(n, lambda x: ~x.rlike("^-?0[xX]") & x.rlike(r"[dDfF]$|\.[\d_]+(?:[eE][+-]?\d+)?$|[eE][+-]?\d+$"), "double").alias("doubles"),
            ),
        )

    return let(parts(rule_text), literals)


def decimal_text(value: Column) -> Column:
    """A decimal without trailing zeros."""
    return F.regexp_replace(F.regexp_replace(value.cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")


def mine_literals(rules: DataFrame, dialect: str = "csharp") -> DataFrame:
    """GEN1: one row per literal, ``(rule_id, kind, literal)`` with the literal as text."""
    def tagged(kind: str, values: Column) -> Column:
        return F.transform(values, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("literal")))

    def parts(m: Column) -> Column:
        return F.concat(
            tagged("string", m["strings"]),
            tagged("int", F.transform(m["ints"], _plain)),
            tagged("decimal", F.transform(m["decimals"], decimal_text)),
            tagged("double", F.transform(m["doubles"], _plain)),
        )

    return rules.select("rule_id", F.inline(let(mined(F.col("rule_text"), dialect), parts)))


def mine_boundaries(rules: DataFrame, dialect: str = "csharp") -> DataFrame:
    """Numeric boundaries with the parameter they are compared to: ``(rule_id, param, literal double)``."""
    compare = _COMPARE[dialect]
    bare = F.regexp_replace(F.regexp_replace("rule_text", _TEXT, "''"), "=>", " ")
    right = rf"([A-Za-z_]\w*)\s*(?:{compare})\s*({_NUMBER})"
    left = rf"({_NUMBER})\s*(?:{compare})\s*([A-Za-z_]\w*)"
    pairs = F.concat(
        F.arrays_zip(_matches(bare, right, 1).alias("param"), _matches(bare, right, 2).alias("number")),
        F.arrays_zip(_matches(bare, left, 2).alias("param"), _matches(bare, left, 1).alias("number")),
    )
    number = _digits(F.col("p.number")).try_cast("double")
    return (
        rules.select("rule_id", F.explode(pairs).alias("p"))
        .select("rule_id", "p.param", number.alias("literal"))
        .where("literal is not null")
        .distinct()
    )


# --- GEN2 -----------------------------------------------------------------------------------------------------

_INT_TYPES = ["int", "int32", "integer", "long", "int64", "bigint", "short", "int16", "smallint", "byte", "tinyint"]
_WIDE_INT_TYPES = ["int", "int32", "integer", "long", "int64", "bigint"]
_FLOAT_TYPES = ["float", "single", "real"]
_NATIVE_NUMERIC = [*_WIDE_INT_TYPES, "decimal", "double", *_FLOAT_TYPES]


def _type(param_type: Column) -> Column:
    """Lower-case type name without the nullable mark."""
    return F.lower(F.regexp_replace(F.trim(param_type), r"\?$", ""))


def _repeat_to(unit: str, length: Column) -> Column:
    return F.substring(F.repeat(F.lit(unit), F.ceil(length / len(unit)).cast("int")), F.lit(1), length.cast("int"))


def rich_string(m: Column) -> Column:
    """Letters and digits, as long as the smallest mined length between 8 and 256, at most 64; 20 without one."""
    guards = F.filter(m["ints"], lambda i: (i >= 8) & (i <= 256))
    length = F.least(F.lit(64), F.coalesce(F.array_min(guards), F.lit(20)))
    return _repeat_to("Ab1", length)


def _around(values: Column, text) -> Column:
    return F.flatten(F.transform(values, lambda v: F.array(text(v - 1), text(v), text(v + 1))))


def _texts(*values: str | None) -> Column:
    return F.array(*[F.lit(v).cast("string") for v in values])


def _plain(value: Column) -> Column:
    return value.cast("string")


def _first(values: Column, cap: int | None) -> Column:
    """The distinct values, the first ``cap`` of them."""
    distinct = F.array_distinct(values)
    return distinct if cap is None else F.slice(distinct, 1, cap)


def _enum_members(kind: Column) -> Column:
    inner = F.regexp_extract(kind, r"^enum\((.*)\)$", 1)
    return F.filter(F.transform(F.split(inner, ","), lambda s: F.trim(s)), lambda s: s != "")


def candidates(param_type: Column, m: Column, cap: int | None = vocab.CANDIDATES_PER_PARAM) -> Column:
    """GEN2: candidate values of a parameter as text, mined boundaries first, then a small catalog; first six.

    A null element is the null candidate, which is not the empty string. Without a cap all are given.
    """

    def dec(v: Column) -> Column:
        return decimal_text(v.cast("decimal(38,10)"))

    values = let(
        _type(param_type),
        lambda kind: F.when(kind.isin("string"), F.concat(F.array(rich_string(m)), _texts("12345"), m["strings"], _texts("", None)))
        .when(kind.isin(_INT_TYPES), F.concat(_around(m["ints"], _plain), _texts("0", "1", "-1")))
        .when(
            kind.startswith("decimal"),
            F.concat(_around(m["decimals"], dec), F.transform(m["ints"], _plain), _texts("0", "1", "-1")),
        )
        .when(kind.isin("double"), F.concat(_around(m["doubles"], _plain), _texts("0.0", "1.0")))
        .when(
            kind.isin(_FLOAT_TYPES),
            F.concat(_around(m["doubles"], lambda v: v.cast("float").cast("string")), _texts("0.0", "1.0")),
        )
        .when(kind.isin("bool", "boolean"), _texts("false", "true"))
        .when(kind.isin("char"), _texts("a", "0"))
        .when(kind.startswith("enum("), _enum_members(F.trim(param_type)))
        .otherwise(_texts(None)),
    )
    return _first(values, cap)


# --- GEN3, GEN4 -----------------------------------------------------------------------------------------------


def guards(rule_text: Column, param: Column) -> Column:
    """GEN4: the string guards a rule applies to one parameter, as a struct of arrays.

    The patterns are constants that capture the receiver; the receiver is then compared with the parameter, so
    nothing is compiled per row.
    """
    compare = _COMPARE["csharp"]

    def of_param(pattern: str, name_group: int, value_group: int) -> Column:
        pairs = F.arrays_zip(
            _matches(rule_text, pattern, name_group).alias("name"),
            _matches(rule_text, pattern, value_group).alias("value"),
        )
        return F.transform(F.filter(pairs, lambda p: p["name"] == param), lambda p: p["value"])

    def call(member: str) -> Column:
        return _unquote(of_param(rf"\b(\w+)\.{member}\s*\(\s*@?({_TEXT})", 1, 2))

    def not_empty(values: Column) -> Column:
        return F.filter(values, lambda v: v != "")

    lengths = F.transform(
        F.concat(
            of_param(rf"\b(\w+)\.Length\s*(?:{compare})\s*(\d+)", 1, 2),
            of_param(rf"\b(\d+)\s*(?:{compare})\s*(\w+)\.Length\b", 2, 1),
        ),
        lambda n: n.try_cast("int"),
    )
    exact = F.concat(
        _unquote(of_param(rf"\b(\w+)\s*==\s*({_TEXT})", 1, 2)),
        _unquote(of_param(rf"({_TEXT})\s*==\s*(\w+)\b", 2, 1)),
        not_empty(call("Equals")),
    )
    static = of_param(rf"\bRegex\.IsMatch\s*\(\s*(\w+)\s*,\s*@?({_TEXT})", 1, 2)
    instance = of_param(rf"\bnew (?:\w+\.)*Regex\s*\(\s*@?({_TEXT})[^()]*\)\s*\.IsMatch\s*\(\s*(\w+)", 2, 1)
    char_call = r"\b[cC]har\.Is"
    return F.struct(
        F.array_sort(F.array_distinct(F.array_compact(lengths))).alias("lengths"),
        F.try_element_at(not_empty(call("StartsWith")), F.lit(1)).alias("prefix"),
        F.try_element_at(not_empty(call("EndsWith")), F.lit(1)).alias("suffix"),
        F.array_distinct(not_empty(call("Contains"))).alias("contains"),
        F.array_distinct(exact).alias("exact"),
        rule_text.rlike(char_call + "Letter").alias("letter"),
        rule_text.rlike(char_call + "(?:Digit|LetterOrDigit)").alias("digit"),
        F.array_distinct(_unquote(F.concat(static, instance))).alias("regexes"),
    )


def has_guards(g: Column) -> Column:
    """GEN4: any guard besides equality, which the literal miner already covers."""
    return (
        (F.size(g["lengths"]) > 0)
        | g["prefix"].isNotNull()
        | g["suffix"].isNotNull()
        | (F.size(g["contains"]) > 0)
        | g["letter"]
        | g["digit"]
        | (F.size(g["regexes"]) > 0)
    )


def extract_guards(rules: DataFrame) -> DataFrame:
    """GEN4: ``(rule_id, param, guards, has_guards)`` for every string parameter."""
    return (
        rules.select("rule_id", "rule_text", F.explode("params").alias("p"))
        .where(_type(F.col("p.type")) == "string")
        .select("rule_id", F.col("p.name").alias("param"), guards(F.col("rule_text"), F.col("p.name")).alias("guards"))
        .withColumn("has_guards", has_guards(F.col("guards")))
    )


def guard_witnesses(g: Column, regex_witnesses: Column | None = None) -> Column:
    """GEN3: values on both sides of every guard, the plain witness first, then near misses.

    ``regex_witnesses`` is an optional ``map<pattern, array<value>>`` of verified values, as GEN5 finds them.
    """
    longest = vocab.SYNTH_STRING_LENGTH
    # least() ignores nulls, so a rule without length guards is told apart first.
    floor = F.when(F.size(g["lengths"]) > 0, F.least(F.lit(longest), F.array_min(g["lengths"]))).otherwise(20)
    base = F.greatest(F.lit(1), floor)
    top = F.array_max(g["lengths"])
    chars = g["letter"] | g["digit"]
    alnum = _repeat_to("Ab1", base)
    values = F.array_compact(
        F.array(
            alnum,
            F.when(floor >= 2, _repeat_to("Ab1", floor - 1)),
            F.when(chars, _repeat_to("123", base)),
            F.when(chars, _repeat_to("Abc", base)),
            F.concat(g["prefix"], alnum),
            F.concat(alnum, F.try_element_at(g["contains"], F.lit(1))),
            F.concat(alnum, g["suffix"]),
            F.when((top > floor) & (top < longest), _repeat_to("Ab1", top + 1)),
        )
    )
    if regex_witnesses is not None:
        found = F.flatten(
            F.transform(
                g["regexes"],
                lambda p: F.coalesce(
                    F.try_element_at(regex_witnesses, p), F.array().cast("array<string>")
                ),
            )
        )
        values = F.concat(values, found)
    values = F.concat(values, g["exact"])
    return F.array_distinct(F.filter(values, lambda v: F.length(v) <= longest))


def string_candidates(
    rule_text: Column, param: Column, m: Column, regex_witnesses: Column | None = None, cap: int | None = vocab.STRING_CANDIDATES
) -> Column:
    """GEN3: candidates of a string parameter: guard witnesses (or the rich string), then mined strings; first ten."""

    def values(g: Column) -> Column:
        first = F.when(has_guards(g), guard_witnesses(g, regex_witnesses)).otherwise(F.array(rich_string(m)))
        return F.concat(first, _texts("12345"), m["strings"], _texts("", None))

    return _first(let(guards(rule_text, param), values), cap)


def rule_patterns(rules: DataFrame) -> list[str]:
    """GEN3: the distinct regular expressions that the rules apply to their string parameters.

    There are as many as rules have written out. One that Spark's engine doesn't know is left out: it has no witness.
    """
    found = extract_guards(rules).select(F.explode("guards.regexes").alias("p")).distinct().collect()
    compile_ = rules.sparkSession._jvm.java.util.regex.Pattern.compile
    known = []
    for pattern in sorted(r["p"] for r in found):
        try:
            compile_(pattern)
        except (Py4JJavaError, IllegalArgumentException):
            continue
        known.append(pattern)
    return known


def witness_dictionary(witnesses: DataFrame) -> Column:
    """GEN3: what GEN5 found as ``map<pattern, array<value>>``, one literal that every rule is looked up in.

    It has two values per pattern, each at most as long as a generated string may be.
    """
    fits = [F.when(F.length(c) <= vocab.SYNTH_STRING_LENGTH, F.col(c)).alias(c) for c in ("match", "non_match")]
    rows = witnesses.select("pattern", *fits).collect()
    entries = [F.struct(F.lit(r["pattern"]), F.array_compact(_texts(r["match"], r["non_match"]))) for r in rows]
    if not entries:
        return F.create_map().cast("map<string, array<string>>")
    return F.map_from_entries(F.array(*entries))


def rule_candidates(
    rules: DataFrame,
    dialect: str = "csharp",
    regex_witnesses: Column | None = None,
    cap: int | None = vocab.CANDIDATES_PER_PARAM,
    string_cap: int | None = vocab.STRING_CANDIDATES,
) -> DataFrame:
    """Rules with ``found``: the ``mined`` literals and, per parameter in order, its ``candidates`` (GEN2, GEN3).

    ``regex_witnesses`` is a ``witness_dictionary``. ``left_out`` counts for each parameter the candidates beyond the cap
    of its kind; without a cap there are none.
    """

    def capped(values: Column, most: int | None) -> Column:
        kept = values if most is None else F.slice(values, 1, most)
        return F.struct(kept.alias("kept"), (F.size(values) - F.size(kept)).alias("left_out"))

    def per_param(m: Column) -> Column:
        values = F.transform(
            "params",
            lambda p: F.when(
                _type(p["type"]) == "string",
                let(
                    string_candidates(F.col("rule_text"), p["name"], m, regex_witnesses, None),
                    lambda v: capped(v, string_cap),
                ),
            ).otherwise(let(candidates(p["type"], m, None), lambda v: capped(v, cap))),
        )
        return let(
            values,
            lambda v: F.struct(
                m.alias("mined"),
                F.transform(v, lambda x: x["kept"]).alias("candidates"),
                F.transform(v, lambda x: x["left_out"]).alias("left_out"),
            ),
        )

    return rules.withColumn("found", let(mined(F.col("rule_text"), dialect), per_param))


def candidate_rows(with_candidates: DataFrame) -> DataFrame:
    """GEN2 in long form: ``(rule_id, param_no, param, type, candidate_no, value)``, numbered from 1.

    The lists are exploded as an expression, as in ``_row_table``: a filter on a named column would compute them once more,
    and in the tasks that read the rules, before these are dealt.
    """
    per_param = F.transform(
        "found.candidates",
        lambda values, i: F.struct(
            (i + 1).alias("param_no"),
            F.get(F.col("params"), i)["name"].alias("param"),
            F.get(F.col("params"), i)["type"].alias("type"),
            values.alias("values"),
        ),
    )
    return (
        with_candidates.select("rule_id", F.inline(per_param))
        .select("rule_id", "param_no", "param", "type", F.posexplode("values").alias("j", "value"))
        .select("rule_id", "param_no", "param", "type", (F.col("j") + 1).alias("candidate_no"), "value")
    )


# --- GEN6, GEN7 -----------------------------------------------------------------------------------------------


def _vary(base: Column, position: Column, value: Column) -> Column:
    return F.transform(base, lambda b, k: F.when(k == position, value).otherwise(b))


def one_hot(cands: Column, cap: int | None = vocab.ONE_HOT_ROWS) -> Column:
    """GEN6: the base row, then one parameter varied at a time in parameter order; distinct, first twelve.

    Without parameters there is one empty row.
    """

    def rows(e: Column) -> Column:
        others = F.transform(
            e["c"], lambda c, i: F.transform(F.slice(c, 2, F.size(c)), lambda v: _vary(e["base"], i, v))
        )
        return F.concat(F.array(e["base"]), F.flatten(others))

    return _first(_with_base(cands, rows), cap)


def round_robin(cands: Column, cap: int | None = vocab.STRUCT_VARIANTS) -> Column:
    """GEN7: the base row, then the second candidate of every field, then the third, and so on; first eight."""

    def rows(e: Column) -> Column:
        widest = F.coalesce(F.array_max(F.transform(e["c"], F.size)), F.lit(1))
        # sequence(1, 0) would count down, so the empty range is spelled out.
        steps = F.when(widest > 1, F.sequence(F.lit(1), widest - 1)).otherwise(F.array().cast("array<int>"))
        others = F.transform(
            steps,
            lambda j: F.filter(
                F.transform(e["c"], lambda c, i: F.when(F.size(c) > j, _vary(e["base"], i, F.get(c, j)))),
                lambda row: row.isNotNull(),
            ),
        )
        return F.concat(F.array(e["base"]), F.flatten(others))

    return _first(_with_base(cands, rows), cap)


def _with_base(cands: Column, rows) -> Column:
    """``rows`` of the candidates ``c`` and their ``base`` row, the first candidate of each."""
    return let(
        cands,
        lambda c: let(F.struct(c.alias("c"), F.transform(c, lambda x: F.get(x, F.lit(0))).alias("base")), rows),
    )


def field_candidates(field_type: Column, m: Column, cap: int = vocab.CANDIDATES_PER_PARAM) -> Column:
    """GEN7: candidates of a struct field, a value that does something first (1, a rich string, true)."""
    dec = F.transform(m["decimals"], decimal_text)
    ints = F.transform(m["ints"], _plain)
    doubles = F.transform(m["doubles"], _plain)
    values = let(
        _type(field_type),
        lambda kind: F.when(kind == "string", F.concat(F.array(rich_string(m)), m["strings"], _texts("", None)))
        .when(kind.isin(_INT_TYPES), F.concat(_texts("1"), ints, _texts("0", "-1")))
        .when(kind.startswith("decimal"), F.concat(_texts("1"), dec, ints, _texts("0", "-1")))
        .when(kind == "double", F.concat(_texts("1.0"), doubles, _texts("0.0")))
        .when(kind.isin(_FLOAT_TYPES), F.concat(_texts("1.0"), doubles, _texts("0.0")))
        .when(kind.isin("bool", "boolean"), _texts("true", "false"))
        .when(kind == "char", _texts("a", "0"))
        .when(kind.startswith("enum("), _enum_members(F.trim(field_type)))
        .otherwise(_texts(None)),
    )
    return F.slice(F.array_distinct(values), 1, cap)


def _row_table(rules: DataFrame, rows: Column, origin: str) -> DataFrame:
    """``(rule_id, row_no, origin, row array<string>)``.

    The rows are exploded as an expression: exploding a named column would make the optimizer filter on it first,
    which computes it again.
    """
    return rules.select("rule_id", F.posexplode(rows).alias("i", "row")).select(
        "rule_id", (F.col("i") + 1).alias("row_no"), F.lit(origin).alias("origin"), "row"
    )


def one_hot_rows(with_candidates: DataFrame, cap: int | None = vocab.ONE_HOT_ROWS) -> DataFrame:
    """GEN6: ``(rule_id, row_no, origin, row array<string>)``."""
    return _row_table(with_candidates, one_hot(F.col("found.candidates"), cap), "one-hot")


def struct_variants(rules: DataFrame, dialect: str = "csharp", cap: int | None = vocab.STRUCT_VARIANTS) -> DataFrame:
    """GEN7: variants of a struct whose fields are the rule's parameters."""
    per_field = let(
        mined(F.col("rule_text"), dialect),
        lambda m: F.transform("params", lambda p: field_candidates(p["type"], m)),
    )
    return _row_table(rules, round_robin(per_field, cap), "variant")


# --- GEN8 -----------------------------------------------------------------------------------------------------


def _ranges(m: Column) -> Column:
    """Lowest and highest value to draw, for whole numbers, decimals and doubles."""
    narrow = F.filter(m["ints"], lambda v: (v > -2147483648) & (v < 2147483647))
    zero = F.lit(0).cast("bigint")
    int_max = F.least(F.coalesce(F.array_max(narrow), zero), F.lit(100_000).cast("bigint"))
    pool = F.concat(
        F.transform(m["decimals"], lambda v: v.cast("double")), F.transform(m["ints"], lambda v: v.cast("double"))
    )
    finite = F.filter(m["doubles"], lambda v: ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))

    def above(values: Column) -> Column:
        top = F.least(F.coalesce(F.array_max(values), F.lit(0.0)), F.lit(1_000_000.0))
        return F.greatest(F.lit(10_000.0), top * 2 + 100)

    return F.struct(
        (F.least(zero, F.coalesce(F.array_min(narrow), zero)) - 5).alias("int_lo"),
        F.greatest(F.lit(1000).cast("bigint"), int_max * 2 + 100).alias("int_hi"),
        above(pool).alias("dec_hi"),
        above(finite).alias("dbl_hi"),
    )


def _draw(kind: Column, values: Column, share: Column, r: Column) -> Column:
    """The value at ``share`` of the range of a parameter of this kind."""

    def between(high: Column) -> Column:
        return F.bround((F.lit(-10.0) + share * (high + 10)).cast("decimal(20,6)"), 2)

    whole = r["int_lo"] + F.floor(share * (r["int_hi"] - r["int_lo"] + 1))
    return (
        F.when(kind.isin(_WIDE_INT_TYPES), whole.cast("string"))
        .when(kind.startswith("decimal"), decimal_text(between(r["dec_hi"]).cast("decimal(38,10)")))
        .when(kind.isin("double", *_FLOAT_TYPES), between(r["dbl_hi"]).cast("double").cast("string"))
        .when(kind.isin("bool", "boolean"), F.when(share < 0.5, "false").otherwise("true"))
        .otherwise(F.get(values, F.floor(share * F.size(values)).cast("int")))
    )


def sampled_rows(with_candidates: DataFrame, n: int = vocab.SAMPLED_ROWS) -> DataFrame:
    """GEN8: up to ``n`` joint draws per rule with a numeric parameter, none equal to a one-hot row.

    A draw depends only on rule, parameter and draw number, so rows are the same under any partitioning.
    """

    def rows(e: Column) -> Column:
        drawn = F.transform(
            F.sequence(F.lit(0), F.lit(n - 1)),
            lambda k: F.transform(
                e["p"],
                lambda p, i: let(
                    stable_fraction([F.col("rule_id"), p["name"], k]),
                    lambda share: _draw(p["kind"], F.get(e["c"], i), share, e["r"]),
                ),
            ),
        )
        return F.array_except(drawn, one_hot(e["c"]))

    kinds = F.transform("params", lambda p: F.struct(p["name"].alias("name"), _type(p["type"]).alias("kind")))
    bound = F.struct(kinds.alias("p"), F.col("found.candidates").alias("c"), _ranges(F.col("found.mined")).alias("r"))
    numeric = F.exists(
        "params", lambda p: _type(p["type"]).isin(_NATIVE_NUMERIC) | _type(p["type"]).startswith("decimal")
    )
    return _row_table(with_candidates.where(numeric), let(bound, rows), "sampled")


# --- GEN10, SET1, SET3 ----------------------------------------------------------------------------------------


def simple_samples(param_type: Column) -> Column:
    """GEN10: fixed sample values of a type; an unknown type has its default value only."""
    kind = _type(param_type)
    aliases = {
        "int": ["int", "int32", "long", "int64", "short", "byte"],
        "float": ["float", "single"],
        "bool": ["bool", "boolean"],
    }
    out = F.array(F.concat(F.lit("default("), param_type, F.lit(")!")))
    for name, values in vocab.SIMPLE_SAMPLES.items():
        out = F.when(kind.isin(aliases.get(name, [name])), _texts(*values)).otherwise(out)
    return out


def zip_rows(rules: DataFrame, cap: int = vocab.ZIP_ROWS) -> DataFrame:
    """GEN10: at most ``cap`` rows, row r taking the r-th sample of every parameter or its last one."""

    def rows(sets: Column) -> Column:
        longest = F.coalesce(F.array_max(F.transform(sets, F.size)), F.lit(1))
        n = F.greatest(F.lit(1), F.least(F.lit(cap), longest))
        return F.transform(
            F.sequence(F.lit(1), n), lambda r: F.transform(sets, lambda s: F.element_at(s, F.least(r, F.size(s))))
        )

    sets = F.transform("params", lambda p: simple_samples(p["type"]))
    return _row_table(rules, let(sets, rows), "simple")


def union_candidates(*lists: Column) -> Column:
    """SET1: concatenated lists, distinct, the first order kept."""
    return F.array_distinct(F.concat(*lists))


ROWS_PER_TASK = 100_000


def already_seen(rows: DataFrame, existing: DataFrame, most_rows: int | None = None) -> DataFrame:
    """SET3: rows of a rule that do not exist yet for that rule.

    Rows of rules are alike and pack so well that adaptive execution, which goes by packed bytes, would give very many to
    one task; both sides are dealt by the number of rows. A caller that knows how many there are ``most_rows`` may say so.
    """
    if most_rows is None:
        most_rows = rows.count()
    tasks = max(1, ceil(most_rows / ROWS_PER_TASK))
    keys = ["rule_id", "row"]
    known = existing.select(*keys).repartition(tasks, *keys).distinct()
    return rows.repartition(tasks, *keys).join(known.hint("merge"), keys, "left_anti").select(*rows.columns)


# --- GEN5, GEN11 ----------------------------------------------------------------------------------------------

_PATTERNS_PER_PASS = 100


def pattern_witness(df: DataFrame, col: str, patterns: list[str]) -> DataFrame:
    """GEN5: per pattern the smallest matching and non-matching value of a column, with row counts.

    The patterns become aggregate expressions of one global aggregation (a hundred per pass over the column), so
    rows are never multiplied by patterns. A side that never occurs is null with count 0.
    """
    parts = []
    value = F.col(f"`{col}`")
    for start in range(0, len(patterns), _PATTERNS_PER_PASS):
        some = patterns[start : start + _PATTERNS_PER_PASS]
        aggregates = []
        for i, p in enumerate(some):
            hit = F.coalesce(value.rlike(p), F.lit(False))
            miss = value.isNotNull() & ~hit
            aggregates += [
                F.min(F.when(hit, value)).alias(f"m{i}"),
                F.min(F.when(miss, value)).alias(f"x{i}"),
                F.count_if(hit).alias(f"nm{i}"),
                F.count_if(miss).alias(f"nx{i}"),
            ]
        rows = F.array(
            *[
                F.struct(
                    F.lit(p).alias("pattern"),
                    F.col(f"m{i}").alias("match"),
                    F.col(f"x{i}").alias("non_match"),
                    F.col(f"nm{i}").alias("n_match"),
                    F.col(f"nx{i}").alias("n_non_match"),
                )
                for i, p in enumerate(some)
            ]
        )
        parts.append(df.agg(*aggregates).select(F.inline(rows)))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


_NUMBER_TYPE = "struct<side: int, exact: decimal(38,18), double: double, whole: decimal(38,0)>"


def _number(x: Column) -> Column:
    """A number in a form that orders all of them, null if it is none."""
    exact, double, zero = x.try_cast("decimal(38,18)"), x.try_cast("double"), F.lit(0)
    side = F.when(exact.isNotNull(), 0).when(double < 0, -1).otherwise(1)
    number = F.struct(
        side.alias("side"),
        F.coalesce(exact, zero.cast("decimal(38,18)")).alias("exact"),
        F.when(exact.isNull(), double).otherwise(F.lit(0.0)).alias("double"),
        F.when(exact.isNull(), F.coalesce(x.try_cast("decimal(38,0)"), zero)).otherwise(zero).cast("decimal(38,0)").alias("whole"),
    )
    return F.when(double.isNotNull(), number.cast(_NUMBER_TYPE))


def _number_after(number: Column, step: Column) -> Column:
    """The number a step further, null where no decimal holds it."""
    whole = F.when(number["whole"] != 0, F.try_add(number["whole"], step))
    return F.when(number["side"] == 0, _number(number["exact"] + step)).otherwise(_number(whole))


def boundary_coverage(df: DataFrame, literals: DataFrame) -> DataFrame:
    """GEN11: how many rows lie below, just below, at, just above and above each mined boundary.

    ``literals(rule_id, param, literal)`` names columns of ``df``. The columns are first reduced to counts per
    distinct value; boundaries are then placed among those counts by a running sum, so rows are never paired with
    boundaries. A zero marks a branch that the data does not exercise. Only numeric columns are counted, as decimals,
    so whole numbers beyond 2^53 stay apart. Values that no decimal(38, 18) holds are compared as doubles, equal ones as
    whole numbers as far as a decimal holds those, and lie beyond all decimals by their sign; NaN is above all.
    """
    wanted = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
    none = F.array().cast(f"array<struct<param: string, value: {_NUMBER_TYPE}>>")
    cells = F.concat(none, *[F.array(F.struct(F.lit(c).alias("param"), _number(F.col(f"`{c}`")).alias("value"))) for c in wanted])
    counts = (
        df.select(F.inline(cells)).where("value is not null").groupBy("param", "value").agg(F.count("*").alias("n"))
    )
    literals = literals.withColumn("__at", _number(F.col("literal"))).where("__at is not null")
    marks = literals.select("param", F.col("__at").alias("literal")).distinct()
    totals = counts.groupBy("param").agg(F.sum("n").alias("total"))

    line = counts.select("param", "value", "n", F.lit(1).alias("is_value")).unionByName(
        marks.select("param", F.col("literal").alias("value"), F.lit(0).cast("bigint").alias("n"), F.lit(0).alias("is_value"))
    )
    below = (
        prefix_sum(line, ["param"], [F.col("value"), F.col("is_value")], F.col("n"), "n_below")
        .where("is_value = 0")
        .select("param", F.col("value").alias("literal"), "n_below")
    )
    near = (
        marks.select("param", "literal", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1))).alias("step"))
        .withColumn("value", F.when(F.col("step") == 0, F.col("literal")).otherwise(_number_after(F.col("literal"), F.col("step"))))
        .join(counts, ["param", "value"])
        .groupBy("param", "literal")
        .agg(
            F.sum(F.when(F.col("step") == -1, F.col("n"))).alias("n_at_minus_1"),
            F.sum(F.when(F.col("step") == 0, F.col("n"))).alias("n_at"),
            F.sum(F.when(F.col("step") == 1, F.col("n"))).alias("n_at_plus_1"),
        )
    )
    placed = (
        below.join(near, ["param", "literal"], "left")
        .join(totals, "param")
        .fillna(0, ["n_at_minus_1", "n_at", "n_at_plus_1"])
        .withColumn("n_above", F.col("total") - F.col("n_below") - F.col("n_at"))
        .drop("total")
    )
    return literals.join(placed.withColumnRenamed("literal", "__at"), ["param", "__at"]).select(
        "rule_id", "param", "literal", "n_below", "n_at_minus_1", "n_at", "n_at_plus_1", "n_above"
    )
