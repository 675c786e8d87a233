import pytest
from pyspark.sql import functions as F

from driftlock import vocab
from driftlock.functions import names, text
from driftlock.functions.scrub import scrub
from driftlock.operators import tagging


def array(*items):
    return F.array(*[F.lit(i) for i in items]).cast("array<string>")


@pytest.mark.parametrize(
    "name, words",
    [
        ("CalculateVat2X_HTTPServer.v1", ["calculate", "vat", "2x", "httpserver", "v", "1"]),
        ("", []),
        ("__", []),
        ("ÉtéChaud", ["été", "chaud"]),
    ],
)
def test_words_of_identifiers(value, name, words):
    assert value(names.tokenize_identifier(F.lit(name))) == words


def tags_by_rule(words):
    """A keyword is a whole word; one of four letters or more may also begin a word."""
    return [
        tag
        for tag, keywords in vocab.DOMAIN_KEYWORDS.items()
        if any(w == k or (len(k) >= vocab.PREFIX_KEYWORD_LENGTH and w.startswith(k)) for w in words for k in keywords)
    ]


def test_domain_tags_follow_their_keywords(spark):
    """Every keyword alone, between other words, lengthened, and inside another word."""
    made = {}
    for keyword in {k for words in vocab.DOMAIN_KEYWORDS.values() for k in words}:
        made |= {
            f"Gru{keyword.capitalize()}Blip": ["gru", keyword, "blip"],
            f"{keyword}_0": [keyword, "0"],
            f"{keyword}oid": [keyword + "oid"],
            f"q{keyword}": ["q" + keyword],
        }
    names_ = spark.createDataFrame([(n,) for n in made], "n string")
    got = {r.n: list(r.t) for r in names_.select("n", tagging.domain_tags([F.col("n")]).alias("t")).collect()}
    assert got == {n: tags_by_rule(words) for n, words in made.items()}
    several = tagging.domain_tags([F.lit("blip"), F.array(F.lit("GruDisk"), F.lit("vat")), F.lit(None).cast("string")])
    assert spark.range(1).select(several.alias("t")).first().t == ["money", "io"]


def test_landmines_follow_their_rules(spark):
    """Every import, base, attribute and suffix, and the nearest thing that is none."""
    made = []

    def case(flag, usings=(), bases=(), attributes=(), path="dir/Blip.cs"):
        made.append((len(made), [*usings], [*bases], [*attributes], path, [flag] if flag else []))

    for rule in tagging.LANDMINE_RULES:
        for name in rule.imports:
            case(rule.flag, usings=["Gru", name])
            case(rule.flag, usings=[name + ".Blip"])
            case(None, usings=[name + "Blip"])
        for name in rule.attributes:
            case(rule.flag, attributes=[name])
            case(rule.flag, attributes=["Gru", name + "Attribute"])
            case(None, bases=["My" + name])
        for name in rule.bases:
            case(rule.flag, bases=[name])
            case(None, attributes=["Gru" + name])
        for suffix in rule.suffixes:
            case(rule.flag, path="dir/Blip" + suffix.upper())
            case(None, path="dir/Blip" + suffix + ".txt")
        for name in rule.shared_bases:
            case(rule.flag, bases=[name])
            for other in rule.unless_imports:
                case(None, usings=[other], bases=[name])
                case(rule.flag, usings=[other + "Blip"], bases=[name])
    df = spark.createDataFrame(made, "i int, u array<string>, b array<string>, a array<string>, p string, want array<string>")
    found = tagging.flags(F.col("u"), F.col("b"), F.col("a"), F.col("p"), tagging.LANDMINE_RULES)
    assert [r.i for r in df.withColumn("got", found).where("got <> want or got is null").collect()] == []
    assert len(made) > 30


@pytest.mark.parametrize(
    "path, expected",
    [
        ("a/Form1.Designer.cs", True),
        ("a/x.g.i.cs", True),
        ("a\\My Project\\Settings.vb", True),
        ("a/Program.cs", False),
        ("", False),
        (None, False),
    ],
)
def test_generated_paths(value, path, expected):
    assert value(tagging.flag_generated_path(F.lit(path).cast("string"))) is expected


@pytest.mark.parametrize(
    "path, content, expected",
    [
        ("src/VatTest.cs", "", True),
        ("src/Vattests.cs", "", True),
        ("src/Unit.Tests/Vat.cs", "", True),
        ("src/Vat.cs", "using Xunit;", True),
        ("src/Vat.cs", "using xunit;", False),
        ("src/Testing.cs", "", False),
    ],
)
def test_test_files(value, path, content, expected):
    assert value(tagging.is_test_file(F.lit(path), F.lit(content))) is expected


@pytest.mark.parametrize(
    "obstacles, seams, expected",
    [(["File"], [], "NeedsSeam"), (["File"], ["IClock"], "SeamAvailable"), ([], [], "Pure"), (None, None, "Pure")],
)
def test_seamability(value, obstacles, seams, expected):
    cols = [F.lit(None).cast("array<string>") if x is None else array(*x) for x in (obstacles, seams)]
    assert value(tagging.classify_seamability(*cols)) == expected


PATTERN_CASES = [
    ("C:\\src\\Legacy\\Pay.cs", "*/Legacy/*", True),
    ("src/legacy/Pay.cs", "Legacy", True),
    ("src/Legacy/Pay.cs", "leg?cy", True),
    ("src/Legacy/Pay.cs", "a.c*", False),
    ("src/Pay+1.cs", "pay+?", True),
    ("src/Pay.cs", "  ", False),
    ("", "a", False),
]


@pytest.mark.parametrize("text_value, pattern, expected", PATTERN_CASES)
def test_patterns_by_row_and_as_list(value, text_value, pattern, expected):
    assert value(tagging.matches_pattern(F.lit(text_value), F.lit(pattern))) is expected
    assert value(tagging.matches_any([F.lit(text_value)], [pattern])) is expected


def test_no_patterns_match_nothing(value):
    assert value(tagging.matches_any([F.lit("a")], [])) is False


def test_names(value):
    assert value(names.safe_id(F.lit("Svc.Run(int) é"))) == "Svc_Run_int__é"
    assert value(names.short_hash(F.lit("abc"))) == "ba7816"
    assert value(names.lock_name(F.lit("A.B"), F.lit("abc"))) == "A_B_ba7816_CharacterizationTests"
    label = "x/LocalDate_Format_ec5e65_CharacterizationTests.Format_x.verified.txt"
    assert value(names.snapshot_label(F.lit(label))) == "LocalDate.Format"
    assert value(names.simple_name(F.lit("A.B.C"))) == "C"
    assert value(names.last_identifier(F.lit("Ns.Base<int, X.Y> "))) == "Base"
    assert value(names.percent(F.lit(0.256))) == "26%"
    assert value(names.thousands(F.lit(1234567))) == "1,234,567"
    assert value(names.table_cell(F.lit("a|b\r\nc"))) == "a\\|b  c"


@pytest.mark.parametrize(
    "name, friendly",
    [
        ("System.ServiceModel.ClientBase`1", "System.ServiceModel.ClientBase<T>"),
        ("A.Outer+Inner", "A.Outer.Inner"),
        ("Map`2+Entry", "Map<T1, T2>.Entry"),
        ("Broken`x", "Broken"),
        ("Zero`0", "Zero"),
        ("Plain", "Plain"),
    ],
)
def test_friendly_type_names(value, name, friendly):
    assert value(names.friendly_type_name(F.lit(name))) == friendly


def secret_cases():
    """For every shape: what is redacted, what stays around it, and the nearest text that is no secret."""
    mark = "[REDACTED]"
    cases = [("nothing to hide = 7", "nothing to hide = 7", 0)]
    words = ["password", "Passwd", "PWD", "secret", "token", "api_key", "apikey", "api-key", "access_key", "accesskey", "client-secret"]
    for i, word in enumerate(words):
        value = f"walrus {i}"
        cases += [
            (f'my {word}= "{value}", 1', f'my {word}= "{mark}", 1', 1),
            (f"{{'{word}' : '{value}'}}", f"{{'{word}' : '{mark}'}}", 1),
            (f'{{"{word}":"{value}"}}', f'{{"{word}":"{mark}"}}', 1),
            (f'{word} = ""', f'{word} = ""', 0),
            (f'{word}ling "{value}"', f'{word}ling "{value}"', 0),
        ]
    for word in ("Password", "pwd"):
        cases.append((f"Host=h;{word} = otter7;Port=1", f"Host=h;{word} = {mark};Port=1", 1))
    tokens = {"AKIA": "AKIA" + "Z9" * 8, "ASIA": "ASIA" + "7Q" * 8, "sk": "sk-" + "m_4-" * 5, "jwt": f"eyJ{'a1' * 5}.{'b2' * 5}.{'c3' * 3}"}
    cases += [(f"before {t} after", f"before {mark} after", 1) for t in tokens.values()]
    short = ["AKIA" + "Z" * 15, "sk-" + "m" * 15, "eyJa.b.c", "-----BEGIN PUBLIC KEY-----\nx\n-----END PUBLIC KEY-----"]
    cases += [(f"before {t} after", f"before {t} after", 0) for t in short]
    for kind in ("", "EC ", "OPENSSH "):
        block = f"-----BEGIN {kind}PRIVATE KEY-----\nmm\nnn\n-----END {kind}PRIVATE KEY-----"
        cases.append((f"<\n{block}\n>", f"<\n{mark}\n>", 1))
    # A self-describing token in an assignment counts once; values over lines and with escapes go as a whole.
    cases += [
        (f'token = "{tokens["jwt"]}"', f'token = "{mark}"', 1),
        ('secret = "one\ntwo\nthree" .', f'secret = "{mark}" .', 1),
        ('secret = "a \\"b\\" c" .', f'secret = "{mark}" .', 1),
        (f"pwd='x'; password=y {tokens['sk']}", f"pwd='{mark}'; password={mark} {mark}", 3),
    ]
    return cases


SECRETS = secret_cases()


def test_scrub(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(SECRETS)], "i int, t string")
    got = {r.i: (r.t, r.redactions) for r in scrub(df, ["t"]).collect()}
    assert got == {i: (want, n) for i, (_, want, n) in enumerate(SECRETS)}


@pytest.mark.parametrize("q", ['"', "'"])
def test_scrub_steps_over_any_number_of_escapes(spark, q):
    lines = "line\\n" * 300
    values = [
        lines + f"\\{q}hidden\\{q} more", f"{{\\{q}a\\{q}: 1}}" * 20_000 + "x", f"ab\\{q}hidden\\{q}", f"a\\\n b\\{q}hidden",
        f"\\{q}hidden", "\\\\", "x" * 200_000 + f"\\{q}hidden",
    ]
    made = [(i, f"let secret = {q}{v}{q}, n = {q}1{q};") for i, v in enumerate(values)]
    df = spark.createDataFrame([*made, (-1, f"secret = {q}{q}; b = {q}c{q}"), (-2, f"secret = {q}C:\\dir\\{q}")], "i int, t string")
    got = {r.i: (r.t, r.redactions) for r in scrub(df, ["t"]).collect()}
    want = {i: (f"let secret = {q}[REDACTED]{q}, n = {q}1{q};", 1) for i, _ in made}
    assert got == want | {-1: (f"secret = {q}{q}; b = {q}c{q}", 0), -2: (f"secret = {q}[REDACTED]{q}", 1)}


def test_scrub_twice_changes_nothing(spark):
    df = spark.createDataFrame([(t,) for t, _, _ in SECRETS], "t string")
    once = scrub(df, ["t"], None)
    assert scrub(once, ["t"]).agg(F.sum("redactions")).first()[0] == 0


def test_extract_code(value):
    assert value(text.extract_code(F.lit("Here you go:\n```csharp\nclass X {}\n```\nDone."))) == "class X {}"
    assert value(text.extract_code(F.lit("  class X {}  "))) == "class X {}"
    assert value(text.extract_code(F.lit("Sure:\n  using A;\nx"))) == "using A;\nx"
    assert value(text.extract_code(F.lit("no code at all"))) == "no code at all"


def test_diagnostics(value):
    log = "ok\n  A.cs(1,2): error CS1: x\nB.cs(3,4): error CS2: y\n A.cs(1,2): error CS1: x \na.cs(9,9): error CS3: z\n"
    assert value(text.extract_diagnostics(F.lit(log), "error CS")) == [
        "A.cs(1,2): error CS1: x",
        "B.cs(3,4): error CS2: y",
        "a.cs(9,9): error CS3: z",
    ]
    assert value(text.broken_files(F.lit(log))) == ["A.cs", "B.cs"]
    many = "\n".join(f"line {i}  " for i in range(50)) + "\n\n"
    assert value(text.extract_diagnostics(F.lit(many), "error CS")) == [f"line {i}" for i in range(20, 50)]


def test_diagnostics_per_file(value):
    errors = [f"  src/One.cs({i},1): error CS{i}: a" for i in range(14)] + ["src/one.cs(3,1): error CS3: a"] * 2
    log = "\n".join([*errors[:7], "C:\\x\\Two.cs(1,1): error CS9: b", "link: error CS0: no file", *errors[7:], "TWO.CS(2,2): error CS8: b"])
    got = {r["file"]: r["errors"] for r in value(text.file_diagnostics(F.lit(log)))}
    assert got["src/One.cs"] == [e.strip() for e in errors[:10]]
    assert got["C:\\x\\Two.cs"] == ["C:\\x\\Two.cs(1,1): error CS9: b", "TWO.CS(2,2): error CS8: b"] and len(got) == 2
    assert value(text.file_diagnostics(F.lit("all well"))) == []


@pytest.mark.parametrize(
    "code, lang, expected",
    [
        ("", "csharp", 1),
        ("if (a && b) { } else if (c) { }", "csharp", 4),
        ("foreach (var x in y) while (z) { }", "csharp", 3),
        ("do { x(); } while (y);", "csharp", 2),
        ("switch (a) { case 1: break; case 2 when b: break; default: break; }", "csharp", 4),
        ('var s = "if while"; // for if\n/* case */ x ??= y ?? z;', "csharp", 3),
        ("return x switch { 1 => a, 2 => b, _ => c };", "csharp", 4),
        ("try { } catch (E e) when (f) { }", "csharp", 3),
        ("var y = a ? b : c; int? n; q?.Run();", "csharp", 2),
        ("If a Then\n x\nElseIf b AndAlso c Then\n y\nEnd If ' if", "vb", 4),
        ("Do While a\nLoop\nFor Each x In y\nNext\nExit For", "vb", 3),
        ("Select Case a\nCase 1\nCase Else\nEnd Select", "vb", 2),
    ],
)
def test_lexical_complexity(value, code, lang, expected):
    assert value(text.lexical_complexity(F.lit(code), lang)) == expected
