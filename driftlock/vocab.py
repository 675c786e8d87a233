"""Fixed values.

Word lists, names, weights, rates and limits that must equal the published behaviour for results to agree.
They are stated as plain text; everything that uses them lives elsewhere.
"""

from __future__ import annotations

# Domain tags in report order, each with its keywords.
DOMAIN_KEYWORDS = {
    "money": [
        "money", "price", "pricing", "cost", "amount", "vat", "tax", "invoice", "discount", "currency", "payment",
        "pay", "charge", "fee", "refund", "balance", "billing", "salary", "wage", "ledger", "account", "decimal",
    ],
    "auth": [
        "auth", "login", "logout", "token", "password", "passwd", "credential", "permission", "role", "claim",
        "principal", "identity", "authorize", "authenticate", "secret", "session",
    ],
    "date": [
        "date", "time", "expiry", "expire", "schedule", "deadline", "duration", "timeout", "timestamp", "calendar",
        "datetime",
    ],
    "io": [
        "file", "stream", "http", "url", "uri", "socket", "sql", "query", "database", "connection", "request",
        "response", "download", "upload", "ftp", "smtp", "email", "disk", "path",
    ],
    "data-transform": [
        "parse", "serialize", "deserialize", "convert", "transform", "map", "mapper", "encode", "decode", "format",
        "marshal", "json", "xml", "csv",
    ],
}
# A keyword of at least this many letters also matches as the beginning of a token.
PREFIX_KEYWORD_LENGTH = 4

SIDE_EFFECT_TAGS = ["io"]
SENSITIVE_TAGS = ["money", "auth"]

# Risk weights, caps, and the threshold from which a unit counts as high-risk.
RISK_WEIGHTS = {
    "complexity": 2.0,
    "untested": 2.5,
    "domain": 1.5,
    "blast-radius": 1.5,
    "size": 1.0,
    "landmine": 1.5,
}
RISK_CAPS = {"complexity": 20.0, "size": 200.0, "blast-radius": 20.0}
HIGH_RISK_THRESHOLD = 3.5

# Members whose value depends on when or where they run.
AMBIENT_MEMBERS = {
    "DateTime": ["Now", "UtcNow", "Today"],
    "DateTimeOffset": ["Now", "UtcNow"],
    "Guid": ["NewGuid"],
    "Stopwatch": ["GetTimestamp", "StartNew"],
    "Environment": [
        "GetEnvironmentVariable", "GetEnvironmentVariables", "ExpandEnvironmentVariables", "MachineName", "UserName",
        "UserDomainName", "CurrentDirectory", "GetCommandLineArgs", "CommandLine", "ProcessPath", "TickCount",
        "TickCount64",
    ],
}
# Types that stand for something outside the process.
RESOURCE_TYPES = [
    "File", "Directory", "FileInfo", "DirectoryInfo", "FileStream", "StreamReader", "StreamWriter", "Console",
    "HttpClient", "WebClient", "WebRequest", "HttpWebRequest", "Socket", "TcpClient", "SqlConnection", "SqlCommand",
    "OleDbConnection", "DbConnection", "Process", "Random",
]
# Interfaces that are data shapes rather than collaborators.
NON_COLLABORATORS = [
    "IEnumerable", "IEnumerator", "ICollection", "IList", "IReadOnlyList", "IReadOnlyCollection", "IDictionary",
    "IReadOnlyDictionary", "ISet", "IComparable", "IEquatable", "IFormattable", "IConvertible", "ICloneable",
    "IDisposable", "IAsyncDisposable",
]
SEAM_LIST_LIMIT = 6

FRAMEWORK_PREFIXES = [
    "System", "mscorlib", "netstandard", "Microsoft.Win32", "Microsoft.VisualBasic", "WindowsBase",
    "PresentationCore", "PresentationFramework", "Accessibility",
]

EXCLUDED_DIRS = ["bin", "obj", ".git", ".vs", "node_modules", "packages", "TestResults"]
GENERATED_SUFFIXES = [".designer.cs", ".designer.vb", ".g.cs", ".g.i.cs", ".g.vb"]
GENERATED_SEGMENT = "My Project"
TEST_IMPORTS = ["using Xunit", "using NUnit", "Microsoft.VisualStudio.TestTools"]
TRACKED_EXTENSIONS = [".cs", ".vb"]

# USD per million tokens: (needle in the model name, input rate, output rate); the last one is the default.
MODEL_RATES = [("haiku", 1, 5), ("opus", 5, 25), ("", 3, 15)]
CACHE_WRITE_FACTOR = "1.25"
CACHE_READ_FACTOR = "0.1"

FORMAT_VERSION = 1
REDACTED = "[REDACTED]"
VOID_OUTCOME = "completed (no return value)"
LOCK_SUFFIX = "_CharacterizationTests"

# Limits that are part of the published contract.
MAX_TARGETS = 25
CANDIDATES_PER_PARAM = 6
STRING_CANDIDATES = 10
ONE_HOT_ROWS = 12
STRUCT_VARIANTS = 8
SAMPLED_ROWS = 16
SYNTH_STRING_LENGTH = 512
ZIP_ROWS = 3
DIAGNOSTIC_LINES = 25
FILE_DIAGNOSTIC_LINES = 10
TAIL_LINES = 30
FLAKY_CAUSES = 4

# Sample values per type for the simple row generator.
SIMPLE_SAMPLES = {
    "int": ["0", "1", "-1"],
    "decimal": ["0m", "100.5m", "-1m"],
    "double": ["0.0", "1.5", "-1.0"],
    "float": ["0f", "1.5f"],
    "bool": ["true", "false"],
    "string": ['""', '"abc"', "null"],
    "char": ["'a'", "'0'"],
}
