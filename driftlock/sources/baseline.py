"""SRC9, SRC10: versioned baselines and report files."""

from __future__ import annotations

import re
import uuid
import warnings

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftlock import vocab
from driftlock.functions.scrub import refuse_secrets, scrub, string_columns, text_columns
from driftlock.operators.verify import cell_delta, fingerprint, verify

_MANIFEST = """
    version int, format int, schema string, n_rows bigint, hash_xor bigint, hash_sum string, folder string,
    keys array<string>, scrubbed array<string>
"""


def _folder(root: str, name: str) -> str:
    """The folder of a baseline. The name must stay inside the root."""
    if not re.fullmatch(r"[A-Za-z0-9_][A-Za-z0-9_.-]*", name):
        raise ValueError(f"refusing to write outside {root}: {name!r}")
    return f"{root.rstrip('/')}/{name}"


def _read_manifests(spark: SparkSession, folder: str) -> DataFrame:
    """Manifests of all versions; a folder without one has no baseline.

    A version is one file, or the folder of files that earlier formats wrote. What a crash left behind has other names.
    """
    reader = spark.read.schema(_MANIFEST).option("ignoreMissingFiles", "true").option("pathGlobFilter", "*.json")
    return reader.option("recursiveFileLookup", "true").json(f"{folder}/manifest").where("version is not null")


def versions(spark: SparkSession, root: str, name: str) -> list[int]:
    """Committed versions of a baseline, oldest first. One small file each."""
    try:
        rows = _read_manifests(spark, _folder(root, name)).select("version").distinct().collect()
    except Exception as error:  # the reader reports a missing folder as an analysis error
        if "PATH_NOT_FOUND" in str(error):
            return []
        raise
    return sorted(r[0] for r in rows)


class VersionTaken(ValueError):
    """Another writer committed the version first."""


def put_if_absent(spark: SparkSession, path: str, text: str) -> None:
    """Make a file with this text, whole or not at all, unless there is one: then ``FileExistsError``.

    The text goes into a file of its own name, which is then renamed without overwriting: of two writers one succeeds, and
    a crash leaves at most a file that no reader looks at.
    """
    hadoop = spark._jvm.org.apache.hadoop
    target = hadoop.fs.Path(path)
    part = hadoop.fs.Path(target.getParent(), f"_{uuid.uuid4().hex}.part")
    conf = spark._jsc.hadoopConfiguration()
    files = target.getFileSystem(conf)
    files.mkdirs(target.getParent())
    stream = files.create(part, False)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    try:
        none = spark.sparkContext._gateway.new_array(getattr(hadoop.fs, "Options$Rename"), 0)
        hadoop.fs.FileContext.getFileContext(target.toUri(), conf).rename(part, target, none)
    except Py4JJavaError as error:
        files.delete(part, False)
        if "FileAlreadyExistsException" in str(error.java_exception):
            raise FileExistsError(path) from None
        raise


def recover(spark: SparkSession, root: str, name: str) -> list[str]:
    """The data folders that no manifest names: what failed or running attempts left. Remove them when nobody writes."""
    folder = _folder(root, name)
    hadoop = spark._jvm.org.apache.hadoop
    data = hadoop.fs.Path(f"{folder}/data")
    files = data.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(data):
        return []
    there = {s.getPath().getName() for s in files.listStatus(data)}
    named: set[str] = set()
    for number in versions(spark, root, name):
        named.add(read_manifest(spark, root, name, number)["folder"] or f"version={number}")
    return sorted(there - named)


def write_baseline(
    df: DataFrame,
    root: str,
    name: str,
    keys: list[str],
    version: int | None = None,
    scrub_cols: list[str] | None = None,
) -> int:
    """SRC9: write the next version of a baseline, secrets scrubbed, and return its number.

    Data goes into a folder of its own, named anew for each attempt, so a version that is being read is never
    overwritten and what a failed attempt left behind is in nobody's way (``recover`` lists it). The manifest follows the
    data and commits it, as one file that is put in place whole and only if the version has none: of two writers of a
    number one gets ``VersionTaken``. It names the folder, the keys and the scrubbed columns, and a version without a
    manifest does not exist. Its counts come from the written files, not from a second run of the plan. Strings are scrubbed at any depth; a key
    that holds a secret makes the write fail.
    """
    spark = df.sparkSession
    folder = _folder(root, name)
    done = versions(spark, root, name)
    number = version if version is not None else (done[-1] + 1 if done else 1)
    if number in done:
        raise VersionTaken(f"{name} already has a version {number}")
    cols = text_columns(df, without=keys) if scrub_cols is None else scrub_cols
    attempt = f"version={number}-{uuid.uuid4().hex}"
    data = f"{folder}/data/{attempt}"
    checked = df.withColumns({k: refuse_secrets(F.col(f"`{k}`"), k) for k in string_columns(df) if k in keys})
    scrub(checked, cols, None).write.mode("errorifexists").parquet(data)
    digest = fingerprint(spark.read.parquet(data))
    manifest = digest.select(
        F.lit(number).alias("version"),
        F.lit(vocab.FORMAT_VERSION).alias("format"),
        F.lit(df.schema.json()).alias("schema"),
        "*",
        F.lit(attempt).alias("folder"),
        F.array(*[F.lit(k) for k in keys]).cast("array<string>").alias("keys"),
        F.array(*[F.lit(c) for c in cols]).cast("array<string>").alias("scrubbed"),
    )
    line = manifest.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).first()[0]
    try:
        put_if_absent(spark, f"{folder}/manifest/{number:09d}.json", line + "\n")
    except FileExistsError:
        raise VersionTaken(f"{name} already has a version {number}") from None
    return number


def read_baseline(spark: SparkSession, root: str, name: str, version: int | None = None) -> DataFrame:
    """SRC9: a committed version, the newest by default. A stamp newer than this code understands is a warning.

    A manifest without a stamp counts as format 0.
    """
    folder = _folder(root, name)
    done = versions(spark, root, name)
    if not done:
        raise FileNotFoundError(f"no baseline {name} under {root}")
    number = done[-1] if version is None else version
    if number not in done:
        raise FileNotFoundError(f"baseline {name} has no version {number}")
    manifest = read_manifest(spark, root, name, number)
    stamp = manifest["format"]
    if stamp > vocab.FORMAT_VERSION:
        warnings.warn(
            f"baseline {name} has format {stamp}, this code understands {vocab.FORMAT_VERSION}", stacklevel=2
        )
    return spark.read.parquet(f"{folder}/data/{manifest['folder'] or f'version={number}'}")


def scrubbed_like(current: DataFrame, root: str, name: str, version: int | None = None) -> DataFrame:
    """The current output with the columns scrubbed that were scrubbed when the baseline was written.

    Only so can it be compared: else an unchanged row that holds a secret would look changed, and the difference
    would show the secret.
    """
    spark = current.sparkSession
    done = versions(spark, root, name)
    manifest = read_manifest(spark, root, name, done[-1] if version is None else version)
    return scrub(current, [c for c in manifest["scrubbed"] or [] if c in current.columns], None)


def verify_baseline(current: DataFrame, root: str, name: str, version: int | None = None, **options) -> DataFrame:
    """JN7 against a stored baseline: its keys, and both sides scrubbed alike. Options are those of ``verify``."""
    spark = current.sparkSession
    locked = read_baseline(spark, root, name, version)
    done = versions(spark, root, name)
    manifest = read_manifest(spark, root, name, done[-1] if version is None else version)
    return verify(locked, scrubbed_like(current, root, name, version), manifest["keys"], **options)


def baseline_cells(current: DataFrame, root: str, name: str, version: int | None = None, **options) -> DataFrame:
    """LK6 against a stored baseline; scrubbed values only."""
    spark = current.sparkSession
    locked = read_baseline(spark, root, name, version)
    done = versions(spark, root, name)
    manifest = read_manifest(spark, root, name, done[-1] if version is None else version)
    return cell_delta(locked, scrubbed_like(current, root, name, version), manifest["keys"], **options)


def read_manifest(spark: SparkSession, root: str, name: str, version: int) -> dict:
    """The manifest of one version as a dictionary."""
    manifest = _read_manifests(spark, _folder(root, name)).where(F.col("version") == version)
    row = manifest.withColumn("format", F.coalesce("format", F.lit(0))).first()
    return row.asDict()


def write_received(df: DataFrame, root: str, name: str) -> DataFrame:
    """The output of the current run; what an earlier run left behind is replaced."""
    path = f"{_folder(root, name)}/received"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


# --- SRC10 ----------------------------------------------------------------------------------------------------

_INTERNAL = ["risk_raw", "seams", "obstacles"]


def camel_case(name: str) -> str:
    head, *tail = name.split("_")
    return head + "".join(t.capitalize() for t in tail)


def report_rows(df: DataFrame) -> DataFrame:
    """SRC10: columns in camel case; the unrounded total and the raw seam lists stay internal."""
    return df.select(*[F.col(f"`{c}`").alias(camel_case(c)) for c in df.columns if c not in _INTERNAL])


def write_report(df: DataFrame, path: str) -> None:
    """SRC10: the machine-readable report as JSON lines, nulls written out."""
    report_rows(df).write.mode("errorifexists").option("ignoreNullFields", "false").json(path)
