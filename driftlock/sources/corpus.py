"""SRC1: a tree of files as a table."""

from __future__ import annotations

import re
from urllib.parse import quote, unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftlock import vocab
from driftlock.functions.names import path_segments


# Scheme and authority of a file URI; what follows is the path as the file system spells it.
_SCHEME = r"^[a-zA-Z][\w+.-]*:(?://[^/]*)?"


def scan_corpus(
    spark: SparkSession,
    root: str,
    globs: str = "*",
    exclude_dirs: list[str] = vocab.EXCLUDED_DIRS,
) -> DataFrame:
    """SRC1: ``files(path, content, length)`` of every file below ``root`` that matches the glob.

    A file is dropped when a segment of its path below the root is an excluded folder, ignoring case. The folder
    test reads the listed path only, so files of excluded folders are never opened. Bytes that are no UTF-8 become
    replacement characters. Unreadable files are skipped.
    """
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", globs)
        .option("ignoreCorruptFiles", "true")
        .option("ignoreMissingFiles", "true")
        .load(root)
    )
    base = "/" + unquote(re.sub(_SCHEME, "", root)).strip("/")
    path = F.regexp_replace("path", _SCHEME, "")
    def excluded(listed):
        # Listed paths are encoded as URIs.
        start = quote(base) + "/"
        below = F.regexp_replace(listed, _SCHEME, "")
        below = F.when(below.startswith(start), F.substr(below, F.lit(len(start) + 1))).otherwise(below)
        return F.exists(path_segments(below), lambda s: F.lower(s).isin([d.lower() for d in exclude_dirs]))

    return files.where(~excluded(F.col("_metadata.file_path"))).select(
        path.alias("path"), F.make_valid_utf8(F.col("content").cast("string")).alias("content"), "length"
    )
