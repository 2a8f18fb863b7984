"""Formats as table functions of SQL: ``SELECT r.* FROM files f, LATERAL read_lockfile(f.source_file, f.text) r``.

A reader is a function from a file's name and text to rows. It runs in Arrow batches where the files' rows are, so that
files are read in parallel as their table is partitioned. A file that it can't read gives a row with ``error`` and nothing
else; a null text gives no row.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

DEPENDENCY = "name string, version string, ecosystem string, license string"
#: A pinned requirement: name, extras, version.
PINNED = re.compile(r"^\s*([A-Za-z0-9][A-Za-z0-9._-]*)\s*(?:\[[^\]]*\])?\s*==\s*([^\s;#,]+)")


def register(spark: SparkSession, name: str, parse: Callable[[str, str], Iterable[tuple]], schema: str) -> None:
    """Makes ``parse`` a table function of the session: its rows have the columns of ``schema`` (DDL), and ``error``."""
    width = len(spark.createDataFrame([], schema).columns)

    class Reader:
        def eval(self, source_file: str, text: str):
            if text is None:
                return
            try:
                rows = list(parse(source_file, text))
            except Exception as e:  # whatever a reader trips over is the file's error, not the query's
                yield (*([None] * width), f"{type(e).__name__}: {e}")
                return
            for row in rows:
                yield (*row, None)

    spark.udtf.register(name, F.udtf(Reader, returnType=f"{schema}, error string"))


def lockfile_rows(source_file: str, text: str) -> Iterable[tuple]:
    """The dependencies of a requirements.txt or package-lock.json (name, version, ecosystem, license); other files have none."""
    base = (source_file or "").rsplit("/", 1)[-1]
    if base == "requirements.txt":
        return [(m[1], m[2], "pypi", "") for m in map(PINNED.match, text.splitlines()) if m]
    if base == "package-lock.json":
        told = json.loads(text).get("packages", {})
        named = ((k.rsplit("node_modules/", 1)[-1], v) for k, v in told.items() if "node_modules/" in k)
        return [(n, str(v["version"]), "npm", str(v.get("license") or "")) for n, v in named if v.get("version")]
    return []


def register_lockfiles(spark: SparkSession, name: str = "read_lockfile") -> None:
    register(spark, name, lockfile_rows, DEPENDENCY)
