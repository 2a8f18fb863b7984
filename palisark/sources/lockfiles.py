"""Lock files to dependency rows: source_file, name, version, ecosystem, license.

Line formats are read by patterns over the whole text, structured ones from ``files.documents``. Every format is a
projection of its own files; nothing is shuffled but the few rows of formats that repeat an entry.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisark.sources import files

MAX_DEPTH = 50
#: How entries of the line formats look; name and version are the groups.
REQUIREMENT = r"(?m)^[ \t]*([A-Za-z0-9_.\-\[\]]+)==([^\s;#]+)"
YARN = r'(?m)^"?(@?[^@\s"]+)@[^\n]*:[ \t]*\n(?:[ \t]+(?!version)[^\n]*\n)*?[ \t]+version:?[ \t]+"?([^"\s]+)"?'
GO_SUM = r"(?m)^[ \t]*(\S+)[ \t]+v*(\S+?)(?:/go\.mod)?[ \t]"
GEM = r"(?m)^ {4}([^\s(]+) \(([^)]+)\)"
HEX = r'"([^"]+)":\s*\{:hex,\s*:[^,]+,\s*"([^"]+)"'
PNPM = r"^/?(@?[^@]+)@(.+)$"
CONAN = r"^([^/#]+)/([^#]+)"


def _row(name: Column, version: Column, ecosystem: str, license_id: Column | None = None) -> list[Column]:
    none = F.lit("")
    return [
        F.col("source_file"), name.alias("name"), version.alias("version"), F.lit(ecosystem).alias("ecosystem"),
        F.coalesce(license_id if license_id is not None else none, none).alias("license"),
    ]


def _matches(pattern: str, ecosystem: str) -> Callable[[DataFrame], DataFrame]:
    """A row for each match of ``pattern`` in a text."""

    def read(rows: DataFrame) -> DataFrame:
        group = lambda n: F.regexp_extract_all("text", F.lit(pattern), F.lit(n))
        each = rows.select("source_file", F.explode(F.arrays_zip(group(1).alias("name"), group(2).alias("version"))).alias("m"))
        return each.select(*_row(F.col("m.name"), F.col("m.version"), ecosystem))

    return read


def _toml_packages(ecosystem: str) -> Callable[[DataFrame], DataFrame]:
    """The first name and version of each [[package]] block, so that a file that is broken elsewhere is read too."""

    def read(rows: DataFrame) -> DataFrame:
        blocks = rows.select("source_file", F.explode(F.slice(F.split("text", r"(?m)^\[\[package\]\]"), 2, 2**31 - 1)).alias("b"))
        value = lambda key: F.regexp_extract("b", rf"""(?m)^{key}\s*=\s*["']([^"']+)["']""", 1)
        return blocks.select(*_row(value("name"), value("version"), ecosystem))

    return read


def _entries(rows: DataFrame, path: str, kind: str = "map<string,variant>") -> DataFrame:
    """The entries of a map (key, value) or list (value) in each document."""
    found = F.try_variant_get("doc", path, kind)
    return rows.select("source_file", F.explode(found).alias("key", "value") if kind.startswith("map") else F.explode(found).alias("value"))


def _text(path: str) -> Column:
    return F.try_variant_get("value", path, "string")


def _npm(docs: DataFrame) -> DataFrame:
    """Versions 2 and 3 of the format list packages by folder; the first one nests them."""
    flat = _entries(docs, "$.packages").where("key <> ''")
    name = F.coalesce(F.nullif(_text("$.name"), F.lit("")), F.substring_index("key", "node_modules/", -1))
    nested = docs.where(F.try_variant_get("doc", "$.packages", "map<string,variant>").isNull())
    return flat.select(*_row(name, _text("$.version"), "npm", _text("$.license"))).unionByName(_npm_nested(nested))


def _npm_nested(docs: DataFrame) -> DataFrame:
    def flatten(entries: object, depth: int = 0) -> Iterator[tuple[str, str]]:
        if isinstance(entries, dict) and depth < MAX_DEPTH:
            for name, entry in entries.items():
                if isinstance(entry, dict):
                    yield name, str(entry.get("version", ""))
                    yield from flatten(entry.get("dependencies"), depth + 1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            out = [(f, *pair) for f, d in zip(x["source_file"], x["json"]) for pair in flatten(json.loads(d))]
            yield pd.DataFrame(out, columns=["source_file", "name", "version"])

    tree = docs.select("source_file", F.to_json(F.try_variant_get("doc", "$.dependencies", "variant")).alias("json")).where("json is not null")
    found = tree.mapInPandas(run, "source_file string, name string, version string")
    return found.select(*_row(F.col("name"), F.col("version"), "npm"))


def _pnpm(docs: DataFrame) -> DataFrame:
    key = F.col("key")
    return _entries(docs, "$.packages").where(key.rlike(PNPM)).select(*_row(F.regexp_extract(key, PNPM, 1), F.regexp_extract(key, PNPM, 2), "npm"))


def _pipfile(docs: DataFrame) -> DataFrame:
    both = _entries(docs, "$.default").unionByName(_entries(docs, "$.develop"))
    return both.select(*_row(F.col("key"), F.regexp_replace(_text("$.version"), "^=+", ""), "pypi"))


def _composer(docs: DataFrame) -> DataFrame:
    both = _entries(docs, "$.packages", "array<variant>").unionByName(_entries(docs, "$['packages-dev']", "array<variant>"))
    return both.select(*_row(_text("$.name"), F.regexp_replace(_text("$.version"), "^v+", ""), "packagist", _text("$.license[0]")))


def _pub(docs: DataFrame) -> DataFrame:
    return _entries(docs, "$.packages").select(*_row(F.col("key"), _text("$.version"), "pub"))


def _conan(docs: DataFrame) -> DataFrame:
    ref = _text("$")
    return _entries(docs, "$.requires", "array<variant>").select(*_row(F.regexp_extract(ref, CONAN, 1), F.regexp_extract(ref, CONAN, 2), "conan"))


#: The reader of each lock file: of its text, or of its document.
OF_TEXT = {
    "yarn.lock": _matches(YARN, "npm"), "requirements.txt": _matches(REQUIREMENT, "pypi"), "poetry.lock": _toml_packages("pypi"), "go.sum": _matches(GO_SUM, "go"),
    "Cargo.lock": _toml_packages("crates.io"), "Gemfile.lock": _matches(GEM, "rubygems"), "mix.lock": _matches(HEX, "hex"),
}
OF_DOCUMENT = {
    "package-lock.json": _npm, "pnpm-lock.yaml": _pnpm, "Pipfile.lock": _pipfile, "composer.lock": _composer, "pubspec.lock": _pub, "conan.lock": _conan,
}


def dependencies(rows: DataFrame) -> DataFrame:
    """The dependencies of all lock files among (source_file, text) rows; each is listed once for its file.

    Entries without a name or version have no row; neither have texts that are null, empty or broken.
    """
    name = files.file_name(F.col("source_file"))
    docs = files.documents(rows.where(name.isin(*OF_DOCUMENT)))
    parts = [read(rows.where(name == n)) for n, read in OF_TEXT.items()] + [read(docs.where(name == n)) for n, read in OF_DOCUMENT.items()]
    return reduce(DataFrame.unionByName, parts).where("name <> '' and version <> ''").distinct()


def selected(resources: DataFrame) -> DataFrame:
    """The dependencies among resources."""
    return resources.where(F.col("resource_type").startswith("dependency_"))


def as_resources(deps: DataFrame) -> DataFrame:
    """Dependencies as resources: type dependency_<ecosystem>, address <ecosystem>/<name>@<version>."""
    e, n, v = F.col("ecosystem"), F.col("name"), F.col("version")
    return deps.select(
        "source_file", F.concat(F.lit("dependency_"), e).alias("resource_type"), F.concat(e, F.lit("/"), n, F.lit("@"), v).alias("address"), n.alias("name"),
        e.alias("provider"), F.to_variant_object(F.struct("name", "version", "ecosystem", "license")).alias("properties"),
    )
