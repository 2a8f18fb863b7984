"""Files as tables: which are read, what format each one is, and structured text as VARIANT documents."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_BYTES = 50 << 20
#: Folders that are never entered (any hidden one isn't either), lock files by name.
SKIP_FOLDERS = (
    "node_modules", ".git", "__pycache__", ".terraform", "vendor", ".venv", "venv", ".tox", "dist", "build", ".mypy_cache", ".pytest_cache", ".eggs",
)
LOCKFILES = (
    "package-lock.json", "yarn.lock", "pnpm-lock.yaml", "requirements.txt", "Pipfile.lock", "poetry.lock", "go.sum", "Cargo.lock", "Gemfile.lock",
    "composer.lock", "mix.lock", "pubspec.lock", "conan.lock",
)


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def walk(spark: SparkSession, root: str, max_bytes: int = MAX_BYTES) -> DataFrame:
    """path, rel, length, content of all files under ``root`` that aren't too large or in a skipped folder.

    The size goes to the file listing, so what is too large isn't read; contents are read by the tasks that use them.
    ``too_large`` tells what was left out.
    """
    return _listed(spark, root).where(F.col("length") <= max_bytes).select("path", "rel", "length", "content")


def _listed(spark: SparkSession, root: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.rstrip("/").split("://")[-1].lstrip("/")
    rel = F.regexp_replace(F.regexp_replace("path", "^[a-z]+:/*", ""), "^" + _quoted(base) + "/?", "")
    folders = F.slice(F.split(rel, "/"), F.lit(1), F.size(F.split(rel, "/")) - 1)
    skipped = F.exists(folders, lambda d: d.isin(*SKIP_FOLDERS) | d.startswith("."))
    return files.withColumn("rel", rel).where(~skipped)


#: What wasn't read: by which parser, and why.
QUARANTINE = "source_file string, parser string, error string"


def too_large(spark: SparkSession, root: str, max_bytes: int = MAX_BYTES) -> DataFrame:
    """The files that ``walk`` leaves out for their size (QUARANTINE); no content is read."""
    big = _listed(spark, root).where(F.col("length") > max_bytes)
    return big.select(F.col("rel").alias("source_file"), F.lit("walk").alias("parser"), F.format_string(f"%d bytes, more than {max_bytes}", "length").alias("error"))


def _quoted(text: str) -> str:
    return "\\Q" + text + "\\E"


def is_dockerfile(path: Column) -> Column:
    name = F.lower(file_name(path))
    return (name == "dockerfile") | name.startswith("dockerfile.") | name.endswith(".dockerfile")


def is_iac_candidate(path: Column) -> Column:
    name = F.lower(file_name(path))
    return name.rlike(r"\.(tf|json|ya?ml)$") | is_dockerfile(path)


def is_lockfile(path: Column) -> Column:
    return file_name(path).isin(*LOCKFILES)


def kind_of_file(path: Column) -> Column:
    """lockfile, chart, iac or other."""
    return F.when(is_lockfile(path), "lockfile").when(file_name(path) == "Chart.yaml", "chart").when(is_iac_candidate(path), "iac").otherwise("other")


def totals(files: DataFrame) -> DataFrame:
    """One row: how many files of each kind."""
    kind = kind_of_file(F.col("path"))
    n = lambda k: F.count_if(kind == k).alias(k)
    return files.agg(F.count("*").alias("files"), n("lockfile"), n("chart"), n("iac"))


def texts(files: DataFrame) -> DataFrame:
    """source_file and text of files."""
    return files.select(F.col("rel" if "rel" in files.columns else "path").alias("source_file"), F.decode("content", "UTF-8").alias("text"))


def documents(rows: DataFrame) -> DataFrame:
    """The JSON, YAML (all documents) or TOML documents of (source_file, text) rows: source_file, doc_no, doc VARIANT.

    A text that doesn't parse has no documents (``parsed`` tells why).
    """
    return parsed(rows).where("error is null").drop("error")


def parsed(rows: DataFrame) -> DataFrame:
    """``documents``, and a row with an error, without doc_no and doc, for each text that doesn't parse.

    The parsers run in Arrow batches and give JSON. YAML's tags are read as what they mark, so templates with intrinsic
    functions are read too; dates become text.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            out = []
            for f, t in zip(x["source_file"], x["text"]):
                try:
                    out += [(f, i, json.dumps(d, default=str), None) for i, d in enumerate(_parsed(f, t or ""))]
                except (ValueError, RecursionError) as e:
                    out.append((f, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["source_file", "doc_no", "json", "error"]).astype({"doc_no": "Int32"})

    found = rows.select("source_file", "text").mapInPandas(run, "source_file string, doc_no int, json string, error string")
    return found.select("source_file", "doc_no", F.parse_json("json").alias("doc"), "error")


def _parsed(name: str, text: str) -> list:
    import tomllib

    import yaml

    class Loader(yaml.SafeLoader):
        pass

    def tagged(loader, suffix, node):
        if isinstance(node, yaml.ScalarNode):
            return loader.construct_scalar(node)
        return loader.construct_sequence(node, True) if isinstance(node, yaml.SequenceNode) else loader.construct_mapping(node, True)

    Loader.add_multi_constructor("!", tagged)
    base = name.rsplit("/", 1)[-1]
    try:
        if base in ("poetry.lock", "Cargo.lock"):
            return [tomllib.loads(text)]
        if base.endswith((".json", "Pipfile.lock", "composer.lock", "conan.lock")):
            return [json.loads(text)]
        return [d for d in yaml.load_all(text, Loader) if d is not None]
    except yaml.YAMLError as e:
        raise ValueError(str(e)) from e


def _has(key: str) -> Column:
    return F.try_variant_get("doc", f"$['{key}']", "variant").isNotNull()


def is_plan(path: Column) -> Column:
    return path.endswith(".json") & (_has("planned_values") | _has("format_version"))


def is_cloudformation(path: Column) -> Column:
    clues = ("Parameters", "Mappings", "Conditions", "Outputs", "Description")
    return path.rlike(r"(?i)\.(json|ya?ml)$") & (_has("AWSTemplateFormatVersion") | _has("Resources") & F.array_contains(F.array(*map(_has, clues)), True))


def is_kubernetes(path: Column) -> Column:
    return path.rlike(r"(?i)\.ya?ml$") & _has("apiVersion") & _has("kind") & ~_has("AWSTemplateFormatVersion")


def is_chart(path: Column) -> Column:
    return (file_name(path) == "Chart.yaml") & _has("apiVersion") & (_has("name") | _has("version"))


@dataclass(frozen=True)
class Format:
    """A format: which documents are its own, and how they become resources; the lowest priority number goes first.

    What ``parse`` gives may have a column ``error``: where that isn't null, the format can't read the row's source_file,
    and the next format that fits is tried (``iac.read``).
    """

    name: str
    priority: int
    detects: Callable[[Column], Column]
    parse: Callable[[DataFrame], DataFrame]
    structured: bool = True  # takes documents(), else texts()


FORMATS: dict[str, Format] = {}


def register_format(name: str, detects: Callable[[Column], Column], parse: Callable[[DataFrame], DataFrame], priority: int = 100, structured: bool = True) -> None:
    """Adds a format, or replaces one of the same name."""
    FORMATS[name] = Format(name, priority, detects, parse, structured)


def claims(structured: bool) -> Column:
    """The names of the formats whose predicates hold for a row, by priority."""
    path = F.col("source_file")
    own = [f for f in sorted(FORMATS.values(), key=lambda f: f.priority) if f.structured == structured]
    held = [F.when(F.coalesce(f.detects(path), F.lit(False)), F.lit(f.name)) for f in own]
    return F.array_compact(F.array(*held)) if held else F.array().cast("array<string>")


def with_format(rows: DataFrame, structured: bool) -> DataFrame:
    """``rows`` with format_type: the first format, by priority, whose predicate holds; null for none."""
    return rows.withColumn("format_type", F.get(claims(structured), F.lit(0)))
