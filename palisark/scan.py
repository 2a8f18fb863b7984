"""Whole scans: files to resources, graph, threats, secrets, vulnerabilities and licences; images in the same way.

Files are parsed once: resources, nodes and edges, which all that follows uses many times, are written to the shared
folder; findings are lazy DataFrames. Tables of known vulnerabilities and ignore
entries are given by the caller as DataFrames (``schemas.VULNERABILITY``, ``schemas.OS_VULNERABILITY``,
``reports.read_ignores``).
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce
from pathlib import Path

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisark import dims
from palisark.operators import graph, image, reports, rules, secrets, vulnerabilities
from palisark.session import written
from palisark.sources import files, iac, lockfiles

SCANNERS = ("misconfig", "secret", "vuln", "license")
#: The fields of a configuration, their defaults, and those that a file found by chance may set.
CONFIG_DEFAULTS = {"min_severity": "info", "extra_rule_paths": (), "output_format": "json", "redaction": {"strategy": "placeholder", "fields": ("arn", "account_id", "tags", "ip_address")}}
SAFE_FIELDS = ("min_severity", "output_format", "redaction")
OUTPUT_FORMATS = ("json", "sarif", "markdown", "bitbucket", "matrix", "diagram", "cyclonedx")


class ConfigError(ValueError):
    """A configuration that can't be used."""


def read_config(path: str | Path | None = None, trusted: bool = True) -> tuple[dict, list[str]]:
    """The configuration of a YAML file over the defaults, and its fields that were not taken.

    A file that the caller hasn't named (``trusted`` false) sets SAFE_FIELDS only. Unknown fields aren't taken.
    """
    if path is None:
        return dict(CONFIG_DEFAULTS), []
    try:
        data = yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {}
    except (OSError, yaml.YAMLError) as e:
        raise ConfigError(f"{path}: {e}") from e
    if not isinstance(data, dict):
        raise ConfigError(f"{path}: not a mapping")
    allowed = set(CONFIG_DEFAULTS) if trusted else set(SAFE_FIELDS)
    config = CONFIG_DEFAULTS | {k: v for k, v in data.items() if k in allowed}
    if config["min_severity"] not in dims.SEVERITIES:
        raise ConfigError(f"{path}: unknown severity {config['min_severity']!r}")
    if config["output_format"] not in OUTPUT_FORMATS:
        raise ConfigError(f"{path}: unknown format {config['output_format']!r}")
    return config, sorted(set(data) - allowed)


def threats(resources: DataFrame, extra_rule_paths: Iterable[str | Path] = (), min_severity: str = "info") -> DataFrame:
    """Rule threats and boundary threats as one table, with ``phase`` (0 rules, 1 boundaries) in the order of a report."""
    nodes = written(graph.nodes(resources), "nodes")
    return _threats(nodes, graph.edges(resources, nodes), extra_rule_paths, min_severity)


def _threats(nodes: DataFrame, edges: DataFrame, extra_rule_paths: Iterable[str | Path], min_severity: str) -> DataFrame:
    by_rule = rules.threats(nodes, rules.load(extra_rule_paths)).withColumn("phase", F.lit(0))
    by_edge = graph.boundary_threats(edges, nodes).withColumn("phase", F.lit(1))
    return reports.min_severity(by_rule.unionByName(by_edge), min_severity)


@dataclass(frozen=True)
class Analysis:
    """What ``analyze`` gives: the graph beside its threats."""

    resources: DataFrame
    nodes: DataFrame
    edges: DataFrame
    threats: DataFrame


def analyze(spark: SparkSession, path: str, extra_rule_paths: Iterable[str | Path] = (), min_severity: str = "info") -> Analysis:
    """The graph and the threats of the infrastructure files under ``path`` (a folder or a file)."""
    resources = written(iac.resources(files.walk(spark, path)), "resources")
    nodes = written(graph.nodes(resources), "nodes")
    edges = written(graph.edges(resources, nodes), "edges")
    return Analysis(resources, nodes, edges, _threats(nodes, edges, extra_rule_paths, min_severity))


def scan(spark: SparkSession, path: str, extra_rule_paths: Iterable[str | Path] = (), min_severity: str = "info") -> DataFrame:
    """The threats of the infrastructure files under ``path``."""
    return analyze(spark, path, extra_rule_paths, min_severity).threats


def scan_secrets(spark: SparkSession, path: str, allow_patterns: tuple[str, ...] = ()) -> DataFrame:
    """The secrets in the text files under ``path``."""
    found = secrets.scannable(files.walk(spark, path), path_col="rel")
    return secrets.scan(found, path_col="rel", allow_patterns=allow_patterns)


def scan_vulnerabilities(spark: SparkSession, path: str, known: DataFrame, ignore_unfixed: bool = False) -> DataFrame:
    """The vulnerable dependencies of the lock files under ``path``."""
    return vulnerabilities.dependency_findings(lockfiles.dependencies(files.texts(files.walk(spark, path))), known, ignore_unfixed)


def scan_filesystem(
    spark: SparkSession, path: str, known: DataFrame | None = None, scanners: tuple[str, ...] = SCANNERS, ignores: DataFrame | None = None,
    ignore_unfixed: bool = False, extra_rule_paths: Iterable[str | Path] = (), min_severity: str = "info",
) -> dict[str, DataFrame]:
    """For each scanner its findings under ``path``, less what an ignore entry names; 'suppressed': how many of each type.

    vuln needs ``known``; without it there is none.
    """
    found = files.walk(spark, path)
    deps = lockfiles.dependencies(files.texts(found))
    out = {}
    if "misconfig" in scanners:
        out["misconfig"] = threats(written(iac.resources(found), "resources"), extra_rule_paths, min_severity).withColumn("finding_type", F.lit("misconfig"))
    if "secret" in scanners:
        out["secret"] = secrets.scan(secrets.scannable(found, path_col="rel"), path_col="rel")
    if "vuln" in scanners and known is not None:
        out["vuln"] = vulnerabilities.dependency_findings(deps, known, ignore_unfixed)
    if "license" in scanners:
        out["license"] = reports.license_findings(deps)
    if ignores is None:
        return out
    parts = {k: reports.suppress_all(v, ignores) for k, v in out.items()}
    gone = None
    for _, n in parts.values():
        gone = n if gone is None else gone.unionByName(n)
    return {k: v for k, (v, _) in parts.items()} | ({"suppressed": gone} if gone is not None else {})


def unread(spark: SparkSession, path: str, allow_patterns: tuple[str, ...] = ()) -> DataFrame:
    """What scans of ``path`` leave out (``files.QUARANTINE``): files that are too large, that no format could read or that
    none fits, files too large for the secret scan, and allow patterns that are too long."""
    found = files.walk(spark, path)
    large = files.too_large(spark, path)
    return large.unionByName(iac.read(found).quarantine).unionByName(secrets.left_out(found, allow_patterns))


def scan_all(spark: SparkSession, path: str, known: DataFrame | None = None, **options) -> DataFrame:
    """All findings under ``path`` as one table (``reports.combined``)."""
    parts = scan_filesystem(spark, path, known, **options)
    parts.pop("suppressed", None)
    return reports.combined(**parts)


def scan_image(
    layers: DataFrame, configs: DataFrame, os_known: DataFrame, known: DataFrame, ignore_unfixed: bool = False, with_secrets: bool = False
) -> dict[str, DataFrame]:
    """Of image layers (image, layer, content) and configurations (image, config VARIANT): os, os_packages, app_packages,
    os_vulnerability, app_vulnerability, misconfig, secret (if asked for), and summary, a row for each image.

    Layers are merged as lists of files; contents are read afterwards and once, of files that a reader or scanner wants.
    """
    merged = written(image.merge_layers(*image.read_layers(layers)), "image-files")
    wanted = image.wanted_files(F.col("path"))
    if with_secrets:
        wanted = wanted | (F.col("size") <= secrets.MAX_FILE_BYTES) & ~secrets.skipped(F.col("path"))
    found = written(image.read_contents(layers, merged.where(wanted)), "image-contents")
    os_info, packages, apps = image.detect_os(found), image.installed_packages(found), image.app_packages(found)
    out = {"os": os_info, "os_packages": packages, "app_packages": apps}
    out["os_vulnerability"] = vulnerabilities.os_findings(packages, os_info, os_known, ignore_unfixed)
    named = apps.withColumn("source_file", F.concat_ws("\0", "image", "source_file"))
    out["app_vulnerability"] = vulnerabilities.dependency_findings(named, known, ignore_unfixed).withColumn("image", F.substring_index("source_file", "\0", 1))
    out["misconfig"] = image.config_findings(configs)
    if with_secrets:
        texts = secrets.scannable(found.withColumn("path", F.concat_ws("\0", "image", "path")))
        out["secret"] = secrets.scan(texts).withColumn("image", F.substring_index("file_path", "\0", 1))
    kinds = {
        "os_packages": "os_packages", "app_packages": "app_dependencies", "os_vulnerability": "os_vulnerabilities", "app_vulnerability": "app_vulnerabilities",
        "misconfig": "misconfigs", "secret": "secrets",
    }
    each = [out[k].select("image", F.lit(n).alias("kind")) for k, n in kinds.items() if k in out]
    images = layers.select("image").union(configs.select("image"))
    out["summary"] = image.summary(reduce(DataFrame.unionByName, each), images)
    return out
