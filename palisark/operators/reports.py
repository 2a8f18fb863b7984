"""Licences, suppression, differences between reports, and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palisark import dims
from palisark.functions import formats
from palisark.operators.ordering import first_titles, numbered

#: SPDX identifiers by class; the first class that has one counts.
LICENSES = {
    "permissive": (
        "MIT",
        "Apache-2.0",
        "BSD-2-Clause",
        "BSD-3-Clause",
        "ISC",
        "0BSD",
        "Unlicense",
        "CC0-1.0",
        "Zlib",
        "BSL-1.0",
        "MIT-0",
        "Apache-1.1",
        "Artistic-2.0",
        "PostgreSQL",
        "PSF-2.0",
        "Python-2.0",
        "BlueOak-1.0.0",
    ),
    "restrictive": (
        "AGPL-3.0-only",
        "AGPL-3.0-or-later",
        "AGPL-1.0-only",
        "SSPL-1.0",
    ),
    "copyleft": (
        "GPL-2.0-only",
        "GPL-2.0-or-later",
        "GPL-3.0-only",
        "GPL-3.0-or-later",
        "EUPL-1.1",
        "EUPL-1.2",
        "CC-BY-SA-4.0",
        "CC-BY-SA-3.0",
    ),
    "weakly_copyleft": (
        "LGPL-2.0-only",
        "LGPL-2.0-or-later",
        "LGPL-2.1-only",
        "LGPL-2.1-or-later",
        "LGPL-3.0-only",
        "LGPL-3.0-or-later",
        "MPL-2.0",
        "EPL-1.0",
        "EPL-2.0",
        "CDDL-1.0",
        "CDDL-1.1",
        "CPL-1.0",
        "OSL-3.0",
    ),
}
LICENSE_SEVERITY = {"permissive": "info", "weakly_copyleft": "low", "copyleft": "medium", "restrictive": "high", "unknown": "low"}
#: Mentions of licences in prose, with the identifier meant; the first that fits counts.
LICENSE_PROSE = (
    (r"GNU Affero General Public License", "AGPL-3.0-only"),
    (r"GNU Lesser General Public License", "LGPL-3.0-only"),
    (r"GNU General Public License, version 3", "GPL-3.0-only"),
    (r"GNU General Public License", "GPL-2.0-only"),
    (r"Apache License, Version 2", "Apache-2.0"),
    (r"Mozilla Public License", "MPL-2.0"),
    (r"CC BY-NC", "CC-BY-NC-4.0"),
    (r"CC BY-SA", "CC-BY-SA-4.0"),
    (r"MIT License", "MIT"),
)


def classify_license(license_id: Column) -> Column:
    table = {x: k for k, names in reversed(LICENSES.items()) for x in names}
    return F.coalesce(F.try_element_at(dims.literal_map(table), F.trim(F.coalesce(license_id, F.lit("")))), F.lit("unknown"))


def license_severity(classification: Column) -> Column:
    return F.element_at(dims.literal_map(LICENSE_SEVERITY), classification)


def license_of_prose(text: Column) -> Column:
    """The identifier of the licence that a text mentions, or null."""
    return F.coalesce(*[F.when(text.contains(said), F.lit(spdx)) for said, spdx in LICENSE_PROSE])


def license_findings(dependencies: DataFrame, warn_copyleft: bool = True, alert_unknown: bool = True, alert_restrictive: bool = True) -> DataFrame:
    """A finding for each named dependency whose licence isn't permissive, by the classes that are switched on."""
    classes = ["restrictive"] * alert_restrictive + ["copyleft", "weakly_copyleft"] * warn_copyleft + ["unknown"] * alert_unknown
    lic, cls = F.coalesce("license", F.lit("")), F.col("classification")
    title = (
        F.when(cls == "restrictive", F.concat(F.lit("Restrictive license: "), lic)).when(cls == "copyleft", F.concat(F.lit("Copyleft license: "), lic))
        .when(cls == "weakly_copyleft", F.concat(F.lit("Weakly copyleft license: "), lic))
        .when(lic == "", F.lit("No license information available")).otherwise(F.concat(F.lit("Unknown license classification: "), lic))
    )
    rows = dependencies.where("name <> ''").withColumn("classification", classify_license(F.col("license"))).where(cls.isin(*classes) if classes else F.lit(False))
    return rows.select(
        F.concat(F.lit("LIC-"), dims.hash_id(F.col("ecosystem"), F.col("name"), F.col("version"), lic)).alias("id"), F.lit("license").alias("finding_type"),
        title.alias("title"), license_severity(cls).alias("severity"), "source_file", F.col("name").alias("package_name"), F.col("version").alias("package_version"),
        "ecosystem", lic.alias("license_id"), lic.alias("license_name"), "classification",
    )


def read_ignores(spark: SparkSession, path: str) -> DataFrame:
    """An ignore file: ``id`` or ``id exp:YYYY-MM-DD`` a line, # comments. An unreadable date never expires."""
    line = F.trim(F.regexp_replace("value", "#.*$", ""))
    rows = spark.read.text(path).select(line.alias("line")).where("line <> ''")
    date = F.regexp_extract("line", r"\bexp:(\S+)", 1)
    return rows.select(F.split("line", r"\s+")[0].alias("ignore_id"), F.to_date(F.try_to_timestamp(date, F.lit("yyyy-MM-dd"))).alias("expires"))


def suppress(findings: DataFrame, ignores: DataFrame, id_col: str = "id", today: Column | None = None) -> DataFrame:
    """The findings that no entry still in force names; the day of expiry is in force."""
    today = F.current_date() if today is None else today
    active = ignores.where(F.col("expires").isNull() | (today <= F.col("expires"))).select(F.col("ignore_id").alias(id_col)).distinct()
    return findings.join(active, id_col, "left_anti")


def min_severity(findings: DataFrame, least: str) -> DataFrame:
    return findings.where(dims.severity_rank(F.col("severity")) >= dims.SEVERITIES.index(least))


def last_by_id(report: DataFrame, order: str = "ord") -> DataFrame:
    """Of repeated ids the last one's row."""
    others = [c for c in report.columns if c != "id"]
    return report.groupBy("id").agg(F.max_by(F.struct(*others), order).alias("r")).select("id", "r.*")


def diff(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """Rows of either report with ``change``: added, removed or unchanged (as they are now). Ids decide.

    One full outer join on the id; both sides are deduplicated first (the last row of an id counts).
    """
    names = [c for c in current.columns if c not in ("id", "ord")]
    pack = lambda df: last_by_id(df).select("id", F.struct(*names).alias("r"))
    old = pack(baseline).withColumnsRenamed({"id": "id_old", "r": "old"})
    new = pack(current).withColumnsRenamed({"id": "id_new", "r": "new"})
    joined = old.join(new, F.col("id_old") == F.col("id_new"), "full_outer")
    change = F.when(F.col("id_old").isNull(), "added").when(F.col("id_new").isNull(), "removed").otherwise("unchanged")
    return joined.select(F.coalesce("id_new", "id_old").alias("id"), change.alias("change"), F.coalesce("new", "old").alias("r")).select("id", "change", "r.*")


def severity_summary(findings: DataFrame, *by: str) -> DataFrame:
    return findings.groupBy(*by, "severity").agg(F.count("*").alias("n"))


def technique_summary(threats: DataFrame) -> DataFrame:
    """For each known technique: threats, worst severity, first five titles by id."""
    known = list(dims.TECHNIQUE_NAMES)
    each = threats.select(F.explode("mitre_techniques").alias("technique_id"), "sev_rank", "title", "id").where(F.col("technique_id").isin(*known))
    counts = each.groupBy("technique_id").agg(F.count("*").alias("n"), dims.severity_name(F.max("sev_rank")).alias("max_severity"))
    return counts.join(first_titles(each.select("technique_id", "id", "title"), ["technique_id"], "id", "title"), "technique_id").orderBy("technique_id")


def failed(findings: DataFrame) -> DataFrame:
    """One row: whether any finding is critical or high."""
    return findings.agg(F.coalesce(F.bool_or(F.col("severity").isin("critical", "high")), F.lit(False)).alias("failed"))


def normalised_threats(raw: DataFrame) -> DataFrame:
    """Unknown STRIDE categories become information_disclosure; confidence is clamped to 0..1."""
    return raw.withColumns({
        "stride_category": F.when(F.col("stride_category").isin(*dims.STRIDE_CATEGORIES), F.col("stride_category")).otherwise("information_disclosure"),
        "confidence": F.greatest(F.lit(0.0), F.least(F.lit(1.0), "confidence")),
    })


def type_counts(findings: DataFrame) -> DataFrame:
    """Findings by type and severity."""
    return findings.groupBy("finding_type", "severity").agg(F.count("*").alias("n"))


def severity_bar(threats: DataFrame) -> DataFrame:
    """A row for each file: its threats, those of each severity, and its distinct STRIDE categories."""
    counts = [F.count_if(F.col("severity") == s).alias(s) for s in reversed(dims.SEVERITIES)]
    return threats.groupBy("source_file").agg(F.count("*").alias("total"), *counts, F.array_sort(F.collect_set("stride_category")).alias("stride_categories"))


def stride_summary(threats: DataFrame) -> DataFrame:
    """Threats and worst rank by STRIDE category."""
    return threats.groupBy("stride_category").agg(F.count("*").alias("n"), F.max("sev_rank").cast("long").alias("max_rank"))


def worst(threats: DataFrame, n: int, *order: str) -> DataFrame:
    """The ``n`` worst threats, equal ones by ``order``."""
    return threats.orderBy(F.desc("sev_rank"), *order).limit(n)


def gates(findings: DataFrame, *by: str) -> DataFrame:
    """Whether any finding of a group is critical or high (FAILED), and how many there are."""
    return findings.groupBy(*by).agg(F.bool_or(F.col("severity").isin("critical", "high")).alias("failed"), F.count("*").alias("n_reported"))


#: The columns in which an ignore entry may name a finding, by type of finding; the id does for all.
IGNORE_KEYS = {"vulnerability": "vuln_id", "secret": "rule_id"}


def suppress_all(findings: DataFrame, ignores: DataFrame, today: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """The findings that stay, and suppressed: finding_type and n of those that an entry in force names.

    An entry names a vulnerability by vuln_id, a secret by rule_id, anything else by id.
    """
    today = F.current_date() if today is None else today
    keys = [c for c in IGNORE_KEYS.values() if c in findings.columns]
    key = F.coalesce(*[F.when(F.col("finding_type") == k, F.col(c)) for k, c in IGNORE_KEYS.items() if c in keys], F.col("id")) if keys else F.col("id")
    active = ignores.where(F.col("expires").isNull() | (today <= F.col("expires"))).select(F.col("ignore_id").alias("__key")).distinct()
    keyed = findings.withColumn("__key", key)
    gone = keyed.join(active, "__key", "left_semi").groupBy("finding_type").agg(F.count("*").alias("n"))
    return keyed.join(active, "__key", "left_anti").drop("__key"), gone


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """The threats of JSON reports as ``diff`` takes them: ord, id, title, severity, resource_address; ids and titles are text."""
    schema = "threats array<struct<id:string,title:string,severity:string,resource_address:string>>"
    rows = spark.read.schema(schema).json(path, multiLine=True)
    return rows.select(F.posexplode("threats").alias("ord", "t")).select("ord", "t.*").where("id is not null")


def diff_document(changes: DataFrame) -> DataFrame:
    """A difference as a JSON document (``formats.document``): for each kind of change its count and its rows by id."""
    counts = {r["change"]: r["n"] for r in changes.groupBy("change").agg(F.count("*").alias("n")).collect()}  # three kinds
    sections: list[str | DataFrame] = ["{"]
    for i, kind in enumerate(("added", "removed", "unchanged")):
        rows = changes.where(F.col("change") == kind).drop("change")
        line = F.to_json(F.struct(*rows.columns))
        sections += [f'{"," if i else ""}"{kind}":{{"n":{counts.get(kind, 0)},"rows":[', numbered(rows, "id").withColumn("line", line), "]}"]
    return formats.document(changes.sparkSession, *sections, "}")


def diff_markdown(changes: DataFrame) -> DataFrame:
    """A difference as lines of a markdown table, in order: added, removed, unchanged, each by id."""
    place = F.array_position(F.array(*map(F.lit, ("added", "removed", "unchanged"))), F.col("change"))
    cell = lambda c: F.replace(F.replace(F.col(c), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))
    line = F.concat(F.lit("| "), F.concat_ws(" | ", "change", "id", "severity", cell("title"), F.concat(F.lit("`"), cell("resource_address"), F.lit("`"))), F.lit(" |"))
    return changes.orderBy(place, "id").select(line.alias("line"))


def combined(**parts: DataFrame) -> DataFrame:
    """Findings of several scanners as one table: scanner, severity, and the finding as JSON."""
    out = None
    for scanner, found in parts.items():
        rows = found.select(F.lit(scanner).alias("scanner"), "severity", F.to_json(F.struct(*found.columns)).alias("finding"))
        out = rows if out is None else out.unionByName(rows)
    return out
