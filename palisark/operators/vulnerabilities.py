"""Known vulnerabilities: advisory tables, their upsert, and the joins of packages with version ranges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palisark import dims, schemas
from palisark.functions import versions
from palisark.operators.intervals import interval_join
from palisark.session import small_side, written

#: Names of the OSV feed's ecosystems.
OSV_ECOSYSTEMS = {
    "npm": "npm", "PyPI": "pypi", "Go": "go", "crates.io": "crates.io", "RubyGems": "rubygems", "Packagist": "packagist", "Hex": "hex", "Pub": "pub",
}
DEBIAN_URGENCY = {"unimportant": "info", "low": "low", "low*": "low", "medium": "medium", "medium*": "medium", "high": "high", "high*": "high"}
UBUNTU_SEVERITY = {"critical": "critical", "high": "high", "medium": "medium", "low": "low", "negligible": "info", "untriaged": "medium"}
AMAZON_SEVERITY = {"critical": "critical", "important": "high", "medium": "medium", "moderate": "medium", "low": "low"}
REDHAT_SEVERITY = {"critical": "critical", "important": "high", "moderate": "medium", "low": "low", "none": "info"}
SUMMARY_CHARS = 500
KEY, OS_KEY = ("id", "ecosystem", "package"), ("id", "os_family", "os_version", "package")


def upsert(table: DataFrame, rows: DataFrame, key: tuple[str, ...] = KEY, order: str = "load_ord") -> DataFrame:
    """``table`` with ``rows`` put over it: of each key the row that was loaded last, by ``order`` (new rows win)."""
    both = table.withColumn(order, F.lit(-1).cast("long")).unionByName(rows, allowMissingColumns=True)
    last = F.max_by(F.struct(*[c for c in table.columns]), order)
    return both.groupBy(*key).agg(last.alias("r")).select("r.*")


def cve_of(vuln_id: Column, aliases: Column) -> Column:
    """The first alias that is a CVE, else the id."""
    return F.coalesce(F.get(F.filter(aliases, lambda x: x.startswith("CVE-")), F.lit(0)), vuln_id)


#: Ranges of a package up to which its versions meet all of them; with more, versions are looked up (``interval_join``).
FEW_RANGES = 64


def versions_in_ranges(versions_: DataFrame, ranges: DataFrame, few: int = FEW_RANGES) -> DataFrame:
    """Each of ``versions_`` (ecosystem, name, version, ...) with each of ``ranges`` (ecosystem, name, version_introduced,
    version_fixed, ...) of its package that it lies in, see ``versions.is_vulnerable``.

    Keys are made before anything meets. While no package has more than ``few`` ranges a version meets those of its
    package. Otherwise versions find their ranges by a join whose rows grow with the result: PEP 440 versions and ranges by
    their keys; all others by the semantic key, from the first three parts of the lower bound on (a shorter version counts
    as equal to a longer one), with an exact test after it; PEP 440 versions and ranges whose bounds aren't PEP 440, which
    are odd ones of their package, by a test of each.
    """
    by = ["ecosystem", "name"]
    pypi = F.col("ecosystem") == "pypi"
    points = versions_.withColumns({"skey": versions.bound_key(F.col("version")), "pkey": F.when(pypi, versions.pep440_key(F.col("version")))}).where("skey is not null")
    low, high = F.col("version_introduced"), F.col("version_fixed")
    made = {"slow": versions.bound_key(low), "shigh": versions.bound_key(high), "plow": F.when(pypi, versions.pep440_key(low)), "phigh": F.when(pypi, versions.pep440_key(high))}
    bounds = ranges.withColumns(made).where("slow is not null or shigh is not null")
    above = F.col("slow").isNull() | F.coalesce(F.col("pkey") >= F.col("plow"), versions.compare_keys(F.col("skey"), F.col("slow")) >= 0)
    below = F.col("shigh").isNull() | F.coalesce(F.col("pkey") < F.col("phigh"), versions.compare_keys(F.col("skey"), F.col("shigh")) < 0)
    drop = lambda df: df.drop("skey", "pkey", *made)
    if (bounds.groupBy(*by).count().agg(F.max("count")).first()[0] or 0) <= few:
        return drop(points.join(bounds, by).where(above & below))
    odd = (F.col("slow").isNotNull() & F.col("plow").isNull()) | (F.col("shigh").isNotNull() & F.col("phigh").isNull())
    points, bounds = written(points, "version-keys"), written(bounds, "range-keys")
    semantic = interval_join(
        points.where("pkey is null").withColumn("k", F.col("skey")), bounds.withColumns({"lo": F.slice("slow", 1, 3), "hi": F.col("shigh")}), by, "k", "lo", "hi"
    ).where(above & below)
    pep = interval_join(
        points.where("pkey is not null").withColumn("k", F.col("pkey")), bounds.where(pypi & ~odd).withColumns({"lo": F.col("plow"), "hi": F.col("phigh")}), by, "k", "lo", "hi"
    )
    rest = points.where("pkey is not null").join(bounds.where(pypi & odd), by).where(above & below)
    return drop(semantic).unionByName(drop(pep)).unionByName(drop(rest))


def dependency_findings(dependencies: DataFrame, vulnerabilities: DataFrame, ignore_unfixed: bool = False) -> DataFrame:
    """A finding for each dependency in a vulnerable range of its package."""
    deps = dependencies.where("name <> '' and version <> '' and ecosystem <> ''").select("source_file", "name", "version", "ecosystem")
    vulns = vulnerabilities.where("version_fixed <> ''") if ignore_unfixed else vulnerabilities
    aliases = F.coalesce(F.from_json("aliases", "array<string>"), F.array().cast("array<string>"))
    known = F.when(F.col("severity").isin(*dims.SEVERITIES), F.col("severity"))
    # What an entry tells is made once for each entry, before versions meet it.
    told = vulns.select(
        "id", "ecosystem", F.col("package").alias("name"), "version_introduced", "version_fixed", "cvss_score", "summary",
        F.coalesce(known, dims.cvss_severity(F.col("cvss_score"))).alias("severity"), cve_of(F.col("id"), aliases).alias("cve_id"),
    )
    hit = versions_in_ranges(deps, told)
    return hit.select(
        F.concat(F.lit("VULN-"), dims.hash_id(F.col("id"), F.col("ecosystem"), F.col("name"), F.col("version"))).alias("id"),
        F.lit("vulnerability").alias("finding_type"), F.coalesce("summary", F.concat(F.lit("Vulnerability in "), "name")).alias("title"),
        "severity", "source_file", F.col("name").alias("package_name"),
        F.col("version").alias("package_version"), "ecosystem", "cve_id", F.col("id").alias("vuln_id"),
        F.col("version_fixed").alias("fixed_version"), F.lit("").alias("advisory_url"), "cvss_score",
    )


def _keyed(rows: DataFrame, column: str, name: str) -> DataFrame:
    """``rows`` with a struct of the keys (pep, rpm) of a version column, each version's made once: versions repeat."""
    key = F.struct(versions.pep440_key(F.col(column)).alias("pep"), versions.rpm_key(F.col(column)).alias("rpm"))
    known = small_side(rows.select(column).where(F.col(column).isNotNull()).distinct().select(column, key.alias(f"__{name}")), "version-keys")
    return rows.join(known, column, "left")


def os_findings(packages: DataFrame, os_info: DataFrame, vulnerabilities: DataFrame, ignore_unfixed: bool = False) -> DataFrame:
    """A finding for each installed package below an advisory's fixed version.

    Advisories are looked up by the source name and the name; if both have one, it is found twice. ``os_info``: image,
    family, version, pkg_manager. A medium severity with a score takes the score's.
    """
    named = packages.join(os_info.select("image", "family", "version", "pkg_manager").withColumnRenamed("version", "os_release"), "image")
    installed = F.when(F.col("pkg_manager") == "rpm", versions.rpm_evr(F.col("version"), F.col("release"), F.col("epoch"))).otherwise(F.col("version"))
    keys = F.array_distinct(F.array_compact(F.array(F.nullif("source_name", F.lit("")), "name")))
    rows = named.select(
        "image", "name", installed.alias("installed"), "pkg_manager", F.col("family").alias("os_family"),
        versions.os_version_key(F.col("family"), F.col("os_release")).alias("os_version"), keys.alias("keys"),
    )
    rows = _keyed(rows, "installed", "i").withColumn("package", F.explode("keys")).drop("keys")
    vulns = vulnerabilities.where("version_fixed <> ''") if ignore_unfixed else vulnerabilities
    hit = rows.join(_keyed(vulns, "version_fixed", "f"), ["os_family", "os_version", "package"]).where(
        versions.os_package_vulnerable(F.col("installed"), F.col("version_fixed"), F.col("pkg_manager"), F.col("__i"), F.col("__f"))
    )
    by_score = F.when((F.col("severity") == "medium") & (F.col("cvss_score") > 0), dims.cvss_severity(F.col("cvss_score")))
    return hit.select(
        F.concat(F.lit("VULN-"), dims.hash_id(F.col("id"), F.col("image"), F.col("package"), F.col("name"))).alias("id"), "image", F.col("name").alias("package_name"),
        F.col("installed").alias("package_version"), F.col("os_family").alias("ecosystem"), F.col("id").alias("cve_id"), F.col("version_fixed").alias("fixed_version"),
        F.coalesce(by_score, "severity").alias("severity"), "cvss_score", F.col("summary").alias("title"),
    )


def osv(entries: DataFrame, ecosystem: str, order: str = "load_ord") -> DataFrame:
    """OSV entries (a VARIANT column ``entry`` and ``load_ord``) as vulnerability rows: one for each affected range.

    The last introduced and fixed events of a range count; '0' is no lower bound. A CVSS_V3 score that is a number gives
    the severity; a vector string gives score 0 and 'low'; no score gives 'medium'.
    """
    e = F.col("entry")
    get = lambda v, p, t: F.try_variant_get(v, p, t)
    scores = F.filter(get(e, "$.severity", "array<struct<type:string,score:string>>"), lambda s: s["type"] == "CVSS_V3")
    last = F.try_element_at(scores, F.lit(-1))
    score = F.coalesce(last["score"].try_cast("double"), F.lit(0.0))
    severity = F.when(last.isNull(), "medium").when(score >= 9, "critical").when(score >= 7, "high").when(score >= 4, "medium").otherwise("low")
    base = entries.select(
        get(e, "$.id", "string").alias("id"), F.substring(F.coalesce(get(e, "$.summary", "string"), F.lit("")), 1, SUMMARY_CHARS).alias("summary"),
        F.to_json(F.coalesce(get(e, "$.aliases", "array<string>"), F.array().cast("array<string>"))).alias("aliases"), severity.alias("severity"),
        score.alias("cvss_score"), order, F.posexplode(get(e, "$.affected", "array<variant>")).alias("a", "affected"),
    )
    ranges = base.select(
        "*", get(F.col("affected"), "$.package.name", "string").alias("package"),
        F.posexplode(get(F.col("affected"), "$.ranges", "array<struct<type:string,events:array<struct<introduced:string,fixed:string>>>>")).alias("r", "range"),
    ).where("package <> '' and range.type in ('SEMVER', 'ECOSYSTEM')")
    event = lambda k: F.coalesce(F.try_element_at(F.filter(F.transform(F.col("range.events"), lambda x: x[k]), lambda x: x.isNotNull()), F.lit(-1)), F.lit(""))
    introduced = F.when(event("introduced") == "0", "").otherwise(event("introduced"))
    return ranges.select(
        "id", F.lit(ecosystem).alias("ecosystem"), "package", introduced.alias("version_introduced"), event("fixed").alias("version_fixed"), "severity",
        "cvss_score", "summary", "aliases", F.lit("[]").alias("references_json"), (F.col(order) * 1_000_000 + F.col("a") * 1000 + F.col("r")).alias(order),
    )


def _advisory(rows: DataFrame, family: str, os_version: Column | str, **columns: Column) -> DataFrame:
    version = F.lit(os_version) if isinstance(os_version, str) else os_version
    made = {"os_family": F.lit(family), "os_version": version, "cvss_score": F.lit(0.0)} | columns
    names = [x.split(" ")[0] for x in schemas.OS_VULNERABILITY.split(", ")]
    return rows.select(*[made[n].alias(n) for n in names])


def alpine_secdb(docs: DataFrame, os_version: str) -> DataFrame:
    """Alpine's database (VARIANT ``entry``): packages x fixed versions x CVEs; entries marked X- go."""
    packages = docs.select(F.explode(F.try_variant_get("entry", "$.packages", "array<variant>")).alias("p"))
    fixes = packages.select(
        F.try_variant_get("p", "$.pkg.name", "string").alias("package"), F.explode(F.try_variant_get("p", "$.pkg.secfixes", "map<string,variant>")).alias("fixed", "cves")
    )
    each = fixes.select("package", "fixed", F.explode(F.try_variant_get("cves", "$", "array<string>")).alias("cve")).withColumn("cve", F.trim("cve"))
    each = each.where("cve <> '' and not startswith(cve, 'X-')")
    summary = F.concat_ws(" in ", "cve", "package")
    return _advisory(each, "alpine", os_version, id=F.col("cve"), package=F.col("package"), version_fixed=F.col("fixed"), severity=F.lit("medium"), summary=summary)


def debian_tracker(docs: DataFrame) -> DataFrame:
    """Debian's tracker (VARIANT ``entry``): CVE x release; the package is the entry's scope, else the CVE id."""
    cves = docs.select(F.explode(F.try_variant_get("entry", "$", "map<string,variant>")).alias("cve", "c"))
    releases = cves.select("cve", "c", F.explode(F.try_variant_get("c", "$.releases", "map<string,variant>")).alias("codename", "r"))
    get = lambda c, p: F.try_variant_get(c, p, "string")
    rows = releases.where(get("r", "$.status").isin("resolved", "open", "undetermined"))
    version = F.coalesce(F.try_element_at(dims.literal_map(versions.DEBIAN_RELEASES), F.col("codename")), F.col("codename"))
    urgency = F.lower(F.coalesce(get("r", "$.urgency"), F.lit("unimportant")))
    return _advisory(
        rows, "debian", version, id=F.col("cve"), package=F.coalesce(get("c", "$.scope"), F.col("cve")), version_fixed=F.coalesce(get("r", "$.fixed_version"), F.lit("")),
        severity=F.coalesce(F.try_element_at(dims.literal_map(DEBIAN_URGENCY), urgency), F.lit("medium")),
        summary=F.substring(F.coalesce(get("c", "$.description"), F.lit("")), 1, SUMMARY_CHARS),
    )


def ubuntu_oval(definitions: DataFrame, os_version: str) -> DataFrame:
    """Ubuntu OVAL definitions (title, references array, severity): a row for each CVE; the package follows ' in '."""
    title = F.col("title")
    package = F.when(title.contains(" in "), F.element_at(F.split(F.trim(F.element_at(F.split(title, " in "), 2)), r"\s+"), 1)).otherwise("")
    rows = definitions.select("title", "severity", package.alias("package"), F.explode("references").alias("cve")).where("startswith(cve, 'CVE-')")
    severity = F.coalesce(F.try_element_at(dims.literal_map(UBUNTU_SEVERITY), F.lower("severity")), F.lit("medium"))
    return _advisory(
        rows, "ubuntu", os_version, id=F.col("cve"), package=F.col("package"), version_fixed=F.lit(""), severity=severity, summary=F.substring(title, 1, SUMMARY_CHARS)
    )


def read_ubuntu_oval(spark: SparkSession, path: str) -> DataFrame:
    """OVAL XML as the columns that ``ubuntu_oval`` takes."""
    schema = "metadata struct<title:string,reference:array<struct<_ref_id:string>>,advisory:struct<severity:string>>"
    rows = spark.read.format("xml").option("rowTag", "definition").schema(schema).load(path)
    return rows.select(
        F.col("metadata.title").alias("title"), F.transform("metadata.reference", lambda r: r["_ref_id"]).alias("references"), F.col("metadata.advisory.severity").alias("severity")
    )


def amazon_alas(items: DataFrame, os_version: str) -> DataFrame:
    """Amazon's feed items (title, description): the CVEs of the description; titles tell the severity in brackets."""
    word = F.lower(F.regexp_extract("title", r"\((\w+)\)", 1))
    severity = F.coalesce(F.try_element_at(dims.literal_map(AMAZON_SEVERITY), word), F.lit("medium"))
    cves = F.array_distinct(F.regexp_extract_all(F.concat_ws(" ", "title", "description"), F.lit(r"(CVE-\d{4}-\d+)"), F.lit(1)))
    rows = items.select("title", severity.alias("severity"), F.explode(cves).alias("cve"))
    return _advisory(rows, "amzn", os_version, id=F.col("cve"), package=F.lit(""), version_fixed=F.lit(""), severity=F.col("severity"), summary=F.substring("title", 1, SUMMARY_CHARS))


def redhat_cves(entries: DataFrame, major: str) -> DataFrame:
    """Red Hat's CVE list (CVE, severity, cvss3_score, bugzilla_description, affected_packages): packages built for elN."""
    rows = entries.select("CVE", "severity", "cvss3_score", "bugzilla_description", F.explode("affected_packages").alias("nvr"))
    rows = rows.where(F.col("nvr").contains(f"el{major}"))
    name = F.regexp_extract("nvr", r"(?s)^(.*)-[^-]*-[^-]*$", 1)
    rows = rows.withColumn("package", F.when(name == "", F.col("nvr")).otherwise(name)).dropDuplicates(["CVE", "package"])
    severity = F.coalesce(F.try_element_at(dims.literal_map(REDHAT_SEVERITY), F.lower("severity")), F.lit("medium"))
    return _advisory(
        rows, "rhel", major, id=F.col("CVE"), package=F.col("package"), version_fixed=F.lit(""), severity=severity,
        cvss_score=F.coalesce(F.col("cvss3_score").try_cast("double"), F.lit(0.0)), summary=F.substring(F.coalesce("bugzilla_description", F.lit("")), 1, SUMMARY_CHARS),
    )


def status(table: DataFrame) -> DataFrame:
    return table.agg(F.count("*").alias("entries"))


def union(*tables: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), tables)


def ranked(table: DataFrame, key: tuple[str, ...], order: str) -> DataFrame:
    """The load number of each key's row, 1 the last."""
    return table.withColumn("recency", F.row_number().over(W.partitionBy(*key).orderBy(F.desc(order))))
