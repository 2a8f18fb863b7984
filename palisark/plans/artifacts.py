"""Queries over artefacts that are made from the driver's tables: package databases, advisories, manifests, lock files,
image configurations. Each makes texts or documents, reads them with the library's readers, and has the SQL of its rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palisark import dims
from palisark.functions import formats, versions
from palisark.operators import graph, image, reports, rules, secrets, vulnerabilities
from palisark.plans.catalogue import _SEVERITY_SQL, _STRIDE_SQL, _infra, _threats, query, sql_text, table
from palisark.sources import files, iac, lockfiles, readers


def _pick(values: tuple, by: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (by % len(values) + 1).cast("int"))


def _pick_sql(values: tuple, by: str) -> str:
    return "[" + ", ".join(sql_text(v) for v in values) + f"][{by} % {len(values)} + 1]"


def _text(*parts: object) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(str(p)) for p in parts])


def _files(rows: DataFrame, image_col: str, path: str | Column, stanza: Column, separator: str) -> DataFrame:
    """One file for each image, its stanzas in no fixed order."""
    made = rows.groupBy(F.col(image_col).cast("string").alias("image")).agg(F.array_join(F.collect_list(stanza), separator).alias("text"))
    return made.select("image", (path if isinstance(path, Column) else F.lit(path)).alias("path"), F.encode("text", "UTF-8").alias("content"))


# Packages of images


@query("""
    SELECT CAST(p_partkey % 40 AS VARCHAR) AS image, 'pkg' || p_partkey AS name, p_size || '.' || p_partkey % 7 || '-r0' AS version, 'x86_64' AS arch,
           CASE WHEN p_partkey % 3 = 0 THEN 'src' || p_partkey % 11 ELSE 'pkg' || p_partkey END AS source_name, p_size || '.' || p_partkey % 7 || '-r0' AS source_version, 'MIT' AS license
    FROM part
""")
def apk_database(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    origin = F.when(k % 3 == 0, _text("\no:src", k % 11)).otherwise("")
    stanza = _text("P:pkg", k, "\nV:", F.col("p_size"), ".", k % 7, "-r0\nA:x86_64\nL:MIT", origin)
    made = _files(table(spark, sf_dir, "part").withColumn("image", k % 40), "image", "lib/apk/db/installed", stanza, "\n\n")
    return image.installed_packages(made).select("image", "name", "version", "arch", "source_name", "source_version", "license")


@query("""
    SELECT CAST(p_partkey % 40 AS VARCHAR) AS image, 'pkg' || p_partkey AS name, p_size || '.' || p_partkey % 7 AS version, 'amd64' AS arch,
           CASE WHEN p_partkey % 3 > 0 THEN 'src' || p_partkey % 11 ELSE 'pkg' || p_partkey END AS source_name,
           CASE WHEN p_partkey % 3 = 2 THEN '9.' || p_partkey % 5 ELSE p_size || '.' || p_partkey % 7 END AS source_version
    FROM part WHERE p_partkey % 4 > 0
""")
def dpkg_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    status = F.when(k % 4 == 0, _pick(("deinstall ok config-files", "purge ok not-installed"), k)).otherwise("install ok installed")
    source = F.when(k % 3 == 1, _text("\nSource: src", k % 11)).when(k % 3 == 2, _text("\nSource: src", k % 11, " (9.", k % 5, ")")).otherwise("")
    stanza = _text("Package: pkg", k, "\nStatus: ", status, "\nArchitecture: amd64\nVersion: ", F.col("p_size"), ".", k % 7, source)
    path = F.when(F.col("image") % 2 == 0, "var/lib/dpkg/status").otherwise("var/lib/dpkg/status.d/base")
    made = _files(table(spark, sf_dir, "part").withColumn("image", k % 40), "image", path, stanza, "\n\n")
    return image.installed_packages(made).select("image", "name", "version", "arch", "source_name", "source_version")


@query("""
    SELECT CAST(s_suppkey AS VARCHAR) AS image, ['alpine', 'debian', 'ubuntu', 'centos', 'rocky', 'debian'][s_suppkey % 6 + 1] AS family,
           CASE s_suppkey % 6 WHEN 0 THEN '3.' || s_suppkey % 20 WHEN 1 THEN '12' WHEN 2 THEN '22.04' WHEN 3 THEN '8.4' WHEN 4 THEN '9.' || s_suppkey % 3 ELSE '11.' || s_suppkey % 9 END AS version,
           ['apk', 'dpkg', 'dpkg', 'rpm', 'rpm', 'dpkg'][s_suppkey % 6 + 1] AS pkg_manager,
           ['', 'bookworm', 'jammy', '', '', ''][s_suppkey % 6 + 1] AS version_codename
    FROM supplier
""")
def os_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """os-release beats the other files; the older files tell an OS that has none; a file that tells nothing is passed over."""
    k = F.col("s_suppkey")
    release = (
        F.when(k % 6 == 0, _text('NAME="Alpine Linux"\nID=alpine\nVERSION_ID=3.', k % 20, "\n")).when(k % 6 == 1, 'ID=debian\nVERSION_ID="12"\nVERSION_CODENAME=bookworm\n')
        .when(k % 6 == 4, _text('ID="rocky"\nID_LIKE="rhel centos fedora"\nVERSION_ID="9.', k % 3, '"\n')).otherwise("# nothing\n")
    )
    older = (
        F.when(k % 6 == 2, F.struct(F.lit("etc/lsb-release").alias("path"), F.lit("DISTRIB_ID=Ubuntu\nDISTRIB_RELEASE=22.04\nDISTRIB_CODENAME=jammy\n").alias("text")))
        .when(k % 6 == 3, F.struct(F.lit("etc/centos-release").alias("path"), F.lit("CentOS Linux release 8.4 (Core)\n").alias("text")))
        .when(k % 6 == 5, F.struct(F.lit("etc/debian_version").alias("path"), _text("11.", k % 9, "\n").alias("text")))
        .otherwise(F.struct(F.lit("etc/redhat-release").alias("path"), F.lit("Fedora release 1\n").alias("text")))
    )
    each = F.array(F.struct(F.lit("etc/os-release").alias("path"), release.alias("text")), older)
    made = table(spark, sf_dir, "supplier").select(k.cast("string").alias("image"), F.explode(each).alias("f")).select("image", "f.path", F.encode("f.text", "UTF-8").alias("content"))
    return image.detect_os(made).select("image", "family", "version", "pkg_manager", "version_codename")


@query("""
    WITH v AS (SELECT 'CVE-' || l_orderkey || '-' || l_linenumber AS id, l_partkey, CAST(l_quantity AS BIGINT) AS fix, l_suppkey FROM lineitem)
    SELECT p_partkey, v.id AS cve_id, CASE WHEN l_suppkey % 10 >= 9 THEN 'critical' WHEN l_suppkey % 10 >= 7 THEN 'high' WHEN l_suppkey % 10 >= 4 THEN 'medium'
           WHEN l_suppkey % 10 > 0 THEN 'low' ELSE 'medium' END AS severity
    FROM part JOIN v ON l_partkey = p_partkey WHERE fix = 1 OR p_size < fix
""")
def os_package_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """dpkg packages by name or by source; an advisory without a fixed version counts for every version."""
    k = F.col("p_partkey")
    packages = table(spark, sf_dir, "part").select(
        k.cast("string").alias("image"), _text("pkg", k).alias("name"), F.concat_ws(".", "p_size", k % 7).alias("version"), F.lit("").alias("release"),
        F.lit(0).alias("epoch"), F.lit("amd64").alias("arch"), _text("src", k).alias("source_name"), F.lit("").alias("source_version"), F.lit("").alias("license"),
    )
    info = packages.select("image", F.lit("debian").alias("family"), F.lit("bookworm").alias("version"), F.lit("dpkg").alias("pkg_manager"))
    fix = F.col("l_quantity").cast("long")
    package = _text(F.when(F.col("l_linenumber") % 2 == 0, "pkg").otherwise("src"), F.col("l_partkey"))
    known = table(spark, sf_dir, "lineitem").select(
        F.concat_ws("-", F.lit("CVE"), "l_orderkey", "l_linenumber").alias("id"), F.lit("debian").alias("os_family"), F.lit("12").alias("os_version"), package.alias("package"),
        F.when(fix == 1, "").otherwise(fix.cast("string")).alias("version_fixed"), F.lit("medium").alias("severity"), (F.col("l_suppkey") % 10).cast("double").alias("cvss_score"), F.lit("s").alias("summary"),
    )
    return vulnerabilities.os_findings(packages, info, known).select(F.col("image").cast("long").alias("p_partkey"), "cve_id", "severity")


@query("""
    SELECT p_partkey, CASE WHEN a <> b THEN CASE WHEN a < b THEN -1 ELSE 1 END WHEN p < q THEN -1 WHEN p > q THEN 1 ELSE 0 END AS cmp
    FROM (SELECT p_partkey, p_size AS a, 25 AS b, [0, 1, 2, 3, 4][p_partkey % 5 + 1] AS p, [0, 1, 2, 3, 4][p_partkey % 4 + 1] AS q FROM part)
""")
def pep440_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Development, pre-, final and post-releases in Python's order."""
    k = F.col("p_partkey")
    suffixes = (".dev1", "a1", "rc1", "", ".post1")
    a, b = _text(F.col("p_size"), ".0", _pick(suffixes, k)), _text("25", _pick(suffixes[:4], k))
    return table(spark, sf_dir, "part").select("p_partkey", versions.compare(a, b, F.lit("pypi")).alias("cmp"))


@query("""
    SELECT p_partkey, CASE WHEN p_partkey % 3 > 0 THEN p_partkey % 3 || ':' ELSE '' END || p_size || CASE WHEN p_partkey % 2 = 0 THEN '-' || p_partkey % 9 || '.el8' ELSE '' END AS evr FROM part
""")
def rpm_evr_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    release = F.when(k % 2 == 0, _text(k % 9, ".el8")).otherwise("")
    return table(spark, sf_dir, "part").select("p_partkey", versions.rpm_evr(F.col("p_size").cast("string"), release, (k % 3).cast("int")).alias("evr"))


# Advisories


@query("""
    SELECT 'GHSA-' || event_id AS id, 'npm' AS ecosystem, event_type AS package, CASE WHEN event_id % 3 = 0 THEN '' ELSE event_id % 3 || '.0.0' END AS version_introduced,
           event_id % 7 + 3 || '.0' AS version_fixed,
           CASE WHEN event_id % 4 = 0 THEN 'medium' WHEN event_id % 10 >= 9 THEN 'critical' WHEN event_id % 10 >= 7 THEN 'high' WHEN event_id % 10 >= 4 THEN 'medium' ELSE 'low' END AS severity,
           CASE WHEN event_id % 4 = 0 THEN 0.0 ELSE CAST(event_id % 10 AS DOUBLE) END AS cvss_score, CASE WHEN event_id % 2 = 0 THEN 'CVE-' || event_id ELSE 'GHSA-' || event_id END AS cve
    FROM events WHERE event_id % 5 > 0
""")
def osv_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OSV documents; ranges of commits (every fifth entry's) are no version ranges."""
    k = F.col("event_id")
    doc = _text(
        '{"id":"GHSA-', k, '","summary":"s","aliases":["X-1"', F.when(k % 2 == 0, _text(',"CVE-', k, '"')).otherwise(""), "],",
        F.when(k % 4 == 0, "").otherwise(_text('"severity":[{"type":"CVSS_V3","score":"', k % 10, '"}],')),
        '"affected":[{"package":{"name":"', F.col("event_type"), '"},"ranges":[{"type":"', F.when(k % 5 == 0, "GIT").otherwise("SEMVER"),
        '","events":[{"introduced":"', F.when(k % 3 == 0, "0").otherwise(_text(k % 3, ".0.0")), '"},{"fixed":"1.0"},{"fixed":"', k % 7 + 3, '.0"}]}]}]}',
    )
    rows = vulnerabilities.osv(table(spark, sf_dir, "events").select(F.parse_json(doc).alias("entry"), k.alias("load_ord")), "npm")
    cve = vulnerabilities.cve_of(F.col("id"), F.from_json("aliases", "array<string>"))
    return rows.select("id", "ecosystem", "package", "version_introduced", "version_fixed", "severity", "cvss_score", cve.alias("cve"))


@query("""
    SELECT 'CVE-' || p_partkey || '-' || n AS id, 'alpine' AS os_family, '3.19' AS os_version, p_brand || p_partkey AS package, p_size || '-r' || f AS version_fixed, 'medium' AS severity
    FROM part, (VALUES (0), (1)) f(f), (VALUES (0, 0), (0, 1), (1, 2)) c(g, n) WHERE f = g
""")
def alpine_advisories(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    fixes = _text('{"', F.col("p_size"), '-r0":["CVE-', k, '-0"," CVE-', k, '-1 ","X-1"],"', F.col("p_size"), '-r1":["CVE-', k, '-2"]}')
    doc = _text('{"packages":[{"pkg":{"name":"', F.col("p_brand"), k, '","secfixes":', fixes, "}}]}")
    found = vulnerabilities.alpine_secdb(table(spark, sf_dir, "part").select(F.parse_json(doc).alias("entry")), "3.19")
    return found.select("id", "os_family", "os_version", "package", "version_fixed", "severity")


@query("""
    SELECT 'CVE-' || p_partkey AS id, ['10', '11', '12', '13', 'sid'][r + 1] AS os_version, CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE 'CVE-' || p_partkey END AS package,
           CASE WHEN r = 0 THEN '' ELSE p_size || '.' || r END AS version_fixed,
           ['info', 'low', 'medium', 'high', 'medium', 'info'][(p_partkey + r) % 6 + 1] AS severity
    FROM part, (VALUES (0), (1), (2), (3), (4)) x(r) WHERE r <> 3 OR p_partkey % 3 > 0
""")
def debian_advisories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Releases by code name; a status that isn't known counts for nothing, an unknown urgency as medium, none as info."""
    k = F.col("p_partkey")
    urgency = lambda r: _pick(('"unimportant"', '"low"', '"medium*"', '"high"', '"not yet assigned"', "null"), k + r)
    status = lambda r: F.when(k % 3 == 0, "not-affected").otherwise("open") if r == 3 else F.lit("resolved")
    fixed = lambda r: F.lit("") if r == 0 else _text('"fixed_version":"', F.col("p_size"), ".", r, '",')
    names = ("buster", "bullseye", "bookworm", "trixie", "sid")
    each = [_text(f'"{n}":{{"status":"', status(r), '",', fixed(r), '"urgency":', urgency(r), "}") for r, n in enumerate(names)]
    scope = F.when(k % 2 == 0, _text('"scope":"', F.col("p_brand"), '",')).otherwise("")
    doc = _text('{"CVE-', k, '":{', scope, '"releases":{', F.concat_ws(",", *each), "}}}")
    found = vulnerabilities.debian_tracker(table(spark, sf_dir, "part").select(F.parse_json(doc).alias("entry")))
    return found.select("id", "os_version", "package", "version_fixed", "severity")


@query("""
    SELECT 'CVE-2024-' || p_partkey || n AS id, CASE WHEN p_partkey % 2 = 0 THEN 'lib' || p_size ELSE '' END AS package,
           ['critical', 'high', 'medium', 'low', 'info', 'medium', 'medium'][p_partkey % 7 + 1] AS severity
    FROM part, (VALUES (0), (1)) x(n)
""")
def ubuntu_advisories(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    title = F.when(k % 2 == 0, _text("CVE-2024-", k, " in lib", F.col("p_size"), " (main) fixed")).otherwise("No package here")
    references = F.array(_text("CVE-2024-", k, "0"), F.lit("https://x"), _text("CVE-2024-", k, "1"))
    rows = table(spark, sf_dir, "part").select(
        title.alias("title"), references.alias("references"), _pick(("Critical", "high", "MEDIUM", "low", "negligible", "untriaged", "odd"), k).alias("severity")
    )
    return vulnerabilities.ubuntu_oval(rows, "22.04").select("id", "package", "severity")


@query("""
    SELECT 'CVE-2024-' || (p_partkey + 1000 * n) AS id, ['critical', 'high', 'medium', 'medium', 'low', 'medium'][p_partkey % 6 + 1] AS severity
    FROM part, (VALUES (1), (2)) x(n)
""")
def amazon_advisories(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    title = _text("ALAS-", k, " (", _pick(("critical", "Important", "medium", "moderate", "low", "odd"), k), "): kernel")
    said = _text("Fixes CVE-2024-", k + 1000, " and CVE-2024-", k + 2000, ", again CVE-2024-", k + 1000)
    return vulnerabilities.amazon_alas(table(spark, sf_dir, "part").select(title.alias("title"), said.alias("description")), "2023").select("id", "severity")


@query("""
    SELECT 'CVE-' || p_partkey AS id, 'lib-' || p_size AS package, ['critical', 'high', 'medium', 'low', 'info', 'medium'][p_partkey % 6 + 1] AS severity,
           CASE WHEN p_partkey % 4 = 0 THEN 0.0 ELSE CAST(p_partkey % 10 AS DOUBLE) END AS cvss_score
    FROM part
""")
def redhat_advisories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packages of the major release only, each once for a CVE."""
    k = F.col("p_partkey")
    built = F.array(_text("lib-", F.col("p_size"), "-1.2-3.el9"), _text("lib-", F.col("p_size"), "-1.2-4.el9_1"), F.lit("other-1-1.el8"))
    rows = table(spark, sf_dir, "part").select(
        _text("CVE-", k).alias("CVE"), _pick(("critical", "Important", "moderate", "low", "none", "odd"), k).alias("severity"),
        F.when(k % 4 == 0, "n/a").otherwise((k % 10).cast("string")).alias("cvss3_score"), F.lit("d").alias("bugzilla_description"), built.alias("affected_packages"),
    )
    return vulnerabilities.redhat_cves(rows, "9").select("id", "package", "severity", "cvss_score")


# Image configurations and references


@query("""
    WITH c AS (SELECT c_custkey AS k FROM customer)
    SELECT k AS c_custkey, id, detail FROM (
        SELECT k, 'IMG_ROOT_USER' AS id, '' AS detail FROM c WHERE k % 3 < 2 UNION ALL SELECT k, 'IMG_NO_HEALTHCHECK', '' FROM c WHERE k % 4 > 0
        UNION ALL SELECT k, 'IMG_SECRET_IN_ENV', 'DB_PASSWORD, apiKey' FROM c WHERE k % 5 = 0 UNION ALL SELECT k, 'IMG_PRIVILEGED_PORT', k % 1500 || '/tcp' FROM c WHERE k % 1500 < 1024
        UNION ALL SELECT k, 'IMG_NO_MAINTAINER', '' FROM c WHERE k % 7 > 1)
""")
def image_config_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    label = _pick(('{"maintainer":"m"}', '{"org.opencontainers.image.authors":"a"}', "{}", "null", '{"x":"y"}', "{}", "{}"), k)
    doc = _text(
        '{"config":{"User":"', _pick(("", "root", "app"), k), '","Env":["PATH=/bin"', F.when(k % 5 == 0, ',"DB_PASSWORD=x","apiKey=y"').otherwise(""), '],"ExposedPorts":{"', k % 1500,
        '/tcp":{},"9000/tcp":{}},"Labels":', label, ',"Healthcheck":', _pick(('{"Test":["CMD"]}', "null", "{}", "null"), k), "}}",
    )
    found = image.config_findings(table(spark, sf_dir, "customer").select(k.cast("string").alias("image"), F.parse_json(doc).alias("config")))
    return found.select(F.col("image").cast("long").alias("c_custkey"), "id", "detail")


@query("""
    SELECT c_custkey, ['registry-1.docker.io', 'registry-1.docker.io', 'ghcr.io', 'localhost', 'host:5000', 'registry-1.docker.io'][c_custkey % 6 + 1] AS registry,
           ['library/app' || c_custkey, 'me/app' || c_custkey, 'me/app' || c_custkey, 'app' || c_custkey, 'a/b/app' || c_custkey, 'library/app' || c_custkey][c_custkey % 6 + 1] AS repository,
           ['latest', '1.' || c_custkey, 'latest', 'latest', 'v2', ''][c_custkey % 6 + 1] AS tag, CASE WHEN c_custkey % 6 = 5 THEN 'sha256:abc' ELSE '' END AS digest
    FROM customer
""")
def image_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    raw = F.element_at(
        F.array(
            _text("app", k), _text("me/app", k, ":1.", k), _text("ghcr.io/me/app", k), _text("localhost/app", k), _text("host:5000/a/b/app", k, ":v2"), _text("docker.io/library/app", k, "@sha256:abc")
        ),
        (k % 6 + 1).cast("int"),
    )
    return table(spark, sf_dir, "customer").select("c_custkey", image.reference(raw).alias("r")).select("c_custkey", "r.*")


@query("""
    SELECT c_custkey, 'PATH=/bin;' || ['API_KEY', 'user', 'MyToken', 'HOME'][c_custkey % 4 + 1] || '=' || CASE WHEN c_custkey % 2 = 0 THEN '***' ELSE c_name END AS env FROM customer
""")
def image_env_redaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    env = F.array(F.lit("PATH=/bin"), _text(_pick(("API_KEY", "user", "MyToken", "HOME"), F.col("c_custkey")), "=", F.col("c_name")))
    return table(spark, sf_dir, "customer").select("c_custkey", F.array_join(image.redacted_env(env), ";").alias("env"))


@query("""
    WITH n AS (SELECT o_custkey % 50 AS image, o_orderkey % 7 AS k FROM orders WHERE o_custkey % 50 <> 3)
    SELECT i.image, count(*) FILTER (k = 0) AS os_packages, count(*) FILTER (k = 1) AS os_vulnerabilities, count(*) FILTER (k IN (2, 6)) AS app_dependencies,
           count(*) FILTER (k = 3) AS app_vulnerabilities, count(*) FILTER (k = 4) AS secrets, count(*) FILTER (k = 5) AS misconfigs, count(*) FILTER (k IN (1, 3)) AS total_vulnerabilities
    FROM (SELECT DISTINCT o_custkey % 50 AS image FROM orders) i LEFT JOIN n USING (image) GROUP BY i.image
""")
def image_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The seven counts of each image; one image has nothing but its row."""
    orders = table(spark, sf_dir, "orders").withColumn("image", F.col("o_custkey") % 50)
    kinds = ("os_packages", "os_vulnerabilities", "app_dependencies", "app_vulnerabilities", "secrets", "misconfigs", "app_dependencies")
    kind = _pick(kinds, F.col("o_orderkey"))
    return image.summary(orders.where("image <> 3").select("image", kind.alias("kind")), orders)


@query("""
    SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 2 THEN 'd2' WHEN s_suppkey % 3 = 1 THEN 'd0' ELSE 'd1' END AS digest FROM supplier
""")
def image_platforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact platform, else the first of the same OS."""
    k = F.col("s_suppkey")
    entries = F.array(
        F.struct(F.lit("linux").alias("os"), F.when(k % 3 == 0, "arm64").otherwise("arm").alias("arch"), F.lit("d0").alias("digest")),
        F.struct(F.when(k % 3 == 0, "linux").otherwise("windows").alias("os"), F.lit("amd64").alias("arch"), F.lit("d1").alias("digest")),
        F.struct(F.lit("linux").alias("os"), F.when(k % 3 == 2, "amd64").otherwise("s390x").alias("arch"), F.lit("d2").alias("digest")),
    )
    rows = table(spark, sf_dir, "supplier").select(k.alias("image"), F.posexplode(entries).alias("ord", "m")).select("image", "ord", "m.*")
    return image.pick_platform(rows).withColumnRenamed("image", "s_suppkey")


# Infrastructure as code


def _documents(rows: DataFrame, source: Column, doc: Column, doc_no: Column | None = None) -> DataFrame:
    return rows.select(source.alias("source_file"), (F.lit(0) if doc_no is None else doc_no.cast("int")).alias("doc_no"), F.parse_json(doc).alias("doc"))


@query("""
    SELECT s_suppkey, 'R' || i AS address,
           ['aws_s3_bucket', 'aws_instance', 'aws_apigateway_rest_api', 'aws_kms_key', 'custom_thing', 'aws_rds_db_cluster', 'aws_internet_gateway', 'aws_ecs_service', 'aws_ecs_task_definition', 'aws_eks_cluster',
            'aws_wafv2_web_acl', 'alexa_skill'][i + 1] AS resource_type,
           CASE WHEN i = 1 THEN 'R0' WHEN i = 2 THEN 'R0,R1' ELSE '' END AS dependencies, CASE WHEN i = 0 THEN s_name END AS bucket
    FROM supplier, range(12) r(i)
""")
def cloudformation_resources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types by name and by rule; DependsOn as a name and as a list."""
    kinds = ("KMS::Key", "Custom::Thing", "RDS::DBCluster", "EC2::InternetGateway", "ECS::Service", "ECS::TaskDefinition", "EKS::Cluster", "WAFv2::WebACL", "Alexa::Skill")
    more = "".join(f',"R{i}":{{"Type":"{"" if k[0] in "CA" else "AWS::"}{k}"}}' for i, k in enumerate(kinds, 3))
    k = F.col("s_suppkey")
    doc = _text(
        '{"AWSTemplateFormatVersion":"2010-09-09","Resources":{"R0":{"Type":"AWS::S3::Bucket","Properties":{"BucketName":"', F.col("s_name"), '"}},"R1":{"Type":"AWS::EC2::Instance","DependsOn":"R0"},'
        '"R2":{"Type":"AWS::ApiGateway::RestApi","DependsOn":["R0","R1"]}', more, "}}",
    )
    found = iac.cloudformation(_documents(table(spark, sf_dir, "supplier"), k.cast("string"), doc).where(files.is_cloudformation(F.lit("t.json"))))
    bucket = F.try_variant_get("properties", "$.BucketName", "string")
    return found.select(F.col("source_file").cast("long").alias("s_suppkey"), "address", "resource_type", F.array_join("dependencies", ",").alias("dependencies"), bucket.alias("bucket"))


@query("""
    SELECT c_custkey, has AND p AS privileged, NOT (has AND q) AS run_as_root, NOT has OR r AS has_resource_limits, has AND latest AS uses_latest_tag, host AS host_network,
           CASE WHEN has AND c_custkey % 4 = 0 THEN 'SYS_ADMIN' ELSE '' END AS dangerous, CASE WHEN has AND c_custkey % 7 = 0 THEN 'TOKEN' ELSE '' END AS secret_env, true AS writable_root_fs
    FROM (SELECT c_custkey, c_custkey % 2 = 0 AS p, c_custkey % 3 = 0 AS q, c_custkey % 5 = 0 AS r, c_custkey % 11 <> 3 AS latest, c_custkey % 13 = 0 AS host, c_custkey % 17 > 0 AS has FROM customer)
""")
def kubernetes_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flags over a container and an init container of Deployments and CronJobs; some have no containers at all."""
    k = F.col("c_custkey")
    yes = lambda c: F.when(c, "true").otherwise("false")
    first = _text(
        '{"name":"a","image":"x:1","resources":{"limits":{"cpu":1}},"securityContext":{"privileged":', yes(k % 2 == 0), ',"capabilities":{"add":["', F.when(k % 4 == 0, "SYS_ADMIN").otherwise("CHOWN"), '"]}}}'
    )
    second = _text(
        '{"name":"b","image":"', F.when(k % 11 == 3, "y:2").when(k % 11 < 3, "y").otherwise("y:latest"), '","resources":', F.when(k % 5 == 0, '{"limits":{"memory":"1Gi"}}').otherwise("{}"),
        ',"securityContext":{"runAsNonRoot":', yes(k % 3 == 0), '},"env":[{"name":"TOKEN"', F.when(k % 7 == 0, ',"valueFrom":{"secretKeyRef":{"name":"s"}}').otherwise(',"value":"v"'), "}]}",
    )
    some = F.when(k % 17 > 0, _text(first, '],"initContainers":[', second)).otherwise("")
    pod = _text('{"hostNetwork":', yes(k % 13 == 0), ',"containers":[', some, "]}")
    spec = F.when(k % 2 == 0, _text('{"template":{"spec":', pod, "}}")).otherwise(_text('{"jobTemplate":{"spec":{"template":{"spec":', pod, "}}}}"))
    doc = _text('{"apiVersion":"v1","kind":"', F.when(k % 2 == 0, "Deployment").otherwise("CronJob"), '","metadata":{"name":"n"},"spec":', spec, "}")
    found = iac.kubernetes(_documents(table(spark, sf_dir, "customer"), k.cast("string"), doc))
    flag = lambda n: F.try_variant_get("properties", f"$.{n}", "boolean").alias(n)
    names = lambda n: F.array_join(F.try_variant_get("properties", f"$.{n}", "array<string>"), ",")
    return found.select(
        F.col("source_file").cast("long").alias("c_custkey"), flag("privileged"), flag("run_as_root"), flag("has_resource_limits"), flag("uses_latest_tag"), flag("host_network"),
        names("dangerous_capabilities").alias("dangerous"), names("secret_env_vars").alias("secret_env"), flag("writable_root_fs"),
    )


@query("""
    SELECT c_custkey, ['kubernetes_cluster_role', 'kubernetes_role_binding', 'kubernetes_service', 'kubernetes_network_policy', 'kubernetes_namespace'][c_custkey % 5 + 1] AS resource_type,
           ['*', 'admin', 'NodePort', 'Egress', ''][c_custkey % 5 + 1] AS told
    FROM customer
""")
def kubernetes_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What roles, bindings, services and policies tell of themselves."""
    k = F.col("c_custkey")
    body = _pick(
        (
            '"ClusterRole","rules":[{"verbs":["get"],"resources":["pods"]},{"verbs":["*"],"resources":["*"]}]', '"RoleBinding","roleRef":{"name":"admin","kind":"Role"}',
            '"Service","spec":{"type":"NodePort"}', '"NetworkPolicy","spec":{"policyTypes":["Egress"],"egress":[{}]}', '"Namespace"',
        ), k,
    )
    found = iac.kubernetes(_documents(table(spark, sf_dir, "customer"), k.cast("string"), _text('{"apiVersion":"v1","metadata":{"name":"n"},"kind":', body, "}")))
    get = lambda p, t="string": F.try_variant_get("properties", p, t)
    told = (
        F.when(get("$.has_wildcard_verbs", "boolean") & get("$.has_wildcard_resources", "boolean"), "*").when(get("$.role_ref_name").isNotNull(), get("$.role_ref_name"))
        .when(get("$.service_type").isNotNull(), get("$.service_type")).when(get("$.has_egress_rules", "boolean") & ~get("$.has_ingress_rules", "boolean"), get("$.policy_types[0]")).otherwise("")
    )
    return found.select(F.col("source_file").cast("long").alias("c_custkey"), "resource_type", told.alias("told"))


@query("""
    SELECT p_partkey, p_partkey % 2 = 0 AS has_user, p_partkey % 3 > 0 AS uses_latest_tag, p_partkey % 5 = 0 AS has_ssh_exposed, p_partkey % 2 = 0 AND p_partkey % 4 = 0 AS is_root_user,
           p_partkey % 7 = 0 AS has_healthcheck, ['img', 'img:1', 'img'][CASE p_partkey % 3 WHEN 0 THEN 2 ELSE 1 END] AS base_image, CAST(6 + p_partkey % 2 AS BIGINT) AS n_instructions, 1 AS n_secret
    FROM part
""")
def dockerfile_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The summary of each file, and its instructions: continued lines are one, comments none."""
    k = F.col("p_partkey")
    text = _text(
        "# a comment\nFROM ", F.when(k % 3 == 0, "img:1").otherwise("img"), "\nENV API_TOKEN=x\nRUN apt-get update && \\\n   apt-get install -y curl\nEXPOSE ", F.when(k % 5 == 0, "22/tcp").otherwise("8080"),
        "\nHEALTHCHECK ", F.when(k % 7 == 0, "CMD x").otherwise("NONE"), F.when(k % 4 == 0, "\nUSER root").when(k % 2 == 0, "\nUSER app").otherwise("\n\nCOPY . /app"), F.when(k % 2 == 1, "\nWORKDIR /app").otherwise(""), "\n",
    )
    # A part is a few bytes in its table and a file here: keys are dealt out before they become texts, and files stay where they are.
    keys = table(spark, sf_dir, "part").select("p_partkey", k.cast("string").alias("source_file"))
    keys = keys.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "source_file")
    found = iac.dockerfile(keys.select("source_file", text.alias("text")))
    get = lambda n, t="boolean": F.try_variant_get("properties", f"$.{n}", t)
    whole = F.col("resource_type") == "dockerfile_image"
    facts = [F.max(F.when(whole, get(n))).alias(n) for n in ("has_user", "uses_latest_tag", "has_ssh_exposed", "is_root_user", "has_healthcheck")]
    told = found.groupBy("source_file").agg(
        *facts, F.max(F.when(whole, get("base_image", "string"))).alias("base_image"), F.count_if(~whole).alias("n_instructions"),
        F.count_if(~whole & get("has_secret_pattern")).cast("int").alias("n_secret"),
    )
    return told.select(F.col("source_file").cast("long").alias("p_partkey"), *told.columns[1:])


@query("""
    SELECT s_suppkey, 'aws_instance.i' AS address, '' AS module, 'aws_vpc.v' AS dependencies, s_name AS told FROM supplier
    UNION ALL SELECT s_suppkey, 'module.m.aws_subnet.s', 'module.m', 'module.m.aws_vpc.w', CAST(s_suppkey AS VARCHAR) FROM supplier
    UNION ALL SELECT s_suppkey, 'module.m.module.d.aws_db_instance.b', 'module.m.module.d', '', '' FROM supplier
""")
def terraform_plan_resources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested modules; references count without a prefix, explicit dependencies with their module's, variables not at all."""
    k = F.col("s_suppkey")
    doc = _text(
        '{"format_version":"1.0","planned_values":{"root_module":{"resources":[{"address":"aws_instance.i","type":"aws_instance","name":"i","provider_name":"aws","values":{"told":"', F.col("s_name"),
        '"}}],"child_modules":[{"address":"module.m","resources":[{"address":"module.m.aws_subnet.s","type":"aws_subnet","name":"s","values":{"told":"', k,
        '"}}],"child_modules":[{"address":"module.m.module.d","resources":[{"address":"module.m.module.d.aws_db_instance.b","type":"aws_db_instance","name":"b","values":{}}]}]}]}},'
        '"configuration":{"root_module":{"resources":[{"type":"aws_instance","name":"i","expressions":{"x":{"references":["aws_vpc.v","var.y"]}}}],'
        '"module_calls":{"m":{"module":{"resources":[{"type":"aws_subnet","name":"s","depends_on":["aws_vpc.w"]}]}}}}}}',
    )
    found = iac.terraform_plan(_documents(table(spark, sf_dir, "supplier"), k.cast("string"), doc))
    told = F.coalesce(F.try_variant_get("properties", "$.told", "string"), F.lit(""))
    return found.select(F.col("source_file").cast("long").alias("s_suppkey"), "address", "module", F.array_join("dependencies", ",").alias("dependencies"), told.alias("told"))


@query("""
    SELECT s_suppkey, 'aws_s3_bucket.b' || s_suppkey AS address, 'hashicorp/aws' AS provider, s_suppkey % 2 = 0 AS versioned FROM supplier
    UNION ALL SELECT s_suppkey, 'random_id.r', 'random', NULL FROM supplier
""")
def hcl_resources(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    text = _text(
        '# c\nvariable "v" {\n  default = "x"\n}\nresource "aws_s3_bucket" "b', k, '" {\n  tags = { a = "b", c = 3 }\n  versioning {\n    enabled = ', F.when(k % 2 == 0, "true").otherwise("false"),
        '\n  }\n}\n\nresource "random_id" "r" {\n  byte_length = max(1, 2)\n}\n',
    )
    found = iac.terraform_hcl(table(spark, sf_dir, "supplier").select(k.cast("string").alias("source_file"), text.alias("text")))
    enabled = F.try_variant_get("properties", "$.versioning[0].enabled", "boolean")
    return found.select(F.col("source_file").cast("long").alias("s_suppkey"), "address", "provider", enabled.alias("versioned"))


@query("""
    SELECT s_suppkey, 'kubernetes_deployment.default.web' || s_suppkey AS address, s_suppkey % 2 = 0 AS privileged FROM supplier
""")
def helm_resources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Templates without the template language."""
    k = F.col("s_suppkey")
    text = _text(
        "{{- /* a comment */ -}}\n{{- if .Values.on }}\napiVersion: apps/v1\nkind: Deployment\nmetadata:\n  name: web", k, "\n  labels: {}\nspec:\n  template:\n    spec:\n      containers:\n"
        '      - name: {{ .Chart.Name }}\n        image: "x:1"\n        securityContext:\n          privileged: ', F.when(k % 2 == 0, "true").otherwise("false"), "\n{{- end }}\n",
    )
    rows = table(spark, sf_dir, "supplier").select(_text("c", k, "/templates/dep.yaml").alias("source_file"), text.alias("text"))
    found = iac.helm(rows)
    return found.select(F.regexp_extract("source_file", r"^c(\d+)/", 1).cast("long").alias("s_suppkey"), "address", F.try_variant_get("properties", "$.privileged", "boolean").alias("privileged"))


@query("""
    SELECT s_suppkey, l AS lockfile, name, version, ecosystem FROM (
        SELECT s_suppkey, 'requirements.txt' AS l, 'pkg' || s_suppkey AS name, '1.' || s_suppkey AS version, 'pypi' AS ecosystem FROM supplier
        UNION ALL SELECT s_suppkey, 'go.sum', 'github.com/x/m' || s_suppkey, '1.2.' || s_suppkey, 'go' FROM supplier
        UNION ALL SELECT s_suppkey, 'package-lock.json', 'a' || s_suppkey, '2.0.0', 'npm' FROM supplier UNION ALL SELECT s_suppkey, 'package-lock.json', '@s/b', '3.' || s_suppkey, 'npm' FROM supplier
        UNION ALL SELECT s_suppkey, 'Cargo.lock', 'serde', '1.0.' || s_suppkey, 'crates.io' FROM supplier UNION ALL SELECT s_suppkey, 'yarn.lock', 'lodash', '4.' || s_suppkey, 'npm' FROM supplier
        UNION ALL SELECT s_suppkey, 'Gemfile.lock', 'rails', '6.' || s_suppkey, 'rubygems' FROM supplier UNION ALL SELECT s_suppkey, 'pubspec.lock', 'http', '0.' || s_suppkey, 'pub' FROM supplier
        UNION ALL SELECT s_suppkey, 'composer.lock', 'a/b', '5.' || s_suppkey, 'packagist' FROM supplier UNION ALL SELECT s_suppkey, 'Pipfile.lock', 'flask', '2.' || s_suppkey, 'pypi' FROM supplier
        UNION ALL SELECT s_suppkey, 'pnpm-lock.yaml', 'left', '7.' || s_suppkey || '.0', 'npm' FROM supplier UNION ALL SELECT s_suppkey, 'mix.lock', 'jason', '1.' || s_suppkey, 'hex' FROM supplier
        UNION ALL SELECT s_suppkey, 'conan.lock', 'zlib', '1.2.' || s_suppkey, 'conan' FROM supplier UNION ALL SELECT s_suppkey, 'poetry.lock', 'click', '8.' || s_suppkey, 'pypi' FROM supplier)
""")
def lockfile_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A lock file of every kind for each supplier."""
    k = F.col("s_suppkey")
    made = {
        "requirements.txt": _text("# c\npkg", k, "==1.", k, "\nplain\n"), "go.sum": _text("github.com/x/m", k, " v1.2.", k, " h1:a=\ngithub.com/x/m", k, " v1.2.", k, "/go.mod h1:b=\n"),
        "package-lock.json": _text('{"lockfileVersion":3,"packages":{"":{"name":"me"},"node_modules/a', k, '":{"version":"2.0.0"},"node_modules/x/node_modules/@s/b":{"version":"3.', k, '"}}}'),
        "Cargo.lock": _text('[[package]]\nname = "serde"\nversion = "1.0.', k, '"\n'), "yarn.lock": _text('lodash@^4.0.0:\n  version "4.', k, '"\n'),
        "Gemfile.lock": _text("GEM\n  specs:\n    rails (6.", k, ")\n      actionpack (= 6.1.0)\n"), "pubspec.lock": _text("packages:\n  http:\n    version: '0.", k, "'\n"),
        "composer.lock": _text('{"packages":[{"name":"a/b","version":"v5.', k, '"}]}'), "Pipfile.lock": _text('{"default":{"flask":{"version":"==2.', k, '"}}}'),
        "pnpm-lock.yaml": _text("packages:\n  /left@7.", k, ".0:\n    dev: true\n"), "mix.lock": _text('%{\n  "jason": {:hex, :jason, "1.', k, '", "abc"},\n}\n'),
        "conan.lock": _text('{"requires":["zlib/1.2.', k, '"]}'), "poetry.lock": _text('[[package]]\nname = "click"\nversion = "8.', k, '"\n'),
    }
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("n"), t.alias("text")) for n, t in made.items()])).alias("f")
    rows = table(spark, sf_dir, "supplier").select(k.cast("string").alias("k"), each).select(F.concat_ws("/", "k", "f.n").alias("source_file"), "f.text")
    found = lockfiles.dependencies(rows)
    return found.select(F.substring_index("source_file", "/", 1).cast("long").alias("s_suppkey"), F.substring_index("source_file", "/", -1).alias("lockfile"), "name", "version", "ecosystem")


# Graph


@query("""
    WITH e AS (SELECT 'aws_instance.' || s_suppkey AS s, 'aws_subnet.' || s_nationkey AS t FROM supplier
               UNION ALL SELECT 'aws_db_instance.' || c_custkey, 'aws_subnet.' || c_nationkey FROM customer)
    SELECT s AS id, 'to' AS side FROM e WHERE t = 'aws_subnet.3' UNION ALL SELECT 'aws_subnet.' || s_nationkey, 'from' FROM supplier WHERE s_suppkey = 5
""")
def graph_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    resources = _infra(spark, sf_dir)
    edges = graph.edges(resources, graph.nodes(resources)).where("edge_type = 'containment'")
    into = graph.edges_of(edges, "aws_subnet.3").where("target = 'aws_subnet.3'").select(F.col("source").alias("id"), F.lit("to").alias("side"))
    return into.unionByName(graph.neighbours(edges, "aws_instance.5").select("id", F.lit("from").alias("side")))


@query("""
    SELECT trust_zone, count(*) AS n_nodes FROM (SELECT 'private' AS trust_zone FROM nation UNION ALL SELECT CASE WHEN s_acctbal < 0 THEN 'dmz' ELSE 'private' END FROM supplier
        UNION ALL SELECT 'private' FROM customer) GROUP BY 1
""")
def zone_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.zone_counts(graph.nodes(_infra(spark, sf_dir))).select("trust_zone", "n_nodes")


def _network(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as roles and security groups, suppliers as instance profiles, instances and load balancers that refer to them."""
    empty = F.array().cast("array<string>")

    def rows(name: str, key: str, kind: str, props: Column, ord_: Column) -> DataFrame:
        k = F.col(key).cast("string")
        return table(spark, sf_dir, name).select(
            F.lit("net").alias("source_file"), ord_.cast("int").alias("ord"), F.lit(kind).alias("resource_type"), _text(kind, ".", k).alias("address"), _text(kind, "-", k).alias("name"),
            F.lit("aws").alias("provider"), F.parse_json(props).alias("properties"), empty.alias("dependencies"), F.lit("").alias("module"), F.lit("").alias("source_location"),
        )

    n, s = F.col("n_nationkey"), F.col("s_suppkey")
    parts = [
        rows("nation", "n_nationkey", "aws_iam_role", F.lit("{}"), n), rows("nation", "n_nationkey", "aws_security_group", F.lit("{}"), 100 + n),
        rows("nation", "n_nationkey", "aws_vpc", F.lit("{}"), 200 + n),
        rows("supplier", "s_suppkey", "aws_iam_instance_profile", _text('{"role":"', F.when(s % 2 == 0, "aws_iam_role-").otherwise(""), F.col("s_nationkey"), '"}'), 1_000 + s),
        rows("supplier", "s_suppkey", "aws_lb", _text('{"security_groups":["aws_security_group.', F.col("s_nationkey"), '","aws_security_group-0"],"vpc_id":"v"}'), 1_000_000 + s),
    ]
    return reduce(DataFrame.unionByName, parts)


@query("""
    SELECT 'aws_iam_instance_profile.' || s_suppkey AS source, 'aws_iam_role.' || s_nationkey AS target, 'iam_binding' AS edge_type FROM supplier
    UNION ALL SELECT DISTINCT 'aws_lb.' || s_suppkey, 'aws_security_group.' || g, 'network_flow' FROM (SELECT s_suppkey, s_nationkey AS g FROM supplier UNION ALL SELECT s_suppkey, 0 FROM supplier)
    UNION ALL SELECT 'aws_lb.' || s_suppkey, 'aws_vpc.0', 'containment' FROM supplier
""")
def network_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roles by address and by name, security groups by both, the first network of its type."""
    resources = _network(spark, sf_dir)
    return graph.edges(resources, graph.nodes(resources)).select("source", "target", "edge_type")


@query("""
    SELECT 'aws_lb.' || s_suppkey AS resource_address, t AS target, 'medium' AS severity
    FROM (SELECT s_suppkey, 'v' AS t FROM supplier UNION ALL SELECT s_suppkey, 'g' FROM (SELECT DISTINCT s_suppkey, g FROM (SELECT s_suppkey, s_nationkey AS g FROM supplier UNION ALL SELECT s_suppkey, 0 FROM supplier)))
""")
def boundary_threats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Load balancers lie in the DMZ, networks and groups don't; roles and profiles share a zone."""
    resources = _network(spark, sf_dir)
    nodes = graph.nodes(resources)
    found = graph.boundary_threats(graph.edges(resources, nodes), nodes)
    target = F.when(F.col("description").contains("aws_vpc"), "v").otherwise("g")
    return found.select("resource_address", target.alias("target"), "severity")


@query("""
    SELECT n_nationkey, n_threats, ['info', 'low', 'medium', 'high', 'critical'][worst + 1] AS max_severity, n_titles , array_to_string(titles, ',') AS titles FROM (
        SELECT n_nationkey, count(c_custkey) AS n_threats, max(c_custkey % 5) AS worst, least(5, count(c_custkey)) AS n_titles,
               coalesce(list(c_name ORDER BY c_custkey % 5 DESC, c_name) FILTER (c_name IS NOT NULL), [])[1:5] AS titles
        FROM nation LEFT JOIN (SELECT * FROM customer WHERE c_nationkey <> 7) ON c_nationkey = n_nationkey GROUP BY n_nationkey)
""")
def threats_of_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = table(spark, sf_dir, "nation").select(F.lit("g").alias("source_file"), F.col("n_nationkey").cast("string").alias("id"))
    threats = table(spark, sf_dir, "customer").select(
        F.lit("g").alias("source_file"), F.when(F.col("c_nationkey") == 7, "of no node").otherwise(F.col("c_nationkey").cast("string")).alias("resource_address"), (F.col("c_custkey") % 5).cast("int").alias("sev_rank"), F.col("c_name").alias("title")
    )
    found = graph.threat_counts(nodes, threats)
    return found.select(F.col("id").cast("int").alias("n_nationkey"), "n_threats", "max_severity", F.size("titles").cast("long").alias("n_titles"), F.array_join("titles", ",").alias("titles"))


@query("""
    SELECT n_nationkey, CASE WHEN n_nationkey IN (3, 4) THEN '1,2' WHEN n_nationkey IN (1, 2) THEN '1' WHEN n_nationkey = 5 THEN '2' ELSE '' END AS path_nos FROM nation
""")
def attack_path_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges n to n + 1; the paths run up from 1 to 5 and down from 6 to 3."""
    k = F.col("n_nationkey")
    edges = table(spark, sf_dir, "nation").select("n_nationkey", F.lit("g").alias("source_file"), k.cast("string").alias("source"), (k + 1).cast("string").alias("target"))
    paths = spark.createDataFrame([("g", 1, ["1", "2", "3", "4", "5"]), ("g", 2, ["6", "5", "4", "3"])], "source_file string, path_no int, path array<string>")
    return graph.path_edges(edges, paths).select("n_nationkey", F.array_join("path_nos", ",").alias("path_nos"))


# Rules and reports


_LISTS = [
    (rules.Rule("LIST_HAS", "t", "", "tampering", "low", "", {"l": {"contains": 2}}), "k % 3 = 0"),
    (rules.Rule("TEXT_HAS", "t", "", "tampering", "low", "", {"s": {"contains": "ab"}}), "k % 2 = 0"),
    (rules.Rule("KEY_HAS", "t", "", "tampering", "low", "", {"d": {"contains": "x"}}), "k % 5 = 0"),
    (rules.Rule("LIST_HASNT", "t", "", "tampering", "low", "", {"l": {"not_contains": "2"}}), "true"),
    (rules.Rule("NESTED", "t", "", "tampering", "low", "", {"d.y.z": {"equals": "deep"}}), "k % 7 = 0"),
    (rules.Rule("PLACE", "t", "", "tampering", "low", "", {"l.1": {"equals": 9}}), "k % 3 > 0"),
    (rules.Rule("LAST", "t", "", "tampering", "low", "", {"l.-1": {"equals": 9}}), "k % 3 > 0"),
    (rules.Rule("LIST_IS", "t", "", "tampering", "low", "", {"l": [1, 2]}), "k % 3 = 0"),
    (rules.Rule("BOOL_IS", "t", "", "tampering", "low", "", {"b": True}), "k % 4 = 0"),
    (rules.Rule("BOOL_ONE", "t", "", "tampering", "low", "", {"b": 1}), "k % 4 = 0"),
    (rules.Rule("EMPTY", "t", "", "tampering", "low", "", {"s": {"is_empty": True}}), "k % 2 = 1"),
    (rules.Rule("NULL_IS", "t", "", "tampering", "low", "", {"n": {"not_exists": True}}), "true"),
]


@query("WITH e AS (SELECT event_id, event_id AS k FROM events) " + " UNION ALL ".join(f"SELECT event_id, '{r.id}' AS rule_id FROM e WHERE {sql}" for r, sql in _LISTS))
def rule_eval_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists, mappings, truth values, nested paths, places from either end."""
    k = F.col("event_id")
    doc = _text(
        '{"l":', F.when(k % 3 == 0, "[1,2]").otherwise("[1,9]"), ',"s":"', F.when(k % 2 == 0, "cabd").otherwise(""), '","n":null,"b":', F.when(k % 4 == 0, "true").otherwise("false"),
        ',"d":{"', F.when(k % 5 == 0, "x").otherwise("w"), '":1,"y":{"z":"', F.when(k % 7 == 0, "deep").otherwise("no"), '"}}}',
    )
    rows = table(spark, sf_dir, "events").select("event_id", "event_type", F.parse_json(doc).alias("properties"))
    return rules.matches(rows, [r for r, _ in _LISTS], "event_type").select("event_id", "rule_id")


def _tree(depth: int, leaf: dict) -> dict:
    return leaf if depth == 0 else {"all_of": [_tree(depth - 1, leaf)]}


@query("SELECT event_id, 'DEEP' AS rule_id FROM events WHERE event_id % 2 = 0")
def rule_depth_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A condition at the greatest depth counts; one beyond it is false."""
    made = [rules.Rule(i, "t", "", "tampering", "low", "", _tree(d, {"k": 0})) for i, d in (("DEEP", rules.MAX_DEPTH), ("TOO_DEEP", rules.MAX_DEPTH + 1))]
    rows = table(spark, sf_dir, "events").select("event_id", "event_type", F.to_variant_object(F.struct((F.col("event_id") % 2).alias("k"))).alias("properties"))
    return rules.matches(rows, made, "event_type").select("event_id", "rule_id")


@query(f"""
    SELECT finding_type, severity, count(*) AS n FROM (SELECT ['vulnerability', 'secret', 'license'][event_id % 3 + 1] AS finding_type, {_SEVERITY_SQL} AS severity FROM events) GROUP BY ALL
""")
def finding_type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.type_counts(_threats(spark, sf_dir).withColumn("finding_type", _pick(("vulnerability", "secret", "license"), F.col("event_id"))))


@query(f"""
    SELECT event_type AS source_file, count(*) AS total, count(*) FILTER (event_id % 5 = 4) AS critical, count(*) FILTER (event_id % 5 = 3) AS high,
           count(*) FILTER (event_id % 5 = 2) AS medium, count(*) FILTER (event_id % 5 = 1) AS low, count(*) FILTER (event_id % 5 = 0) AS info,
           array_to_string(list_sort(list(DISTINCT {_STRIDE_SQL})), ',') AS stride
    FROM events GROUP BY 1
""")
def severity_bar(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = reports.severity_bar(_threats(spark, sf_dir).withColumn("source_file", F.col("event_type")))
    return found.withColumn("stride", F.array_join("stride_categories", ",")).drop("stride_categories")


@query("""
    SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'vulnerability' WHEN 1 THEN 'secret' ELSE 'misconfig' END AS finding_type FROM events
    WHERE NOT (event_id % 3 = 0 AND event_id % 7 = 0) AND NOT (event_id % 3 = 1 AND event_id % 11 = 0) AND NOT (event_id % 3 = 2 AND event_id = 5)
""")
def suppression_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vulnerabilities are named by vuln_id, secrets by rule_id, others by id; an entry that has expired names nothing."""
    k = F.col("event_id")
    rows = table(spark, sf_dir, "events").select(
        "event_id", _pick(("vulnerability", "secret", "misconfig"), k).alias("finding_type"), k.cast("string").alias("id"), _text("V", k % 7).alias("vuln_id"), _text("R", k % 11).alias("rule_id")
    )
    entries = [("V0", None), ("R0", "2024-02-01"), ("5", None), ("V1", "2024-01-31")]
    ignores = spark.createDataFrame(entries, "ignore_id string, d string").select("ignore_id", F.to_date("d").alias("expires"))
    return reports.suppress_all(rows, ignores, F.lit("2024-02-01").cast("date"))[0].select("event_id", "finding_type")


@query("""
    SELECT 'vulnerability' AS finding_type, count(*) AS n FROM events WHERE event_id % 3 = 0 AND event_id % 7 = 0 UNION ALL SELECT 'secret', count(*) FROM events WHERE event_id % 3 = 1 AND event_id % 11 = 0
""")
def suppressed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    rows = table(spark, sf_dir, "events").select(_pick(("vulnerability", "secret", "misconfig"), k).alias("finding_type"), k.cast("string").alias("id"), _text("V", k % 7).alias("vuln_id"), _text("R", k % 11).alias("rule_id"))
    ignores = spark.createDataFrame([("V0",), ("R0",)], "ignore_id string").withColumn("expires", F.lit(None).cast("date"))
    return reports.suppress_all(rows, ignores)[1]


@query("""
    SELECT 'orders' AS scanner, o_orderpriority AS severity, count(*) AS n, count(DISTINCT o_orderkey) AS n_ids FROM orders GROUP BY ALL
    UNION ALL SELECT 'parts', p_brand, count(*), count(DISTINCT p_partkey) FROM part GROUP BY ALL
""")
def combined_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("severity"), F.col("o_orderkey").alias("id"))
    parts = table(spark, sf_dir, "part").select(F.col("p_brand").alias("severity"), F.col("p_partkey").alias("id"), "p_name")
    found = reports.combined(orders=orders, parts=parts)
    return found.groupBy("scanner", "severity").agg(F.count("*").alias("n"), F.count_distinct(F.get_json_object("finding", "$.id")).alias("n_ids"))


@query("""
    SELECT o_custkey AS id, CASE o_custkey % 3 WHEN 0 THEN 'spoofing' WHEN 1 THEN 'information_disclosure' ELSE 'information_disclosure' END AS stride_category,
           least(1.0, greatest(0.0, o_custkey % 5 / 2.0 - 0.5)) AS confidence
    FROM (SELECT DISTINCT o_custkey FROM orders)
""")
def threat_normalisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_custkey")
    rows = table(spark, sf_dir, "orders").select("o_custkey").distinct().select(
        k.alias("id"), _pick(("spoofing", "odd", "information_disclosure"), k).alias("stride_category"), (k % 5 / 2.0 - 0.5).alias("confidence")
    )
    return reports.normalised_threats(rows).select("id", "stride_category", "confidence")


@query("""
    WITH t AS (SELECT event_id, 'RULE_' || event_id % 9 AS rule_id FROM events),
         r AS (SELECT rule_id, row_number() OVER (ORDER BY min(event_id)) - 1 AS rule_index FROM t GROUP BY 1)
    SELECT event_id, CASE event_id % 5 WHEN 4 THEN 'error' WHEN 3 THEN 'error' WHEN 2 THEN 'warning' ELSE 'note' END AS level, rule_id, rule_index, '/ab/../' || event_id || '@x:1' AS uri
    FROM t JOIN r USING (rule_id)
""")
def sarif_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The results of a SARIF document, read from its lines."""
    rows = _sarif_threats(spark, sf_dir)
    lines = formats.sarif(rows, ("event_id",)).where("section = 3")
    j = lambda p: F.get_json_object(F.ltrim(F.col("line"), F.lit(",")), p)
    return lines.select(
        F.col("n").alias("event_id"), j("$.level").alias("level"), j("$.ruleId").alias("rule_id"), j("$.ruleIndex").cast("long").alias("rule_index"),
        j("$.locations[0].physicalLocation.artifactLocation.uri").alias("uri"),
    )


def _sarif_threats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _threats(spark, sf_dir).withColumns({
        "rule_id": _text("RULE_", F.col("event_id") % 9), "resource_address": _text("/a b/../é", F.col("event_id"), "@x:1"), "description": F.lit(" said "), "source": F.lit("rule"),
        "confidence": F.lit(1.0), "resource_type": F.lit("thing"), "mitigation": F.when(F.col("event_id") % 2 == 0, "mend it").otherwise(""), "title": _text("a-title_of ", "rule", F.col("event_id")),
    })


@query("""
    WITH f AS (SELECT 'RULE_' || event_id % 9 AS rule_id, min(event_id) AS e FROM events GROUP BY 1)
    SELECT rule_id, row_number() OVER (ORDER BY e) - 1 AS rule_index, 'ATitleOfRule' || e AS name, CASE WHEN e % 2 = 0 THEN 'mend it' ELSE 'See description.' END AS help,
           'said' AS told, ['note', 'note', 'warning', 'error', 'error'][e % 5 + 1] AS level
    FROM f
""")
def sarif_document_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules of a SARIF document, each as its first threat describes it."""
    lines = formats.sarif(_sarif_threats(spark, sf_dir), ("event_id",)).where("section = 1")
    j = lambda p: F.get_json_object(F.ltrim(F.col("line"), F.lit(",")), p)
    return lines.select(
        j("$.id").alias("rule_id"), F.col("n").alias("rule_index"), j("$.name").alias("name"), j("$.help.text").alias("help"), j("$.fullDescription.text").alias("told"),
        j("$.defaultConfiguration.level").alias("level"),
    )


@query("""
    SELECT event_id, CASE event_id % 5 WHEN 4 THEN 'CRITICAL' WHEN 3 THEN 'HIGH' WHEN 2 THEN 'MEDIUM' ELSE 'LOW' END AS severity, rpad(event_type || ' ' || event_id, 450, '.') AS summary,
           'x' AS path, 1 AS line, 'said' AS details
    FROM events
""")
def bitbucket_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _threats(spark, sf_dir).withColumns({"title": F.rpad("title", 600, "."), "description": F.lit("  said "), "resource_address": F.lit("x")})
    lines = formats.bitbucket(rows, 5, ("event_id",)).where("section = 1")
    j = lambda p: F.get_json_object(F.ltrim(F.col("line"), F.lit(",")), p)
    return lines.select(j("$.external_id").cast("long").alias("event_id"), j("$.severity").alias("severity"), j("$.summary").alias("summary"), j("$.path").alias("path"), j("$.line").cast("int").alias("line"), j("$.details").alias("details"))


@query(r"""
    SELECT c_custkey, 'Ab' || c_custkey || 'CdEf.gh' AS pascal, 'a\<b\>\[c\]\(d\)\`' || c_custkey || '|\e' AS escaped, '/xy/../' || c_custkey || '@1:2' AS uri FROM customer
""")
def text_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        "c_custkey", formats.pascal_case(_text("ab", k, "-CD__ ef.gH")).alias("pascal"), formats.escape_markdown(_text("a<b>[c](d)`", k, "|\\e")).alias("escaped"),
        formats.artifact_uri(_text("/x y/../é", k, "@1:2")).alias("uri"),
    )


@query("""
    SELECT c_custkey, c_custkey % 3 = 0 AS hidden, c_custkey % 2 = 0 AS leaf FROM customer
""")
def nested_redaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sensitive key hides all below it, under the path's name; elsewhere patterns do."""
    k = F.col("c_custkey")
    doc = _text('{"', F.when(k % 3 == 0, "Tags").otherwise("note"), '":{"a":["deep"]},"text":"', F.when(k % 2 == 0, "from 10.0.0.1").otherwise("nothing"), '"}')
    out = secrets.redact_json(doc)
    return table(spark, sf_dir, "customer").select("c_custkey", out.contains("REDACTED_Tags.a[]_").alias("hidden"), out.contains("from REDACTED_ip_v4_").alias("leaf"))


@query("""
    SELECT p_partkey FROM part WHERE p_partkey % 4 IN (0, 3) AND p_partkey % 7 > 0
""")
def scannable_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Binary files, skipped folders and patterns, empty and too large files aren't scanned."""
    k = F.col("p_partkey")
    path = _text("f/", k, _pick((".py", ".min.js", ".lock", "/src/main.go"), k))
    content = F.when(k % 7 == 0, _pick(("", "ab\x00c", "x" * 101), k)).otherwise("some text")
    rows = table(spark, sf_dir, "part").select("p_partkey", path.alias("path"), F.encode(content, "UTF-8").alias("content"))
    return secrets.scannable(rows, max_bytes=100).select("p_partkey")


@query(f"""
    SELECT p_partkey, {_pick_sql(("lockfile", "chart", "iac", "iac", "other", "iac"), "p_partkey")} AS kind FROM part
""")
def file_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    path = _text("d/", k, "/", _pick(("go.sum", "Chart.yaml", "main.tf", "app.Dockerfile", "readme.md", "x.YML"), k))
    return table(spark, sf_dir, "part").select("p_partkey", files.kind_of_file(path).alias("kind"))


@query("SELECT count(*) AS entries FROM lineitem")
def advisory_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem")
    return vulnerabilities.status(vulnerabilities.union(line.where("l_linenumber < 3"), line.where("l_linenumber >= 3")))


@query(f"""
    SELECT event_id, array_to_string(list_sort(list_distinct(CASE event_id % 3 WHEN 0 THEN ['TA0006', 'TA0007'] WHEN 1 THEN ['TA0001', 'TA0003', 'TA0004', 'TA0005', 'TA0040'] ELSE [] END)), ',') AS tactics FROM events
""")
def technique_tactics(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    techniques = F.when(k % 3 == 0, F.array(F.lit("T1040"))).when(k % 3 == 1, F.array(F.lit("T1078"), F.lit("T1485"), F.lit("T9999"))).otherwise(F.array(F.lit("T0")))
    return table(spark, sf_dir, "events").select("event_id", F.array_join(dims.tactics_of(techniques), ",").alias("tactics"))


@query("""
    SELECT event_id, CASE event_id % 2 WHEN 0 THEN 'T1040: Network Sniffing, T9999' ELSE '-' END AS told FROM events
""")
def technique_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = F.when(F.col("event_id") % 2 == 0, F.array(F.lit("T1040"), F.lit("T9999"))).otherwise(F.array().cast("array<string>"))
    return table(spark, sf_dir, "events").select("event_id", formats.technique_text(ids).alias("told"))


@query("""
    SELECT p_partkey, 'dependency_npm' AS resource_type, 'npm/' || p_brand || '@' || p_size AS address, 'pkg:npm/' || p_brand || '@' || p_size AS purl FROM part
""")
def dependency_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dependencies as resources, told from other resources by their type, and as components."""
    deps = table(spark, sf_dir, "part").select(
        F.col("p_partkey").cast("string").alias("source_file"), F.lit(0).alias("ord"), F.col("p_brand").alias("name"), F.col("p_size").cast("string").alias("version"), F.lit("npm").alias("ecosystem"), F.lit("MIT").alias("license")
    )
    made = lockfiles.selected(lockfiles.as_resources(deps).unionByName(lockfiles.as_resources(deps).withColumn("resource_type", F.lit("aws_vpc"))))
    parts = formats.components(deps).select("source_file", F.get_json_object("component", "$.purl").alias("purl"))
    return made.join(parts, "source_file").select(F.col("source_file").cast("long").alias("p_partkey"), "resource_type", "address", "purl")


@query("""
    SELECT p_partkey, 'pkg-' || p_partkey AS name, p_size || '.0' AS version, 'pypi' AS ecosystem, false AS broken FROM part WHERE p_partkey % 3 = 0
    UNION ALL SELECT p_partkey, '@s/x', '1.' || p_size, 'npm', false FROM part WHERE p_partkey % 3 = 1
    UNION ALL SELECT p_partkey, NULL, NULL, NULL, true FROM part WHERE p_partkey % 3 = 2
""")
def lockfiles_in_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lock files through a registered reader, from SQL."""
    k = F.col("p_partkey")
    path = _pick(("a/requirements.txt", "b/package-lock.json", "c/package-lock.json"), k)
    npm = _text('{"lockfileVersion":3,"packages":{"node_modules/@s/x":{"version":"1.', F.col("p_size"), '"}}}')
    text = F.when(k % 3 == 0, _text("pkg-", k, "==", F.col("p_size"), ".0\n")).when(k % 3 == 1, npm).otherwise("{")
    readers.register_lockfiles(spark)
    rows = table(spark, sf_dir, "part").select("p_partkey", path.alias("source_file"), text.alias("text"))
    return spark.sql("SELECT p_partkey, r.name, r.version, r.ecosystem, r.error IS NOT NULL AS broken FROM {rows}, LATERAL read_lockfile(source_file, text) r", rows=rows)


@query("""
    WITH RECURSIVE n AS (SELECT s_suppkey AS id, lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS name, count(*) OVER () AS total FROM supplier),
    e AS (SELECT id AS a, (id * 7 + 3) % total AS b FROM n UNION SELECT id, (id + 11) % total FROM n),
    u AS (SELECT a, b FROM e WHERE a <> b UNION SELECT b, a FROM e WHERE a <> b),
    hot AS (SELECT c_custkey % total AS id, max(c_custkey % 5) AS rank FROM customer, (SELECT max(total) AS total FROM n) WHERE c_custkey % 3 > 0 GROUP BY 1),
    s AS (SELECT n.id FROM n JOIN hot USING (id) WHERE n.id % 10 = 0), g AS (SELECT n.id FROM n JOIN hot USING (id) WHERE n.id % 10 = 7),
    w AS (SELECT id AS s, id AS t, 0 AS d FROM s UNION SELECT s, b, d + 1 FROM w JOIN u ON t = a WHERE d < 25),
    dist AS (SELECT s, t, min(d) AS d FROM w GROUP BY ALL),
    par AS (SELECT x.s, x.t, x.d, min(y.t) AS p FROM dist x JOIN u ON u.b = x.t JOIN dist y ON y.s = x.s AND y.t = u.a AND y.d = x.d - 1 GROUP BY ALL),
    back AS (SELECT s, t AS target, t AS cur, [t] AS path FROM dist JOIN g ON g.id = t WHERE d > 0
             UNION ALL SELECT back.s, target, p, list_prepend(p, path) FROM back JOIN par ON par.s = back.s AND par.t = cur),
    hit AS (SELECT s, target, path, (SELECT max(rank) FROM hot WHERE list_contains(path, hot.id)) AS rank FROM back WHERE cur = s)
    SELECT 'g' AS source_file, CAST(r AS INTEGER) AS path_no, ['info', 'low', 'medium', 'high', 'critical'][rank + 1] AS severity, array_to_string(list_transform(path, lambda x: lpad(CAST(x AS VARCHAR), 6, '0')), '>') AS path
    FROM (SELECT *, row_number() OVER (ORDER BY rank DESC, s, target) AS r FROM hit) WHERE r <= 5
""")
def attack_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The worst paths from threatened outer nodes to threatened inner ones in a graph of suppliers."""
    supplier = table(spark, sf_dir, "supplier")
    total = supplier.count()
    k = F.col("s_suppkey")
    name = lambda c: F.lpad(c.cast("string"), 6, "0")
    zone = F.when(k % 10 == 0, "internet").when(k % 10 == 7, "data").otherwise("private")
    nodes = supplier.select(F.lit("g").alias("source_file"), name(k).alias("id"), zone.alias("trust_zone"))
    links = reduce(DataFrame.union, [supplier.select(F.lit("g").alias("source_file"), name(k).alias("source"), name(to).alias("target")) for to in ((k * 7 + 3) % total, (k + 11) % total)])
    c = F.col("c_custkey")
    threats = table(spark, sf_dir, "customer").where(c % 3 > 0).select(F.lit("g").alias("source_file"), name(c % total).alias("resource_address"), (c % 5).cast("int").alias("sev_rank"))
    return graph.attack_paths(nodes, links, threats).select("source_file", "path_no", "severity", F.array_join("path", ">").alias("path"))
