"""The named queries over the driver's tables, each with the SQL that states its result.

The tables hold no infrastructure files, so the operators run on what the tables have: prose, pages, JSON properties,
and keys from which resources, versions and findings are derived.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palisark import dims
from palisark.functions import formats, versions
from palisark.operators import graph, reports, rules, secrets, store, vulnerabilities
from palisark.operators.intervals import interval_join
from palisark.session import shared_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with the SQL of its result."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sql_text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


LINE_BREAK = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]"
#: The entities that hide quotes and brackets in pages.
ENTITIES = (("&quot;", '"'), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"))


def _secret_sql(source: str, key: str, text: str) -> str:
    parts = []
    for r in secrets.RULES:
        words = " OR ".join(f"contains(t, {sql_text(k)})" for k in r.keywords) or "true"
        excuse = " AND ".join(f"NOT regexp_matches(m, {sql_text(x)})" for x in r.allow) or "true"
        parts.append(f"""
            SELECT k, n, m, {sql_text(r.id)} AS rule_id, {sql_text(r.severity)} AS severity FROM (
                SELECT k, n, unnest(regexp_extract_all(line, {sql_text(r.pattern)}, 0)) AS m FROM (
                    SELECT k, generate_subscripts(lines, 1) AS n, unnest(lines) AS line
                    FROM (SELECT k, string_split_regex(t, {sql_text(LINE_BREAK)}) AS lines FROM src WHERE {words}))
            ) WHERE {excuse}""")
    return f"""WITH src AS (SELECT CAST({key} AS VARCHAR) AS k, {text} AS t FROM {source})
        SELECT k AS file_path, CAST(n AS INTEGER) AS line_number, rule_id, severity,
               CASE WHEN length(m) <= 12 THEN left(m, 2) || '****' || right(m, 2) ELSE left(m, 4) || '****' || right(m, 4) END AS match,
               'SECRET-' || substr(sha256(rule_id || '_' || k || '_' || CAST(n AS VARCHAR) || '_' || m), 1, 12) AS id
        FROM ({" UNION ALL ".join(parts)})"""


def _decoded_sql(text: str) -> str:
    return reduce(lambda t, e: f"replace({t}, {sql_text(e[0])}, {sql_text(e[1])})", ENTITIES, text)


SECRET_COLUMNS = ("file_path", "line_number", "rule_id", "severity", "match", "id")


@query(_secret_sql("documents", "doc_id", "text"))
def secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"), path_col="doc_id").select(*SECRET_COLUMNS)


@query(_secret_sql("pages", "page_id", _decoded_sql("html")))
def secret_scan_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = reduce(lambda t, e: F.replace(t, F.lit(e[0]), F.lit(e[1])), ENTITIES, F.col("html"))
    return secrets.scan(table(spark, sf_dir, "pages").withColumn("html", text), path_col="page_id", text_col="html").select(*SECRET_COLUMNS)


def _redact_sql(source: str, key: str, text: str) -> str:
    each = " UNION ALL ".join(
        f"SELECT DISTINCT k, {sql_text(label)} AS kind, unnest(regexp_extract_all(t, {sql_text(p)}, {g})) AS m FROM src" for label, p, g in secrets.REDACT_PATTERNS
    )
    return f"""WITH src AS (SELECT {key} AS k, {text} AS t FROM {source})
        SELECT k AS {key}, kind, m AS match, 'REDACTED_' || kind || '_' || substr(sha256(m), 1, 8) AS placeholder FROM ({each})"""


@query(_redact_sql("documents", "doc_id", "text"))
def redact_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.redact_matches(table(spark, sf_dir, "documents"), "doc_id", "text")


@query(f"""
    SELECT conv_id, turn, regexp_replace(regexp_replace(text, {sql_text(secrets.REDACT_PATTERNS[2][1])}, '<ip>', 'g'),
                                         {sql_text(secrets.REDACT_PATTERNS[4][1])}, '<email>', 'g') AS masked
    FROM conversations
""")
def mask_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    masked = F.regexp_replace(F.regexp_replace("text", secrets.REDACT_PATTERNS[2][1], "<ip>"), secrets.REDACT_PATTERNS[4][1], "<email>")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", masked.alias("masked"))


def _license_sql(value: str, classes: bool = True) -> str:
    groups = {k: ", ".join(map(sql_text, v)) for k, v in reports.LICENSES.items()}
    return "CASE " + " ".join(f"WHEN trim({value}) IN ({v}) THEN '{k}'" for k, v in groups.items()) + " ELSE 'unknown' END"


_PROSE_SQL = "CASE " + " ".join(f"WHEN contains(text, {sql_text(a)}) THEN '{b}'" for a, b in reports.LICENSE_PROSE) + " END"
_LICENSE_SEVERITY_SQL = "CASE c " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in reports.LICENSE_SEVERITY.items()) + " END"


@query(f"""
    SELECT doc_id, license_id, c AS classification, {_LICENSE_SEVERITY_SQL} AS severity
    FROM (SELECT doc_id, license_id, {_license_sql("license_id")} AS c
          FROM (SELECT doc_id, {_PROSE_SQL} AS license_id FROM documents) WHERE license_id IS NOT NULL)
""")
def license_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "documents").select("doc_id", reports.license_of_prose(F.col("text")).alias("license_id")).where("license_id is not null")
    cls = reports.classify_license(F.col("license_id"))
    return found.select("doc_id", "license_id", cls.alias("classification"), reports.license_severity(cls).alias("severity"))


def _rule(rule_id: str, prefix: str, severity: str, condition: dict) -> rules.Rule:
    return rules.Rule(rule_id, rule_id, "", "tampering", severity, prefix, condition)


#: Every leaf and logical operator of the condition language over the events' properties.
EVENT_RULES = [
    (_rule("EQUALS", "", "low", {"k": {"equals": 7}}), "k = 7"),
    (_rule("DIRECT", "", "low", {"k": 9}), "k = 9"),
    (_rule("NOT_EQUALS", "purchase", "low", {"k": {"not_equals": 7}}), "k IS DISTINCT FROM 7"),
    (_rule("EXISTS", "signup", "info", {"k": {"exists": True}}), "k IS NOT NULL"),
    (_rule("NOT_EXISTS", "error", "high", {"missing": {"not_exists": True}}), "true"),
    (_rule("CONTAINS", "", "low", {"k": {"contains": "7"}}), "false"),
    (_rule("NOT_CONTAINS", "signup", "low", {"k": {"not_contains": "7"}}), "true"),
    (_rule("MATCHES_ANY", "click", "medium", {"k": {"matches_any": [1, 2, 3]}}), "k IN (1, 2, 3)"),
    (_rule("GREATER_THAN", "", "high", {"k": {"greater_than": 97}}), "k > 97"),
    (_rule("LESS_THAN", "", "critical", {"k": {"less_than": 2}}), "k < 2"),
    (_rule("IS_TRUE", "error", "medium", {"k": {"is_true": False}}), "coalesce(k, 0) = 0"),
    (_rule("IS_EMPTY", "view", "low", {"missing": {"is_empty": True}, "k": {"less_than": 5}}), "k < 5"),
    (_rule("PROPERTY_PATH", "view", "low", {"any": {"property_path": "k"}, "k": {"greater_than": 95}}), "k > 95"),
    (_rule("UNKNOWN", "", "critical", {"k": {"like": 7}}), "false"),
    (_rule("ALL_OF", "purchase", "high", {"all_of": [{"k": {"greater_than": 10}}, {"k": {"less_than": 20}}]}), "k > 10 AND k < 20"),
    (_rule("ANY_OF", "click", "high", {"any_of": [{"k": 5}, {"k": 50}], "k": 1}), "k = 5 OR k = 50"),
    (_rule("NONE_OF", "signup", "low", {"none_of": [{"k": {"greater_than": 3}}]}), "NOT coalesce(k > 3, false)"),
    (_rule("NOT", "error", "medium", {"not": {"k": {"greater_than": 3}}}), "NOT coalesce(k > 3, false)"),
]


@query(
    "WITH e AS (SELECT event_id, event_type, CAST(json_extract(props, '$.k') AS DOUBLE) AS k FROM events) "
    + " UNION ALL ".join(
        f"SELECT event_id, '{r.id}' AS rule_id FROM e WHERE starts_with(event_type, '{r.resource_type}') AND coalesce({sql}, false)" for r, sql in EVENT_RULES
    )
)
def rule_eval_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", "event_type", F.parse_json("props").alias("properties"))
    return rules.matches(rows, [r for r, _ in EVENT_RULES], "event_type").select("event_id", "rule_id")


#: Types whose prefixes the dimension tables know, or don't; a key's remainder picks one.
TYPES = (
    "aws_s3_bucket", "aws_route53_zone", "aws_route_table", "aws_lb_listener", "aws_db_instance", "google_sql_database_instance", "azurerm_sql_server",
    "kubernetes_cluster_role_binding", "kubernetes_service_account", "dockerfile_expose", "dependency_npm", "unknown_thing", "aws_iam_role_policy_attachment",
)
_TYPES_SQL = "[" + ", ".join(map(sql_text, TYPES)) + "]"


def _type(key: str) -> Column:
    return F.element_at(F.array(*map(F.lit, TYPES)), (F.pmod(F.col(key), F.lit(len(TYPES))) + 1).cast("int"))


def _prefix_sql(table_: dict[str, str], default: str) -> str:
    rows = ", ".join(f"({sql_text(p)}, {sql_text(v)})" for p, v in table_.items())
    return f"coalesce((SELECT v FROM (VALUES {rows}) d(p, v) WHERE starts_with(t.resource_type, p) ORDER BY length(p) DESC LIMIT 1), '{default}')"


@query(f"""
    SELECT p_partkey, resource_type, {_prefix_sql(dims.CATEGORIES, "unknown")} AS category, {_prefix_sql(dims.ZONE_OF, "private")} AS trust_zone
    FROM (SELECT p_partkey, {_TYPES_SQL}[p_partkey % {len(TYPES)} + 1] AS resource_type FROM part) t
""")
def longest_prefix_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_partkey", _type("p_partkey").alias("resource_type"))
    return rows.select(
        "p_partkey", "resource_type", dims.category(F.col("resource_type")).alias("category"), dims.longest_prefix(F.col("resource_type"), dims.ZONE_OF, "private").alias("trust_zone")
    )


@query(f"""
    SELECT p_partkey, rule_id FROM (SELECT p_partkey, p_size, {_TYPES_SQL}[p_partkey % {len(TYPES)} + 1] AS t FROM part),
        (VALUES ('S3_BIG', 'aws_s3', 25), ('ANY_AWS', 'aws_', 45), ('ROUTE', 'aws_route', 10)) r(rule_id, p, least)
    WHERE starts_with(t, p) AND p_size > least
""")
def rule_prefix_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    props = F.to_variant_object(F.named_struct(F.lit("size"), F.col("p_size")))
    rows = table(spark, sf_dir, "part").select("p_partkey", _type("p_partkey").alias("resource_type"), props.alias("properties"))
    tested = [_rule(i, p, "low", {"size": {"greater_than": n}}) for i, p, n in (("S3_BIG", "aws_s3", 25), ("ANY_AWS", "aws_", 45), ("ROUTE", "aws_route", 10))]
    return rules.matches(rows, tested).select("p_partkey", "rule_id")


#: What the built-in rules for these types say about a part's resource, by k, its number among those of its type:
#: rule, severity, STRIDE category, techniques, tactics, types, and when it fires.
BUILTIN_SQL = """
    ('ELB_NO_HTTPS', 'high', 'information_disclosure', 'T1557', 'TA0006', t = 'aws_lb_listener' AND k % 2 = 1),
    ('ELB_NO_ACCESS_LOGS', 'medium', 'repudiation', 'T1562.008', 'TA0005', t = 'aws_lb_listener' AND k % 3 = 0),
    ('ELB_OUTDATED_TLS', 'medium', 'information_disclosure', 'T1557', 'TA0006', t = 'aws_lb_listener' AND k % 4 IN (1, 2)),
    ('IAM_OVERPERMISSIVE_ROLE', 'high', 'elevation_of_privilege', 'T1078.004,T1098', 'TA0001,TA0003,TA0004', t = 'aws_iam_role_policy_attachment' AND k % 4 = 2),
    ('RDS_PUBLIC_ACCESS', 'critical', 'information_disclosure', 'T1190', 'TA0001', t = 'aws_db_instance' AND k % 2 = 0),
    ('RDS_NO_ENCRYPTION', 'high', 'information_disclosure', 'T1530', 'TA0009', t = 'aws_db_instance' AND k % 3 <> 1),
    ('RDS_NO_BACKUP', 'medium', 'tampering', 'T1485', 'TA0040', t = 'aws_db_instance' AND (k % 5 = 0 OR k % 4 = 0)),
    ('S3_NO_ENCRYPTION', 'high', 'information_disclosure', 'T1530', 'TA0009', t = 'aws_s3_bucket' AND k % 3 <> 2),
    ('S3_PUBLIC_ACCESS', 'critical', 'information_disclosure', 'T1530,T1190', 'TA0009,TA0001', t = 'aws_s3_bucket' AND (k % 3 > 0 OR k % 7 = 0)),
    ('S3_NO_VERSIONING', 'medium', 'tampering', 'T1485', 'TA0040', t = 'aws_s3_bucket' AND k % 4 IN (0, 1)),
    ('S3_NO_LOGGING', 'medium', 'repudiation', 'T1562.008', 'TA0005', t = 'aws_s3_bucket' AND k % 2 = 0),
    ('AZURE_SQL_NO_AUDIT', 'high', 'repudiation', 'T1562.008', 'TA0005', t = 'azurerm_sql_server' AND k % 3 <> 2),
    ('AZURE_SQL_NO_THREAT_DETECTION', 'medium', 'information_disclosure', 'T1190', 'TA0001', t = 'azurerm_sql_server' AND k % 5 <> 0),
    ('AZURE_SQL_PUBLIC_ACCESS', 'high', 'information_disclosure', 'T1190', 'TA0001', t = 'azurerm_sql_server' AND k % 2 = 0),
    ('CLOUDSQL_NO_SSL', 'high', 'information_disclosure', 'T1557', 'TA0006', t = 'google_sql_database_instance' AND k % 2 = 1),
    ('CLOUDSQL_PUBLIC_IP', 'high', 'information_disclosure', 'T1190', 'TA0001', t = 'google_sql_database_instance' AND k % 3 = 0),
    ('CLOUDSQL_NO_BACKUP', 'high', 'denial_of_service', 'T1485', 'TA0040', t = 'google_sql_database_instance' AND k % 5 <> 0),
    ('CLOUDSQL_NO_ENCRYPTION', 'medium', 'information_disclosure', 'T1530', 'TA0009', t = 'google_sql_database_instance' AND k % 3 <> 1),
    ('CLOUDSQL_NO_MAINTENANCE_WINDOW', 'low', 'denial_of_service', 'T1499', 'TA0040', t = 'google_sql_database_instance' AND k % 2 = 0),
    ('K8S_CLUSTER_ADMIN_BINDING', 'critical', 'elevation_of_privilege', 'T1078', 'TA0004', t = 'kubernetes_cluster_role_binding' AND k % 2 = 1),
    ('K8S_WILDCARD_RBAC_VERBS', 'high', 'elevation_of_privilege', 'T1078', 'TA0004', t = 'kubernetes_cluster_role_binding' AND k % 3 = 0),
    ('K8S_WILDCARD_RBAC_RESOURCES', 'high', 'elevation_of_privilege', 'T1078', 'TA0004', t = 'kubernetes_cluster_role_binding' AND k % 5 = 0),
    ('K8S_AUTOMOUNT_DEFAULT', 'medium', 'elevation_of_privilege', 'T1528', 'TA0006', t = 'kubernetes_service_account' AND k % 2 = 0)
"""


@query(f"""
    WITH r AS (SELECT t || '.' || p_partkey AS address, t, k FROM (SELECT p_partkey, {_TYPES_SQL}[p_partkey % {len(TYPES)} + 1] AS t, p_partkey // {len(TYPES)} AS k FROM part)),
         hit AS (SELECT address, rule_id, severity, stride_category, techniques, tactics
                 FROM r, LATERAL (VALUES {BUILTIN_SQL}) b(rule_id, severity, stride_category, techniques, tactics, fires) WHERE fires)
    SELECT substr(sha256(rule_id || '_' || address), 1, 12) AS id, rule_id, address AS resource_address, severity, stride_category, techniques, tactics FROM hit
""")
def builtin_rule_threats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All built-in rules over resources derived from parts, whose properties are there, empty, wrong or missing by turns."""
    k = F.floor(F.col("p_partkey") / len(TYPES))
    pick = lambda n, *values: F.element_at(F.array(*[v if isinstance(v, Column) else F.lit(v) for v in values]), (k % n + 1).cast("int"))
    some, empty, none = F.array(F.lit(1)), F.array().cast("array<int>"), F.lit(None).cast("array<int>")
    enabled = lambda x: F.array(F.struct(F.lit(x).alias("enabled")))
    props = {
        "protocol": pick(2, "HTTPS", "HTTP"), "access_logs": pick(3, none, some, empty), "ssl_policy": pick(4, "ELBSecurityPolicy-TLS13-1-2-2021-06", "ELBSecurityPolicy-2016-08", "ELBSecurityPolicy-TLS-1-0-2015-04", None),
        "assume_role_policy": pick(4, None, '{"Principal":{"AWS":"*"}}', '[{"Effect":"Allow","Principal":"*"}]', ""), "publicly_accessible": k % 2 == 0, "storage_encrypted": pick(3, False, True, None),
        "backup_retention_period": F.when(k % 5 != 0, k % 4), "acl": pick(3, "private", "public-read", "authenticated-read"), "policy": F.when(k % 7 == 0, '{"Effect":"Allow","Principal":"*"}'),
        "versioning": pick(4, F.lit(None).cast("array<struct<enabled:boolean>>"), enabled(False), enabled(True), F.array().cast("array<struct<enabled:boolean>>")), "logging": F.when(k % 2 == 1, some),
        "server_side_encryption_configuration": pick(3, none, empty, some), "extended_auditing_policy": pick(3, none, empty, some), "threat_detection_policy": F.when(k % 5 == 0, "on"), "public_network_access_enabled": k % 2 == 0,
        "settings": F.struct(
            F.struct((k % 2 == 0).alias("require_ssl"), (k % 3 == 0).alias("ipv4_enabled")).alias("ip_configuration"), F.struct((k % 5 == 0).alias("enabled")).alias("backup_configuration"),
            F.when(k % 2 == 1, F.struct(F.lit(7).alias("day"))).alias("maintenance_window"),
        ),
        "encryption_key_name": F.when(k % 3 == 1, "key"), "role_ref_name": pick(2, "view", "cluster-admin"), "has_wildcard_verbs": k % 3 == 0, "has_wildcard_resources": k % 5 == 0,
        "automountServiceAccountToken": F.when(k % 2 == 1, False),
    }
    rows = table(spark, sf_dir, "part").select(
        F.lit("part").alias("source_file"), F.concat(_type("p_partkey"), F.lit("."), "p_partkey").alias("id"), _type("p_partkey").alias("resource_type"),
        F.parse_json(F.to_json(F.struct(*[v.alias(n) for n, v in props.items()]))).alias("properties"),
    )
    told = F.array_join("mitre_techniques", ",").alias("techniques"), F.array_join("mitre_tactics", ",").alias("tactics")
    return rules.threats(rows, rules.load()).select("id", "rule_id", "resource_address", "severity", "stride_category", *told)


_ZONES_SQL = "['internet', 'dmz', 'private', 'data', 'management']"


def _zone(region: str) -> Column:
    return F.element_at(F.array(*map(F.lit, dims.ZONES)), (F.col(region) + 1).cast("int"))


@query(f"""
    WITH z AS (SELECT n_nationkey, {_ZONES_SQL}[n_regionkey + 1] AS zone FROM nation),
         e AS (SELECT s_suppkey, a.zone AS source_zone, b.zone AS target_zone FROM supplier
               JOIN z a ON s_nationkey = a.n_nationkey JOIN customer ON c_custkey % 97 = s_suppkey % 97 JOIN z b ON c_nationkey = b.n_nationkey)
    SELECT source_zone, target_zone, count(*) AS n_edges,
           CASE WHEN least(source_zone, target_zone) || '/' || greatest(source_zone, target_zone)
                     IN ('internet/private', 'data/internet', 'data/dmz', 'internet/management') THEN 'high' ELSE 'medium' END AS severity
    FROM e WHERE source_zone <> target_zone GROUP BY ALL
""")
def trust_boundary_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    zones = table(spark, sf_dir, "nation").select("n_nationkey", _zone("n_regionkey").alias("zone"))
    sources = table(spark, sf_dir, "supplier").join(zones, F.col("s_nationkey") == F.col("n_nationkey")).select((F.col("s_suppkey") % 97).alias("k"), F.col("zone").alias("source_zone"))
    targets = table(spark, sf_dir, "customer").join(zones, F.col("c_nationkey") == F.col("n_nationkey")).select((F.col("c_custkey") % 97).alias("k"), F.col("zone").alias("target_zone"))
    # Both sides are counted per key and zone before they meet: the join has at most 97 x 5 rows a side.
    a = sources.groupBy("k", "source_zone").agg(F.count("*").alias("n_a"))
    b = targets.groupBy("k", "target_zone").agg(F.count("*").alias("n_b"))
    crossing = a.join(b, "k").where("source_zone <> target_zone").groupBy("source_zone", "target_zone").agg(F.sum(F.col("n_a") * F.col("n_b")).alias("n_edges"))
    return crossing.withColumn("severity", graph.boundary_severity(F.col("source_zone"), F.col("target_zone")))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def dependency_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(known, "o_custkey", "left_semi")


def _infra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as subnets, suppliers as instances in them, customers as databases that name their subnet and depend on an instance."""
    strings = "array<string>"
    none = F.array().cast(strings)
    col = lambda kind, key, name, props, deps, ord_: (
        F.lit("tables").alias("source_file"), ord_.cast("int").alias("ord"), F.lit(kind).alias("resource_type"), F.concat(F.lit(kind + "."), key).alias("address"),
        name.alias("name"), F.lit("aws").alias("provider"), F.to_variant_object(props).alias("properties"), deps.alias("dependencies"), F.lit("").alias("module"),
        F.lit("").alias("source_location"),
    )
    nation = table(spark, sf_dir, "nation").select(*col("aws_subnet", F.col("n_nationkey").cast("string"), F.col("n_name"), F.named_struct(F.lit("size"), F.lit(1)), none, F.col("n_nationkey")))
    names = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    supplier = table(spark, sf_dir, "supplier").join(names, F.col("s_nationkey") == F.col("n_nationkey")).select(
        *col("aws_instance", F.col("s_suppkey").cast("string"), F.col("s_name"), F.named_struct(F.lit("subnet_id"), F.col("n_name"), F.lit("associate_public_ip_address"), F.col("s_acctbal") < 0), none, 1000 + F.col("s_suppkey"))
    )
    subnet = F.concat(F.lit("aws_subnet."), F.col("c_nationkey").cast("string"))
    customer = table(spark, sf_dir, "customer").select(
        *col("aws_db_instance", F.col("c_custkey").cast("string"), F.col("c_name"), F.named_struct(F.lit("subnet_ids"), F.array(subnet)), F.array(F.concat(F.lit("aws_instance."), (F.col("c_custkey") % 20).cast("string"))), 1_000_000 + F.col("c_custkey"))
    )
    return nation.unionByName(supplier).unionByName(customer)


@query("""
    WITH n AS (SELECT 'aws_subnet.' || n_nationkey AS id, 'private' AS z FROM nation
               UNION ALL SELECT 'aws_instance.' || s_suppkey, CASE WHEN s_acctbal < 0 THEN 'dmz' ELSE 'private' END FROM supplier
               UNION ALL SELECT 'aws_db_instance.' || c_custkey, 'private' FROM customer),
         e AS (SELECT 'aws_instance.' || s_suppkey AS s, 'aws_subnet.' || s_nationkey AS t, 'containment' AS edge_type FROM supplier
               UNION ALL SELECT 'aws_db_instance.' || c_custkey, 'aws_subnet.' || c_nationkey, 'containment' FROM customer
               UNION ALL SELECT 'aws_db_instance.' || c_custkey, 'aws_instance.' || (c_custkey % 20), 'dependency' FROM customer)
    SELECT e.s AS source, e.t AS target, edge_type, a.z <> b.z AS crosses_trust_boundary FROM e JOIN n a ON e.s = a.id JOIN n b ON e.t = b.id
""")
def reference_union_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    resources = _infra(spark, sf_dir)
    found = graph.nodes(resources)
    return graph.edges(resources, found).select("source", "target", "edge_type", "crosses_trust_boundary")


_VERSION_SQL = "p_size || '.' || (p_partkey % 10) || '.' || (p_partkey % 7) || CASE WHEN p_partkey % 5 = 0 THEN '-rc1' ELSE '' END"


def _key_sql(v: str) -> str:
    parts = f"list_transform(string_split(regexp_replace(regexp_replace({v}, '^v+', ''), '[-+].*$', ''), '.'), lambda x: coalesce(TRY_CAST(x AS BIGINT), 0))"
    return f"(CASE WHEN len({parts}) = 1 THEN list_concat({parts}, [0, 0]) WHEN len({parts}) = 2 THEN list_concat({parts}, [0]) ELSE {parts} END)"


@query(f"""
    WITH p AS (SELECT p_partkey, p_partkey % 25 AS eco, {_key_sql(_VERSION_SQL)} AS k FROM part),
         s AS (SELECT s_suppkey, s_nationkey AS eco, {_key_sql("'v' || (s_suppkey % 50) || '.4'")} AS lo, {_key_sql("(s_suppkey % 50 + 3) || '.3.1.9'")} AS hi FROM supplier)
    SELECT p_partkey, s_suppkey FROM p JOIN s USING (eco)
    WHERE k[1:least(len(k), len(lo))] >= lo[1:least(len(k), len(lo))] AND k[1:least(len(k), len(hi))] < hi[1:least(len(k), len(hi))]
""")
def version_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    tail = F.when(F.col("p_partkey") % 5 == 0, "-rc1").otherwise("")
    version = F.concat_ws("", F.concat_ws(".", "p_size", F.col("p_partkey") % 10, F.col("p_partkey") % 7), tail)
    eco = lambda c: F.concat(F.lit("eco"), c)
    parts = table(spark, sf_dir, "part").select("p_partkey", eco(F.col("p_partkey") % 25).alias("ecosystem"), F.lit("x").alias("name"), version.alias("version"))
    low = F.concat(F.lit("v"), F.col("s_suppkey") % 50, F.lit(".4"))
    high = F.concat(F.col("s_suppkey") % 50 + 3, F.lit(".3.1.9"))
    ranges = table(spark, sf_dir, "supplier").select("s_suppkey", eco(F.col("s_nationkey")).alias("ecosystem"), F.lit("x").alias("name"), low.alias("version_introduced"), high.alias("version_fixed"))
    return vulnerabilities.versions_in_ranges(parts, ranges).select("p_partkey", "s_suppkey")


@query("""
    WITH p AS (SELECT p_partkey, p_partkey % 3 AS g, CAST(round(p_retailprice * 100) AS BIGINT) AS k FROM part),
         r AS (SELECT o_orderkey, o_orderkey % 3 AS g, CASE WHEN o_orderkey % 101 > 0 THEN CAST(round(o_totalprice * 100) AS BIGINT) % 200000 END AS lo, o_orderkey % 500 AS width FROM orders)
    SELECT p_partkey, o_orderkey FROM p JOIN r ON p.g = r.g AND (lo IS NULL OR lo <= k) AND k < coalesce(lo, 90500) + width
""")
def nested_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices in intervals, of which three keys have all; some intervals are open below."""
    cents = lambda c: F.round(F.col(c) * 100).cast("long")
    points = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % 3).alias("g"), cents("p_retailprice").alias("k"))
    k = F.col("o_orderkey")
    low = F.when(k % 101 > 0, cents("o_totalprice") % 200000)
    spans = table(spark, sf_dir, "orders").select("o_orderkey", (k % 3).alias("g"), low.alias("lo"), (F.coalesce(low, F.lit(90500)) + k % 500).alias("hi"))
    return interval_join(points, spans, ["g"], "k", "lo", "hi").select("p_partkey", "o_orderkey")


@query("""
    SELECT user_id, event_type, event_id, value FROM (
        SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS r FROM events) WHERE r = 1
""")
def upsert_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value", F.col("event_id").alias("load_ord"))
    return vulnerabilities.upsert(rows.drop("load_ord").limit(0), rows, ("user_id", "event_type"))


@query("""
    SELECT user_id, event_type, event_id, value FROM (
        SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id % 3 DESC, event_id DESC) AS r FROM events WHERE event_id % 3 < 2 OR event_id % 50 = 2) WHERE r = 1
""")
def upsert_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store after three loads, the last of which touches a part of its keys."""
    path = shared_path(spark, "store")
    store.create(spark, path, "user_id long, event_type string, event_id long, value double", ("user_id", "event_type"), 16)
    e = table(spark, sf_dir, "events")
    for part in ("event_id % 3 = 0", "event_id % 3 = 1", "event_id % 3 = 2 and event_id % 50 = 2"):
        store.load(spark, path, e.where(part), "event_id")
    return store.read(spark, path)


_DIFF_CUT = "1997-01-01"


@query(f"""
    WITH a AS (SELECT o_custkey AS id, max_by(o_orderpriority, o_orderkey) AS p FROM orders WHERE o_orderdate < TIMESTAMP '{_DIFF_CUT}' GROUP BY 1),
         b AS (SELECT o_custkey AS id, max_by(o_orderpriority, o_orderkey) AS p FROM orders WHERE o_orderdate >= TIMESTAMP '{_DIFF_CUT}' GROUP BY 1)
    SELECT coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NULL THEN 'added' WHEN b.id IS NULL THEN 'removed' ELSE 'unchanged' END AS change,
           coalesce(b.p, a.p) AS title
    FROM a FULL JOIN b ON a.id = b.id
""")
def report_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderpriority").alias("title"), F.col("o_orderkey").alias("ord"), "o_orderdate")
    cut = F.lit(_DIFF_CUT).cast("timestamp_ntz")
    day = F.col("o_orderdate").cast("timestamp_ntz")
    return reports.diff(rows.where(day < cut).drop("o_orderdate"), rows.where(day >= cut).drop("o_orderdate"))


@query("""
    SELECT event_id, event_type FROM events e WHERE NOT EXISTS (
        SELECT 1 FROM (SELECT s_suppkey * 7 AS id, DATE '2024-01-01' + CAST(s_suppkey % 60 AS INTEGER) AS exp FROM supplier) i
        WHERE i.id = e.event_id AND DATE '2024-02-01' <= exp)
""")
def ignore_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    ignores = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") * 7).alias("ignore_id"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("s_suppkey") % 60).cast("int")).alias("expires"))
    found = table(spark, sf_dir, "events").select("event_id", "event_type")
    return reports.suppress(found, ignores, "event_id", F.lit("2024-02-01").cast("date"))


_SEVERITY_SQL = "['info', 'low', 'medium', 'high', 'critical'][event_id % 5 + 1]"
_STRIDE_SQL = "[" + ", ".join(map(sql_text, dims.STRIDE_CATEGORIES)) + "][event_id % 6 + 1]"
_TECHNIQUES = list(dims.TECHNIQUE_NAMES)[:12]
_TECHNIQUE_SQL = "[" + ", ".join(map(sql_text, _TECHNIQUES)) + "]"


def _threats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as threats: severity, STRIDE category and two techniques follow from the id."""
    e = table(spark, sf_dir, "events")
    pick = lambda values, by: F.element_at(F.array(*map(F.lit, values)), (by % len(values) + 1).cast("int"))
    i = F.col("event_id")
    severity = pick(dims.SEVERITIES, i)
    techniques = F.array_distinct(F.array(pick(_TECHNIQUES, i), pick(_TECHNIQUES, F.col("user_id"))))
    return e.select(
        "event_id", "user_id", "event_type", F.lpad(i.cast("string"), 12, "0").alias("id"), F.concat_ws(" ", "event_type", i).alias("title"), severity.alias("severity"),
        dims.severity_rank(severity).alias("sev_rank"), pick(dims.STRIDE_CATEGORIES, i).alias("stride_category"), techniques.alias("mitre_techniques"), "value",
    )


@query(f"SELECT event_type, {_SEVERITY_SQL} AS severity, count(*) AS n FROM events GROUP BY ALL")
def severity_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.severity_summary(_threats(spark, sf_dir), "event_type")


@query(f"SELECT {_STRIDE_SQL} AS stride_category, count(*) AS n, max(event_id % 5) AS max_rank FROM events GROUP BY 1")
def stride_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.stride_summary(_threats(spark, sf_dir))


@query(f"""
    SELECT technique_id, count(*) AS n, ['info', 'low', 'medium', 'high', 'critical'][max(event_id % 5) + 1] AS max_severity,
           array_to_string(list(event_type || ' ' || event_id ORDER BY event_id)[1:5], '; ') AS first_titles
    FROM (SELECT event_id, event_type, unnest(list_distinct([{_TECHNIQUE_SQL}[event_id % 12 + 1], {_TECHNIQUE_SQL}[user_id % 12 + 1]])) AS technique_id FROM events)
    GROUP BY 1
""")
def technique_max_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.technique_summary(_threats(spark, sf_dir)).withColumn("first_titles", F.array_join("first_titles", "; "))


@query(f"""
    SELECT event_id, {_SEVERITY_SQL} AS severity FROM events WHERE event_id % 5 >= 3
""")
def min_severity_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.min_severity(_threats(spark, sf_dir), "high").select("event_id", "severity")


@query(f"SELECT event_id, {_SEVERITY_SQL} AS severity FROM events ORDER BY event_id % 5 DESC, event_id LIMIT 5")
def top5_by_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.worst(_threats(spark, sf_dir), 5, "event_id").select("event_id", "severity")


@query("""
    SELECT c_custkey, c_mktsegment AS zone, (r - 1) % 5 AS col, CAST(floor((r - 1) / 5) AS BIGINT) AS row_no
    FROM (SELECT c_custkey, c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) AS r FROM customer)
""")
def layout_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formats.layout_grid(table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("zone"), F.col("c_custkey").alias("ord"))).drop("ord")


@query("""
    WITH f AS (SELECT o_orderpriority AS rule_id, min(o_orderkey) AS first FROM orders GROUP BY 1)
    SELECT rule_id, first, row_number() OVER (ORDER BY first) - 1 AS rule_index FROM f
""")
def sarif_rule_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("rule_id"), F.col("o_orderkey").alias("ord"))
    return formats.sarif_rules(rows).select("rule_id", F.col("ord").alias("first"), F.col("rule_index").cast("long").alias("rule_index"))


@query("""
    WITH RECURSIVE e AS (SELECT n_nationkey AS a, (n_nationkey * 7 + 3) % 25 AS b FROM nation UNION ALL SELECT n_nationkey, (n_nationkey + 11) % 25 FROM nation),
    u AS (SELECT DISTINCT lpad(CAST(a AS VARCHAR), 2, '0') AS x, lpad(CAST(b AS VARCHAR), 2, '0') AS y
          FROM (SELECT a, b FROM e UNION ALL SELECT b, a FROM e) WHERE a <> b),
    w AS (SELECT lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS s, lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS t, [lpad(CAST(n_nationkey AS VARCHAR), 2, '0')] AS p
          FROM nation WHERE n_regionkey = 0
          UNION ALL SELECT s, y, list_append(p, y) FROM w JOIN u ON t = x WHERE NOT list_contains(p, y) AND len(p) < 7)
    SELECT s AS entry, t AS target, array_to_string(p, '>') AS path, CAST(len(p) - 1 AS INTEGER) AS hops
    FROM (SELECT *, row_number() OVER (PARTITION BY s, t ORDER BY len(p), p) AS r FROM w JOIN nation ON lpad(CAST(n_nationkey AS VARCHAR), 2, '0') = t AND n_regionkey = 3
          WHERE s <> t) WHERE r = 1
""")
def shortest_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation")
    name = lambda c: F.lpad(c.cast("string"), 2, "0")
    k = F.col("n_nationkey")
    links = reduce(DataFrame.union, [nation.select(F.lit("g").alias("source_file"), name(k).alias("source"), name(to).alias("target")) for to in ((k * 7 + 3) % 25, (k + 11) % 25)])
    ends = nation.select(F.lit("g").alias("source_file"), name(k).alias("id"), "n_regionkey")
    found = graph.shortest_paths(links, ends.where("n_regionkey = 0"), ends.where("n_regionkey = 3"))
    return found.select("entry", "target", F.array_join("path", ">").alias("path"), "hops")


@query("""
    SELECT p_partkey, 'pkg:' || CASE WHEN p_partkey % 4 = 0 THEN 'golang/example.org/m/' WHEN p_partkey % 4 = 1 THEN 'npm/@scope/' WHEN p_partkey % 4 = 2 THEN 'hex/' ELSE 'cargo/' END
               || replace(p_name, ' ', '-') || '@' || CASE WHEN p_partkey % 5 = 0 THEN '' ELSE p_size || '.0.0' END AS purl,
           substr(sha256(p_brand || '_' || p_partkey), 1, 12) AS hash_id,
           CASE WHEN p_size / 5.0 >= 9 THEN 'critical' WHEN p_size / 5.0 >= 7 THEN 'high' WHEN p_size / 5.0 >= 4 THEN 'medium' WHEN p_size > 0 THEN 'low' ELSE 'info' END AS severity
    FROM part
""")
def purl_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    k = F.col("p_partkey") % 4
    prefix = F.when(k == 0, "example.org/m/").when(k == 1, "@scope/").otherwise("")
    ecosystem = F.element_at(F.array(*map(F.lit, ("go", "npm", "hex", "crates.io"))), (k + 1).cast("int"))
    version = F.when(F.col("p_partkey") % 5 != 0, F.concat("p_size", F.lit(".0.0")))
    purl = formats.purl(ecosystem, F.concat(prefix, F.replace("p_name", F.lit(" "), F.lit("-"))), version)
    return part.select("p_partkey", purl.alias("purl"), dims.hash_id(F.col("p_brand"), F.col("p_partkey")).alias("hash_id"), dims.cvss_severity(F.col("p_size") / 5.0).alias("severity"))


@query("""
    SELECT event_type, bool_or(event_id % 5 >= 3) AS failed, count(*) AS n_reported, max(length(title)) AS longest
    FROM (SELECT event_type, event_id, left(event_type || ' ' || event_id, 9) AS title FROM events) GROUP BY 1
""")
def bitbucket_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _threats(spark, sf_dir).withColumn("title", F.substring("title", 1, 9))
    longest = rows.groupBy("event_type").agg(F.max(F.length("title")).cast("long").alias("longest"))
    return reports.gates(rows, "event_type").join(longest, "event_type")


@query(f"""
    SELECT p_partkey, {_license_sql("lic")} AS classification FROM (
        SELECT p_partkey, ['MIT', ' GPL-3.0-only ', 'AGPL-3.0-only', 'MPL-2.0', 'Weird', ''][p_partkey % 6 + 1] AS lic FROM part)
    WHERE {_license_sql("lic")} <> 'permissive'
""")
def license_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    lic = F.element_at(F.array(*map(F.lit, ("MIT", " GPL-3.0-only ", "AGPL-3.0-only", "MPL-2.0", "Weird", ""))), (F.col("p_partkey") % 6 + 1).cast("int"))
    deps = table(spark, sf_dir, "part").select(F.lit("part").alias("source_file"), F.col("p_partkey").cast("string").alias("name"), F.lit("1.0").alias("version"), F.lit("npm").alias("ecosystem"), lic.alias("license"))
    return reports.license_findings(deps).select(F.col("package_name").cast("long").alias("p_partkey"), "classification")


@query("""
    WITH d AS (SELECT p_partkey, p_brand AS name, p_size || '.' || (p_partkey % 10) || '.0' AS v, p_size AS major, p_partkey % 10 AS minor FROM part),
         x AS (SELECT s_suppkey, 'Brand#' || (s_suppkey % 5 + 1) || (s_suppkey % 4 + 1) AS name, s_suppkey % 40 AS hi FROM supplier)
    SELECT p_partkey, s_suppkey, 'CVE-2024-' || s_suppkey AS cve_id,
           CASE WHEN s_suppkey % 10 >= 9 THEN 'critical' WHEN s_suppkey % 10 >= 7 THEN 'high' WHEN s_suppkey % 10 >= 4 THEN 'medium' WHEN s_suppkey % 10 > 0 THEN 'low' ELSE 'info' END AS severity
    FROM d JOIN x USING (name) WHERE major < hi
""")
def vulnerability_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    deps = table(spark, sf_dir, "part").select(k.cast("string").alias("source_file"), F.col("p_brand").alias("name"), F.concat_ws(".", "p_size", k % 10, F.lit("0")).alias("version"), F.lit("npm").alias("ecosystem"))
    s = F.col("s_suppkey")
    vulns = table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("GHSA-"), s).alias("id"), F.lit("npm").alias("ecosystem"), F.concat(F.lit("Brand#"), s % 5 + 1, s % 4 + 1).alias("package"), F.lit("").alias("version_introduced"),
        F.concat(s % 40, F.lit(".0.0")).alias("version_fixed"), F.lit("unrated").alias("severity"), (s % 10).cast("double").alias("cvss_score"), F.lit("x").alias("summary"),
        F.concat(F.lit('["OSV-1","CVE-2024-'), s, F.lit('"]')).alias("aliases"), F.lit("[]").alias("references_json"),
    )
    found = vulnerabilities.dependency_findings(deps, vulns)
    return found.select(F.col("source_file").cast("long").alias("p_partkey"), F.substring("vuln_id", 6, 20).cast("long").alias("s_suppkey"), "cve_id", "severity")


@query("""
    SELECT p_partkey, CASE WHEN a1 <> b1 THEN CASE WHEN a1 < b1 THEN -1 ELSE 1 END WHEN a2 <> b2 THEN CASE WHEN a2 < b2 THEN -1 ELSE 1 END
                           WHEN a3 <> b3 THEN CASE WHEN a3 < b3 THEN -1 ELSE 1 END ELSE 0 END AS cmp
    FROM (SELECT p_partkey, p_partkey % 3 AS a1, p_size AS a2, p_partkey % 7 AS a3, p_partkey % 2 AS b1, 25 AS b2, 3 AS b3 FROM part)
""")
def rpm_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    a = F.concat(k % 3, F.lit(":"), "p_size", F.lit(".0-"), k % 7, F.lit(".el9"))
    b = F.concat(k % 2, F.lit(":25-3.el9"))
    return table(spark, sf_dir, "part").select("p_partkey", versions.compare_rpm(a, b).alias("cmp"))


@query("""
    SELECT p_partkey, family, version, CASE WHEN family = 'debian' AND version = 'bookworm' THEN '12'
           WHEN family IN ('alpine', 'ubuntu') THEN array_to_string(string_split(version, '.')[1:2], '.') ELSE split_part(version, '.', 1) END AS os_version
    FROM (SELECT p_partkey, ['alpine', 'debian', 'ubuntu', 'amzn', 'rhel'][p_partkey % 5 + 1] AS family,
                 CASE WHEN p_partkey % 20 = 1 THEN 'bookworm' ELSE p_size || '.' || (p_partkey % 12) || '.' || (p_partkey % 3) END AS version FROM part)
""")
def os_version_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    family = F.element_at(F.array(*map(F.lit, ("alpine", "debian", "ubuntu", "amzn", "rhel"))), (k % 5 + 1).cast("int"))
    version = F.when(k % 20 == 1, "bookworm").otherwise(F.concat_ws(".", "p_size", k % 12, k % 3))
    rows = table(spark, sf_dir, "part").select("p_partkey", family.alias("family"), version.alias("version"))
    return rows.withColumn("os_version", versions.os_version_key(F.col("family"), F.col("version")))


@query("""
    SELECT 'image' AS image, path, arg_max(layer, layer) AS layer FROM (
        SELECT l_partkey % 500 AS path, l_linenumber AS layer, l_quantity AS q FROM lineitem) f
    WHERE q < 48 AND NOT EXISTS (SELECT 1 FROM lineitem w WHERE w.l_quantity >= 48 AND w.l_partkey % 500 = f.path AND w.l_linenumber > f.layer) GROUP BY path
""")
def layer_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palisark.operators import image

    rows = table(spark, sf_dir, "lineitem").select(
        F.lit("image").alias("image"), (F.col("l_partkey") % 500).cast("string").alias("path"), F.col("l_linenumber").alias("layer"), (F.col("l_quantity") >= 48).alias("gone")
    )
    files = rows.where("not gone").withColumn("content", F.lit(None).cast("binary"))
    merged = image.merge_layers(files.drop("gone"), rows.where("gone").select("image", "path", "layer"))
    return merged.select("image", F.col("path").cast("long").alias("path"), "layer")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of all kinds: kind, severity, subject, detail."""
    s = secret_scan(spark, sf_dir).select(F.lit("secret").alias("kind"), "severity", F.col("file_path").alias("subject"), F.col("rule_id").alias("detail"))
    r = redact_matches(spark, sf_dir).select(F.lit("redaction").alias("kind"), F.lit("info").alias("severity"), F.col("doc_id").cast("string").alias("subject"), F.col("kind").alias("detail"))
    li = license_classify(spark, sf_dir).select(F.lit("license").alias("kind"), "severity", F.col("doc_id").cast("string").alias("subject"), F.col("license_id").alias("detail"))
    ru = rule_eval_props(spark, sf_dir).select(F.lit("rule").alias("kind"), F.lit("low").alias("severity"), F.col("event_id").cast("string").alias("subject"), F.col("rule_id").alias("detail"))
    return reduce(DataFrame.unionByName, [s, r, li, ru])


_FLAG_SQL = (("secret_scan", "secret", "severity", "file_path", "rule_id"), ("redact_matches", "redaction", "'info'", "CAST(doc_id AS VARCHAR)", "kind"), ("license_classify", "license", "severity", "CAST(doc_id AS VARCHAR)", "license_id"), ("rule_eval_props", "rule", "'low'", "CAST(event_id AS VARCHAR)", "rule_id"))
QUERIES["all_findings"] = flagship
ORACLE_SQL["all_findings"] = " UNION ALL ".join(f"SELECT '{k}' AS kind, {sev} AS severity, {sub} AS subject, {det} AS detail FROM ({ORACLE_SQL[q]})" for q, k, sev, sub, det in _FLAG_SQL)
