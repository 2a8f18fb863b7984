"""Report formats. A document is a table of lines in order: heads and feet are text, and what a report lists is made where
its rows are, so that a report of any size passes no driver. ``write`` puts it into files that follow one another."""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palisark import dims
from palisark.operators.ordering import numbered
from palisark.session import small_side, written

GRID_COLUMNS = 5
TOOL, VERSION = "palisark", "0.1.0"
#: Fixed values of the formats.
PURL_TYPES = {"npm": "npm", "pypi": "pypi", "go": "golang", "crates.io": "cargo", "rubygems": "gem", "packagist": "composer"}
SARIF_LEVEL = {"critical": "error", "high": "error", "medium": "warning", "low": "note", "info": "note"}
SARIF_SCHEMA = "https://raw.githubusercontent.com/oasis-tcs/sarif-spec/main/sarif-2.1/schema/sarif-schema-2.1.0.json"
BITBUCKET_SEVERITY = {"critical": "CRITICAL", "high": "HIGH", "medium": "MEDIUM", "low": "LOW", "info": "LOW"}
NAVIGATOR_COLORS = {"critical": "#ff0000", "high": "#ff6600", "medium": "#ffcc00", "low": "#66ccff", "info": "#cccccc"}
NAVIGATOR_SCORES = {"critical": 100, "high": 75, "medium": 50, "low": 25, "info": 10}
SUMMARY_CHARS, DETAIL_CHARS = 450, 2000
THREAT_FIELDS = (
    "id", "title", "description", "stride_category", "severity", "source", "resource_type", "resource_address", "mitigation", "rule_id", "confidence",
    "metadata", "mitre_techniques", "mitre_tactics",
)


def purl(ecosystem: Column, name: Column, version: Column) -> Column:
    """pkg:type/name@version, the name with its scope or module path as it is."""
    kind = F.coalesce(F.try_element_at(dims.literal_map(PURL_TYPES), ecosystem), ecosystem)
    return F.concat(F.lit("pkg:"), kind, F.lit("/"), name, F.lit("@"), F.coalesce(version, F.lit("")))


def layout_grid(nodes: DataFrame, by: str = "zone", order: str = "ord") -> DataFrame:
    """Column and row of each node in its zone's grid, in input order.

    Numbers are counted in two steps: within ranges of the order, and the ranges before; so a zone of any size is
    spread over tasks, not sorted in one. The ranges are written once: cut anew for each step, they could differ.
    """
    at = F.row_number().over(W.partitionBy(by, "__part").orderBy(order)) - 1
    ranged = written(nodes.repartitionByRange(order).withColumn("__part", F.spark_partition_id()), "ranges")
    sizes = ranged.groupBy(by, "__part").agg(F.count("*").alias("__n"))
    before = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(W.partitionBy(by).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    i = F.col("__i") + F.col("__before")
    placed = ranged.withColumn("__i", at).join(before.drop("__n"), [by, "__part"])
    return placed.withColumns({"col": (i % GRID_COLUMNS).cast("long"), "row_no": F.floor(i / GRID_COLUMNS).cast("long")}).drop("__part", "__i", "__before")


def pascal_case(text: Column) -> Column:
    """Words, between white space, underscores or hyphens, with a capital and small letters, put together."""
    words = F.filter(F.split(text, r"[\s_\-]+"), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.lower(F.substring(w, F.lit(2), F.length(w))))), "")


def artifact_uri(address: Column) -> Column:
    """An address without the characters that URIs don't have."""
    return F.regexp_replace(address, r"[^A-Za-z0-9_./:@\-]", "")


def escape_markdown(text: Column) -> Column:
    """What would make links, tags or code gets a backslash."""
    return F.regexp_replace(text, r"([<>\[\]()`])", r"\\$1")


def technique_text(ids: Column) -> Column:
    """Technique ids with their names, an unknown one as it is; '-' for none."""
    names = dims.literal_map(dims.TECHNIQUE_NAMES)
    told = F.transform(ids, lambda t: F.coalesce(F.concat(t, F.lit(": "), F.try_element_at(names, t)), t))
    return F.when(F.size(told) > 0, F.array_join(told, ", ")).otherwise("-")


# Documents


def document(spark: SparkSession, *sections: str | DataFrame, separator: str = ",") -> DataFrame:
    """Lines in order (section, n, line): a text is a line; of a table with n and line, all lines but n = 0 follow a separator."""
    parts = []
    for i, s in enumerate(sections):
        if isinstance(s, str):
            s = spark.createDataFrame([(0, s)], "n long, line string")
        else:
            s = s.select("n", F.concat(F.when(F.col("n") > 0, separator).otherwise(""), "line").alias("line"))
        parts.append(s.select(F.lit(i).alias("section"), "n", "line"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.orderBy("section", "n")


def write(lines: DataFrame, path: str) -> None:
    """Writes a document's lines as text files in ``path``; read in the order of their names they are the document."""
    lines.select("line").write.text(path)


def _dumps(x: object) -> str:
    return json.dumps(x, separators=(",", ":"))


def _severity_counts(threats: DataFrame) -> dict[str, int]:
    """All severities, worst first, with their counts."""
    found = {r["severity"]: r["n"] for r in threats.groupBy("severity").agg(F.count("*").alias("n")).collect()}
    return {s: found.get(s, 0) for s in reversed(dims.SEVERITIES)}


def json_report(threats: DataFrame, report: dict, order: tuple[str, ...] = ("ord",)) -> DataFrame:
    """The fields of ``report``, counts by severity, and the threats in order, as a document."""
    counts = _severity_counts(threats)
    head = _dumps(report | {"summary": counts, "total_threats": sum(counts.values())})[:-1] + ',"threats":['
    fields = [c for c in THREAT_FIELDS if c in threats.columns]
    return document(threats.sparkSession, head, numbered(threats, *order).withColumn("line", F.to_json(F.struct(*fields))), "]}")


def sarif_rules(threats: DataFrame, order: str = "ord") -> DataFrame:
    """One row for each rule_id with the ``order`` of its first finding, numbered by it from 0 (rule_index)."""
    return numbered(threats.groupBy("rule_id").agg(F.min(order).alias(order)), order, "rule_id", name="rule_index")


def sarif_results(threats: DataFrame) -> DataFrame:
    """``threats`` (with rule_index) with ``line``: its SARIF result."""
    uri = artifact_uri(F.col("resource_address"))
    text = F.concat(
        F.lit("["), F.upper("stride_category"), F.lit("] "), "title", F.lit("\n\n"), F.trim(F.coalesce("description", F.lit(""))), F.lit("\n\nResource: "), "resource_address",
        F.lit(" ("), "resource_type", F.lit(")"),
    )
    place = F.struct(
        F.struct(F.struct(uri.alias("uri"), F.lit("%SRCROOT%").alias("uriBaseId")).alias("artifactLocation")).alias("physicalLocation"),
        F.array(F.struct(uri.alias("fullyQualifiedName"), F.lit("resource").alias("kind"))).alias("logicalLocations"),
    )
    level = F.element_at(dims.literal_map(SARIF_LEVEL), F.col("severity"))
    more = F.struct("severity", "stride_category", "source", "confidence", "resource_type")
    body = F.struct(
        rule_key().alias("ruleId"), F.col("rule_index").alias("ruleIndex"), level.alias("level"), F.struct(text.alias("text")).alias("message"), F.array(place).alias("locations"),
        more.alias("properties"),
    )
    return threats.withColumn("line", F.to_json(body))


def rule_key() -> Column:
    return F.coalesce(F.nullif("rule_id", F.lit("")), "id")


def _sarif_rule() -> Column:
    """The rule object of a threat that is the first of its rule."""
    fix = F.trim(F.coalesce("mitigation", F.lit("")))
    tags = F.concat(
        F.array(F.lit("security"), F.concat(F.lit("stride/"), "stride_category"), F.concat(F.lit("source/"), "source")),
        F.transform(F.coalesce("mitre_techniques", F.array().cast("array<string>")), lambda t: F.concat(F.lit("mitre/"), t)),
    )
    level = F.element_at(dims.literal_map(SARIF_LEVEL), F.col("severity"))
    return F.to_json(F.struct(
        F.col("rule_key").alias("id"), pascal_case(F.col("title")).alias("name"), F.struct(F.col("title").alias("text")).alias("shortDescription"),
        F.struct(F.trim(F.coalesce("description", F.lit(""))).alias("text")).alias("fullDescription"),
        F.struct(F.when(fix != "", fix).otherwise("See description.").alias("text"), F.when(fix != "", F.concat(F.lit("**Mitigation**: "), fix)).otherwise("").alias("markdown")).alias("help"),
        F.struct(level.alias("level")).alias("defaultConfiguration"), F.struct(tags.alias("tags")).alias("properties"),
    ))


def sarif(threats: DataFrame, order: tuple[str, ...] = ("ord",), tool: str = TOOL, version: str = VERSION, uri: str = "") -> DataFrame:
    """A SARIF 2.1.0 document. A rule (or a threat without one) is described as its first threat has it; ruleIndex is its
    place among the rules, which are numbered like the results: by partition, and by prefix sums over partitions."""
    rows = numbered(threats.withColumn("rule_key", rule_key()), *order)
    first = rows.groupBy("rule_key").agg(F.min_by(F.struct(*threats.columns), "n").alias("t"), F.min("n").alias("first"))
    rules = small_side(numbered(first, "first", name="rule_index").select("rule_key", "rule_index", "t.*"), "sarif-rules")
    results = sarif_results(rows.join(rules.select("rule_key", "rule_index"), "rule_key"))
    driver = _dumps({"name": tool, "version": version} | ({"informationUri": uri} if uri else {}))[:-1]
    head = f'{{"$schema":"{SARIF_SCHEMA}","version":"2.1.0","runs":[{{"tool":{{"driver":{driver},"rules":['
    listed = rules.select(F.col("rule_index").alias("n"), _sarif_rule().alias("line"))
    tail = '],"invocations":[{"executionSuccessful":true,"toolExecutionNotifications":[]}]}]}'
    return document(threats.sparkSession, head, listed, ']}},"results":[', results, tail)


def bitbucket_annotations(threats: DataFrame) -> DataFrame:
    """``threats`` with ``line``: its Code Insights annotation."""
    severity = F.element_at(dims.literal_map(BITBUCKET_SEVERITY), F.col("severity"))
    body = F.struct(
        F.col("id").alias("external_id"), F.lit("VULNERABILITY").alias("annotation_type"), F.left("title", F.lit(SUMMARY_CHARS)).alias("summary"),
        F.left(F.trim(F.coalesce("description", F.lit(""))), F.lit(DETAIL_CHARS)).alias("details"), severity.alias("severity"), F.col("resource_address").alias("path"), F.lit(1).alias("line"),
    )
    return threats.withColumn("line", F.to_json(body))


def bitbucket(threats: DataFrame, scanned: int, order: tuple[str, ...] = ("ord",), title: str = f"{TOOL} threat model") -> DataFrame:
    """A Code Insights report and its annotations, as a document: FAILED if anything is critical or high."""
    counts = _severity_counts(threats)
    total = sum(counts.values())
    told = {"Total Threats": total, "Critical": counts["critical"], "High": counts["high"], "Medium": counts["medium"], "Resources Scanned": scanned}
    report = {
        "title": title, "details": f"Scanned {scanned} resources, found {total} threats.", "report_type": "SECURITY", "reporter": TOOL,
        "result": "FAILED" if counts["critical"] + counts["high"] else "PASSED", "data": [{"title": k, "type": "NUMBER", "value": v} for k, v in told.items()],
    }
    return document(threats.sparkSession, f'{{"report":{_dumps(report)},"annotations":[', bitbucket_annotations(numbered(threats, *order)), "]}")


def markdown(threats: DataFrame, order: tuple[str, ...] = ("ord",), title: str = "Threat report") -> DataFrame:
    """Counts by severity, then the threats of each STRIDE category, worst first, as a document."""
    counts = _severity_counts(threats)
    head = "\n".join([f"# {title}", "", "| Severity | Count |", "|---|---|", *(f"| {s} | {n} |" for s, n in counts.items())])
    rows = numbered(threats.withColumn("worst", -dims.severity_rank(F.col("severity"))), "stride_category", "worst", *order)
    first = rows.groupBy("stride_category").agg(F.min("n").alias("n")).withColumn("begins", F.lit(True))  # six categories
    rows = rows.join(F.broadcast(first), ["stride_category", "n"], "left")
    heading = F.when(F.col("begins"), F.concat(F.lit("\n## "), F.initcap(F.replace("stride_category", F.lit("_"), F.lit(" "))), F.lit("\n"))).otherwise("")
    text = lambda c: escape_markdown(F.coalesce(c, F.lit("")))
    fix = F.when(F.coalesce("mitigation", F.lit("")) != "", F.concat(F.lit("\n\nMitigation: "), text("mitigation"))).otherwise("")
    place = F.concat(F.lit("\n\nResource: `"), F.replace("resource_address", F.lit("`"), F.lit("")), F.lit("`\n\n"))
    line = F.concat(heading, F.lit("\n### \\["), F.upper("severity"), F.lit("\\] "), text("title"), place, text("description"), fix)
    return document(threats.sparkSession, head, rows.withColumn("line", line), separator="\n")


def navigator_layer(techniques: Iterable[dict], n_threats: int = 0, input_file: str = "", name: str = f"{TOOL} threat model") -> str:
    """An ATT&CK Navigator layer from ``reports.technique_summary`` rows, of which there are as many as known techniques at most."""
    cells = [
        {
            "techniqueID": t["technique_id"], "tactic": "", "score": NAVIGATOR_SCORES[t["max_severity"]], "color": NAVIGATOR_COLORS[t["max_severity"]],
            "comment": f"{t['n']} finding(s): " + "; ".join(t["first_titles"]), "enabled": True,
            "metadata": [{"name": "findings", "value": str(t["n"])}, {"name": "max_severity", "value": t["max_severity"]}],
        }
        for t in sorted(techniques, key=lambda t: t["technique_id"])
    ]
    shown = ("critical", "high", "medium", "low", "info")
    return json.dumps({
        "name": name, "versions": {"attack": "16", "navigator": "5.1", "layer": "4.5"}, "domain": "enterprise-attack",
        "description": f"Scan of {input_file}: {n_threats} threats mapped to {len(cells)} ATT&CK techniques.",
        "filters": {"platforms": ["IaaS"]}, "sorting": 3,
        "layout": {"layout": "side", "aggregateFunction": "max", "showID": True, "showName": True, "showAggregateScores": True, "countUnscored": False},
        "hideDisabled": False, "techniques": cells, "gradient": {"colors": [NAVIGATOR_COLORS[s] for s in ("info", "medium", "high", "critical")], "minValue": 0, "maxValue": 100},
        "legendItems": [{"label": s.capitalize(), "color": NAVIGATOR_COLORS[s]} for s in shown], "showTacticRowBackground": True, "tacticRowBackground": "#205b8f",
        "selectTechniquesAcrossTactics": True, "selectSubtechniquesWithParent": True, "selectVisibleTechniques": False,
    }, indent=2)


def components(dependencies: DataFrame) -> DataFrame:
    """CycloneDX components of dependencies that have a name and a version: their columns, purl, and component as JSON."""
    ref = purl(F.col("ecosystem"), F.col("name"), F.col("version"))
    license_ = F.when(F.coalesce("license", F.lit("")) != "", F.array(F.struct(F.struct(F.col("license").alias("id")).alias("license"))))
    known = F.array(F.struct(F.lit("ecosystem").alias("name"), F.col("ecosystem").alias("value")))
    body = F.struct(F.lit("library").alias("type"), ref.alias("bom-ref"), "name", "version", ref.alias("purl"), license_.alias("licenses"), known.alias("properties"))
    return dependencies.where("name <> '' and version <> ''").select("*", ref.alias("purl"), F.to_json(body).alias("component"))


def cyclonedx(dependencies: DataFrame, vulnerabilities: DataFrame | None = None, source: str = "", timestamp: str = "", order: tuple[str, ...] = ("source_file", "ord")) -> DataFrame:
    """A CycloneDX 1.5 document of dependencies and vulnerability findings; ratings where a score is known.

    Its serial number follows from the components: their count and the sum of their hashes.
    """
    import hashlib
    import uuid

    parts = numbered(components(dependencies), *order)
    told = parts.agg(F.count("*").alias("n"), F.sum(F.xxhash64("component").cast("decimal(38,0)")).alias("h")).first()
    serial = uuid.UUID(hashlib.sha256(f"{told['n']} {told['h']}".encode()).hexdigest()[:32])
    meta = {"tools": {"components": [{"type": "application", "name": TOOL, "version": VERSION}]}, "component": {"type": "application", "name": source or "unknown", "bom-ref": "root-component"}}
    meta = ({"timestamp": timestamp} if timestamp else {}) | meta
    head = _dumps({"bomFormat": "CycloneDX", "specVersion": "1.5", "serialNumber": f"urn:uuid:{serial}", "version": 1, "metadata": meta})[:-1] + ',"components":['
    listed = parts.withColumn("line", F.col("component"))
    alone = parts.withColumn("line", F.to_json(F.struct(F.col("purl").alias("ref"), F.array().cast("array<string>").alias("dependsOn"))))
    sections: list[str | DataFrame] = [head, listed, '],"dependencies":[', alone]
    if vulnerabilities is not None:
        ref = purl(F.col("ecosystem"), F.col("package_name"), F.col("package_version"))
        rating = F.when(F.col("cvss_score") > 0, F.array(F.struct(F.col("cvss_score").alias("score"), F.col("severity"), F.lit("CVSSv3").alias("method"))))
        body = F.struct(F.col("cve_id").alias("id"), F.col("title").alias("description"), F.array(F.struct(ref.alias("ref"))).alias("affects"), rating.alias("ratings"))
        sections += ['],"vulnerabilities":[', numbered(vulnerabilities, "cve_id", "package_name", "package_version", "id").withColumn("line", F.to_json(body))]
    return document(dependencies.sparkSession, *sections, "]}")


def text_table(rows: Iterable[dict], widths: dict[str, int]) -> str:
    """Rows, worst first, in columns of fixed width."""
    rank = {s: i for i, s in enumerate(dims.SEVERITIES)}
    line = lambda get: "  ".join(str(get(c))[:n].ljust(n) for c, n in widths.items()).rstrip()
    body = sorted(rows, key=lambda r: -rank[r["severity"]])
    return "\n".join([line(str.upper), *[line(lambda c, r=r: r.get(c) or "") for r in body]])


def svg(nodes: Iterable[dict], edges: Iterable[dict], paths: Iterable[dict] = (), threats: Iterable[dict] = (), cell: int = 150) -> str:
    """A diagram: a lane for each trust zone with its nodes in rows of five, edges, attack paths in red, a badge with the
    number of threats on each node that has some, a legend of severities, and a table of ``threats``, worst first.

    Nodes may have n_threats, max_severity and titles (``graph.threat_counts``), which a node's tooltip tells.
    """
    from html import escape

    nodes, places, parts, top = list(nodes), {}, [], 20
    width = GRID_COLUMNS * cell + 40
    for zone in dims.ZONES:
        own = [n for n in nodes if n["trust_zone"] == zone]
        if not own:
            continue
        rows = -(-len(own) // GRID_COLUMNS)
        parts.append(f'<rect class="lane" x="10" y="{top}" width="{GRID_COLUMNS * cell + 20}" height="{rows * 90 + 30}" fill="#f4f4f8" stroke="#99a"/>')
        parts.append(f'<text x="18" y="{top + 18}" font-size="13">{zone}</text>')
        for i, n in enumerate(own):
            x, y = 20 + i % GRID_COLUMNS * cell, top + 30 + i // GRID_COLUMNS * 90
            places[n["id"]] = (x + cell // 2 - 10, y + 30)
            told = escape("\n".join([n["id"], *(n.get("titles") or ())]))
            parts.append(f'<g class="node"><title>{told}</title><rect x="{x}" y="{y}" width="{cell - 20}" height="60" rx="6" fill="#fff" stroke="#445"/>')
            parts.append(f'<text x="{x + 8}" y="{y + 34}" font-size="10">{escape(n["id"][:22])}</text>')
            if n.get("n_threats"):
                color = NAVIGATOR_COLORS.get(n.get("max_severity") or "info", "#cccccc")
                parts.append(f'<circle class="badge" cx="{x + cell - 24}" cy="{y + 4}" r="10" fill="{color}"/>')
                parts.append(f'<text x="{x + cell - 24}" y="{y + 8}" font-size="10" text-anchor="middle">{n["n_threats"]}</text>')
            parts.append("</g>")
        top += rows * 90 + 50
    hot = {frozenset(p) for path in paths for p in zip(path["path"], path["path"][1:])}
    for e in edges:
        if e["source"] in places and e["target"] in places:
            (a, b), (c, d) = places[e["source"]], places[e["target"]]
            color = "#c00" if frozenset((e["source"], e["target"])) in hot else "#888"
            parts.append(f'<path class="edge {e["edge_type"]}" d="M{a},{b} Q{(a + c) // 2},{min(b, d) - 30} {c},{d}" fill="none" stroke="{color}"/>')
    parts.append('<g class="legend">')
    for i, s in enumerate(reversed(dims.SEVERITIES)):
        parts.append(f'<circle cx="{24 + i * 90}" cy="{top + 8}" r="6" fill="{NAVIGATOR_COLORS[s]}"/><text x="{36 + i * 90}" y="{top + 12}" font-size="10">{s}</text>')
    parts.append("</g>")
    top += 30
    rank = {s: i for i, s in enumerate(dims.SEVERITIES)}
    for t in sorted(threats, key=lambda t: -rank[t["severity"]]):
        line = "  ".join([t["severity"], t["resource_address"][:30], t["title"][:60]])
        parts.append(f'<text class="threat" x="18" y="{top + 12}" font-size="10">{escape(line)}</text>')
        top += 18
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{top}">' + "".join(parts) + "</svg>"
