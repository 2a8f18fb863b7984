"""Operators that have no registered query, or whose query is too small, lose nothing in silence."""

from __future__ import annotations

import io
import tarfile

import pytest
from pyspark.sql import functions as F

from palisark.functions import formats
from palisark.operators import graph, image, vulnerabilities


def layer(names):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w") as tar:
        for name in names:
            member = tarfile.TarInfo(name)
            member.size = 1
            tar.addfile(member, io.BytesIO(b"x"))
    return out.getvalue()


@pytest.mark.parametrize("limit, most", [("MAX_FILES", 3), ("MAX_LAYER_BYTES", 1000)])
def test_layers_beyond_a_limit_are_errors(spark, monkeypatch, limit, most):
    content = layer(["a", "b", "c", ".wh.d"])
    layers = spark.createDataFrame([("i", 0, content), ("i", 1, None)], "image string, layer int, content binary")
    files, removals = image.read_layers(layers)
    assert files.count() == 3 and removals.count() == 1
    monkeypatch.setattr(image, limit, most)
    with pytest.raises(Exception, match="more than"):
        image.read_layers(layers)[0].count()


def test_paths_of_more_than_fifty_hops(spark):
    node = lambda k: f"n{k:02}"
    links = spark.createDataFrame([("f", node(k), node(k + 1)) for k in range(53)], "source_file string, source string, target string")
    ends = [spark.createDataFrame([("f", node(k))], "source_file string, id string") for k in (0, 53)]
    assert [(r.hops, r.path) for r in graph.shortest_paths(links.coalesce(1), *ends).collect()] == [(53, [node(k) for k in range(54)])]


def test_attack_paths_in_blocks_equal_those_at_once(spark):
    import random

    rng = random.Random(6)
    zones = ["internet", "dmz", "private", "private", "data"]
    nodes = [(f, f"{f}{i:02}", rng.choice(zones)) for f in "ab" for i in range(40)]
    links = [(f, f"{f}{rng.randrange(40):02}", f"{f}{rng.randrange(40):02}") for f in "ab" for _ in range(45)]
    threats = [(f, f"{f}{rng.randrange(40):02}", rng.randrange(5)) for f in "ab" for _ in range(40)]
    tables = [
        spark.createDataFrame(nodes, "source_file string, id string, trust_zone string"), spark.createDataFrame(links, "source_file string, source string, target string"),
        spark.createDataFrame(threats, "source_file string, resource_address string, sev_rank int"),
    ]

    def expected(f):
        rank = {}
        for g, i, r in threats:
            rank[i] = max(rank.get(i, r), r)
        near = {}
        for g, a, b in links:
            if a != b:
                near.setdefault(a, set()).add(b), near.setdefault(b, set()).add(a)
        out = []
        for _, s, z in nodes:
            if s[0] != f or z not in ("internet", "dmz") or s not in rank:
                continue
            parent, level = {s: None}, [s]
            while level:
                new = {}
                for a in sorted(level):
                    for b in near.get(a, ()):
                        if b not in parent:
                            new.setdefault(b, a)
                parent |= new
                level = list(new)
            for _, t, y in nodes:
                if y == "data" and t in rank and t in parent and t != s:
                    path = [t]
                    while parent[path[0]]:
                        path.insert(0, parent[path[0]])
                    out.append((-max(rank.get(x, -1) for x in path), s, t, path))
        return [(f, k, p) for k, (_, _, _, p) in enumerate(sorted(out)[:5], 1)]

    want = expected("a") + expected("b")
    assert len(want) >= 6
    for at_once in (2, 100):
        got = graph.attack_paths(*tables, at_once=at_once).orderBy("source_file", "path_no").collect()
        assert [(r.source_file, r.path_no, r.path) for r in got] == want


def test_grid_places_every_node(spark):
    """The ranges that nodes are counted in are those that they are placed in, though they are cut by sampling."""
    nodes = spark.range(100_000).selectExpr("id", "id % 3 as zone", "id as ord", "sha2(string(id), 256) as name")
    size = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    old = spark.conf.get(size)
    try:
        spark.conf.set(size, "16k")  # else few rows are one range
        right = (F.col("col") == F.floor(F.col("id") / 3) % 5) & (F.col("row_no") == F.floor(F.floor(F.col("id") / 3) / 5))
        placed = formats.layout_grid(nodes).agg(F.count("*"), F.count_if(right), F.max("name")).first()
    finally:
        spark.conf.set(size, old)
    assert placed[:2] == (100_000, 100_000)


def test_os_versions_are_read_before_packages_meet_advisories(spark):
    """Each version's key is made once, however many advisories a package has."""
    packages = spark.createDataFrame([("i", "p", "2.10", "", 0, "", "")], "image string, name string, version string, release string, epoch int, source_name string, source_version string")
    info = spark.createDataFrame([("i", "debian", "12", "dpkg")], "image string, family string, version string, pkg_manager string")
    fixes = ["2.9", "2.11", "", None, "2.10", "x"]
    known = spark.createDataFrame([(f"C{i}", "debian", "12", "p", v, "low", 0.0, "s") for i, v in enumerate(fixes)], "id string, os_family string, os_version string, package string, version_fixed string, severity string, cvss_score double, summary string")
    found = vulnerabilities.os_findings(packages, info, known)
    assert sorted(r.cve_id for r in found.collect()) == ["C1", "C2", "C3", "C5"]
    assert "RLIKE" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_entries_are_read_before_dependencies_meet_them(spark):
    deps = spark.createDataFrame([("f", "p", "1.0", "npm")], "source_file string, name string, version string, ecosystem string")
    entry = ("G1", "npm", "p", "", "2.0", "unrated", 7.5, "s", '["X","CVE-1"]')
    vulns = spark.createDataFrame([entry], "id string, ecosystem string, package string, version_introduced string, version_fixed string, severity string, cvss_score double, summary string, aliases string")
    found = vulnerabilities.dependency_findings(deps, vulns)
    assert [(r.cve_id, r.severity) for r in found.collect()] == [("CVE-1", "high")]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "from_json" not in plan[: plan.index("Join")]
