"""Files on disk to resources, graph and findings."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from palisark.operators import graph, rules
from palisark.sources import files, iac, lockfiles, readers

PLAN = {
    "format_version": "1.0",
    "planned_values": {
        "root_module": {
            "resources": [
                {"address": "aws_s3_bucket.b", "mode": "managed", "type": "aws_s3_bucket", "name": "b", "provider_name": "aws", "values": {"acl": "public-read"}},
                {"address": "aws_vpc.v", "mode": "managed", "type": "aws_vpc", "name": "v", "provider_name": "aws", "values": {}},
            ],
            "child_modules": [
                {
                    "address": "module.m",
                    "resources": [{"address": "module.m.aws_subnet.s", "mode": "managed", "type": "aws_subnet", "name": "s", "provider_name": "aws", "values": {"vpc_id": "v"}}],
                }
            ],
        }
    },
    "configuration": {"root_module": {"resources": [{"address": "aws_s3_bucket.b", "type": "aws_s3_bucket", "name": "b", "expressions": {"x": {"references": ["aws_vpc.v"]}}}]}},
}
STACK = """
AWSTemplateFormatVersion: '2010-09-09'
Resources:
  Bucket:
    Type: AWS::S3::Bucket
    Properties:
      BucketName: !Ref Name
    DependsOn: Other
  Other:
    Type: AWS::EC2::Instance
"""
MANIFEST = """
apiVersion: apps/v1
kind: Deployment
metadata:
  name: web
spec:
  template:
    spec:
      containers:
      - name: c
        image: nginx:latest
        securityContext:
          privileged: true
---
apiVersion: v1
kind: Service
metadata:
  name: s
spec:
  type: LoadBalancer
"""
DOCKERFILE = "FROM ubuntu:latest\nENV API_KEY=abc\nRUN apt-get update && \\\n    apt-get install -y curl\nEXPOSE 22\n"
HCL = 'resource "aws_s3_bucket" "logs" {\n  bucket = "x"\n  versioning {\n    enabled = true\n  }\n}\n'


@pytest.fixture
def folder(tmp_path):
    made = {
        "a/plan.json": json.dumps(PLAN), "b/stack.yml": STACK, "c/dep.yaml": MANIFEST, "d/Dockerfile": DOCKERFILE, "e/main.tf": HCL, "node_modules/x/main.tf": HCL,
        ".hidden/main.tf": HCL, "f/broken.json": "{", "f/requirements.txt": "a==1\n",
    }
    for name, text in made.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    return str(tmp_path)


def test_walk_counts_kinds_and_skips_folders(spark, folder):
    found = files.walk(spark, folder)
    assert tuple(files.totals(found).first()) == (7, 1, 0, 6)
    assert files.walk(spark, folder, max_bytes=20).count() == 2


def test_resources_of_every_format(spark, folder):
    found = {(r.source_file, r.address): r for r in iac.resources(files.walk(spark, folder)).withColumn("p", F.to_json("properties")).collect()}
    assert {a for f, a in found if f == "a/plan.json"} == {"aws_s3_bucket.b", "aws_vpc.v", "module.m.aws_subnet.s"}
    assert found["a/plan.json", "aws_s3_bucket.b"].dependencies == ["aws_vpc.v"]
    assert found["a/plan.json", "module.m.aws_subnet.s"].module == "module.m"
    assert found["b/stack.yml", "Bucket"].resource_type == "aws_s3_bucket" and found["b/stack.yml", "Bucket"].dependencies == ["Other"]
    assert {a for f, a in found if f == "c/dep.yaml"} == {"kubernetes_deployment.default.web", "kubernetes_service.default.s"}
    assert [a for f, a in sorted(found) if f == "d/Dockerfile"][-1] == "dockerfile.run.2" and len([1 for f, _ in found if f == "d/Dockerfile"]) == 5
    assert json.loads(found["e/main.tf", "aws_s3_bucket.logs"].p)["versioning"] == [{"enabled": True}]


def test_every_file_is_read_or_accounted_for(spark, folder):
    got = iac.read(files.walk(spark, folder))
    told = {r.source_file: r.format_type for r in got.files.collect()}
    assert told == {"a/plan.json": "terraform_plan", "b/stack.yml": "cloudformation", "c/dep.yaml": "kubernetes", "d/Dockerfile": "dockerfile", "e/main.tf": "terraform_hcl"}
    [broken] = got.quarantine.collect()
    assert (broken.source_file, broken.parser) == ("f/broken.json", "text") and "JSONDecodeError" in broken.error
    assert files.too_large(spark, folder, 150).select("source_file").distinct().count() + files.walk(spark, folder, 150).count() == 7


def test_what_one_format_cant_read_the_next_one_reads(spark, tmp_path):
    for name, text in {"one.picky": "good", "two.picky": "bad", "three.picky": "worse", "four.json": "[1]", "five.json": "{nothing", "six.tf": HCL}.items():
        (tmp_path / name).write_text(text)
    def reader(kind, refuses):
        def parse(rows):
            refused = F.when(F.col("text").isin(*refuses), f"{kind} can't read this")
            return rows.select(
                "source_file", F.lit(0).alias("ord"), F.lit(kind).alias("resource_type"), F.concat(F.lit(kind + "."), "source_file").alias("address"), F.lit("n").alias("name"), F.lit("p").alias("provider"),
                F.parse_json(F.lit("{}")).alias("properties"), F.array().cast("array<string>").alias("dependencies"), F.lit("").alias("module"), F.lit("").alias("source_location"), refused.alias("error"),
            )

        return parse

    picky = lambda p: p.endswith(".picky") | p.endswith("five.json")
    files.register_format("first", picky, reader("first", ["bad", "worse", "{nothing"]), 1, structured=False)
    files.register_format("second", picky, reader("second", ["worse"]), 2, structured=False)
    try:
        got = iac.read(files.walk(spark, str(tmp_path)))
        assert {r.source_file: r.format_type for r in got.files.collect()} == {"one.picky": "first", "two.picky": "second", "five.json": "second", "six.tf": "terraform_hcl"}
        assert {(r.resource_type, r.source_file) for r in got.resources.collect()} == {("first", "one.picky"), ("second", "two.picky"), ("second", "five.json"), ("aws_s3_bucket", "six.tf")}
        assert sorted((r.source_file, r.parser, r.error) for r in got.quarantine.collect()) == [
            ("four.json", "", "no format fits"), ("three.picky", "first", "first can't read this"), ("three.picky", "second", "second can't read this"),
        ]
        from palisark import scan

        left = scan.unread(spark, str(tmp_path), ("x" * 501, "short"))
        assert sorted({r.parser for r in left.collect()}) == ["", "first", "second", "secrets"]
    finally:
        files.FORMATS.pop("first"), files.FORMATS.pop("second")


def test_edges_cross_zones(spark, folder):
    resources = iac.resources(files.walk(spark, folder))
    nodes = graph.nodes(resources)
    edges = graph.edges(resources, nodes)
    assert {(r.source, r.target, r.edge_type, r.crosses_trust_boundary) for r in edges.collect()} == {
        ("aws_s3_bucket.b", "aws_vpc.v", "dependency", True), ("module.m.aws_subnet.s", "aws_vpc.v", "containment", False), ("Bucket", "Other", "dependency", True),
    }
    assert graph.boundary_threats(edges, nodes).count() == 2


def test_built_in_rules_fire(spark, folder):
    nodes = graph.nodes(iac.resources(files.walk(spark, folder)))
    fired = {(r.resource_address, r.rule_id) for r in rules.threats(nodes, rules.load()).select("resource_address", "rule_id").collect()}
    assert ("aws_s3_bucket.b", "S3_NO_ENCRYPTION") in fired
    assert any(a == "kubernetes_deployment.default.web" for a, _ in fired)


LOCKS = {
    "package-lock.json": json.dumps({"lockfileVersion": 3, "packages": {"": {"name": "me"}, "node_modules/a": {"version": "1.0.0", "license": "MIT"}, "node_modules/a/node_modules/@s/b": {"version": "2.0.0"}}}),
    "old/package-lock.json": json.dumps({"lockfileVersion": 1, "dependencies": {"a": {"version": "1.0.0", "dependencies": {"c": {"version": "3.0.0"}}}}}),
    "yarn.lock": '# v1\n\n"@babel/core@^7.0.0", "@babel/core@^7.1.0":\n  version "7.2.0"\n\nlodash@^4.0.0:\n  version "4.17.21"\n',
    "pnpm-lock.yaml": "lockfileVersion: '6.0'\npackages:\n  /lodash@4.17.21:\n    resolution: {integrity: x}\n  /@s/b@2.0.0(peer@1.0.0):\n    dev: true\n",
    "requirements.txt": "# c\nflask==2.0.1\nrequests[security]>=2.25 ; python_version > '3'\n-r other.txt\nplain\n",
    "Pipfile.lock": json.dumps({"default": {"flask": {"version": "==2.0.1"}}, "develop": {"pytest": {"version": "==7.0"}}}),
    "poetry.lock": '[[package]]\nname = "click"\nversion = "8.0"\n',
    "go.sum": "github.com/x/y v1.2.3 h1:abc=\ngithub.com/x/y v1.2.3/go.mod h1:def=\n",
    "Cargo.lock": '[[package]]\nname = "serde"\nversion = "1.0.1"\n',
    "Gemfile.lock": "GEM\n  remote: https://rubygems.org/\n  specs:\n    rails (6.1.0)\n      actionpack (= 6.1.0)\n\nPLATFORMS\n  ruby\n",
    "composer.lock": json.dumps({"packages": [{"name": "a/b", "version": "v1.0", "license": ["MIT"]}], "packages-dev": [{"name": "c/d", "version": "2.0"}]}),
    "mix.lock": '%{\n  "jason": {:hex, :jason, "1.2.2", "abc", [:mix], [], "hexpm", "def"},\n}\n',
    "pubspec.lock": "packages:\n  http:\n    dependency: direct\n    version: '0.13.3'\n",
    "conan.lock": json.dumps({"requires": ["fmt/8.0.0#x%1", "zlib/1.2.11", 7]}),
}
EXPECTED = {
    "package-lock.json": {("a", "1.0.0", "npm"), ("@s/b", "2.0.0", "npm")},
    "old/package-lock.json": {("a", "1.0.0", "npm"), ("c", "3.0.0", "npm")},
    "yarn.lock": {("@babel/core", "7.2.0", "npm"), ("lodash", "4.17.21", "npm")},
    "pnpm-lock.yaml": {("lodash", "4.17.21", "npm"), ("@s/b", "2.0.0(peer@1.0.0)", "npm")},
    "requirements.txt": {("flask", "2.0.1", "pypi")},
    "Pipfile.lock": {("flask", "2.0.1", "pypi"), ("pytest", "7.0", "pypi")},
    "poetry.lock": {("click", "8.0", "pypi")},
    "go.sum": {("github.com/x/y", "1.2.3", "go")},
    "Cargo.lock": {("serde", "1.0.1", "crates.io")},
    "Gemfile.lock": {("rails", "6.1.0", "rubygems")},
    "composer.lock": {("a/b", "1.0", "packagist"), ("c/d", "2.0", "packagist")},
    "mix.lock": {("jason", "1.2.2", "hex")},
    "pubspec.lock": {("http", "0.13.3", "pub")},
    "conan.lock": {("zlib", "1.2.11", "conan"), ("fmt", "8.0.0", "conan")},
}


def test_lockfiles(spark):
    rows = spark.createDataFrame([*LOCKS.items(), ("x/poetry.lock", "[["), ("y/go.sum", None), ("z/package-lock.json", "")], "source_file string, text string")
    found: dict[str, set] = {}
    for r in lockfiles.dependencies(rows).collect():
        found.setdefault(r.source_file, set()).add((r.name, r.version, r.ecosystem))
    assert found == EXPECTED
    assert {(r.name, r.license) for r in lockfiles.dependencies(rows).where("license <> ''").collect()} == {("a", "MIT"), ("a/b", "MIT")}


def test_a_reader_in_sql(spark):
    def parse(name, text):
        if text == "bad":
            raise ValueError("no such thing")
        return [(w, len(w)) for w in text.split()]

    readers.register(spark, "read_words", parse, "word string, n int")
    rows = [("a", "one three"), ("b", "bad"), ("c", ""), ("d", None), ("e", "two")]
    spark.createDataFrame(rows, "source_file string, text string").repartition(3).createOrReplaceTempView("some_files")
    found = spark.sql("SELECT f.source_file, r.* FROM some_files f, LATERAL read_words(f.source_file, f.text) r").collect()
    assert sorted((r.source_file, r.word, r.n, r.error) for r in found if r.error is None) == [("a", "one", 3, None), ("a", "three", 5, None), ("e", "two", 3, None)]
    assert [(r.source_file, r.word, r.error) for r in found if r.error] == [("b", None, "ValueError: no such thing")]


def test_lock_files_in_sql(spark):
    readers.register_lockfiles(spark)
    texts = [
        ("x/requirements.txt", "# c\nFlask[async]==1.0 ; python_version>'3'\nb>=2\n-r other.txt\nC == 2.1\n"),
        ("y/package-lock.json", json.dumps({"lockfileVersion": 3, "packages": {"": {"name": "own"}, "node_modules/a": {"version": "1"}, "node_modules/a/node_modules/@s/b": {"version": "2", "license": "MIT"}}})),
        ("z/package-lock.json", "{"), ("other.txt", "a==1"),
    ]
    spark.createDataFrame(texts, "source_file string, text string").createOrReplaceTempView("lock_texts")
    found = spark.sql("SELECT source_file, r.* FROM lock_texts, LATERAL read_lockfile(source_file, text) r").collect()
    assert sorted((r.name, r.version, r.ecosystem, r.license) for r in found if not r.error) == [("@s/b", "2", "npm", "MIT"), ("C", "2.1", "pypi", ""), ("Flask", "1.0", "pypi", ""), ("a", "1", "npm", "")]
    assert [r.source_file for r in found if r.error] == ["z/package-lock.json"]


def test_dockerfiles_are_read_in_one_pass(spark):
    """Instructions and summary of a file come from the task that reads it; rows of one name are files of their own."""
    texts = {
        "a": "# FROM x\nFROM a@sha256:x AS b\nFROM img:1\nADD only\nADD https://x/id_rsa /a\nCOPY --chown=a:b s.key d\nCOPY a b\nEXPOSE 22 80/tcp x\nEXPOSE foo\nUSER  app \nHEALTHCHECK none\n",
        "b": "", "c": None, "d": "from lower\n  \n# nothing\n", "e": "RUN a \\\n  b\r\nENTRYPOINT x\rENTRYPOINT y",
    }
    found = iac.dockerfile(spark.createDataFrame(list(texts.items()), "source_file string, text string"))
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    rows = {(r.source_file, r.address): json.loads(r.p) for r in found.withColumn("p", F.to_json("properties")).collect()}
    assert {f for f, _ in rows} == {"a", "e"} and len(rows) == 15
    assert rows["a", "dockerfile.image.summary"] == {
        "has_user": True, "has_healthcheck": False, "uses_latest_tag": False, "exposed_ports": [22, 80], "base_image": "a@sha256:x", "user_value": "app", "has_workdir": False,
        "entrypoint_count": 0, "has_ssh_exposed": True, "has_privileged_port": True, "add_count": 2, "copy_without_chown": 1, "is_root_user": False,
    }
    own = {a: {k: v for k, v in p.items() if k not in ("instruction", "arguments", "line_number")} for (f, a), p in rows.items() if f == "a"}
    assert own["dockerfile.from.0"] == {"image": "a@sha256:x", "tag": "x"} and own["dockerfile.from.1"] == {"image": "img:1", "tag": "1"}
    assert own["dockerfile.add.2"] == {} and own["dockerfile.add.3"] == {"is_local_add": False, "has_sensitive_file": True}
    assert own["dockerfile.copy.4"] == {"has_sensitive_file": True, "has_chown": True} and own["dockerfile.copy.5"] == {"has_chown": False}
    assert own["dockerfile.expose.6"] == {"port": 80} and own["dockerfile.expose.7"] == {} and own["dockerfile.user.8"] == {"user": "app"}
    assert rows["e", "dockerfile.run.0"]["arguments"] == "a    b" and rows["e", "dockerfile.entrypoint.2"]["line_number"] == 3
    twice = spark.createDataFrame([("a", "FROM x"), ("a", "FROM y\nRUN z")], "source_file string, text string")
    assert sorted(r.address for r in iac.dockerfile(twice).collect()) == ["dockerfile.from.0"] * 2 + ["dockerfile.image.summary"] * 2 + ["dockerfile.run.1"]
