"""The upsert sink: what a load rewrites, what a failed one leaves, versions and the order of rows."""

from __future__ import annotations

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from palisark.operators import store

SCHEMA = "id string, package string, severity string, n long"


@pytest.fixture
def made(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    store.create(spark, path, SCHEMA, ("id", "package"), buckets=32)
    return path


def rows_of(spark, ids, severity, load_ord=0):
    return spark.createDataFrame([(f"V{i}", "p", severity, i, load_ord) for i in ids], SCHEMA + ", load_ord long")


def manifest(path):
    return json.loads(sorted(Path(path.removeprefix("file://")).glob("manifests/*.json"))[-1].read_text())["data"]


def test_a_small_load_rewrites_its_buckets_only(spark, made):
    assert len(store.load(spark, made, rows_of(spark, range(3000), "low"))) == 32
    before = manifest(made)
    touched = store.load(spark, made, rows_of(spark, range(0, 3000, 1000), "high"))
    after = manifest(made)
    assert 1 <= len(touched) <= 3 and {int(k) for k in after if after[k] != before[k]} == set(touched)
    found = {r.id: r.severity for r in store.read(spark, made).collect()}
    assert len(found) == 3000 and {k for k, v in found.items() if v == "high"} == {"V0", "V1000", "V2000"}
    assert store.read(spark, made, 1).where("severity = 'high'").count() == 0


def test_a_failed_load_leaves_the_old_state(spark, made):
    store.load(spark, made, rows_of(spark, range(100), "low"))
    bad = rows_of(spark, range(100), "high").withColumn("severity", F.when(F.col("n") == 77, F.raise_error(F.lit("broken"))).otherwise(F.col("severity")))
    with pytest.raises(Exception, match="broken"):
        store.load(spark, made, bad)
    assert {r.severity for r in store.read(spark, made).collect()} == {"low"}
    store.load(spark, made, rows_of(spark, range(10), "high"))
    assert store.vacuum(spark, made) >= 1
    assert store.read(spark, made).where("severity = 'high'").count() == 10 and store.read(spark, made).count() == 100
    with pytest.raises(store.StoreError):
        store.read(spark, made, 0)


def test_of_two_loads_at_once_one_fails(spark, made, monkeypatch):
    real = store._manifest
    store.load(spark, made, rows_of(spark, range(5), "low"))
    monkeypatch.setattr(store, "_manifest", lambda s, p, v=None: real(s, p, 0))  # this one began before the other ended
    with pytest.raises(store.StoreError):
        store.load(spark, made, rows_of(spark, range(5), "high"))
    monkeypatch.undo()
    assert {r.severity for r in store.read(spark, made).collect()} == {"low"}


def test_order_nulls_and_columns(spark, made):
    new = spark.createDataFrame([("a", None, "low", 1), ("a", None, "high", 2), (None, None, "info", 1), ("a", "p", "info", 1)], "id string, package string, severity string, load_ord long")
    store.load(spark, made, new.withColumn("bucket", F.lit("x")).withColumn("place", F.lit("y")))
    assert sorted((str(r.id), str(r.package), r.severity, r.n) for r in store.read(spark, made).collect()) == [("None", "None", "info", None), ("a", "None", "high", None), ("a", "p", "info", None)]
    assert store.load(spark, made, new.where("false")) == []
    with pytest.raises(store.StoreError):
        store.create(spark, made, SCHEMA, ("id",))
    with pytest.raises(store.StoreError):
        store.read(spark, made + "-none")
