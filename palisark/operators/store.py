"""A keyed table in files, changed by upserts: the sink of the advisory tables.

Rows lie in a fixed number of buckets by the hash of their key. An upsert reads and rewrites the buckets that its keys
fall into, all others stay as they are, and its last step puts down a manifest that names the files of every bucket: a
reader sees the state before or after it, never one between, and a load that fails leaves nothing behind but files that
no manifest names (``vacuum`` deletes these). Manifests are numbered; of two loads that run at once the second to finish
fails, and may be tried again.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisark.session import fresh_name

BUCKETS = 64


class StoreError(RuntimeError):
    """A store that isn't there, or has been changed meanwhile."""


def _fs(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), where


def _manifests(spark: SparkSession, path: str) -> list[int]:
    fs, where = _fs(spark, f"{path}/manifests")
    if not fs.exists(where):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(where)]
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[:-5].isdigit())


def _manifest(spark: SparkSession, path: str, version: int | None = None) -> tuple[int, dict]:
    known = _manifests(spark, path)
    if not known or version is not None and version not in known:
        raise StoreError(f"no such store or version: {path}")
    version = known[-1] if version is None else version
    return version, json.loads(spark.read.text(f"{path}/manifests/{version:08}.json", wholetext=True).first()["value"])


def _commit(spark: SparkSession, path: str, version: int, manifest: dict) -> None:
    fs, made = _fs(spark, f"{path}/manifests/.{uuid.uuid4().hex}")
    out = fs.create(made)
    out.write(bytearray(json.dumps(manifest).encode()))
    out.close()
    _, there = _fs(spark, f"{path}/manifests/{version:08}.json")
    if fs.exists(there) or not fs.rename(made, there):
        fs.delete(made, False)
        raise StoreError(f"{path} was changed while this load ran")


def create(spark: SparkSession, path: str, schema: str, key: tuple[str, ...], buckets: int = BUCKETS) -> None:
    """An empty store. ``schema`` in DDL; ``key``: the columns that tell rows apart (null is a value like others)."""
    if _manifests(spark, path):
        raise StoreError(f"there is a store at {path} already")
    _commit(spark, path, 0, {"schema": schema, "key": list(key), "buckets": buckets, "data": {}})


def _columns(spark: SparkSession, schema: str) -> list[str]:
    return spark.createDataFrame([], schema).columns


def _read(spark: SparkSession, path: str, manifest: dict, buckets: list[int] | None = None) -> DataFrame:
    data = {int(k): v for k, v in manifest["data"].items()}
    places = [f"{path}/{data[b]}" for b in (data if buckets is None else buckets) if b in data]
    if not places:
        return spark.createDataFrame([], manifest["schema"])
    return spark.read.schema(manifest["schema"]).parquet(*places)


def read(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The rows of the last version, or of an earlier one that hasn't been vacuumed."""
    return _read(spark, path, _manifest(spark, path, version)[1])


def load(spark: SparkSession, path: str, rows: DataFrame, order: str = "load_ord") -> list[int]:
    """Puts ``rows`` over the store: of each key the row that comes last by ``order`` counts; the buckets that were rewritten.

    Of rows with the same key and ``order`` one counts. Columns that the store doesn't have play no part; missing ones are
    null. Without rows nothing is changed.
    """
    version, manifest = _manifest(spark, path)
    key, columns = manifest["key"], _columns(spark, manifest["schema"])
    bucket, place = (fresh_name(x, [*columns, order]) for x in ("bucket", "place"))
    number = F.pmod(F.xxhash64(*key), F.lit(manifest["buckets"])).cast("int")
    new = rows.select(*[F.col(c) if c in rows.columns else F.lit(None).alias(c) for c in columns], F.col(order).cast("long").alias(place))
    new = new.withColumn(bucket, number)
    touched = sorted(r[0] for r in new.select(bucket).distinct().collect())  # a number for each bucket at most
    if not touched:
        return []
    old = _read(spark, path, manifest, touched).withColumns({place: F.lit(None).cast("long"), bucket: number})
    last = F.max_by(F.struct(*columns), F.struct(F.col(place).isNotNull(), place))
    both = old.unionByName(new).groupBy(*[F.col(k).alias(f"__{k}") for k in key], bucket).agg(last.alias("r")).select("r.*", bucket)
    folder = f"data/{uuid.uuid4().hex}"
    both.repartition(F.col(bucket)).write.partitionBy(bucket).parquet(f"{path}/{folder}")
    data = manifest["data"] | {str(b): f"{folder}/{bucket}={b}" for b in touched}
    _commit(spark, path, version + 1, manifest | {"data": data})
    return touched


def vacuum(spark: SparkSession, path: str) -> int:
    """Deletes earlier versions and what no manifest names; how many folders went. No load may run meanwhile."""
    version, manifest = _manifest(spark, path)
    used = {v.split("/")[1] + "/" + v.split("/")[2] for v in manifest["data"].values()}
    fs, where = _fs(spark, f"{path}/data")
    gone = 0
    for load_ in fs.listStatus(where) if fs.exists(where) else []:
        folders = [f for f in fs.listStatus(load_.getPath()) if f.isDirectory()]
        dead = [f for f in folders if f"{load_.getPath().getName()}/{f.getPath().getName()}" not in used]
        for f in [load_] if len(dead) == len(folders) else dead:
            fs.delete(f.getPath(), True)
            gone += 1
    for v in _manifests(spark, path):
        if v != version:
            fs.delete(_fs(spark, f"{path}/manifests/{v:08}.json")[1], False)
    return gone
