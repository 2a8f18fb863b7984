"""Session construction and the shared working folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a narrow table (a few numbers each) that may be broadcast once they have been counted.
BROADCAST_ROWS = 200_000


def get_session(master: str = "local[*]", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session with the settings that tests and bench use; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(master)
        .appName("palisark")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where that setting is absent and all tasks run in this process (tests, a single machine) a temporary folder is
    made and set; on a cluster its absence is an error, because executors don't see a folder of the driver's machine.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base and not spark.sparkContext.master.startswith(("local[", "local ")) and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not base:
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="palisark-"))
        base = spark.sparkContext.getCheckpointDir()
    return base.rstrip("/")


def shared_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/palisark/{label}-{uuid.uuid4().hex}"


def fresh_name(name: str, taken: list[str]) -> str:
    """``name``, or with underscores before it what no column of ``taken`` is called."""
    known = {c.lower() for c in taken}
    while name.lower() in known:
        name = f"_{name}"
    return name


def written(df: DataFrame, label: str, **options: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    It cuts lineage, and a lost executor costs no recomputation; the schema is passed on, so that no job infers it.
    """
    spark = df.sparkSession
    path = shared_path(spark, label)
    df.write.options(**{"compression": "zstd", **options}).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Deletes tables that ``written`` made and that nothing reads any more."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.written_path)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def small_side(df: DataFrame, label: str, most: int = BROADCAST_ROWS) -> DataFrame:
    """``df``, written and counted: marked for broadcast if it has at most ``most`` rows, else joined by shuffle."""
    out = written(df, label)
    return F.broadcast(out) if out.count() <= most else out
