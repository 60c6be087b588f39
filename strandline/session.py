"""Session for local runs, and the shared folder that cuts lineage."""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = 8, **conf: str) -> SparkSession:
    """A local session with the settings that tests and the bench use."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("strandline")
        .config("spark.sql.shuffle.partitions", str(cpus) if str(cpus).isdigit() else "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("STRANDLINE_DRIVER_MEMORY", "8g"))
        .config("spark.sql.warehouse.dir", os.path.join(tempfile.gettempdir(), "strandline-warehouse"))
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or the context's checkpoint folder.

    Where neither is set, a local session (tests, the bench) gets a temporary folder; a cluster must name one.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir, or SparkContext.setCheckpointDir, to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="strandline-"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


#: Spark's setting by which an action's shuffle files go when it ends, not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def cleaned(spark: SparkSession) -> Iterator[None]:
    """The shuffle files of the actions within go when each ends."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt by keys into as many parts as a shuffle has. written keeps them as buckets, so that sums and joins by these keys shuffle none of its rows."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = df.repartition(n, *keys)
    out._dealt = n, keys
    return out


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written as Parquet to the shared folder and read again: cuts lineage and survives lost executors. What is dealt stays so.

    The files go when the driver's JVM ends, or by freed.
    """
    spark = df.sparkSession
    table = f"strandline_{name}_{uuid.uuid4().hex}"
    path = f"{shared_folder(spark)}/{table}"
    writer = df.write.option("compression", "zstd")
    n, keys = getattr(df, "_dealt", (0, ()))
    with cleaned(spark):
        if keys:
            writer.bucketBy(n, *keys).option("path", path).saveAsTable(table)
        else:
            writer.parquet(path)
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    _files(spark, target).deleteOnExit(target)
    out = spark.table(table) if keys else spark.read.schema(df.schema).parquet(path)
    out._written_to = path, table if keys else None
    return out


def _files(spark: SparkSession, path):
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def freed(*tables: DataFrame) -> None:
    """Deletes what written wrote of these: for tables that only fed others which are written themselves by now."""
    for df in tables:
        path, table = getattr(df, "_written_to", (None, None))
        if path:
            spark = df.sparkSession
            target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            if table:
                spark.sql(f"DROP TABLE IF EXISTS {table}")
            _files(spark, target).delete(target, True)
