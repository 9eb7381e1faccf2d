"""Session settings the operators rely on, and the shared work folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Runtime settings; none of them depends on the size of the data.
SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # What is kept in memory gets as many partitions as its data asks for, too.
    "spark.sql.optimizer.canChangeCachedPlanOutputPartitioning": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # The JVM compiles no method above 8000 bytes: wide projections are cut up instead.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def configure(spark: SparkSession, **conf: str) -> SparkSession:
    """Apply the runtime settings to an existing session (times are UTC throughout)."""
    for key, value in {**SESSION_CONF, **conf}.items():
        if spark.conf.isModifiable(key):
            spark.conf.set(key, value)
    return spark


def get_session(app_name: str = "behavior_spark", master: str | None = None, **conf: str) -> SparkSession:
    """Build (or reuse) a session; keyword ``conf`` wins over the defaults.

    Shuffle partitions are left to the cluster: AQE coalesces them at run time.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**SESSION_CONF, **conf}.items():
        builder = builder.config(key, value)
    return configure(builder.getOrCreate(), **conf)


def work_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints, taken from ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder: on a cluster another
    machine could not read it.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
    folder = tempfile.mkdtemp(prefix="behavior_spark-")
    spark.sparkContext.setCheckpointDir(folder)
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def new_folder(spark: SparkSession, label: str) -> str:
    """A fresh, unused path below the shared work folder, with the scheme of its file system."""
    return f"{qualified(spark, work_dir(spark))}/{label}-{uuid.uuid4().hex}"


def checkpoint_dir(spark: SparkSession) -> None:
    """Make sure that Spark has a folder for checkpoints."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(work_dir(spark))


def _hadoop_path(spark: SparkSession, path: str):
    """A path and the file system it is on, whatever the store."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark._jsc.hadoopConfiguration())


def qualified(spark: SparkSession, path: str) -> str:
    """The path with the scheme of its file system: tasks that open files on their own must not take it for a local one."""
    found, files = _hadoop_path(spark, path)
    return str(files.makeQualified(found).toString())


def folder_exists(spark: SparkSession, path: str) -> bool:
    found, files = _hadoop_path(spark, path)
    return files.exists(found)


_MATERIALIZED: list[str] = []


def materialized(df: DataFrame) -> DataFrame:
    """Write a frame as Parquet to the shared work folder and read it from there from now on.

    Unlike a cache it survives lost executors, and nothing before it runs a second time. Unlike a checkpoint it is columnar
    and has sizes that AQE can use. ``release`` removes the files.
    """
    spark = df.sparkSession
    folder = new_folder(spark, "step")
    df.write.parquet(folder)
    _MATERIALIZED.append(folder)
    return spark.read.schema(df.schema).parquet(folder)


def release(spark: SparkSession) -> int:
    """Remove everything this process has written by ``materialized``; frames that read it are no longer usable."""
    removed = 0
    while _MATERIALIZED:
        found, files = _hadoop_path(spark, _MATERIALIZED.pop())
        removed += bool(files.delete(found, True))
    return removed
