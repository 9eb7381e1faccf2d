"""Tables that hold the latest row of each key at rest.

Rows are bucketed and sorted by key when they are written: all rows of a key lie in the same bucket of every folder. A batch becomes one more folder with
one row per key; when there are more than a few, the folders are merged bucket by bucket, without a shuffle, into one. A bucket is sorted by
one task, so a table whose buckets would grow beyond ``BUCKET_BYTES`` is written anew with more of them, by a shuffle. A read takes the
buckets of all folders side by side, so finding the latest row per key needs no shuffle either, and with a single folder no work at all.

Folders are named by the table's manifest, so readers see a batch whole or not at all, and a batch with a token is added once.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from behavior_spark import schemas
from behavior_spark.session import _hadoop_path, new_folder
from behavior_spark.sources import manifest as M
from behavior_spark.sources.manifest import WHOLE, Manifest
from behavior_spark.sources.tables import align, latest

PART = "part"
BUCKETS = 64  # per table at first; several times the executors' cores for large tables
BUCKET_BYTES = 64 << 20  # of files, on average; about eight times as much when a task sorts it


def _names(columns: Sequence[str]) -> str:
    return ", ".join(f"`{c}`" for c in columns)


def _write(rows: DataFrame, folder: str, keys: Sequence[str], buckets: int) -> None:
    """One sorted file per bucket. Spark knows buckets of catalog tables only, so a table is named for the moment."""
    name = f"at_rest_{uuid.uuid4().hex}"
    rows.write.format("parquet").option("path", folder).bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(name)
    rows.sparkSession.sql(f"DROP TABLE {name}")  # external: the files stay


def _bytes(spark: SparkSession, folder: str) -> int:
    found, files = _hadoop_path(spark, folder)
    return files.getContentSummary(found).getLength()


def _enough(buckets: int, size: int) -> int:
    """The number of buckets, doubled until ``size`` bytes fit."""
    while size > buckets * BUCKET_BYTES:
        buckets *= 2
    return buckets


def _scan(spark: SparkSession, path: str, known: Manifest, schema: T.StructType) -> DataFrame:
    """The rows of all folders that the manifest names, in one scan: a task reads a bucket of every folder.

    It must be one scan. Over a union of bucketed scans Spark 4.1 plans no shuffle either, but then reads the scans without their buckets.
    """
    name, keys = f"at_rest_{uuid.uuid4().hex}", _names(known.layout["keys"])
    place = f"{path}/{M.PARTS}".replace("\\", "\\\\").replace("'", "\\'")
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    setting = "spark.sql.hive.manageFilesourcePartitions"  # folders are found by listing, not by asking the catalog
    before = spark.conf.get(setting)
    spark.conf.set(setting, "false")
    try:
        spark.sql(
            f"CREATE TABLE {name} ({columns}, `{PART}` STRING) USING parquet PARTITIONED BY (`{PART}`) "
            f"CLUSTERED BY ({keys}) SORTED BY ({keys}) INTO {known.layout['buckets']} BUCKETS LOCATION '{place}'"
        )
        rows = spark.table(name)
        rows.schema  # resolved now: the plan keeps the files and the buckets, the name can go
        spark.sql(f"DROP TABLE {name}")
    finally:
        spark.conf.set(setting, before)
    live = [f.removeprefix(f"{PART}=") for f in known.folders[WHOLE]]
    return rows.where(F.col(PART).isin(live)).drop(PART)


def _merged(spark: SparkSession, path: str, known: Manifest, schema: T.StructType) -> DataFrame:
    rows, layout = _scan(spark, path, known, schema), known.layout
    return rows if len(known.folders[WHOLE]) == 1 else latest(rows, layout["keys"], layout["version"], layout["tiebreak"])


def upsert(
    df: DataFrame, path: str, schema: T.StructType, keys: Sequence[str], version: str, tiebreak: Sequence[str] = (), token: str | None = None,
    buckets: int = BUCKETS, most_folders: int = 8,
) -> bool:
    """Merge a batch into the table: per key the row with the highest version, then tie-break values, stays.

    ``buckets`` are those of the first write; the table doubles them as it grows. Returns whether the batch was added (its token may be known). Beyond ``most_folders`` folders all are merged into one. One writer at a time:
    a second one fails at its commit (``manifest.Conflict``) and changes nothing.
    """
    spark = df.sparkSession
    known = M.load(spark, path)
    now = known or Manifest(layout={"keys": list(keys), "version": version, "tiebreak": list(tiebreak), "buckets": buckets})
    if token is not None and token in now.tokens:
        return False
    wanted = {"keys": list(keys), "version": version, "tiebreak": list(tiebreak)}
    if {k: now.layout.get(k) for k in wanted} != wanted:
        raise ValueError(f"{path} is kept by {now.layout}")
    step = new_folder(spark, "batch")
    latest(align(df, schema), keys, version, tiebreak).write.parquet(step)  # written first: its size decides about the buckets
    rows, folders = spark.read.schema(schema).parquet(step), now.folders.get(WHOLE, [])
    part, base, count = M.new_part(), f"{path}/{M.PARTS}", now.layout["buckets"]
    wanted = _enough(count, _bytes(spark, step) + sum(_bytes(spark, f"{base}/{f}") for f in folders))
    # The hash of a bucket is the hash of a shuffle: one task and one file per bucket.
    if wanted > count:
        dealt = (_scan(spark, path, now, schema).unionByName(rows) if folders else rows).repartition(wanted, *keys)
        _write(latest(dealt, keys, version, tiebreak), f"{base}/{part}", keys, wanted)
        new = replace(now.with_folder(part, [WHOLE], [WHOLE]), layout={**now.layout, "buckets": wanted})
    else:
        _write(rows.repartition(count, *keys), f"{base}/{part}", keys, count)
        new = now.with_folder(part, [WHOLE])
    if len(new.folders[WHOLE]) > most_folders:
        whole = M.new_part()
        _write(_merged(spark, path, new, schema), f"{base}/{whole}", keys, count)
        new = now.with_folder(whole, [WHOLE], [WHOLE])
    M.remove(spark, step)
    M.commit(spark, path, known, replace(new, tokens=now.tokens + ((token,) if token is not None else ())))
    return True


def read(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The latest row of each key."""
    known = M.load(spark, path)
    if known is None or not known.folders.get(WHOLE):
        return spark.createDataFrame([], schema)
    return _merged(spark, path, known, schema).select(*schema.names)


# ---- the tables --------------------------------------------------------------------------------


def upsert_orders(df: DataFrame, path: str, token: str | None = None, **options) -> bool:
    return upsert(df, path, schemas.ORDERS, ["order_id"], "event_time", ["anonymous_user_id", "session_id", "total"], token, **options)


def orders(spark: SparkSession, path: str) -> DataFrame:
    """One row per order id, as ``tables.orders_latest`` finds it."""
    return read(spark, path, schemas.ORDERS)


def upsert_ml_scores(df: DataFrame, path: str, token: str | None = None, **options) -> bool:
    keys = ["source", "anonymous_user_id", "session_id"]
    return upsert(df, path, schemas.ML_SCORES, keys, "scored_at", ["model_version", "ml_lead_score"], token, **options)


def ml_scores(spark: SparkSession, path: str) -> DataFrame:
    """Newest score per session, as ``tables.ml_scores_latest`` finds it."""
    return read(spark, path, schemas.ML_SCORES)


def upsert_dataset(df: DataFrame, path: str, name: str, token: str | None = None, **options) -> bool:
    order = ["load_batch_id", "source_file", "source_row_num"]
    return upsert(df, path, schemas.DATASET_TABLES[name], schemas.DATASET_KEYS[name], "ingested_at", order, token, **options)


def dataset_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    """Dataset rows without repeated loads, as ``tables.dataset_latest`` finds them."""
    return read(spark, path, schemas.DATASET_TABLES[name])
