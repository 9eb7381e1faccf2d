"""Stored tables: month-partitioned Parquet, keep-latest reads, repeatable batch writes."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from behavior_spark import schemas
from behavior_spark.functions import event_month
from behavior_spark.sources import manifest

MONTH = "event_month"


# ---- reading -------------------------------------------------------------------------------


def in_time_range(df: DataFrame, start: datetime | None = None, end: datetime | None = None) -> DataFrame:
    """Both ends inclusive, each optional. Adds the month predicate where the table has one."""
    if start is not None:
        df = df.where(F.col("event_time") >= F.lit(start))
        if MONTH in df.columns:
            df = df.where(F.col(MONTH) >= start.year * 100 + start.month)
    if end is not None:
        df = df.where(F.col("event_time") <= F.lit(end))
        if MONTH in df.columns:
            df = df.where(F.col(MONTH) <= end.year * 100 + end.month)
    return df


def _read(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    columns: Sequence[str] | None,
    start: datetime | None,
    end: datetime | None,
    written_since: datetime | None = None,
) -> DataFrame:
    # The schema is given, so nothing is inferred; columns that old files lack read as NULL.
    stored = T.StructType([*schema.fields, T.StructField(MONTH, T.IntegerType())])
    rows = in_time_range(stored_rows(spark, path, stored, written_since), start, end)
    return rows.select(*(columns or schema.names))


def stored_rows(spark: SparkSession, path: str, schema: T.StructType, written_since: datetime | None = None) -> DataFrame:
    """All rows of a table: what its manifest names and the micro-batches after it, or every file if it has no manifest.

    With ``written_since`` older files are left out; Spark drops them when it lists files and does not open them.
    """
    known = manifest.load(spark, path)
    if known is None:
        return _younger(spark.read.schema(schema).parquet(path), written_since)
    rows = merged_rows(spark, path, schema, known, written_since=written_since)
    fresh = [
        f"{run}/{batch}" for run in manifest.listed(spark, path) if run.startswith("run=")
        for batch in manifest.listed(spark, f"{path}/{run}") if batch.startswith("ingest_batch=")
        and int(batch.removeprefix("ingest_batch=")) > known.merged.get(run.removeprefix("run="), -1)
    ]
    return rows.unionByName(batches(spark, path, schema, fresh, written_since)) if fresh else rows


def _younger(rows: DataFrame, since: datetime | None) -> DataFrame:
    return rows if since is None else rows.where(F.col("_metadata.file_modification_time") >= F.lit(since))


def batches(spark: SparkSession, path: str, schema: T.StructType, folders: Sequence[str], written_since: datetime | None = None) -> DataFrame:
    """Rows of some micro-batch folders."""
    rows = spark.read.schema(schema).option("basePath", path).parquet(*[f"{path}/{f}" for f in folders])
    return _younger(rows, written_since).select(*schema.names)


def merged_rows(
    spark: SparkSession, path: str, schema: T.StructType, known: manifest.Manifest, groups=None, written_since: datetime | None = None
) -> DataFrame:
    """Rows of the folders that a manifest names, of all groups or some."""
    base, months = f"{path}/{manifest.PARTS}", MONTH in schema.names
    chosen = known.folders if groups is None else {g: known.folders.get(g, []) for g in groups}
    folders = [f"{base}/{f}/{MONTH}={g}" if months else f"{base}/{f}" for g, some in chosen.items() for f in some]
    if not folders:
        return spark.createDataFrame([], schema)
    return _younger(spark.read.schema(schema).option("basePath", base).parquet(*folders), written_since).select(*schema.names)


def events(spark, path, columns=None, start=None, end=None) -> DataFrame:
    """Scan of the event table with a column subset and a time range (months are pruned)."""
    return _read(spark, path, schemas.CLICK_EVENTS, columns, start, end)


def purchase_items(spark, path, columns=None, start=None, end=None) -> DataFrame:
    return _read(spark, path, schemas.PURCHASE_ITEMS, columns, start, end)


def recent_events(
    spark: SparkSession, path: str, now: datetime, minutes: int = 10, columns: Sequence[str] | None = None, slack_minutes: int = 60
) -> DataFrame:
    """Events received within the last minutes, without a scan of the table: only files written since then are read.

    A row is written after it arrived, on a clock that is at most ``slack_minutes`` behind; rewritten files are younger still.
    """
    since = now - timedelta(minutes=minutes)
    rows = _read(spark, path, schemas.CLICK_EVENTS, None, None, None, since - timedelta(minutes=slack_minutes))
    return rows.where(F.col("received_at") > F.lit(since)).select(*(columns or schemas.CLICK_EVENTS.names))


def session_partials(spark: SparkSession, path: str) -> DataFrame:
    """The partial session features that a stream has written; ``features.merged_sessions`` makes features of them."""
    from behavior_spark.operators.features import SESSION_PARTIALS

    stored = T.StructType([*SESSION_PARTIALS.fields, T.StructField(MONTH, T.IntegerType())])
    return stored_rows(spark, path, stored).drop(MONTH)


def malformed(spark: SparkSession, path: str) -> DataFrame:
    return stored_rows(spark, path, schemas.MALFORMED)


def orders(spark, path, columns=None, start=None, end=None) -> DataFrame:
    """Every stored order message; see ``orders_latest`` for one row per order."""
    return _read(spark, path, schemas.ORDERS, columns, start, end)


def ml_scores(spark: SparkSession, path: str) -> DataFrame:
    """Every stored score, of runs that were committed and of plain appends to a table without a manifest."""
    return stored_rows(spark, path, schemas.ML_SCORES)


def dataset_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    """One dataset table; the schema keeps hex batch ids from being read as numbers."""
    return spark.read.schema(schemas.DATASET_TABLES[name]).parquet(path)


# ---- keep-latest ---------------------------------------------------------------------------


def latest(df: DataFrame, keys: Sequence[str], version: str, tiebreak: Sequence[str] = ()) -> DataFrame:
    """One row per key: the highest version, then the highest tie-break values.

    Spark keeps only the first row per key in every task before it shuffles, so a key with
    a third of all rows sends one row per task.
    """
    order = [F.col(c).desc_nulls_last() for c in (version, *tiebreak)]
    return (
        df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
        .where(F.col("_rank") == 1)
        .drop("_rank")
    )


def orders_latest(order_rows: DataFrame) -> DataFrame:
    """One row per order id. Purchases without an id share the key '' and become one row."""
    return latest(order_rows, ["order_id"], "event_time", ["anonymous_user_id", "session_id", "total"])


def ml_scores_latest(scores: DataFrame, per_model: bool = False) -> DataFrame:
    """Newest score per session. The key has no model version unless ``per_model`` asks for it."""
    keys = ["source", "anonymous_user_id", "session_id"]
    if per_model:
        return latest(scores, [*keys, "model_version"], "scored_at", ["ml_lead_score"])
    return latest(scores, keys, "scored_at", ["model_version", "ml_lead_score"])


def dataset_latest(df: DataFrame, name: str) -> DataFrame:
    """Dataset rows without repeated loads: one row per natural key and row hash."""
    return latest(df, schemas.DATASET_KEYS[name], "ingested_at", ["load_batch_id", "source_file", "source_row_num"])


# ---- shapes --------------------------------------------------------------------------------


def align(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Bring a frame to a schema: new columns read as NULL, the rest is cast and ordered."""
    present = set(df.columns)
    return df.select(
        *[
            (F.col(f.name) if f.name in present else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema.fields
        ]
    )


def stamped(df: DataFrame, column: str, now: Column | datetime | None = None) -> DataFrame:
    """Set a load-time column: the current time unless ``now`` is given."""
    return df.withColumn(column, now_column(now))


def now_column(now: Column | datetime | str | None = None) -> Column:
    if now is None:
        return F.current_timestamp()
    return now if isinstance(now, Column) else F.lit(now).cast("timestamp")


# ---- writing -------------------------------------------------------------------------------


def _append(df: DataFrame, path: str, schema: T.StructType, order: Sequence[Column]) -> None:
    # REBALANCE evens out file sizes: AQE splits a month that holds most rows over many
    # tasks and merges the small ones.
    (
        align(df, schema)
        .withColumn(MONTH, event_month(F.col("event_time")))
        .hint("rebalance", MONTH)
        .sortWithinPartitions(MONTH, *order)
        .write.mode("append")
        .partitionBy(MONTH)
        .parquet(path)
    )


def append_events(df: DataFrame, path: str) -> None:
    """Append events by month, sorted so that page and type filters skip row groups."""
    _append(df, path, schemas.CLICK_EVENTS, [F.col("page_url"), F.col("event_type"), F.to_date("event_time")])


def append_items(df: DataFrame, path: str) -> None:
    _append(df, path, schemas.PURCHASE_ITEMS, [F.col("order_id"), F.col("product_id"), F.col("event_time")])


def append_orders(df: DataFrame, path: str) -> None:
    _append(df, path, schemas.ORDERS, [F.col("order_id"), F.col("event_time")])


def append_ml_scores(df: DataFrame, path: str) -> None:
    align(df, schemas.ML_SCORES).write.mode("append").parquet(path)


def write_batch(df: DataFrame, path: str, batch_id: str) -> None:
    """Write one load batch to its own folder; a rerun replaces the same folder. AQE sizes the files."""
    df.drop("load_batch_id").hint("rebalance").write.mode("overwrite").parquet(f"{path}/load_batch_id={batch_id}")


def append_once(df: DataFrame, path: str, token: str) -> bool:
    """Append rows under a token; a token that is there already adds nothing. Returns whether rows were added.

    The rows become visible together with their token, by one commit. A run that died before it leaves a folder that is not read, so
    repeating the run adds its rows once. Use it for all writes of a table or for none.
    """
    spark = df.sparkSession
    known = manifest.load(spark, path)
    if known is not None and token in known.tokens:
        return False
    part = manifest.new_part()
    df.hint("rebalance").write.parquet(f"{path}/{manifest.PARTS}/{part}")
    return manifest.commit_part(spark, path, part, token)


def write_scored(df: DataFrame, path: str, now: Column | datetime | None = None, run: str | None = None) -> None:
    """Store a scoring run. With the name of the ``run`` a repeated write adds nothing."""
    rows = stamped(df, "scored_at", now)
    if run is None:
        append_ml_scores(rows, path)
    else:
        append_once(align(rows, schemas.ML_SCORES), path, f"run={run}")


# ---- views ---------------------------------------------------------------------------------


def register_views(
    spark: SparkSession,
    click_events: DataFrame,
    dataset_events: DataFrame,
    item_properties: DataFrame | None = None,
    orders: DataFrame | None = None,
    ml_scores: DataFrame | None = None,
) -> list[str]:
    """(Re)create the named views over the given tables and return their names."""
    from behavior_spark.operators import features, reports, scoring

    live = features.live_sessions(click_events)
    dataset = features.dataset_sessions(dataset_events)
    sessions = features.session_features(click_events, dataset_events)
    views = {
        "click_events": click_events,
        "click_events_ga4": reports.ga4_view(click_events),
        "unified_events": features.unified_events(click_events, dataset_events),
        "live_session_features": live,
        f"{schemas.SOURCE_DATASET}_session_features": dataset,
        "session_features": sessions,
        "lead_scores_rule_based": scoring.score(sessions),
    }
    if item_properties is not None:
        views["item_latest"] = features.item_latest(item_properties)
    if orders is not None:
        views["orders"] = orders_latest(orders)
    if ml_scores is not None:
        views["ml_scores"] = ml_scores_latest(ml_scores)
    for name, frame in views.items():
        frame.createOrReplaceTempView(name)
    return list(views)
