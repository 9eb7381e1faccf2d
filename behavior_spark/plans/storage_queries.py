"""Queries over what was stored before: month tables, views, dataset imports, a stream's output."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from behavior_spark import schemas
from behavior_spark.operators import features, ingest
from behavior_spark.plans.ingest_queries import _NORMALIZED, _ORDER_COLUMNS, ARRIVAL, _event_stream, _ingested
from behavior_spark.plans.oracle import BLOCKS, sql
from behavior_spark.plans.registry import query
from behavior_spark.session import new_folder
from behavior_spark.sources import at_rest, manifest, tables
from behavior_spark.sources.messages import read_text_stream
from behavior_spark.streaming import fanout

_START, _END = datetime(2024, 1, 8), datetime(2024, 1, 15, 12)


@query("stored_events", sql("""
    SELECT event_id, event_time, event_type, session_id, product_id FROM click_events
    WHERE event_time >= TIMESTAMP '2024-01-08 00:00:00' AND event_time <= TIMESTAMP '2024-01-15 12:00:00'"""))
def _(t):
    """Appended by month, read back with a time range that prunes months."""
    folder = new_folder(t.spark, "events")
    tables.append_events(t.click_events, folder)
    return tables.events(t.spark, folder, ["event_id", "event_time", "event_type", "session_id", "product_id"], _START, _END)


@query("stored_items", sql("SELECT order_id, product_id, count(*) AS n FROM items GROUP BY order_id, product_id"))
def _(t):
    folder = new_folder(t.spark, "items")
    tables.append_items(t.purchase_items, folder)
    return tables.purchase_items(t.spark, folder, ["order_id", "product_id"]).groupBy("order_id", "product_id").agg(F.count("*").alias("n"))


@query("stamped_defaults", sql("SELECT count(*) AS n, count(*) AS stamped, count(*) AS kept FROM click_events"))
def _(t):
    """Rows get the time of writing where none is given, and keep a given one."""
    rows = t.click_events.select("event_id")
    fresh = tables.stamped(rows, "scored_at")
    given = tables.stamped(rows, "scored_at", ARRIVAL).where(F.col("scored_at") == F.lit(ARRIVAL).cast("timestamp")).count()
    recent = F.col("scored_at").between(F.current_timestamp() - F.expr("INTERVAL 1 HOUR"), F.current_timestamp() + F.expr("INTERVAL 1 HOUR"))
    return fresh.agg(F.count("*").alias("n"), F.count_if(recent).alias("stamped")).withColumn("kept", F.lit(given).cast("bigint"))


@query("named_views", sql("""
    SELECT 'click_events' AS view, count(*) AS n FROM click_events
    UNION ALL SELECT 'live_session_features', count(*) FROM live
    UNION ALL SELECT 'session_features', count(*) FROM sessions
    UNION ALL SELECT 'lead_scores_rule_based', count(*) FROM sessions
    UNION ALL SELECT 'item_latest', count(*) FROM item_latest
    UNION ALL SELECT 'orders', (SELECT count(DISTINCT order_id) FROM order_rows)
    UNION ALL SELECT 'ml_scores', count(*) FROM ml_latest"""))
def _(t):
    names = tables.register_views(
        t.spark, t.click_events, t.dataset_events, t.item_properties, orders=t.orders, ml_scores=t.ml_scores
    )
    wanted = ["click_events", "live_session_features", "session_features", "lead_scores_rule_based", "item_latest", "orders", "ml_scores"]
    assert set(wanted) <= set(names)
    return t.spark.sql(" UNION ALL ".join(f"SELECT '{name}' AS view, count(*) AS n FROM {name}" for name in wanted))


def _csv(t):
    """The four files of the dataset as folders of CSV parts."""
    folder = new_folder(t.spark, "dataset")
    names = {name: schemas.CSV_SCHEMAS[name].names for name in schemas.DATASET_FILES}
    frames = {
        "events.csv": t.dataset_csv, "item_properties_part1.csv": t.property_parts[0],
        "item_properties_part2.csv": t.property_parts[1], "category_tree.csv": t.category_csv,
    }
    for name, frame in frames.items():
        # A quote inside a quoted value is doubled, as in the public files.
        frame.select(*names[name]).write.option("header", True).option("escape", '"').csv(f"{folder}/{name}")
    return folder


@query("dataset_import", sql("""
    SELECT 'events' AS table_name, count(*) AS n, sum(item_id)::BIGINT AS items, 1 AS first_written, 0 AS again_written FROM dataset_events
    UNION ALL SELECT 'item_properties', count(*), sum(item_id)::BIGINT, 1, 0 FROM item_properties
    UNION ALL SELECT 'category_tree', (SELECT count(*) FROM nation) + (SELECT count(*) FROM region), NULL, 1, 0"""))
def _(t):
    """CSV files to stored tables under a batch id; the second run of the same files writes nothing."""
    folder, root = _csv(t), new_folder(t.spark, "warehouse")
    batch, first = ingest.import_dataset(t.spark, folder, root, ARRIVAL)
    same, again = ingest.import_dataset(t.spark, folder, root, ARRIVAL)
    assert batch == same
    out = None
    for name in ("events", "item_properties", "category_tree"):
        stored = tables.dataset_table(t.spark, f"{root}/{name}", name).where(F.col("load_batch_id") == batch)
        items = F.sum("item_id") if "item_id" in stored.columns else F.lit(None).cast("bigint")
        row = stored.agg(F.count("*").alias("n"), items.alias("items")).select(
            F.lit(name).alias("table_name"), "n", "items", F.lit(int(first)).alias("first_written"), F.lit(int(again)).alias("again_written")
        )
        out = row if out is None else out.unionByName(row)
    return out


@query("stream_session_features", sql("SELECT session_id, anonymous_user_id, product_views, add_to_cart_count, purchase_count FROM streamed",
    streamed="""SELECT session_id, anonymous_user_id, count(*) FILTER (WHERE event_type = 'product_view') AS product_views,
        count(*) FILTER (WHERE event_type = 'add_to_cart') AS add_to_cart_count,
        count(*) FILTER (WHERE event_type = 'purchase') AS purchase_count
        FROM normalized WHERE session_id <> '' AND session_id <> 'unknown_session' AND anonymous_user_id <> ''
        GROUP BY session_id, anonymous_user_id"""))
def _(t):
    """Features over the event table that a stream has written."""
    stored = _ingested(t, _event_stream(t), "events")
    return features.live_sessions(stored).select("session_id", "anonymous_user_id", "product_views", "add_to_cart_count", "purchase_count")


# ---- micro-batches, merged -----------------------------------------------------------------


def _many_batches(t, compact_every=None):
    """All messages as a stream of eight files, out of order, one file per micro-batch.

    The short rows are dealt and sampled, not the messages: those are made once, where they are written.
    """
    folder = new_folder(t.spark, "stream")
    spread = F.pmod(F.xxhash64("n"), F.lit(8))
    t.messages_of(t.base.repartitionByRange(8, spread)).select("raw_message").write.text(f"{folder}/in")
    paths = fanout.Paths.below(folder)
    stream = read_text_stream(t.spark, f"{folder}/in", max_files=1)
    fanout.start_fanout(stream, paths, f"{folder}/checkpoint", {"availableNow": True}, ARRIVAL, compact_every=compact_every).awaitTermination()
    return paths


@query("compacted_events", sql(f"SELECT {_NORMALIZED}, event_payload FROM normalized"))
def _(t):
    """The events of many micro-batches: some merged while the stream ran, some afterwards, none twice."""
    paths = _many_batches(t, compact_every=3)
    fanout.compact_fanout(t.spark, paths)
    return tables.events(t.spark, paths.events).drop("received_at")


@query("compacted_folders", sql("""
    SELECT CAST(year(event_time) * 100 + month(event_time) AS VARCHAR) AS event_month, CAST(1 AS BIGINT) AS folders FROM normalized GROUP BY 1"""))
def _(t):
    """One folder per month is left to read."""
    paths = _many_batches(t)
    fanout.compact_fanout(t.spark, paths)
    months = F.regexp_extract(F.input_file_name(), "event_month=([0-9]+)", 1).alias("event_month")
    place = F.regexp_replace(F.input_file_name(), "/[^/]*$", "").alias("place")
    return tables.events(t.spark, paths.events, ["event_id"]).select(months, place).groupBy("event_month").agg(F.count_distinct("place").alias("folders"))


_FRESH = {"fresh": BLOCKS["live"].replace("FROM click_events", "FROM normalized")}


@query("fresh_features", sql("SELECT * FROM fresh", **_FRESH))
def _(t):
    """All session features from the partial sums that a stream keeps, without its events."""
    return features.merged_sessions(tables.session_partials(t.spark, _many_batches(t).sessions))


@query("fresh_features_compacted", sql("SELECT * FROM fresh", **_FRESH))
def _(t):
    paths = _many_batches(t, compact_every=3)
    fanout.compact_fanout(t.spark, paths)
    return features.merged_sessions(tables.session_partials(t.spark, paths.sessions))


# ---- latest rows at rest -------------------------------------------------------------------


@query("orders_at_rest", sql(f"SELECT {_ORDER_COLUMNS} FROM latest_orders"))
def _(t):
    """Order messages in four batches, merged by key as they are written; one batch comes twice."""
    folder, rows = new_folder(t.spark, "orders"), t.orders
    for i in (2, 0, 3, 1, 0):
        at_rest.upsert_orders(rows.where(F.pmod(F.xxhash64("anonymous_user_id", "total"), F.lit(4)) == i), folder, f"batch {i}", buckets=8, most_folders=3)
    return at_rest.orders(t.spark, folder).drop("products_json")


@query("ml_scores_at_rest", sql("SELECT * REPLACE (CAST(ml_lead_score AS DOUBLE) AS ml_lead_score) FROM ml_latest"))
def _(t):
    folder = new_folder(t.spark, "scores")
    for run in (2, 1):  # the older run arrives last
        at_rest.upsert_ml_scores(t.ml_scores.where(F.col("model_version") == f"gbt_v{run}"), folder, f"run {run}", buckets=8)
    return at_rest.ml_scores(t.spark, folder)


@query("dataset_at_rest", sql("""
    SELECT *, 'b2' AS load_batch_id, TIMESTAMP '2024-02-01 02:00:00' AS ingested_at FROM dataset_events"""))
def _(t):
    folder = new_folder(t.spark, "dataset")
    for n in (1, 2):
        load = t.dataset_events.withColumns({"load_batch_id": F.lit(f"b{n}"), "ingested_at": F.lit(f"2024-02-01 0{n}:00:00").cast("timestamp")})
        at_rest.upsert_dataset(load, folder, "events", f"b{n}", buckets=8)
    return at_rest.dataset_table(t.spark, folder, "events")


# ---- writes that count once ----------------------------------------------------------------


@query("scores_written_twice", sql("""
    SELECT * REPLACE (CAST(ml_lead_score AS DOUBLE) AS ml_lead_score), CAST(2 AS BIGINT) AS commits FROM ml_scores"""))
def _(t):
    """Two scoring runs, each stored twice, as after a failure that was noticed too late."""
    folder = new_folder(t.spark, "scores")
    for run in (1, 1, 2, 2):
        tables.write_scored(t.ml_scores.where(F.col("model_version") == f"gbt_v{run}"), folder, F.col("scored_at"), run=f"run {run}")
    commits = manifest.load(t.spark, folder).version
    return tables.ml_scores(t.spark, folder).withColumn("commits", F.lit(commits).cast("bigint"))


@query("stored_recent_events", sql("""
    SELECT event_id, event_type, received_at FROM click_events WHERE received_at > TIMESTAMP '2024-01-29 00:00:00' - INTERVAL 1440 MINUTE"""))
def _(t):
    """Recent events from the stored table: files are chosen by the time they were written."""
    folder = new_folder(t.spark, "events")
    tables.append_events(t.click_events, folder)
    return tables.recent_events(t.spark, folder, datetime(2024, 1, 29), 1440, ["event_id", "event_type", "received_at"])
