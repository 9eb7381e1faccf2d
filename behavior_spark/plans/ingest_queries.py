"""Queries over messages, stored tables and the offline dataset."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from behavior_spark import schemas
from behavior_spark.functions import parse_event_time, to_uint_or_null, url_hash
from behavior_spark.operators import ingest, quality, reports
from behavior_spark.operators.features import item_latest
from behavior_spark.plans.fixtures import RAW_MESSAGE, base_columns
from behavior_spark.plans.oracle import half_even, sql
from behavior_spark.plans.registry import query
from behavior_spark.session import new_folder
from behavior_spark.sources import tables
from behavior_spark.sources.messages import is_malformed
from behavior_spark.streaming import fanout

ARRIVAL = "2024-02-01 00:00:00"
_ORDER_COLUMNS = "order_id, event_time, anonymous_user_id, session_id, total, revenue, tax, shipping, discount, currency, coupon"


@query("event_scan", sql(
    "SELECT event_id, event_time, event_type, page_url FROM click_events "
    "WHERE event_time >= TIMESTAMP '2024-01-08 00:00:00' AND event_time <= TIMESTAMP '2024-01-15 12:00:00'"
))
def _(t):
    rows = tables.in_time_range(t.click_events, datetime(2024, 1, 8), datetime(2024, 1, 15, 12))
    return rows.select("event_id", "event_time", "event_type", "page_url")


@query("malformed_messages", sql("SELECT n, CAST(NOT is_json AS INT) AS malformed FROM checked_messages"))
def _(t):
    return t.numbered_messages.select("n", is_malformed().cast("int").alias("malformed"))


@query("split_malformed", sql(
    "SELECT CASE WHEN is_json THEN 'good' ELSE 'bad' END AS side, raw_message FROM checked_messages"
))
def _(t):
    good, bad = ingest.split_malformed(t.messages)
    return good.withColumn("side", F.lit("good")).unionByName(bad.withColumn("side", F.lit("bad"))).select("side", "raw_message")


# An envelope that a broken element makes unreadable stays one row as it is; a broken element that is a string leaves its neighbours whole.
@query("explode_batch", sql("""
    SELECT TIMESTAMP '2024-02-01 00:00:00' AS sent_at, json_extract_string(j, '$.type') AS message_type,
        json_extract_string(j, '$.event') AS event, json_extract_string(j, '$.userId') AS user_id,
        json_extract_string(j, '$.anonymousId') AS anonymous_id, json_extract_string(j, '$.timestamp') AS event_timestamp,
        json_extract_string(j, '$.properties.page_url') AS page_url, json_extract_string(j, '$.event_id') AS event_id,
        CASE WHEN NOT is_json THEN sha256(raw_message) END AS broken_sha256
    FROM enveloped WHERE readable
    UNION ALL SELECT DISTINCT NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, sha256(envelope) FROM enveloped WHERE NOT readable""",
    elements="""SELECT *, CAST(floor(n / 20) AS BIGINT) AS batch_no, CASE WHEN NOT is_json AND CAST(floor(n / 20) AS BIGINT) % 2 = 1
        THEN concat('"', raw_message, '"') ELSE raw_message END AS element FROM checked_messages""",
    envelope_texts="""SELECT batch_no, concat('{"batch":[', string_agg(element, ',' ORDER BY n), '],"sentAt":"2024-02-01T00:00:00.000Z"}') AS envelope
        FROM elements GROUP BY batch_no""",
    enveloped="SELECT *, json_valid(envelope) AS readable FROM elements JOIN envelope_texts USING (batch_no)",
))
def _(t):
    return ingest.explode_batch(t.envelopes).select(
        "sent_at",
        "message_type",
        "event",
        "user_id",
        "anonymous_id",
        "event_timestamp",
        F.get_json_object("properties", "$.page_url").alias("page_url"),
        F.get_json_object("raw_message", "$.event_id").alias("event_id"),
        F.when(is_malformed(), F.sha2("raw_message", 256)).alias("broken_sha256"),
    )


_NORMALIZED = ("event_id, event_time, event_type, page_url, referrer, x_pct, y_pct, scroll_pct, element_selector, element_tag, "
    "device_type, viewport_width, viewport_height, session_id, anonymous_user_id, product_id, "
    "category, price, quantity, order_id, cart_value, search_query, results_count")  # fmt: skip


@query("normalize_events", sql(f"SELECT {_NORMALIZED}, event_payload FROM normalized"))
def _(t):
    return ingest.normalize_events(t.messages, ARRIVAL, new_id="digest").drop("received_at")


def _ingested(t, messages, name):
    """Run a message stream to its end and read back one of the tables it fed."""
    folder = new_folder(t.spark, "stream")
    paths = fanout.Paths.below(folder)
    run = fanout.start_fanout(messages, paths, f"{folder}/checkpoint", {"availableNow": True}, ARRIVAL)
    run.awaitTermination()
    if name == "malformed":
        return t.spark.read.schema("raw_message STRING").parquet(paths.malformed).select("raw_message")
    return getattr(tables, name)(t.spark, getattr(paths, {"purchase_items": "items"}.get(name, name)))


def _event_stream(t):
    """The given event file itself as a stream of messages."""
    stream = t.spark.readStream.schema(t.table("events").schema).parquet(f"{t.folder}/event*.parquet")
    base = base_columns("get_json_object(props, '$.k')", "CAST(ts AS TIMESTAMP)")
    return stream.selectExpr(*base).selectExpr(f"{RAW_MESSAGE} AS raw_message")


def _purchase_stream(t):
    """Purchase messages by way of text files; each holds what one task of the join had, so none is too large for one task."""
    folder = new_folder(t.spark, "messages")
    t.purchase_messages.write.text(folder, compression="gzip")
    return ingest.read_text_stream(t.spark, folder)


@query("stream_events", sql(f"SELECT {_NORMALIZED}, event_payload FROM normalized"))
def _(t):
    return _ingested(t, _event_stream(t), "events").drop("received_at")


@query("stream_malformed", sql("SELECT raw_message FROM checked_messages WHERE NOT is_json"))
def _(t):
    return _ingested(t, _event_stream(t), "malformed")


@query("stream_purchase_items", sql("SELECT * FROM items"))
def _(t):
    return _ingested(t, _purchase_stream(t), "purchase_items")


@query("stream_orders_latest", sql(f"SELECT {_ORDER_COLUMNS} FROM latest_orders"))
def _(t):
    return tables.orders_latest(_ingested(t, _purchase_stream(t), "orders")).drop("products_json")


@query("purchase_items", sql("SELECT * FROM items"))
def _(t):
    return t.purchase_items


@query("purchase_messages", sql("SELECT count(*) AS messages FROM purchases"))
def _(t):
    parsed = ingest.parse_messages(t.purchase_messages)
    return parsed.where(ingest.is_purchase()).agg(F.count("*").alias("messages"))


@query("purchase_messages_with_track", sql("""
    SELECT count(*) AS messages FROM purchase_messages WHERE json_extract_string(j, '$.type') = 'purchase'
        OR json_extract_string(j, '$.event') IN ('Order Completed', 'purchase')"""))
def _(t):
    rows = ingest.orders(t.purchase_messages, ARRIVAL, include_track_purchase=True)
    return rows.agg(F.count("*").alias("messages"))


@query("orders", sql(f"SELECT {_ORDER_COLUMNS}, CAST(json_array_length(products_json) AS INT) AS products FROM order_rows"))
def _(t):
    return t.orders.withColumn("products", F.json_array_length("products_json")).drop("products_json")


@query("orders_latest", sql(f"SELECT {_ORDER_COLUMNS} FROM latest_orders"))
def _(t):
    return tables.orders_latest(t.orders).drop("products_json")


@query("keep_latest", sql("""
    SELECT user_id, event_id, ts AS event_time FROM (SELECT user_id, event_id, ts,
        row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS nth FROM events) WHERE nth = 1"""))
def _(t):
    rows = t.table("events").select("user_id", "event_id", F.col("ts").cast("timestamp").alias("event_time"))
    return tables.latest(rows, ["user_id"], "event_time", ["event_id"])


@query("ml_scores_latest", sql("SELECT * REPLACE (CAST(ml_lead_score AS DOUBLE) AS ml_lead_score) FROM ml_latest"))
def _(t):
    return tables.ml_scores_latest(t.ml_scores)


@query("ml_scores_latest_per_model", sql("SELECT * REPLACE (CAST(ml_lead_score AS DOUBLE) AS ml_lead_score) FROM ml_scores"))
def _(t):
    return tables.ml_scores_latest(t.ml_scores.unionByName(t.ml_scores), per_model=True)


@query("align_schema", sql("""
    SELECT order_id, event_time, anonymous_user_id, session_id, total, CAST(NULL AS DOUBLE) AS discount FROM order_rows
    UNION ALL SELECT CAST(o_orderkey AS VARCHAR), o_orderdate, NULL, NULL, NULL, NULL FROM orders"""))
def _(t):
    old = t.table("orders").select(
        F.col("o_orderkey").alias("order_id"), F.col("o_orderdate").cast("timestamp").alias("event_time")
    )
    both = tables.align(old, schemas.ORDERS).unionByName(t.orders)
    return both.select("order_id", "event_time", "anonymous_user_id", "session_id", "total", "discount")


@query("order_products", sql("SELECT order_id, product_id, count(*) AS n FROM items GROUP BY order_id, product_id"))
def _(t):
    return reports.order_products(t.purchase_items)


@query("order_products_parts", sql("SELECT order_id, count(*) AS items FROM items GROUP BY order_id"))
def _(t):
    return reports.order_products(t.purchase_items).groupBy("order_id").agg(F.sum("n").alias("items"))


@query("ga4_view", sql("""
    SELECT event_id, event_time, received_at, event_type, page_url, session_id, anonymous_user_id, event_payload,
        product_id AS item_id, category AS item_category, CAST(price AS DOUBLE) AS price, quantity,
        order_id AS transaction_id, CAST(NULL AS DOUBLE) AS cart_value, search_query AS search_term, results_count
    FROM click_events"""))
def _(t):
    return reports.ga4_view(t.click_events)


# ---- offline dataset -----------------------------------------------------------------------


@query("dataset_events", sql("SELECT * FROM dataset_events"))
def _(t):
    return t.dataset_events


@query("dataset_properties", sql("SELECT * FROM item_properties"))
def _(t):
    return t.item_properties


@query("dataset_categories", sql("""
    SELECT CAST(100 + n_nationkey AS BIGINT) AS category_id, CAST(n_regionkey AS BIGINT) AS parent_id FROM nation
    UNION ALL SELECT r_regionkey, NULL FROM region"""))
def _(t):
    return ingest.dataset_categories(t.category_csv)


@query("row_hash", sql("SELECT row_hash, source_row_num FROM dataset_events"))
def _(t):
    return t.dataset_csv.select("row_hash", F.col("source_row_num"))


@query("dataset_latest", sql("""
    SELECT *, 'b2' AS load_batch_id, TIMESTAMP '2024-02-01 02:00:00' AS ingested_at FROM dataset_events"""))
def _(t):
    # Loaded twice under two batch ids: the newer load stays.
    loads = [
        t.dataset_events.withColumns(
            {"load_batch_id": F.lit(f"b{n}"), "ingested_at": F.lit(f"2024-02-01 0{n}:00:00").cast("timestamp")}
        )
        for n in (1, 2)
    ]
    return tables.dataset_latest(loads[0].unionByName(loads[1]), "events")


@query("source_row_numbers", sql("""
    SELECT count(*) AS row_count, count(*) AS numbered, CAST(1 AS INT) AS contiguous,
        sum(CAST(itemid AS BIGINT))::BIGINT AS items FROM dataset_csv"""))
def _(t):
    # Written as CSV with headers, read back in splits and numbered per file.
    folder = new_folder(t.spark, "csv")
    t.dataset_csv.select("timestamp", "visitorid", "event", "itemid", "transactionid").write.option(
        "header", True
    ).csv(folder)
    rows = t.spark.read.schema(schemas.CSV_SCHEMAS["events.csv"]).option("header", True).csv(folder)
    numbered = ingest.with_source_row_num(rows)
    per_file = numbered.groupBy("source_file").agg(
        F.count("*").alias("n"),
        F.count_distinct("source_row_num").alias("d"),
        F.min("source_row_num").alias("lo"),
        F.max("source_row_num").alias("hi"),
        F.sum(F.col("itemid").cast("bigint")).alias("items"),
    )
    return per_file.agg(
        F.sum("n").alias("row_count"),
        F.sum("d").alias("numbered"),
        F.min(((F.col("lo") == 2) & (F.col("hi") == F.col("n") + 1)).cast("int")).alias("contiguous"),
        F.sum("items").alias("items"),
    )


@query("item_latest", sql("SELECT item_id, CAST(category_id AS DOUBLE) AS category_id, available FROM item_latest"))
def _(t):
    return item_latest(t.item_properties)


@query("category_coverage", sql(f"""
    SELECT {half_even('100.0::DOUBLE * count(category_id) / count(*)', 2)} AS pct_with_category
    FROM dataset_events LEFT JOIN item_latest USING (item_id)"""))
def _(t):
    return quality.category_coverage(t.dataset_events, item_latest(t.item_properties))


@query("expect_distribution", sql("""
    WITH wanted(event_type, expected) AS (VALUES ('view', 10), ('addtocart', 20), ('missing', 5)),
    found AS (SELECT CASE event_type WHEN 'click' THEN 'addtocart' WHEN 'purchase' THEN 'transaction' WHEN 'error'
        THEN 'error' ELSE 'view' END AS event_type, count(*) AS observed FROM events GROUP BY 1)
    SELECT event_type, observed, CAST(expected AS BIGINT) AS expected,
        CAST(observed IS NOT DISTINCT FROM expected AS INT) AS passed FROM found FULL JOIN wanted USING (event_type)"""))
def _(t):
    return quality.expect_distribution(t.dataset_events, {"view": 10, "addtocart": 20, "missing": 5})


@query("expect_counts", """
    SELECT 'events' AS table_name, count(*) AS observed, CAST(10 AS BIGINT) AS expected,
        CAST(count(*) = 10 AS INT) AS passed FROM events
    UNION ALL SELECT 'category_tree', (SELECT count(*) FROM nation) + (SELECT count(*) FROM region), 30, 
        CAST((SELECT count(*) FROM nation) + (SELECT count(*) FROM region) = 30 AS INT)""")
def _(t):
    found = {"events": t.dataset_events, "category_tree": ingest.dataset_categories(t.category_csv)}
    return quality.expect_counts(found, {"events": 10, "category_tree": 30})


# ---- scalar functions ----------------------------------------------------------------------


@query("url_hash", "SELECT page_id, url, substr(sha256(url), 1, 12) AS url_hash FROM pages")
def _(t):
    return t.table("pages").select("page_id", "url", url_hash(F.col("url")).alias("url_hash"))


@query("parse_event_time", sql("""
    SELECT n, CASE n % 6 WHEN 4 THEN NULL WHEN 2 THEN date_trunc('second', ts) WHEN 5 THEN date_trunc('second', ts)
        ELSE date_trunc('millisecond', ts) END AS parsed FROM base"""))
def _(t):
    forms = """CASE n % 6 WHEN 0 THEN concat(replace(CAST(ts AS STRING), ' ', 'T'), 'Z')
        WHEN 1 THEN concat(CAST(ts + INTERVAL 2 HOUR AS STRING), '+02:00')
        WHEN 2 THEN concat(' ', unix_seconds(ts)) WHEN 3 THEN CAST(unix_millis(ts) AS STRING)
        WHEN 4 THEN CASE n % 4 WHEN 0 THEN concat('at ', n) ELSE '12:30' END
        ELSE CASE n % 4 WHEN 1 THEN date_format(ts, 'yyyyMMddHHmmss') ELSE date_format(ts, "dd MMM yyyy HH:mm:ss 'GMT'") END END"""
    return t.base.selectExpr("n", f"{forms} AS text").select("n", parse_event_time(F.col("text")).alias("parsed"))


@query("to_uint_or_null", sql("""
    SELECT n, CASE n % 5 WHEN 0 THEN CAST(n AS DOUBLE) WHEN 4 THEN 18446744073709551615.0::DOUBLE END AS parsed FROM base"""))
def _(t):
    forms = """CASE n % 5 WHEN 0 THEN CAST(n AS STRING) WHEN 1 THEN concat('-', n) WHEN 2 THEN concat(' ', n)
        WHEN 3 THEN '18446744073709551616' ELSE '18446744073709551615' END"""
    return t.base.selectExpr("n", f"{forms} AS text").select("n", to_uint_or_null(F.col("text")).alias("parsed"))
