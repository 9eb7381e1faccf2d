"""Table schemas and the labels that appear in results."""

from __future__ import annotations

from pyspark.sql import types as T

# These labels appear in results and must stay as they are.
SOURCE_LIVE = "live"
SOURCE_DATASET = "retailrocket"
UNKNOWN_SESSION = "unknown_session"
UNKNOWN_DEVICE = "unknown"
EVENT_VOCABULARY = {"view": "product_view", "addtocart": "add_to_cart", "transaction": "purchase"}
ECOMMERCE_TYPES = ("product_view", "add_to_cart", "purchase")
DATASET_FILES = (
    "events.csv",
    "item_properties_part1.csv",
    "item_properties_part2.csv",
    "category_tree.csv",
)

MONEY = T.DecimalType(18, 2)
UINT64 = T.DecimalType(20, 0)

_TYPES = {
    "STRING": T.StringType(),
    "TIMESTAMP": T.TimestampType(),
    "FLOAT": T.FloatType(),
    "INT": T.IntegerType(),
    "BIGINT": T.LongType(),
    "MONEY": MONEY,
}


def _schema(columns: str) -> T.StructType:
    """Nullable columns from ``name TYPE, ...``; needs no session, unlike Spark's own parser."""
    pairs = [column.split() for column in columns.split(",")]
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


CLICK_EVENTS = _schema(
    "event_id STRING, event_time TIMESTAMP, received_at TIMESTAMP, event_type STRING, page_url STRING, "
    "referrer STRING, x_pct FLOAT, y_pct FLOAT, scroll_pct FLOAT, element_selector STRING, "
    "element_tag STRING, device_type STRING, viewport_width INT, viewport_height INT, "
    "session_id STRING, anonymous_user_id STRING, event_payload STRING, product_id STRING, "
    "category STRING, price MONEY, quantity BIGINT, order_id STRING, "
    "cart_value MONEY, search_query STRING, results_count BIGINT"
)

PURCHASE_ITEMS = _schema(
    "event_id STRING, event_time TIMESTAMP, order_id STRING, anonymous_user_id STRING, "
    "session_id STRING, product_id STRING, sku STRING, name STRING, category STRING, "
    "price MONEY, quantity BIGINT, position BIGINT, currency STRING"
)

MALFORMED = _schema("raw_message STRING")

ORDERS = _schema(
    "order_id STRING, event_time TIMESTAMP, anonymous_user_id STRING, session_id STRING, "
    "total MONEY, revenue MONEY, tax MONEY, shipping MONEY, "
    "discount MONEY, currency STRING, coupon STRING, products_json STRING"
)

ML_SCORES = _schema(
    "session_id STRING, anonymous_user_id STRING, source STRING, ml_lead_score FLOAT, "
    "model_version STRING, scored_at TIMESTAMP"
)

SESSION_FEATURES = _schema(
    "session_id STRING, anonymous_user_id STRING, page_views BIGINT, product_views BIGINT, "
    "add_to_cart_count BIGINT, purchase_count BIGINT, search_count BIGINT, max_scroll_pct FLOAT, "
    "session_duration_seconds BIGINT, distinct_products_viewed BIGINT, cart_abandoned INT, "
    "first_event_at TIMESTAMP, last_event_at TIMESTAMP, source STRING"
)

_LINEAGE = "row_hash STRING, load_batch_id STRING, source_file STRING, source_row_num BIGINT, ingested_at TIMESTAMP"

DATASET_TABLES = {
    "events": _schema(
        "event_time TIMESTAMP, visitor_id BIGINT, item_id BIGINT, event_type STRING, "
        f"transaction_id BIGINT, {_LINEAGE}"
    ),
    "item_properties": _schema(
        f"event_time TIMESTAMP, item_id BIGINT, property STRING, value STRING, {_LINEAGE}"
    ),
    "category_tree": _schema(f"category_id BIGINT, parent_id BIGINT, {_LINEAGE}"),
}

# Natural keys: a row loaded twice is the same row.
DATASET_KEYS = {
    "events": ["visitor_id", "event_time", "item_id", "event_type", "row_hash"],
    "item_properties": ["item_id", "property", "event_time", "row_hash"],
    "category_tree": ["category_id", "row_hash"],
}

CSV_SCHEMAS = {
    "events.csv": _schema("timestamp STRING, visitorid STRING, event STRING, itemid STRING, transactionid STRING"),
    "item_properties_part1.csv": _schema("timestamp STRING, itemid STRING, property STRING, value STRING"),
    "item_properties_part2.csv": _schema("timestamp STRING, itemid STRING, property STRING, value STRING"),
    "category_tree.csv": _schema("categoryid STRING, parentid STRING"),
}
