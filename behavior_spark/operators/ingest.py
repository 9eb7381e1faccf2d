"""JSON messages and dataset rows to typed tables.

``parse_messages`` reads a message once; the three projections share its result, so a
stream that feeds three tables parses every message a single time.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from behavior_spark.functions import (
    blank_to_null,
    decimal_of,
    digest_id,
    double_of,
    first_filled,
    json_object,
    json_objects,
    parse_event_time,
    parsed_once,
    text_of,
    uint_of,
)
from behavior_spark.functions.jsontext import CORRUPT
from behavior_spark.operators import quality
from behavior_spark.schemas import CLICK_EVENTS, ORDERS, PURCHASE_ITEMS
from behavior_spark.session import folder_exists
from behavior_spark.sources.dataset import (
    already_loaded,
    load_batch_id,
    read_dataset_csv,
    source_files,
    with_source_row_num,
)
from behavior_spark.sources.messages import RAW, explode_batch, read_kafka, read_text_stream, split_malformed
from behavior_spark.sources.tables import align, dataset_table, now_column, stamped, write_batch

__all__ = [
    "already_loaded",
    "dataset_categories",
    "dataset_events",
    "dataset_properties",
    "explode_batch",
    "import_dataset",
    "is_purchase",
    "load_batch_id",
    "normalize_events",
    "orders",
    "parse_messages",
    "purchase_items",
    "read_dataset_csv",
    "read_kafka",
    "read_text_stream",
    "row_hash",
    "source_files",
    "split_malformed",
    "start_fanout",
    "with_row_hash",
    "with_source_row_num",
]

# The keys read from a message and from its ``properties`` object.
TOP_KEYS = (
    "event_id", "messageId", "type", "event_type", "event", "page_url", "event_time", "timestamp",
    "referrer", "element_selector", "element_tag", "device_type", "session_id", "anonymous_user_id",
    "anonymousId", "userId", "x_pct", "y_pct", "scroll_pct", "viewport_width", "viewport_height",
    "event_payload", "product_id", "category", "price", "quantity", "order_id", "cart_value", "query",
    "results_count",
)
PROPERTY_KEYS = (
    "page_url", "referrer", "element_selector", "element_tag", "device_type", "session_id", "x_pct",
    "y_pct", "scroll_pct", "viewport_width", "viewport_height", "product_id", "category", "price",
    "quantity", "order_id", "cart_value", "query", "search_term", "results_count", "products", "total",
    "revenue", "tax", "shipping", "discount", "currency", "coupon",
)
ITEM_KEYS = ("product_id", "sku", "name", "category", "price", "quantity", "position")


def parse_messages(messages: DataFrame) -> DataFrame:
    """Add ``top`` (a struct of strings with the inner struct ``properties``) and ``malformed``.

    The parser also flags a message whose ``properties`` is no object. Such a message is
    good, it only has no properties; a second look tells the two apart.
    """
    whole = json_object(F.col(RAW), TOP_KEYS, corrupt=True, properties=PROPERTY_KEYS)
    flagged = F.col(f"top.{CORRUPT}").isNotNull()
    # Only flagged messages are parsed again: the check occurs once, so Spark does not hoist it.
    no_object = json_object(F.col(RAW), [], corrupt=True)[CORRUPT].isNotNull()
    return parsed_once(messages, "top", whole).withColumn(
        "malformed", F.col("top").isNull() | (flagged & no_object)
    )


def _parsed(messages: DataFrame) -> DataFrame:
    return messages if "malformed" in messages.columns else parse_messages(messages)


def _top(key: str) -> Column:
    return F.col(f"top.{key}")


def _props(key: str) -> Column:
    return F.col(f"top.properties.{key}")


def _either(key: str, default: Column | None = None) -> Column:
    """Text at top level, else in the properties; empty counts as missing."""
    return first_filled(_top(key), _props(key), default=default)


def _number(key: str, cast) -> Column:
    """A number at top level, else in the properties; unreadable counts as missing."""
    return F.coalesce(cast(_top(key)), cast(_props(key)))


def _new_id(new_id: str) -> Column:
    if new_id == "digest":
        return digest_id(F.col(RAW))
    if new_id == "uuid":
        return F.expr("uuid()")
    raise ValueError("new_id must be 'uuid' or 'digest'")


def normalize_events(
    messages: DataFrame, now: Column | datetime | str | None = None, new_id: str = "uuid"
) -> DataFrame:
    """Messages to the typed event table (malformed messages are dropped).

    ``now`` stands in for unreadable event times and is the received time. ``new_id`` says
    how to make a missing event id: random, or a digest of the message that a rerun repeats.
    """
    arrival = now_column(now)
    empty = F.lit("")
    values = {
        "event_id": first_filled(_top("event_id"), _top("messageId"), default=_new_id(new_id)),
        "event_time": F.coalesce(parse_event_time(first_filled(_top("event_time"), _top("timestamp"))), arrival),
        "received_at": arrival,
        "event_type": first_filled(_top("event_type"), _top("event"), default=empty),
        "page_url": _either("page_url", empty),
        "referrer": _either("referrer"),
        "x_pct": _number("x_pct", double_of),
        "y_pct": _number("y_pct", double_of),
        "scroll_pct": _number("scroll_pct", double_of),
        "element_selector": _either("element_selector"),
        "element_tag": _either("element_tag"),
        "device_type": _either("device_type", F.lit("unknown")),
        "viewport_width": _number("viewport_width", lambda c: uint_of(c, 16)),
        "viewport_height": _number("viewport_height", lambda c: uint_of(c, 16)),
        "session_id": first_filled(
            _top("session_id"), _props("session_id"), _top("anonymousId"), default=F.lit("unknown_session")
        ),
        "anonymous_user_id": first_filled(
            _top("anonymous_user_id"), _top("anonymousId"), _top("userId"), default=empty
        ),
        "event_payload": first_filled(_top("event_payload"), default=F.col(RAW)),
        "product_id": _either("product_id"),
        "category": _either("category"),
        "price": _number("price", decimal_of),
        "quantity": _number("quantity", lambda c: uint_of(c, 32)),
        "order_id": _either("order_id"),
        "cart_value": _number("cart_value", decimal_of),
        "search_query": first_filled(_top("query"), _props("query"), _props("search_term")),
        "results_count": _number("results_count", lambda c: uint_of(c, 32)),
    }
    good = _parsed(messages).where(~F.col("malformed"))
    return align(good.select(*[value.alias(name) for name, value in values.items()]), CLICK_EVENTS)


def is_purchase(include_track_purchase: bool = False) -> Column:
    """Predicate on parsed messages: an order event.

    ``include_track_purchase`` also takes ``type=track, event=purchase``, which the order
    tables leave out by default.
    """
    kind, name = text_of(_top("type")), text_of(_top("event"))
    chosen = (kind == "purchase") | (name == "Order Completed")
    if include_track_purchase:
        chosen = chosen | ((kind == "track") & (name == "purchase"))
    return chosen


def _order_messages(messages: DataFrame, include_track_purchase: bool) -> DataFrame:
    return _parsed(messages).where(~F.col("malformed") & is_purchase(include_track_purchase))


def _order_keys(now: Column | datetime | str | None) -> dict[str, Column]:
    # Order tables are stricter than the event table: one place per key, no fallbacks.
    return {
        "event_time": F.coalesce(parse_event_time(_top("timestamp")), now_column(now)),
        "order_id": text_of(_props("order_id")),
        "anonymous_user_id": text_of(_top("anonymousId")),
        "session_id": text_of(_top("session_id")),
        "currency": blank_to_null(_props("currency")),
    }


def purchase_items(
    messages: DataFrame, now: Column | datetime | str | None = None, include_track_purchase: bool = False
) -> DataFrame:
    """One row per product of an order; an order without products gives one blank row."""
    listed = F.col("_listed")
    blank = F.array(F.lit(None)).cast(f"ARRAY<STRUCT<{', '.join(f'{key}: STRING' for key in ITEM_KEYS)}>>")
    exploded = (
        _order_messages(messages, include_track_purchase)
        .withColumn("_listed", json_objects(_props("products"), ITEM_KEYS))
        .select("top", F.explode(F.when(F.size(listed) > 0, listed).otherwise(blank)).alias("item"))
    )
    values = {
        "event_id": text_of(_top("messageId")),
        **_order_keys(now),
        "product_id": text_of(F.col("item.product_id")),
        "sku": blank_to_null(F.col("item.sku")),
        "name": blank_to_null(F.col("item.name")),
        "category": blank_to_null(F.col("item.category")),
        "price": decimal_of(F.col("item.price")),
        "quantity": uint_of(F.col("item.quantity"), 32),
        "position": uint_of(F.col("item.position"), 32),
    }
    return align(exploded.select(*[value.alias(name) for name, value in values.items()]), PURCHASE_ITEMS)


def orders(
    messages: DataFrame, now: Column | datetime | str | None = None, include_track_purchase: bool = False
) -> DataFrame:
    """Order headers, one per purchase message (repeats included)."""
    values = {
        **_order_keys(now),
        **{name: decimal_of(_props(name)) for name in ("total", "revenue", "tax", "shipping", "discount")},
        "coupon": blank_to_null(_props("coupon")),
        "products_json": first_filled(_props("products"), default=F.lit("[]")),
    }
    rows = _order_messages(messages, include_track_purchase)
    return align(rows.select(*[value.alias(name) for name, value in values.items()]), ORDERS)


# ---- offline dataset -----------------------------------------------------------------------


def row_hash(columns: Sequence[str], file_name: str = "source_file", row_num: str = "source_row_num") -> Column:
    """SHA-256 of ``file:line:`` and the values joined by bars; NULL counts as empty."""
    values = F.concat_ws("|", *[text_of(F.col(c).cast("string")) for c in columns])
    return F.sha2(F.concat_ws(":", F.col(file_name), F.col(row_num).cast("string"), values), 256)


def with_row_hash(rows: DataFrame) -> DataFrame:
    lineage = {"source_file", "source_row_num"}
    return rows.withColumn("row_hash", row_hash([c for c in rows.columns if c not in lineage]))


def _lineage(rows: DataFrame) -> list[Column]:
    """Lineage columns, as far as the rows carry them."""
    names = ("row_hash", "load_batch_id", "source_file", "source_row_num", "ingested_at")
    return [F.col(n) for n in names if n in rows.columns]


def dataset_events(rows: DataFrame) -> DataFrame:
    """Raw event strings to typed rows; a blank transaction id is NULL.

    Unreadable numbers raise, as the import is all or nothing.
    """
    return rows.select(
        F.timestamp_millis(F.col("timestamp").cast("bigint")).alias("event_time"),
        F.col("visitorid").cast("bigint").alias("visitor_id"),
        F.col("itemid").cast("bigint").alias("item_id"),
        F.col("event").alias("event_type"),
        blank_to_null(F.trim(text_of(F.col("transactionid")))).cast("bigint").alias("transaction_id"),
        *_lineage(rows),
    )


def dataset_properties(*parts: DataFrame) -> DataFrame:
    """Property files, any number of parts, into one table."""
    typed = [
        rows.select(
            F.timestamp_millis(F.col("timestamp").cast("bigint")).alias("event_time"),
            F.col("itemid").cast("bigint").alias("item_id"),
            F.col("property"),
            F.col("value"),
            *_lineage(rows),
        )
        for rows in parts
    ]
    table = typed[0]
    for rows in typed[1:]:
        table = table.unionByName(rows)
    return table


def dataset_categories(rows: DataFrame) -> DataFrame:
    """Parent-pointer rows; a blank parent is NULL (a root)."""
    return rows.select(
        F.col("categoryid").cast("bigint").alias("category_id"),
        blank_to_null(F.trim(text_of(F.col("parentid")))).cast("bigint").alias("parent_id"),
        *_lineage(rows),
    )


def import_dataset(
    spark: SparkSession,
    folder: str,
    root: str,
    now: Column | datetime | str | None = None,
    totals: dict[str, int] | None = None,
    distribution: dict[str, int] | None = None,
) -> tuple[str, bool]:
    """Load the four CSV files into the tables below ``root``; returns the batch id and
    whether anything was written.

    A batch that is already loaded is skipped. The event table is written last, as its rows
    mark the batch as loaded: after a failure a rerun writes the same folders again.
    ``totals`` and ``distribution`` are checked at the end and raise if they differ
    (``quality.DATASET_TOTALS`` and ``quality.DATASET_EVENT_TYPES`` hold the public dataset's).
    """
    batch_id = load_batch_id(source_files(spark, folder))
    # Before the first import there is no table.
    if folder_exists(spark, f"{root}/events") and already_loaded(dataset_table(spark, f"{root}/events", "events"), batch_id):
        return batch_id, False
    raw = {name: with_row_hash(rows) for name, rows in read_dataset_csv(spark, folder).items()}
    typed = {
        "category_tree": dataset_categories(raw["category_tree.csv"]),
        "item_properties": dataset_properties(raw["item_properties_part1.csv"], raw["item_properties_part2.csv"]),
        "events": dataset_events(raw["events.csv"]),
    }
    for name, rows in typed.items():
        write_batch(stamped(rows, "ingested_at", now), f"{root}/{name}", batch_id)
    stored = {name: dataset_table(spark, f"{root}/{name}", name) for name in typed}
    if totals:
        quality.require(quality.expect_counts(stored, totals))
    if distribution:
        quality.require(quality.expect_distribution(stored["events"], distribution))
    return batch_id, True


def start_fanout(*args, **kwargs):
    """See ``behavior_spark.streaming.fanout.start_fanout``."""
    from behavior_spark.streaming.fanout import start_fanout as start

    return start(*args, **kwargs)
