"""Session feature vectors over two event sources.

A session is a key, not a gap: the tracker's session id, or visitor and UTC day for the
offline dataset.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from behavior_spark import schemas
from behavior_spark.functions import span_seconds, to_uint_or_null
from behavior_spark.sources.tables import align


def real_session() -> Column:
    """Events that belong to a known session of a known user."""
    return ~F.col("session_id").isin("", schemas.UNKNOWN_SESSION) & (F.col("anonymous_user_id") != "")


def _visitor_day() -> Column:
    return F.concat(F.col("visitor_id").cast("string"), F.lit("_"), F.to_date("event_time").cast("string"))


def _count_of(event_type: str) -> Column:
    return F.count_if(F.col("event_type") == event_type)


def _times() -> list[Column]:
    first, last = F.min("event_time"), F.max("event_time")
    return [
        span_seconds(first, last).alias("session_duration_seconds"),
        first.alias("first_event_at"),
        last.alias("last_event_at"),
    ]


def cart_abandoned(carts: Column, purchases: Column) -> Column:
    """1 when something was put into the cart and nothing was bought."""
    return F.when((carts > 0) & (purchases == 0), 1).otherwise(0)


def live_sessions(events: DataFrame) -> DataFrame:
    """Features per (session, user) of the live event table.

    Every measure is pre-aggregated in the map tasks, and the distinct count first spreads
    a session's rows over its products, so a very large session does not end in one task.
    """
    carts, purchases = _count_of("add_to_cart"), _count_of("purchase")
    rows = (
        events.where(real_session())
        .groupBy("session_id", "anonymous_user_id")
        .agg(
            _count_of("page_view").alias("page_views"),
            _count_of("product_view").alias("product_views"),
            carts.alias("add_to_cart_count"),
            purchases.alias("purchase_count"),
            _count_of("search").alias("search_count"),
            # No scroll event leaves NULL, which differs from "scrolled to 0".
            F.max(F.when(F.col("event_type") == "scroll", F.col("scroll_pct"))).alias("max_scroll_pct"),
            F.count_distinct("product_id").alias("distinct_products_viewed"),
            cart_abandoned(carts, purchases).alias("cart_abandoned"),
            *_times(),
        )
        .withColumn("source", F.lit(schemas.SOURCE_LIVE))
    )
    return align(rows, schemas.SESSION_FEATURES)


# Partial features of a session: one row per product that it touched, so that no row holds a set.
SESSION_PARTIALS = T.StructType(
    [T.StructField(name, T.StringType()) for name in ("session_id", "anonymous_user_id", "product_id")]
    + [T.StructField(name, T.LongType()) for name in ("page_views", "product_views", "add_to_cart_count", "purchase_count", "search_count")]
    + [T.StructField("max_scroll_pct", T.FloatType())]
    + [T.StructField(name, T.TimestampType()) for name in ("first_event_at", "last_event_at")]
)
_PARTIAL_KEYS = ["session_id", "anonymous_user_id", "product_id"]
_COUNTERS = {
    "page_views": "page_view", "product_views": "product_view", "add_to_cart_count": "add_to_cart", "purchase_count": "purchase", "search_count": "search",
}


def session_partials(events: DataFrame, also: Sequence[Column] = ()) -> DataFrame:
    """What a batch of live events adds to its sessions: counters and extremes per session, user and product (and ``also``)."""
    return (
        events.where(real_session())
        .groupBy(*_PARTIAL_KEYS, *also)
        .agg(
            *[_count_of(kind).alias(name) for name, kind in _COUNTERS.items()],
            F.max(F.when(F.col("event_type") == "scroll", F.col("scroll_pct"))).alias("max_scroll_pct"),
            F.min("event_time").alias("first_event_at"),
            F.max("event_time").alias("last_event_at"),
        )
    )


def _combined() -> list[Column]:
    return [
        *[F.sum(name).alias(name) for name in _COUNTERS],
        F.max("max_scroll_pct").alias("max_scroll_pct"),
        F.min("first_event_at").alias("first_event_at"),
        F.max("last_event_at").alias("last_event_at"),
    ]


def combine_partials(partials: DataFrame, also: Sequence[str] = ()) -> DataFrame:
    """Partial rows of the same session, user and product (and ``also``) as one."""
    return partials.groupBy(*_PARTIAL_KEYS, *also).agg(*_combined())


def merged_sessions(partials: DataFrame) -> DataFrame:
    """The features of ``live_sessions`` from partial rows, whatever batches they were counted in and in which order."""
    rows = (
        partials.groupBy("session_id", "anonymous_user_id")
        .agg(*_combined(), F.count_distinct("product_id").alias("distinct_products_viewed"))
        .withColumns(
            {
                "cart_abandoned": cart_abandoned(F.col("add_to_cart_count"), F.col("purchase_count")),
                "session_duration_seconds": span_seconds(F.col("first_event_at"), F.col("last_event_at")),
                "source": F.lit(schemas.SOURCE_LIVE),
            }
        )
    )
    return align(rows, schemas.SESSION_FEATURES)


def dataset_sessions(events: DataFrame) -> DataFrame:
    """Features per visitor and UTC day of the dataset; it has no pages, searches or scrolls."""
    carts, purchases = _count_of("addtocart"), _count_of("transaction")
    rows = (
        events.select(
            _visitor_day().alias("session_id"),
            F.col("visitor_id").cast("string").alias("anonymous_user_id"),
            "event_type",
            "item_id",
            "event_time",
        )
        .groupBy("session_id", "anonymous_user_id")
        .agg(
            _count_of("view").alias("product_views"),
            carts.alias("add_to_cart_count"),
            purchases.alias("purchase_count"),
            F.count_distinct("item_id").alias("distinct_products_viewed"),
            cart_abandoned(carts, purchases).alias("cart_abandoned"),
            *_times(),
        )
        .withColumns(
            {
                "page_views": F.lit(0),
                "search_count": F.lit(0),
                "max_scroll_pct": F.lit(None),
                "source": F.lit(schemas.SOURCE_DATASET),
            }
        )
    )
    return align(rows, schemas.SESSION_FEATURES)


def session_features(live_events: DataFrame, dataset_events: DataFrame, source: str = "all") -> DataFrame:
    """Both feature tables as one; ``source`` keeps a single one (the other is not scanned)."""
    rows = live_sessions(live_events).unionByName(dataset_sessions(dataset_events))
    return by_source(rows, source)


def by_source(rows: DataFrame, source: str = "all") -> DataFrame:
    if source not in ("all", schemas.SOURCE_LIVE, schemas.SOURCE_DATASET):
        raise ValueError(f"unknown source {source!r}")
    return rows if source == "all" else rows.where(F.col("source") == source)


def unified_events(live_events: DataFrame, dataset_events: DataFrame) -> DataFrame:
    """Both sources in one shape and one event vocabulary."""
    kind = F.col("event_type")
    mapped = kind
    for name, common in schemas.EVENT_VOCABULARY.items():
        mapped = F.when(kind == name, F.lit(common)).otherwise(mapped)
    live = live_events.select(
        "event_id",
        "event_time",
        "event_type",
        "page_url",
        "anonymous_user_id",
        "session_id",
        "product_id",
        F.lit(schemas.SOURCE_LIVE).alias("source"),
    )
    dataset = dataset_events.select(
        F.col("row_hash").alias("event_id"),
        "event_time",
        mapped.alias("event_type"),
        F.lit(None).cast("string").alias("page_url"),
        F.col("visitor_id").cast("string").alias("anonymous_user_id"),
        _visitor_day().alias("session_id"),
        F.col("item_id").cast("string").alias("product_id"),
        F.lit(schemas.SOURCE_DATASET).alias("source"),
    )
    return live.unionByName(dataset)


def item_latest(properties: DataFrame, tiebreak: Column | None = None) -> DataFrame:
    """Newest category and availability per item.

    Rows of equal time are settled by ``tiebreak`` (default: the value), so that a rerun
    gives the same answer.
    """
    order = F.struct(F.col("event_time"), F.col("value") if tiebreak is None else tiebreak)

    def newest(name: str) -> Column:
        return F.max_by(
            F.when(F.col("property") == name, F.col("value")), F.when(F.col("property") == name, order)
        )

    return (
        properties.groupBy("item_id")
        .agg(newest("categoryid").alias("_category"), newest("available").alias("_available"))
        .select(
            "item_id",
            to_uint_or_null(F.col("_category")).alias("category_id"),
            F.coalesce("_available", F.lit("")).alias("available"),
        )
    )


def conform(rows: DataFrame) -> DataFrame:
    """Cast any frame of session rows to the feature schema; a NULL scroll depth stays NULL.

    Only the two times may be missing.
    """
    missing = set(schemas.SESSION_FEATURES.names) - set(rows.columns) - {"first_event_at", "last_event_at"}
    if missing:
        raise ValueError(f"missing feature columns: {sorted(missing)}")
    return align(rows, schemas.SESSION_FEATURES)
