"""Checks over stored tables, features and scores, each a small DataFrame."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from behavior_spark import schemas
from behavior_spark.functions import round_half_even
from behavior_spark.sources.tables import ml_scores_latest, now_column


# Rows of the public dataset, by table and by event type.
DATASET_TOTALS = {"events": 2_756_101, "item_properties": 20_275_902, "category_tree": 1_669}
DATASET_EVENT_TYPES = {"view": 2_664_312, "addtocart": 69_332, "transaction": 22_457}


def _rows() -> Column:
    return F.count(F.lit(1))


def _positive(column: str) -> Column:
    return F.count_if(F.col(column) > 0)


# ---- events --------------------------------------------------------------------------------


def events_by_source(unified: DataFrame) -> DataFrame:
    return unified.groupBy("source").agg(_rows().alias("event_count")).orderBy("source")


def vocabulary(unified: DataFrame, source: str = schemas.SOURCE_DATASET, n: int = 10) -> DataFrame:
    """Most frequent event types of one source after mapping; ties by name."""
    return (
        unified.where(F.col("source") == source)
        .groupBy("event_type")
        .agg(_rows().alias("event_count"))
        .orderBy(F.desc("event_count"), "event_type")
        .limit(max(1, int(n)))
    )


def product_id_coverage(unified: DataFrame) -> DataFrame:
    """With and without a product id, by source and e-commerce event type."""
    return (
        unified.where(F.col("event_type").isin(*schemas.ECOMMERCE_TYPES))
        .groupBy("source", "event_type")
        .agg(
            F.count("product_id").alias("with_product_id"),
            F.count_if(F.col("product_id").isNull()).alias("without_product_id"),
            _rows().alias("total"),
        )
        .orderBy("source", "event_type")
    )


def column_coverage(events: DataFrame) -> DataFrame:
    """How many events fill each e-commerce column."""
    names = ["product_id", "category", "price", "quantity", "order_id", "cart_value", "search_query", "results_count"]
    return events.agg(*[F.count(name).alias(f"c_{name}") for name in names])


def valid_event() -> Column:
    return (F.col("event_type") != "") & (F.col("page_url") != "")


def recent_events(events: DataFrame, now: Column | datetime | str, minutes: int = 10) -> DataFrame:
    """Events received within the last minutes. Judged by arrival, as event times can be wrong."""
    since = now_column(now) - F.make_dt_interval(mins=F.lit(minutes))
    return events.where(F.col("received_at") > since)


def freshness(events: DataFrame, now: Column | datetime | str, minutes: int = 10) -> DataFrame:
    """Recent events: all, valid, and malformed (no type or no page)."""
    return recent_events(events, now, minutes).agg(
        _rows().alias("recent"),
        F.count_if(valid_event()).alias("valid"),
        F.count_if(~valid_event()).alias("malformed"),
    )


def latest_click_sample(events: DataFrame) -> DataFrame:
    """Coordinates of the newest click that has both."""
    return (
        events.where((F.col("event_type") == "click") & F.col("x_pct").isNotNull() & F.col("y_pct").isNotNull())
        .orderBy(F.desc("received_at"), F.desc("event_id"))
        .limit(1)
        .select("x_pct", "y_pct")
    )


def orders_without_id(orders: DataFrame) -> DataFrame:
    """Order rows without an id; a keep-latest read joins them into one."""
    return orders.agg(F.count_if(F.col("order_id") == "").alias("without_order_id"), _rows().alias("total"))


# ---- sessions ------------------------------------------------------------------------------


def sessions_by_source(features: DataFrame) -> DataFrame:
    return features.groupBy("source").agg(_rows().alias("session_count")).orderBy("source")


def live_coverage(live: DataFrame) -> DataFrame:
    return live.agg(
        _rows().alias("total_sessions"),
        _positive("page_views").alias("sessions_with_page_views"),
        _positive("product_views").alias("sessions_with_product_views"),
        _positive("add_to_cart_count").alias("sessions_with_cart"),
        _positive("purchase_count").alias("sessions_with_purchase"),
        _positive("search_count").alias("sessions_with_search"),
        F.count("max_scroll_pct").alias("sessions_with_scroll"),
        F.count_if(F.col("cart_abandoned") == 1).alias("cart_abandoners"),
    )


def dataset_coverage(dataset: DataFrame) -> DataFrame:
    """Coverage and invariants; ``invariants_hold`` is 1 if the last three equal the total."""
    total = _rows()
    no_pages = F.count_if(F.col("page_views") == 0)
    no_searches = F.count_if(F.col("search_count") == 0)
    no_scrolls = F.count_if(F.col("max_scroll_pct").isNull())
    return dataset.agg(
        total.alias("total_sessions"),
        _positive("product_views").alias("sessions_with_product_views"),
        _positive("add_to_cart_count").alias("sessions_with_cart"),
        _positive("purchase_count").alias("sessions_with_purchase"),
        F.count_if(F.col("cart_abandoned") == 1).alias("cart_abandoners"),
        no_pages.alias("page_views_always_zero"),
        no_searches.alias("search_count_always_zero"),
        no_scrolls.alias("max_scroll_always_null"),
        ((no_pages == total) & (no_searches == total) & (no_scrolls == total)).cast("int").alias("invariants_hold"),
    )


def feature_averages(features: DataFrame) -> DataFrame:
    def mean(column: str, digits: int) -> Column:
        return round_half_even(F.avg(column), digits)

    return (
        features.groupBy("source")
        .agg(
            mean("product_views", 2).alias("avg_product_views"),
            mean("add_to_cart_count", 4).alias("avg_add_to_cart"),
            mean("purchase_count", 4).alias("avg_purchase"),
            mean("cart_abandoned", 4).alias("avg_cart_abandoned_rate"),
            mean("session_duration_seconds", 0).alias("avg_duration_seconds"),
        )
        .orderBy("source")
    )


def category_coverage(dataset_events: DataFrame, item_latest: DataFrame) -> DataFrame:
    """Share of dataset events whose item has a category.

    Events are counted per item before the join, so a very popular item is one row in it.
    """
    per_item = dataset_events.groupBy("item_id").agg(_rows().alias("n"))
    joined = per_item.join(item_latest.select("item_id", "category_id"), "item_id", "left")
    hits = F.coalesce(F.sum(F.when(F.col("category_id").isNotNull(), F.col("n"))), F.lit(0))
    share = F.try_divide(hits * F.lit(100.0), F.sum("n"))
    return joined.agg(round_half_even(share, 2).alias("pct_with_category"))


# ---- scores --------------------------------------------------------------------------------


def _check(rows: DataFrame, count: Column, name: str, passes) -> DataFrame:
    return rows.agg(count.alias(name)).withColumn("passed", passes(F.col(name)).cast("int"))


def rule_scores_in_range(scored: DataFrame) -> DataFrame:
    return _check(scored, F.count_if(~F.col("lead_score").between(0, 100)), "out_of_range", lambda n: n == 0)


def ml_scores_in_range(ml_scores: DataFrame) -> DataFrame:
    outside = F.count_if(~F.col("ml_lead_score").between(0, 1))
    return _check(ml_scores_latest(ml_scores), outside, "out_of_range", lambda n: n == 0)


def no_dataset_bouncers(scored: DataFrame) -> DataFrame:
    fired = F.count_if((F.col("source") == schemas.SOURCE_DATASET) & (F.col("rule_bouncer") == 1))
    return _check(scored, fired, "dataset_bouncers", lambda n: n == 0)


def hot_leads(scored: DataFrame) -> DataFrame:
    return _check(scored, F.count_if(F.col("score_tier") == "hot"), "hot_count", lambda n: n > 0)


# ---- expectations --------------------------------------------------------------------------


def expect_distribution(rows: DataFrame, expected: dict[str, int], column: str = "event_type") -> DataFrame:
    """Counts per value beside the expected ones; a value on one side only does not pass."""
    wanted = rows.sparkSession.createDataFrame(list(expected.items()), f"{column} STRING, expected BIGINT")
    observed = rows.groupBy(column).agg(_rows().alias("observed"))
    return (
        observed.join(wanted, column, "full")
        .withColumn("passed", F.col("observed").eqNullSafe(F.col("expected")).cast("int"))
        .orderBy(column)
    )


def expect_counts(tables: dict[str, DataFrame], expected: dict[str, int]) -> DataFrame:
    """Row totals of named tables beside the expected ones."""
    rows = None
    for name, wanted in expected.items():
        row = tables[name].agg(_rows().alias("observed")).select(
            F.lit(name).alias("table_name"), "observed", F.lit(wanted).cast("bigint").alias("expected")
        )
        rows = row if rows is None else rows.unionByName(row)
    return rows.withColumn("passed", (F.col("observed") == F.col("expected")).cast("int"))


def require(check: DataFrame) -> None:
    """Raise if any row of a check did not pass."""
    failed = check.where(F.col("passed") != 1).limit(20).collect()
    if failed:
        raise RuntimeError("check failed: " + "; ".join(str(row.asDict()) for row in failed))
