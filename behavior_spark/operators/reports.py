"""Product questions as DataFrame operators: heatmaps, sessions, clicks, leads."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from behavior_spark.functions import round_half_even, url_hash
from behavior_spark.operators.scoring import RULES, as_percent
from behavior_spark.sources.tables import in_time_range, ml_scores_latest

__all__ = [
    "HeatmapConfig",
    "catalog_search",
    "click_ranking",
    "clicks_with_selector",
    "density_grid",
    "ga4_view",
    "heatmap",
    "lead_funnel",
    "ml_summary",
    "normalize_url_filter",
    "order_products",
    "rule_totals",
    "scoped_sessions",
    "score_comparison",
    "scroll_bands",
    "session_stats",
    "tier_distribution",
    "to_pixels",
    "top_leads",
    "top_ml_leads",
    "top_rule_leads",
    "triggered_rules",
    "url_hash",
    "url_predicate",
]

# Bin width in percent, heatmap event types and their labels, rule labels.
BIN_PCT = 5
SCROLL_LANE_PCT = 50.0
HEATMAP_MODES = {"Click": "click", "Scroll": "scroll", "Hover": "mousemove"}
RULE_LABELS = {
    "rule_add_to_cart": "Added to Cart",
    "rule_purchase": "Purchased",
    "rule_browsing_depth": "High Browsing Depth",
    "rule_search_intent": "Search Intent",
    "rule_scroll_engagement": "High Scroll Engagement",
    "rule_bouncer": "Bouncer",
}


# ---- filters -------------------------------------------------------------------------------


def normalize_url_filter(url: str | None, wildcard: str | None = None) -> str:
    """The wildcard if one is given, else the page."""
    return (wildcard or "").strip() or (url or "").strip()


def url_predicate(pattern: str | None) -> Column:
    """Exact page, or a pattern in which ``*`` stands for any text.

    Patterns are anchored at both ends: ``/product/*`` matches no absolute address, use
    ``*/product/*``.
    """
    wanted = (pattern or "").strip()
    if not wanted:
        raise ValueError("a page address or pattern is required")
    if "*" not in wanted:
        return F.col("page_url") == wanted
    return F.col("page_url").like(re.sub(r"([\\%_])", r"\\\1", wanted).replace("*", "%"))


def heatmap_event_type(event_type: str) -> str:
    """Check and normalize a heatmap's event type; labels such as ``Hover`` also do."""
    wanted = event_type.strip().lower()
    by_label = {label.lower(): name for label, name in HEATMAP_MODES.items()}
    wanted = by_label.get(wanted, wanted)
    if wanted not in HEATMAP_MODES.values():
        raise ValueError(f"no heatmap for event type {event_type!r}; use one of {sorted(HEATMAP_MODES.values())}")
    return wanted


def _at_least_one(limit: int) -> int:
    return max(1, int(limit))


# ---- heatmaps ------------------------------------------------------------------------------


@dataclass(frozen=True)
class HeatmapConfig:
    url: str
    event_type: str
    start_time: datetime | None = None
    end_time: datetime | None = None
    viewport_width: int | None = None
    viewport_height: int | None = None
    device_type: str | None = None
    min_count: int = 1


def _bin(pct: Column) -> Column:
    return F.rint(pct / BIN_PCT) * BIN_PCT


def heatmap(events: DataFrame, config: HeatmapConfig) -> DataFrame:
    """Event counts in 5 % bins, most frequent first.

    Scroll depth becomes a lane in the middle of the page. Each task pre-aggregates to at
    most 21 x 21 bins, so almost nothing is shuffled.
    """
    kind = heatmap_event_type(config.event_type)
    rows = in_time_range(
        events.where(url_predicate(config.url) & (F.col("event_type") == kind)), config.start_time, config.end_time
    )
    for column in ("viewport_width", "viewport_height", "device_type"):
        wanted = getattr(config, column)
        if wanted is not None:
            rows = rows.where(F.col(column) == wanted)
    if kind == "scroll":
        x, y = F.lit(SCROLL_LANE_PCT), F.col("scroll_pct").cast("double")
    else:
        x, y = F.col("x_pct").cast("double"), F.col("y_pct").cast("double")
    return (
        rows.where(x.isNotNull() & y.isNotNull())
        .groupBy(_bin(x).alias("x_bin_pct"), _bin(y).alias("y_bin_pct"))
        .agg(
            F.count(F.lit(1)).alias("event_count"),
            F.min("event_time").alias("first_event_time"),
            F.max("event_time").alias("last_event_time"),
        )
        .where(F.col("event_count") >= _at_least_one(config.min_count))
        .orderBy(F.desc("event_count"), "y_bin_pct", "x_bin_pct")
    )


def scroll_bands(bins: DataFrame) -> DataFrame:
    """Stretch every scroll bin over the full width of the page."""
    return (
        bins.groupBy("y_bin_pct")
        .agg(F.max("event_count").cast("double").alias("event_count"))
        .withColumn("x_bin_pct", F.explode(F.sequence(F.lit(0), F.lit(100), F.lit(BIN_PCT))))
        .select(F.col("x_bin_pct").cast("double").alias("x_bin_pct"), "y_bin_pct", "event_count")
    )


def _on_page(column: str) -> Column:
    """The bin lies on the page once rounded; asked of the double, as stray values fit no whole number."""
    return F.rint(F.col(column)).between(0, 100)


def _whole_pct(column: str) -> Column:
    return F.when(_on_page(column), F.rint(F.col(column))).cast("int")


def density_grid(bins: DataFrame) -> DataFrame:
    """Every observed x bin by every observed y bin, 0 where there is no data.

    Bins are whole percents, so the one row this passes through holds at most 101 x 101
    cells. Without any bin the grid is the empty page.
    """
    whole = bins.where(_on_page("x_bin_pct") | _on_page("y_bin_pct")).select(
        _whole_pct("x_bin_pct").alias("x"), _whole_pct("y_bin_pct").alias("y"), F.col("event_count").cast("double").alias("n")
    )
    blank = F.sequence(F.lit(0), F.lit(100), F.lit(BIN_PCT))

    def axis(name: str) -> Column:
        seen = F.collect_set(F.col(name))
        return F.when(F.size(seen) > 0, seen).otherwise(blank)

    cell = F.struct(F.col("x"), F.col("y"))
    return (
        whole.groupBy("x", "y")
        .agg(F.max("n").alias("n"))
        .agg(
            axis("x").alias("xs"),
            axis("y").alias("ys"),
            F.map_from_entries(F.collect_list(F.struct(cell.alias("cell"), F.col("n")))).alias("cells"),
        )
        .select(F.explode("xs").alias("x"), "ys", "cells")
        .select("x", F.explode("ys").alias("y"), "cells")
        .select(
            F.col("x").alias("x_bin_pct"),
            F.col("y").alias("y_bin_pct"),
            F.coalesce(F.try_element_at("cells", F.struct("x", "y")), F.lit(0.0)).alias("event_count"),
        )
    )


def to_pixels(bins: DataFrame, width: int, height: int) -> DataFrame:
    """Add pixel positions for a picture of the given size; bins outside 0..100 go."""
    x, y = _whole_pct("x_bin_pct"), _whole_pct("y_bin_pct")
    return bins.where(_on_page("x_bin_pct") & _on_page("y_bin_pct")).withColumns(
        {"x_px": x * F.lit(int(width)) / F.lit(100), "y_px": y * F.lit(int(height)) / F.lit(100)}
    )


# ---- sessions and clicks -------------------------------------------------------------------


def scoped_sessions(events: DataFrame, url: str) -> DataFrame:
    """Events of a page scope that carry a session id (unknown sessions count here)."""
    return events.where(url_predicate(url) & F.col("session_id").isNotNull() & (F.col("session_id") != ""))


def session_stats(events: DataFrame, url: str) -> DataFrame:
    """One row: sessions, mean deepest scroll, bounce rate and events of a page scope.

    A bounce is a session with exactly one page view in the scope. The event total is the
    sum of the sessions' counts, so the events are read once; an empty scope gives zeros.
    """
    per_session = (
        scoped_sessions(events, url)
        .groupBy("session_id")
        .agg(
            F.count_if(F.col("event_type") == "page_view").alias("page_views"),
            F.max(F.when(F.col("event_type") == "scroll", F.col("scroll_pct").cast("double"))).alias("deepest"),
            F.count(F.lit(1)).alias("events"),
        )
    )
    sessions = F.count(F.lit(1))
    bounced = F.count_if(F.col("page_views") == 1)
    depth = F.avg(F.coalesce(F.col("deepest"), F.lit(0.0)))
    return per_session.agg(
        sessions.alias("total_sessions"),
        round_half_even(F.coalesce(depth, F.lit(0.0)), 2).alias("avg_scroll_depth_pct"),
        round_half_even(F.coalesce(F.try_divide(bounced * F.lit(100.0), sessions), F.lit(0.0)), 2).alias(
            "bounce_rate_pct"
        ),
        F.coalesce(F.sum("events"), F.lit(0)).cast("bigint").alias("total_events"),
    )


def clicks_with_selector(events: DataFrame) -> DataFrame:
    return events.where(
        (F.col("event_type") == "click") & F.col("element_selector").isNotNull() & (F.col("element_selector") != "")
    )


def click_ranking(events: DataFrame, url: str, limit: int = 10) -> DataFrame:
    """Most clicked selectors of a page scope; equal counts by name."""
    return (
        clicks_with_selector(events.where(url_predicate(url)))
        .groupBy("element_selector")
        .agg(F.count(F.lit(1)).alias("click_count"))
        .orderBy(F.desc("click_count"), "element_selector")
        .limit(_at_least_one(limit))
    )


def ga4_view(events: DataFrame) -> DataFrame:
    """The event table under the alias names of the GA4 vocabulary."""
    # Column names and their aliases.
    aliases = {
        "product_id": "item_id",
        "category": "item_category",
        "order_id": "transaction_id",
        "search_query": "search_term",
    }
    kept = [
        "event_id", "event_time", "received_at", "event_type", "page_url", "session_id", "anonymous_user_id",
        "event_payload", "product_id", "category", "price", "quantity", "order_id", "cart_value", "search_query",
        "results_count",
    ]
    return events.select(*[F.col(c).alias(aliases.get(c, c)) for c in kept])


def catalog_search(products: DataFrame, query: str, name: str = "name") -> DataFrame:
    """How many products have the query in their name, ignoring case."""
    hit = F.contains(F.lower(F.col(name)), F.lower(F.lit(query)))
    return products.agg(F.count_if(hit).alias("results_count")).select(F.lit(query).alias("query"), "results_count")


def order_products(items: DataFrame) -> DataFrame:
    """How often each product is in each order: one row per order and product.

    Counts combine in the map tasks, so the blank id that all purchases without one share costs no more than its
    different products.
    """
    return items.groupBy("order_id", "product_id").agg(F.count(F.lit(1)).alias("n"))


def products_of(items: DataFrame, order_id: str) -> DataFrame:
    """The products of one order in one row, sorted, repeats included; no row if there is no such order."""
    own = order_products(items.where(F.col("order_id") == order_id))
    repeated = F.flatten(F.sort_array(F.collect_list(F.array_repeat("product_id", F.col("n").cast("int")))))
    return own.groupBy("order_id").agg(repeated.alias("products"))


# ---- leads ---------------------------------------------------------------------------------

_FLAGS = [r.column for r in RULES]


def lead_funnel(scored: DataFrame) -> DataFrame:
    """Sessions per tier, largest first."""
    return (
        scored.groupBy("score_tier")
        .agg(F.count(F.lit(1)).alias("session_count"))
        .orderBy(F.desc("session_count"), "score_tier")
    )


def tier_distribution(scored: DataFrame) -> DataFrame:
    """Sessions and scores by source and tier."""
    return (
        scored.groupBy("source", "score_tier")
        .agg(
            F.count(F.lit(1)).alias("sessions"),
            round_half_even(F.avg("lead_score"), 1).alias("avg_score"),
            F.min("lead_score").alias("min_score"),
            F.max("lead_score").alias("max_score"),
        )
        .orderBy("source", "score_tier")
    )


def rule_totals(scored: DataFrame) -> DataFrame:
    """How many sessions each rule fired for."""
    # The report's column names.
    names = {
        "rule_add_to_cart": "cart_sessions",
        "rule_purchase": "purchase_sessions",
        "rule_browsing_depth": "deep_browsing_sessions",
        "rule_search_intent": "search_sessions",
        "rule_scroll_engagement": "scroll_engaged_sessions",
        "rule_bouncer": "bouncer_sessions",
    }
    return scored.agg(*[F.coalesce(F.sum(flag), F.lit(0)).cast("bigint").alias(name) for flag, name in names.items()])


def top_rule_leads(scored: DataFrame, n: int = 10) -> DataFrame:
    """Highest rule scores; ties by user, session and source."""
    return (
        scored.orderBy(F.desc("lead_score"), "anonymous_user_id", "session_id", "source")
        .limit(_at_least_one(n))
        .select("anonymous_user_id", "lead_score", "score_tier", "source", *_FLAGS)
    )


def top_ml_leads(ml_scores: DataFrame, n: int = 10) -> DataFrame:
    """Highest model scores, newest score per session; ties by user, session and source."""
    return (
        ml_scores_latest(ml_scores)
        .orderBy(F.desc("ml_lead_score"), "anonymous_user_id", "session_id", "source")
        .limit(_at_least_one(n))
        .select(
            "anonymous_user_id",
            "source",
            as_percent(F.col("ml_lead_score"), 1).alias("ml_score_pct"),
            "model_version",
            "scored_at",
        )
    )


def ml_summary(ml_scores: DataFrame) -> DataFrame:
    """Model scores by source, newest score per session."""
    value = F.col("ml_lead_score").cast("double")
    return (
        ml_scores_latest(ml_scores)
        .groupBy("source")
        .agg(
            F.count(F.lit(1)).alias("scored_sessions"),
            round_half_even(F.avg(value), 4).alias("avg_score"),
            round_half_even(F.min(value), 4).alias("min_score"),
            round_half_even(F.max(value), 4).alias("max_score"),
            F.max("scored_at").alias("last_scored_at"),
        )
        .orderBy("source")
    )


def top_leads(ml_scores: DataFrame, scored: DataFrame, n: int = 50) -> DataFrame:
    """Sessions with both scores, highest model score first.

    Both sides hold one row per key, so the join cannot multiply rows.
    """
    keys = ["session_id", "anonymous_user_id", "source"]
    return (
        ml_scores_latest(ml_scores)
        .select(*keys, "ml_lead_score")
        .join(scored, keys, "inner")
        .orderBy(F.desc("ml_lead_score"), *keys)
        .limit(_at_least_one(n))
        .select(
            *keys,
            as_percent(F.col("ml_lead_score"), 2).alias("ml_score_pct"),
            F.col("lead_score").alias("rule_score"),
            "score_tier",
            "first_event_at",
            "last_event_at",
            *_FLAGS,
        )
    )


def _first_per_session(rows: DataFrame, n: int, *order: Column) -> DataFrame:
    nth = F.row_number().over(Window.partitionBy("session_id").orderBy(*order))
    return rows.withColumn("_nth", nth).where(F.col("_nth") <= n).drop("_nth")


def score_comparison(scored: DataFrame, ml_scores: DataFrame, n: int = 10) -> DataFrame:
    """Rule and model scores matched on the session id alone; highest model score first.

    Several users may share a session id, and each pair is a result. Only a session's first
    ``n`` rows of either side can reach the first ``n`` pairs, so the others are left out
    before the join: exact, without a session's full set of pairs.
    """
    n = _at_least_one(n)
    model = ml_scores_latest(ml_scores).select(
        "session_id", "ml_lead_score", F.col("source").alias("ml_source"), F.col("anonymous_user_id").alias("ml_user")
    )
    rules = scored.select("session_id", "anonymous_user_id", "source", "lead_score", "score_tier")
    model = _first_per_session(model, n, F.desc("ml_lead_score"), F.col("ml_source"), F.col("ml_user"))
    rules = _first_per_session(rules, n, F.col("source"), F.col("anonymous_user_id"))
    return (
        model.join(rules, "session_id", "inner")
        .orderBy(F.desc("ml_lead_score"), "session_id", "ml_source", "ml_user", "source", "anonymous_user_id")
        .limit(n)
        .select(
            "anonymous_user_id",
            "source",
            F.col("lead_score").alias("rule_score"),
            F.col("score_tier").alias("rule_tier"),
            as_percent(F.col("ml_lead_score"), 1).alias("ml_score_pct"),
        )
    )


def triggered_rules(scored: DataFrame, labels: dict[str, str] | None = None) -> DataFrame:
    """Add the readable labels of the rules that fired, in the order of the rule table."""
    named = [F.when(F.col(flag) == 1, F.lit(label)) for flag, label in (labels or RULE_LABELS).items()]
    return scored.withColumn("triggered_rules", F.array_compact(F.array(*named)))


def drilldown(leads: DataFrame, columns: Sequence[str] = ("session_id", "ml_score_pct", "rule_score", "score_tier")) -> DataFrame:
    """What the lead page shows for a selected session."""
    return triggered_rules(leads).select(*columns, "triggered_rules")
