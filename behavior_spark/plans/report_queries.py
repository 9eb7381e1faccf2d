"""Queries behind the dashboard: heatmaps, session statistics, click rankings."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from behavior_spark import schemas
from behavior_spark.operators import reports
from behavior_spark.operators.reports import HeatmapConfig
from behavior_spark.plans.oracle import half_even, sql
from behavior_spark.plans.registry import query

ANY_PAGE = "https://example.com/*"
CHECKOUT = "https://example.com/checkout"


def _bins(kind: str, where: str = "true", least: int = 1) -> str:
    x = "CAST(x_pct AS DOUBLE)" if kind != "scroll" else "CAST(50 AS DOUBLE)"
    y = "CAST(y_pct AS DOUBLE)" if kind != "scroll" else "CAST(scroll_pct AS DOUBLE)"
    return sql(f"""SELECT {half_even(x + ' / 5', 0)} * 5 AS x_bin_pct, {half_even(y + ' / 5', 0)} * 5 AS y_bin_pct,
        count(*) AS event_count, min(event_time) AS first_event_time, max(event_time) AS last_event_time
        FROM click_events WHERE event_type = '{kind}' AND {x} IS NOT NULL AND {y} IS NOT NULL AND {where}
        GROUP BY 1, 2 HAVING count(*) >= {least}""")


@query("heatmap_click", _bins("click"))
def _(t):
    return reports.heatmap(t.click_events, HeatmapConfig(ANY_PAGE, "click"))


@query("heatmap_scroll", _bins("scroll"))
def _(t):
    return reports.heatmap(t.click_events, HeatmapConfig(ANY_PAGE, "scroll"))


@query("heatmap_hover", _bins("mousemove"))
def _(t):
    return reports.heatmap(t.click_events, HeatmapConfig(ANY_PAGE, " Hover "))


@query("heatmap_page", _bins("click", f"page_url = '{CHECKOUT}'"))
def _(t):
    return reports.heatmap(t.click_events, HeatmapConfig(CHECKOUT, "click"))


@query("heatmap_filtered", _bins(
    "click",
    "event_time >= TIMESTAMP '2024-01-05 06:00:00' AND event_time <= TIMESTAMP '2024-01-25 18:00:00' "
    "AND viewport_width = 1440 AND viewport_height = 900 AND device_type = 'desktop'",
    least=2,
))
def _(t):
    return reports.heatmap(
        t.click_events,
        HeatmapConfig(
            ANY_PAGE,
            "click",
            start_time=datetime(2024, 1, 5, 6),
            end_time=datetime(2024, 1, 25, 18),
            viewport_width=1440,
            viewport_height=900,
            device_type="desktop",
            min_count=2,
        ),
    )


@query("scroll_bands", sql("""
    SELECT CAST(x AS DOUBLE) AS x_bin_pct, y_bin_pct, CAST(max(event_count) AS DOUBLE) AS event_count
    FROM scroll_bins, range(0, 101, 5) AS lanes(x) GROUP BY 1, 2"""))
def _(t):
    return reports.scroll_bands(reports.heatmap(t.click_events, HeatmapConfig(ANY_PAGE, "scroll")))


@query("density_grid", sql("""
    SELECT CAST(x AS INT) AS x_bin_pct, CAST(y AS INT) AS y_bin_pct, CAST(coalesce(event_count, 0) AS DOUBLE) AS event_count
    FROM (SELECT DISTINCT x_bin_pct AS x FROM click_bins) CROSS JOIN (SELECT DISTINCT y_bin_pct AS y FROM click_bins)
    LEFT JOIN click_bins ON x = x_bin_pct AND y = y_bin_pct"""))
def _(t):
    return reports.density_grid(reports.heatmap(t.click_events, HeatmapConfig(ANY_PAGE, "click")))


@query("heatmap_pixels", sql("""
    SELECT x_bin_pct, y_bin_pct, event_count, x_bin_pct * 1440 / 100 AS x_px, y_bin_pct * 900 / 100 AS y_px FROM click_bins"""))
def _(t):
    bins = reports.to_pixels(reports.heatmap(t.click_events, HeatmapConfig(ANY_PAGE, "click")), 1440, 900)
    return bins.select("x_bin_pct", "y_bin_pct", "event_count", "x_px", "y_px")


def _pages(where: str) -> str:
    return sql(f"SELECT page_url, count(*) AS events FROM click_events WHERE {where} GROUP BY 1")


def _scope(t, pattern: str):
    return t.click_events.where(reports.url_predicate(pattern)).groupBy("page_url").agg(F.count("*").alias("events"))


@query("page_filter_exact", _pages(f"page_url = '{CHECKOUT}'"))
def _(t):
    return _scope(t, f" {CHECKOUT} ")


@query("page_filter_wildcard", _pages("page_url LIKE '%/product/%'"))
def _(t):
    return _scope(t, "*/product/*")


@query("page_filter_anchored", _pages("page_url LIKE '/product/%'"))
def _(t):
    return _scope(t, "/product/*")


@query("page_filter_percent", _pages("page_url LIKE '%/100\\%off' ESCAPE '\\'"))
def _(t):
    return _scope(t, "*/100%off")


@query("page_filter_underscore", _pages("page_url LIKE '%plan=a\\_%' ESCAPE '\\'"))
def _(t):
    return _scope(t, "*plan=a_*")


def _stats(where: str) -> str:
    return sql(f"""SELECT count(*) AS total_sessions, {half_even('coalesce(avg(coalesce(deepest, 0)), 0)', 2)} AS avg_scroll_depth_pct,
        CASE WHEN count(*) = 0 THEN 0 ELSE {half_even('100.0::DOUBLE * count(*) FILTER (WHERE views = 1) / greatest(count(*), 1)', 2)} END AS bounce_rate_pct,
        coalesce(sum(events), 0)::BIGINT AS total_events FROM (
        SELECT session_id, count(*) FILTER (WHERE event_type = 'page_view') AS views, count(*) AS events,
            max(CAST(scroll_pct AS DOUBLE)) FILTER (WHERE event_type = 'scroll') AS deepest
        FROM click_events WHERE session_id <> '' AND {where} GROUP BY session_id)""")


@query("session_stats", _stats("true"))
def _(t):
    return reports.session_stats(t.click_events, ANY_PAGE)


@query("session_stats_page", _stats(f"page_url = '{CHECKOUT}'"))
def _(t):
    return reports.session_stats(t.click_events, CHECKOUT)


@query("session_stats_empty_scope", _stats("page_url = 'nowhere'"))
def _(t):
    return reports.session_stats(t.click_events, "nowhere")


@query("scoped_sessions", sql("SELECT session_id, count(*) AS events FROM click_events WHERE session_id <> '' GROUP BY 1"))
def _(t):
    return reports.scoped_sessions(t.click_events, ANY_PAGE).groupBy("session_id").agg(F.count("*").alias("events"))


@query("click_ranking", sql("""
    SELECT element_selector, count(*) AS click_count FROM click_events WHERE event_type = 'click' AND element_selector <> ''
    GROUP BY 1 ORDER BY click_count DESC, element_selector LIMIT 10"""))
def _(t):
    return reports.click_ranking(t.click_events, ANY_PAGE)


@query("click_ranking_top2", sql(f"""
    SELECT element_selector, count(*) AS click_count FROM click_events WHERE event_type = 'click' AND element_selector <> ''
        AND page_url = '{CHECKOUT}' GROUP BY 1 ORDER BY click_count DESC, element_selector LIMIT 2"""))
def _(t):
    return reports.click_ranking(t.click_events, CHECKOUT, limit=2)


@query("clicks_with_selector", sql("""
    SELECT event_id, element_selector FROM click_events WHERE event_type = 'click' AND element_selector <> ''"""))
def _(t):
    return reports.clicks_with_selector(t.click_events).select("event_id", "element_selector")


@query("ecommerce_events", sql("""
    SELECT event_id, event_type FROM click_events WHERE event_type IN ('product_view', 'add_to_cart', 'purchase')"""))
def _(t):
    rows = t.click_events.where(F.col("event_type").isin(*schemas.ECOMMERCE_TYPES))
    return rows.select("event_id", "event_type")


@query("catalog_search", """
    SELECT 'WIDGET' AS query, count(*) FILTER (WHERE contains(lower(p_name), 'widget')) AS results_count FROM part""")
def _(t):
    return reports.catalog_search(t.table("part"), "WIDGET", "p_name")
