"""Reports on small frames."""

from datetime import datetime

import pytest

from behavior_spark import reports, tables
from behavior_spark.operators.reports import HeatmapConfig, heatmap_event_type


@pytest.fixture(scope="module")
def events(spark):
    rows = [
        ("e1", "s1", "page_view", "https://e.com/product/1", None, None, None, None),
        ("e2", "s1", "click", "https://e.com/product/1", 42.5, 63.1, None, "a#x"),
        ("e3", "s1", "click", "https://e.com/product/1", 42.4, 63.2, None, "b"),
        ("e4", "s2", "page_view", "https://e.com/product/2", None, None, None, None),
        ("e5", "s2", "page_view", "https://e.com/product/2", None, None, None, None),
        ("e6", "s2", "scroll", "https://e.com/product/1", None, None, 75.0, None),
        ("e7", "", "click", "https://e.com/product/1", 1.0, 1.0, None, "b"),
        ("e8", "s3", "scroll", "https://e.com/100%off_x", None, None, 12.5, None),
        ("e9", "s3", "click", "https://e.com/100%off_x", None, 3.0, None, ""),
    ]
    return spark.createDataFrame(
        rows,
        "event_id STRING, session_id STRING, event_type STRING, page_url STRING, x_pct FLOAT, y_pct FLOAT, scroll_pct FLOAT, element_selector STRING",
    ).selectExpr("*", "timestamp_seconds(1700000000 + CAST(substr(event_id, 2) AS INT)) AS event_time", "1440 AS viewport_width")


def test_bins_round_half_to_even(events):
    rows = reports.heatmap(events, HeatmapConfig("https://e.com/product/1", "click")).collect()
    assert [(r.x_bin_pct, r.y_bin_pct, r.event_count) for r in rows] == [(40.0, 65.0, 2), (0.0, 0.0, 1)]
    rows = reports.heatmap(events, HeatmapConfig("*", "Scroll", end_time=datetime(2024, 1, 1))).collect()
    assert [(r.x_bin_pct, r.y_bin_pct) for r in rows] == [(50.0, 10.0), (50.0, 75.0)]
    assert reports.heatmap(events, HeatmapConfig("*", "click", min_count=2)).count() == 1
    assert reports.heatmap(events, HeatmapConfig("*", "click", viewport_width=390)).count() == 0


def test_url_scopes(events):
    def count(pattern):
        return events.where(reports.url_predicate(pattern)).count()

    assert count(" https://e.com/product/1 ") == 5
    assert count("*/product/*") == 7
    assert count("/product/*") == 0
    assert count("*100%off_*") == 2
    assert count("*100%of__*") == 0
    for blank in ("", "  ", None):
        with pytest.raises(ValueError):
            reports.url_predicate(blank)
    assert reports.normalize_url_filter("page", " * ") == "*"
    assert reports.normalize_url_filter(" page ", "  ") == "page"


def test_event_type_check():
    assert [heatmap_event_type(t) for t in (" CLICK ", "Hover", "mousemove")] == ["click", "mousemove", "mousemove"]
    with pytest.raises(ValueError):
        heatmap_event_type("purchase")


def test_session_stats(events):
    row = reports.session_stats(events, "https://e.com/*").first()
    assert tuple(row) == (3, 29.17, 33.33, 8)
    assert tuple(reports.session_stats(events, "nowhere").first()) == (0, 0.0, 0.0, 0)


def test_session_stats_reads_events_once(events):
    plan = reports.session_stats(events, "*")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") == 1


def test_click_ranking(events):
    assert [tuple(r) for r in reports.click_ranking(events, "*").collect()] == [("b", 2), ("a#x", 1)]
    assert [tuple(r) for r in reports.click_ranking(events, "*", limit=0).collect()] == [("b", 2)]


def test_bands_grid_and_pixels(events):
    scroll = reports.scroll_bands(reports.heatmap(events, HeatmapConfig("*", "scroll")))
    assert scroll.count() == 42
    clicks = reports.heatmap(events, HeatmapConfig("*", "click"))
    grid = {(r.x_bin_pct, r.y_bin_pct): r.event_count for r in reports.density_grid(clicks).collect()}
    assert grid == {(40, 65): 2.0, (0, 0): 1.0, (40, 0): 0.0, (0, 65): 0.0}
    assert reports.density_grid(clicks.limit(0)).count() == 441
    pixels = {(r.x_px, r.y_px) for r in reports.to_pixels(clicks, 1440, 900).collect()}
    assert pixels == {(576.0, 585.0), (0.0, 0.0)}


def test_score_comparison_matches_all_pairs(spark):
    """Pairs within a session, first n of all, against the full join."""
    rules = spark.range(60).selectExpr(
        "concat('s', id % 3) AS session_id", "concat('u', id) AS anonymous_user_id", "'live' AS source",
        "CAST(id AS INT) AS lead_score", "'hot' AS score_tier",
    )
    model = spark.range(40).selectExpr(
        "concat('s', id % 4) AS session_id", "concat('m', id) AS anonymous_user_id", "'live' AS source",
        "CAST((id * 7 % 5) / 10.0 AS FLOAT) AS ml_lead_score", "'v' AS model_version", "timestamp_seconds(id) AS scored_at",
    )
    left, right = tables.ml_scores_latest(model).collect(), rules.collect()
    pairs = sorted(
        (-m.ml_lead_score, m.session_id, m.source, m.anonymous_user_id, r.source, r.anonymous_user_id, r.lead_score)
        for m in left for r in right if m.session_id == r.session_id
    )[:30]
    found = [(r.anonymous_user_id, r.rule_score) for r in reports.score_comparison(rules, model, n=30).collect()]
    assert found == [(p[5], p[6]) for p in pairs]
