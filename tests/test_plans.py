"""Physical plans: what is read, pushed down, parsed and shuffled."""

import re

import pytest

from behavior_spark import features, ingest, ml, reports, tables, tracker
from behavior_spark.operators.reports import HeatmapConfig
from behavior_spark.plans.fixtures import Inputs


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def events(spark, tmp_path_factory):
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    spark.conf.set("spark.sql.debug.maxToStringFields", "1000")
    folder = str(tmp_path_factory.mktemp("plans") / "events")
    tables.append_events(Inputs(spark, "/root/testdata/sf0.001").click_events, folder)
    return tables.events(spark, folder)


def test_features_read_their_columns_only(events):
    text = plan(features.live_sessions(events))
    read = re.search(r"ReadSchema: struct<([^>]*)>", text).group(1)
    assert set(re.findall(r"(\w+):", read)) == {
        "event_time", "event_type", "scroll_pct", "session_id", "anonymous_user_id", "product_id",
    }


def test_heatmap_filters_reach_the_scan(events):
    text = plan(reports.heatmap(events, HeatmapConfig("https://example.com/checkout", "click")))
    pushed = re.search(r"PushedFilters: \[([^\]]*)\]", text).group(1)
    assert "EqualTo(page_url,https://example.com/checkout)" in pushed and "EqualTo(event_type,click)" in pushed
    assert text.count("Exchange hashpartitioning") == 1


def test_a_message_is_parsed_once(spark, tmp_path):
    path = str(tmp_path / "messages")
    Inputs(spark, "/root/testdata/sf0.001").messages.write.text(path)
    messages = spark.read.text(path).toDF("raw_message")
    parses = [line for line in plan(ingest.normalize_events(messages)).splitlines() if "from_json(StructField(event_id" in line]
    assert len(parses) == 1


def test_one_source_leaves_the_other_out(spark):
    t = Inputs(spark, "/root/testdata/sf0.001")
    both = plan(features.session_features(t.click_events, t.dataset_events))
    one = plan(features.session_features(t.click_events, t.dataset_events, "live"))
    assert both.count("FileScan") == 2 and one.count("FileScan") == 1


def test_keep_latest_prunes_before_the_shuffle(events):
    text = plan(tables.latest(events, ["session_id"], "event_time", ["event_id"]))
    assert "Partial" in text.split("Exchange")[1] and "WindowGroupLimit" in text.split("Exchange")[1]


def test_ordered_rules_shuffle_rows_by_slice(events):
    """Wide rows go by session and slice; only short rows go by session."""
    for df in (tracker.running_max_scroll(events), tracker.cart_value(events)):
        text = plan(df)
        exchanges = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", text)
        assert re.search(r"_slice", exchanges[0]) and len(exchanges) <= 6
        assert "event_month" not in text  # the events themselves are not scanned again


def test_top_k_and_no_cross_join(spark, events):
    assert "TakeOrderedAndProject" in plan(reports.click_ranking(events, "*"))
    t = Inputs(spark, "/root/testdata/sf0.001")
    for df in (
        reports.density_grid(reports.heatmap(events, HeatmapConfig("*", "click"))),
        reports.top_leads(t.ml_scores, t.scored),
        ml.rule_baseline(ml.label(t.sessions)),
    ):
        assert "CartesianProduct" not in plan(df) and "NestedLoopJoin" not in plan(df)
