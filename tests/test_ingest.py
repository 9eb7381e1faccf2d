"""Messages to tables: golden messages, loose JSON, stored tables, streams."""

import json
from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from behavior_spark import ingest, quality, reports, schemas, tables
from behavior_spark.streaming import fanout

NOW = "2024-05-01 00:00:00"
FIRST, SECOND, THIRD = "2024-04-02T17:45:10.000Z", "2024-04-02T17:46:00.000Z", "2024-04-02T17:52:31.250Z"
BASKET = [
    {"product_id": "tent-2p", "name": "Tent for two", "category": "camping", "price": 214.0, "quantity": 1, "position": 1},
    {"product_id": "peg", "name": "Ground peg", "category": "camping", "price": 0.85, "quantity": 12, "position": 2},
    {"product_id": "lamp", "name": "Head lamp", "category": "light", "price": 31.4, "quantity": 3, "position": 3},
]


def _purchase(event_id, at, total):
    """The whole basket under one order; ``total`` is what the shop says it cost."""
    order = {"order_id": "R-77", "total": total, "revenue": 318.4, "currency": "EUR", "products": BASKET}
    return {
        "event_id": event_id, "timestamp": at, "type": "purchase", "event_type": "purchase", "session_id": "walk", "anonymous_user_id": "hiker",
        "properties": order,
    }


_WHO = {"session_id": "walk", "anonymous_user_id": "hiker"}
GOLDEN = [
    {"event_id": "seen", "event_time": FIRST, "event_type": "product_view", "page_url": "https://shop.test/tents/2", "product_id": "tent-2p",
     "category": "camping", "price": 214.0, **_WHO},
    {"event_id": "put", "event_time": FIRST, "event_type": "add_to_cart", "properties": {"product_id": "peg", "category": "camping", "quantity": 12,
     "price": 0.85}, **_WHO},
    {"event_id": "put2", "event_time": SECOND, "event_type": "add_to_cart", "properties": {"product_id": "lamp", "quantity": 3, "price": 31.4}, **_WHO},
    _purchase("paid", SECOND, 323.39),
    _purchase("paid again", THIRD, 324.89),
    _purchase("paid late", FIRST, 318.4),
]


def frame(spark, messages):
    texts = [m if isinstance(m, str) else json.dumps(m) for m in messages]
    return spark.createDataFrame([(t,) for t in texts], "raw_message STRING")


@pytest.fixture(scope="module")
def golden(spark):
    return frame(spark, GOLDEN)


def test_new_columns_are_filled(golden):
    row = quality.column_coverage(ingest.normalize_events(golden, NOW)).first()
    assert (row.c_product_id, row.c_category, row.c_price, row.c_quantity, row.c_order_id) == (3, 2, 3, 2, 3)


def test_flat_and_nested_fields(golden):
    rows = {r.event_id: r for r in ingest.normalize_events(golden, NOW).collect()}
    assert (rows["seen"].product_id, rows["seen"].category, rows["seen"].price) == ("tent-2p", "camping", Decimal("214.00"))
    assert (rows["put"].product_id, rows["put"].quantity, rows["put"].price) == ("peg", 12, Decimal("0.85"))
    assert (rows["put2"].product_id, rows["put2"].category) == ("lamp", None)
    assert rows["seen"].device_type == "unknown"


def test_line_items_and_orders(golden):
    items = ingest.purchase_items(golden, NOW)
    assert items.count() == 9
    assert sorted((r.product_id, r.n) for r in reports.order_products(items).collect()) == [("lamp", 3), ("peg", 3), ("tent-2p", 3)]
    order = items.first().order_id
    assert reports.products_of(items, order).first().products == ["lamp"] * 3 + ["peg"] * 3 + ["tent-2p"] * 3
    headers = ingest.orders(golden, NOW)
    assert headers.count() == 3
    kept = tables.orders_latest(headers).collect()
    assert [(r.order_id, r.total, r.event_time) for r in kept] == [("R-77", Decimal("324.89"), datetime(2024, 4, 2, 17, 52, 31, 250_000))]
    assert [p["quantity"] for p in json.loads(kept[0].products_json)] == [1, 12, 3]


def test_alias_view(golden):
    row = reports.ga4_view(ingest.normalize_events(golden, NOW)).where("event_type = 'product_view'").first()
    assert (row.item_id, row.item_category, row.transaction_id, row.search_term) == ("tent-2p", "camping", None, None)


def test_loose_json(spark):
    messages = [
        "{not json",
        "[1, 2]",
        {"event_id": "n", "price": "139.495", "quantity": 2.5, "results_count": 4294967296, "viewport_width": 65536,
         "viewport_height": "900", "x_pct": "abc", "properties": {"x_pct": 3, "quantity": 7}},
        {"messageId": "m", "event": "view", "event_type": "", "timestamp": "nonsense", "anonymousId": "anon", "properties": "text"},
        {"event_id": "t", "event_time": "1711965600123", "userId": "w", "properties": {"session_id": "ps", "query": "", "search_term": "st"}},
        {"event_id": "e", "event_payload": "{}", "referrer": None, "product_id": 5},
    ]
    df = frame(spark, messages)
    good, bad = ingest.split_malformed(df)
    assert (good.count(), bad.count()) == (4, 2)
    rows = {r.event_id: r for r in ingest.normalize_events(df, NOW).collect()}
    assert set(rows) == {"n", "m", "t", "e"}
    n, m, t, e = rows["n"], rows["m"], rows["t"], rows["e"]
    assert (n.price, n.quantity, n.results_count, n.viewport_width, n.viewport_height, n.x_pct) == (
        Decimal("139.50"), 7, None, None, 900, 3.0,
    )
    assert (m.event_type, m.session_id, m.anonymous_user_id) == ("view", "anon", "anon")
    assert m.event_time == datetime(2024, 5, 1) == m.received_at
    assert (t.event_time, t.session_id, t.anonymous_user_id, t.search_query) == (
        datetime(2024, 4, 1, 10, 0, 0, 123_000), "ps", "w", "st",
    )
    assert (e.event_payload, e.product_id, e.session_id, e.referrer) == ("{}", "5", "unknown_session", None)


def test_missing_ids(spark):
    df = frame(spark, [{"event_type": "x"}, {"event_type": "y"}])
    digests = [r.event_id for r in ingest.normalize_events(df, NOW, new_id="digest").collect()]
    assert digests == [r.event_id for r in ingest.normalize_events(df, NOW, new_id="digest").collect()]
    assert len(set(digests)) == 2 and all(len(d) == 36 for d in digests)
    assert ingest.normalize_events(df, NOW).select("event_id").distinct().count() == 2
    with pytest.raises(ValueError):
        ingest.normalize_events(df, NOW, new_id="serial")


def test_order_without_products_gives_a_blank_row(spark):
    lists = [None, [], "none", {"product_id": "x"}]
    df = frame(spark, [{"type": "purchase", "properties": {"order_id": f"o{i}", "products": p}} for i, p in enumerate(lists)])
    rows = ingest.purchase_items(df, NOW).collect()
    assert sorted(r.order_id for r in rows) == ["o0", "o1", "o2", "o3"]
    assert all(r.product_id == "" and r.price is None and r.event_id == "" for r in rows)


def test_mixed_product_lists(spark):
    df = frame(spark, [{"type": "purchase", "properties": {"products": [{"product_id": "a", "price": {"x": 1}}, 5, None, {"product_id": "b"}]}}])
    assert sorted(r.product_id for r in ingest.purchase_items(df, NOW).collect()) == ["", "", "a", "b"]


def test_properties_of_another_kind(spark):
    kinds = [{"event_id": "a", "properties": [1]}, {"event_id": "b", "properties": 5, "price": 3}, {"event_id": "c", "properties": None}]
    df = frame(spark, [*kinds, '{"event_id": "d", "properties": {"price": 1', '{"event_id": "e", "properties": {"price": "7"}}'])
    rows = {r.event_id: r.price for r in ingest.normalize_events(df, NOW).collect()}
    assert rows == {"a": None, "b": Decimal("3.00"), "c": None, "e": Decimal("7.00")}


def test_purchase_message_filter(spark):
    kinds = [{"type": "purchase"}, {"type": "track", "event": "Order Completed"}, {"type": "track", "event": "purchase"}, {"type": "page"}]
    df = frame(spark, kinds)
    assert ingest.orders(df, NOW).count() == 2
    assert ingest.orders(df, NOW, include_track_purchase=True).count() == 3


def test_explode_batch_passes_plain_messages_on(spark):
    envelope = {"batch": [{"type": "track", "event": "click", "timestamp": FIRST}, {"type": "track", "event": "scroll"}], "sentAt": THIRD}
    rows = ingest.explode_batch(frame(spark, [envelope, {"event_id": "plain"}, "{broken", {"batch": []}])).collect()
    assert sorted(str(r.event) for r in rows) == ["None", "None", "click", "scroll"]
    assert "{broken" in [r.raw_message for r in rows]
    assert {r.sent_at for r in rows if r.event} == {datetime(2024, 4, 2, 17, 52, 31, 250_000)}


# ---- stored tables -------------------------------------------------------------------------


def _events(spark):
    months = [{"event_id": f"e{i}", "event_time": f"2024-0{1 + i % 3}-05T00:00:00Z", "event_type": "click", "page_url": f"p{i % 2}"} for i in range(30)]
    return ingest.normalize_events(frame(spark, months), NOW)


def test_append_and_scan_prune_months(spark, folder):
    tables.append_events(_events(spark), folder)
    tables.append_events(_events(spark).limit(5).drop("cart_value"), folder)
    scan = tables.events(spark, folder, ["event_id"], datetime(2024, 2, 1), datetime(2024, 2, 28))
    assert scan.count() >= 10
    plan = scan._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "event_month" in plan.split("PartitionFilters")[1].split("PushedFilters")[0]
    assert tables.events(spark, folder).schema == schemas.CLICK_EVENTS
    assert tables.events(spark, folder).count() == 35


def test_write_batch_replaces_itself(spark, folder):
    rows = spark.range(10).select(
        F.col("id").alias("category_id"), F.lit(None).cast("bigint").alias("parent_id"), F.lit("h").alias("row_hash"),
        F.lit("f").alias("source_file"), F.col("id").alias("source_row_num"), F.lit(NOW).cast("timestamp").alias("ingested_at"),
    )
    for batch in ("0123456789012345", "0123456789012345", "1e10000000000000"):
        tables.write_batch(rows, folder, batch)
    stored = tables.dataset_table(spark, folder, "category_tree")
    assert stored.count() == 20
    assert {r[0] for r in stored.select("load_batch_id").distinct().collect()} == {"0123456789012345", "1e10000000000000"}
    assert ingest.already_loaded(stored, "1e10000000000000") and not ingest.already_loaded(stored, "other")
    assert tables.dataset_latest(stored, "category_tree").count() == 10


def test_align_adds_casts_and_orders(spark):
    old = spark.createDataFrame([("7", "x")], "quantity STRING, event_id STRING")
    row = tables.align(old, schemas.CLICK_EVENTS)
    assert row.schema == schemas.CLICK_EVENTS and row.first().quantity == 7


def test_latest_takes_highest_version_then_tiebreak(spark):
    df = spark.createDataFrame([("a", 1, 5), ("a", 2, 1), ("a", 2, 3), ("b", None, 1), ("b", 1, 0)], "k STRING, v INT, t INT")
    found = {(r.k, r.v, r.t) for r in tables.latest(df, ["k"], "v", ["t"]).collect()}
    assert found == {("a", 2, 3), ("b", 1, 0)}


def test_large_orders_are_one_row_per_product(spark):
    items = spark.range(1000).selectExpr(
        "concat('e', id) AS event_id", "CASE WHEN id < 900 THEN '' ELSE concat('o', id % 10) END AS order_id",
        "concat('p', id % 7) AS product_id", "id AS position", "timestamp_seconds(id) AS event_time",
    )
    rows = reports.order_products(items).collect()
    blank = [r for r in rows if r.order_id == ""]
    assert len(blank) == 7 and sum(r.n for r in blank) == 900
    assert sum(r.n for r in rows) == 1000


# ---- streams -------------------------------------------------------------------------------


def test_stream_equals_batch_and_replay_changes_nothing(spark, golden, folder):
    golden.unionByName(frame(spark, ["{bad"])).write.text(f"{folder}/in")
    paths = fanout.Paths.below(folder)
    stream = ingest.read_text_stream(spark, f"{folder}/in", max_files=1)
    ingest.start_fanout(stream, paths, f"{folder}/checkpoint", {"availableNow": True}, NOW).awaitTermination()

    def stored():
        return {
            "events": sorted(map(str, tables.events(spark, paths.events).collect())),
            "items": sorted(map(str, tables.purchase_items(spark, paths.items).collect())),
            "orders": sorted(map(str, tables.orders(spark, paths.orders).collect())),
        }

    found = stored()
    assert found["events"] == sorted(map(str, ingest.normalize_events(golden, NOW).collect()))
    assert found["items"] == sorted(map(str, ingest.purchase_items(golden, NOW).collect()))
    assert found["orders"] == sorted(map(str, ingest.orders(golden, NOW).collect()))
    assert spark.read.parquet(paths.malformed).count() == 1

    # A micro-batch written again takes the place of its first version.
    run = spark.read.json(f"{folder}/checkpoint/metadata").first()["id"]
    batches = spark.read.parquet(paths.malformed).select("ingest_batch").distinct().collect()
    again = frame(spark, ["{bad"])
    fanout.write_fanout(again, batches[0][0], run, fanout.Paths.below(f"{folder}/replay"), NOW)
    fanout.write_fanout(again, batches[0][0], run, fanout.Paths.below(f"{folder}/replay"), NOW)
    assert spark.read.parquet(f"{folder}/replay/malformed").count() == 1
    # A restart from the checkpoint finds nothing new.
    ingest.start_fanout(stream, paths, f"{folder}/checkpoint", {"availableNow": True}, NOW).awaitTermination()
    assert stored() == found
