"""Tracker rules against plain loops on random data."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from behavior_spark import tracker
from behavior_spark.operators import thinning
from behavior_spark.operators.running import Running, by_position, running
from behavior_spark.session import release


def timed(spark, rows, columns):
    """Rows whose first value is epoch milliseconds."""
    df = spark.createDataFrame(rows, f"ms BIGINT, {columns}")
    return df.withColumn("event_time", F.timestamp_millis("ms")).drop("ms")


# ---- thinning ------------------------------------------------------------------------------


def thinned(rows, ms):
    """rows: (time, key, id); returns the kept ids."""
    kept, last = set(), {}
    for at, key, name in sorted(rows, key=lambda r: (r[0], r[2])):
        if key not in last or at - last[key] >= ms:
            kept.add(name)
            last[key] = at
    return kept


@pytest.mark.parametrize("ms, gap, arrow_rows", [(100, 250, 7), (100, 12, 1000), (1, 2, 50), (90_000, 20_000, 13), (60_000, 40_000, 3)])
def test_throttle_equals_loop(spark, ms, gap, arrow_rows):
    rng = random.Random(ms * 31 + gap)
    rows, number = [], 0
    for key, count in (("hot", 1500), ("a", 200), ("b", 3), (None, 60)):
        at = rng.randrange(1_700_000_000_000, 1_700_000_200_000)
        for _ in range(count):
            at += rng.randrange(gap) if rng.random() < 0.97 else rng.randrange(200_000)
            rows.append((at, key, f"e{number:06d}"))
            number += 1
    rng.shuffle(rows)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(arrow_rows))
    try:
        df = timed(spark, rows, "session_id STRING, event_id STRING").withColumn("extra", F.lit(2**60 + 1))
        found = tracker.throttle(df, ms, ["session_id"]).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(r.event_id for r in found) == sorted(thinned(rows, ms))
    assert {r.extra for r in found} == {2**60 + 1}


def test_throttle_splits_a_hot_session(spark):
    """The large rows are shuffled by session and slice, never by the session alone."""
    df = timed(spark, [(1, "s", "e")], "session_id STRING, event_id STRING")
    plan = tracker.throttle(df, keys=["session_id"])._jdf.queryExecution().optimizedPlan().toString()
    by_session = [line for line in plan.splitlines() if "RepartitionByExpression" in line and "_slice" not in line]
    assert len(by_session) == 1  # the short rows, one per slice
    assert thinning.SLICE_MS == 60_000


def test_throttle_needs_a_positive_interval(spark):
    with pytest.raises(ValueError):
        tracker.throttle(timed(spark, [(1, "s", "e")], "session_id STRING, event_id STRING"), 0)


# ---- running values ------------------------------------------------------------------------


@pytest.mark.parametrize("parts", [1, 7, 40])
def test_running_values_equal_loop(spark, parts):
    rng = random.Random(parts)
    rows = [
        (1_700_000_000_000 + rng.randrange(0, 400_000, 500), rng.choice(["hot", "hot", "x", None]), f"e{i:04d}",
         rng.choice([None, rng.randrange(-50, 50)]))
        for i in range(600)
    ]
    df = timed(spark, rows, "k STRING, event_id STRING, v INT")
    values = [Running("s", "sum", "v"), Running("lo", "min", "v"), Running("hi", "max", "v"), Running("l", "last", "v"),
              Running("prior", "last", "v", before=True), Running("s0", "sum", "v", before=True)]
    out = running(df, ["k"], ["event_time", "event_id"], values, parts=parts)
    found = {r.event_id: (r.s, r.lo, r.hi, r.l, r.prior, r.s0) for r in out.collect()}
    expected = {}
    for key in {r[1] for r in rows}:
        seen = []
        for _at, _k, name, v in sorted((r for r in rows if r[1] == key), key=lambda r: (r[0], r[2])):
            before = list(seen)
            if v is not None:
                seen.append(v)
            expected[name] = (
                sum(seen) if seen else None, min(seen, default=None), max(seen, default=None), seen[-1] if seen else None,
                before[-1] if before else None, sum(before) if before else None,
            )
    assert found == expected


def test_one_instant_of_one_key_is_shared_out(spark):
    df = spark.range(1_000_000).selectExpr("'k' AS k", "timestamp_seconds(0) AS event_time", "concat('e', id) AS event_id", "1 AS v")
    sliced = by_position(df, ["k"], ["event_time", "event_id"], 16)
    sizes = [r["count"] for r in sliced.groupBy("_slice").count().collect()]
    assert sum(sizes) == 1_000_000 and max(sizes) < 150_000
    assert release(spark) > 0


def test_running_checks_its_arguments(spark):
    df = timed(spark, [(1, "s", "e")], "k STRING, event_id STRING")
    with pytest.raises(ValueError):
        running(df, ["k"], ["event_time"], [Running("x", "mean", "k")])


def test_running_max_scroll(spark):
    rows = [(t, "s", f"e{t}", "scroll", p) for t, p in ((1, 10.0), (2, 40.0), (3, 20.0), (1_000_000, 30.0), (1_000_001, 60.0))]
    df = timed(spark, rows, "session_id STRING, event_id STRING, event_type STRING, scroll_pct FLOAT")
    found = {r.event_id: r.max_scroll_pct for r in tracker.running_max_scroll(df).collect()}
    assert found == {"e1": 10.0, "e2": 40.0, "e3": 40.0, "e1000000": 40.0, "e1000001": 60.0}


def replay(actions):
    """actions in order: (kind, product, quantity, price); the cart's value after each."""
    cart, values = {}, []
    for kind, product, quantity, price in actions:
        if kind == "add_to_cart":
            held = cart.get(product, (0, 0.0))[0]
            cart[product] = (held + quantity, price)
        elif kind == "remove_from_cart" and product in cart:
            left = max(0, cart[product][0] - quantity)
            if left:
                cart[product] = (left, cart[product][1])
            else:
                del cart[product]
        values.append(math.floor(sum(q * p for q, p in cart.values()) * 100 + 0.5) / 100)
        if kind == "purchase":
            cart = {}
    return values


@pytest.mark.parametrize("parts", [None, 23])
def test_cart_value_equals_replay(spark, parts):
    rng = random.Random(7)
    rows, expected, number = [], {}, 0
    for session, count in [("hot", 700), (None, 90)] + [(f"s{i}", 60) for i in range(15)]:
        at, actions, names = 1_700_000_000_000, [], []
        for _ in range(count):
            at += rng.choice([0, 40, 400, 3000])
            kind = rng.choices(["add_to_cart", "remove_from_cart", "purchase"], [6, 5, 1 if session != "hot" else 0.05])[0]
            product = None if kind == "purchase" else f"p{rng.randrange(4)}"
            quantity = None if kind == "purchase" else rng.randrange(1, 4)
            price = rng.randrange(1, 2000) / 4 if kind == "add_to_cart" else None
            name = f"e{number:06d}"
            number += 1
            actions.append((kind, product, quantity, price))
            names.append(name)
            rows.append((at, session, name, kind, product, quantity, price))
        expected.update(zip(names, replay(actions)))
    rng.shuffle(rows)
    df = timed(spark, rows, "session_id STRING, event_id STRING, event_type STRING, product_id STRING, quantity INT, price DOUBLE")
    found = {r.event_id: r.cart_value for r in tracker.cart_value(df, parts=parts).collect()}
    assert found == expected


@pytest.mark.parametrize("default", [True, False])
def test_consent_gate_equals_loop(spark, default):
    rng = random.Random(3)
    events = [(rng.randrange(0, 4000, 10), rng.choice("abc"), f"e{i}") for i in range(400)]
    changes = [(rng.randrange(0, 4000, 10), rng.choice("ab"), rng.random() < 0.5) for _ in range(60)]
    expected = set()
    for at, user, name in events:
        past = [(t, yes) for t, u, yes in changes if u == user and t <= at]
        if max(past, default=(0, default))[1]:
            expected.add(name)
    gated = tracker.consent_gate(
        timed(spark, events, "anonymous_user_id STRING, event_id STRING"),
        timed(spark, changes, "anonymous_user_id STRING, consented BOOLEAN"),
        default,
        parts=9,
    )
    assert gated.columns == ["anonymous_user_id", "event_id", "event_time"]
    assert {r.event_id for r in gated.collect()} == expected


def test_denied_consent_keeps_nothing(spark):
    events = timed(spark, [(1, "u", "e1"), (9, "u", "e2")], "anonymous_user_id STRING, event_id STRING")
    never = timed(spark, [(0, "u", False)], "anonymous_user_id STRING, consented BOOLEAN")
    assert tracker.consent_gate(events, never, default=True).count() == 0


def test_first_purchase_per_order(spark):
    rows = [(1, "u", "o1", "a"), (2, "u", "o1", "b"), (3, "v", "o1", "c"), (4, "u", "", "d"), (5, "u", None, "e")]
    df = timed(spark, rows, "anonymous_user_id STRING, order_id STRING, event_id STRING")
    assert {r.event_id for r in tracker.first_purchase(df).collect()} == {"a", "c"}


# ---- calls ---------------------------------------------------------------------------------


def checked(spark, calls, lenient=False):
    df = spark.createDataFrame([(i, m, json.dumps(p)) for i, (m, p) in enumerate(calls)], "id INT, method STRING, payload STRING")
    events, rejects = tracker.validate_events(df, lenient)
    return {r.id: r for r in events.collect()}, {r.id for r in rejects.collect()}


def test_tracker_calls(spark):
    calls = [
        ("product_view", {"product_id": "SKU-1", "category": "electronics", "price": 19.99, "currency": "USD"}),
        ("product_view", {"category": "electronics"}),
        ("add_to_cart", {"product_id": "SKU-2", "quantity": 2, "price": 10.0}),
        ("add_to_cart", {"product_id": "SKU-2", "quantity": 2}),
        ("add_to_cart", {"product_id": "SKU-2", "quantity": 2, "price": None}),
        ("add_to_cart", {"product_id": "SKU-2", "quantity": 0.3, "price": 1}),
        ("remove_from_cart", {"product_id": "SKU-2", "quantity": 1.5}),
        ("remove_from_cart", {"product_id": "SKU-2", "quantity": -1}),
        ("purchase", {"order_id": "O1", "items": [{"product_id": "a", "quantity": 1, "price": 10}, {"product_id": "b", "price": 10, "quantity": 2}, {"price": 3}]}),
        ("purchase", {"order_id": "O2", "total": 30, "items": [{"product_id": "a", "quantity": 0}]}),
        ("purchase", {"order_id": "O3"}),
        ("purchase", {"total": 3}),
        ("search", {"query": "  wireless headphones ", "results_count": 12}),
        ("search", {"query": " \t"}),
        ("search", {"query": "x", "results_count": -4}),
        ("unknown", {}),
    ]
    events, rejects = checked(spark, calls)
    assert rejects == {1, 3, 5, 7, 11, 13, 15}
    assert (events[0].price, events[0].currency) == (19.99, "USD")
    assert events[4].price == 0.0
    assert events[6].quantity == 2
    assert (events[8].total, len(events[8].products)) == (30.0, 2)
    assert (events[9].total, events[9].products[0].quantity) == (30.0, 1)
    assert (events[10].total, events[10].products) == (None, None)
    assert (events[12].search_query, events[12].results_count) == ("wireless headphones", 12)
    assert events[14].results_count == 0


def test_lenient_calls(spark):
    calls = [
        ("product_view", {"product_id": "p", "price": "abc"}),
        ("add_to_cart", {"product_id": "p"}),
        ("remove_from_cart", {"product_id": "p", "quantity": -3}),
        ("purchase", {"order_id": "o", "items": [{"product_id": "a", "price": 5}]}),
    ]
    events, rejects = checked(spark, calls, lenient=True)
    assert rejects == set()
    assert (events[0].price, events[0].currency) == (0.0, "USD")
    assert (events[1].quantity, events[1].price, events[2].quantity) == (1, 0.0, 1)
    assert events[3].products is None and events[3].total is None


def test_coordinates_scroll_and_selector(spark):
    df = spark.createDataFrame(
        [(10, 20, 0, 30, 1000, 0, 600, 150, "BUTTON", "buy", "x"), (2000, 333, None, 0, 1000, 1000, 400, 50, "DIV", "", "card  wide"),
         (-5, 12, 0, 0, 1000, 800, 400, 200, "A", None, None)],
        "client_x INT, client_y INT, scroll_x INT, scroll_y INT, document_width INT, document_height INT, window_height INT, "
        "scroll_top INT, element_tag STRING, element_id STRING, element_class STRING",
    )
    rows = tracker.selector(tracker.scroll_pct(tracker.normalize_coordinates(df))).collect()
    assert [(r.x_pct, r.y_pct) for r in rows] == [(1.0, 0.0), (100.0, 33.3), (0.0, 1.5)]
    assert [r.scroll_pct for r in rows] == [0.0, 8.0, 50.0]
    assert [r.element_selector for r in rows] == ["button#buy", "div.card.wide", "a"]
