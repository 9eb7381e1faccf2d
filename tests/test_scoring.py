"""Rule scores: one row per case."""

import pytest
from pyspark.sql import functions as F

from behavior_spark import features, reports, schemas, scoring

UNSET = {
    "anonymous_user_id": "a", "page_views": 2, "product_views": 0, "add_to_cart_count": 0, "purchase_count": 0,
    "search_count": 0, "max_scroll_pct": None, "session_duration_seconds": 30, "distinct_products_viewed": 0,
    "cart_abandoned": 0, "source": "live",
}

CASES = {
    "nothing": ({}, 0, "cold", {}),
    "cart": ({"add_to_cart_count": 1}, 30, "warm", {"add_to_cart": 30}),
    "purchase": ({"purchase_count": 1}, 20, "cold", {"purchase": 20}),
    "cart and purchase": ({"add_to_cart_count": 1, "purchase_count": 1}, 50, "warm", {"add_to_cart": 30, "purchase": 20}),
    "hot at sixty": (
        {"add_to_cart_count": 1, "purchase_count": 1, "search_count": 1}, 60, "hot",
        {"add_to_cart": 30, "purchase": 20, "search_intent": 10},
    ),
    "three products": ({"distinct_products_viewed": 3}, 15, "cold", {"browsing_depth": 15}),
    "ten products": ({"distinct_products_viewed": 10}, 15, "cold", {"browsing_depth": 15}),
    "two products": ({"distinct_products_viewed": 2}, 0, "cold", {}),
    "search": ({"search_count": 4}, 10, "cold", {"search_intent": 10}),
    "scroll at seventy": ({"max_scroll_pct": 70.0}, 0, "cold", {}),
    "scroll above seventy": ({"max_scroll_pct": 70.01}, 10, "cold", {"scroll_engagement": 10}),
    "scroll unknown": ({"max_scroll_pct": None}, 0, "cold", {}),
    "bouncer": ({"page_views": 1}, 0, "cold", {"bouncer": -10}),
    "one page and a product": ({"page_views": 1, "product_views": 1}, 0, "cold", {}),
    "one page and a search": ({"page_views": 1, "search_count": 1}, 10, "cold", {"search_intent": 10}),
    "one page and a cart": ({"page_views": 1, "add_to_cart_count": 1}, 30, "warm", {"add_to_cart": 30}),
    "one page and a purchase": ({"page_views": 1, "purchase_count": 1}, 20, "cold", {"purchase": 20}),
    "no page": ({"page_views": 0}, 0, "cold", {}),
    "all": (
        {"add_to_cart_count": 5, "purchase_count": 3, "distinct_products_viewed": 10, "search_count": 7, "max_scroll_pct": 99.0},
        85, "hot",
        {"add_to_cart": 30, "purchase": 20, "browsing_depth": 15, "search_intent": 10, "scroll_engagement": 10},
    ),
    "dataset cart": (
        {"source": "retailrocket", "page_views": 0, "product_views": 5, "distinct_products_viewed": 5, "add_to_cart_count": 2},
        45, "warm", {"add_to_cart": 30, "browsing_depth": 15},
    ),
    "dataset purchase": (
        {"source": "retailrocket", "page_views": 0, "product_views": 3, "distinct_products_viewed": 3,
         "add_to_cart_count": 1, "purchase_count": 1},
        65, "hot", {"add_to_cart": 30, "purchase": 20, "browsing_depth": 15},
    ),
}


@pytest.fixture(scope="module")
def sessions(spark):
    names = [n for n in schemas.SESSION_FEATURES.names if n not in ("first_event_at", "last_event_at")]
    rows = [{**UNSET, **changes, "session_id": name} for name, (changes, *_rest) in CASES.items()]
    return features.conform(
        spark.createDataFrame([[None if r[n] is None else str(r[n]) for n in names] for r in rows], ", ".join(f"{n} STRING" for n in names))
    )


def test_scores_tiers_and_contributions(sessions):
    found = {
        r["session_id"]: (r["lead_score"], r["score_tier"], dict(r["rule_contributions"]))
        for r in scoring.score_with_contributions(sessions).collect()
    }
    assert found == {name: (score, tier, fired) for name, (_c, score, tier, fired) in CASES.items()}


def test_source_and_row_count_are_kept(sessions):
    scored = scoring.score(sessions)
    assert scored.count() == len(CASES)
    assert scored.where("source = 'retailrocket'").count() == 2


def test_no_sessions_give_no_scores(sessions):
    assert scoring.score(sessions.limit(0)).count() == 0


def test_scores_are_clamped(sessions):
    rules = (scoring.Rule("huge", 500, "page_views = 2"), scoring.Rule("low", -500, "page_views <> 2"))
    low, high = scoring.score(sessions, rules).agg(F.min("lead_score"), F.max("lead_score")).first()
    assert (low, high) == (0, 100)


def test_conform_casts_and_keeps_null_scroll(sessions):
    assert sessions.schema == schemas.SESSION_FEATURES
    assert sessions.where("max_scroll_pct IS NULL").count() == sum(
        1 for changes, *_r in CASES.values() if changes.get("max_scroll_pct") is None
    )
    with pytest.raises(ValueError):
        features.conform(sessions.drop("page_views"))


def test_labels_of_fired_rules(sessions):
    rows = reports.triggered_rules(scoring.score(sessions))
    found = {r["session_id"]: r["triggered_rules"] for r in rows.collect()}
    assert found["nothing"] == []
    assert found["bouncer"] == ["Bouncer"]
    assert found["cart and purchase"] == ["Added to Cart", "Purchased"]
