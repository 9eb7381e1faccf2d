"""Queries over session features, rule scores and the checks on them."""

from __future__ import annotations

from pyspark.sql import functions as F

from behavior_spark import schemas
from behavior_spark.functions import round_half_even, span_seconds
from behavior_spark.operators import features, quality, reports, scoring
from behavior_spark.plans.oracle import half_even, sql
from behavior_spark.plans.registry import query

_FEATURES = ", ".join(c if c != "max_scroll_pct" else "CAST(max_scroll_pct AS DOUBLE) AS max_scroll_pct" for c in schemas.SESSION_FEATURES.names)
_FLAGS = "rule_add_to_cart, rule_purchase, rule_browsing_depth, rule_search_intent, rule_scroll_engagement, rule_bouncer"


@query("unified_events", sql("SELECT * FROM unified"))
def _(t):
    return features.unified_events(t.click_events, t.dataset_events)


@query("live_session_features", sql(f"SELECT {_FEATURES} FROM live"))
def _(t):
    return t.live


@query("dataset_session_features", sql(f"SELECT {_FEATURES} FROM dataset"))
def _(t):
    return t.dataset


@query("session_features", sql(f"SELECT {_FEATURES} FROM sessions"))
def _(t):
    return t.sessions


@query("session_features_by_source", sql(f"SELECT {_FEATURES} FROM sessions WHERE source = 'live'"))
def _(t):
    return features.session_features(t.click_events, t.dataset_events, schemas.SOURCE_LIVE)


@query("real_sessions", sql("""
    SELECT event_id, session_id, anonymous_user_id FROM click_events
    WHERE session_id NOT IN ('', 'unknown_session') AND anonymous_user_id <> ''"""))
def _(t):
    return t.click_events.where(features.real_session()).select("event_id", "session_id", "anonymous_user_id")


@query("conform_features", sql(f"SELECT {_FEATURES} FROM live"))
def _(t):
    loose = t.live.select(*[F.col(c).cast("string").alias(c) for c in t.live.columns])
    return features.conform(loose)


@query("session_span", sql("""
    SELECT user_id, date_diff('second', min(ts), max(ts)) AS seconds FROM base GROUP BY user_id"""))
def _(t):
    return t.base.groupBy("user_id").agg(span_seconds(F.min("ts"), F.max("ts")).alias("seconds"))


@query("round_half_even", sql(f"""
    SELECT n, {half_even('k / 2.0::DOUBLE', 0)} AS whole, {half_even('value * k', 2)} AS cents FROM base"""))
def _(t):
    return t.base.select(
        "n",
        round_half_even(F.col("k") / 2).alias("whole"),
        round_half_even(F.col("value") * F.col("k"), 2).alias("cents"),
    )


# ---- rule scores ---------------------------------------------------------------------------


@query("rule_scores", sql("SELECT * FROM scored"))
def _(t):
    return t.scored


@query("rule_contributions", sql("""
    SELECT session_id, anonymous_user_id, source, first_event_at, last_event_at, lead_score, score_tier,
        array_to_string(list_sort(list_filter([
            CASE WHEN rule_add_to_cart = 1 THEN 'add_to_cart=30' END, CASE WHEN rule_purchase = 1 THEN 'purchase=20' END,
            CASE WHEN rule_browsing_depth = 1 THEN 'browsing_depth=15' END,
            CASE WHEN rule_search_intent = 1 THEN 'search_intent=10' END,
            CASE WHEN rule_scroll_engagement = 1 THEN 'scroll_engagement=10' END,
            CASE WHEN rule_bouncer = 1 THEN 'bouncer=-10' END], lambda x: x IS NOT NULL)), ',') AS contributions
    FROM scored"""))
def _(t):
    entries = F.transform(
        F.map_entries("rule_contributions"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))
    )
    scored = scoring.score_with_contributions(t.sessions)
    return scored.withColumn("contributions", F.concat_ws(",", F.array_sort(entries))).drop("rule_contributions")


@query("lead_funnel", sql("SELECT score_tier, count(*) AS session_count FROM scored GROUP BY 1"))
def _(t):
    return reports.lead_funnel(t.scored)


@query("tier_distribution", sql(f"""
    SELECT source, score_tier, count(*) AS sessions, {half_even('avg(lead_score)', 1)} AS avg_score,
        min(lead_score) AS min_score, max(lead_score) AS max_score FROM scored GROUP BY 1, 2"""))
def _(t):
    return reports.tier_distribution(t.scored)


@query("rule_totals", sql("""
    SELECT sum(rule_add_to_cart)::BIGINT AS cart_sessions, sum(rule_purchase)::BIGINT AS purchase_sessions,
        sum(rule_browsing_depth)::BIGINT AS deep_browsing_sessions, sum(rule_search_intent)::BIGINT AS search_sessions,
        sum(rule_scroll_engagement)::BIGINT AS scroll_engaged_sessions, sum(rule_bouncer)::BIGINT AS bouncer_sessions
    FROM scored"""))
def _(t):
    return reports.rule_totals(t.scored)


@query("top_rule_leads", sql(f"""
    SELECT anonymous_user_id, lead_score, score_tier, source, {_FLAGS} FROM scored
    ORDER BY lead_score DESC, anonymous_user_id, session_id, source LIMIT 10"""))
def _(t):
    return reports.top_rule_leads(t.scored)


_LABELS = """array_to_string(list_filter([CASE WHEN rule_add_to_cart = 1 THEN 'Added to Cart' END,
    CASE WHEN rule_purchase = 1 THEN 'Purchased' END, CASE WHEN rule_browsing_depth = 1 THEN 'High Browsing Depth' END,
    CASE WHEN rule_search_intent = 1 THEN 'Search Intent' END,
    CASE WHEN rule_scroll_engagement = 1 THEN 'High Scroll Engagement' END,
    CASE WHEN rule_bouncer = 1 THEN 'Bouncer' END], lambda x: x IS NOT NULL), ',')"""


@query("triggered_rules", sql(f"SELECT session_id, anonymous_user_id, source, {_LABELS} AS rules FROM scored"))
def _(t):
    return reports.triggered_rules(t.scored).select(
        "session_id", "anonymous_user_id", "source", F.concat_ws(",", "triggered_rules").alias("rules")
    )


# ---- model scores --------------------------------------------------------------------------

_LEADS = f"""SELECT session_id, anonymous_user_id, source, {half_even('CAST(ml_lead_score AS DOUBLE) * 100', 2)} AS ml_score_pct,
    lead_score AS rule_score, score_tier, first_event_at, last_event_at, {_FLAGS}
    FROM ml_latest JOIN scored USING (session_id, anonymous_user_id, source)
    ORDER BY ml_lead_score DESC, session_id, anonymous_user_id, source LIMIT 50"""


@query("top_leads", sql(_LEADS))
def _(t):
    return reports.top_leads(t.ml_scores, t.scored)


@query("lead_drilldown", sql(
    f"SELECT session_id, ml_score_pct, rule_score, score_tier, {_LABELS} AS triggered_rules FROM leads", leads=_LEADS
))
def _(t):
    rows = reports.drilldown(reports.top_leads(t.ml_scores, t.scored))
    return rows.withColumn("triggered_rules", F.concat_ws(",", "triggered_rules"))


@query("top_ml_leads", sql(f"""
    SELECT anonymous_user_id, source, {half_even('CAST(ml_lead_score AS DOUBLE) * 100', 1)} AS ml_score_pct, model_version,
        scored_at FROM ml_latest ORDER BY ml_lead_score DESC, anonymous_user_id, session_id, source LIMIT 10"""))
def _(t):
    return reports.top_ml_leads(t.ml_scores)


@query("score_comparison", sql(f"""
    SELECT r.anonymous_user_id, r.source, r.lead_score AS rule_score, r.score_tier AS rule_tier,
        {half_even('CAST(m.ml_lead_score AS DOUBLE) * 100', 1)} AS ml_score_pct
    FROM scored r JOIN ml_latest m ON r.session_id = m.session_id
    ORDER BY m.ml_lead_score DESC, r.session_id, m.source, m.anonymous_user_id, r.source, r.anonymous_user_id LIMIT 10"""))
def _(t):
    return reports.score_comparison(t.scored, t.ml_scores)


# Sessions shared by several users, of both sources: the match on the session alone gives every pair.
_SHARED = "concat('w', right(anonymous_user_id, 1))"


@query("score_comparison_shared", sql(
    f"""SELECT r.anonymous_user_id, r.source, r.lead_score AS rule_score, r.score_tier AS rule_tier,
        {half_even('CAST(m.ml_lead_score AS DOUBLE) * 100', 1)} AS ml_score_pct
    FROM shared_rules r JOIN shared_ml m ON r.session_id = m.session_id
    ORDER BY m.ml_lead_score DESC, r.session_id, m.source, m.anonymous_user_id, r.source, r.anonymous_user_id LIMIT 25""",
    shared_rules=f"""SELECT {_SHARED} AS session_id, concat(anonymous_user_id, '/', session_id) AS anonymous_user_id, source,
        lead_score, score_tier FROM scored""",
    shared_ml=f"""SELECT {_SHARED} AS session_id, concat(anonymous_user_id, '/', session_id) AS anonymous_user_id, source,
        ml_lead_score FROM ml_latest""",
))
def _(t):
    shared = {
        "session_id": F.concat(F.lit("w"), F.right(F.col("anonymous_user_id"), F.lit(1))),
        "anonymous_user_id": F.concat_ws("/", "anonymous_user_id", "session_id"),
    }
    return reports.score_comparison(t.scored.withColumns(shared), t.ml_scores.withColumns(shared), n=25)


@query("ml_summary", sql(f"""
    SELECT source, count(*) AS scored_sessions, {half_even('avg(CAST(ml_lead_score AS DOUBLE))', 4)} AS avg_score,
        {half_even('min(ml_lead_score)', 4)} AS min_score, {half_even('max(ml_lead_score)', 4)} AS max_score,
        max(scored_at) AS last_scored_at FROM ml_latest GROUP BY source"""))
def _(t):
    return reports.ml_summary(t.ml_scores)


@query("ml_tier", sql("""
    SELECT session_id, anonymous_user_id, source, CASE WHEN pct >= 60 THEN 'hot' WHEN pct >= 30 THEN 'warm' ELSE 'cold' END
        AS ml_tier FROM (SELECT *, CAST(ml_lead_score AS DOUBLE) * 100 AS pct FROM ml_latest)"""))
def _(t):
    from behavior_spark.operators.ml import ml_tier
    from behavior_spark.sources.tables import ml_scores_latest

    return ml_scores_latest(t.ml_scores).select(
        "session_id", "anonymous_user_id", "source", ml_tier(F.col("ml_lead_score").cast("double") * 100).alias("ml_tier")
    )


# ---- checks --------------------------------------------------------------------------------


@query("events_by_source", sql("SELECT source, count(*) AS event_count FROM unified GROUP BY 1"))
def _(t):
    return quality.events_by_source(features.unified_events(t.click_events, t.dataset_events))


@query("dataset_vocabulary", sql("""
    SELECT event_type, count(*) AS event_count FROM unified WHERE source = 'retailrocket' GROUP BY 1
    ORDER BY event_count DESC, event_type LIMIT 10"""))
def _(t):
    return quality.vocabulary(features.unified_events(t.click_events, t.dataset_events))


@query("sessions_by_source", sql("SELECT source, count(*) AS session_count FROM sessions GROUP BY 1"))
def _(t):
    return quality.sessions_by_source(t.sessions)


@query("live_coverage", sql("""
    SELECT count(*) AS total_sessions, count(*) FILTER (WHERE page_views > 0) AS sessions_with_page_views,
        count(*) FILTER (WHERE product_views > 0) AS sessions_with_product_views,
        count(*) FILTER (WHERE add_to_cart_count > 0) AS sessions_with_cart,
        count(*) FILTER (WHERE purchase_count > 0) AS sessions_with_purchase,
        count(*) FILTER (WHERE search_count > 0) AS sessions_with_search,
        count(max_scroll_pct) AS sessions_with_scroll, sum(cart_abandoned)::BIGINT AS cart_abandoners FROM live"""))
def _(t):
    return quality.live_coverage(t.live)


@query("dataset_coverage", sql("""
    SELECT count(*) AS total_sessions, count(*) FILTER (WHERE product_views > 0) AS sessions_with_product_views,
        count(*) FILTER (WHERE add_to_cart_count > 0) AS sessions_with_cart,
        count(*) FILTER (WHERE purchase_count > 0) AS sessions_with_purchase, sum(cart_abandoned)::BIGINT AS cart_abandoners,
        count(*) AS page_views_always_zero, count(*) AS search_count_always_zero, count(*) AS max_scroll_always_null,
        1 AS invariants_hold FROM dataset"""))
def _(t):
    return quality.dataset_coverage(t.dataset)


@query("feature_averages", sql(f"""
    SELECT source, {half_even('avg(product_views)', 2)} AS avg_product_views,
        {half_even('avg(add_to_cart_count)', 4)} AS avg_add_to_cart, {half_even('avg(purchase_count)', 4)} AS avg_purchase,
        {half_even('avg(cart_abandoned)', 4)} AS avg_cart_abandoned_rate,
        {half_even('avg(session_duration_seconds)', 0)} AS avg_duration_seconds FROM sessions GROUP BY source"""))
def _(t):
    return quality.feature_averages(t.sessions)


@query("product_id_coverage", sql("""
    SELECT source, event_type, count(product_id) AS with_product_id, count(*) - count(product_id) AS without_product_id,
        count(*) AS total FROM unified WHERE event_type IN ('product_view', 'add_to_cart', 'purchase') GROUP BY 1, 2"""))
def _(t):
    return quality.product_id_coverage(features.unified_events(t.click_events, t.dataset_events))


@query("column_coverage", sql("""
    SELECT count(product_id) AS c_product_id, count(category) AS c_category, count(price) AS c_price,
        count(quantity) AS c_quantity, count(order_id) AS c_order_id, CAST(0 AS BIGINT) AS c_cart_value,
        count(search_query) AS c_search_query, count(results_count) AS c_results_count FROM click_events"""))
def _(t):
    return quality.column_coverage(t.click_events)


@query("freshness", sql("""
    SELECT count(*) AS recent, count(*) FILTER (WHERE event_type <> '' AND page_url <> '') AS valid,
        count(*) FILTER (WHERE event_type = '' OR page_url = '') AS malformed FROM click_events
    WHERE received_at > TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 10 MINUTE"""))
def _(t):
    return quality.freshness(t.click_events, "2024-01-20 00:00:00", minutes=10)


@query("recent_events", sql("""
    SELECT event_id, received_at FROM click_events WHERE received_at > TIMESTAMP '2024-01-29 00:00:00' - INTERVAL 1440 MINUTE
        AND event_type <> '' AND page_url <> ''"""))
def _(t):
    recent = quality.recent_events(t.click_events, "2024-01-29 00:00:00", minutes=1440)
    return recent.where(quality.valid_event()).select("event_id", "received_at")


@query("latest_click_sample", sql("""
    SELECT CAST(x_pct AS DOUBLE) AS x_pct, CAST(y_pct AS DOUBLE) AS y_pct FROM click_events
    WHERE event_type = 'click' AND x_pct IS NOT NULL AND y_pct IS NOT NULL
    ORDER BY received_at DESC, event_id DESC LIMIT 1"""))
def _(t):
    return quality.latest_click_sample(t.click_events)


@query("orders_without_id", sql("""
    SELECT count(*) FILTER (WHERE order_id = '') AS without_order_id, count(*) AS total FROM order_rows"""))
def _(t):
    return quality.orders_without_id(t.orders)


@query("rule_scores_in_range", sql("""
    SELECT count(*) FILTER (WHERE lead_score < 0 OR lead_score > 100) AS out_of_range, 1 AS passed FROM scored"""))
def _(t):
    return quality.rule_scores_in_range(t.scored)


@query("ml_scores_in_range", sql("""
    SELECT count(*) FILTER (WHERE ml_lead_score < 0 OR ml_lead_score > 1) AS out_of_range, 1 AS passed FROM ml_latest"""))
def _(t):
    return quality.ml_scores_in_range(t.ml_scores)


@query("no_dataset_bouncers", sql("""
    SELECT count(*) FILTER (WHERE source = 'retailrocket' AND rule_bouncer = 1) AS dataset_bouncers, 1 AS passed FROM scored"""))
def _(t):
    return quality.no_dataset_bouncers(t.scored)


@query("hot_leads", sql("""
    SELECT count(*) FILTER (WHERE score_tier = 'hot') AS hot_count,
        CAST(count(*) FILTER (WHERE score_tier = 'hot') > 0 AS INT) AS passed FROM scored"""))
def _(t):
    return quality.hot_leads(t.scored)
