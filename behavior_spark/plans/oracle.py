"""SQL (DuckDB dialect) building blocks for checking the queries.

``sql`` puts the blocks a statement names in front of it as common table expressions.
"""

from __future__ import annotations

import re

from behavior_spark.plans import fixtures as fx


def _columns(rules: dict[str, str], **values: str) -> str:
    return ", ".join(fx.select_list(rules, **values))


def half_even(value: str, digits: int) -> str:
    return f"round_even(CAST({value} AS DOUBLE) * {10**digits}, 0) / {10**digits}" if digits else (
        f"round_even(CAST({value} AS DOUBLE), 0)"
    )


def _when_filled(*choices: str, default: str = "NULL") -> str:
    return "coalesce(" + ", ".join(f"nullif({c}, '')" for c in choices) + f", {default})"


def _text(key: str, where: str = "j") -> str:
    return f"json_extract_string({where}, '$.{key}')"


def _both(key: str) -> tuple[str, str]:
    return _text(key), _text(f"properties.{key}")


def _number(key: str, kind: str) -> str:
    top, nested = _both(key)
    return f"coalesce(TRY_CAST({top} AS {kind}), TRY_CAST({nested} AS {kind}))"


def _uint(key: str, limit: int, kind: str) -> str:
    def one(text: str) -> str:
        whole = f"CASE WHEN regexp_full_match({text}, '[0-9]+') THEN TRY_CAST({text} AS BIGINT) END"
        return f"CASE WHEN ({whole}) <= {limit} THEN {whole} END"

    top, nested = _both(key)
    return f"CAST(coalesce({one(top)}, {one(nested)}) AS {kind})"


def parse_time(text: str) -> str:
    return f"date_trunc('millisecond', CAST(TRY_CAST({text} AS TIMESTAMPTZ) AT TIME ZONE 'UTC' AS TIMESTAMP))"


ARRIVAL = "TIMESTAMP '2024-02-01 00:00:00'"

_EVENT_VALUES = {
    "event_id": _when_filled(_text("event_id"), _text("messageId")),
    "event_time": f"coalesce({parse_time(_when_filled(_text('event_time'), _text('timestamp')))}, {ARRIVAL})",
    "event_type": _when_filled(_text("event_type"), _text("event"), default="''"),
    "page_url": _when_filled(*_both("page_url"), default="''"),
    "referrer": _when_filled(*_both("referrer")),
    "x_pct": f"CAST(CAST({_number('x_pct', 'DOUBLE')} AS FLOAT) AS DOUBLE)",
    "y_pct": f"CAST(CAST({_number('y_pct', 'DOUBLE')} AS FLOAT) AS DOUBLE)",
    "scroll_pct": f"CAST(CAST({_number('scroll_pct', 'DOUBLE')} AS FLOAT) AS DOUBLE)",
    "element_selector": _when_filled(*_both("element_selector")),
    "element_tag": _when_filled(*_both("element_tag")),
    "device_type": _when_filled(*_both("device_type"), default="'unknown'"),
    "viewport_width": _uint("viewport_width", 65535, "INT"),
    "viewport_height": _uint("viewport_height", 65535, "INT"),
    "session_id": _when_filled(
        _text("session_id"), _text("properties.session_id"), _text("anonymousId"), default="'unknown_session'"
    ),
    "anonymous_user_id": _when_filled(
        _text("anonymous_user_id"), _text("anonymousId"), _text("userId"), default="''"
    ),
    "event_payload": _when_filled(_text("event_payload"), default="raw_message"),
    "product_id": _when_filled(*_both("product_id")),
    "category": _when_filled(*_both("category")),
    "price": f"CAST({_number('price', 'DECIMAL(18,2)')} AS DOUBLE)",
    "quantity": _uint("quantity", 4294967295, "BIGINT"),
    "order_id": _when_filled(*_both("order_id")),
    "cart_value": f"CAST({_number('cart_value', 'DECIMAL(18,2)')} AS DOUBLE)",
    "search_query": _when_filled(_text("query"), _text("properties.query"), _text("properties.search_term")),
    "results_count": _uint("results_count", 4294967295, "BIGINT"),
}

_ORDER_KEYS = f"""coalesce({parse_time(_text('timestamp'))}, {ARRIVAL}) AS event_time,
    coalesce({_text('properties.order_id')}, '') AS order_id, coalesce({_text('anonymousId')}, '') AS anonymous_user_id,
    coalesce({_text('session_id')}, '') AS session_id, nullif({_text('properties.currency')}, '') AS currency"""

_FEATURE_COLUMNS = """session_id, anonymous_user_id, page_views, product_views, add_to_cart_count, purchase_count,
    search_count, max_scroll_pct, session_duration_seconds, distinct_products_viewed,
    CAST(add_to_cart_count > 0 AND purchase_count = 0 AS INT) AS cart_abandoned, first_event_at, last_event_at, source"""


def _count(kind: str) -> str:
    return f"count(*) FILTER (WHERE event_type = '{kind}')"


_SPAN = """greatest(0, date_diff('second', min(event_time), max(event_time))) AS session_duration_seconds,
    min(event_time) AS first_event_at, max(event_time) AS last_event_at"""

BLOCKS = {
    "base": "SELECT " + ", ".join(fx.base_columns("json_extract_string(props, '$.k')", "ts")) + " FROM events",
    "click_mapped": f"SELECT n, k, {_columns(fx.CLICK_EVENTS)} FROM base",
    "click_events": f"SELECT {', '.join(fx.CLICK_EVENTS)}, {_columns(fx.CLICK_EVENTS_BY_TYPE)} FROM click_mapped",
    "raw_messages": f"SELECT n, {fx.RAW_MESSAGE} AS raw_message FROM base",
    "checked_messages": """SELECT n, raw_message, json_valid(raw_message) AS is_json,
        CASE WHEN json_valid(raw_message) THEN raw_message END AS j FROM raw_messages""",
    "normalized": "SELECT " + ", ".join(f"{v} AS {k}" for k, v in _EVENT_VALUES.items())
    + " FROM checked_messages WHERE is_json",
    "line_json": f"""SELECT l_orderkey, '[' || string_agg(item, ',' ORDER BY item) || ']' AS list
        FROM (SELECT l_orderkey, {fx.ITEM_JSON} AS item FROM lineitem) GROUP BY l_orderkey""",
    "order_repeats": """SELECT *, 0 AS repeat_no FROM orders
        UNION ALL SELECT *, 1 AS repeat_no FROM orders WHERE o_orderkey % 10 = 0""",
    "purchase_messages": f"""SELECT {fx.PURCHASE_MESSAGE} AS j FROM (
        SELECT r.*, coalesce(list, '[]') AS products FROM order_repeats r LEFT JOIN line_json ON o_orderkey = l_orderkey)""",
    "purchases": f"""SELECT j FROM purchase_messages
        WHERE {_text('type')} = 'purchase' OR {_text('event')} = 'Order Completed'""",
    "items": f"""SELECT coalesce({_text('messageId')}, '') AS event_id, {_ORDER_KEYS},
        coalesce({_text('product_id', 'item')}, '') AS product_id, nullif({_text('sku', 'item')}, '') AS sku,
        nullif({_text('name', 'item')}, '') AS name, nullif({_text('category', 'item')}, '') AS category,
        CAST(TRY_CAST({_text('price', 'item')} AS DECIMAL(18,2)) AS DOUBLE) AS price,
        TRY_CAST({_text('quantity', 'item')} AS BIGINT) AS quantity,
        TRY_CAST({_text('position', 'item')} AS BIGINT) AS position
        FROM (SELECT j, unnest(CASE WHEN json_array_length(j, '$.properties.products') > 0
            THEN CAST(json_extract(j, '$.properties.products') AS JSON[]) ELSE [CAST('{{}}' AS JSON)] END) AS item FROM purchases)""",
    "order_rows": f"""SELECT {_ORDER_KEYS}, """
    + ", ".join(
        f"CAST(TRY_CAST({_text('properties.' + c)} AS DECIMAL(18,2)) AS DOUBLE) AS {c}"
        for c in ("total", "revenue", "tax", "shipping", "discount")
    )
    + f""", nullif({_text('properties.coupon')}, '') AS coupon,
        CAST(json_extract(j, '$.properties.products') AS VARCHAR) AS products_json FROM purchases""",
    "latest_orders": """SELECT * EXCLUDE (nth) FROM (SELECT *, row_number() OVER (PARTITION BY order_id ORDER BY
        event_time DESC, anonymous_user_id DESC, session_id DESC, total DESC) AS nth FROM order_rows) WHERE nth = 1""",
    "dataset_csv": f"""SELECT {_columns(fx.DATASET_CSV, ms='(epoch_us(ts) // 1000)')}, 'events.csv' AS source_file,
        n + 2 AS source_row_num FROM base""",
    "dataset_events": """SELECT make_timestamp(CAST(timestamp AS BIGINT) * 1000) AS event_time,
        CAST(visitorid AS BIGINT) AS visitor_id, CAST(itemid AS BIGINT) AS item_id, event AS event_type,
        CAST(nullif(trim(transactionid), '') AS BIGINT) AS transaction_id,
        sha256(concat(source_file, ':', source_row_num, ':', timestamp, '|', visitorid, '|', event, '|', itemid, '|',
            transactionid)) AS row_hash, source_file, source_row_num FROM dataset_csv""",
    "item_properties": f"""SELECT make_timestamp(CAST(timestamp AS BIGINT) * 1000) AS event_time,
        CAST(itemid AS BIGINT) AS item_id, property, value, source_file FROM (
        SELECT {_columns(fx.PROPERTY_CSV, ms='(epoch_us(l_shipdate) // 1000)')},
            CASE WHEN l_orderkey % 2 = 0 THEN 'item_properties_part1.csv' ELSE 'item_properties_part2.csv' END AS source_file
        FROM lineitem)""",
    "item_latest": """SELECT item_id, CASE WHEN regexp_full_match(c, '[0-9]+') THEN TRY_CAST(c AS BIGINT) END AS category_id,
        coalesce(a, '') AS available FROM (
        SELECT item_id, max_by(value, (event_time, value)) FILTER (WHERE property = 'categoryid') AS c,
            max_by(value, (event_time, value)) FILTER (WHERE property = 'available') AS a
        FROM item_properties GROUP BY item_id)""",
    "live": f"""SELECT {_FEATURE_COLUMNS} FROM (SELECT session_id, anonymous_user_id, {_count('page_view')} AS page_views,
        {_count('product_view')} AS product_views, {_count('add_to_cart')} AS add_to_cart_count,
        {_count('purchase')} AS purchase_count, {_count('search')} AS search_count,
        max(scroll_pct) FILTER (WHERE event_type = 'scroll') AS max_scroll_pct, {_SPAN},
        count(DISTINCT product_id) AS distinct_products_viewed, 'live' AS source
        FROM click_events WHERE session_id <> '' AND session_id <> 'unknown_session' AND anonymous_user_id <> ''
        GROUP BY session_id, anonymous_user_id)""",
    "dataset": f"""SELECT {_FEATURE_COLUMNS} FROM (SELECT concat(visitor_id, '_', CAST(event_time AS DATE)) AS session_id,
        CAST(visitor_id AS VARCHAR) AS anonymous_user_id, CAST(0 AS BIGINT) AS page_views, {_count('view')} AS product_views,
        {_count('addtocart')} AS add_to_cart_count, {_count('transaction')} AS purchase_count,
        CAST(0 AS BIGINT) AS search_count, CAST(NULL AS FLOAT) AS max_scroll_pct, {_SPAN},
        count(DISTINCT item_id) AS distinct_products_viewed, 'retailrocket' AS source
        FROM dataset_events GROUP BY visitor_id, CAST(event_time AS DATE))""",
    "sessions": "SELECT * FROM live UNION ALL SELECT * FROM dataset",
    "flagged": """SELECT *, CAST(add_to_cart_count > 0 AS INT) AS rule_add_to_cart, CAST(purchase_count > 0 AS INT) AS rule_purchase,
        CAST(distinct_products_viewed > 2 AS INT) AS rule_browsing_depth, CAST(search_count > 0 AS INT) AS rule_search_intent,
        CAST(coalesce(max_scroll_pct > 70, false) AS INT) AS rule_scroll_engagement,
        CAST((page_views, product_views, add_to_cart_count, purchase_count, search_count) = (1, 0, 0, 0, 0) AS INT) AS rule_bouncer
        FROM sessions""",
    "scored": """SELECT session_id, anonymous_user_id, source, first_event_at, last_event_at, lead_score,
        CASE WHEN lead_score >= 60 THEN 'hot' WHEN lead_score >= 30 THEN 'warm' ELSE 'cold' END AS score_tier,
        rule_add_to_cart, rule_purchase, rule_browsing_depth, rule_search_intent, rule_scroll_engagement, rule_bouncer
        FROM (SELECT *, greatest(0, least(100, 30 * rule_add_to_cart + 20 * rule_purchase + 15 * rule_browsing_depth
            + 10 * rule_search_intent + 10 * rule_scroll_engagement - 10 * rule_bouncer)) AS lead_score FROM flagged)""",
    "ml_scores": f"""SELECT {_columns(fx.ML_SCORE, scored_at="TIMESTAMP '2024-03-01 00:00:00' + INTERVAL 1 HOUR * run")}
        FROM (SELECT *, unnest(CASE WHEN day(first_event_at) % 3 = 0 THEN [1] ELSE [1, 2] END) AS run FROM scored)""",
    "ml_latest": """SELECT * EXCLUDE (nth) FROM (SELECT *, row_number() OVER (PARTITION BY source, anonymous_user_id, session_id
        ORDER BY scored_at DESC, model_version DESC, ml_lead_score DESC) AS nth FROM ml_scores) WHERE nth = 1""",
    "unified": """SELECT event_id, event_time, event_type, page_url, anonymous_user_id, session_id, product_id,
        'live' AS source FROM click_events
        UNION ALL SELECT row_hash, event_time, CASE event_type WHEN 'view' THEN 'product_view' WHEN 'addtocart'
            THEN 'add_to_cart' WHEN 'transaction' THEN 'purchase' ELSE event_type END, NULL, CAST(visitor_id AS VARCHAR),
            concat(visitor_id, '_', CAST(event_time AS DATE)), CAST(item_id AS VARCHAR), 'retailrocket' FROM dataset_events""",
    "labelled": "SELECT *, CAST(purchase_count > 0 AS INT) AS converted FROM dataset",
    "blind": """SELECT labelled.*, 30 * CAST(add_to_cart_count > 0 AS INT) + 15 * CAST(distinct_products_viewed > 2 AS INT)
        AS rule_score FROM labelled""",
    "moves": f"SELECT {_columns(fx.MOVES)} FROM base",
    "pointers": f"SELECT {_columns(fx.POINTERS)} FROM base",
    "calls": f"SELECT {_columns(fx.CALLS)} FROM base",
    "consent_changes": """SELECT concat('u', user_id) AS anonymous_user_id, ts AS event_time,
        bool_or(k % 3 <> 0) AS consented FROM base WHERE kind = 'signup' GROUP BY ALL""",
    "click_bins": f"""SELECT 5 * {half_even('x_pct / 5.0::DOUBLE', 0)} AS x_bin_pct, 5 * {half_even('y_pct / 5.0::DOUBLE', 0)} AS y_bin_pct,
        count(*) AS event_count, min(event_time) AS first_event_time, max(event_time) AS last_event_time
        FROM click_events WHERE event_type = 'click' AND x_pct IS NOT NULL AND y_pct IS NOT NULL GROUP BY 1, 2""",
    "scroll_bins": f"""SELECT CAST(50 AS DOUBLE) AS x_bin_pct, 5 * {half_even('scroll_pct / 5.0::DOUBLE', 0)} AS y_bin_pct,
        count(*) AS event_count, min(event_time) AS first_event_time, max(event_time) AS last_event_time
        FROM click_events WHERE event_type = 'scroll' AND scroll_pct IS NOT NULL GROUP BY 1, 2""",
}


def sql(statement: str, recursive: bool = False, **extra: str) -> str:
    """The statement with the blocks it needs; ``extra`` adds blocks of its own."""
    known = {**BLOCKS, **extra}
    chosen: list[str] = []

    def need(text: str, within: tuple[str, ...]) -> None:
        for name, block in known.items():
            if name in chosen or name in within or not re.search(rf"(?:FROM|JOIN)\s+{name}\b", text):
                continue
            need(block, (*within, name))
            chosen.append(name)

    need(statement, ())
    if not chosen:
        return statement
    blocks = ",\n".join(f"{name} AS ({known[name]})" for name in chosen)
    return f"WITH {'RECURSIVE ' if recursive else ''}{blocks}\n{statement}"
