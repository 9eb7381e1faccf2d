"""Queries over the tracker's rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from behavior_spark.functions import js_number
from behavior_spark.operators import tracker
from behavior_spark.plans.oracle import sql
from behavior_spark.plans.registry import query
from behavior_spark.session import new_folder


@query("running_max_scroll", sql("""
    SELECT event_id, session_id, CAST(scroll_pct AS DOUBLE) AS scroll_pct, CAST(greatest(0, max(scroll_pct) OVER (
        PARTITION BY session_id ORDER BY event_time, event_id ROWS UNBOUNDED PRECEDING)) AS DOUBLE) AS max_scroll_pct
    FROM click_events WHERE event_type = 'scroll'"""))
def _(t):
    return tracker.running_max_scroll(t.click_events).select("event_id", "session_id", "scroll_pct", "max_scroll_pct")


_FIRST = """SELECT event_id, anonymous_user_id, order_id, event_time FROM (SELECT *, row_number() OVER (
    PARTITION BY anonymous_user_id, order_id ORDER BY event_time, event_id) AS nth
    FROM click_events WHERE event_type = 'purchase') WHERE nth = 1"""


def _purchases(t):
    return t.click_events.where("event_type = 'purchase'").select(
        "event_id", "anonymous_user_id", "order_id", "event_time"
    )


@query("first_purchase", sql(_FIRST))
def _(t):
    return tracker.first_purchase(_purchases(t))


def _streamed(t, rows, turn, keys, operator):
    """Run a stream operator over ``rows`` in four rounds of files (a key's rows of a round in one file), several micro-batches each."""
    folder = new_folder(t.spark, "stream")
    numbered = rows.withColumn("turn", turn)
    stored = f"{folder}/rounds"
    numbered.repartition(2, *keys).write.partitionBy("turn").parquet(stored)
    for n in range(4):
        t.spark.read.schema(rows.schema).parquet(f"{stored}/turn={n}").repartition(2, *keys).write.mode("append").parquet(f"{folder}/in")
    stream = t.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    run = (
        operator(stream)
        .writeStream.format("parquet")
        .option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True)
        .start(f"{folder}/out")
    )
    run.awaitTermination()
    return t.spark.read.schema(rows.schema).parquet(f"{folder}/out")


# Purchases arrive by the minute of the hour: many come before earlier ones, and repeats come rounds apart.
@query("first_purchase_stream", sql("""
    SELECT event_id, anonymous_user_id, order_id, event_time FROM (SELECT *, row_number() OVER (
        PARTITION BY anonymous_user_id, order_id ORDER BY (minute(event_time) + 1) % 4, event_time, event_id) AS nth
    FROM click_events WHERE event_type = 'purchase' AND order_id <> '') WHERE nth = 1"""))
def _(t):
    turn = ((F.minute("event_time") + 1) % 4).cast("int")
    return _streamed(t, _purchases(t), turn, ["anonymous_user_id", "order_id"], tracker.first_purchase_stream)


# Every row points to the first row 100 ms or more later; the kept rows are reached from the first.
_THINNED = sql(
    "SELECT session_id, anonymous_user_id, make_timestamp(move_ms * 1000) AS event_time, first_id AS event_id "
    "FROM hops JOIN distinct_moves USING (session_id, anonymous_user_id, move_ms)",
    recursive=True,
    distinct_moves="SELECT session_id, anonymous_user_id, move_ms, min(event_id) AS first_id FROM moves GROUP BY ALL",
    links="""SELECT session_id, anonymous_user_id, move_ms, min(move_ms) OVER (PARTITION BY session_id, anonymous_user_id ORDER BY move_ms
        RANGE BETWEEN 100 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_ms FROM distinct_moves""",
    hops="""SELECT session_id, anonymous_user_id, min(move_ms) AS move_ms FROM moves GROUP BY session_id, anonymous_user_id
        UNION ALL SELECT links.session_id, links.anonymous_user_id, links.next_ms FROM hops
        JOIN links ON links.session_id = hops.session_id AND links.anonymous_user_id = hops.anonymous_user_id
            AND links.move_ms = hops.move_ms WHERE links.next_ms IS NOT NULL""",
)


@query("mousemove_throttle", _THINNED)
def _(t):
    return tracker.throttle(t.moves)


@query("mousemove_throttle_stream", _THINNED)
def _(t):
    # Four stretches of time, one after the other: the state carries over from one to the next.
    rows = t.moves
    span = rows.agg(F.min("event_time").alias("lo"), F.max("event_time").alias("hi")).first()
    lo, width = F.unix_millis(F.lit(span.lo)), F.unix_millis(F.lit(span.hi)) - F.unix_millis(F.lit(span.lo)) + 1
    turn = F.floor((F.unix_millis("event_time") - lo) * 4 / width).cast("int")
    keys = ["session_id", "anonymous_user_id"]
    return _streamed(t, rows, turn, keys, tracker.throttle_stream)


@query("mousemove_throttle_by_event_time", _THINNED)
def _(t):
    """Rows come up to forty seconds late, in any order; they wait for the watermark."""
    rows, folder = t.moves, new_folder(t.spark, "moves")
    ms = F.unix_millis("event_time")
    lo, hi = rows.agg(F.min(ms), F.max(ms)).first()
    arrival = ms - lo + F.pmod(F.xxhash64("event_id"), F.lit(40_000))
    turn = F.floor(arrival * 6 / (hi - lo + 40_000)).cast("int")
    # The last file has a row of a far future, behind which nothing is left to wait for.
    end = rows.limit(1).select(*[F.lit("end").alias(c) if c != "event_time" else F.lit("2040-01-01").cast("timestamp").alias(c) for c in rows.columns])
    # All rows are dealt by their turn at once; a turn's one file is then a copy of its rows alone.
    rows.withColumn("turn", turn).write.partitionBy("turn").parquet(f"{folder}/turns")
    turns = t.spark.read.schema(rows.withColumn("turn", turn).schema).parquet(f"{folder}/turns")
    for i in range(7):
        part = end if i == 6 else turns.where(F.col("turn") == i)
        part.select(*rows.columns).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = t.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    out = tracker.throttle_by_event_time(stream, "40 seconds").writeStream.format("parquet").option("path", f"{folder}/out")
    out.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.schema(rows.schema).parquet(f"{folder}/out").where("session_id <> 'end'")


@query("consent_gate", sql("""
    SELECT event_id, e.anonymous_user_id, e.event_time FROM click_events e ASOF LEFT JOIN consent_changes c
        ON e.anonymous_user_id = c.anonymous_user_id AND e.event_time >= c.event_time
    WHERE coalesce(consented, true)"""))
def _(t):
    rows = t.click_events.select("event_id", "anonymous_user_id", "event_time")
    return tracker.consent_gate(rows, t.consent_changes, default=True)


@query("consent_gate_opt_in", sql("""
    SELECT event_id, e.anonymous_user_id, e.event_time FROM click_events e ASOF LEFT JOIN consent_changes c
        ON e.anonymous_user_id = c.anonymous_user_id AND e.event_time >= c.event_time
    WHERE coalesce(consented, false)"""))
def _(t):
    rows = t.click_events.select("event_id", "anonymous_user_id", "event_time")
    return tracker.consent_gate(rows, t.consent_changes, default=False)


@query("cart_value", sql(
    """SELECT event_id, event_type, session_id,
        CAST(100 * sum(after_row - before_row) OVER (PARTITION BY session_id, epoch ORDER BY event_time, event_id
            ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cart_cents FROM worth""",
    buys="""SELECT *, event_type = 'purchase' AND (coalesce(order_id, '') = '' OR row_number() OVER (
            PARTITION BY event_type, anonymous_user_id, order_id ORDER BY event_time, event_id) = 1) AS bought FROM click_events""",
    actions="""SELECT *, coalesce(sum(CAST(bought AS INT)) OVER (PARTITION BY session_id
            ORDER BY event_time, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS epoch,
        CASE event_type WHEN 'add_to_cart' THEN quantity WHEN 'remove_from_cart' THEN -quantity ELSE 0 END AS moved,
        CASE event_type WHEN 'add_to_cart' THEN CAST(price AS DECIMAL(18,2)) END AS add_price
        FROM buys WHERE event_type IN ('add_to_cart', 'remove_from_cart', 'purchase')""",
    sums="""SELECT *, sum(moved) OVER steps AS total, last_value(add_price IGNORE NULLS) OVER steps AS unit_price FROM actions
        WINDOW steps AS (PARTITION BY session_id, epoch, product_id ORDER BY event_time, event_id ROWS UNBOUNDED PRECEDING)""",
    stock="""SELECT *, (total - least(0, min(total) OVER steps)) * coalesce(unit_price, 0) AS after_row FROM sums
        WINDOW steps AS (PARTITION BY session_id, epoch, product_id ORDER BY event_time, event_id ROWS UNBOUNDED PRECEDING)""",
    worth="""SELECT *, coalesce(lag(after_row) OVER (PARTITION BY session_id, epoch, product_id
        ORDER BY event_time, event_id), 0) AS before_row FROM stock""",
))
def _(t):
    replayed = tracker.cart_value(t.click_events)
    return replayed.select("event_id", "event_type", "session_id", (F.col("cart_value") * 100).cast("bigint").alias("cart_cents"))


@query("normalize_coordinates", sql("""
    SELECT event_id, greatest(0, least(100, floor(x * 10 + 0.5) / 10)) AS x_pct,
        greatest(0, least(100, floor(y * 10 + 0.5) / 10)) AS y_pct FROM (SELECT event_id,
        CASE WHEN document_width > 0 THEN (client_x + scroll_x) / document_width * 100 ELSE 0 END AS x,
        CASE WHEN document_height > 0 THEN (client_y + scroll_y) / document_height * 100 ELSE 0 END AS y FROM pointers)"""))
def _(t):
    return tracker.normalize_coordinates(t.pointers).select("event_id", "x_pct", "y_pct")


@query("scroll_depth", sql("""
    SELECT event_id, CASE WHEN document_height > window_height
        THEN floor(scroll_top / (document_height - window_height) * 100 + 0.5) ELSE 0.0 END AS scroll_pct FROM pointers"""))
def _(t):
    return tracker.scroll_pct(t.pointers).select("event_id", "scroll_pct")


@query("element_selector", sql("""
    SELECT event_id, CASE WHEN element_id <> '' THEN lower(element_tag) || '#' || element_id
        WHEN element_class <> '' THEN lower(element_tag) || '.' || regexp_replace(element_class, '\\s+', '.', 'g')
        ELSE lower(element_tag) END AS element_selector FROM pointers"""))
def _(t):
    return tracker.selector(t.pointers).select("event_id", "element_selector")


_FORMS = """CASE n % 8 WHEN 0 THEN '-1' WHEN 1 THEN '' WHEN 2 THEN 'abc' WHEN 3 THEN '2.5' WHEN 4 THEN ' 7 '
    WHEN 5 THEN 'Infinity' WHEN 6 THEN '0.2' END"""


@query("normalize_numbers", sql("""
    SELECT n, CAST([-1, 0, NULL, 2.5, 7, NULL, 0.2, NULL][1 + n % 8] AS DOUBLE) AS number,
        CAST([NULL, 0, NULL, 2.5, 7, NULL, 0.2, NULL][1 + n % 8] AS DOUBLE) AS amount,
        CAST([NULL, NULL, NULL, 3, 7, NULL, 0, NULL][1 + n % 8] AS BIGINT) AS quantity FROM base"""))
def _(t):
    text = F.col("form")
    return t.base.selectExpr("n", f"{_FORMS} AS form").select(
        "n",
        js_number(text).alias("number"),
        tracker.normalize_number(text).alias("amount"),
        tracker.normalize_quantity(text).alias("quantity"),
    )


_CHECKED = {
    "args": """SELECT call_id, method, nullif(json_extract_string(payload, '$.product_id'), '') AS product_id,
        json_extract_string(payload, '$.category') AS category, json_extract_string(payload, '$.price') AS price_text,
        TRY_CAST(json_extract_string(payload, '$.price') AS DOUBLE) AS price_number,
        TRY_CAST(json_extract_string(payload, '$.quantity') AS DOUBLE) AS quantity_number,
        nullif(json_extract_string(payload, '$.order_id'), '') AS order_id,
        trim(json_extract_string(payload, '$.query')) AS query,
        TRY_CAST(json_extract_string(payload, '$.results_count') AS DOUBLE) AS results,
        TRY_CAST(json_extract_string(payload, '$.total') AS DOUBLE) AS total,
        json_extract_string(payload, '$.items[0].product_id') AS first_product,
        CAST(json_extract(payload, '$.items[0].quantity') AS DOUBLE) AS first_quantity FROM calls""",
    "tidy": """SELECT *, CASE WHEN price_text IS NULL THEN 0 WHEN price_number >= 0 THEN price_number END AS price,
        CASE WHEN quantity_number > 0 THEN CAST(floor(quantity_number + 0.5) AS BIGINT) END AS quantity,
        CASE WHEN total >= 0 THEN total ELSE 2.5 * CASE WHEN first_quantity > 0 THEN first_quantity ELSE 1 END END AS asked FROM args""",
    "judged": """SELECT *, coalesce(CASE method WHEN 'product_view' THEN product_id IS NOT NULL
        WHEN 'add_to_cart' THEN product_id IS NOT NULL AND quantity > 0 AND price IS NOT NULL
        WHEN 'remove_from_cart' THEN product_id IS NOT NULL AND quantity > 0
        WHEN 'purchase' THEN order_id IS NOT NULL WHEN 'search' THEN query <> '' END, false) AS ok FROM tidy""",
}


@query("validate_events", sql(
    """SELECT call_id, method AS event_type, CASE WHEN method IN ('product_view', 'add_to_cart', 'remove_from_cart') THEN product_id END AS product_id,
        CASE WHEN method IN ('product_view', 'add_to_cart') THEN category END AS category,
        CASE WHEN method IN ('product_view', 'add_to_cart') THEN CAST(price AS DOUBLE) END AS price,
        CASE WHEN method IN ('add_to_cart', 'remove_from_cart') THEN quantity END AS quantity,
        CASE WHEN method = 'purchase' THEN order_id END AS order_id,
        CASE WHEN method = 'purchase' THEN first_product || ':2.5:' || CAST(CASE WHEN first_quantity > 0 THEN first_quantity ELSE 1 END AS BIGINT) || ';b::2' END AS products,
        CASE WHEN method = 'purchase' THEN CASE WHEN asked * 8 = floor(asked * 8) THEN floor(asked * 100 + 0.5) / 100
            ELSE CAST(printf('%.2f', asked) AS DOUBLE) END END AS total,
        CASE WHEN method = 'search' THEN query END AS search_query,
        CASE WHEN method = 'search' THEN CAST(coalesce(results, 0) AS BIGINT) END AS results_count
    FROM judged WHERE ok""",
    **_CHECKED,
))
def _(t):
    events, _rejects = tracker.validate_events(t.calls)
    shown = F.transform("products", lambda p: F.concat_ws(":", p["product_id"], F.coalesce(p["price"].cast("string"), F.lit("")), p["quantity"].cast("string")))
    return events.withColumn("products", F.when(F.col("products").isNotNull(), F.concat_ws(";", shown))).drop("currency")


@query("rejected_calls", sql("SELECT call_id, method FROM judged WHERE NOT ok", **_CHECKED))
def _(t):
    return tracker.validate_events(t.calls)[1].select("call_id", "method")


@query("validate_events_lenient", sql(
    """SELECT call_id, method AS event_type, CASE WHEN method IN ('product_view', 'add_to_cart')
        THEN coalesce(price_number, 0) END AS price,
        CASE WHEN method IN ('add_to_cart', 'remove_from_cart')
            THEN CAST(floor(greatest(1, CASE WHEN coalesce(quantity_number, 0) = 0 THEN 1 ELSE quantity_number END)) AS BIGINT) END AS quantity,
        CASE WHEN method IN ('product_view', 'add_to_cart', 'purchase') THEN 'USD' END AS currency
    FROM judged WHERE CASE method WHEN 'purchase' THEN order_id IS NOT NULL WHEN 'search' THEN query <> ''
        ELSE product_id IS NOT NULL END""",
    **_CHECKED,
))
def _(t):
    events, _rejects = tracker.validate_events(t.calls, lenient=True)
    return events.select("call_id", "event_type", "price", "quantity", "currency")
