"""Input frames derived from the given tables: events, messages, dataset rows, scores.

The column rules are plain SQL text that Spark and DuckDB both read, so the same input
reaches the operators here and the SQL they are compared with (``oracle.py``).
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from behavior_spark import schemas
from behavior_spark.operators import features, ingest, scoring
from behavior_spark.sources.messages import RAW
from behavior_spark.sources.tables import align

# ---- column rules shared with the SQL side -------------------------------------------------

# `base`: n, ts, user_id, kind, value, k (0..99)
CLICK_EVENTS = {
    "event_id": "concat('e', n)",
    "event_time": "ts",
    "received_at": "ts",
    "event_type": """CASE kind
        WHEN 'view' THEN CASE n % 3 WHEN 0 THEN 'page_view' WHEN 1 THEN 'product_view' ELSE 'scroll' END
        WHEN 'click' THEN CASE n % 3 WHEN 0 THEN 'click' WHEN 1 THEN 'add_to_cart' ELSE 'mousemove' END
        WHEN 'signup' THEN CASE n % 2 WHEN 0 THEN 'search' ELSE 'remove_from_cart' END
        WHEN 'purchase' THEN CASE n % 4 WHEN 0 THEN 'purchase' ELSE 'product_view' END
        ELSE CASE n % 2 WHEN 0 THEN 'click' ELSE 'page_view' END END""",
    "page_url": """concat('https://example.com/', CASE k % 4 WHEN 0 THEN concat('product/', k % 9)
        WHEN 1 THEN 'checkout' WHEN 2 THEN 'pricing?plan=a_b' ELSE '100%off' END)""",
    "device_type": "CASE WHEN n % 2 = 0 THEN 'desktop' ELSE 'mobile' END",
    "viewport_width": "CASE WHEN n % 2 = 0 THEN 1440 ELSE 390 END",
    "viewport_height": "CASE WHEN n % 2 = 0 THEN 900 ELSE 844 END",
    "session_id": """CASE WHEN kind = 'error' AND n % 7 = 0 THEN 'unknown_session'
        WHEN kind = 'error' AND n % 7 = 1 THEN ''
        ELSE concat('s', user_id, '_', CAST(floor((day(ts) - 1) / 7) AS INT)) END""",
    "anonymous_user_id": "CASE WHEN n % 97 = 0 THEN '' ELSE concat('u', user_id) END",
    "event_payload": "concat('n', n)",
}
# Columns that depend on the mapped event type (`event_type` of CLICK_EVENTS).
CLICK_EVENTS_BY_TYPE = {
    "x_pct": """CASE WHEN event_type IN ('click', 'mousemove') AND n % 11 <> 0
        THEN CAST(CAST((n * 37) % 1001 AS DOUBLE) / 10 AS FLOAT) END""",
    "y_pct": """CASE WHEN event_type IN ('click', 'mousemove') AND n % 11 <> 0
        THEN CAST(CAST((n * 53) % 1001 AS DOUBLE) / 10 AS FLOAT) END""",
    "scroll_pct": "CASE WHEN event_type = 'scroll' THEN CAST((n * 29) % 101 AS FLOAT) END",
    "element_selector": """CASE WHEN event_type = 'click' THEN CASE n % 5 WHEN 0 THEN 'button.buy-now'
        WHEN 1 THEN 'a#nav' WHEN 2 THEN 'div.card.wide' WHEN 3 THEN '' END END""",
    "product_id": """CASE WHEN event_type IN ('product_view', 'add_to_cart', 'remove_from_cart')
        THEN concat('SKU-', k % 12) END""",
    "category": "CASE WHEN event_type IN ('product_view', 'add_to_cart') THEN concat('cat', k % 4) END",
    "price": """CASE WHEN event_type IN ('product_view', 'add_to_cart')
        THEN CAST(CAST(k AS DOUBLE) + 0.25 AS DECIMAL(18,2)) END""",
    "quantity": """CASE WHEN event_type IN ('add_to_cart', 'remove_from_cart')
        THEN CAST(1 + k % 4 AS BIGINT) END""",
    "order_id": "CASE WHEN event_type = 'purchase' THEN concat('ord', k % 5) END",
    "search_query": "CASE WHEN event_type = 'search' THEN concat('q', k % 5) END",
    "results_count": "CASE WHEN event_type = 'search' THEN CAST(k AS BIGINT) END",
}

_TIME_TEXT = "concat(replace(substr(CAST(ts AS STRING), 1, 23), ' ', 'T'), 'Z')"
_MONEY_TEXT = "CAST(CAST(value AS DECIMAL(18,2)) AS STRING)"

# One message per event: one in fifty is no JSON, even rows are flat, odd rows are nested.
RAW_MESSAGE = f"""CASE WHEN n % 50 = 0 THEN '{{not json'
    WHEN n % 2 = 0 THEN concat('{{"event_id":"e', n, '","event_time":"', {_TIME_TEXT}, '","event_type":"', kind,
        '","page_url":"https://example.com/p', n % 13, '","session_id":"s', user_id,
        '","anonymous_user_id":"u', user_id, '","price":', {_MONEY_TEXT},
        ',"viewport_width":', CASE WHEN n % 6 = 0 THEN 70000 ELSE 1440 END, ',"viewport_height":900',
        ',"x_pct":', (n * 37) % 100, '.', (n * 7) % 10, ',"y_pct":"', (n * 53) % 100, '","element_selector":"a#n', n % 4,
        '","element_tag":"A","device_type":"', CASE WHEN n % 4 = 0 THEN '' ELSE 'desktop' END,
        '","quantity":', CASE WHEN n % 8 = 0 THEN '1.5' ELSE '3' END, ',"results_count":', n % 9,
        ',"query":"find ', n % 3, '","category":"c', n % 5, '","product_id":null}}')
    ELSE concat('{{"messageId":"m', n, '","timestamp":"', CASE WHEN n % 10 = 7 THEN 'yesterday' ELSE {_TIME_TEXT} END,
        '","type":"track","event":"', kind, '","anonymousId":"', CASE WHEN n % 9 = 0 THEN '' ELSE concat('u', user_id) END,
        '","userId":"w', user_id, '","properties":{{"page_url":"https://example.com/p', n % 13,
        '","price":', {_MONEY_TEXT}, ',"cart_value":', {_MONEY_TEXT}, ',"scroll_pct":', (n * 29) % 101,
        ',"referrer":"r', n % 6, '","order_id":"', CASE WHEN n % 7 = 0 THEN '' ELSE concat('o', n) END,
        '","product_id":"SKU-', n % 9, '","search_term":"q', n % 3, '"}}}}') END"""

# Line items as JSON text; amounts go through DECIMAL so that both engines print them alike.
ITEM_JSON = """concat('{"product_id":"p', l_partkey, '","sku":"', CASE WHEN l_linenumber = 3 THEN '' ELSE concat('k', l_suppkey) END,
    '","name":"part ', l_partkey, '","price":', CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS STRING),
    ',"quantity":', CAST(l_quantity AS INT), ',"position":', l_linenumber, '}')"""
# `repeat_no` 0 is the order, 1 its later duplicate; `products` is the JSON list.
PURCHASE_MESSAGE = """concat('{"messageId":"m', o_orderkey, '-', repeat_no, '",',
    CASE o_orderkey % 3 WHEN 0 THEN '"type":"purchase","event":"x"' WHEN 1 THEN '"type":"track","event":"Order Completed"'
        ELSE CASE WHEN o_orderkey % 5 = 0 THEN '"type":"track","event":"purchase"' ELSE '"type":"purchase"' END END,
    ',"timestamp":"', replace(CAST(o_orderdate + INTERVAL 1 SECOND * repeat_no AS STRING), ' ', 'T'), 'Z',
    '","anonymousId":"c', o_custkey, '","session_id":"v', o_custkey % 100,
    '","properties":{"order_id":"', CASE WHEN o_orderkey % 17 = 0 THEN '' ELSE concat('o', o_orderkey) END,
    '","total":', CAST(CAST(o_totalprice AS DECIMAL(18,2)) + repeat_no AS STRING),
    ',"revenue":', CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS STRING), ',"shipping":4.99,"currency":"',
    CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE 'USD' END, '","products":', products, '}}')"""

DATASET_CSV = {
    "timestamp": "CAST({ms} AS STRING)",
    "visitorid": "CAST(user_id AS STRING)",
    "event": """CASE kind WHEN 'click' THEN 'addtocart' WHEN 'purchase' THEN 'transaction'
        WHEN 'error' THEN 'error' ELSE 'view' END""",
    "itemid": "CAST((user_id * 3 + n % 4) % 400 AS STRING)",
    "transactionid": "CASE WHEN kind = 'purchase' THEN CAST(n AS STRING) WHEN n % 2 = 0 THEN ' ' ELSE '' END",
}

PROPERTY_CSV = {
    "timestamp": "CAST({ms} AS STRING)",
    "itemid": "CAST(l_partkey % 300 AS STRING)",
    # Every seventh item has no category.
    "property": """CASE l_linenumber % 3 WHEN 0 THEN CASE WHEN l_partkey % 300 % 7 = 0 THEN '790' ELSE 'categoryid' END
        WHEN 1 THEN 'available' ELSE '790' END""",
    "value": """CASE l_linenumber % 3
        WHEN 0 THEN CASE WHEN l_suppkey % 10 = 0 THEN concat('n', l_suppkey, ':x') ELSE CAST(l_suppkey AS STRING) END
        WHEN 1 THEN CAST(l_orderkey % 2 AS STRING) ELSE CAST(CAST(l_quantity AS INT) AS STRING) END""",
}

# Mouse moves: dense in time, and one session holds a third of all rows.
MOVES = {
    "event_id": "concat('m', lpad(CAST(n AS STRING), 12, '0'))",
    "session_id": "CASE WHEN n % 3 = 0 THEN 'hot' ELSE concat('t', CAST(floor(n / 300) AS BIGINT)) END",
    "anonymous_user_id": "CASE WHEN n % 3 = 0 THEN 'nobody' ELSE concat('u', CAST(n % 2 AS STRING)) END",
    "move_ms": "1704067200000 + n * 23 + (n * 7919) % 61",
}

# Pointer positions and elements as a browser reports them.
POINTERS = {
    "event_id": "concat('e', n)",
    "client_x": "CAST((n * 37) % 1500 AS DOUBLE)",
    "client_y": "CAST((n * 53) % 900 AS DOUBLE)",
    "scroll_x": "CAST(n % 5 AS DOUBLE)",
    "scroll_y": "CAST((n * 11) % 2000 AS DOUBLE)",
    "document_width": "CASE WHEN n % 31 = 0 THEN 0 ELSE 1440 END",
    "document_height": "CASE WHEN n % 37 = 0 THEN 0 ELSE 2400 + k END",
    "window_height": "CASE WHEN n % 41 = 0 THEN 5000 ELSE 900 END",
    "scroll_top": "CAST((n * 13) % 1600 AS DOUBLE)",
    "element_tag": "CASE n % 3 WHEN 0 THEN 'BUTTON' WHEN 1 THEN 'a' ELSE 'Div' END",
    "element_id": "CASE n % 4 WHEN 0 THEN concat('id', k) WHEN 1 THEN '' END",
    "element_class": "CASE n % 5 WHEN 0 THEN 'card  wide' WHEN 1 THEN 'x' WHEN 2 THEN '' WHEN 3 THEN ' lead y' END",
}

# Tracker calls with good and bad arguments.
CALLS = {
    "call_id": "n",
    "method": """CASE kind WHEN 'view' THEN 'product_view' WHEN 'click' THEN 'add_to_cart'
        WHEN 'signup' THEN 'remove_from_cart' WHEN 'purchase' THEN 'purchase' ELSE 'search' END""",
    "payload": """concat('{"product_id":', CASE n % 7 WHEN 0 THEN 'null' WHEN 1 THEN '""' ELSE concat('"SKU-', k, '"') END,
        ',"category":"c', k % 4, '","price":', CASE n % 6 WHEN 0 THEN 'null' WHEN 1 THEN '-2' WHEN 2 THEN '"abc"' ELSE concat(k, '.5') END,
        ',"quantity":', CASE n % 5 WHEN 0 THEN '0' WHEN 1 THEN '2.5' WHEN 2 THEN '"3"' WHEN 3 THEN '-1' ELSE concat('', 1 + k % 4) END,
        ',"order_id":', CASE n % 8 WHEN 0 THEN 'null' ELSE concat('"o', n, '"') END,
        ',"query":"', CASE n % 9 WHEN 0 THEN '  ' ELSE concat(' find ', k, ' ') END,
        '","results_count":', CASE n % 4 WHEN 0 THEN 'null' ELSE concat('', n % 3) END,
        CASE n % 3 WHEN 0 THEN concat(',"total":', CASE n % 12 WHEN 0 THEN '2.675' WHEN 3 THEN '10.235' WHEN 6 THEN '0.125' ELSE concat(k, '.25') END) WHEN 1 THEN '' ELSE ',"total":-1' END,
        ',"items":[{"product_id":"a', k, '","price":2.5,"quantity":', k % 3, '},{"product_id":"","price":9},{"product_id":"b","price":-4,"quantity":2}]}')""",
}

# Model scores: a repeatable function of the rule score, two runs, two model versions.
ML_SCORE = {
    "session_id": "session_id",
    "anonymous_user_id": "anonymous_user_id",
    "source": "source",
    "ml_lead_score": """CAST(CAST((lead_score * 37 + length(session_id) * 11
        + (year(first_event_at) + day(first_event_at) * run + run) * 13) % 101 AS DOUBLE) / 100 AS FLOAT)""",
    "model_version": "concat('gbt_v', run)",
    "scored_at": "{scored_at}",
}


def base_columns(k: str, ts: str) -> list[str]:
    return ["event_id AS n", f"{ts} AS ts", "user_id", "event_type AS kind", "value", f"CAST({k} AS INT) AS k"]


def select_list(rules: dict[str, str], **values: str) -> list[str]:
    return [f"{(rule.format(**values) if values else rule)} AS {name}" for name, rule in rules.items()]


class Inputs:
    """The given tables below a folder, and the frames derived from them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def base(self) -> DataFrame:
        """Dealt evenly: a file has as many tasks as row groups at most, and what is made of the short rows takes far longer than reading them."""
        return self.table("events").repartition("event_id", "ts", "user_id").selectExpr(*base_columns("get_json_object(props, '$.k')", "CAST(ts AS TIMESTAMP)"))

    @cached_property
    def click_events(self) -> DataFrame:
        mapped = self.base.selectExpr("n", "k", *select_list(CLICK_EVENTS))
        rows = mapped.selectExpr(*CLICK_EVENTS, *select_list(CLICK_EVENTS_BY_TYPE))
        return align(rows, schemas.CLICK_EVENTS)

    # ---- messages --------------------------------------------------------------------------

    @cached_property
    def numbered_messages(self) -> DataFrame:
        return self.messages_of(self.base)

    def messages_of(self, base: DataFrame) -> DataFrame:
        return base.selectExpr("n", f"{RAW_MESSAGE} AS {RAW}")

    @cached_property
    def messages(self) -> DataFrame:
        return self.numbered_messages.select(RAW)

    @cached_property
    def envelopes(self) -> DataFrame:
        """Client batches of up to twenty messages. What is no JSON is an element as it is in even batches, and a string in odd ones."""
        batch_no = F.expr("CAST(floor(n / 20) AS BIGINT)")
        text = F.when((F.col("n") % 50 == 0) & (batch_no % 2 == 1), F.concat(F.lit('"'), RAW, F.lit('"'))).otherwise(F.col(RAW))
        return (
            self.numbered_messages.groupBy(batch_no.alias("batch_no"))
            .agg(F.array_sort(F.collect_list(F.struct("n", text.alias(RAW)))).alias("entries"))
            .select(
                "batch_no",
                F.concat(
                    F.lit('{"batch":['),
                    F.concat_ws(",", F.transform("entries", lambda e: e[RAW])),
                    F.lit('],"sentAt":"2024-02-01T00:00:00.000Z"}'),
                ).alias(RAW),
            )
        )

    @cached_property
    def purchase_messages(self) -> DataFrame:
        items = (
            self.table("lineitem")
            .selectExpr("l_orderkey", f"{ITEM_JSON} AS item")
            .groupBy("l_orderkey")
            .agg(F.concat(F.lit("["), F.concat_ws(",", F.sort_array(F.collect_list("item"))), F.lit("]")).alias("products"))
        )
        orders = self.table("orders").withColumn(
            "repeat_no", F.explode(F.expr("CASE WHEN o_orderkey % 10 = 0 THEN array(0, 1) ELSE array(0) END"))
        )
        joined = orders.join(items, orders.o_orderkey == items.l_orderkey, "left").withColumn(
            "products", F.coalesce("products", F.lit("[]"))
        )
        return joined.selectExpr(f"{PURCHASE_MESSAGE} AS {RAW}")

    @cached_property
    def purchase_items(self) -> DataFrame:
        return ingest.purchase_items(self.purchase_messages, "2024-02-01 00:00:00")

    @cached_property
    def orders(self) -> DataFrame:
        return ingest.orders(self.purchase_messages, "2024-02-01 00:00:00")

    # ---- dataset ---------------------------------------------------------------------------

    @cached_property
    def dataset_csv(self) -> DataFrame:
        rows = self.base.selectExpr(
            *select_list(DATASET_CSV, ms="unix_millis(ts)"),
            "'events.csv' AS source_file",
            "n + 2 AS source_row_num",
        )
        return ingest.with_row_hash(rows)

    @cached_property
    def dataset_events(self) -> DataFrame:
        return ingest.dataset_events(self.dataset_csv)

    @cached_property
    def property_parts(self) -> tuple[DataFrame, DataFrame]:
        rows = self.table("lineitem")
        parts = []
        for part, condition in ((1, "l_orderkey % 2 = 0"), (2, "l_orderkey % 2 = 1")):
            parts.append(
                rows.where(condition).selectExpr(
                    *select_list(PROPERTY_CSV, ms="unix_millis(CAST(l_shipdate AS TIMESTAMP))"),
                    f"'item_properties_part{part}.csv' AS source_file",
                )
            )
        return parts[0], parts[1]

    @cached_property
    def item_properties(self) -> DataFrame:
        return ingest.dataset_properties(*self.property_parts)

    @cached_property
    def category_csv(self) -> DataFrame:
        nations = self.table("nation").selectExpr(
            "CAST(100 + n_nationkey AS STRING) AS categoryid", "CAST(n_regionkey AS STRING) AS parentid"
        )
        regions = self.table("region").selectExpr(
            "CAST(r_regionkey AS STRING) AS categoryid",
            "CASE WHEN r_regionkey % 2 = 0 THEN '' ELSE ' ' END AS parentid",
        )
        return nations.unionByName(regions)

    # ---- features and scores ---------------------------------------------------------------

    @cached_property
    def live(self) -> DataFrame:
        return features.live_sessions(self.click_events)

    @cached_property
    def dataset(self) -> DataFrame:
        return features.dataset_sessions(self.dataset_events)

    @cached_property
    def sessions(self) -> DataFrame:
        return features.session_features(self.click_events, self.dataset_events)

    @cached_property
    def scored(self) -> DataFrame:
        return scoring.score(self.sessions)

    @cached_property
    def ml_scores(self) -> DataFrame:
        """Two scoring runs; every third session was scored by the first run only."""
        runs = self.scored.withColumn(
            "run", F.explode(F.expr("CASE WHEN day(first_event_at) % 3 = 0 THEN array(1) ELSE array(1, 2) END"))
        )
        at = "timestamp_seconds(1709251200 + run * 3600)"
        return align(runs.selectExpr(*select_list(ML_SCORE, scored_at=at)), schemas.ML_SCORES)

    # ---- tracker ---------------------------------------------------------------------------

    @cached_property
    def moves(self) -> DataFrame:
        return self.base.selectExpr(*select_list(MOVES)).selectExpr(
            "event_id", "session_id", "anonymous_user_id", "timestamp_millis(move_ms) AS event_time"
        )

    @cached_property
    def pointers(self) -> DataFrame:
        return self.base.selectExpr(*select_list(POINTERS))

    @cached_property
    def calls(self) -> DataFrame:
        return self.base.selectExpr(*select_list(CALLS))

    @cached_property
    def consent_changes(self) -> DataFrame:
        """Every signup switches a user's consent, on or off."""
        return self.base.where("kind = 'signup'").selectExpr(
            "concat('u', user_id) AS anonymous_user_id", "ts AS event_time", "k % 3 <> 0 AS consented"
        )
