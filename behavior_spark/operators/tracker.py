"""The browser tracker's rules, as operators over stored or streamed events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from behavior_spark.functions import js_number, js_trim, number_of_trimmed, parsed_once, round_half_up, text_of, to_fixed, whole_number
from behavior_spark.operators import carts
from behavior_spark.operators.running import Running, running
from behavior_spark.operators.thinning import throttle

# ---- scalar rules --------------------------------------------------------------------------


def normalize_number(value: Column, present: Column | None = None) -> Column:
    """A finite number not below zero, else NULL."""
    return _amount(js_number(value, present))


def _amount(number: Column) -> Column:
    return F.when(number >= 0, number)


def normalize_quantity(value: Column, present: Column | None = None) -> Column:
    """A finite number above zero, rounded half up, else NULL."""
    return _count(js_number(value, present))


def _count(number: Column) -> Column:
    return whole_number(F.when((number > 0) & (number < F.lit(2.0**63)), round_half_up(number)))


def coordinate_pct(position: Column, scroll: Column, size: Column) -> Column:
    """Position in the document in percent: one digit, 0..100, and 0 without a size."""
    share = F.when(size > 0, (position + scroll) / F.nullif(size, F.lit(0)) * 100).otherwise(F.lit(0.0))
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), round_half_up(share, 1)))


def normalize_coordinates(events: DataFrame) -> DataFrame:
    """Add ``x_pct`` and ``y_pct`` from client position, scroll offset and document size."""

    def pct(axis: str, size: str) -> Column:
        return coordinate_pct(
            F.col(f"client_{axis}").cast("double"),
            F.coalesce(F.col(f"scroll_{axis}").cast("double"), F.lit(0.0)),
            F.col(size).cast("double"),
        )

    return events.withColumns({"x_pct": pct("x", "document_width"), "y_pct": pct("y", "document_height")})


def scroll_pct(events: DataFrame) -> DataFrame:
    """Add ``scroll_pct``: whole percent of the way down, 0 when there is no room to scroll."""
    room = F.col("document_height").cast("double") - F.col("window_height").cast("double")
    top = F.coalesce(F.col("scroll_top").cast("double"), F.lit(0.0))
    depth = F.when(room > 0, round_half_up(top / F.nullif(room, F.lit(0.0)) * 100)).otherwise(F.lit(0.0))
    return events.withColumn("scroll_pct", depth)


def selector(events: DataFrame) -> DataFrame:
    """Add ``element_selector``: tag and id, else tag and class names."""
    tag = F.lower("element_tag")
    by_id = F.concat(tag, F.lit("#"), F.col("element_id"))
    by_class = F.concat(tag, F.lit("."), F.regexp_replace("element_class", r"(?U)\s+", "."))
    return events.withColumn(
        "element_selector",
        F.when(text_of(F.col("element_id")) != "", by_id)
        .when(text_of(F.col("element_class")) != "", by_class)
        .otherwise(tag),
    )


# ---- ordered rules -------------------------------------------------------------------------


def running_max_scroll(events: DataFrame, parts: int | None = None) -> DataFrame:
    """Scroll events with the deepest scroll of the session so far (never below 0)."""
    scrolls = events.where((F.col("event_type") == "scroll") & F.col("scroll_pct").isNotNull())
    deepest = running(
        scrolls,
        ["session_id"],
        ["event_time", "event_id"],
        [Running("max_scroll_pct", "max", "scroll_pct")],
        parts=parts,
    )
    floor = F.lit(0).cast(events.schema["scroll_pct"].dataType)
    return deepest.withColumn("max_scroll_pct", F.greatest(floor, "max_scroll_pct"))


def first_purchase(
    purchases: DataFrame,
    keys: Sequence[str] = ("anonymous_user_id", "order_id"),
    order: Sequence[str] = ("event_time", "event_id"),
) -> DataFrame:
    """The first purchase per user and order; repeats and purchases without an order id go."""
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return (
        purchases.where(text_of(F.col("order_id")) != "")
        .withColumn("_nth", nth)
        .where(F.col("_nth") == 1)
        .drop("_nth")
    )


def consent_gate(
    events: DataFrame,
    changes: DataFrame,
    default: bool,
    user: str = "anonymous_user_id",
    parts: int | None = None,
) -> DataFrame:
    """Events whose latest consent change at or before them says yes.

    ``changes`` holds the user, ``event_time`` and a boolean ``consented``. A change counts
    before the events of the same instant; of changes at one instant a yes comes last.
    ``default`` holds before the first change.
    """
    columns = events.columns
    marked = events.withColumns(
        {"_kind": F.lit(1), "_state": F.lit(None).cast("int"), "_order": F.col("event_id").cast("string")}
    )
    state = F.col("consented").cast("int")
    switches = changes.select(
        *[
            F.col(c).cast(events.schema[c].dataType).alias(c)
            if c in (user, "event_time")
            else F.lit(None).cast(events.schema[c].dataType).alias(c)
            for c in columns
        ],
        F.lit(0).alias("_kind"),
        state.alias("_state"),
        state.cast("string").alias("_order"),
    )
    gated = running(
        marked.unionByName(switches),
        [user],
        ["event_time", "_kind", "_order"],
        [Running("_allowed", "last", "_state")],
        parts=parts,
    )
    allowed = F.coalesce(F.col("_allowed"), F.lit(int(default))) == 1
    return gated.where((F.col("_kind") == 1) & allowed).select(*columns)


def cart_value(events: DataFrame, session: str = "session_id", parts: int | None = None) -> DataFrame:
    """Replay carts: every add, remove and purchase with the cart's value after it.

    ``events`` holds ``event_type``, ``product_id``, ``quantity`` and ``price``. A purchase
    shows the value it buys and empties the cart; one that repeats an order of its user changes nothing. A product's
    quantity never falls below zero, and its price is that of its last add. See ``carts.py`` for how it is computed.
    """
    return carts.cart_value(events, session, parts)


# ---- call validation -----------------------------------------------------------------------

ITEM = "STRUCT<product_id STRING, category STRING, price DOUBLE, quantity BIGINT>"


def _normal_items(text: Column, lenient: bool) -> Column:
    """The valid products of an ``items`` list; NULL when the payload has no list."""
    listed = F.from_json(text, "ARRAY<MAP<STRING, STRING>>")
    normal = F.transform(
        listed,
        lambda item: F.struct(
            _filled(item["product_id"]).alias("product_id"),
            _filled(item["category"]).alias("category"),
            normalize_number(item["price"], F.map_contains_key(item, "price")).alias("price"),
            F.coalesce(F.nullif(normalize_quantity(item["quantity"]), F.lit(0)), F.lit(1).cast("bigint")).alias(
                "quantity"
            ),
        ),
    )
    kept = F.filter(normal, lambda item: item["product_id"].isNotNull())
    return F.lit(None).cast(f"ARRAY<{ITEM}>") if lenient else kept.cast(f"ARRAY<{ITEM}>")


def _filled(value: Column) -> Column:
    return F.nullif(value, F.lit(""))


def validate_events(calls: DataFrame, lenient: bool = False) -> tuple[DataFrame, DataFrame]:
    """Check tracker calls; returns the events they make and the calls that make none.

    ``calls`` holds ``method`` (product_view, add_to_cart, remove_from_cart, purchase or
    search) and ``payload``, the call's JSON argument. A purchase without an ``items`` list
    takes the products of the cart: its ``products`` and, unless given, its ``total`` stay
    NULL here, and ``cart_value`` of the replayed cart fills the total. ``lenient`` applies
    the demo page's looser rules.

    Trimmed texts, numbers and totals are columns of their own, each worked out once per call: as plain expressions they would be copied to
    every place that looks at them, and the rules look at each many times.
    """
    has = lambda key: F.map_contains_key(F.col("_p"), F.lit(key))
    text = lambda key: F.col("_p")[key]
    method = F.col("method")
    product = _filled(text("product_id"))
    order = _filled(text("order_id"))
    number = lambda key: F.col("_n")[key]
    query = F.col("_t")["query"]
    zero = F.lit(0.0)
    if lenient:
        given = ("price",)
        price = F.coalesce(number("price"), zero)
        count = F.coalesce(F.nullif(number("quantity"), zero), F.lit(1.0))
        quantity = F.greatest(F.lit(1.0), count).cast("bigint")
        results = F.coalesce(number("results_count"), zero).cast("bigint")
        total = F.nullif(number("total"), zero)
        currency = F.coalesce(_filled(text("currency")), F.lit("USD"))
        add_ok = remove_ok = product.isNotNull()
    else:
        given = ("price", "quantity", "total")
        price = _amount(number("price"))
        quantity = _count(number("quantity"))
        results = F.coalesce(_count(number("results_count")), F.lit(0).cast("bigint"))
        total = _amount(number("total"))
        currency = _filled(text("currency"))
        counted = F.coalesce(quantity, F.lit(0)) > 0
        add_ok = product.isNotNull() & counted & price.isNotNull()
        remove_ok = product.isNotNull() & counted
    # Only purchases have items to parse; the list is used twice and parsed once.
    listed = _normal_items(F.when(method == "purchase", text("items")), lenient)
    products = F.col("_items")
    summed = F.aggregate(
        products, zero, lambda sofar, item: sofar + F.coalesce(item["price"], zero) * item["quantity"]
    )

    def only(kinds: Sequence[str], value: Column) -> Column:
        return F.when(method.isin(*kinds), value)

    accepted = (
        F.when(method == "product_view", product.isNotNull())
        .when(method == "add_to_cart", add_ok)
        .when(method == "remove_from_cart", remove_ok)
        .when(method == "purchase", order.isNotNull())
        .when(method == "search", query != "")
        .otherwise(F.lit(False))
    )
    items = ("product_view", "add_to_cart", "remove_from_cart")
    arguments = F.coalesce(F.from_json("payload", "MAP<STRING, STRING>"), F.create_map().cast("MAP<STRING, STRING>"))
    parsed = parsed_once(calls, "_p", arguments)
    numbers = ("price", "quantity", "results_count", "total")
    trimmed = F.struct(*[js_trim(text(key)).alias(key) for key in numbers], js_trim(text_of(text("query"))).alias("query"))
    values = F.struct(*[number_of_trimmed(F.col("_t")[key], has(key) if key in given else None).alias(key) for key in numbers])
    checked = parsed_once(parsed_once(parsed, "_t", trimmed), "_n", values).withColumn("_ok", accepted)
    priced = parsed_once(parsed_once(checked.where("_ok"), "_items", listed), "_total", F.coalesce(total, summed))
    events = priced.select(
        *[c for c in calls.columns if c not in ("method", "payload")],
        method.alias("event_type"),
        only(items, product).alias("product_id"),
        only(("product_view", "add_to_cart"), _filled(text("category"))).alias("category"),
        only(("product_view", "add_to_cart"), price).alias("price"),
        only(("add_to_cart", "remove_from_cart"), quantity).alias("quantity"),
        only(("product_view", "add_to_cart", "purchase"), currency).alias("currency"),
        only(("purchase",), order).alias("order_id"),
        only(("purchase",), products).alias("products"),
        only(("purchase",), to_fixed(F.col("_total"))).alias("total"),
        only(("search",), query).alias("search_query"),
        only(("search",), results).alias("results_count"),
    )
    return events, checked.where("NOT _ok").select(*calls.columns)


def throttle_by_event_time(*args, **kwargs) -> DataFrame:
    """See ``behavior_spark.streaming.stateful.throttle_by_event_time``."""
    from behavior_spark.streaming.stateful import throttle_by_event_time as thin

    return thin(*args, **kwargs)


def throttle_stream(*args, **kwargs) -> DataFrame:
    """See ``behavior_spark.streaming.stateful.throttle_stream``."""
    from behavior_spark.streaming.stateful import throttle_stream as thin

    return thin(*args, **kwargs)


def first_purchase_stream(*args, **kwargs) -> DataFrame:
    """See ``behavior_spark.streaming.stateful.first_purchase_stream``."""
    from behavior_spark.streaming.stateful import first_purchase_stream as first

    return first(*args, **kwargs)
