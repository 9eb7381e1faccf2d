"""Cart replay in windows, without a task per session.

With S the running signed quantity of a product since the last purchase, the quantity held
is S minus the lowest S so far if that is below zero. The cart's value is the running sum
of the changes in quantity times price.

Sessions are cut into slices by position (``running.by_position``), so no task holds a busy session or instant. A short table says for every slice and product it
touches what the slice does to the product after its last purchase: the change d, the
lowest point on the way, the last price. From these the carts at the slice borders follow.
Each slice is then replayed on its own: it starts with rows that put the held quantities of
the products it touches, and the value of the whole cart, in place. The actions and the two short tables are written
once and read again: the events are scanned once.

Money is decimal: sums are exact and the same for every slicing. A purchase that repeats an order of its user is no
purchase: it empties nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from behavior_spark.operators.running import by_position
from behavior_spark.session import materialized

MONEY, VALUE = "decimal(18,2)", "decimal(38,2)"

_SO_FAR = (Window.unboundedPreceding, Window.currentRow)
_BEFORE = (Window.unboundedPreceding, -1)


def _whole(value: int = 0) -> Column:
    return F.lit(value).cast("bigint")


def _held(total: Column, lowest: Column) -> Column:
    return total - F.least(_whole(), lowest)


def _zero() -> Column:
    return F.lit(0).cast(VALUE)


def _worth(held: Column, unit: Column) -> Column:
    return (held.cast("decimal(19,0)") * F.coalesce(unit, F.lit(0).cast(MONEY))).cast(VALUE)


def _buys(actions: DataFrame, user: str) -> DataFrame:
    """Add ``_bought``: 1 for a purchase, unless its user has bought the same order before."""
    kind = F.col("event_type") == "purchase"
    if not {user, "order_id"} <= set(actions.columns):
        return actions.withColumn("_bought", kind.cast("int"))
    named = kind & (F.coalesce("order_id", F.lit("")) != "")
    firsts = (
        actions.where(named)
        .groupBy(F.col(user).alias("_user"), F.col("order_id").alias("_order"))
        .agg(F.min(F.struct("event_time", "event_id")).alias("_first"))
    )
    same = named & F.col(user).eqNullSafe(F.col("_user")) & (F.col("order_id") == F.col("_order"))
    repeat = F.col("_first").isNotNull() & (F.col("_first") != F.struct("event_time", "event_id"))
    joined = actions.join(firsts, same, "left")
    return joined.withColumn("_bought", (kind & ~repeat).cast("int")).drop("_user", "_order", "_first")


def _actions(events: DataFrame, session: str, user: str) -> DataFrame:
    kind = F.col("event_type")
    quantity = F.coalesce(F.col("quantity").cast("bigint"), _whole())
    return _buys(events.where(kind.isin("add_to_cart", "remove_from_cart", "purchase")), user).withColumns(
        {
            # The keys are joined on, so neither is NULL.
            "_session": F.coalesce(F.concat(F.lit("s"), F.col(session).cast("string")), F.lit("none")),
            # Purchases have no product of their own.
            "_product": F.when(kind != "purchase", F.coalesce("product_id", F.lit(""))),
            "_moved": F.when(kind == "add_to_cart", quantity)
            .when(kind == "remove_from_cart", -quantity)
            .otherwise(_whole()),
            "_add_price": F.when(kind == "add_to_cart", F.col("price").cast(MONEY)),
        }
    )


def _slice_products(actions: DataFrame) -> DataFrame:
    """Per session, slice and product: what happens to it after the slice's last purchase."""
    at = F.struct("event_time", "event_id")
    in_slice = Window.partitionBy("_session", "_slice")
    steps = Window.partitionBy("_session", "_slice", "_product").orderBy("event_time", "event_id")
    rows = (
        actions.select("_session", "_slice", "_product", "event_time", "event_id", "_bought", "_moved", "_add_price")
        .withColumn("_last_buy", F.max(F.when(F.col("_bought") == 1, at)).over(in_slice))
        .withColumn("_after", (F.col("_bought") == 0) & (F.col("_last_buy").isNull() | (at > F.col("_last_buy"))))
        .withColumn("_sum", F.sum(F.when(F.col("_after"), F.col("_moved"))).over(steps.rowsBetween(*_SO_FAR)))
    )
    priced = F.col("_after") & F.col("_add_price").isNotNull()
    return (
        rows.where("_product IS NOT NULL")
        .groupBy("_session", "_slice", "_product")
        .agg(
            F.coalesce(F.sum(F.when(F.col("_after"), F.col("_moved"))), _whole()).alias("d"),
            F.min(F.when(F.col("_after"), F.col("_sum"))).alias("low"),
            F.max_by("_add_price", F.when(priced, at)).alias("price"),
        )
    )


def _slice_epochs(actions: DataFrame) -> DataFrame:
    """Per session and slice: purchases-so-far marks before and at the end of the slice."""
    slices = actions.groupBy("_session", "_slice").agg(F.max("_bought").alias("_buys"))
    ordered = Window.partitionBy("_session").orderBy("_slice")
    return slices.select(
        "_session",
        "_slice",
        F.sum("_buys").over(ordered.rowsBetween(*_SO_FAR)).alias("epoch"),
        F.coalesce(F.sum("_buys").over(ordered.rowsBetween(*_BEFORE)), _whole()).alias("epoch_before"),
    )


def _product_states(actions: DataFrame, epochs: DataFrame) -> DataFrame:
    """Per session, slice and product: the state before the slice and the change of value."""
    products = _slice_products(actions).join(epochs, ["_session", "_slice"])
    in_epoch = Window.partitionBy("_session", "_product", "epoch").orderBy("_slice").rowsBetween(*_SO_FAR)
    by_slice = Window.partitionBy("_session", "_product").orderBy("_slice")
    total = F.sum("d").over(in_epoch)
    states = (
        products.withColumn("total", total)
        .withColumn("lowest", F.min(F.col("total") - F.col("d") + F.col("low")).over(in_epoch))
        .withColumn("held", _held(F.col("total"), F.col("lowest")))
        .withColumn("unit", F.last("price", ignorenulls=True).over(in_epoch))
        .withColumn("value", _worth(F.col("held"), F.col("unit")))
        .withColumn("prior", F.lag(F.struct("epoch", "held", "unit", "value")).over(by_slice))
    )
    still = F.col("prior.epoch") == F.col("epoch_before")
    same = F.col("prior.epoch") == F.col("epoch")
    return states.select(
        "_session",
        "_slice",
        "_product",
        "epoch",
        F.when(still, F.col("prior.held")).alias("start_held"),
        F.when(still, F.col("prior.unit")).alias("start_unit"),
        (F.col("value") - F.coalesce(F.when(same, F.col("prior.value")), _zero())).cast(VALUE).alias("change"),
    )


def _start_values(epochs: DataFrame, states: DataFrame) -> DataFrame:
    """Per session and slice: the value of the whole cart before the slice."""
    changes = states.groupBy("_session", "_slice").agg(F.sum("change").alias("change"))
    ordered = Window.partitionBy("_session").orderBy("_slice")
    in_epoch = Window.partitionBy("_session", "epoch").orderBy("_slice").rowsBetween(*_SO_FAR)
    return (
        epochs.join(changes, ["_session", "_slice"], "left")
        .withColumn("after", F.sum(F.coalesce("change", _zero())).over(in_epoch).cast(VALUE))
        .select("_session", "_slice", F.lag("after").over(ordered).alias("start_value"))
    )


def cart_value(events: DataFrame, session: str, parts: int | None = None, user: str = "anonymous_user_id") -> DataFrame:
    """See ``tracker.cart_value``."""
    columns = events.columns
    kept = [c for c in columns if c != "cart_value"]
    actions = by_position(_actions(events, session, user), ["_session"], ["event_time", "event_id"], parts)
    epochs = materialized(_slice_epochs(actions))
    states = materialized(_product_states(actions, epochs))

    # `_own`: 0 the cart's value, 1 a product's state, 2 a row of the events.
    working = ["_session", "_slice", "_product", "_bought", "_moved", "_add_price"]

    def start_rows(rows: DataFrame, own: int, product: Column, held: Column, unit: Column, value: Column) -> DataFrame:
        return rows.select(
            *[F.lit(None).cast(events.schema[c].dataType).alias(c) for c in kept],
            "_session",
            "_slice",
            product.alias("_product"),
            F.lit(0).alias("_bought"),
            held.alias("_moved"),
            unit.alias("_add_price"),
            F.lit(own).alias("_own"),
            value.alias("_start"),
        )

    none, no_number = F.lit(None).cast("string"), F.lit(None).cast(VALUE)
    values = start_rows(
        _start_values(epochs, states).where("start_value <> 0"), 0, none, _whole(), F.lit(None).cast(MONEY), F.col("start_value")
    )
    products = start_rows(
        states.where("start_held <> 0"), 1, F.col("_product"), F.col("start_held"), F.col("start_unit"), no_number
    )
    rows = (
        actions.select(*kept, *working, F.lit(2).alias("_own"), F.lit(None).cast(VALUE).alias("_start"))
        .unionByName(products)
        .unionByName(values)
    )

    order = ["_own", "event_time", "event_id"]
    in_slice = Window.partitionBy("_session", "_slice").orderBy(*order)
    epochs = rows.withColumn("_epoch", F.coalesce(F.sum("_bought").over(in_slice.rowsBetween(*_BEFORE)), _whole()))
    cart = Window.partitionBy("_session", "_slice", "_epoch", "_product").orderBy(*order)
    upto = cart.rowsBetween(*_SO_FAR)
    stocked = (
        epochs.withColumn("_sum", F.sum("_moved").over(upto))
        .withColumn("_unit", F.last("_add_price", ignorenulls=True).over(upto))
        .withColumn("_value", _worth(_held(F.col("_sum"), F.min("_sum").over(upto)), F.col("_unit")))
        .withColumn("_change", F.col("_value") - F.coalesce(F.lag("_value").over(cart), _zero()))
    )
    # The cart's start value already holds the products' states.
    change = F.when(F.col("_own") == 2, F.col("_change")).otherwise(F.coalesce("_start", _zero()))
    so_far = Window.partitionBy("_session", "_slice", "_epoch").orderBy(*order).rowsBetween(*_SO_FAR)
    total = F.sum(change).over(so_far)
    return (
        stocked.withColumn("_total", total)
        .where("_own = 2")
        .select(*kept, F.col("_total").cast(VALUE).alias("cart_value"))
    )
