"""Running values over ordered rows that stay parallel inside one large group.

A plain window puts a whole group into one task. Here the rows are range-partitioned by group and order, and the
partitions are the slices: they are even whatever the groups and whatever the clock, also if all rows are of one group and one instant.
The window runs inside a slice, and a slice starts from what the slices before it add up
to. Those totals are pre-aggregated, one short row per group and slice, and enter the
window as the slice's first row, so the large rows are not joined.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from behavior_spark.session import materialized

@dataclass(frozen=True)
class Running:
    """A running value: ``sum``, ``min``, ``max`` or ``last`` (newest that is not NULL).

    ``before=True`` leaves the current row out.
    """

    name: str
    kind: str
    column: str
    before: bool = False

    def total(self, order: Sequence[str]) -> Column:
        """What a whole slice adds up to."""
        value = F.col(self.column)
        if self.kind == "last":
            return F.max_by(value, F.when(value.isNotNull(), F.struct(*[F.col(c) for c in order])))
        return self._aggregate(value)

    def over(self, window, column: str | None = None) -> Column:
        value = F.col(column or self.column)
        if self.kind == "last":
            return F.last(value, ignorenulls=True).over(window)
        return self._aggregate(value).over(window)

    def _aggregate(self, value: Column) -> Column:
        return {"sum": F.sum, "min": F.min, "max": F.max}[self.kind](value)


def by_position(df: DataFrame, keys: Sequence[str], order: Sequence[str], parts: int | None = None) -> DataFrame:
    """The rows with ``_slice``: range partitions of ``keys`` and ``order``, written once so that the borders are fixed.

    Without ``parts`` the session's shuffle partitions are the upper limit and AQE joins small ones.
    """
    columns = [*keys, *order]
    ranged = df.repartitionByRange(parts, *columns) if parts else df.repartitionByRange(*columns)
    return materialized(ranged.withColumn("_slice", F.spark_partition_id()))


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    values: Sequence[Running],
    parts: int | None = None,
) -> DataFrame:
    """Add running values per ``keys``, rows taken in ``order``, which must settle ties."""
    if any(v.kind not in ("sum", "min", "max", "last") for v in values):
        raise ValueError("kind must be sum, min, max or last")
    columns = df.columns
    sliced = by_position(df, keys, order, parts)

    # One row per group and slice.
    totals = sliced.groupBy(*keys, "_slice").agg(*[v.total(order).alias(v.name) for v in values])
    earlier = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(
        *keys,
        "_slice",
        F.row_number().over(Window.partitionBy(*keys).orderBy("_slice")).alias("_nth"),
        *[v.over(earlier, v.name).alias(v.name) for v in values],
    ).where(F.col("_nth") > 1)

    # Carry rows come first in their slice and only fill the running columns.
    rows = sliced.select(*columns, "_slice", F.lit(1).alias("_own"), *[F.col(v.column).alias(v.name) for v in values])
    starts = carried.select(
        *[F.col(c) if c in keys else F.lit(None).cast(df.schema[c].dataType).alias(c) for c in columns],
        "_slice",
        F.lit(0).alias("_own"),
        *[v.name for v in values],
    )
    frame = Window.partitionBy(*keys, "_slice").orderBy("_own", *order)
    upto = frame.rowsBetween(Window.unboundedPreceding, 0)
    before = frame.rowsBetween(Window.unboundedPreceding, -1)
    names = {v.name: v.over(before if v.before else upto, v.name) for v in values}
    return (
        rows.unionByName(starts)
        .select(*columns, "_own", *[value.alias(name) for name, value in names.items()])
        .where(F.col("_own") == 1)
        .drop("_own")
    )
