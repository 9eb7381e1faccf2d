"""Exact global orders without a global window.

Rows are cut into slices of the order. A window numbers rows inside a slice, and a short
table (one row per slice) says how many rows come before it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from behavior_spark.session import materialized

HASH_DIGITS = 3  # 16 ** 3 slices per group
SCORE_SLICES = 256


def hash_key(keys: Sequence[str], seed: int | str = "") -> Column:
    """A repeatable random order: the MD5 of the keys and a seed."""
    texts = [F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]
    return F.md5(F.concat_ws("|", *texts, F.lit(str(seed))))


def hash_rank(rows: DataFrame, groups: Sequence[str], keys: Sequence[str], seed: int | str = "") -> DataFrame:
    """Add ``hash_rank`` (from 1) and ``group_rows``: a shuffled position in each group.

    A group is split over 4,096 slices by the hash's first digits, so the size of a group
    does not matter. The table of slice counts has at most 4,096 rows per group; groups
    are labels or other values of which there are few.
    """
    order = "_hash"
    sliced = rows.withColumn(order, hash_key(keys, seed)).withColumn("_slice", F.substring(order, 1, HASH_DIGITS))
    counts = sliced.groupBy(*groups, "_slice").agg(F.count(F.lit(1)).alias("_n"))
    by_group = Window.partitionBy(*groups)
    before = by_group.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        *groups,
        "_slice",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
        F.sum("_n").over(by_group).alias("group_rows"),
    )
    inside = F.row_number().over(Window.partitionBy(*groups, "_slice").orderBy(order, *keys))
    return (
        sliced.withColumn("_inside", inside)
        .join(offsets, [*groups, "_slice"])
        .withColumn("hash_rank", F.col("_before") + F.col("_inside"))
        .drop(order, "_slice", "_before", "_inside")
    )


def _slice_number(value: Column, bounds: Sequence[float], first: int = 0) -> Column:
    """How many of the sorted bounds are not above the value, by halving."""
    if not bounds:
        return F.lit(first)
    middle = len(bounds) // 2
    return F.when(value < bounds[middle], _slice_number(value, bounds[:middle], first)).otherwise(
        _slice_number(value, bounds[middle + 1 :], first + middle + 1)
    )


def score_steps(rows: DataFrame, score: str, label: str) -> DataFrame:
    """Per distinct score: its positives and rows, and the positives and rows above it.

    Equal scores are one row, so ties shrink before anything is ordered. Slice bounds are
    approximate quantiles of the distinct scores (a fixed number of values on the driver);
    they decide only which task does the work, not the result.
    """
    steps = (
        rows.where(F.col(score).isNotNull())
        .groupBy(F.col(score).cast("double").alias("score"))
        .agg(F.sum(F.col(label).cast("bigint")).alias("pos"), F.count(F.lit(1)).alias("n"))
    )
    # Written once: the rows behind it (often a model's output) are not computed again.
    steps = materialized(steps)
    shares = [i / SCORE_SLICES for i in range(1, SCORE_SLICES)]
    bounds = sorted(set(steps.approxQuantile("score", shares, 1 / (2 * SCORE_SLICES))))
    number = _slice_number(F.col("score"), bounds)
    sliced = steps.withColumn("_slice", number)
    totals = sliced.groupBy("_slice").agg(F.sum("pos").alias("_p"), F.sum("n").alias("_r"))
    # At most SCORE_SLICES rows: a window over all of them is fine.
    above = Window.partitionBy(F.lit(1)).orderBy(F.desc("_slice")).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(1))
    carried = totals.select(
        "_slice",
        F.coalesce(F.sum("_p").over(above), F.lit(0)).alias("_p_above"),
        F.coalesce(F.sum("_r").over(above), F.lit(0)).alias("_r_above"),
        F.sum("_p").over(everything).alias("all_pos"),
        F.sum("_r").over(everything).alias("all_n"),
    )
    local = Window.partitionBy("_slice").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    return (
        sliced.withColumns(
            {
                "_p_local": F.coalesce(F.sum("pos").over(local), F.lit(0)),
                "_r_local": F.coalesce(F.sum("n").over(local), F.lit(0)),
            }
        )
        .join(carried, "_slice")
        .select(
            "score",
            "pos",
            "n",
            (F.col("_p_above") + F.col("_p_local")).alias("pos_above"),
            (F.col("_r_above") + F.col("_r_local")).alias("n_above"),
            "all_pos",
            "all_n",
        )
    )
