"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from behavior_spark.session import new_folder

# Words are runs of anything but the six ASCII white-space characters; bytes.split() cuts there too.
WORD = r"[^\x20\x09-\x0D]+"
# Python works on slices of a batch, so that a few very long texts do not add up.
SLICE_BYTES = 8 << 20


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def written(df: DataFrame, label: str) -> DataFrame:
    """Write a frame to the shared folder and go on from the files: short lineage, nothing runs twice."""
    spark = df.sparkSession
    folder = new_folder(spark, f"llm-{label}")
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def schema_of(ddl: str) -> StructType:
    return StructType.fromDDL(ddl)


def sliced(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive slices of a batch whose texts hold at most ``most`` bytes (one row at least)."""
    sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_pylist()
    start, held = 0, 0
    for i, size in enumerate(sizes):
        if i > start and held + size > most:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += size
    if start < batch.num_rows:
        yield batch.slice(start)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """The texts as UTF-8 bytes; null is empty."""
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]


def map_rows(df: DataFrame, work: Callable[[pa.RecordBatch], pa.RecordBatch | None], ddl: str, text: str = "text") -> DataFrame:
    """``work`` on every slice of every batch; rows stay in their partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch, text):
                done = work(part)
                if done is not None and done.num_rows:
                    yield done

    return df.mapInArrow(run, schema_of(ddl))


def free_name(columns: list[str], wanted: str) -> str:
    """A column name that the frame does not have (names are compared without case)."""
    taken = {c.lower() for c in columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def sum_or_zero(column: Column | str) -> Column:
    return F.coalesce(F.sum(column), F.lit(0))


def running(df: DataFrame, order: list[Column], values: list[str], group: list[str] | None = None, parts: int | None = None) -> DataFrame:
    """Add ``before_<value>`` for each long or double value: its sum over the rows ahead, without one task over all rows.

    Rows are range-partitioned by ``group`` and ``order`` and written, so that the bounds are fixed. Each partition is
    summed, the short table of partition sums gives the offsets (one row per partition and group, windowed per
    group), and rows are summed inside their partition only. ``order`` must settle ties for a repeatable result. A null group counts as a group.
    """
    from pyspark.sql import Window

    group = group or []
    keys = [F.col(g) for g in group] + order
    part = free_name(df.columns, "__part")
    ranged = df.repartitionByRange(parts, *keys) if parts else df.repartitionByRange(*keys)
    ranged = written(ranged.withColumn(part, F.spark_partition_id()), "ranged")
    sums = ranged.groupBy(part, *group).agg(*[F.sum(v).alias(f"sum_{i}") for i, v in enumerate(values)])
    across = Window.orderBy(part) if not group else Window.partitionBy(*group).orderBy(part)
    across = across.rowsBetween(Window.unboundedPreceding, -1)
    # One column holds all that the join adds, so no name of the frame can be in its way.
    at = F.struct(
        F.col(part).alias("part"), *[F.col(g).alias(f"g_{i}") for i, g in enumerate(group)],
        *[F.coalesce(F.sum(f"sum_{i}").over(across), F.lit(0)).alias(f"at_{i}") for i in range(len(values))],
    )
    offset = free_name(ranged.columns, "__offset")
    offsets = sums.select(at.alias(offset))
    same = F.col(part) == F.col(f"{offset}.part")
    for i, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"{offset}.g_{i}"))
    inside = Window.partitionBy(part, *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    ahead = free_name([*ranged.columns, offset], "__ahead")
    out = ranged.withColumn(ahead, F.struct(*[F.coalesce(F.sum(v).over(inside), F.lit(0)).alias(f"in_{i}") for i, v in enumerate(values)]))
    out = out.join(offsets, same)
    for i, v in enumerate(values):
        out = out.withColumn(f"before_{v}", F.col(f"{offset}.at_{i}") + F.col(f"{ahead}.in_{i}"))
    return out.drop(part, offset, ahead)
