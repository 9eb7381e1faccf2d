"""Mouse-move thinning: keep a row if ``ms`` or more passed since the last kept one.

The rule depends on its own output, so no window expresses it, and one task per session
would break down on a session that holds a third of all rows. Rows are therefore cut into
slices of time. All that one slice hands to the next is the wait until a row may be kept
again, a number below ``ms``:

1. for every slice, find the wait it hands over for each wait it could be given;
2. per session, link the slices: one short row each;
3. thin every slice on its own, starting from its known wait.

Step 1 works on distinct milliseconds, so a slice has a fixed greatest size. Step 3 streams.
"""

from __future__ import annotations

import sys
from bisect import bisect_left
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Executors need no copy of this package: the functions travel with the query.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SLICE_MS = 60_000


def _breaks(batch: pa.RecordBatch, keys: Sequence[str], previous: tuple | None) -> np.ndarray:
    """True where a row's key differs from the row before; ``previous`` is the key before the batch."""
    n = batch.num_rows
    moved = np.zeros(n, dtype=bool)
    first = tuple(batch.column(k)[0].as_py() for k in keys)
    moved[0] = first != previous
    for key in keys:
        values = batch.column(key)
        here, prior = values.slice(1), values.slice(0, n - 1)
        differs = pc.fill_null(pc.not_equal(here, prior), False).to_numpy(zero_copy_only=False)
        one_null = pc.xor(pc.is_null(here), pc.is_null(prior)).to_numpy(zero_copy_only=False)
        moved[1:] |= differs | one_null
    return moved


def _last_key(batch: pa.RecordBatch, keys: Sequence[str]) -> tuple:
    return tuple(batch.column(k)[batch.num_rows - 1].as_py() for k in keys)


def _following(position: np.ndarray, code: np.ndarray, ms: int) -> np.ndarray:
    """First row of the same slice at least ``ms`` later, or the number of rows."""
    n = len(position)
    target = np.searchsorted(position, position + ms, side="left")
    reached = target < n
    reached[reached] = code[target[reached]] == code[reached]
    return np.where(reached, target, n)


def _exits(ms: int, width: int):
    """Per slice: thresholds of the incoming wait and the wait handed over for each."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            lists = batch.column("offsets")
            sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
            offset = pc.list_flatten(lists).to_numpy(zero_copy_only=False).astype(np.int64)
            code = np.repeat(np.arange(len(sizes)), sizes)
            n = len(offset)
            jump = np.append(_following(code * (width + ms + 1) + offset, code, ms), n)
            # Double the jumps until every row knows the last row its chain keeps.
            final = np.where(jump[:n] == n, np.arange(n), jump[:n])
            while not np.array_equal(final, final[final]):
                final = final[final]
            leftover = np.maximum(0, offset[final] + ms - width)
            # A row can open a slice if some wait up to `ms` ends after the row before it.
            opens = np.ones(n, dtype=bool)
            opens[1:] = (code[1:] != code[:-1]) | (offset[:-1] < ms)
            ends = np.concatenate([[0], np.cumsum(np.bincount(code[opens], minlength=len(sizes)))])
            ends = pa.array(ends, pa.int32())
            columns = [batch.column(i) for i in range(batch.num_columns - 1)]
            columns.append(pa.ListArray.from_arrays(ends, pa.array(offset[opens], pa.int64())))
            columns.append(pa.ListArray.from_arrays(ends, pa.array(leftover[opens], pa.int64())))
            names = [*batch.schema.names[:-1], "upto", "leftover"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return find


def _waits(keys: Sequence[str]):
    """Walk a session's slices in order; keep those that start with a wait."""

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        previous, last_slice, handed = None, None, 0
        for batch in batches:
            if batch.num_rows == 0:
                continue
            new_key = _breaks(batch, keys, previous)
            slices = batch.column("_slice").to_pylist()
            upto = batch.column("upto").to_pylist()
            leftover = batch.column("leftover").to_pylist()
            wait = np.zeros(batch.num_rows, dtype=np.int64)
            for i, number in enumerate(slices):
                given = handed if not new_key[i] and number - 1 == last_slice else 0
                wait[i] = given
                opened = bisect_left(upto[i], given)
                handed = leftover[i][opened] if opened < len(upto[i]) else 0
                last_slice = number
            previous = _last_key(batch, keys)
            waiting = batch.select([*keys, "_slice"]).filter(pa.array(wait > 0))
            yield pa.RecordBatch.from_arrays(
                [*waiting.columns, pa.array(wait[wait > 0], pa.int64())], names=[*waiting.schema.names, "_wait"]
            )

    return link


def _thin(ms: int, width: int, slices: Sequence[str], columns: Sequence[str]):
    """Keep rows slice by slice; a slice may go on in the next batch."""

    def thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        previous, open_from = None, 0
        for batch in batches:
            n = batch.num_rows
            if n == 0:
                continue
            new_slice = _breaks(batch, slices, previous)
            continued = not new_slice[0]
            code = np.cumsum(new_slice) - (0 if continued else 1)
            offset = batch.column("_offset").to_numpy(zero_copy_only=False)
            given = pc.fill_null(batch.column("_wait"), 0).to_numpy(zero_copy_only=False)
            # Offset from which each slice of the batch may keep a row.
            start = np.zeros(code[-1] + 1, dtype=np.int64)
            np.maximum.at(start, code, given)
            if continued:
                start[0] = max(start[0], open_from)
            following = _following(code * (width + ms + 1) + offset, code, ms)
            free = np.flatnonzero((offset >= start[code]) & (offset >= 0))
            at = free[np.append(True, code[free][1:] != code[free][:-1])] if len(free) else free
            keep = np.zeros(n, dtype=bool)
            while len(at):
                keep[at] = True
                at = following[at]
                at = at[at < n]
            kept_last = np.flatnonzero(keep & (code == code[-1]))
            open_from = int(offset[kept_last[-1]]) + ms if len(kept_last) else int(start[-1])
            previous = _last_key(batch, slices)
            yield batch.select(list(columns)).filter(pa.array(keep))

    return thin


def throttle(
    events: DataFrame,
    ms: int = 100,
    keys: Sequence[str] = ("session_id", "anonymous_user_id"),
    time: str = "event_time",
    order: Sequence[str] = ("event_id",),
) -> DataFrame:
    """Keep a row if at least ``ms`` milliseconds passed since the last kept row of its key.

    The first row is kept; rows of one millisecond are taken in ``order``. Rows without a
    time are dropped. Exact for sessions of any size.
    """
    if ms < 1:
        raise ValueError("ms must be at least 1")
    keys, columns = list(keys), events.columns
    width = max(SLICE_MS, ms)
    slices = [*keys, "_slice"]
    millis = F.unix_millis(F.col(time))
    rows = events.where(F.col(time).isNotNull()).withColumns(
        {
            "_slice": F.floor(millis / F.lit(width)).cast("bigint"),
            "_offset": F.pmod(millis, F.lit(width)).cast("bigint"),
        }
    )
    key_fields = [T.StructField(k, events.schema[k].dataType) for k in keys]
    slice_fields = [*key_fields, T.StructField("_slice", T.LongType())]
    longs = T.ArrayType(T.LongType())
    exits = (
        rows.groupBy(*slices)
        .agg(F.array_sort(F.collect_set("_offset")).alias("offsets"))
        .mapInArrow(
            _exits(ms, width),
            T.StructType([*slice_fields, T.StructField("upto", longs), T.StructField("leftover", longs)]),
        )
    )
    waits = (
        exits.repartition(*keys)
        .sortWithinPartitions(*slices)
        .mapInArrow(_waits(keys), T.StructType([*slice_fields, T.StructField("_wait", T.LongType())]))
    )
    # A slice's wait travels as a row in front of it, so the large rows need no join.
    markers = waits.select(
        *[F.col(c) if c in keys else F.lit(None).cast(events.schema[c].dataType).alias(c) for c in columns],
        "_slice",
        F.lit(-1).cast("bigint").alias("_offset"),
        "_wait",
    )
    return (
        rows.withColumn("_wait", F.lit(None).cast("bigint"))
        .unionByName(markers)
        .repartition(*slices)
        .sortWithinPartitions(*slices, "_offset", *order)
        .mapInArrow(_thin(ms, width, slices, columns), T.StructType([T.StructField(f.name, f.dataType) for f in events.schema]))
    )
