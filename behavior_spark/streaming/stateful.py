"""Tracker rules on live streams; the state is one number or flag per key."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

# Executors need no copy of this package: the processor travels with the query.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

MERGED = 50_000  # rows that wait at least before they are merged
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Gathered:
    """Rows of a key that arrive in parts. They are merged when as many wait as are held, so that n rows cost n log n and not the square of n."""

    def __init__(self, merge: Callable[[pd.DataFrame], pd.DataFrame], held: pd.DataFrame | None = None):
        self.merge, self.held, self.parts, self.size = merge, held, [], 0

    def add(self, part: pd.DataFrame) -> None:
        self.parts.append(part)
        self.size += len(part)
        if self.size > max(MERGED, 0 if self.held is None else len(self.held)):
            self.rows()

    def rows(self) -> pd.DataFrame | None:
        if self.parts:
            some = self.parts if self.held is None else [self.held, *self.parts]
            self.held, self.parts, self.size = self.merge(pd.concat(some, ignore_index=True)), [], 0
        return self.held


class _Throttle(StatefulProcessor):
    """Remembers the time of the last kept row of a key."""

    def __init__(self, ms: int, columns: Sequence[str], order: Sequence[str], ttl_ms: int | None):
        self.ms, self.columns, self.order, self.ttl_ms = ms, list(columns), list(order), ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        schema = T.StructType([T.StructField("ms", T.LongType())])
        self.last = handle.getValueState("last_kept", schema, ttlDurationMs=self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # Spark renames columns that start with an underscore here, so the plan's order counts. Only the first
        # row of a millisecond can be kept: memory follows the time that a micro-batch spans, not its rows.
        gathered = _Gathered(lambda both: both.sort_values(["row_ms", *self.order], kind="stable").drop_duplicates("row_ms"))
        for part in rows:
            if len(part):
                gathered.add(part.set_axis([*self.columns, "row_ms"], axis=1))
        batch = gathered.rows()
        if batch is None:
            return
        times = batch["row_ms"].to_numpy(dtype=np.int64)
        free_from = self.last.get()[0] + self.ms if self.last.exists() else times[0]
        kept = []
        at = int(np.searchsorted(times, free_from, side="left"))
        while at < len(times):
            kept.append(at)
            at = int(np.searchsorted(times, times[at] + self.ms, side="left"))
        if kept:
            self.last.update((int(times[kept[-1]]),))
            yield batch.iloc[kept][self.columns]

    def close(self) -> None:
        pass


def throttle_stream(
    stream: DataFrame,
    ms: int = 100,
    keys: Sequence[str] = ("session_id", "anonymous_user_id"),
    time: str = "event_time",
    order: Sequence[str] = ("event_id",),
    ttl_ms: int | None = None,
) -> DataFrame:
    """Thin a live stream: keep a row if ``ms`` or more passed since the last kept row.

    Rows are taken in the order of their time within a micro-batch; a row that arrives
    after a later one was kept counts as too early, so a stream equals the batch operator as long as no key's rows
    arrive in an earlier order than in the micro-batches before. State, one number per key, is kept for ever; with ``ttl_ms`` it is
    dropped after that time without a kept row, and then a replay of late data keeps other rows. The user is part of the key so that
    the unknown session is spread.
    """
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    columns = stream.columns
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in stream.schema])
    return (
        stream.where(F.col(time).isNotNull())
        .withColumn("row_ms", F.unix_millis(F.col(time)))
        .groupBy(*keys)
        .transformWithStateInPandas(
            statefulProcessor=_Throttle(ms, columns, order, ttl_ms),
            outputStructType=schema,
            outputMode="Append",
            timeMode="None" if ttl_ms is None else "ProcessingTime",
        )
    )


def _first_rows(keys: Sequence[str], order: Sequence[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of a task's rows the first per key. Rows wait until they are as many as the keys, so memory follows the keys and not their repeats."""

    def first(rows: pa.Table) -> pa.Table:
        ordered = rows.sort_by([(name, "ascending") for name in order])  # stable, nulls last
        numbered = ordered.select(list(keys)).append_column("nth row", pa.array(np.arange(len(ordered))))
        found = numbered.group_by(list(keys), use_threads=False).aggregate([("nth row", "min")])
        return ordered.take(found["nth row_min"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, waiting, size = None, [], 0
        for batch in batches:
            waiting.append(pa.Table.from_batches([batch]))
            size += batch.num_rows
            if size > max(MERGED, 0 if held is None else len(held)):
                held, waiting, size = first(pa.concat_tables([*([] if held is None else [held]), *waiting])), [], 0
        if waiting:
            held = first(pa.concat_tables([*([] if held is None else [held]), *waiting]))
        if held is not None:
            yield from held.to_batches(max_chunksize=10_000)

    return run


def first_purchase_stream(
    stream: DataFrame,
    keys: Sequence[str] = ("anonymous_user_id", "order_id"),
    time: str = "event_time",
    order: Sequence[str] = ("event_id",),
) -> DataFrame:
    """The first purchase per user and order that the stream sees, however late it arrives; no repeat ever passes.

    The state is one flag per user and order and is never dropped: an order is known for ever, as it is to the
    batch operator. Within a micro-batch the earliest by ``time`` and ``order`` passes: a micro-batch is cut down to it first,
    whole tasks at a time, and Spark's own deduplication remembers the keys. (A checkpoint of the processor per key that did this before cannot be continued.)
    """
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    # A micro-batch stores what it changed, not the files of every partition's database.
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in stream.schema])
    return (
        stream.where(F.col("order_id").isNotNull() & (F.col("order_id") != ""))
        .repartition(*keys)
        .mapInArrow(_first_rows(keys, [time, *order]), schema)
        .dropDuplicates(list(keys))
    )


class _InOrder(StatefulProcessor):
    """Holds rows until the watermark has passed them, then thins them in the order of their time.

    Two values per key: the time of the last kept row, and the waiting rows as Arrow bytes, one row per millisecond at most.
    """

    def __init__(self, ms: int, columns: Sequence[str], order: Sequence[str]):
        self.ms, self.columns, self.order = ms, list(columns), list(order)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last_kept", T.StructType([T.StructField("ms", T.LongType())]))
        self.held = handle.getValueState("held", T.StructType([T.StructField("rows", T.BinaryType())]))

    def _waiting(self) -> pd.DataFrame | None:
        if not self.held.exists():
            return None
        with pa.ipc.open_stream(self.held.get()[0]) as stored:
            return stored.read_pandas()

    def _keep(self, rows: pd.DataFrame) -> None:
        if not len(rows):
            self.held.clear()
            return
        sink = pa.BufferOutputStream()
        table = pa.Table.from_pandas(rows, preserve_index=False)
        with pa.ipc.new_stream(sink, table.schema) as stored:
            stored.write_table(table)
        self.held.update((sink.getvalue().to_pybytes(),))

    def _first_per_ms(self, rows: pd.DataFrame) -> pd.DataFrame:
        return rows.sort_values(["row_ms", *self.order], kind="stable").drop_duplicates("row_ms")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        before = self._waiting()
        gathered = _Gathered(self._first_per_ms, before)
        for part in rows:
            if not len(part):
                continue
            part = part.set_axis([*self.columns, "row_ms"], axis=1)
            late = part["row_ms"] < passed
            if late.any():
                yield part[late][self.columns].assign(late=True)
            if not late.all():
                gathered.add(part[~late])
        waiting = gathered.rows()
        if waiting is None or not len(waiting):
            return
        self._keep(waiting)
        first = int(waiting["row_ms"].iloc[0])
        if before is None or first < int(before["row_ms"].iloc[0]):
            if before is not None:
                self.handle.deleteTimer(int(before["row_ms"].iloc[0]))
            self.handle.registerTimer(first)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        waiting = self._waiting()
        if waiting is None:
            return
        times = waiting["row_ms"].to_numpy(dtype=np.int64)
        ready = int(np.searchsorted(times, timerValues.getCurrentWatermarkInMs(), side="left"))
        # A row at the watermark itself may still get company; the timer that fired is for one before it or at it.
        ready = max(ready, int(np.searchsorted(times, expiredTimerInfo.getExpiryTimeInMs(), side="right")))
        at = int(np.searchsorted(times, self.last.get()[0] + self.ms, side="left")) if self.last.exists() else 0
        kept = []
        while at < ready:
            kept.append(at)
            at = int(np.searchsorted(times, times[at] + self.ms, side="left"))
        rest = waiting.iloc[ready:]
        self._keep(rest)
        if len(rest):
            self.handle.registerTimer(int(rest["row_ms"].iloc[0]))
        if kept:
            self.last.update((int(times[kept[-1]]),))
            yield waiting.iloc[kept][self.columns].assign(late=False)

    def close(self) -> None:
        pass


def throttle_by_event_time(
    stream: DataFrame,
    delay: str = "10 seconds",
    ms: int = 100,
    keys: Sequence[str] = ("session_id", "anonymous_user_id"),
    time: str = "event_time",
    order: Sequence[str] = ("event_id",),
) -> DataFrame:
    """Thin a live stream in the order of event time, whatever order its rows arrive in.

    A row waits until the watermark (the latest time seen, less ``delay``) has passed it; then it is kept if ``ms`` or more passed since the
    last kept row of its key, exactly as the batch operator decides. Rows that arrive behind the watermark come out unthinned with
    ``late`` set, for a side table; all others have it unset. Rows without a time are dropped.

    State per key is the last kept time and the rows of the last ``delay``, one per millisecond, so it does not grow with the
    rows that a hot key sends.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in stream.schema])
    columns = [F.col(c) if c != time else (F.col(c) + F.expr("INTERVAL 0 SECONDS")).alias(c) for c in stream.columns]
    return (
        stream.where(F.col(time).isNotNull())
        .withWatermark(time, delay)
        # The shifted copy carries no watermark, so Spark leaves late rows to the processor instead of dropping them.
        .select(*columns, F.unix_millis(F.col(time)).alias("row_ms"))
        .groupBy(*keys)
        .transformWithStateInPandas(
            statefulProcessor=_InOrder(ms, stream.columns, order), outputStructType=schema.add("late", T.BooleanType()),
            outputMode="Append", timeMode="EventTime",
        )
    )
