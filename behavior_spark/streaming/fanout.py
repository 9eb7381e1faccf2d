"""One message stream into the event, line-item and order tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from datetime import datetime, timezone
from typing import TypeVar

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from behavior_spark import schemas
from behavior_spark.functions import event_month
from behavior_spark.operators import features, ingest
from behavior_spark.sources.manifest import Manifest
from behavior_spark.sources.messages import RAW
from behavior_spark.sources.tables import MONTH
from behavior_spark.streaming.compaction import compact

# Fixed value: the client's flush interval.
FLUSH = {"processingTime": "5 seconds"}
# Where a message says its time: as a date, or as a number of seconds or milliseconds.
_TIME = r'"(?:event_time|timestamp)"\s*:\s*"?\s*([0-9]+-?[0-9]*)'
CODEC = "zstd"
R = TypeVar("R")


@dataclass(frozen=True)
class Paths:
    """Where the tables go. ``malformed`` takes the messages that are no JSON object, ``sessions`` the partial session features."""

    events: str
    items: str
    orders: str
    malformed: str
    sessions: str

    @classmethod
    def below(cls, folder: str) -> Paths:
        return cls(*[f"{folder}/{name}" for name in ("events", "items", "orders", "malformed", "sessions")])


def in_order_of_time(messages: DataFrame) -> DataFrame:
    """Messages in even ranges of their time, so that a task holds few months and a heavy month is spread over many tasks.

    The time is read off the text: it only decides which task writes a message, never its month. This is the only shuffle of a message; all
    tables are written from it, and each of them would cost one of its own otherwise. Equal texts stay together.
    """
    return messages.repartitionByRange(F.substring(F.regexp_extract(RAW, _TIME, 1), 1, 7), F.xxhash64(RAW))


def at_once(spark: SparkSession, jobs: Sequence[Callable[[], R]]) -> list[R]:
    """Run jobs of different tables side by side: each alone leaves most cores idle. All are ended when the first error is raised."""
    with ThreadPoolExecutor(len(jobs)) as pool:
        running = [pool.submit(inheritable_thread_target(spark)(job)) for job in jobs]
    return [job.result() for job in running]


def write_fanout(
    batch: DataFrame, batch_id: int, run_id: str, paths: Paths, now: Column | datetime | str | None = None,
    new_id: str = "digest",
) -> None:
    """Write one micro-batch to every table.

    A message is shuffled and parsed once. The folder names the run and the batch and is overwritten, so
    a batch that is replayed after a failure replaces itself. Ids must come out the same when a lost part of the batch is
    computed again, so random ones are refused.
    """
    if new_id != "digest":
        raise ValueError("a stream's missing ids must be digests: random ones differ between its tables and replays")
    arrival = now if now is not None else datetime.now(timezone.utc)
    parsed = ingest.parse_messages(in_order_of_time(batch)).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        events = ingest.normalize_events(parsed, arrival, new_id)
        tables = {
            paths.events: events,
            paths.items: ingest.purchase_items(parsed, arrival),
            paths.orders: ingest.orders(parsed, arrival),
        }
        folder = f"run={run_id}/ingest_batch={batch_id}"

        def write(rows: DataFrame, path: str, by_month: bool = True) -> None:
            writer = rows.write.mode("overwrite").option("compression", CODEC)
            (writer.partitionBy(MONTH) if by_month else writer).parquet(f"{path}/{folder}")

        monthly = {path: rows.withColumn(MONTH, event_month(F.col("event_time"))) for path, rows in tables.items()}
        # REBALANCE sizes the files by their data: without it every task writes a small file per month.
        partials = features.session_partials(events, [event_month(F.col("event_time")).alias(MONTH)]).hint("rebalance", MONTH)
        malformed = parsed.where("malformed").select(RAW).hint("rebalance")
        jobs = [lambda path=path, rows=rows: write(rows, path) for path, rows in {**monthly, paths.sessions: partials}.items()]
        at_once(batch.sparkSession, [*jobs, lambda: write(malformed, paths.malformed, False)])
    finally:
        parsed.unpersist()


def compact_fanout(spark: SparkSession, paths: Paths, folders_per_month: int = 1) -> dict[str, Manifest | None]:
    """Merge the closed micro-batches of all tables (see ``compaction.compact``)."""
    tables = {
        paths.events: (schemas.CLICK_EVENTS, ["page_url", "event_type", "event_time"]),
        paths.items: (schemas.PURCHASE_ITEMS, ["order_id", "product_id", "event_time"]),
        paths.orders: (schemas.ORDERS, ["order_id", "event_time"]),
        paths.malformed: (schemas.MALFORMED, (), None, False),
        paths.sessions: (features.SESSION_PARTIALS, ["session_id", "anonymous_user_id"], lambda rows: features.combine_partials(rows, [MONTH])),
    }
    jobs = [lambda path=path, how=how: compact(spark, path, *how[:2], folders_per_month, *how[2:]) for path, how in tables.items()]
    return dict(zip(tables, at_once(spark, jobs), strict=True))


def start_fanout(
    stream: DataFrame,
    paths: Paths,
    checkpoint: str,
    trigger: dict | None = None,
    now: Column | datetime | str | None = None,
    new_id: str = "digest",
    compact_every: int | None = None,
) -> StreamingQuery:
    """Start the continuous ingest; ``trigger`` defaults to the client's 5 second flush.

    The run id is the id Spark keeps in the checkpoint: the same after a restart, a new one
    if the checkpoint is lost and batch numbers start again. With ``compact_every`` the folders of
    so many micro-batches are merged before the next one is written.
    """
    run: dict[str, str] = {}

    def write(batch: DataFrame, batch_id: int) -> None:
        if "id" not in run:
            stored = batch.sparkSession.read.schema("id STRING").json(f"{checkpoint}/metadata").first()
            run["id"] = stored["id"]
        if compact_every and batch_id and batch_id % compact_every == 0:
            compact_fanout(batch.sparkSession, paths)
        write_fanout(batch, batch_id, run["id"], paths, now, new_id)

    return (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or FLUSH))
        .start()
    )
