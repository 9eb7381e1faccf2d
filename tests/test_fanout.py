import threading

import pytest
from pyspark.sql import functions as F

from behavior_spark.operators import ingest
from behavior_spark.sources import tables
from behavior_spark.streaming import fanout

NOW = "2024-02-01 00:00:00"


def _messages(spark):
    """Half of all messages in one month, the others over two years; dates, milliseconds, and texts without a time."""
    rows = spark.range(4000).selectExpr(
        "id", "CASE WHEN id % 2 = 0 THEN timestamp'2024-01-05 00:00:00' ELSE add_months(date'2022-01-15', int(id % 24)) END + make_interval(0, 0, 0, 0, 0, int(id % 50)) AS t"
    )
    form = """CASE WHEN id % 100 = 99 THEN '{not json' ELSE concat('{"messageId":"m', id, '","type":"purchase","', CASE WHEN id % 3 = 0 THEN 'event_time' ELSE 'timestamp' END, '" : ',
        CASE WHEN id % 5 = 1 THEN concat('', unix_millis(t)) ELSE concat('"', replace(string(t), ' ', 'T'), 'Z"') END, ',"properties":{"order_id":"o', id, '","products":[{"product_id":"p"}]}}') END"""
    return rows.selectExpr(f"{form} AS raw_message")


def test_ranges_are_even_and_hold_few_months(spark):
    messages = _messages(spark).where("raw_message NOT LIKE '{not%' AND raw_message LIKE '%T%'")
    ranged = fanout.in_order_of_time(messages).withColumn("part", F.spark_partition_id())
    rows = ingest.normalize_events(ranged.select("raw_message"), NOW, "digest").withColumn("part", F.spark_partition_id())
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = [r["count"] for r in rows.groupBy("part").count().collect()]
        pairs = rows.select("part", F.date_format("event_time", "yyyy-MM").alias("m")).distinct().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    parts, months = len(sizes), len({r.m for r in pairs})
    assert parts > 1 and max(sizes) < 2 * sum(sizes) / parts  # a month with half of the rows is no single task
    assert len(pairs) < parts + months  # neighbouring tasks share a month at most


def test_tables_are_written_from_one_shuffle_of_the_messages(spark, folder):
    messages = _messages(spark)
    paths = fanout.Paths.below(folder)
    fanout.write_fanout(messages, 0, "r", paths, NOW)
    for got, want in (
        (tables.events(spark, paths.events), ingest.normalize_events(messages, NOW, "digest")),
        (tables.purchase_items(spark, paths.items), ingest.purchase_items(messages, NOW)),
        (tables.orders(spark, paths.orders), ingest.orders(messages, NOW)),
        (tables.malformed(spark, paths.malformed).select("raw_message"), messages.where("raw_message LIKE '{not%'")),
    ):
        assert want.count() > 0 and got.exceptAll(want).count() == want.exceptAll(got).count() == 0
    codecs = {r.path.split("/")[-1].split(".")[-2] for r in spark.read.format("binaryFile").load(f"{paths.orders}/run=r/ingest_batch=0").select("path").collect()}
    assert codecs == {"zstd"}


def test_jobs_run_side_by_side_and_all_end_before_an_error(spark):
    both, ended = threading.Barrier(2, timeout=20), []

    def good():
        both.wait()
        ended.append(spark.range(3).count())
        return 1

    def bad():
        both.wait()
        raise ValueError("no")

    assert fanout.at_once(spark, [good, lambda: both.wait() and 2 or 2]) == [1, 2]
    with pytest.raises(ValueError, match="no"):
        fanout.at_once(spark, [bad, good])
    assert ended == [3, 3]
