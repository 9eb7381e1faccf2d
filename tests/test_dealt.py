import re
from datetime import datetime, timedelta

import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from behavior_spark.operators import tracker
from behavior_spark.plans import storage_queries
from behavior_spark.plans.fixtures import Inputs
from behavior_spark.sources import tables


def test_events_of_one_file_are_dealt_evenly(spark, folder):
    rows = [(i if i % 9 else None, datetime(2024, 1, 1) + timedelta(seconds=i) if i % 7 else None, i % 5, "view", 1.0, '{"k": 3}') for i in range(1, 2001)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(f"{folder}/events.parquet")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = [r["count"] for r in Inputs(spark, folder).base.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert sum(sizes) == 2000 and len(sizes) > 1 and max(sizes) < 2 * 2000 / len(sizes)


def test_a_call_is_trimmed_once_for_each_field(spark):
    calls = spark.createDataFrame([(1, "add_to_cart", '{"product_id":"a","price":" 2.5 ","quantity":" 2 "}'), (2, "search", '{"query":"  "}')], "call_id long, method string, payload string")
    events, rejects = tracker.validate_events(calls)
    spark.conf.set("spark.sql.debug.maxToStringFields", "1000")
    # The items of a purchase have trims of their own; of the call's fields each has one, where there was one in every place that looked at it.
    plans = [frame.drop("products")._jdf.queryExecution().optimizedPlan().toString() for frame in (events, rejects)]
    for key in ("price", "quantity", "results_count", "total"):
        assert all(len(re.findall(rf"trim\(_p#\d+\[{key}\]", plan)) <= 1 for plan in plans), key
    assert [(r.call_id, r.price, r.quantity) for r in events.collect()] == [(1, 2.5, 2)]
    assert [r.call_id for r in rejects.collect()] == [2]


def test_messages_are_made_after_their_rows_are_dealt_to_files(spark, folder):
    rows = [(i, datetime(2024, 1, 1) + timedelta(hours=i), i % 5, "view", 1.0, '{"k": 3}') for i in range(200)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").write.parquet(f"{folder}/events.parquet")
    inputs = Inputs(spark, folder)
    written, write = [], DataFrameWriter.text
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(DataFrameWriter, "text", lambda self, path: written.append(self._df) or write(self, path))
        paths = storage_queries._many_batches(inputs)
    # Range bounds are sampled from what is below the exchange: no text of a message may be made there.
    plan = written[0]._jdf.queryExecution().optimizedPlan().toString()
    assert "event_time" in plan and "event_time" not in plan[plan.index("RepartitionByExpression") :]
    assert sorted(r.raw_message for r in written[0].collect()) == sorted(r.raw_message for r in inputs.messages.collect())
    assert tables.events(spark, paths.events).count() + spark.read.parquet(f"{paths.malformed}/run=*/*").count() == 200
