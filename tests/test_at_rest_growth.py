from datetime import datetime

from pyspark.sql import functions as F

from behavior_spark import schemas
from behavior_spark.sources import at_rest, manifest, tables

AT = datetime(2024, 1, 1)


def _orders(spark, lo, hi, turn):
    rows = spark.range(lo, hi).select(
        F.when(F.col("id") % 97 == 0, None).otherwise(F.concat(F.lit("o"), F.col("id") % 700)).alias("order_id"),
        (F.lit(AT) + F.make_interval(secs=(F.col("id") * 7919 + turn) % 1000)).alias("event_time"),
        F.concat(F.lit("u"), F.col("id")).alias("anonymous_user_id"), F.sha2(F.col("id").cast("string"), 512).alias("products_json"),
    )
    return tables.align(rows, schemas.ORDERS)


def test_buckets_follow_the_size_of_the_table(spark, folder, monkeypatch):
    monkeypatch.setattr(at_rest, "BUCKET_BYTES", 8000)
    some = [_orders(spark, 0, 50, 0), _orders(spark, 40, 900, 1), _orders(spark, 0, 900, 2), _orders(spark, 0, 30, 3)]
    buckets, every = [], None
    for i, batch in enumerate(some):
        assert at_rest.upsert_orders(batch, folder, f"b{i}", buckets=2, most_folders=2)
        every = batch if every is None else every.unionByName(batch)
        known = manifest.load(spark, folder)
        buckets.append(known.layout["buckets"])
        # No bucket that a task sorts is far above the bound.
        size = sum(at_rest._bytes(spark, f"{folder}/{manifest.PARTS}/{f}") for f in known.folders[manifest.WHOLE])
        assert size <= 2 * 8000 * buckets[-1]  # files this small are half footer
        keys = ["order_id", "event_time", "anonymous_user_id"]
        got, want = at_rest.orders(spark, folder).select(keys), tables.orders_latest(every).select(keys)
        assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0
    assert not at_rest.upsert_orders(some[0], folder, "b0")
    assert buckets[0] < buckets[1] <= buckets[2] and buckets == sorted(buckets)
    plan = at_rest.orders(spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_a_large_first_batch_gets_its_buckets_at_once(spark, folder, monkeypatch):
    monkeypatch.setattr(at_rest, "BUCKET_BYTES", 8000)
    at_rest.upsert_orders(_orders(spark, 0, 900, 0), folder, buckets=2)
    known = manifest.load(spark, folder)
    assert known.layout["buckets"] >= 8 and len(known.folders[manifest.WHOLE]) == 1


def test_enough_buckets():
    assert [at_rest._enough(8, n * at_rest.BUCKET_BYTES) for n in (0, 8, 9, 16, 100)] == [8, 8, 16, 16, 128]
