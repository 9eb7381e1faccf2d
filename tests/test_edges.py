"""Stray values: rounding, times, bins, numbers, options of sources."""

from collections import Counter
from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from behavior_spark import reports
from behavior_spark.functions import parse_event_time, to_fixed
from behavior_spark.functions.jsontext import double_of
from behavior_spark.operators import tracker
from behavior_spark.sources.messages import OFFSETS_PER_TRIGGER, explode_batch, kafka_options
from behavior_spark.streaming import stateful


def column(spark, values, kind):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i INT, v {kind}")


def applied(spark, values, kind, change):
    return [r.out for r in column(spark, values, kind).select("i", change(F.col("v")).alias("out")).orderBy("i").collect()]


def test_to_fixed_looks_at_the_binary_value(spark):
    given = [2.675, 10.235, 1.005, 0.125, 8.345, 1.45, -2.675, -0.125, 0.0, 1e17, 1234567.885, 0.615, None]
    # What a browser's toFixed(2) shows.
    shown = [2.67, 10.23, 1.0, 0.13, 8.35, 1.45, -2.67, -0.13, 0.0, 1e17, 1234567.88, 0.61, None]
    exact = [None if x is None else x for x in shown]
    got = applied(spark, given, "DOUBLE", to_fixed)
    from decimal import ROUND_HALF_UP, Decimal

    want = [None if x is None else float(Decimal(x).quantize(Decimal("0.01"), ROUND_HALF_UP)) for x in given]
    assert got == want
    assert got[:2] == exact[:2]


def test_times_need_a_date(spark):
    at = datetime(2024, 3, 5, 10, 0, 0)
    texts = ["Tue, 05 Mar 2024 10:00:00 GMT", "05 Mar 2024 12:00:00 +0200", "20240305100000", "2024/03/05 10:00:00", "2024-03-05T10:00:00Z", "1709632800",
             "1709632800000", "12:30", "T10:00:00", "soon", "", None]
    assert applied(spark, texts, "STRING", parse_event_time) == [at] * 7 + [None] * 5


def test_numbers_have_no_type_letter(spark):
    assert applied(spark, ["5f", "5d", "5D ", "5", " 2.5 ", "NaN", "1e400"], "STRING", double_of) == [None, None, None, 5.0, 2.5, None, None]


def test_quantities_that_fit_no_whole_number_are_null(spark):
    assert applied(spark, ["1e300", "2.5", "-1"], "STRING", tracker.normalize_quantity) == [None, 3, None]


def test_stray_bins_are_left_out(spark):
    bins = spark.createDataFrame([(1e12, 5.0, 3), (50.0, -1e300, 2), (10.0, 20.0, 1), (float("nan"), 5.0, 1)], "x_bin_pct DOUBLE, y_bin_pct DOUBLE, event_count BIGINT")
    cells = {(r.x_bin_pct, r.y_bin_pct): r.event_count for r in reports.density_grid(bins).collect()}
    assert cells == {(50, 5): 0.0, (50, 20): 0.0, (10, 5): 0.0, (10, 20): 1.0}
    assert [(r.x_px, r.y_px) for r in reports.to_pixels(bins, 200, 100).collect()] == [(20.0, 20.0)]


def test_envelopes_are_strict(spark):
    messages = spark.createDataFrame([("{'batch':[{\"type\":\"track\"}]}",), ('{"batch":[{"type":"track"},{"type":"page"}]}',)], "raw_message STRING")
    assert explode_batch(messages).count() == 3  # single quotes open no envelope


@pytest.mark.parametrize("given", [{}, {"maxOffsetsPerTrigger": "7", "minPartitions": "9"}])
def test_kafka_options(given):
    found = kafka_options("host:9092", "clicks", **given)
    assert found["kafka.bootstrap.servers"] == "host:9092" and found["subscribe"] == "clicks" and found["startingOffsets"] == "earliest"
    assert found["maxOffsetsPerTrigger"] == given.get("maxOffsetsPerTrigger", str(OFFSETS_PER_TRIGGER))
    assert ("minPartitions" in found) == ("minPartitions" in given)


def test_a_late_first_purchase_passes_and_no_repeat_does(spark, folder):
    batches = [[("u", "o1", 14, "e1")], [("u", "o2", 0, "e2")], [("u", "o1", 29, "e3"), ("v", "o1", 30, "e4")], [("u", "", 31, "e5"), ("u", "o2", 1, "e6")]]
    schema = "anonymous_user_id STRING, order_id STRING, event_time TIMESTAMP, event_id STRING"
    for batch in batches:
        rows = [(u, o, datetime(2024, 1, 1 + h // 24, h % 24), e) for u, o, h, e in batch]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    run = tracker.first_purchase_stream(stream).writeStream.format("parquet").option("checkpointLocation", f"{folder}/c").trigger(availableNow=True)
    run.start(f"{folder}/out").awaitTermination()
    assert {r.event_id for r in spark.read.schema(schema).parquet(f"{folder}/out").collect()} == {"e1", "e2", "e4"}


def test_first_purchases_are_found_by_whole_tasks(spark, folder, monkeypatch):
    monkeypatch.setattr(stateful, "MERGED", 10)  # merged many times
    schema = "anonymous_user_id STRING, order_id STRING, event_time TIMESTAMP, event_id STRING, price DECIMAL(12,2)"
    at = [None, *[datetime(2024, 1, 1, h) for h in range(20)]]
    batches = [[(u, f"o{o}", at[(i * 7 + o) % len(at)], f"e{n}{i % 9}", Decimal(i)) for u in ("u", None, "") for o in range(5 + 9 * n) for i in range(12)] for n in range(3)]
    expected, known = [], set()
    for batch in batches:
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        rows = sorted(batch, key=lambda r: (r[2] is None, r[2] or datetime.max, r[3]))
        for row in rows:
            if row[:2] not in known:
                known.add(row[:2])
                expected.append(row)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    first = tracker.first_purchase_stream(stream)
    plan = first._jdf.queryExecution().logical().toString()
    assert "Deduplicate" in plan and "TransformWithState" not in plan  # no call of Python per key
    first.writeStream.format("parquet").option("checkpointLocation", f"{folder}/c").trigger(availableNow=True).start(f"{folder}/out").awaitTermination()
    assert Counter(map(tuple, spark.read.schema(schema).parquet(f"{folder}/out").collect())) == Counter(expected)
