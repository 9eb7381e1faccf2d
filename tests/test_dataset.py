"""Offline dataset: four CSV files to typed tables."""

import hashlib
from pathlib import Path

import pytest

from behavior_spark import features, ingest, quality, tables
from behavior_spark.sources.dataset import load_batch_id, read_dataset_csv, source_files, with_source_row_num


@pytest.fixture
def files(folder):
    events = ["timestamp,visitorid,event,itemid,transactionid"]
    events += [f"{1433221332117 + i * 60000},{i % 50},{['view', 'addtocart', 'transaction'][i % 3]},{i % 20},{i if i % 3 == 2 else ''}" for i in range(3000)]
    Path(folder, "events.csv").write_text("\n".join(events) + "\n")
    for part in (1, 2):
        rows = ["timestamp,itemid,property,value"]
        rows += [f"{1433221332117 + i},{i},{'categoryid' if i % 2 else 'available'},{'1338' if i % 2 else '1'}" for i in range(part, 20, 2)]
        rows.append('1433221339999,19,790,"n1.000 ""a"", n2"')
        Path(folder, f"item_properties_part{part}.csv").write_text("\n".join(rows) + "\n")
    Path(folder, "category_tree.csv").write_text("categoryid,parentid\n1338,\n7,1338\n")
    return folder


def test_missing_file_raises(spark, folder):
    with pytest.raises(FileNotFoundError, match="events.csv"):
        source_files(spark, folder)


def test_batch_id(spark, files):
    names = ["events.csv", "item_properties_part1.csv", "item_properties_part2.csv", "category_tree.csv"]
    text = "|".join(f"{n}:{Path(files, n).stat().st_size}" for n in names)
    assert load_batch_id(source_files(spark, files)) == hashlib.sha256(text.encode()).hexdigest()[:16]


def test_row_numbers_over_splits(spark, files):
    from behavior_spark.schemas import CSV_SCHEMAS

    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    try:
        rows = spark.read.schema(CSV_SCHEMAS["events.csv"]).option("header", True).csv(f"{files}/events.csv")
        numbered = with_source_row_num(rows)
        assert rows.rdd.getNumPartitions() > 5
        found = {(r.source_row_num, r.timestamp) for r in numbered.collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert found == {(i + 2, str(1433221332117 + i * 60000)) for i in range(3000)}


def test_import(spark, files):
    raw = {name: ingest.with_row_hash(rows) for name, rows in read_dataset_csv(spark, files).items()}
    events = ingest.dataset_events(raw["events.csv"])
    assert events.where("transaction_id IS NOT NULL").count() == 1000
    first = events.where("source_row_num = 2").first()
    line = f"events.csv:2:{1433221332117}|0|view|0|"
    assert first.row_hash == hashlib.sha256(line.encode()).hexdigest()
    assert first.event_time.isoformat() == "2015-06-02T05:02:12.117000"
    props = ingest.dataset_properties(raw["item_properties_part1.csv"], raw["item_properties_part2.csv"])
    assert props.where("""value = 'n1.000 "a", n2'""").count() == 2
    tree = ingest.dataset_categories(raw["category_tree.csv"])
    assert {(r.category_id, r.parent_id) for r in tree.collect()} == {(1338, None), (7, 1338)}
    quality.require(quality.expect_distribution(events, {"view": 1000, "addtocart": 1000, "transaction": 1000}))
    counts = quality.expect_counts({"events": events, "category_tree": tree}, {"events": 3000, "category_tree": 3})
    with pytest.raises(RuntimeError, match="category_tree"):
        quality.require(counts)


def test_import_is_repeatable(spark, files, folder):
    root = f"{folder}/tables"
    totals = {"events": 3000, "item_properties": 21, "category_tree": 2}
    batch, written = ingest.import_dataset(spark, files, root, "2024-01-01 00:00:00", totals, {"view": 1000, "addtocart": 1000, "transaction": 1000})
    assert written
    assert ingest.import_dataset(spark, files, root) == (batch, False)
    stored = tables.dataset_table(spark, f"{root}/events", "events")
    assert stored.count() == 3000 == tables.dataset_latest(stored, "events").count()
    assert {r.load_batch_id for r in stored.select("load_batch_id").distinct().collect()} == {batch}
    Path(files, "category_tree.csv").write_text("categoryid,parentid\n1338,\n")
    second, written = ingest.import_dataset(spark, files, root)
    assert written and second != batch
    assert tables.dataset_table(spark, f"{root}/events", "events").count() == 6000
    with pytest.raises(RuntimeError):
        ingest.import_dataset(spark, files, f"{folder}/other", totals={"events": 1})


def test_item_latest_keeps_every_item(spark):
    rows = [
        (1, "2024-01-01", "categoryid", "5"), (1, "2024-01-02", "categoryid", "18446744073709551615"),
        (1, "2024-01-01", "available", "0"), (2, "2024-01-01", "790", "x"), (3, "2024-01-01", "categoryid", "-4"),
        (4, "2024-01-01", "categoryid", " 4"),
    ]
    df = spark.createDataFrame(rows, "item_id INT, t STRING, property STRING, value STRING").selectExpr(
        "CAST(item_id AS BIGINT) item_id", "CAST(t AS TIMESTAMP) event_time", "property", "value"
    )
    found = {r.item_id: (None if r.category_id is None else int(r.category_id), r.available) for r in features.item_latest(df).collect()}
    assert found == {1: (2**64 - 1, "0"), 2: (None, ""), 3: (None, ""), 4: (None, "")}


def test_views(spark):
    from behavior_spark.plans.fixtures import Inputs

    t = Inputs(spark, "/root/testdata/sf0.001")
    names = tables.register_views(spark, t.click_events, t.dataset_events, t.item_properties)
    assert {"session_features", "lead_scores_rule_based", "unified_events", "item_latest", "click_events_ga4"} <= set(names)
    hot = spark.sql("SELECT count(*) FROM lead_scores_rule_based WHERE score_tier = 'hot'").first()[0]
    assert hot == 57
