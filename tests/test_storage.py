"""Compaction, tables at rest, writes with tokens, partial features and thinning by event time."""

from __future__ import annotations

import os
import re
from datetime import datetime, timedelta
from functools import reduce

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from behavior_spark import schemas
from behavior_spark.operators import features, thinning
from behavior_spark.plans.fixtures import Inputs
from behavior_spark.sources import at_rest, manifest, tables
from behavior_spark.streaming import compaction, fanout, stateful

FOLDER = "/root/testdata/sf0.001"


def same(a: DataFrame, b: DataFrame) -> bool:
    columns = sorted(a.columns)
    assert columns == sorted(b.columns)
    return a.select(columns).exceptAll(b.select(columns)).isEmpty() and b.select(columns).exceptAll(a.select(columns)).isEmpty()


def plan(df: DataFrame) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def messages(spark, parts: int) -> list[DataFrame]:
    rows = Inputs(spark, FOLDER).numbered_messages
    # Out of order: every part has rows from the whole time span.
    return [rows.where(F.pmod(F.xxhash64("n"), F.lit(parts)) == i).select("raw_message") for i in range(parts)]


@pytest.fixture(scope="module")
def fed(spark, tmp_path_factory):
    """Twenty micro-batches, not merged yet, and the rows that went in."""
    paths = fanout.Paths.below(str(tmp_path_factory.mktemp("fed")))
    parts = messages(spark, 20)
    for i, part in enumerate(parts):
        fanout.write_fanout(part, i, "r1", paths, "2024-02-01 00:00:00")
    return paths, reduce(DataFrame.union, parts)


def copied(path: str, folder: str) -> str:
    import shutil

    target = f"{folder}/copy"
    shutil.copytree(path, target)
    return target


def folders_read(df: DataFrame) -> set[str]:
    return {re.sub(r"/[^/]*$", "", f) for f in df.inputFiles()}


def test_compaction_leaves_one_folder_per_month_and_the_same_rows(spark, fed, folder):
    path = copied(fed[0].events, folder)
    before = tables.events(spark, path)
    months, rows = {r[0] for r in before.select(F.date_format("event_time", "yyyyMM")).distinct().collect()}, before.collect()
    assert len(folders_read(before)) >= 20
    done = compaction.compact(spark, path, schemas.CLICK_EVENTS, ["page_url"])
    assert done.version == 1 and done.merged == {"r1": 19} and set(done.folders) == months
    after = tables.events(spark, path)
    assert len(folders_read(after)) == len(months)
    key = repr
    assert sorted(map(key, after.collect())) == sorted(map(key, rows))
    assert compaction.compact(spark, path, schemas.CLICK_EVENTS) is None
    # Months are pruned in the merged layout too.
    some = tables.events(spark, path, ["event_id"], datetime(2024, 1, 3), datetime(2024, 1, 4))
    assert "PartitionFilters: [isnotnull(event_month" in plan(some)


def test_batches_after_a_compaction_and_replays_of_merged_ones(spark, fed, folder):
    path, rows = copied(fed[0].events, folder), tables.events(spark, fed[0].events).collect()
    part = spark.createDataFrame(rows, schemas.CLICK_EVENTS).withColumn(tables.MONTH, F.lit(202401))
    compaction.compact(spark, path, schemas.CLICK_EVENTS)
    # Batch 19 comes again after a failure, then batch 20.
    some = part.limit(5)
    for number, frame in ((19, part.limit(7)), (20, some)):
        frame.write.mode("overwrite").partitionBy(tables.MONTH).parquet(f"{path}/run=r1/ingest_batch={number}")
    assert tables.events(spark, path).count() == len(rows) + 5
    # A batch without its mark was not written to its end: it waits, and so do all after it.
    os.remove(f"{path}/run=r1/ingest_batch=20/_SUCCESS")
    some.write.partitionBy(tables.MONTH).parquet(f"{path}/run=r1/ingest_batch=21")
    assert compaction.compact(spark, path, schemas.CLICK_EVENTS) is None
    some.write.mode("overwrite").partitionBy(tables.MONTH).parquet(f"{path}/run=r1/ingest_batch=20")
    done = compaction.compact(spark, path, schemas.CLICK_EVENTS)
    assert done.merged == {"r1": 21} and {len(f) for f in done.folders.values()} == {1}
    assert tables.events(spark, path).count() == len(rows) + 10


def test_more_folders_per_month_rewrite_less(spark, fed, folder):
    path = copied(fed[0].events, folder)
    first = compaction.compact(spark, path, schemas.CLICK_EVENTS, folders_per_month=2)
    month = sorted(first.folders)[0]
    row = tables.events(spark, path).limit(1).withColumn(tables.MONTH, F.lit(int(month)))
    counts = []
    for number in (20, 21):
        row.write.partitionBy(tables.MONTH).parquet(f"{path}/run=r1/ingest_batch={number}")
        done = compaction.compact(spark, path, schemas.CLICK_EVENTS, folders_per_month=2)
        counts.append(len(done.folders[month]))
    assert counts == [2, 1]


def test_a_crash_before_the_commit_changes_nothing(spark, fed, folder, monkeypatch):
    path = copied(fed[0].events, folder)
    rows = sorted(map(repr, tables.events(spark, path).collect()))

    def crash(*_):
        raise OSError("killed")

    for _ in range(2):  # before the first manifest, and after it
        with monkeypatch.context() as patch:
            patch.setattr(manifest, "commit", crash)
            with pytest.raises(OSError):
                row = None
                compaction.compact(spark, path, schemas.CLICK_EVENTS)
        assert sorted(map(repr, tables.events(spark, path).collect())) == rows
        compaction.compact(spark, path, schemas.CLICK_EVENTS)
        assert sorted(map(repr, tables.events(spark, path).collect())) == rows
        row = tables.events(spark, path).limit(1).withColumn(tables.MONTH, F.date_format("event_time", "yyyyMM").cast("int"))
        row.write.partitionBy(tables.MONTH).parquet(f"{path}/run=r1/ingest_batch={20 + _}")
        rows = sorted(map(repr, tables.events(spark, path).collect()))
    compaction.compact(spark, path, schemas.CLICK_EVENTS)
    gone = compaction.vacuum(spark, path, keep=1)
    assert sum(g.startswith("part=") for g in gone) >= 2 and sum(g.startswith("run=") for g in gone) == 22
    assert sorted(map(repr, tables.events(spark, path).collect())) == rows


def test_two_compactions_at_once(spark, fed, folder):
    path = copied(fed[0].events, folder)
    old = manifest.load(spark, path)
    compaction.compact(spark, path, schemas.CLICK_EVENTS)
    with pytest.raises(manifest.Conflict):
        manifest.commit(spark, path, old, manifest.Manifest())
    assert manifest.versions(spark, path) == [1]
    assert not [n for n in os.listdir(f"{path}/_manifest") if n.endswith(".draft")]


def test_partial_features_equal_features_of_all_events(spark, fed):
    paths, _ = fed
    partials = tables.session_partials(spark, paths.sessions)
    merged = features.merged_sessions(partials)
    assert same(merged, features.live_sessions(tables.events(spark, paths.events)))
    assert all(f"{paths.sessions}/" in f for f in merged.inputFiles())
    assert same(features.merged_sessions(features.combine_partials(partials)), merged)


def test_all_tables_of_a_stream_are_merged(spark, folder):
    paths = fanout.Paths.below(folder)
    for i, part in enumerate(messages(spark, 3)):
        fanout.write_fanout(part, i, "r1", paths, "2024-02-01 00:00:00")
    before = [tables.events(spark, paths.events).count(), tables.malformed(spark, paths.malformed).count()]
    sessions, partials = features.merged_sessions(tables.session_partials(spark, paths.sessions)).collect(), tables.session_partials(spark, paths.sessions).count()
    done = fanout.compact_fanout(spark, paths)
    assert all(m.merged == {"r1": 2} for m in done.values())
    assert [tables.events(spark, paths.events).count(), tables.malformed(spark, paths.malformed).count()] == before
    again = features.merged_sessions(tables.session_partials(spark, paths.sessions)).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, sessions))
    assert tables.session_partials(spark, paths.sessions).count() < partials
    assert tables.orders(spark, paths.orders).count() >= 0 and tables.purchase_items(spark, paths.items).count() >= 0


def test_a_stream_merges_its_own_batches(spark, folder):
    source = f"{folder}/in"
    for part in messages(spark, 5):
        part.coalesce(1).write.mode("append").text(source)
    paths = fanout.Paths.below(f"{folder}/out")
    stream = spark.readStream.format("text").option("maxFilesPerTrigger", 1).load(source).withColumnRenamed("value", "raw_message")
    fanout.start_fanout(stream, paths, f"{folder}/cp", {"availableNow": True}, "2024-02-01 00:00:00", compact_every=2).awaitTermination()
    assert list(manifest.load(spark, paths.events).merged.values()) == [3]
    assert tables.events(spark, paths.events).count() + tables.malformed(spark, paths.malformed).count() == Inputs(spark, FOLDER).messages.count()


@pytest.mark.parametrize("merged", [False, True])
def test_recent_events_open_only_young_files(spark, fed, folder, merged):
    """Old files hold nothing but garbage: the read works because it does not open them."""
    path = copied(fed[0].events, folder)
    if merged:
        compaction.compact(spark, path, schemas.CLICK_EVENTS)
    rows = tables.events(spark, path).count()
    now = datetime.now()
    for place, _, names in os.walk(path):
        for name in names:
            if name.endswith(".parquet"):
                with open(f"{place}/{name}", "r+b") as f:
                    f.write(b"no parquet at all")
                    f.truncate()
                os.utime(f"{place}/{name}", (1_600_000_000, 1_600_000_000))
                crc = f"{place}/.{name}.crc"
                if os.path.exists(crc):
                    os.remove(crc)
    young = spark.createDataFrame([("a", now - timedelta(minutes=3)), ("b", now - timedelta(minutes=30))], "event_id string, received_at timestamp")
    young = tables.align(young.withColumn("event_time", F.col("received_at")), schemas.CLICK_EVENTS).withColumn(tables.MONTH, F.lit(202401))
    young.write.partitionBy(tables.MONTH).parquet(f"{path}/run=r1/ingest_batch=20")
    assert rows > 100
    assert [r.event_id for r in tables.recent_events(spark, path, now, 10).collect()] == ["a"]
    assert {r.event_id for r in tables.recent_events(spark, path, now, 40).collect()} == {"a", "b"}
    with pytest.raises(Exception, match="(?i)parquet"):
        tables.events(spark, path).collect()


# ---- tables at rest ----------------------------------------------------------------------------


def order_batches(spark) -> list[DataFrame]:
    rows = Inputs(spark, FOLDER).orders
    later = rows.withColumns({"event_time": F.col("event_time") + F.expr("INTERVAL 1 DAY"), "total": F.col("total") + 1})
    earlier = rows.withColumn("event_time", F.col("event_time") - F.expr("INTERVAL 1 DAY"))
    return [rows, later.where("hash(order_id) % 3 = 0"), earlier, rows.where("hash(order_id) % 2 = 0"), later.where("order_id = ''")]


@pytest.mark.parametrize("most_folders", [1, 2, 8])
def test_latest_rows_at_rest_need_no_shuffle(spark, folder, most_folders):
    batches = order_batches(spark)
    for batch in batches:
        assert at_rest.upsert_orders(batch, folder, buckets=4, most_folders=most_folders)
    stored = at_rest.orders(spark, folder)
    assert "Exchange" not in plan(stored) and "Exchange" not in plan(tables.orders_latest(stored))
    assert "Bucketed: true" in plan(tables.orders_latest(stored))
    expected = tables.orders_latest(reduce(DataFrame.unionByName, batches))
    assert stored.count() == expected.count()
    # Equal rows but for the order of items in a text that two messages of one time may have in two ways.
    assert same(stored.drop("products_json"), tables.align(expected, schemas.ORDERS).drop("products_json"))
    assert len(manifest.load(spark, folder).folders["all"]) <= most_folders


def test_buckets_are_merged_without_a_shuffle(spark, folder):
    for batch in order_batches(spark)[:3]:
        at_rest.upsert_orders(batch, folder, buckets=4)
    known = manifest.load(spark, folder)
    merged = at_rest._merged(spark, folder, known, schemas.ORDERS)
    assert len(known.folders["all"]) == 3 and "Exchange" not in plan(merged)
    assert merged.select("order_id").distinct().count() == merged.count()
    files = [f for f in os.listdir(f"{folder}/_parts/{known.folders['all'][0]}") if f.endswith(".parquet")]
    assert len(files) <= 4


def test_upsert_settles_ties_and_tokens(spark, folder):
    at = datetime(2024, 1, 1)
    row = {"order_id": "o", "event_time": at, "anonymous_user_id": "u", "session_id": "s", "total": 1}

    def rows(*changes):
        return tables.align(spark.createDataFrame([{**row, **c} for c in changes], "order_id string, event_time timestamp, anonymous_user_id string, session_id string, total int"), schemas.ORDERS)

    assert at_rest.upsert_orders(rows({}, {"total": 3}, {"order_id": None}), folder, "b1", buckets=2)
    assert not at_rest.upsert_orders(rows({"total": 9}), folder, "b1")
    assert at_rest.upsert_orders(rows({"total": 2}, {"order_id": None, "event_time": at + timedelta(1)}), folder, "b2")
    got = {r.order_id: (int(r.total), r.event_time) for r in at_rest.orders(spark, folder).collect()}
    assert got == {"o": (3, at), None: (1, at + timedelta(1))}
    with pytest.raises(ValueError):
        at_rest.upsert(rows({}), folder, schemas.ORDERS, ["session_id"], "event_time")
    assert at_rest.orders(spark, f"{folder}/nothing").count() == 0


def test_a_killed_upsert_is_not_seen(spark, folder, monkeypatch):
    batches = order_batches(spark)
    at_rest.upsert_orders(batches[0], folder, "a", buckets=4)
    with monkeypatch.context() as patch:
        patch.setattr(manifest, "commit", lambda *_: (_ for _ in ()).throw(OSError("killed")))
        with pytest.raises(OSError):
            at_rest.upsert_orders(batches[1], folder, "b")
    keys = ["order_id", "event_time", "total"]
    assert same(at_rest.orders(spark, folder).select(keys), tables.orders_latest(batches[0]).select(keys))
    assert at_rest.upsert_orders(batches[1], folder, "b")
    manifest.vacuum(spark, folder, keep=1)
    both = tables.align(batches[0].unionByName(batches[1]), schemas.ORDERS)
    assert same(at_rest.orders(spark, folder).select(keys), tables.orders_latest(both).select(keys))


def test_scores_and_dataset_at_rest(spark, folder):
    t = Inputs(spark, FOLDER)
    for run in (2, 1):
        at_rest.upsert_ml_scores(t.ml_scores.where(F.col("model_version") == f"gbt_v{run}"), f"{folder}/s", f"run{run}", buckets=4)
    assert same(at_rest.ml_scores(spark, f"{folder}/s"), tables.ml_scores_latest(t.ml_scores))
    loads = [t.dataset_events.withColumns({"load_batch_id": F.lit(f"b{n}"), "ingested_at": F.lit(datetime(2024, 2, 1, n))}) for n in (1, 2)]
    for load in loads:
        at_rest.upsert_dataset(load, f"{folder}/d", "events", buckets=4)
    stored = at_rest.dataset_table(spark, f"{folder}/d", "events")
    expected = tables.dataset_latest(tables.align(loads[0].unionByName(loads[1]), schemas.DATASET_TABLES["events"]), "events")
    assert same(stored, expected) and "Exchange" not in plan(stored)


# ---- writes that count once --------------------------------------------------------------------


def test_scores_written_twice_are_there_once(spark, folder):
    scores = Inputs(spark, FOLDER).ml_scores.drop("scored_at")
    for _ in range(2):
        tables.write_scored(scores, folder, "2024-03-01 00:00:00", run="first")
    tables.write_scored(scores.limit(3), folder, "2024-03-02 00:00:00", run="second")
    assert tables.ml_scores(spark, folder).count() == scores.count() + 3
    assert manifest.load(spark, folder).tokens == ("run=first", "run=second")


def test_a_run_killed_between_chunks_and_repeated(spark, folder, monkeypatch):
    chunks = [spark.range(10 * i, 10 * i + 10).withColumn("x", F.lit(i)) for i in range(4)]

    def load(die_at=None):
        for i, chunk in enumerate(chunks):
            with monkeypatch.context() as patch:
                if i == die_at:
                    patch.setattr(manifest, "commit_part", lambda *_: (_ for _ in ()).throw(OSError("killed")))
                tables.append_once(chunk, folder, f"batch1/items/part1.csv/{i}")

    with pytest.raises(OSError):
        load(die_at=2)
    rows = lambda: sorted(r.id for r in tables.stored_rows(spark, folder, chunks[0].schema).collect())
    assert rows() == list(range(20))
    load()
    load()
    assert rows() == list(range(40))


def test_additions_by_two_jobs_are_both_kept(spark, folder):
    for name in ("a", "b"):
        spark.range(3).write.parquet(f"{folder}/_parts/part={name}")
    real, calls = manifest.commit, []

    def raced(spark, path, old, new):
        calls.append(1)
        if len(calls) == 1:
            real(spark, path, old, manifest.Manifest().with_folder("part=b", ["all"]))
        return real(spark, path, old, new)

    manifest.commit = raced
    try:
        assert manifest.commit_part(spark, folder, "part=a", "t")
    finally:
        manifest.commit = real
    assert len(calls) == 2 and manifest.load(spark, folder).folders["all"] == ["part=b", "part=a"]


# ---- thinning by event time --------------------------------------------------------------------


def thinned(spark, folder, pieces: list[DataFrame], delay: str, **options) -> DataFrame:
    """All rows of a stream that takes the pieces one by one, and a last row of a far future that lets the watermark pass all others."""
    for i, piece in enumerate(pieces):
        piece.coalesce(1).write.mode("append").parquet(f"{folder}/in")
        for f in os.listdir(f"{folder}/in"):  # files are taken in the order of their time
            if f.endswith(".parquet") and not os.path.exists(f"{folder}/seen-{f}"):
                os.utime(f"{folder}/in/{f}", (1_600_000_000 + i,) * 2)
                open(f"{folder}/seen-{f}", "w").close()
    schema = pieces[0].schema
    end = spark.createDataFrame([("end", "end", "end", datetime(2031, 1, 1))], schema)
    end.coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    out = stateful.throttle_by_event_time(stream, delay, **options)
    run = out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/cp")
    run.trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/out").where("session_id <> 'end'")


def moves(spark) -> DataFrame:
    return Inputs(spark, FOLDER).moves


def test_thinning_of_shuffled_rows_equals_the_batch_operator(spark, folder):
    rows = moves(spark)
    ms = F.unix_millis("event_time") - F.unix_millis(F.lit(datetime(2024, 1, 1)))
    # Rows come up to eight seconds late, so neighbours arrive in different batches and in any order.
    placed = rows.withColumn("piece", F.floor((ms + F.pmod(F.xxhash64("event_id"), F.lit(8000))) / 5000))
    last = placed.agg(F.max("piece")).first()[0]
    pieces = [placed.where(F.col("piece") == i).drop("piece").orderBy(F.rand(1)) for i in range(last + 1)]
    got = thinned(spark, folder, pieces, "9 seconds")
    assert got.where("late").isEmpty()
    assert same(got.drop("late"), thinning.throttle(rows))


def test_late_rows_go_to_the_side(spark, folder):
    start = datetime(2024, 1, 1)

    def rows(*seconds):
        return spark.createDataFrame([(f"e{s}", "s", "u", start + timedelta(seconds=s)) for s in seconds], moves(spark).schema)

    got = thinned(spark, folder, [rows(0, 0.05, 60), rows(61, 30.5, 58), rows(62, 20, 61.05)], "5 seconds")
    assert {r.event_id for r in got.where("late").collect()} == {"e30.5", "e20"}
    assert {r.event_id for r in got.where("not late").collect()} == {"e0", "e58", "e60", "e61", "e62"}
