import math
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from behavior_spark.llm import mixing as M
from tests.llm.helpers import awkward, frame

MIX = M.Mix()


def water(sizes: dict, total: float) -> dict:
    """Targets by filling up step by step."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, open_, left = {}, set(names), total
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * level > 2 * sizes[s]}
        if not over:
            target |= {s: weight[s] * level for s in open_}
            break
        target |= {s: 2.0 * sizes[s] for s in over}
        left -= sum(2 * sizes[s] for s in over)
        open_ -= over
    return target


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


@pytest.mark.parametrize("given", ["awkward", "sf0.001"])
def test_targets_and_takes(spark, given):
    if given == "awkward":
        docs, rows = frame(spark), [(r[0], r[1], r[3]) for r in awkward()]
    else:
        docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
        rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    sizes = defaultdict(int)
    for _, text, source in rows:
        sizes[source] += words(text)
    want = water(sizes, 1.5 * sum(sizes.values()))
    got = M.taken(docs).collect()
    assert len(got) == len(rows)
    taken = defaultdict(int)
    for r in got:
        assert r.source_size == sizes[r.source]
        assert math.isclose(r.target, want[r.source], rel_tol=1e-9)
        assert 0 <= r.taken <= 2 * r["size"]
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)
    again = M.taken(docs).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_inverse_of_the_schedule(spark):
    for schedule in MIX.schedules:
        whole = M.integral(schedule)
        rows = spark.range(0, 101).select((F.col("id") / 100).alias("share")).withColumn("t", M.due(schedule, F.col("share"))).collect()
        for r in rows:
            until = 0.0
            for (t0, w0), (t1, w1) in zip(schedule, schedule[1:]):
                x = min(max(r.t - t0, 0), t1 - t0)
                until += w0 * x + (w1 - w0) / (t1 - t0) * x * x / 2
            assert math.isclose(until / whole, r.share, abs_tol=1e-9)


def test_curriculum_moves_words_over_time(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    placed = M.pieces(M.taken(docs))
    assert placed.agg(F.sum("words")).first()[0] == M.taken(docs).agg(F.sum("taken")).first()[0]
    early = placed.where("position < 0.5").groupBy().pivot("source", ["src0", "src10"]).agg(F.sum("words")).first()
    late = placed.where("position >= 0.5").groupBy().pivot("source", ["src0", "src10"]).agg(F.sum("words")).first()
    assert early["src0"] > late["src0"] and early["src10"] < late["src10"]


def test_documents_of_the_mix(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    mixed = M.mixed_documents(docs)
    assert mixed.columns == docs.columns
    size = {r.source: r.target for r in M.taken(docs).collect()}
    longest = max(words(r.text) for r in docs.collect())
    got = defaultdict(int)
    for r in mixed.collect():
        got[r.source] += words(r.text)
    assert all(abs(got[s] - t) <= longest / 2 + 1 for s, t in size.items())
    awkward_mix = M.mixed_documents(frame(spark))
    assert awkward_mix.columns == frame(spark).columns and awkward_mix.where("text is null").count() == 0


def test_empty_table(spark):
    assert M.taken(frame(spark, [])).count() == 0
    assert M.mixed_documents(frame(spark, [])).count() == 0
    only_empty = [r for r in awkward() if r[0] in (4, 5, 6)]
    assert [r.taken for r in M.taken(frame(spark, only_empty)).collect()] == [0, 0, 0]


def test_repeated_rows_take_no_more_than_is_due(spark):
    rows = [(1, "same words here", "a")] * 3 + [(2, "other words that differ", "b"), (2, "other words that differ", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    due = M.pieces(M.taken(docs)).where("words * 2 >= size").groupBy("doc_id").count().collect()
    got = M.mixed_documents(docs).groupBy("doc_id").count().collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, due))
