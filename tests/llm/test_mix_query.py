import math

import pytest

from behavior_spark.llm import mixing as M
from behavior_spark.llm.queries import QUERIES
from tests.llm.helpers import awkward, frame

FOLDER = "/root/testdata/sf0.001"


def passed(schedule, t):
    """The share of the schedule's integral that has passed at a time."""
    done = 0.0
    for (t0, w0), (t1, w1) in zip(schedule, schedule[1:]):
        x = min(max(t - t0, 0), t1 - t0)
        done += w0 * x + (w1 - w0) / (t1 - t0) * x * x / 2
    return done / M.integral(schedule)


def test_query_deals_documents_in_training_order(spark):
    rows = QUERIES["op1_mix_curriculum"](spark, FOLDER).collect()
    sources = sorted({r.source for r in rows})
    starts = []
    for r in rows:
        if not r.taken:
            assert r.first_position is None and r.first_rank is None
            continue
        schedule = M.Mix().schedules[sources.index(r.source) % 3]
        times = [r.first_position, r.last_position]
        passes = math.ceil(r.taken / r["size"])
        for t, n in zip(times, (0, passes - 1)):
            assert math.isclose(passed(schedule, t), (n * r.source_size + r.offset) / r.target, abs_tol=1e-9)
        starts.append((r.first_position, r.first_rank))
    assert [x for _, x in sorted(starts)] == sorted(x for _, x in starts)
    assert len({x for _, x in starts}) == len(starts)
    want = {r.doc_id: r.taken for r in M.taken(spark.read.parquet(f"{FOLDER}/documents.parquet")).collect()}
    assert {r.doc_id: r.taken for r in rows} == want


def test_schedules_of_one_integral_give_other_rows(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    even = M.Mix(schedules=tuple(((0.0, w), (1.0, w)) for w in (5.0, 2.0, 1.0)))
    got, other = ({r.doc_id: r.first_position for r in M.scheduled(docs, m).collect()} for m in (M.Mix(), even))
    assert got != other


@pytest.mark.parametrize("rows", [None, []])
def test_awkward_and_empty_tables(spark, rows):
    got = M.scheduled(frame(spark, rows))
    want = M.taken(frame(spark, rows))
    columns = ["doc_id", "digest", "source", "offset", "taken"]
    assert sorted(map(str, got.select(columns).collect())) == sorted(map(str, want.select(columns).collect()))
    assert got.count() == len(awkward() if rows is None else rows)
