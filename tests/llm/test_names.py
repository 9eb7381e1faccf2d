"""Columns of the input that are named like the operators' own."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as C
from behavior_spark.llm import collocations, line_dedup, mixing, periodic_runs, quality_gam, quality_rules, simhash_dedup
from behavior_spark.llm.common import running
from tests.llm.helpers import awkward, frame

NAMES = ["__id", "__digest", "__source", "__part", "__offset", "__ahead", "first", "due", "copy", "deleted_lines", "text_digest", "repeat", "words", "h"]


def with_names(docs):
    return docs.drop("h").withColumns({n: F.lit(i) for i, n in enumerate(NAMES)})


def test_every_stage_takes_clashing_names(spark):
    docs = with_names(frame(spark, awkward()))
    for name, stage in C.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns, name
        assert out.count() <= 2 * docs.count()
    assert C.STAGES[-1][1](spark, docs, "").count() == docs.count()


@pytest.mark.parametrize("part", ["__part", "__offset", "__ahead", "part"])
def test_running_sums_beside_any_name(spark, part):
    rows = spark.range(50).withColumn(part, F.col("id") % 3).withColumn("v", F.lit(2))
    got = {r.id: r.before_v for r in running(rows, [F.col("id")], ["v"], parts=4).collect()}
    assert got == {i: 2 * i for i in range(50)}
    assert part in running(rows, [F.col("id")], ["v"], [part]).columns


def test_new_operators_take_clashing_names(spark):
    docs = with_names(frame(spark, awkward()))
    assert periodic_runs.found(docs).count() == docs.count()
    assert collocations.collocations(docs, collocations.Mining(least=3)).count() > 0
    labels = spark.createDataFrame([(1, 1, 5), (12, 0, 5)], "doc_id long, quality int, words int")
    assert quality_gam.classify(docs, labels).count() == docs.count()
    assert quality_rules.judge(docs, quality_rules.plan(docs)).count() == docs.count()
    assert simhash_dedup.classes(docs).count() == mixing.scheduled(docs).count() == line_dedup.report(docs).count() == docs.count()
