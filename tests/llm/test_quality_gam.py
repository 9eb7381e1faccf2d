from zlib import crc32

import numpy as np
import pytest

from behavior_spark.llm import quality_gam as Q
from behavior_spark.llm.queries import QUERIES
from tests.llm.helpers import awkward, frame

FOLDER = "/root/testdata/sf0.01"


def auc(scores: np.ndarray, labels: np.ndarray) -> float:
    good, bad = scores[labels == 1], scores[labels == 0]
    return float((good[:, None] > bad).mean() + (good[:, None] == bad).mean() / 2)


def test_held_out_documents_are_told_apart(spark):
    rows = {r.doc_id: r for r in QUERIES["op12_quality_gam"](spark, FOLDER).collect()}
    assert len(rows) == spark.read.parquet(f"{FOLDER}/documents.parquet").count()
    for i, r in rows.items():
        assert r.held_out == (crc32(str(i).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
    labels = [(rows[r.doc_id], r.quality) for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect() if rows[r.doc_id].held_out]
    scores, truth = np.array([r.score for r, _ in labels]), np.array([q for _, q in labels])
    assert len(truth) > 50 and auc(scores, truth) > 0.97
    assert np.mean([r.predicted == q for r, q in labels]) > 0.95


def test_labels_of_held_out_rows_do_not_matter(spark):
    docs, labels = spark.read.parquet(f"{FOLDER}/documents.parquet"), spark.read.parquet(f"{FOLDER}/labels.parquet")
    other = labels.withColumn("quality", Q.F.when(Q.held_out("doc_id"), 1 - Q.F.col("quality")).otherwise(Q.F.col("quality")))
    one, two = (sorted(map(tuple, Q.classify(docs, x).collect())) for x in (labels, other))
    assert one == two


def test_pairs_learn_what_single_measures_cannot():
    rnd = np.random.default_rng(3)
    bins = rnd.integers(0, 32, (4, 4000)).astype(np.uint8)
    labels = ((bins[0] < 16) ^ (bins[2] < 8)).astype(float)
    weights = np.ones(4000)
    alone = Q.boosted(bins, labels, weights, Q.Boosting(pairs=0, rounds=20))
    pairs = Q.boosted(bins, labels, weights, Q.Boosting(pairs=1, rounds=20))
    assert set(pairs.double) == {(2, 0)}
    assert auc(alone.log_odds(bins), labels) < 0.8 and auc(pairs.log_odds(bins), labels) > 0.99


def test_trees_equal_brute_force():
    rnd = np.random.default_rng(4)

    def worth(cells):
        return sum(g.sum() ** 2 / (h.sum() + 1.0) for g, h in cells)

    for _ in range(50):
        g, h = rnd.normal(size=9), rnd.random(9)
        cuts = [[slice(0, 9)]] + [[slice(0, c), slice(c, 9)] for c in range(1, 9)]  # no cut at all may be best
        best = max(cuts, key=lambda some: worth([(g[x], h[x]) for x in some]))
        values = Q.tree(g, h, 1.0, 1)
        assert all(np.allclose(values[x], g[x].sum() / (h[x].sum() + 1)) for x in best)
        g, h = rnd.normal(size=(4, 4)), rnd.random((4, 4))
        most = -np.inf
        for a, b in ((g, h), (g.T, h.T)):
            for c in range(1, 4):
                for d in range(1, 4):
                    for e in range(1, 4):
                        parts = [(x[r, s]) for r, k in ((slice(0, c), d), (slice(c, None), e)) for s in (slice(0, k), slice(k, None)) for x in (a, b)]
                        most = max(most, worth(list(zip(parts[::2], parts[1::2], strict=True))))
        gain, values = Q.pair_tree(g, h, 1.0)
        assert gain == pytest.approx(most - worth([(g, h)])) and values.shape == (4, 4)


def test_score_is_the_sum_of_tables():
    model = Q.Model([np.array([1.0, 2.0])] * 2, 0.5, {0: np.arange(32.0), 1: np.zeros(32)}, {(1, 0): np.full((8, 8), 0.25)})
    assert model.log_odds(model.binned([np.array([0.0, 1.0, 5.0]), np.zeros(3)])).tolist() == [0.75, 1.75, 2.75]


def test_weights_stand_for_repeated_rows():
    rnd = np.random.default_rng(5)
    bins, labels = rnd.integers(0, 32, (3, 300)).astype(np.uint8), rnd.integers(0, 2, 300).astype(float)
    weights = rnd.integers(1, 4, 300)
    one = Q.boosted(bins, labels, weights.astype(float), Q.Boosting(rounds=5))
    two = Q.boosted(np.repeat(bins, weights, axis=1), np.repeat(labels, weights), np.ones(weights.sum()), Q.Boosting(rounds=5))
    assert np.allclose(one.log_odds(bins), two.log_odds(bins))


def test_several_bags_are_averaged(spark):
    docs, labels = spark.read.parquet(f"{FOLDER}/documents.parquet"), spark.read.parquet(f"{FOLDER}/labels.parquet")
    rows = Q.written(Q.measures(docs), "measures")
    known = Q.labelled(rows, labels)
    model = Q.train(known, "label", Q.Boosting(bag=100, rounds=30))
    got = Q.scored(rows, model).join(labels, "doc_id").where("held_out").collect()
    assert auc(np.array([r.score for r in got]), np.array([r.quality for r in got])) > 0.95


def test_awkward_rows_and_labels(spark):
    docs = frame(spark, awkward()).withColumnRenamed("kept", "words").withColumnRenamed("h", "held_out").withColumnRenamed("fp", "label")
    labels = spark.createDataFrame([(1, 1), (1, 0), (3, 1), (4, 0), (4, 0), (None, 1), (12, 0), (13, 7), (14, None)], "doc_id long, quality int")
    got = Q.classify(docs, labels).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r[0]) for r in awkward())
    assert all(0 <= r.score <= 1 for r in got) and not any(r.held_out for r in got if r.doc_id is None)
    empty = {r.score for r in got if r.doc_id in (4, 5, 6)}
    assert len(empty) == 1
    assert {r.score for r in Q.classify(docs, labels.where("false")).collect()} == {0.5}
    assert Q.classify(docs.where("false"), labels).count() == 0
    assert {r.score > 0.5 for r in Q.classify(docs, labels.where("quality = 1")).collect()} == {True}


def test_a_very_long_text(spark):
    (row,) = Q.measures(spark.createDataFrame([(1, "some words and a stop. " * 2_000_000)], "doc_id long, text string")).collect()
    assert row.words == pytest.approx(np.log1p(10_000_000))
