"""Splits, metrics and the model on synthetic sessions."""

import random

import pytest
from pyspark.sql import functions as F

from behavior_spark import features, ml
from behavior_spark.operators.ranking import hash_rank

SMALL = ml.TrainParams(trees=8, depth=4)


def scored_rows(spark, rows):
    return spark.createDataFrame(
        [("live", "u", f"s{i}", float(s), y) for i, (s, y) in enumerate(rows)],
        "source STRING, anonymous_user_id STRING, session_id STRING, ml_lead_score DOUBLE, converted INT",
    )


def brute_auc(rows):
    pos, neg = [s for s, y in rows if y], [s for s, y in rows if not y]
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


def brute_ap(rows):
    total, area = sum(y for _, y in rows), 0.0
    for score in {s for s, _ in rows}:
        above = [y for s, y in rows if s >= score]
        area += sum(y for s, y in rows if s == score) / total * sum(above) / len(above)
    return area


@pytest.mark.parametrize("distinct", [1, 2, 7, 5000])
def test_metrics_equal_brute_force(spark, distinct):
    rng = random.Random(distinct)
    rows = [(rng.randrange(distinct) / distinct, int(rng.random() < 0.2)) for _ in range(400)]
    df = scored_rows(spark, rows)
    assert ml.roc_auc(df).first()[0] == pytest.approx(brute_auc(rows), abs=1e-12)
    assert ml.average_precision(df).first()[0] == pytest.approx(brute_ap(rows), abs=1e-12)
    top = ml.precision_at(df, 0.1).first()
    ordered = sorted(rows, reverse=True)
    edge = ordered[39][0]
    sure = sum(y for s, y in rows if s > edge)
    tied = sum(y for s, y in rows if s == edge)
    assert top.k == 40 and sure <= top.precision_at_k * 40 <= sure + tied


def test_metrics_with_one_label(spark):
    assert ml.roc_auc(scored_rows(spark, [(0.1, 0), (0.4, 0)])).first()[0] is None


def test_hash_rank_is_a_whole_order(spark):
    df = spark.range(5000).selectExpr("CAST(id % 10 = 0 AS INT) AS g", "id AS k")
    ranked = hash_rank(df, ["g"], ["k"], 42)
    for row in ranked.groupBy("g").agg(F.count("*").alias("n"), F.min("hash_rank").alias("lo"), F.max("hash_rank").alias("hi"), F.count_distinct("hash_rank").alias("d"), F.max("group_rows").alias("r")).collect():
        assert row.lo == 1 and row.hi == row.n == row.d == row.r
    assert ranked.orderBy("k").select("hash_rank").collect() == hash_rank(df, ["g"], ["k"], 42).orderBy("k").select("hash_rank").collect()


@pytest.fixture(scope="module")
def sessions(spark):
    """Sessions with a cart buy far more often."""
    rng = random.Random(1)
    rows = []
    for i in range(1500):
        carts = int(rng.random() < 0.3)
        bought = int(rng.random() < (0.5 if carts else 0.02))
        rows.append((f"s{i}", "u", 0, rng.randrange(1, 9), carts, bought, 0, None, rng.randrange(900), rng.randrange(1, 6), 0, "retailrocket"))
    names = ["session_id", "anonymous_user_id", "page_views", "product_views", "add_to_cart_count", "purchase_count", "search_count",
             "max_scroll_pct", "session_duration_seconds", "distinct_products_viewed", "cart_abandoned", "source"]
    schema = ", ".join(f"{n} {'STRING' if n in ('session_id', 'anonymous_user_id', 'source') else 'FLOAT' if n == 'max_scroll_pct' else 'INT'}" for n in names)
    return features.conform(spark.createDataFrame(rows, schema))


def test_split_keeps_shares(sessions):
    labelled = ml.label(sessions)
    train, test = ml.stratified_split(labelled)
    for value in (0, 1):
        total = labelled.where(f"converted = {value}").count()
        assert test.where(f"converted = {value}").count() == round(total * 0.2)
    assert train.join(test, "session_id").count() == 0
    assert train.count() + test.count() == 1500


def test_model_beats_chance_and_survives_saving(spark, sessions, folder):
    train, test = ml.stratified_split(ml.label(sessions))
    model = ml.train(train, SMALL)
    predicted = ml.predict(test, model)
    result = ml.evaluate(predicted)
    assert result["roc_auc"] > 0.75 and result["k"] == 30
    compared = ml.compare_with_rules(predicted).first()
    assert compared.model_roc_auc == pytest.approx(result["roc_auc"])
    assert ml.importances(model).first().feature == "add_to_cart_count"
    ml.save_model(model, f"{folder}/model")
    again = ml.predict(test, ml.load_model(f"{folder}/model"))
    assert sorted(map(str, again.collect())) == sorted(map(str, predicted.collect()))

    path = f"{folder}/scores"
    ml.score_batch(sessions, model, source="retailrocket", path=path, now="2024-03-01 00:00:00")
    ml.score_batch(sessions, model, source="live", path=path)
    ml.score_batch(sessions, model, path=path, dry_run=True)
    assert spark.read.parquet(path).count() == 1500
    with pytest.raises(ValueError):
        ml.score_batch(sessions, model, source="elsewhere")


def test_cross_validation(sessions):
    row = ml.cross_validate(ml.label(sessions), ml.TrainParams(trees=2, depth=2), folds=3).first()
    assert row.mean_roc_auc > 0.7 and row.std_roc_auc < 0.2


def test_cross_validation_fits_one_model_per_fold(sessions, monkeypatch):
    fits, fit = [], ml.Pipeline._fit
    monkeypatch.setattr(ml.Pipeline, "_fit", lambda self, rows: fits.append(1) or fit(self, rows))
    alone, together = (ml.cross_validate(ml.label(sessions), ml.TrainParams(trees=2, depth=2), folds=3, parallelism=n).first() for n in (1, 3))
    assert len(fits) == 6
    assert alone.mean_roc_auc == pytest.approx(together.mean_roc_auc) and alone.std_roc_auc == pytest.approx(together.std_roc_auc)
    with pytest.raises(ValueError):
        ml.cross_validate(ml.label(sessions), ml.TrainParams(trees=2, depth=2), folds=1)


def test_training_needs_both_labels(sessions):
    with pytest.raises(ValueError):
        ml.train(ml.label(sessions).where("converted = 0"), SMALL)


def test_class_balance(sessions):
    labelled = ml.label(sessions)
    row = ml.class_balance(labelled).first()
    assert row.sessions == 1500
    assert row.scale_pos_weight == pytest.approx((1500 - row.conversions) / row.conversions)
