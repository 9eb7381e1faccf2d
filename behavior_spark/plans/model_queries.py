"""Queries over labels, splits, model scores and metrics."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from behavior_spark.operators import ml
from behavior_spark.plans.oracle import sql
from behavior_spark.plans.registry import query
from behavior_spark.session import new_folder

_KEYS = "source, anonymous_user_id, session_id"


def _labelled(t):
    return ml.label(t.sessions)


@query("label", sql(f"SELECT {_KEYS}, converted FROM labelled"))
def _(t):
    return _labelled(t).select("source", "anonymous_user_id", "session_id", "converted")


@query("class_balance", sql("""
    SELECT count(*) AS sessions, sum(converted)::BIGINT AS conversions, 100.0::DOUBLE * sum(converted) / count(*) AS conversion_pct,
        CAST(count(*) - sum(converted) AS DOUBLE) / sum(converted) AS scale_pos_weight FROM labelled"""))
def _(t):
    return ml.class_balance(_labelled(t))


@query("describe_features", sql(" UNION ALL ".join(
    f"""SELECT '{name}' AS feature, count({name}) AS count, avg(CAST({name} AS DOUBLE)) AS mean, stddev_samp(CAST({name} AS DOUBLE)) AS std,
        CAST(min({name}) AS DOUBLE) AS min, quantile_cont(CAST({name} AS DOUBLE), 0.25) AS q25, quantile_cont(CAST({name} AS DOUBLE), 0.5) AS q50,
        quantile_cont(CAST({name} AS DOUBLE), 0.75) AS q75, CAST(max({name}) AS DOUBLE) AS max FROM all_sessions HAVING count({name}) > 0"""
    for name in ml.FEATURES), all_sessions="SELECT * FROM live UNION ALL BY NAME SELECT * FROM dataset"))
def _(t):
    return ml.describe(t.sessions)


_SPLIT = {
    "ranked": """SELECT *, row_number() OVER (PARTITION BY converted
            ORDER BY md5(concat_ws('|', source, anonymous_user_id, session_id, '42')), source, anonymous_user_id, session_id) AS nth,
        count(*) OVER (PARTITION BY converted) AS label_rows FROM labelled"""
}


@query("stratified_split", sql(
    f"SELECT {_KEYS}, converted, CAST(nth <= round(label_rows * 0.2) AS INT) AS in_test FROM ranked", **_SPLIT
))
def _(t):
    train, test = ml.stratified_split(_labelled(t))
    columns = ["source", "anonymous_user_id", "session_id", "converted"]
    return train.select(*columns, F.lit(0).alias("in_test")).unionByName(
        test.select(*columns, F.lit(1).alias("in_test"))
    )


@query("feature_matrix", sql("""
    SELECT session_id, CAST(coalesce(max_scroll_pct, -1) AS DOUBLE) AS scroll_known, CAST(max_scroll_pct IS NULL AS DOUBLE) AS scroll_missing,
        CAST(product_views AS DOUBLE) AS product_views, CAST(add_to_cart_count AS DOUBLE) AS add_to_cart_count,
        CAST(distinct_products_viewed AS DOUBLE) AS distinct_products_viewed, CAST(search_count AS DOUBLE) AS search_count,
        CAST(session_duration_seconds AS DOUBLE) AS session_duration_seconds FROM all_sessions""",
    all_sessions="SELECT * FROM live UNION ALL BY NAME SELECT * FROM dataset"))
def _(t):
    values = vector_to_array(F.col("features"))
    return ml.assemble(t.sessions).select(
        "session_id", *[values[i].alias(name) for i, name in enumerate(ml.INPUTS)]
    )


_STEPS = """SELECT rule_score AS score, sum(converted) AS pos, count(*) AS n, sum(count(*)) OVER up AS n_upto,
    sum(sum(converted)) OVER up AS pos_upto FROM blind GROUP BY rule_score WINDOW up AS (ORDER BY rule_score DESC)"""


@query("rule_roc_auc", sql("""
    SELECT (sum(place) FILTER (WHERE converted = 1) - sum(converted) * (sum(converted) + 1) / 2.0::DOUBLE)
        / (CAST(sum(converted) AS DOUBLE) * (count(*) - sum(converted))) AS roc_auc
    FROM (SELECT converted, rank() OVER (ORDER BY rule_score) + (count(*) OVER (PARTITION BY rule_score) - 1) / 2.0::DOUBLE AS place
        FROM blind)"""))
def _(t):
    return ml.roc_auc(ml.rule_baseline(_labelled(t)), "rule_score").select(F.round("roc_auc", 12).alias("roc_auc"))


@query("rule_average_precision", sql("""
    SELECT sum(CAST(pos AS DOUBLE) / (SELECT sum(converted) FROM blind) * pos_upto / n_upto) AS average_precision FROM steps""",
    steps=_STEPS))
def _(t):
    return ml.average_precision(ml.rule_baseline(_labelled(t)), "rule_score")


@query("rule_precision_at_top", sql("""
    SELECT k, avg(CAST(converted AS DOUBLE)) AS precision_at_k FROM (
        SELECT converted, greatest(1, CAST(floor(count(*) OVER () * 0.1) AS BIGINT)) AS k, row_number() OVER (ORDER BY rule_score DESC,
            md5(concat_ws('|', source, anonymous_user_id, session_id, '')), source, anonymous_user_id, session_id) AS place
        FROM blind) WHERE place <= k GROUP BY k"""))
def _(t):
    return ml.precision_at(ml.rule_baseline(_labelled(t)), 0.1, "rule_score")


# The repeatable scores of the fixtures stand in for a model's.
@query("score_roc_auc", sql("""
    SELECT (sum(place) FILTER (WHERE converted = 1) - sum(converted) * (sum(converted) + 1) / 2.0::DOUBLE)
        / (CAST(sum(converted) AS DOUBLE) * (count(*) - sum(converted))) AS roc_auc
    FROM (SELECT converted, rank() OVER (ORDER BY ml_lead_score) + (count(*) OVER (PARTITION BY ml_lead_score) - 1) / 2.0::DOUBLE AS place
        FROM labelled JOIN ml_latest USING (source, anonymous_user_id, session_id))"""))
def _(t):
    return ml.roc_auc(_with_scores(t)).select(F.round("roc_auc", 12).alias("roc_auc"))


def _with_scores(t):
    from behavior_spark.sources.tables import ml_scores_latest

    scores = ml_scores_latest(t.ml_scores).select(*ml.KEYS, "ml_lead_score")
    return _labelled(t).join(scores, list(ml.KEYS))


@query("compare_with_rules", sql(
    """SELECT a.auc AS model_roc_auc, b.auc AS rule_roc_auc, a.auc - b.auc AS delta FROM by_model a CROSS JOIN by_rules b""",
    joined="SELECT blind.*, ml_lead_score FROM blind JOIN ml_latest USING (source, anonymous_user_id, session_id)",
    **{
        name: f"""SELECT (sum(place) FILTER (WHERE converted = 1) - sum(converted) * (sum(converted) + 1) / 2.0::DOUBLE)
            / (CAST(sum(converted) AS DOUBLE) * (count(*) - sum(converted))) AS auc
            FROM (SELECT converted, rank() OVER (ORDER BY {score}) + (count(*) OVER (PARTITION BY {score}) - 1) / 2.0::DOUBLE AS place
            FROM joined)"""
        for name, score in (("by_model", "ml_lead_score"), ("by_rules", "rule_score"))
    },
))
def _(t):
    return ml.compare_with_rules(_with_scores(t))


def _model(t):
    train, test = ml.stratified_split(_labelled(t))
    return ml.train(train), test


@query("predict", sql(f"SELECT {_KEYS}, converted, 1 AS in_range FROM ranked WHERE nth <= round(label_rows * 0.2)", **_SPLIT))
def _(t):
    model, test = _model(t)
    in_range = F.col("ml_lead_score").between(0, 1).cast("int").alias("in_range")
    return ml.predict(test, model).select(*ml.KEYS, "converted", in_range)


# A model that was saved and loaded gives every test session the same score.
@query("stored_model", sql("SELECT count(*) AS scored, CAST(0 AS BIGINT) AS differing FROM ranked WHERE nth <= round(label_rows * 0.2)", **_SPLIT))
def _(t):
    model, test = _model(t)
    folder = new_folder(t.spark, "model")
    ml.save_model(model, folder)
    again = ml.predict(test, ml.load_model(folder)).select(*ml.KEYS, F.col("ml_lead_score").alias("again"))
    both = ml.predict(test, model).join(again, list(ml.KEYS))
    return both.agg(F.count("*").alias("scored"), F.count_if(~F.col("again").eqNullSafe(F.col("ml_lead_score"))).alias("differing"))


@query("score_batch", sql(f"SELECT {_KEYS}, 'gbt_v1' AS model_version, 1 AS in_range FROM live"))
def _(t):
    model, _test = _model(t)
    scores = ml.score_batch(t.sessions, model, source="live", now="2024-03-01 00:00:00")
    return scores.select(*ml.KEYS, "model_version", F.col("ml_lead_score").between(0, 1).cast("int").alias("in_range"))


@query("feature_importances", sql("SELECT unnest([" + ", ".join(f"'{f}'" for f in ml.FEATURES) + """]) AS feature, 1 AS in_range,
    CAST(1 AS DOUBLE) AS total FROM (SELECT 1 FROM labelled LIMIT 1)"""))
def _(t):
    found = ml.importances(_model(t)[0])
    total = found.agg(F.round(F.sum("importance"), 9).alias("total"))
    return found.select("feature", F.col("importance").between(0, 1).cast("int").alias("in_range")).join(total)


@query("cross_validate", sql("SELECT 5 AS folds, 1 AS in_range, 1 AS spread_known FROM (SELECT 1 FROM labelled LIMIT 1)"))
def _(t):
    found = ml.cross_validate(ml.stratified_split(_labelled(t))[0], folds=5)
    return found.select(
        "folds", F.col("mean_roc_auc").between(0, 1).cast("int").alias("in_range"), (F.col("std_roc_auc") >= 0).cast("int").alias("spread_known")
    )
