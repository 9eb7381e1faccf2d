"""Session scores from a gradient-boosted model: train, evaluate, score."""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from datetime import datetime

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from behavior_spark import schemas
from behavior_spark.operators import scoring
from behavior_spark.operators.features import by_source
from behavior_spark.operators.ranking import hash_rank, score_steps
from behavior_spark.operators.running import Running, running
from behavior_spark.session import checkpoint_dir, materialized
from behavior_spark.sources.tables import stamped, write_scored

# The model's input columns.
FEATURES = (
    "product_views",
    "add_to_cart_count",
    "distinct_products_viewed",
    "max_scroll_pct",
    "search_count",
    "session_duration_seconds",
)
KEYS = ("source", "anonymous_user_id", "session_id")
MODEL_VERSION = "gbt_v1"

# Trees take no NULL: a missing scroll depth becomes -1 and sets its own flag.
INPUTS = ("scroll_known", "scroll_missing", *[f for f in FEATURES if f != "max_scroll_pct"])
_PREPARE = (
    "SELECT *, CAST(coalesce(max_scroll_pct, -1) AS DOUBLE) AS scroll_known, "
    "CAST(max_scroll_pct IS NULL AS DOUBLE) AS scroll_missing FROM __THIS__"
)


@dataclass(frozen=True)
class TrainParams:
    """Model size; a tree of depth 6 has up to 64 leaves.

    Few trees with large steps: MLlib grows them one after another, each in some passes over all training rows, so on a large
    table time follows their number. The default is what every named query and ``train`` use.
    """

    trees: int = 20
    learning_rate: float = 0.3
    depth: int = 6
    min_rows: int = 20
    seed: int = 42


def label(features: DataFrame) -> DataFrame:
    """Dataset sessions with ``converted``: 1 if the session holds a purchase."""
    return by_source(features, schemas.SOURCE_DATASET).withColumn(
        "converted", (F.col("purchase_count") > 0).cast("int")
    )


def class_balance(labelled: DataFrame) -> DataFrame:
    """Sessions, conversions, conversion rate in percent and the weight of a positive row."""
    positives = F.count_if(F.col("converted") == 1)
    negatives = F.count_if(F.col("converted") == 0)
    return labelled.agg(
        F.count(F.lit(1)).alias("sessions"),
        positives.alias("conversions"),
        F.try_divide(positives * F.lit(100.0), F.count(F.lit(1))).alias("conversion_pct"),
        F.try_divide(negatives.cast("double"), positives.cast("double")).alias("scale_pos_weight"),
    )


def describe(features: DataFrame) -> DataFrame:
    """Per input of the model: count, mean, sample deviation, extremes and exact quartiles (between neighbours in proportion).

    Equal values are one row with a count. Running counts over these rows, in slices of the order, say which value a rank falls on.
    """
    pairs = ", ".join(f"'{name}', CAST({name} AS DOUBLE)" for name in FEATURES)
    long = features.selectExpr(f"stack({len(FEATURES)}, {pairs}) AS (feature, value)").where("value IS NOT NULL")
    counts = long.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))
    value = F.col("value")
    overall = long.groupBy("feature").agg(
        F.count(F.lit(1)).alias("count"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max")
    )
    placed = running(counts, ["feature"], ["value"], [Running("below", "sum", "n", before=True)])
    placed = placed.withColumn("below", F.coalesce("below", F.lit(0))).join(overall, "feature")

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("below") <= rank) & (rank < F.col("below") + F.col("n")), value))

    def quartile(share: float) -> Column:
        place = (F.col("count") - 1) * F.lit(share)
        low = at(F.floor(place))
        return low + F.max(place - F.floor(place)) * (at(F.ceil(place)) - low)

    found = placed.groupBy("feature").agg(*[quartile(q).alias(name) for q, name in ((0.25, "q25"), (0.5, "q50"), (0.75, "q75"))])
    return overall.join(found, "feature").select("feature", "count", "mean", "std", "min", "q25", "q50", "q75", "max")


def stratified_split(
    labelled: DataFrame, test_share: float = 0.2, seed: int = 42, keys: Sequence[str] = KEYS
) -> tuple[DataFrame, DataFrame]:
    """Train and test frames with the same share of every label; a rerun gives the same rows.

    The ranked rows are written once, as training reads them many times.
    """
    ranked = materialized(hash_rank(labelled, ["converted"], keys, seed))
    in_test = F.col("hash_rank") <= F.round(F.col("group_rows") * F.lit(test_share))
    columns = labelled.columns
    return ranked.where(~in_test).select(*columns), ranked.where(in_test).select(*columns)


def assemble(features: DataFrame) -> DataFrame:
    """Add the model's input vector as ``features``."""
    prepared = SQLTransformer(statement=_PREPARE).transform(features)
    return VectorAssembler(inputCols=list(INPUTS), outputCol="features").transform(prepared)


def _pipeline(params: TrainParams) -> Pipeline:
    return Pipeline(
        stages=[
            SQLTransformer(statement=_PREPARE),
            VectorAssembler(inputCols=list(INPUTS), outputCol="features"),
            GBTClassifier(
                labelCol="converted",
                featuresCol="features",
                weightCol="_weight",
                maxIter=params.trees,
                stepSize=params.learning_rate,
                maxDepth=params.depth,
                minInstancesPerNode=params.min_rows,
                seed=params.seed,
                checkpointInterval=10,
            ),
        ]
    )


def _weighted(train_rows: DataFrame) -> DataFrame:
    weight = class_balance(train_rows).first()["scale_pos_weight"]
    if not weight:
        raise ValueError("training needs sessions of both labels")
    return train_rows.withColumn("_weight", F.when(F.col("converted") == 1, F.lit(weight)).otherwise(F.lit(1.0)))


def train(train_rows: DataFrame, params: TrainParams = TrainParams()) -> PipelineModel:
    """Fit the classifier; positives weigh as much as negatives in total.

    Long chains of boosting steps are cut by checkpoints in the shared work folder.
    """
    checkpoint_dir(train_rows.sparkSession)
    return _pipeline(params).fit(_weighted(train_rows))


def cross_validate(
    train_rows: DataFrame,
    params: TrainParams = TrainParams(),
    folds: int = 5,
    parallelism: int = 1,
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """Mean and spread of the ROC-AUC over stratified folds, ``parallelism`` of them at a time.

    One model per fold and none over all rows, which MLlib's ``CrossValidator`` would add as the one to use.
    """
    spark = train_rows.sparkSession
    checkpoint_dir(spark)
    ranked = materialized(hash_rank(_weighted(train_rows), ["converted"], keys, params.seed))
    folded = ranked.withColumn("_fold", F.pmod(F.col("hash_rank"), F.lit(folds)).cast("int"))
    evaluator = BinaryClassificationEvaluator(labelCol="converted", rawPredictionCol="probability", numBins=0)

    def area(fold: int) -> float:
        inside, outside = folded.where(F.col("_fold") == fold), folded.where(F.col("_fold") != fold)
        if inside.isEmpty() or outside.isEmpty():
            raise ValueError(f"fold {fold} leaves no rows to train on or to test")
        return evaluator.evaluate(_pipeline(params).fit(outside).transform(inside))

    with ThreadPoolExecutor(parallelism) as pool:
        areas = list(pool.map(inheritable_thread_target(spark)(area), range(folds)))
    return spark.createDataFrame(
        [(folds, float(np.mean(areas)), float(np.std(areas)))],
        "folds INT, mean_roc_auc DOUBLE, std_roc_auc DOUBLE",
    )


def predict(features: DataFrame, model: PipelineModel) -> DataFrame:
    """Add ``ml_lead_score``, the probability of a purchase (the score table's writer cuts it to 32 bits)."""
    columns = features.columns
    probability = vector_to_array("probability")[1]
    return model.transform(features).select(*columns, probability.alias("ml_lead_score"))


def ml_tier(score_0_100: Column) -> Column:
    """The rule tiers applied to a model score in percent."""
    return scoring.tier(score_0_100)


def score_batch(
    features: DataFrame,
    model: PipelineModel,
    source: str = "all",
    path: str | None = None,
    model_version: str = MODEL_VERSION,
    now: Column | datetime | str | None = None,
    dry_run: bool = False,
) -> DataFrame:
    """Score the sessions of a source and append them to the score table at ``path``.

    ``dry_run`` prints ten rows and the number of rows and writes nothing. The scores are worked out once and written
    before they are shown, appended or returned.
    """
    scores = materialized(
        predict(by_source(features, source), model)
        .select("session_id", "anonymous_user_id", "source", F.col("ml_lead_score").cast("float").alias("ml_lead_score"))
        .withColumn("model_version", F.lit(model_version))
    )
    if dry_run:
        scores.select("session_id", "source", "ml_lead_score").show(10, truncate=False)
        print(f"{scores.count()} rows would be written")
    elif path:
        write_scored(scores, path, now)
    return stamped(scores, "scored_at", now)


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def importances(model: PipelineModel) -> DataFrame:
    """Impurity gain per input, largest first; the scroll value and its flag count together."""
    values = model.stages[-1].featureImportances.toArray()
    gains = dict.fromkeys(FEATURES, 0.0)
    for name, value in zip(INPUTS, values):
        gains["max_scroll_pct" if name.startswith("scroll_") else name] += float(value)
    ordered = sorted(gains.items(), key=lambda item: (-item[1], item[0]))
    return SparkSession.active().createDataFrame(ordered, "feature STRING, importance DOUBLE")


# ---- metrics -------------------------------------------------------------------------------


def _roc_auc_of_steps() -> Column:
    # Each negative is beaten by the positives above it and by half of those beside it.
    negatives = F.col("n") - F.col("pos")
    won = F.sum(negatives * (F.col("pos_above") + F.col("pos") / F.lit(2.0)))
    pairs = F.max("all_pos").cast("double") * (F.max("all_n") - F.max("all_pos")).cast("double")
    return F.try_divide(won, pairs)


def _average_precision_of_steps() -> Column:
    precision = (F.col("pos_above") + F.col("pos")) / (F.col("n_above") + F.col("n"))
    return F.try_divide(F.sum(F.col("pos") * precision), F.max("all_pos").cast("double"))


def roc_auc(rows: DataFrame, score: str = "ml_lead_score", label: str = "converted") -> DataFrame:
    """Area under the ROC curve by ranks, ties counting half; NULL with one label only."""
    return score_steps(rows, score, label).agg(_roc_auc_of_steps().alias("roc_auc"))


def average_precision(rows: DataFrame, score: str = "ml_lead_score", label: str = "converted") -> DataFrame:
    """Precision at every distinct score, weighted by the recall gained there."""
    return score_steps(rows, score, label).agg(_average_precision_of_steps().alias("average_precision"))


def precision_at(
    rows: DataFrame,
    share: float = 0.1,
    score: str = "ml_lead_score",
    label: str = "converted",
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """Share of positives among the top rows; equal scores are taken in the order of a hash.

    The score at which the top ends is found on distinct scores. Only the rows of that one
    score are ranked, over many slices, so even a tie of most rows is no large group.
    """
    return _precision_at(score_steps(rows, score, label), rows, share, score, label, keys)


def _precision_at(
    steps: DataFrame, rows: DataFrame, share: float, score: str, label: str, keys: Sequence[str]
) -> DataFrame:
    top = F.greatest(F.lit(1).cast("bigint"), F.floor(F.col("all_n") * F.lit(share)))
    edge = (
        steps.withColumn("k", top)
        .where((F.col("n_above") < F.col("k")) & (F.col("n_above") + F.col("n") >= F.col("k")))
        .select("score", "pos_above", (F.col("k") - F.col("n_above")).alias("wanted"), "k")
        .first()
    )
    spark = rows.sparkSession
    if edge is None:
        return spark.createDataFrame([(None, None)], "k BIGINT, precision_at_k DOUBLE")
    tied = rows.where(F.col(score).cast("double") == F.lit(edge["score"])).withColumn("_tie", F.lit(1))
    chosen = hash_rank(tied, ["_tie"], keys).where(F.col("hash_rank") <= edge["wanted"])
    found = F.coalesce(F.sum(F.col(label).cast("bigint")), F.lit(0)) + F.lit(edge["pos_above"])
    return chosen.agg(
        F.lit(edge["k"]).cast("bigint").alias("k"), (found / F.lit(float(edge["k"]))).alias("precision_at_k")
    )


def rule_baseline(labelled: DataFrame) -> DataFrame:
    """Add ``rule_score`` without the purchase signal, which would give the label away."""
    hidden = {
        **{c: F.lit(0).cast("bigint") for c in ("page_views", "search_count", "purchase_count")},
        "max_scroll_pct": F.lit(None).cast("float"),
    }
    whole = labelled.select(F.struct(*labelled.columns).alias("_row"), *labelled.columns).withColumns(hidden)
    return whole.select("_row.*", scoring.lead_score().alias("rule_score"))


def compare_with_rules(predicted: DataFrame) -> DataFrame:
    """ROC-AUC of the model, of the rules, and the difference, on the same rows."""
    areas = roc_auc(predicted, "ml_lead_score").withColumn("of", F.lit("model"))
    areas = areas.unionByName(roc_auc(rule_baseline(predicted), "rule_score").withColumn("of", F.lit("rules")))
    return areas.agg(
        F.max(F.when(F.col("of") == "model", F.col("roc_auc"))).alias("model_roc_auc"),
        F.max(F.when(F.col("of") == "rules", F.col("roc_auc"))).alias("rule_roc_auc"),
    ).withColumn("delta", F.col("model_roc_auc") - F.col("rule_roc_auc"))


def evaluate(predicted: DataFrame, share: float = 0.1) -> dict[str, float]:
    """The three test metrics as plain numbers."""
    steps = score_steps(predicted, "ml_lead_score", "converted")
    areas = steps.agg(
        _roc_auc_of_steps().alias("roc_auc"), _average_precision_of_steps().alias("average_precision")
    ).first()
    top = _precision_at(steps, predicted, share, "ml_lead_score", "converted", KEYS).first()
    return {**areas.asDict(), **top.asDict()}
