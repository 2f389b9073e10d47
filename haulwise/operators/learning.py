"""Model training and evaluation with MLlib over graph-aggregated features."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import columns as fx
from ..plans.windows import latest_per_key
from ..session import cut


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Weight per class: total / (2 * class size)."""
    total = df.agg(F.count("*").alias("n")).scalar()
    return df.groupBy(label).agg(F.count("*").alias("n")).withColumn(
        "weight", fx.r6(total / (2.0 * F.col("n"))))


def _weighted(df: DataFrame, label: str) -> DataFrame:
    s = df.agg(F.struct(F.count("*").alias("n"), F.sum(label).alias("p")).alias("s")).scalar()
    w = F.when(F.col(label) == 1, s["n"] / (2.0 * F.greatest(s["p"], F.lit(1)))).otherwise(
        s["n"] / (2.0 * F.greatest(s["n"] - s["p"], F.lit(1))))
    return df.withColumn("_weight", w)


def train_classifier(train: DataFrame, features: Sequence[str], label: str, reg: float = 0.01,
                     elastic: float = 0.0, iterations: int = 20):
    """Class-weighted logistic regression; returns (assembler, model).

    The training frame should be materialised: the optimiser reads it repeatedly.
    """
    assembler = VectorAssembler(inputCols=list(features), outputCol="_x")
    lr = LogisticRegression(featuresCol="_x", labelCol=label, weightCol="_weight", regParam=reg,
                            elasticNetParam=elastic, maxIter=iterations)
    return assembler, lr.fit(assembler.transform(_weighted(train, label)))


def batch_score(fitted, df: DataFrame) -> DataFrame:
    """Probability per row from a fitted model; nothing is retrained."""
    assembler, model = fitted
    out = model.transform(assembler.transform(df))
    return out.withColumn("p", F.round(vector_to_array("probability")[1], 4)).drop(
        "_x", "rawPrediction", "probability", "prediction")


def roc_auc(scored: DataFrame, p: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """Rank-sum AUC per group.

    Scores are four-digit decimals, so the rows collapse to at most 10,001
    distinct scores per group before anything is ordered.
    """
    by = list(by)
    hist = scored.groupBy(*by, F.round(p, 4).alias("_p")).agg(
        F.sum(label).alias("_pos"), F.sum(1 - F.col(label)).alias("_neg"))
    w = W.partitionBy(*by).orderBy("_p").rowsBetween(W.unboundedPreceding, -1)
    ranked = hist.withColumn("_below", F.coalesce(F.sum("_neg").over(w), F.lit(0)))
    wins = F.sum(F.col("_pos") * (F.col("_below") + F.col("_neg") / 2.0))
    return ranked.groupBy(*by).agg(
        F.sum("_pos").cast("bigint").alias("n_positive"), F.sum("_neg").cast("bigint").alias("n_negative"),
        fx.r6(F.try_divide(wins, F.nullif(F.sum("_pos") * F.sum("_neg"), F.lit(0)))).alias("auc"))


def precision_recall_f1(scored: DataFrame, p: str, label: str, threshold: float) -> DataFrame:
    """Confusion counts and rates at a threshold (inclusive)."""
    hit, pos = F.col(p) >= threshold, F.col(label) == 1
    c = scored.agg(F.count_if(hit & pos).alias("tp"), F.count_if(hit & ~pos).alias("fp"),
                   F.count_if(~hit & pos).alias("fn"), F.count_if(~hit & ~pos).alias("tn"))
    return c.withColumns({
        "precision": fx.r6(F.try_divide("tp", F.nullif(F.col("tp") + F.col("fp"), F.lit(0)))),
        "recall": fx.r6(F.try_divide("tp", F.nullif(F.col("tp") + F.col("fn"), F.lit(0)))),
        "f1": fx.r6(F.try_divide(2 * F.col("tp"), F.nullif(2 * F.col("tp") + F.col("fp") + F.col("fn"), F.lit(0))))})


def regression_metrics(df: DataFrame, predicted: str, actual: str) -> DataFrame:
    """MAE, RMSE and MAPE; rows with actual 0 do not enter MAPE."""
    e = F.col(predicted) - F.col(actual)
    return df.agg(F.count("*").alias("n"), fx.r6(F.avg(F.abs(e))).alias("mae"), fx.r6(F.sqrt(F.avg(e * e))).alias("rmse"),
                  fx.r6(F.avg(F.abs(F.try_divide(e, F.nullif(actual, F.lit(0)))))).alias("mape"))


def calibration_bins(scored: DataFrame, p: str, label: str, bins: int = 10) -> DataFrame:
    """Mean prediction and observed rate per probability bin; counts add up to the input."""
    b = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).cast("int")
    return scored.groupBy(b.alias("bin")).agg(
        F.count("*").alias("n"), fx.r6(F.avg(p)).alias("mean_predicted"), fx.r6(F.avg(label)).alias("observed_rate"))


def long_metrics(wide: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """One row per key and metric."""
    return wide.unpivot([F.col(k) for k in keys], [F.col(c).cast("double").alias(c) for c in metrics], "metric_name", "metric_value")


def compare_architectures(runs: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Latest test metric of each architecture, one column per metric."""
    latest = latest_per_key(runs.filter(F.col("dataset_split") == "test"), ["architecture", "metric_name"],
                            [F.col("evaluated_at").desc(), F.col("run_id").desc()])
    return latest.groupBy("architecture").agg(*[
        F.max(F.when(F.col("metric_name") == n, F.col("metric_value"))).alias(n) for n in metrics])


def active_model(registry: DataFrame) -> DataFrame:
    """The active version; with none or several the state says so."""
    return registry.filter(F.col("status") == "active").agg(
        F.count("*").alias("n_active"), F.min("model_version").alias("model_version")).withColumn(
        "state", F.when(F.col("n_active") == 1, "ok").when(F.col("n_active") == 0, "none active").otherwise("several active")
    ).withColumn("model_version", F.when(F.col("n_active") == 1, F.col("model_version")))


def label_support(df: DataFrame, split: str, label: str, minimum: int = 10) -> DataFrame:
    """Positives per split and a warning where there are too few."""
    return df.groupBy(split).agg(F.count("*").alias("n"), F.sum(label).cast("bigint").alias("n_positive")).withColumn(
        "warning", F.when(F.col("n_positive") == 0, "no positives").when(F.col("n_positive") < minimum, "few positives"))


def ablate(stages: Mapping[str, DataFrame], features: Mapping[str, Sequence[str]], label: str, split: str) -> DataFrame:
    """Train each feature stage with the same split and settings; AUC per stage and split."""
    out = None
    for stage, df in stages.items():
        df = cut(df)
        fitted = train_classifier(df.filter(F.col(split) == "train"), features[stage], label)
        part = roc_auc(batch_score(fitted, df), "p", label, [split]).withColumn("stage", F.lit(stage))
        out = part if out is None else out.unionByName(part)
    return out


def grid_search(df: DataFrame, features: Sequence[str], label: str, split: str,
                grid: Sequence[tuple[float, float]]) -> DataFrame:
    """Validation AUC for every (reg, elastic) setting, trained on the time-ordered train split.

    The setting of the highest one (the first of equals) is marked and scored once on the test split.
    """
    df = cut(df)
    train, valid, test = (df.filter(F.col(split) == part) for part in ("train", "validation", "test"))
    auc = lambda fitted, rows: roc_auc(batch_score(fitted, rows), "p", label).first()["auc"]
    models = [train_classifier(train, features, label, reg, elastic) for reg, elastic in grid]
    found = [auc(fitted, valid) for fitted in models]
    best = max(range(len(grid)), key=lambda i: -1.0 if found[i] is None else found[i])
    rows = [(float(reg), float(elastic), found[i], i == best, auc(models[i], test) if i == best else None)
            for i, (reg, elastic) in enumerate(grid)]
    return df.sparkSession.createDataFrame(rows, "reg double, elastic double, auc double, is_best boolean, test_auc double")
