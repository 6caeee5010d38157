"""Exact ranking, threshold, regression, classification and calibration metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.ordered import running_totals
from ..functions.quantiles import exact_quantiles
from ..schemas import require
from ..session import written


def score_curve(df: DataFrame, label: str, scores: list[str]) -> DataFrame:
    """Per score column and distinct threshold: hits among rows at or above it.

    Columns `model_key, threshold, pos, neg, tp, fp, positives, negatives`. Rows are first reduced to one per
    distinct score, then running counts are taken over balanced score buckets.
    """
    require(df, [label, *scores], "evaluate scores")
    long = df.select(F.col(label).cast("int").alias("label"), *[F.col(s).cast("double").alias(s) for s in scores])
    long = long.unpivot(["label"], scores, "model_key", "threshold").where("threshold IS NOT NULL AND NOT isnan(threshold)")
    grouped = long.groupBy("model_key", "threshold").agg(
        F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") != 1).alias("neg")
    )
    # read four times below: cut points, bucket sums, rows and totals
    grouped = written(grouped, "score-groups")
    curve = running_totals(grouped, "model_key", "threshold", {"pos": "tp", "neg": "fp"})
    # One row per score column.
    totals = grouped.groupBy("model_key").agg(F.sum("pos").alias("positives"), F.sum("neg").alias("negatives"))
    return curve.join(F.broadcast(totals), "model_key")


def _precision() -> Column:
    return F.col("tp") / (F.col("tp") + F.col("fp"))


def _recall() -> Column:
    return F.col("tp") / F.nullif(F.col("positives"), F.lit(0).cast("long"))


def ranking_metrics(curve: DataFrame) -> DataFrame:
    """`model_key, roc_auc, pr_auc, pr_curve_points`. ROC area with ties at half; PR area as the step sum."""
    above = F.col("tp") - F.col("pos")
    pairs = F.sum(F.col("neg") * (above + F.col("pos") / 2))
    possible = F.first("positives").cast("double") * F.first("negatives")
    step = F.col("pos") / F.nullif(F.col("positives"), F.lit(0).cast("long")) * _precision()
    return curve.groupBy("model_key").agg(
        (pairs / F.nullif(possible, F.lit(0.0))).alias("roc_auc"),
        F.sum(step).alias("pr_auc"),
        (F.count(F.lit(1)) + 1).alias("pr_curve_points"),
    )


def best_first(summary: DataFrame, *order: str) -> DataFrame:
    """Best model first by the named measures, the key deciding between equals."""
    return summary.orderBy(*[F.desc(c) for c in order], "model_key")


def pr_curve(curve: DataFrame) -> DataFrame:
    """Precision/recall per threshold with the closing point (1, 0)."""
    points = curve.select("model_key", "threshold", _precision().alias("precision"), _recall().alias("recall"))
    closing = curve.select("model_key").distinct().select(
        "model_key",
        F.lit(None).cast("double").alias("threshold"),
        F.lit(1.0).alias("precision"),
        F.lit(0.0).alias("recall"),
    )
    return points.unionByName(closing)


def roc_curve(curve: DataFrame) -> DataFrame:
    """False and true positive rate per threshold."""
    return curve.select(
        "model_key",
        "threshold",
        (F.col("fp") / F.nullif(F.col("negatives"), F.lit(0).cast("long"))).alias("fpr"),
        _recall().alias("tpr"),
    )


def best_thresholds(curve: DataFrame) -> DataFrame:
    """Threshold of the best F1 per model (lowest on ties) with its counts and rates."""
    scored = curve.withColumns({"precision": _precision(), "recall": _recall()}).withColumn(
        "f1", 2.0 * F.col("tp") / (F.col("tp") + F.col("fp") + F.col("positives"))
    )
    best = F.max_by(
        F.struct("threshold", "precision", "recall", "f1", "tp", "fp", "positives", "negatives"),
        F.struct("f1", (-F.col("threshold")).alias("low")),
    )
    rows = scored.groupBy("model_key").agg(best.alias("b")).select("model_key", "b.*")
    return rows.select(
        "model_key",
        "threshold",
        "precision",
        "recall",
        "f1",
        (F.col("fp") / F.greatest("negatives", F.lit(1))).alias("false_alarm_rate"),
        "tp",
        "fp",
        (F.col("negatives") - F.col("fp")).alias("tn"),
        (F.col("positives") - F.col("tp")).alias("fn"),
    )


def anomaly_report(df: DataFrame, label: str, scores: list[str]) -> DataFrame:
    """Ranking metrics and best-F1 threshold of every score column present, best F1 first."""
    present = [s for s in scores if s in df.columns]
    if not present:
        raise ValueError("None of the asked score columns is in the table.")
    curve = score_curve(df, label, present)
    ranked = ranking_metrics(curve).drop("pr_curve_points")
    return best_first(ranked.join(best_thresholds(curve), "model_key"), "f1", "pr_auc")


def _errors(target: Column, prediction: Column) -> dict[str, Column]:
    """Error aggregates of one pass; R2 from the variance of the target."""
    error = target - prediction
    total = F.var_pop(target) * F.count(target)
    return {
        "rmse": F.sqrt(F.avg(error * error)),
        "mae": F.avg(F.abs(error)),
        "r2": 1.0 - F.sum(error * error) / F.nullif(total, F.lit(0.0)),
    }


def regression_metrics(df: DataFrame, target: str, prediction: str, by: list[str] | None = None) -> DataFrame:
    y, p = F.col(target).cast("double"), F.col(prediction).cast("double")
    both = df.where(y.isNotNull() & p.isNotNull())
    return both.groupBy(*(by or [])).agg(*[c.alias(n) for n, c in _errors(y, p).items()])


def rul_report(df: DataFrame, target: str = "rul", prediction: str = "prediction") -> DataFrame:
    """Acceptance metrics of remaining-life predictions; fails when every target is zero."""
    require(df, [target, prediction], "evaluate RUL predictions")
    y, p = F.col(target).cast("double"), F.col(prediction).cast("double")
    error = F.abs(y - p)
    nonzero = F.abs(y) > 1e-9
    failed = F.raise_error(F.lit("The percentage error is undefined: every target is zero.")).cast("double")
    mape = F.coalesce(F.avg(F.when(nonzero, error / F.nullif(F.abs(y), F.lit(0.0)))), failed)
    errors = df.select(F.lit("error").alias("feature"), error.alias("value")).where("value IS NOT NULL")
    median = exact_quantiles(errors, [0.5]).select("quantile").scalar()
    row = df.agg(
        F.count(F.lit(1)).alias("row_count"),
        *[c.alias(n) for n, c in _errors(y, p).items()],
        mape.alias("mape"),
        F.avg((error <= 10).cast("double")).alias("within_10_cycles_rate"),
        F.avg((error <= 20).cast("double")).alias("within_20_cycles_rate"),
    )
    return row.withColumn("mape_percent", F.col("mape") * 100.0).withColumn("median_absolute_error", median)


def classification_metrics(df: DataFrame, target: str, probability: str, threshold: float = 0.5) -> DataFrame:
    """Accuracy, precision and recall (0 when undefined); ranking areas only when both classes occur."""
    y, hit = F.col(target).cast("int") == 1, F.col(probability) >= threshold
    tp, predicted, actual = F.count_if(y & hit), F.count_if(hit), F.count_if(y)
    zero = F.lit(0).cast("long")
    row = df.agg(
        F.avg((y == hit).cast("double")).alias("accuracy"),
        F.coalesce(tp / F.nullif(predicted, zero), F.lit(0.0)).alias("precision"),
        F.coalesce(tp / F.nullif(actual, zero), F.lit(0.0)).alias("recall"),
        (F.min(y.cast("int")) < F.max(y.cast("int"))).alias("both"),
    )
    areas = ranking_metrics(score_curve(df, target, [probability])).select(F.struct("roc_auc", "pr_auc")).scalar()
    return row.select(
        "accuracy",
        "precision",
        "recall",
        F.when(F.col("both"), areas["roc_auc"]).alias("roc_auc"),
        F.when(F.col("both"), areas["pr_auc"]).alias("pr_auc"),
    )


def calibration(df: DataFrame, target: str, prediction: str, bins: int = 10) -> DataFrame:
    """Slope and intercept of target on prediction, and the mean gap between the two over quantile bins."""
    rows = df.select(F.col(target).cast("double").alias("y"), F.col(prediction).cast("double").alias("p")).dropna()
    seen = len(rows.limit(max(bins, 2)).collect())
    count = max(2, min(bins, seen))
    long = rows.select(F.lit("p").alias("feature"), F.col("p").alias("value"))
    inner = exact_quantiles(long, [i / count for i in range(count + 1)])
    # At most bins + 1 numbers. Right-closed bins: the number of inner edges below the value.
    edges = sorted({r["quantile"] for r in inner.collect()})
    place = sum((F.col("p") > e).cast("int") for e in edges[1:-1]) if len(edges) > 2 else F.lit(0)
    gaps = rows.withColumn("bin", place).groupBy("bin").agg(F.abs(F.avg("y") - F.avg("p")).alias("gap"))
    enough = F.count(F.lit(1)) >= 2
    return rows.agg(
        F.when(enough, F.regr_slope("y", "p")).alias("calibration_slope"),
        F.when(enough, F.regr_intercept("y", "p")).alias("calibration_intercept"),
        enough.alias("enough"),
    ).select(
        "calibration_slope",
        "calibration_intercept",
        F.when(F.col("enough"), gaps.agg(F.avg("gap")).scalar()).alias("calibration_mae"),
    )


def compare_predictions(df: DataFrame, target: str, predictions: list[str]) -> DataFrame:
    """Regression metrics of several prediction columns side by side (`model_key`)."""
    typed = df.select(F.col(target).cast("double").alias("y"), *[F.col(p).cast("double").alias(p) for p in predictions])
    long = typed.unpivot(["y"], predictions, "model_key", "p")
    return regression_metrics(long, "y", "p", by=["model_key"])
