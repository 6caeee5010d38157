"""Remaining-life forecasts: blending, trend and seasonality, window models, parameter search."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import at_least, blend
from ..session import written
from .metrics import regression_metrics
from .sequences import split_by_unit, target_windows


def with_blend(df: DataFrame, first: str, second: str, first_weight: float = 0.7, second_weight: float = 0.3) -> DataFrame:
    """Add `hybrid_prediction` and the flags for whether the second prediction took part."""
    return df.withColumns(
        {
            "hybrid_prediction": blend(F.col(first), F.col(second), first_weight, second_weight),
            "ensemble_applied": F.col(second).isNotNull().cast("int"),
            "prophet_fallback_used": F.col(second).isNull().cast("int"),
        }
    )


def cycle_curve(windows: DataFrame, target: str, cycle: str = "target_cycle") -> DataFrame:
    """Mean target per cycle on a daily axis that starts on 2000-01-01 with cycle 1; fails on cycles below 1."""
    failed = F.raise_error(F.lit("Cycle values must be at least 1.")).cast("date")
    day = F.when(F.col(cycle) >= 1, F.date_add(F.lit("2000-01-01").cast("date"), (F.col(cycle) - 1).cast("int")))
    mean = windows.groupBy(cycle).agg(F.avg(F.col(target).cast("double")).alias("y"))
    return mean.select(F.coalesce(day, failed).alias("ds"), cycle, "y")


# --- window models -----------------------------------------------------------------------------------


def window_summary(windows: DataFrame, features: list[str]) -> tuple[DataFrame, list[str]]:
    """Mean, last value and change over the window per feature, from the `window` array."""
    def values_of(place: int) -> Column:
        return F.transform("window", lambda row: F.get(row, F.lit(place)))

    out, names = windows, []
    for i, f in enumerate(features):
        values = values_of(i)
        parts = {
            f"{f}_mean": F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.size("window"),
            f"{f}_last": F.element_at(values, -1),
            f"{f}_change": F.element_at(values, -1) - F.element_at(values, 1),
        }
        out = out.withColumns(parts)
        names += list(parts)
    return out.drop("window"), names


def _known(name: str) -> str:
    return f"nanvl(CAST(`{name}` AS DOUBLE), CAST(NULL AS DOUBLE))"


def _filler(train: DataFrame, inputs: list[str]) -> tuple[SQLTransformer, list[str]]:
    """A stage that adds `<input>_filled` and `<input>_missing`; NaN is missing, an input that is never known becomes 0."""
    means = train.agg(*[F.avg(F.expr(_known(c))).alias(c) for c in inputs]).first()
    terms = [f"coalesce({_known(c)}, {float(means[c] or 0.0)!r}D) AS `{c}_filled`" for c in inputs]
    terms += [f"CAST({_known(c)} IS NULL AS DOUBLE) AS `{c}_missing`" for c in inputs]
    names = [f"{c}_filled" for c in inputs] + [f"{c}_missing" for c in inputs]
    return SQLTransformer(statement=f"SELECT *, {', '.join(terms)} FROM __THIS__"), names


def fit_window_model(train: DataFrame, inputs: list[str], target: str, mode: str = "rul", **params) -> PipelineModel:
    """Gradient-boosted trees over window summaries: regression of the remaining life or failure probability.

    Windows with a missing input are kept, in training and in prediction: the training mean stands in for it and a flag
    per input tells the trees.
    """
    filler, filled = _filler(train, inputs)
    assembler = VectorAssembler(inputCols=filled, outputCol="inputs")
    settings = {"maxIter": 10, "maxDepth": 4, "seed": 42, **params}
    if mode == "rul":
        model = GBTRegressor(featuresCol="inputs", labelCol=target, predictionCol="prediction", **settings)
    else:
        model = GBTClassifier(featuresCol="inputs", labelCol=target, **settings)
    return Pipeline(stages=[filler, assembler, model]).fit(train)


def predict_windows(model: PipelineModel, windows: DataFrame, target: str, mode: str = "rul") -> DataFrame:
    """Window columns with `prediction` and `absolute_error`, or `predicted_probability` and `predicted_label`."""
    scored = model.transform(windows)
    scored = scored.select(*windows.columns, *[c for c in ("prediction", "probability") if c in scored.columns])
    if mode == "rul":
        return scored.withColumn("absolute_error", F.abs(F.col(target) - F.col("prediction")))
    share = vector_to_array("probability")[1]
    out = scored.withColumn("predicted_probability", share)
    out = out.withColumn("predicted_label", at_least(F.col("predicted_probability"), 0.5))
    return out.drop("probability", "prediction")


def search_parameters(
    rows: DataFrame, features: list[str], lengths: tuple[int, ...], depths: tuple[int, ...], rounds: tuple[int, ...],
    validation_fraction: float = 0.2, seed: int = 42, stride: int = 1,
) -> DataFrame:
    """One row per trial (window length, tree depth, boosting rounds) with its validation RMSE, best first.

    Each trial is a distributed fit; trials run one after the other with the windows of a length written once.
    """
    if any(n < 2 for n in lengths):
        raise ValueError("Window lengths must be at least 2.")
    trials = []
    train, held = split_by_unit(rows, validation_fraction, seed)
    for length in lengths:
        summaries = []
        for part in (train, held):
            windows = target_windows(part, length, stride, features=features)
            frame, inputs = window_summary(windows, features)
            summaries.append(written(frame.select(*inputs, "rul"), "trial-windows"))
        for depth in depths:
            for count in rounds:
                model = fit_window_model(summaries[0], inputs, "rul", maxDepth=depth, maxIter=count, seed=seed)
                rmse = regression_metrics(predict_windows(model, summaries[1], "rul"), "rul", "prediction").first()["rmse"]
                trials.append((len(trials), length, depth, count, rmse))
    spark = rows.sparkSession
    kinds = "trial int, window_size int, max_depth int, rounds int, validation_rmse double"
    return spark.createDataFrame(trials, kinds).orderBy("validation_rmse", "trial")


# --- trend and seasonality ---------------------------------------------------------------------------


@dataclass(frozen=True)
class TrendModel:
    """Coefficients of a piecewise-linear trend plus Fourier terms over the cycle."""

    intercept: float
    trend: tuple[tuple[float, float], ...]  # (knot, slope change)
    waves: tuple[tuple[float, float], ...]  # (sine, cosine) per order
    period: float


def _trend_terms(cycle: Column, knots: list[float]) -> list[Column]:
    return [F.greatest(cycle - k, F.lit(0.0)) for k in knots]


def _wave_terms(cycle: Column, period: float, order: int) -> list[Column]:
    return [f(2.0 * math.pi * k / period * cycle) for k in range(1, order + 1) for f in (F.sin, F.cos)]


def fit_trend(curve: DataFrame, period: float = 20.0, order: int = 5, pieces: int = 4, ridge: float = 1e-6) -> TrendModel:
    """Least-squares fit on the mean target per cycle (`target_cycle, y`); needs at least two cycles."""
    ends = curve.agg(F.count(F.lit(1)), F.min("target_cycle"), F.max("target_cycle")).first()
    if ends[0] < 2:
        raise ValueError("A trend is fitted on two cycles or more.")
    first, last = float(ends[1]), float(ends[2])
    knots = [first + (last - first) * i / pieces for i in range(pieces)]
    cycle = F.col("target_cycle").cast("double")
    terms = _trend_terms(cycle, knots) + _wave_terms(cycle, period, order)
    names = [f"t{i}" for i in range(len(terms))]
    frame = curve.select("y", *[t.alias(n) for t, n in zip(terms, names)])
    vector = VectorAssembler(inputCols=names, outputCol="inputs").transform(frame)
    model = LinearRegression(featuresCol="inputs", labelCol="y", regParam=ridge, solver="normal").fit(vector)
    found = [float(c) for c in model.coefficients]
    waves = found[len(knots) :]
    return TrendModel(
        float(model.intercept), tuple(zip(knots, found)), tuple(zip(waves[0::2], waves[1::2])), period
    )


def predict_trend(rows: DataFrame, model: TrendModel) -> DataFrame:
    """Add `prophet_prediction`, `prophet_trend` and `prophet_seasonality`, the first being the sum of the others."""
    cycle = F.col("target_cycle").cast("double")
    trend = F.lit(model.intercept)
    for knot, slope in model.trend:
        trend = trend + slope * F.greatest(cycle - knot, F.lit(0.0))
    season = F.lit(0.0)
    for k, (sine, cosine) in enumerate(model.waves, start=1):
        angle = 2.0 * math.pi * k / model.period * cycle
        season = season + sine * F.sin(angle) + cosine * F.cos(angle)
    return rows.withColumns({"prophet_trend": trend, "prophet_seasonality": season}).withColumn(
        "prophet_prediction", F.col("prophet_trend") + F.col("prophet_seasonality")
    )
