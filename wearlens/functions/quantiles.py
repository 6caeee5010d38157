"""Exact quantiles (linear interpolation) of whole columns without sorting a column in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import Window as W
from pyspark.sql import functions as F

ACCURACY = 10_000
#: Widths of brackets that one pass measures, as shares of the rows; the narrowest one that holds the rank is used.
MARGINS = (4.0 / ACCURACY, 0.02, 1.0)


def to_long(df: DataFrame, columns: list[str], ids: list[str] | None = None) -> DataFrame:
    """One row per (row, column): `feature`, `value`; nulls and NaN left out."""
    ids = ids or []
    typed = df.select(*ids, *[F.col(c).cast("double").alias(c) for c in columns])
    return typed.unpivot(ids, columns, "feature", "value").where(F.col("value").isNotNull() & ~F.isnan("value"))


def _brackets(bounds: Row, probabilities: list[float]) -> Column:
    """Per probability the value range that must hold its rank, and the rank itself (from 0, not whole)."""
    found = []
    # An approximate quantile is off by up to 1 / ACCURACY of the rows; interpolation needs up to two ranks beside it.
    width = next(i for i, m in enumerate(MARGINS) if m == 1.0 or m >= 2.0 / ACCURACY + 2.0 / bounds["n"])
    for k, p in enumerate(probabilities):
        low, high = (bounds[side][width * len(probabilities) + k] for side in ("low", "high"))
        named = {"probability": p, "low": low, "high": high, "rank": p * (bounds["n"] - 1)}
        found.append(F.struct(*[F.lit(float(v)).alias(k) for k, v in named.items()]))
    return F.array(*found)


def exact_quantiles(long: DataFrame, probabilities: list[float]) -> DataFrame:
    """`(feature, probability, quantile)` of a long frame, as numpy and pandas define it.

    Pass one brackets each wanted rank with approximate quantiles (error 1/ACCURACY, bracket four times as
    wide; wider for a column of few rows, whose ranks lie further apart). Pass two counts everything below the
    bracket and sorts only the distinct values inside it. Null and NaN values are left out.
    """
    long = long.where(F.col("value").isNotNull() & ~F.isnan("value"))
    low = [max(p - m, 0.0) for m in MARGINS for p in probabilities]
    high = [min(p + m, 1.0) for m in MARGINS for p in probabilities]
    bounds = long.groupBy("feature").agg(
        F.count(F.lit(1)).alias("n"),
        F.percentile_approx("value", low, ACCURACY).alias("low"),
        F.percentile_approx("value", high, ACCURACY).alias("high"),
    )
    # One row per column reaches the driver; the brackets go back as constants.
    brackets = [F.lit(x) for r in bounds.collect() for x in (r["feature"], _brackets(r, probabilities))]
    if not brackets:
        return long.sparkSession.createDataFrame([], "feature string, probability double, quantile double")
    counted = (
        long.withColumn("w", F.explode(F.element_at(F.create_map(*brackets), F.col("feature"))))
        .select("feature", "w.*", "value")
        .where(F.col("value") <= F.col("high"))
        .withColumn("value", F.when(F.col("value") >= F.col("low"), F.col("value")))
        .groupBy("feature", "probability", "rank", "value")
        .agg(F.count(F.lit(1)).alias("rows"))
    )
    upto = W.partitionBy("feature", "probability").orderBy("value").rowsBetween(W.unboundedPreceding, 0)
    reached = counted.withColumn("reached", F.sum("rows").over(upto)).where(F.col("value").isNotNull())
    lower = F.min(F.when(F.col("reached") > F.floor("rank"), F.col("value")))
    upper = F.min(F.when(F.col("reached") > F.ceil("rank"), F.col("value")))
    share = F.col("rank") - F.floor("rank")
    return (
        reached.groupBy("feature", "probability", "rank")
        .agg(lower.alias("lower"), upper.alias("upper"))
        .select("feature", "probability", (F.col("lower") + (F.col("upper") - F.col("lower")) * share).alias("quantile"))
    )


def exact_medians(long: DataFrame) -> DataFrame:
    """`(feature, median)` of a long frame."""
    return exact_quantiles(long, [0.5]).select("feature", F.col("quantile").alias("median"))
