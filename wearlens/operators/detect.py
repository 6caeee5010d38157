"""Anomaly injection, reference statistics, row scores and reconstruction errors."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import at_least, normal, row_hash, uniform
from ..functions.quantiles import exact_medians, exact_quantiles, to_long
from ..functions.sampling import cut_point, up_to
from ..schemas import SENSORS, require
from ..session import written
from .sequences import apply_scaler, fitted_values, late_life, safe_scale, scaled, sequence_scaler, sequence_windows

# Per anomaly type the number of sensors hit and the two parameters of its change.
ANOMALY_TYPES = ("spike", "dropout", "drift_jump")
ANOMALY_SENSORS = {"spike": 4, "dropout": 3, "drift_jump": 6}
SPIKE = (24.0, 4.5)
DROPOUT = (0.01, 0.08)
DRIFT = (10.0, 2.0)
MAD_FACTOR = 1.4826


def inject_anomalies(
    holdout: DataFrame,
    fraction: float = 0.08,
    seed: int = 42,
    sensors: list[str] | None = None,
    append: bool = True,
) -> DataFrame:
    """Labelled anomalies on an exact number of late-life rows, repeatable from unit, cycle and seed.

    Adds `is_anomaly` and `injected_anomaly_type`. `append` keeps the clean rows and adds changed copies;
    otherwise the chosen rows are changed in place.
    """
    if not 0 < fraction < 1:
        raise ValueError("The share of rows to change has to lie above 0 and below 1.")
    sensors = sensors or SENSORS
    require(holdout, ["unit", "cycle", *sensors], "inject anomalies")
    u, c = F.col("unit"), F.col("cycle")
    marked = late_life(holdout).withColumn("_hash", row_hash(u, c, seed))
    order = ["_hash", "unit", "cycle"]
    wanted = max(1, round(holdout.count() * fraction))
    chosen = F.col("is_late_life") & up_to(order, cut_point(marked.where("is_late_life"), order, wanted))
    kind = F.element_at(F.array(*[F.lit(k) for k in ANOMALY_TYPES]), (row_hash(u, c, seed + 1) % 3 + 1).cast("int"))
    places = F.sequence(F.lit(1), F.lit(len(sensors)))
    count = F.coalesce(*[F.when(F.col("_kind") == k, F.lit(min(n, len(sensors)))) for k, n in ANOMALY_SENSORS.items()])
    spread = DROPOUT[1] - DROPOUT[0]
    drawn = {
        "_ranks": F.transform(places, lambda i: row_hash(u, c, i + (seed + 1000))),
        "_noise": F.transform(places, lambda i: normal(u, c, i + (seed + 2000))),
        "_share": F.transform(places, lambda i: DROPOUT[0] + spread * uniform(u, c, i + (seed + 3000))),
    }
    # One pair per sensor: a factor and an amount to add, (1, 0) for a sensor that stays.
    change = (
        F.when(F.col("_kind") == "spike", F.transform("_noise", lambda z: F.struct(F.lit(1.0).alias("by"), (SPIKE[0] + SPIKE[1] * z).alias("add"))))
        .when(F.col("_kind") == "dropout", F.transform("_share", lambda z: F.struct(z.alias("by"), F.lit(0.0).alias("add"))))
        .otherwise(F.transform("_noise", lambda z: F.struct(F.lit(1.0).alias("by"), (DRIFT[0] + DRIFT[1] * z).alias("add"))))
    )
    values = F.array(*[F.col(s).cast("double") for s in sensors])
    moved = F.transform(
        F.arrays_zip("_values", "_change", "_ranks"),
        lambda t: F.when(t["_ranks"] <= F.col("_limit"), t["_values"] * t["_change"]["by"] + t["_change"]["add"]).otherwise(t["_values"]),
    )
    tagged = (
        marked.withColumn("_chosen", F.coalesce(chosen, F.lit(False)))
        .withColumn("_kind", F.when(F.col("_chosen"), kind))
        .withColumns({n: F.when(F.col("_chosen"), d) for n, d in drawn.items()})
        .withColumn("_limit", F.element_at(F.array_sort("_ranks"), count))
        .withColumn("_values", values)
        .withColumn("_change", F.when(F.col("_chosen"), change))
        .withColumn("_moved", F.when(F.col("_chosen"), moved).otherwise(F.col("_values")))
    )
    changed = {s: F.get("_moved", F.lit(i)) for i, s in enumerate(sensors)}
    helpers = ["_hash", "is_late_life", "_chosen", "_kind", *drawn, "_limit", "_values", "_change", "_moved"]
    columns = [*holdout.columns, "is_anomaly", "injected_anomaly_type"]
    labels = {
        "is_anomaly": F.col("_chosen").cast("int"),
        "injected_anomaly_type": F.coalesce("_kind", F.lit("normal")),
    }
    if not append:
        return tagged.withColumns({**changed, **labels}).drop(*helpers).select(*columns)
    clean = holdout.withColumns({"is_anomaly": F.lit(0), "injected_anomaly_type": F.lit("normal")})
    copies = tagged.where("_chosen").withColumns({**changed, **labels}).drop(*helpers)
    typed = clean.withColumns({s: F.col(s).cast("double") for s in sensors})
    return typed.select(*columns).unionByName(copies.select(*columns))


def zscore_reference(df: DataFrame, features: list[str]) -> DataFrame:
    """`feature, center, scale`: mean and population standard deviation."""
    stats = to_long(df, features).groupBy("feature").agg(F.avg("value").alias("center"), F.stddev_pop("value").alias("scale"))
    return stats.withColumn("scale", safe_scale(F.col("scale")))


def mad_reference(df: DataFrame, features: list[str]) -> DataFrame:
    """`feature, center, scale`: median and scaled median absolute deviation, both exact."""
    long = to_long(df, features)
    # one number per feature reaches the driver and goes back as a constant
    centers = {r["feature"]: r["median"] for r in exact_medians(long).collect()}
    if not centers:
        return long.sparkSession.createDataFrame([], "feature string, center double, scale double")
    center = F.element_at(F.create_map(*[F.lit(x) for pair in centers.items() for x in pair]), F.col("feature"))
    spread = exact_medians(long.select("feature", F.abs(F.col("value") - center).alias("value")))
    return spread.select("feature", center.alias("center"), safe_scale(F.col("median") * MAD_FACTOR).alias("scale"))


def distance_score(reference: DataFrame, features: list[str]) -> Column:
    """Root mean square of the standardized features."""
    known = fitted_values(reference)
    squares = [F.pow(scaled(f, known), F.lit(2)) for f in features]
    return F.sqrt(F.aggregate(F.array(*squares), F.lit(0.0), lambda a, x: a + x) / len(features))


def standardize(train: DataFrame, rows: DataFrame, features: list[str]) -> DataFrame:
    return apply_scaler(rows, zscore_reference(train, features), features)


def upper_threshold(df: DataFrame, column: str, contamination: float = 0.08) -> DataFrame:
    """One row, `threshold`: the (1 - contamination) quantile with linear interpolation."""
    if not 0 < contamination < 0.5:
        raise ValueError("The expected share of anomalies has to lie above 0 and below one half.")
    long = df.select(F.lit(column).alias("feature"), F.col(column).cast("double").alias("value"))
    return exact_quantiles(long.where("value IS NOT NULL"), [1.0 - contamination]).select(
        F.col("quantile").alias("threshold")
    )


def score_statistics(train: DataFrame, rows: DataFrame, features: list[str]) -> DataFrame:
    """Add `zscore_score` and `mad_score`."""
    return rows.withColumns(
        {
            "zscore_score": distance_score(zscore_reference(train, features), features),
            "mad_score": distance_score(mad_reference(train, features), features),
        }
    )


def reconstruction_scores(
    train: DataFrame,
    rows: DataFrame,
    features: list[str],
    length: int = 30,
    stride: int = 5,
    components: int = 8,
    contamination: float = 0.08,
    label: str | None = "is_anomaly",
) -> tuple[DataFrame, DataFrame]:
    """Windows with `reconstruction_error` and `predicted_anomaly`, and the threshold frame.

    A linear autoencoder: windows scaled on the train windows, projected on their leading principal
    components; the error is the mean squared rest. The fit exchanges one (length * features)^2 matrix.
    """
    scaler = fitted_values(sequence_scaler(train, features, length, stride))

    def vectors(df: DataFrame, mark: str | None) -> DataFrame:
        windows = sequence_windows(apply_scaler(df, scaler, features), length, stride, label=mark, features=features)
        return windows.withColumn("vector", array_to_vector(F.flatten("window"))).drop("window")

    fitted = written(vectors(train, None), "fit-windows")
    model = PCA(k=components, inputCol="vector", outputCol="projected").fit(fitted)
    basis = model.pc.toArray()
    width = basis.shape[0]
    center = fitted.select(Summarizer.mean(F.col("vector")).alias("m")).first()["m"].toArray()

    @F.pandas_udf("double")
    def rest(series: pd.Series) -> pd.Series:
        x = np.stack(series.to_numpy()) - center
        inside = x @ basis
        return pd.Series((np.square(x).sum(axis=1) - np.square(inside).sum(axis=1)).clip(min=0.0) / width)

    def errors(df: DataFrame) -> DataFrame:
        return df.withColumn("reconstruction_error", rest(vector_to_array("vector"))).drop("vector")

    threshold = upper_threshold(errors(fitted), "reconstruction_error", contamination)
    scored = errors(vectors(rows, label))
    flag = at_least(F.col("reconstruction_error"), threshold.scalar())
    return scored.withColumn("predicted_anomaly", flag), threshold


def paired_changes(labelled: DataFrame, sensors: list[str], top: int = 8) -> DataFrame:
    """Changed rows next to their clean pair: the `top` sensors by absolute difference."""
    ids = ["unit", "cycle"]
    clean = labelled.where("is_anomaly = 0").select(*ids, F.array(*sensors).alias("clean_values"))
    changed = labelled.where("is_anomaly = 1").select(*ids, "injected_anomaly_type", F.array(*sensors).alias("new_values"))
    pairs = changed.join(clean, ids)
    listed = [
        F.struct(
            F.lit(s).alias("sensor"),
            F.get("clean_values", F.lit(i)).alias("clean"),
            F.get("new_values", F.lit(i)).alias("anomalous"),
            (F.get("new_values", F.lit(i)) - F.get("clean_values", F.lit(i))).alias("delta"),
        )
        for i, s in enumerate(sensors)
    ]
    by_size = F.array_sort(
        F.transform(F.array(*listed), lambda p: F.struct((-F.abs(p["delta"])).alias("size"), p["sensor"].alias("name"), p.alias("p")))
    )
    ranked = pairs.select(*ids, "injected_anomaly_type", F.posexplode(F.slice(by_size, 1, top)).alias("place", "r"))
    return ranked.select(*ids, "injected_anomaly_type", (F.col("place") + 1).alias("rank"), "r.p.*")
