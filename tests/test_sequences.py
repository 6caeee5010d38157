import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from wearlens.operators import detect as de
from wearlens.operators import metrics as me
from wearlens.operators import profile as po
from wearlens.operators import sequences as se


def labelled(spark):
    rows = [(u, c, 500.0 + c, int(u == 2 and c >= 5), float(c)) for u in (1, 2) for c in range(1, 7)]
    return spark.createDataFrame(rows, "unit int, cycle int, sensor_1 double, is_anomaly int, row_score double")


def test_windows_labels_and_scores(spark):
    out = se.sequence_windows(labelled(spark), 3, 2, label="is_anomaly", scores=["row_score"], features=["sensor_1"])
    rows = out.orderBy("unit", "window_start_index").collect()
    assert [r["is_anomaly_window"] for r in rows] == [0, 0, 0, 1]
    assert [r["row_score"] for r in rows] == [3.0, 5.0, 3.0, 5.0]
    assert all(len(r["window"]) == 3 for r in rows)


def test_remaining_life(spark):
    rows = [(u, c, 1.0) for u in (1, 2) for c in range(1, 5)]
    df = spark.createDataFrame(rows, "unit int, cycle int, sensor_1 double")
    targets = spark.createDataFrame([(1, 3), (2, 1)], "unit int, rul int")
    out = se.add_test_rul(df, targets).orderBy("unit", "cycle").collect()
    assert [r["rul"] for r in out] == [6, 5, 4, 3, 4, 3, 2, 1]
    with pytest.raises(Exception, match="No test target"):
        se.add_test_rul(df, targets.where("unit = 1")).collect()
    life = spark.createDataFrame([(1, c, 5 - c, 0.0) for c in range(1, 6)], "unit int, cycle int, rul int, sensor_1 double")
    assert [r["rul"] for r in se.target_windows(life, 3).orderBy("target_cycle").collect()] == [2.0, 1.0, 0.0]
    flags = se.target_windows(life, 2, mode="failure_in_next_window", horizon=2).orderBy("target_cycle").collect()
    assert [r["failure_in_next_window"] for r in flags] == [0.0, 1.0, 1.0, 0.0]


def test_split_is_disjoint_and_repeatable(spark):
    df = spark.range(50).select((F.col("id") % 5).alias("unit"), F.col("id").alias("cycle"))
    train, held = se.split_by_unit(df, 0.4)
    a, b = ({r["unit"] for r in part.select("unit").distinct().collect()} for part in (train, held))
    assert len(b) == 2 and not a & b and len(a) == 3
    assert {r["unit"] for r in se.split_by_unit(df.repartition(7), 0.4)[1].collect()} == b


def test_scaler_equals_numpy_over_windows(spark):
    rng = np.random.default_rng(5)
    lives = {1: 17, 2: 9, 3: 4}
    rows = [(u, c, float(rng.normal())) for u, n in lives.items() for c in range(1, n + 1)]
    df = spark.createDataFrame(rows, "unit int, cycle int, sensor_1 double")
    values = []
    for u, n in lives.items():
        x = [r[2] for r in rows if r[0] == u]
        values += [v for s in range(0, n - 6 + 1, 4) for v in x[s : s + 6]]
    row = se.sequence_scaler(df, ["sensor_1"], 6, 4).first()
    assert row["center"] == pytest.approx(np.mean(values)) and row["scale"] == pytest.approx(np.std(values))


def test_threshold_and_ranking(spark):
    errors = spark.createDataFrame([(x,) for x in (0.1, 0.2, 0.3, 0.4, 0.5)], "x double")
    assert de.upper_threshold(errors, "x", 0.2).first()[0] == pytest.approx(0.42)
    scores = spark.createDataFrame([(0, 0.1), (0, 0.2), (1, 0.8), (1, 0.9)], "y int, score double")
    row = me.ranking_metrics(me.score_curve(scores, "y", ["score"])).first()
    assert row["roc_auc"] == 1.0 and row["pr_auc"] == 1.0 and row["pr_curve_points"] == 5


def test_classification_and_calibration(spark):
    rows = spark.createDataFrame([(0, 0.1), (0, 0.2), (1, 0.8), (1, 0.9)], "y int, p double")
    assert tuple(me.classification_metrics(rows, "y", "p").first()) == (1.0, 1.0, 1.0, 1.0, 1.0)
    one = me.classification_metrics(rows.where("y = 1"), "y", "p").first()
    assert one["roc_auc"] is None and one["recall"] == 1.0
    pairs = spark.createDataFrame([(10.0, 9.0), (8.0, 7.0), (6.0, 5.0), (4.0, 3.0)], "y double, p double")
    fit = me.calibration(pairs, "y", "p").first()
    assert fit["calibration_slope"] == pytest.approx(1.0) and fit["calibration_mae"] == pytest.approx(1.0)
    assert tuple(me.calibration(pairs.limit(1), "y", "p").first()) == (None, None, None)


def test_all_zero_targets_fail(spark):
    with pytest.raises(Exception, match="percentage error"):
        me.rul_report(spark.createDataFrame([(0.0, 1.0)], "rul double, prediction double")).collect()


def test_injection_counts(spark):
    rows = [(u, c, *[500.0 + c + i for i in range(1, 22)]) for u in (1, 2) for c in range(1, 11)]
    names = ", ".join(f"sensor_{i} double" for i in range(1, 22))
    df = spark.createDataFrame(rows, f"unit int, cycle int, {names}")
    out = de.inject_anomalies(df, 0.2, 42)
    assert out.count() == 24 and out.where("is_anomaly = 1").count() == 4
    assert out.where("is_anomaly = 1 AND cycle < 7").count() == 0
    assert de.inject_anomalies(df, 0.2, 42, append=False).where("is_anomaly = 1").count() == 4


def test_stationarity_tells_noise_from_a_walk(spark):
    rng = np.random.default_rng(0)
    noise, walk = rng.normal(size=400), np.cumsum(rng.normal(size=400))
    frame = pd.DataFrame({"unit": 1, "cycle": np.arange(1, 401), "sensor_1": noise, "sensor_2": walk})
    out = {r["sensor"]: r for r in po.stationarity(spark.createDataFrame(frame), ["sensor_1", "sensor_2"]).collect()}
    assert out["sensor_1"]["adf_stationary"] and out["sensor_1"]["kpss_stationary"]
    assert not out["sensor_2"]["adf_stationary"] and not out["sensor_2"]["kpss_stationary"]
    assert not math.isnan(out["sensor_2"]["adf_stat"])


def plain_unit_root(values, lags):
    change = np.diff(values)
    rows = len(change) - lags
    if rows < lags + 4 or np.ptp(values) == 0:
        return None
    x = np.column_stack([np.ones(rows), values[lags : lags + rows]] + [change[lags - k : lags - k + rows] for k in range(1, lags + 1)])
    y = change[lags:]
    inverse = np.linalg.inv(x.T @ x)
    beta = inverse @ x.T @ y
    error = y - x @ beta
    return beta[1] / np.sqrt(error @ error / max(rows - x.shape[1], 1) * inverse[1, 1])


def plain_level(values):
    n = len(values)
    if n < 4 or np.ptp(values) == 0:
        return None
    error = values - values.mean()
    lags = int(np.ceil(12.0 * (n / 100.0) ** 0.25))
    variance = error @ error / n
    for k in range(1, min(lags, n - 1) + 1):
        variance += 2.0 * (1.0 - k / (lags + 1.0)) * (error[k:] @ error[:-k]) / n
    return np.sum(np.cumsum(error) ** 2) / (n * n) / variance


@pytest.mark.parametrize("lags", [0, 1, 3])
def test_stationarity_equals_the_definition(spark, lags):
    rng = np.random.default_rng(3)
    # the longest one crosses two buckets of positions; the first cycles are missing, so buckets and positions differ
    series = {1: rng.normal(size=9_001) + 500, 2: np.cumsum(rng.normal(size=300)), 3: rng.normal(size=9), 4: np.array([1.0, 2.0, 4.0]), 5: np.full(50, 0.1), 6: np.array([7.0])}
    rows = [(unit, i + 1_000, float(v)) for unit, x in series.items() for i, v in enumerate(x)]
    rows += [(2, 5_000, None), (1, 1, float("nan")), (7, 1, None)]
    df = spark.createDataFrame(rows, "unit int, cycle int, sensor_1 double").repartition(3)
    out = {r["unit"]: r for r in po.stationarity(df, ["sensor_1"], lags=lags).collect()}
    assert sorted(out) == [1, 2, 3, 4, 5, 6]
    for unit, x in series.items():
        for name, expected in (("adf", plain_unit_root(x, lags)), ("kpss", plain_level(x))):
            found = out[unit][f"{name}_stat"]
            assert (found is None and out[unit][f"{name}_pvalue"] is None) if expected is None else found == pytest.approx(expected, abs=2e-6)
    assert po.stationarity(df.limit(0), ["sensor_1"]).count() == 0


def test_stationarity_holds_no_series(spark):
    df = spark.range(100).select(F.lit(1).alias("unit"), (F.col("id") + 1).alias("cycle"), F.rand(1).alias("sensor_1"))
    plan = po.stationarity(df, ["sensor_1"])._jdf.queryExecution().toString()
    assert "collect_list" not in plan and "Python" not in plan and "InPandas" not in plan


def test_stationarity_of_segments(spark):
    x = np.random.default_rng(4).normal(size=300)
    df = spark.createDataFrame([(1, i + 1, float(v)) for i, v in enumerate(x)], "unit int, cycle int, sensor_1 double")
    out = {r["segment"]: r for r in po.stationarity(df, ["sensor_1"], segment=100).collect()}
    assert sorted(out) == [0, 1, 2]
    for k in range(3):
        assert out[k]["kpss_stat"] == pytest.approx(plain_level(x[100 * k : 100 * k + 100]), abs=2e-6)
        assert out[k]["adf_stat"] == pytest.approx(plain_unit_root(x[100 * k : 100 * k + 100], 1), abs=2e-6)
