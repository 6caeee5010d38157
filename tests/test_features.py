import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from wearlens.functions.ordered import row_index, running_totals, with_neighbours
from wearlens.functions.quantiles import exact_quantiles
from wearlens.operators import features as ft
from wearlens.operators import prepare as pr


def minutes(spark):
    rows = [("2026-01-01T00:%02d:00Z" % i, "engine_1", float(i + 1), 2.0 * (i + 1)) for i in range(4)]
    return spark.createDataFrame(rows, "event_time string, equipment_id string, sensor_1 double, sensor_2 double")


def test_small_batch_features(spark):
    prepared = pr.prepare_batch(minutes(spark), ["sensor_1", "sensor_2"], source_file="batch.csv")
    row = prepared.orderBy("cycle").first()
    assert row["run_id"] == "engine_1_batch_run_001" and row["cycle"] == 1 and row["source_file"] == "batch.csv"
    placed = prepared.withColumn("row_index", F.col("cycle"))
    rows = ft.engineer_features(placed, ["sensor_1", "sensor_2"]).where("cycle = 4").collect()
    found = {r["feature"]: r["feature_value"] for r in rows}
    assert found["sensor_1_1h_mean"] == 2.5
    assert found["sensor_1_lag_2"] == 2.0
    assert found["sensor_2_to_sensor_1_ratio"] == 2.0
    assert len(found) == 2 * (12 + 12 + 5) + 1
    assert found["sensor_1_fft_amp_3"] is None and found["sensor_1_fft_amp_1"] > 0


def test_packed_blocks_hold_what_long_rows_hold(spark):
    """Seven rows a reading of two sensors meet, in place of 59; the maps are the same, also with nulls and one sensor."""
    raw = minutes(spark).withColumn("sensor_1", F.when(F.col("sensor_1") != 2, F.col("sensor_1")))
    for sensors in (["sensor_1", "sensor_2"], ["sensor_1"]):
        placed = pr.prepare_batch(raw, sensors).withColumn("row_index", F.col("cycle"))
        long, blocks = (ft.engineer_features(placed, sensors, blocks=b) for b in (False, True))
        assert blocks.count() == 4 * (3 * len(sensors) + (len(sensors) > 1))
        packed = pr.pack_long_features(long, "v"), pr.pack_long_features(blocks, "v", ft.feature_blocks(sensors))
        one, two = ({r["cycle"]: r.asDict() for r in p.collect()} for p in packed)
        assert one == two and len(two[3]["feature_payload"]) == 29 * len(sensors) + len(sensors) - 1
        assert packed[0].schema.simpleString() == packed[1].schema.simpleString()


def test_unparseable_time_fails(spark):
    raw = minutes(spark).withColumn("event_time", F.lit("yesterday"))
    try:
        pr.prepare_batch(raw, ["sensor_1", "sensor_2"]).collect()
    except Exception as error:
        assert "is no time" in str(error)
    else:
        raise AssertionError("a bad time must fail the job")


def test_rolling_stats_equal_pandas_on_one_busy_key(spark):
    rng = np.random.default_rng(3)
    times = np.unique(rng.integers(0, 90 * ft.HOUR, 1500))
    values = np.where(rng.random(len(times)) < 0.1, np.nan, 1e6 + rng.normal(size=len(times)))
    frame = pd.DataFrame({"k": "a", "event_us": times, "value": values})
    given = spark.createDataFrame(frame).withColumn("value", F.when(~F.isnan("value"), F.col("value")))
    out = ft.rolling_stats(given, ["k"], "event_us").toPandas().sort_values("event_us").reset_index(drop=True)
    series = pd.Series(values, index=pd.to_datetime(times, unit="us"))
    for name in ("1h", "8h", "24h"):
        rolled = series.rolling(name, min_periods=1)
        np.testing.assert_allclose(out[f"{name}_mean"], rolled.mean().to_numpy(), rtol=1e-12)
        np.testing.assert_allclose(out[f"{name}_std"], rolled.std(ddof=0).fillna(0.0).to_numpy(), atol=1e-6)
        np.testing.assert_array_equal(out[f"{name}_min"], rolled.min().to_numpy())
        np.testing.assert_array_equal(out[f"{name}_max"], rolled.max().to_numpy())


def test_positions_and_lags_cross_the_cuts(spark):
    given = spark.range(100).select(F.lit("a").alias("k"), F.col("id"), (F.col("id") * 2.0).alias("v"))
    placed = row_index(given, ["k"], ["id"], F.floor(F.col("id") / 7))
    assert [r["row_index"] for r in placed.orderBy("id").collect()] == list(range(1, 101))
    lagged = ft.lag_values(placed, ["k"], "row_index", ["v"], (1, 12), run=12).orderBy("id").collect()
    assert [r["v_lag_12"] for r in lagged] == [None] * 12 + [2.0 * i for i in range(88)]
    lent = with_neighbours(placed, "row_index", 10, before=3, after=2)
    assert lent.where("_own").count() == 100


def test_running_totals_and_quantiles(spark):
    rng = np.random.default_rng(1)
    values = np.unique(rng.normal(size=3000))
    given = spark.createDataFrame(pd.DataFrame({"m": "a", "s": values, "w": 1}))
    out = running_totals(given, "m", "s", {"w": "t"}, coarse=4).orderBy(F.desc("s")).collect()
    assert [r["t"] for r in out] == list(range(1, len(values) + 1))
    long = given.select(F.col("m").alias("feature"), F.col("s").alias("value"))
    probabilities = [0.0, 0.1, 0.5, 0.92, 1.0]
    rows = exact_quantiles(long, probabilities).orderBy("probability").collect()
    np.testing.assert_allclose([r["quantile"] for r in rows], np.quantile(values, probabilities), rtol=1e-12)


def test_quantiles_of_every_size_without_nan(spark):
    rng = np.random.default_rng(2)
    sizes = (1, 2, 3, 10, 11, 120, 1001, 6000, 30_000)
    columns = {f"c{n}": rng.integers(0, 4 * n, n).astype(float) for n in sizes}
    rows = [(k, v) for k, values in columns.items() for v in [*map(float, values), float("nan"), None]]
    long = spark.createDataFrame(rows, "feature string, value double")
    probabilities = [0.0, 0.05, 0.25, 0.5, 0.9, 0.95, 1.0]
    found = {(r["feature"], r["probability"]): r["quantile"] for r in exact_quantiles(long, probabilities).collect()}
    for name, values in columns.items():
        np.testing.assert_allclose([found[name, p] for p in probabilities], np.quantile(values, probabilities), rtol=1e-12)


def test_rolling_spectrum_of_nulls_chunks_and_batches(spark):
    rng = np.random.default_rng(5)
    rows = [(f"e{k}", int(t), None if rng.random() < 0.1 else float(rng.normal())) for k in range(3) for t in np.unique(rng.integers(0, 400, 150))]
    readings = spark.createDataFrame(rows, "equipment_id string, event_us bigint, value double")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    found = ft.rolling_spectrum(readings, ["equipment_id"], "event_us", [], window=50, chunk=40, top=3).collect()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert len(found) == len(rows)
    for r in found:
        x = np.array([v for e, t, v in rows if e == r["equipment_id"] and r["event_us"] - 50 <= t <= r["event_us"] and v is not None])
        expected = np.sort(np.abs(np.fft.rfft(x - x.mean()))[1:])[::-1][:3].tolist() if len(x) > 1 else []
        got = [r[f"fft_amp_{i}"] for i in (1, 2, 3)]
        assert got[len(expected) :] == [None] * (3 - len(expected))
        np.testing.assert_allclose(got[: len(expected)], expected, atol=1e-9)
