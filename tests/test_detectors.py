import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from wearlens.operators import detect as de
from wearlens.operators import forest as fo
from wearlens.operators import neighbours as ne
from wearlens.operators import profile as po
from wearlens.operators.spectrum import shape_of


def vectors(spark, x, start=0):
    rows = [(start + i, [float(v) for v in r]) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "id long, v array<double>")


def brute_lof(train, rows, k):
    def near(points, same):
        d = np.sqrt(((points[:, None] - train[None]) ** 2).sum(-1))
        if same:
            np.fill_diagonal(d, np.inf)
        order = np.argsort(d, axis=1, kind="stable")[:, :k]
        return np.take_along_axis(d, order, 1), order

    td, ti = near(train, True)
    reach = td[:, -1]
    lrd = 1.0 / (np.maximum(td, reach[ti]).mean(1) + 1e-10)
    d, i = near(rows, False)
    own = 1.0 / (np.maximum(d, reach[i]).mean(1) + 1e-10)
    return lrd[i].mean(1) / own


@pytest.mark.parametrize("block", [2048, 7])
def test_nearest_is_exact(spark, block):
    rng = np.random.default_rng(2)
    train, rows = rng.normal(size=(150, 3)), rng.normal(size=(40, 3)) * 2
    refs = ne.distinct_vectors(vectors(spark, train), "id", "v")
    asked = vectors(spark, rows).withColumnsRenamed({"id": "q", "v": "vec"})
    out = ne.nearest(asked, refs, 4, pivots=5, rings=4, block=block).toPandas().sort_values(["q", "place"])
    d = np.sqrt(((rows[:, None] - train[None]) ** 2).sum(-1))
    np.testing.assert_array_equal(out["ref"].to_numpy().reshape(40, 4), np.argsort(d, axis=1)[:, :4])


def test_outlier_factor_with_many_copies(spark):
    rng = np.random.default_rng(4)
    train = np.vstack([rng.normal(size=(60, 2)), np.tile([[0.25, 0.5]], (30, 1))])
    rows = np.vstack([rng.normal(size=(20, 2)), [[0.25, 0.5], [9.0, 9.0]]])
    for k in (5, 35):
        out = ne.local_outlier_factor(vectors(spark, train), vectors(spark, rows), "id", "v", k, pivots=4)
        got = out.orderBy("id").toPandas()["local_outlier_factor_score"].to_numpy()
        np.testing.assert_allclose(got, brute_lof(train, rows, k), rtol=1e-9)


def test_forest_finds_planted_rows_and_repeats(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(400, 3))
    x[:8] += 9
    frame = pd.DataFrame(x, columns=["a", "b", "c"])
    frame.insert(0, "id", np.arange(len(x)))
    df = spark.createDataFrame(frame)
    first = fo.isolation_scores(df, df, "id", ["a", "b", "c"], 0.05, trees=40, sample=64)
    top = [r["id"] for r in first.orderBy(F.desc("isolation_forest_score")).limit(8).collect()]
    assert set(top) == set(range(8))
    again = fo.isolation_scores(df.repartition(5), df, "id", ["a", "b", "c"], 0.05, trees=40, sample=64)
    a, b = (d.orderBy("id").toPandas()["isolation_forest_score"] for d in (first, again))
    np.testing.assert_allclose(a, b)


def test_tree_samples_have_the_exact_size(spark):
    df = spark.range(3000).select("id")
    counts = fo.tree_samples(df, "id", trees=10, sample=50).groupBy("tree").count().collect()
    assert len(counts) == 10 and {r["count"] for r in counts} == {50}


def test_reconstruction_equals_numpy(spark):
    rng = np.random.default_rng(8)
    rows = [(u, c, *map(float, rng.normal(size=3))) for u in (1, 2, 3) for c in range(1, 31)]
    df = spark.createDataFrame(rows, "unit int, cycle int, sensor_1 double, sensor_2 double, sensor_3 double")
    names = ["sensor_1", "sensor_2", "sensor_3"]
    scored, threshold = de.reconstruction_scores(df, df.withColumn("is_anomaly", F.lit(0)), names, 5, 2, 4)
    got = scored.orderBy("unit", "window_start_index").toPandas()
    windows = []
    for u in (1, 2, 3):
        x = np.array([r[2:] for r in rows if r[0] == u])
        windows += [x[s : s + 5] for s in range(0, 26, 2)]
    flat = np.array(windows)
    flat = (flat - flat.reshape(-1, 3).mean(0)) / flat.reshape(-1, 3).std(0)
    flat = flat.reshape(len(flat), -1)
    centered = flat - flat.mean(0)
    basis = np.linalg.svd(centered, full_matrices=False)[2][:4].T
    expected = (centered**2).sum(1) - ((centered @ basis) ** 2).sum(1)
    np.testing.assert_allclose(got["reconstruction_error"], expected / 15, rtol=1e-6)
    assert threshold.first()[0] == pytest.approx(np.quantile(expected / 15, 0.92))


def test_series_spectrum_equals_numpy(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=50)
    df = spark.createDataFrame([(1, i + 1, float(v)) for i, v in enumerate(x)], "unit int, cycle int, sensor_1 double")
    row = po.series_spectrum(df, ["sensor_1"]).first()
    expected = np.sort(np.abs(np.fft.rfft(x - x.mean()))[1:])[::-1][:5]
    np.testing.assert_allclose([row[f"fft_amp_{i}"] for i in range(1, 6)], expected, atol=1e-4)


def test_long_series_stays_one_series(spark):
    n = 70_000
    df = spark.range(n).select(F.lit(1).alias("unit"), (F.col("id") + 1).alias("cycle"), F.sin(F.col("id") * 2 * np.pi * 700 / n).alias("sensor_1"))
    rows = po.series_spectrum(df, ["sensor_1"], top=2).collect()
    assert len(rows) == 1 and rows[0]["fft_amp_1"] == pytest.approx(n / 2, rel=1e-3) and rows[0]["fft_amp_2"] < 1
    assert po.stationarity(df, ["sensor_1"]).count() == 1


@pytest.mark.parametrize("n", [1_009, 2_048, 3_000])
def test_spectrum_over_many_tasks_equals_numpy(spark, n):
    """A prime length, a power of two and another one, next to a short series, a single value and nulls; equal cycles by value."""
    rng = np.random.default_rng(n)
    x = rng.normal(size=n) * 30 + 600
    rows = [("a", 2 * i, float(v)) for i, v in enumerate(x)] + [("b", i, float(v)) for i, v in enumerate(x[:40])] + [("c", 1, 5.0), ("d", 1, None)]
    rows += [("a", 7, None), ("e", 3, 2.0), ("e", 3, 1.0), ("e", 4, 5.0)]
    df = spark.createDataFrame(rows, "unit string, cycle long, sensor_1 double").repartition(3)
    found = {r["unit"]: r for r in po.series_spectrum(df, ["sensor_1"], whole=500).collect()}
    assert sorted(found) == ["a", "b", "c", "e"]
    for unit, values in (("a", x), ("b", x[:40]), ("e", np.array([1.0, 2.0, 5.0]))):
        expected = np.sort(np.abs(np.fft.rfft(values - values.mean()))[1:])[::-1][:5]
        got = [found[unit][f"fft_amp_{i}"] for i in range(1, 6)]
        np.testing.assert_allclose(got[: len(expected)], expected, atol=1e-4)
        assert got[len(expected) :] == [None] * (5 - len(expected))
    assert all(found["c"][f"fft_amp_{i}"] is None for i in range(1, 6))
    assert po.series_spectrum(df.limit(0), ["sensor_1"], whole=500).count() == 0


def test_groups_of_a_long_spectrum_are_small():
    for n in (2, 3, 500, 1_000_000, 3_000_000_000):
        rows, columns = shape_of(n)
        assert rows * columns >= 2 * n - 1 and rows <= columns <= 2 * rows and columns**2 <= 8 * n
    assert max(shape_of(1_000_000)) <= 2_048 and max(shape_of(1_000_000_000)) <= 65_536


def test_nearest_pairs_take_exact_distances_of_few_pairs(monkeypatch):
    """Far from the origin, in tight groups, with ties, copies and values that are none: the same as all distances sorted."""
    rng = np.random.default_rng(12)
    spread = rng.normal(size=(9_000, 16))
    tight = 1e4 + np.repeat(rng.normal(size=(5, 8)), 60, axis=0) + 1e-7 * rng.normal(size=(300, 8))
    grid = rng.integers(0, 2, size=(400, 6)).astype(float)
    broken = rng.normal(size=(50, 4))
    broken[3, 1], broken[7, 2] = np.nan, np.inf
    huge = rng.normal(size=(60, 3)) * 1e160
    for known, asked in ((spread, spread[:600] * 1.25), (tight, tight[::7]), (grid, grid[:90]), (broken, broken), (huge, huge), (spread[:3], spread[:2])):
        with np.errstate(all="ignore"):
            rows, cols, dist = ne.nearest_pairs(asked, known, 7)
            every = ne.distances(asked, known)
        best = np.argsort(every, axis=1, kind="stable")[:, :7]
        np.testing.assert_array_equal(rows, np.repeat(np.arange(len(asked)), best.shape[1]))
        np.testing.assert_array_equal(cols, best.ravel())
        np.testing.assert_array_equal(dist, np.take_along_axis(every, best, 1).ravel())
    taken = []
    rough = ne.Known.not_ruled_out
    monkeypatch.setattr(ne.Known, "not_ruled_out", lambda *a: taken.append(rough(*a)) or taken[-1])
    ne.nearest_pairs(spread[:600], spread, 7)
    assert sum(map(len, taken)) < 600 * len(spread) / 100


def test_a_query_is_sent_to_areas_not_to_rings(spark):
    """Vectors of many rings that no bound rules out go to one task each, not to one a ring."""
    rng = np.random.default_rng(13)
    x = rng.normal(size=(400, 12))
    refs = ne.distinct_vectors(vectors(spark, x / np.linalg.norm(x, axis=1, keepdims=True)), "id", "v")
    asked = refs.select(F.col("ref").alias("q"), "vec")
    made = []
    before = ne.written
    ne.written = lambda df, name: made.append((name, before(df, name))) or made[-1][1]
    try:
        out = ne.nearest(asked, refs, 3)
    finally:
        ne.written = before
    sent = dict(made)["visits"]
    assert sent.count() == 400 and sent.agg(F.max(F.size("areas"))).first()[0] == 1
    assert out.groupBy("q").count().where("count = 3").count() == 400


def test_rows_with_gaps_have_no_score_and_equal_vectors_share_one(spark):
    rng = np.random.default_rng(14)
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(rng.normal(size=(80, 3)))]
    rows += [(100, [0.0, -0.0, 1.0]), (101, [-0.0, 0.0, 1.0]), (102, [None, 1.0, 2.0]), (103, [1.0, None, 2.0])]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    scores = {r[0]: r[1] for r in ne.local_outlier_factor(df, df, "id", "v", 5, pivots=1).collect()}
    assert set(scores) == {*range(80), 100, 101} and scores[100] == scores[101]
