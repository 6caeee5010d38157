"""Registered queries: joins, profile, sequences, ranking, detection and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import detect as de
from ..operators import forest as fo
from ..operators import metrics as me
from ..operators import neighbours as ne
from ..operators import profile as po
from ..operators import sequences as se
from ..schemas import SENSORS, SETTINGS
from . import sqltext as q
from .batch_queries import TWO, rounded
from .bindings import ELEMENTS, matrix, readings, table, unit_cycles
from .registry import query

SEED = 42


def cycles(spark, folder) -> DataFrame:
    return readings(spark, folder).select("unit", "cycle", *TWO, "failure_label", "event_id")


# --- remaining life and windows --------------------------------------------------------------------


@query("train_rul_win5", f"WITH {q.READINGS} SELECT unit, cycle, max(cycle) OVER (PARTITION BY unit) - cycle AS rul FROM tv")
def _train_rul(spark, folder):
    return se.add_train_rul(cycles(spark, folder)).select("unit", "cycle", "rul")


@query(
    "attach_test_rul_joi1",
    f"WITH {q.READINGS}, t AS (SELECT unit, sum(failure_label) AS target FROM tv GROUP BY 1) "
    "SELECT unit, cycle, CAST(max(cycle) OVER (PARTITION BY unit) + target - cycle AS BIGINT) AS rul FROM tv JOIN t USING (unit)",
)
def _test_rul(spark, folder):
    rows = cycles(spark, folder)
    targets = rows.groupBy("unit").agg(F.sum("failure_label").alias("rul"))
    return se.add_test_rul(rows, targets).select("unit", "cycle", "rul")


@query(
    "units_without_target_joi1",
    "SELECT DISTINCT user_id AS unit FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE value > 200)",
)
def _no_target(spark, folder):
    rows = cycles(spark, folder)
    targets = rows.where("sensor_1 > 200").groupBy("unit").agg(F.count(F.lit(1)).alias("rul"))
    return se.units_without_target(rows, targets)


def _windows_sql(length: int, stride: int, outs: str, source: str = "tv", extra: str = "") -> str:
    return (
        f"p AS (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY cycle) - 1 AS place FROM {source}), "
        f"w AS (SELECT unit, place AS window_start_index, place + {length - 1} AS window_end_index, {length} AS window_length, "
        f"cycle AS cycle_start, last(cycle) OVER f AS cycle_end, count(*) OVER f AS n, {outs} FROM p "
        f"WINDOW f AS (PARTITION BY unit ORDER BY place ROWS BETWEEN CURRENT ROW AND {length - 1} FOLLOWING)), "
        f"s AS (SELECT * EXCLUDE (n) FROM w WHERE n = {length} AND window_start_index % {stride} = 0)"
    )


@query(
    "sequence_windows_win6",
    f"WITH {q.READINGS}, {_windows_sql(10, 3, 'max(failure_label) OVER f AS is_anomaly_window')} SELECT * FROM s",
)
def _windows(spark, folder):
    return se.sequence_windows(cycles(spark, folder), 10, 3, label="failure_label")


@query(
    "window_arrays_win6",
    f"WITH {q.READINGS}, {_windows_sql(5, 5, 'list(sensor_1) OVER f AS v, list(sensor_2) OVER f AS x')} "
    "SELECT unit, window_start_index, len(v) AS length, list_sum(v) AS first_total, x[1] AS first_value, x[5] AS last_value FROM s",
)
def _window_arrays(spark, folder):
    out = se.sequence_windows(cycles(spark, folder), 5, 5, features=TWO)
    total = F.aggregate("window", F.lit(0.0), lambda a, r: a + r[0])
    return out.select(
        "unit", "window_start_index", F.size("window").alias("length"), total.alias("first_total"),
        F.col("window")[0][1].alias("first_value"), F.col("window")[4][1].alias("last_value"),
    )


@query(
    "window_scores_win7",
    f"WITH {q.READINGS}, {_windows_sql(10, 2, 'max(failure_label) OVER f AS is_anomaly_window, max(sensor_1) OVER f AS sensor_1, max(sensor_2) OVER f AS sensor_2')} SELECT * FROM s",
)
def _window_scores(spark, folder):
    return se.sequence_windows(cycles(spark, folder), 10, 2, label="failure_label", scores=TWO)


def _target_sql(length: int, mode: str, horizon: int) -> str:
    last = "CAST(last(rul) OVER f AS DOUBLE)"
    target = f"{last} AS rul" if mode == "rul" else f"CAST({last} BETWEEN 1 AND {horizon} AS DOUBLE) AS {mode}"
    body = _windows_sql(length, 1, f"{last} AS target_rul, {target}", "uv")
    return (
        f"WITH {q.UNIT_CYCLES}, {body} SELECT unit, window_start_index, window_end_index, window_length AS window_size, cycle_start, cycle_end, "
        f"window_end_index AS target_index, cycle_end AS target_cycle, target_rul, {horizon} AS prediction_horizon, {mode} FROM s"
    )


@query("target_windows_win8", _target_sql(8, "rul", 8))
def _targets(spark, folder):
    return se.target_windows(unit_cycles(spark, folder), 8)


@query("failure_windows_win8", _target_sql(6, "failure_in_next_window", 12))
def _failures(spark, folder):
    return se.target_windows(unit_cycles(spark, folder), 6, mode="failure_in_next_window", horizon=12)


@query(
    "latest_per_unit_win9",
    f"WITH {q.UNIT_CYCLES} SELECT unit, cycle AS target_cycle, prediction FROM uv QUALIFY row_number() OVER (PARTITION BY unit ORDER BY cycle DESC) = 1",
)
def _latest(spark, folder):
    rows = unit_cycles(spark, folder).select("unit", F.col("cycle").alias("target_cycle"), "prediction")
    return se.latest_per_unit(rows)


@query("late_life_win10", f"WITH {q.READINGS} SELECT unit, cycle, cycle >= ceil(0.7 * max(cycle) OVER (PARTITION BY unit)) AS is_late_life FROM tv")
def _late(spark, folder):
    return se.late_life(cycles(spark, folder)).select("unit", "cycle", "is_late_life")


def _scaler_sql(source: str, features: list[str], length: int, stride: int) -> str:
    stats = " UNION ALL ".join(
        f"SELECT '{c}' AS feature, round(avg({c}), 6) AS center, round(CASE WHEN stddev_pop({c}) < 1e-12 THEN 1 ELSE stddev_pop({c}) END, 6) AS scale FROM x"
        for c in features
    )
    return (
        f"p AS (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY cycle) - 1 AS place, count(*) OVER (PARTITION BY unit) AS size FROM {source}), "
        f"o AS (SELECT *, unnest(range(greatest(0, place - {length - 1}), least(place, size - {length}) + 1)) AS start FROM p WHERE size >= {length}), "
        f"x AS (SELECT * FROM o WHERE start % {stride} = 0) {stats}"
    )


@query("sequence_scaler_win11", f"WITH {q.READINGS}, {_scaler_sql('tv', TWO, 12, 5)}")
def _scaler(spark, folder):
    return rounded(se.sequence_scaler(cycles(spark, folder), TWO, 12, 5))


@query(
    "scaled_rows_win11",
    f"WITH {q.READINGS}, m AS (WITH {_scaler_sql('tv', TWO, 12, 5)}) SELECT unit, cycle, "
    "round((sensor_1 - (SELECT center FROM m WHERE feature = 'sensor_1')) / (SELECT scale FROM m WHERE feature = 'sensor_1'), 3) AS sensor_1 FROM tv",
)
def _scaled(spark, folder):
    rows = cycles(spark, folder)
    out = se.apply_scaler(rows, rounded(se.sequence_scaler(rows, TWO, 12, 5)), TWO)
    return out.select("unit", "cycle", F.round("sensor_1", 3).alias("sensor_1"))


# --- joins -----------------------------------------------------------------------------------------

_WINDOW_KEYS = ["unit", "window_start_index", "window_end_index", "window_length", "cycle_start", "cycle_end", "is_anomaly_window"]


@query(
    "merged_window_scores_joi2",
    f"WITH {q.READINGS}, {_windows_sql(10, 2, 'max(failure_label) OVER f AS is_anomaly_window, max(sensor_1) OVER f AS sensor_1, max(sensor_2) OVER f AS sensor_2')} SELECT * FROM s",
)
def _merged(spark, folder):
    rows = cycles(spark, folder)
    first, second = (se.sequence_windows(rows, 10, 2, label="failure_label", scores=[s]) for s in TWO)
    return first.join(second, _WINDOW_KEYS, "left")


@query(
    "forecast_columns_joi3",
    f"WITH {q.UNIT_CYCLES} SELECT unit, cycle, rul, prediction, round(prediction * 0.5, 9) AS other FROM uv",
)
def _columns(spark, folder):
    rows = unit_cycles(spark, folder)
    left = rows.select("unit", "cycle", "rul", "prediction")
    right = rows.select("unit", "cycle", F.round(F.col("prediction") * 0.5, 9).alias("other"))
    return left.join(right, ["unit", "cycle"])


def _split_sql(fraction: float) -> str:
    return (
        f"h AS (SELECT unit, {q.row_hash('unit', '0', SEED)} AS hash FROM (SELECT DISTINCT unit FROM tv)), "
        f"v AS (SELECT unit, row_number() OVER (ORDER BY hash, unit) <= least(greatest(round_even(count(*) OVER () * {fraction}, 0), 1), count(*) OVER () - 1) AS held FROM h)"
    )


@query(
    "unit_split_joi8",
    f"WITH {q.READINGS}, {_split_sql(0.2)} SELECT unit, cycle, CASE WHEN held THEN 'validation' ELSE 'train' END AS split FROM tv JOIN v USING (unit)",
)
def _unit_split(spark, folder):
    train, held = se.split_by_unit(cycles(spark, folder), 0.2, SEED)
    parts = [df.select("unit", "cycle", F.lit(n).alias("split")) for df, n in ((train, "train"), (held, "validation"))]
    return parts[0].unionByName(parts[1])


@query("validation_units_rul1", f"WITH {q.READINGS}, {_split_sql(0.4)} SELECT unit FROM v WHERE held")
def _held(spark, folder):
    return se.split_by_unit(cycles(spark, folder), 0.4, SEED)[1].select("unit").distinct()


# --- profile ---------------------------------------------------------------------------------------


@query(
    "unit_summary_agg1",
    f"WITH {q.MATRIX} SELECT unit, max(cycle) AS cycles, count(DISTINCT setting_1) AS unique_settings_1, count(DISTINCT setting_2) AS unique_settings_2, "
    "count(DISTINCT setting_3) AS unique_settings_3 FROM ev GROUP BY unit",
)
def _unit_summary(spark, folder):
    return po.unit_summary(matrix(spark, folder))


_NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(
    "describe_columns_agg2",
    " UNION ALL ".join(
        f"SELECT '{c}' AS feature, count({c}) AS count, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, min({c}) AS min, max({c}) AS max, "
        f"round(quantile_cont({c}, 0.25), 4) AS q25, round(quantile_cont({c}, 0.5), 4) AS q50, round(quantile_cont({c}, 0.75), 4) AS q75 FROM lineitem"
        for c in _NUMERIC
    ),
)
def _describe(spark, folder):
    return rounded(po.describe_columns(table(spark, folder, "lineitem"), _NUMERIC), 4)


@query(
    "cycle_summary_agg3",
    "WITH m AS (SELECT user_id, count(*) AS life FROM events GROUP BY 1) SELECT count(*) AS units, min(life) AS min_cycles, "
    "CAST(floor(median(life)) AS BIGINT) AS median_cycles, max(life) AS max_cycles FROM m",
)
def _cycle_summary(spark, folder):
    return po.cycle_summary(cycles(spark, folder))


@query(
    "constant_columns_agg4",
    "SELECT c AS \"column\" FROM (SELECT 'fixed' AS c, count(*) FROM lineitem UNION ALL SELECT 'empty', count(*) FROM lineitem)",
)
def _constant(spark, folder):
    rows = table(spark, folder, "lineitem").withColumns(
        {"fixed": F.lit(7.0), "empty": F.lit(None).cast("double"), "holed": F.when(F.col("l_tax") > 0, 1)}
    )
    return po.constant_columns(rows, exclude=("l_orderkey",))


@query(
    "sensor_variability_agg5",
    " UNION ALL ".join(f"SELECT '{c}' AS sensor, round(stddev_samp({c}), 4) AS std, count(DISTINCT {c}) AS distinct_values FROM lineitem" for c in _NUMERIC),
)
def _variability(spark, folder):
    return rounded(po.sensor_variability(table(spark, folder, "lineitem"), _NUMERIC), 4)


@query(
    "sensor_degradation_agg6",
    f"WITH {q.READINGS}, l AS ({q.unpivot('tv', ['unit', 'cycle'], TWO)}), e AS (SELECT unit, sensor, arg_max(value, cycle) - arg_min(value, cycle) AS change FROM l GROUP BY 1, 2) "
    "SELECT sensor, round(avg(change), 6) AS avg_end_minus_start FROM e GROUP BY 1",
)
def _degradation(spark, folder):
    return rounded(po.sensor_degradation(cycles(spark, folder), TWO))


_SERIES_SQL = f"""WITH {q.READINGS},
c AS (SELECT unit, list(sensor_1 ORDER BY cycle) AS v, count(*) AS n, avg(sensor_1) AS m FROM tv GROUP BY 1),
k AS (SELECT unit, v, n, m, unnest(range(1, n // 2 + 1)) AS f FROM c),
a AS (SELECT unit, sqrt(pow(list_sum(list_transform(range(0, n), lambda j: (v[j + 1] - m) * cos(2 * pi() * f * j / n))), 2) +
  pow(list_sum(list_transform(range(0, n), lambda j: (v[j + 1] - m) * sin(2 * pi() * f * j / n))), 2)) AS amp FROM k),
s AS (SELECT unit, list(amp ORDER BY amp DESC) AS amps FROM a GROUP BY 1)
SELECT unit, 'sensor_1' AS sensor, 0 AS segment, {', '.join(f'round(amps[{i}], 4) AS fft_amp_{i}' for i in range(1, 6))} FROM c LEFT JOIN s USING (unit)"""


@query("series_spectrum_agg7", _SERIES_SQL)
def _series(spark, folder):
    return po.series_spectrum(cycles(spark, folder), ["sensor_1"])


def _read_off_sql(stat: str, levels) -> str:
    steps = "".join(
        f" WHEN {stat} <= {high} THEN {first} + ({second} - {first}) * ({stat} - ({low})) / ({high} - ({low}))"
        for (low, first), (high, second) in zip(levels, levels[1:], strict=False)
    )
    return f"CASE WHEN {stat} <= {levels[0][0]} THEN {levels[0][1]}{steps} WHEN {stat} IS NOT NULL THEN {levels[-1][1]} END"


# The level's coefficient from residuals: change and level are both freed from the lagged change first.
_STATIONARITY_SQL = f"""WITH {q.READINGS},
x AS (SELECT unit, sensor, value, row_number() OVER (PARTITION BY unit, sensor ORDER BY cycle) AS j, count(*) OVER u AS n,
  value - avg(value) OVER u AS e, max(value) OVER u = min(value) OVER u AS flat
  FROM ({q.unpivot('tv', ['unit', 'cycle'], TWO)}) WHERE value IS NOT NULL WINDOW u AS (PARTITION BY unit, sensor)),
s AS (SELECT *, sum(e) OVER (PARTITION BY unit, sensor ORDER BY j) AS s, ceil(12 * pow(n / 100.0, 0.25)) AS l FROM x),
k AS (SELECT a.unit, a.sensor, sum(2.0 * (1.0 - (b.j - a.j) / (a.l + 1.0)) * a.e * b.e) AS c
  FROM s a JOIN s b ON a.unit = b.unit AND a.sensor = b.sensor AND b.j > a.j AND b.j - a.j <= a.l GROUP BY 1, 2),
t AS (SELECT unit, sensor, max(n) AS n, bool_or(flat) AS flat, sum(s * s) AS ss, sum(e * e) AS ee FROM s GROUP BY 1, 2),
level_test AS (SELECT unit, sensor, CASE WHEN n >= 4 AND NOT flat THEN (ss / (n * n)) / (ee / n + c / n) END AS kpss FROM t LEFT JOIN k USING (unit, sensor)),
d AS (SELECT unit, sensor, flat, j, lag(value) OVER w AS v, value - lag(value) OVER w AS y, lag(value) OVER w - lag(value, 2) OVER w AS p
  FROM x WINDOW w AS (PARTITION BY unit, sensor ORDER BY j)),
g AS (SELECT unit, sensor, v - coalesce(regr_slope(v, p) OVER u * (p - avg(p) OVER u), 0) - avg(v) OVER u AS rv,
  y - coalesce(regr_slope(y, p) OVER u * (p - avg(p) OVER u), 0) - avg(y) OVER u AS ry FROM d WHERE j > 2 AND NOT flat WINDOW u AS (PARTITION BY unit, sensor)),
h AS (SELECT unit, sensor, count(*) AS m, sum(rv * rv) AS vv, sum(rv * ry) AS vy, sum(ry * ry) AS yy FROM g GROUP BY 1, 2),
root AS (SELECT unit, sensor, CASE WHEN m >= 5 THEN (vy / vv) / sqrt((yy - vy * vy / vv) / greatest(m - 3, 1) / vv) END AS adf FROM h)
SELECT unit, sensor, 0 AS segment, round(adf, 6) AS adf_stat, round({_read_off_sql('adf', po.UNIT_ROOT_LEVELS)}, 6) AS adf_pvalue,
  round(kpss, 6) AS kpss_stat, round({_read_off_sql('kpss', po.KPSS_LEVELS)}, 6) AS kpss_pvalue,
  round({_read_off_sql('adf', po.UNIT_ROOT_LEVELS)}, 6) < 0.05 AS adf_stationary, round({_read_off_sql('kpss', po.KPSS_LEVELS)}, 6) >= 0.05 AS kpss_stationary
FROM level_test LEFT JOIN root USING (unit, sensor)"""


@query("stationarity_agg8", _STATIONARITY_SQL)
def _stationarity(spark, folder):
    return po.stationarity(cycles(spark, folder), TWO)


_LEVEL_SQL = f"""WITH {q.READINGS},
e AS (SELECT unit, cycle, count(*) OVER u AS n, sensor_1 - avg(sensor_1) OVER u AS e FROM tv WINDOW u AS (PARTITION BY unit)),
s AS (SELECT *, sum(e) OVER (PARTITION BY unit ORDER BY cycle) AS s, ceil(12 * pow(n / 100.0, 0.25)) AS l FROM e),
k AS (SELECT a.unit, sum(2.0 * (1.0 - (b.cycle - a.cycle) / (a.l + 1.0)) * a.e * b.e) AS c FROM s a JOIN s b ON a.unit = b.unit AND b.cycle > a.cycle AND b.cycle - a.cycle <= a.l GROUP BY 1),
t AS (SELECT unit, max(n) AS n, sum(s * s) AS ss, sum(e * e) AS ee FROM s GROUP BY 1),
r AS (SELECT unit, (ss / (n * n)) / (ee / n + c / n) AS kpss_stat FROM t JOIN k USING (unit))
SELECT unit, 'sensor_1' AS sensor, round(kpss_stat, 6) AS kpss_stat, kpss_stat <= 0.463 AS kpss_stationary FROM r"""


@query("level_stationarity_agg8", _LEVEL_SQL)
def _level(spark, folder):
    out = po.stationarity(cycles(spark, folder), ["sensor_1"])
    return out.select("unit", "sensor", "kpss_stat", "kpss_stationary")


_WIDE = ELEMENTS


@query(
    "zscore_reference_agg9",
    f"WITH {q.WIDE_MATRIX} " + " UNION ALL ".join(f"SELECT '{c}' AS feature, round(avg({c}), 6) AS center, round(stddev_pop({c}), 6) AS scale FROM ev" for c in _WIDE),
)
def _zscore(spark, folder):
    return rounded(de.zscore_reference(matrix(spark, folder, _WIDE), _WIDE))


def _mad_sql(source: str, columns: list[str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS feature, round(max(m), 6) AS center, round(CASE WHEN 1.4826 * median(abs({c} - m)) < 1e-12 THEN 1 ELSE 1.4826 * median(abs({c} - m)) END, 6) AS scale "
        f"FROM {source}, (SELECT median({c}) AS m FROM {source})"
        for c in columns
    )


@query("mad_reference_agg10", _mad_sql("lineitem", ["l_quantity", "l_extendedprice"]))
def _mad(spark, folder):
    return rounded(de.mad_reference(table(spark, folder, "lineitem"), ["l_quantity", "l_extendedprice"]))


@query("upper_threshold_agg11", "SELECT round(quantile_cont(value, 0.92), 6) AS threshold FROM events")
def _upper(spark, folder):
    return rounded(de.upper_threshold(table(spark, folder, "events"), "value", 0.08))


@query(
    "cycle_curve_agg12",
    f"WITH {q.UNIT_CYCLES} SELECT strftime(DATE '2000-01-01' + CAST(cycle - 1 AS INTEGER), '%Y-%m-%d') AS ds, cycle AS target_cycle, round(avg(rul), 6) AS y FROM uv GROUP BY cycle",
)
def _curve(spark, folder):
    from ..operators.forecast import cycle_curve

    out = cycle_curve(unit_cycles(spark, folder).withColumn("target_cycle", F.col("cycle")), "rul")
    return rounded(out.withColumn("ds", F.date_format("ds", "yyyy-MM-dd")))


@query(
    "split_summary_agg13",
    f"WITH {q.READINGS}, {_split_sql(0.2)}, u AS (SELECT *, max(cycle) OVER (PARTITION BY unit) - cycle AS rul FROM tv), {_windows_sql(10, 1, 'last(rul) OVER f AS rul', 'u')} "
    "SELECT CASE WHEN held THEN 'validation' ELSE 'train' END AS split, count(*) AS windows, count(DISTINCT unit) AS units, min(cycle_end) AS min_cycle, max(cycle_end) AS max_cycle, "
    "count(*) FILTER (rul >= 0.5) AS positive, count(*) FILTER (rul < 0.5) AS negative, CAST(min(rul) AS DOUBLE) AS min_target, CAST(max(rul) AS DOUBLE) AS max_target FROM s JOIN v USING (unit) GROUP BY 1",
)
def _split_summary(spark, folder):
    prepared = se.prepared_sequences(cycles(spark, folder), features=TWO, length=10, validation_fraction=0.2, seed=SEED)
    return se.split_summary(prepared, "rul")


@query("label_counts_agg14", "SELECT event_type, CAST(event_type = 'error' AS INTEGER) AS failure_label, count(*) AS rows FROM events GROUP BY 1, 2")
def _labels(spark, folder):
    rows = table(spark, folder, "events").withColumn("failure_label", (F.col("event_type") == "error").cast("int"))
    return po.label_composition(rows, ["event_type", "failure_label"])


_PREPARED_SQL = (
    f"WITH {q.READINGS}, {_split_sql(0.2)}, u AS (SELECT tv.*, held, max(cycle) OVER (PARTITION BY unit) - cycle AS rul FROM tv JOIN v USING (unit)), "
    f"fit AS (SELECT * FROM u WHERE NOT held), m AS (WITH {_scaler_sql('fit', TWO, 10, 2)}), "
    "z AS (SELECT unit, cycle, rul, held, (sensor_1 - (SELECT center FROM m WHERE feature = 'sensor_1')) / (SELECT scale FROM m WHERE feature = 'sensor_1') AS x FROM u), "
    f"{_windows_sql(10, 2, 'last(rul) OVER f AS rul, held, avg(x) OVER f AS mean_x', 'z')} "
    "SELECT CASE WHEN held THEN 'validation' ELSE 'train' END AS split, unit, cycle_end AS target_cycle, CAST(rul AS DOUBLE) AS rul, round(mean_x, 3) AS mean_x FROM s"
)


@query("prepared_sequences_rul2", _PREPARED_SQL)
def _prepared(spark, folder):
    out = se.prepared_sequences(cycles(spark, folder), features=TWO, length=10, stride=2, validation_fraction=0.2, seed=SEED)
    mean = F.aggregate("window", F.lit(0.0), lambda a, r: a + r[0]) / 10
    return out.select("split", "unit", "target_cycle", "rul", F.round(mean, 3).alias("mean_x"))


# --- ranking and sets ------------------------------------------------------------------------------


def curve_sql() -> str:
    long = q.unpivot("tv", ["failure_label"], TWO, "model_key", "threshold")
    return (
        f"{q.READINGS}, l AS ({long}), g AS (SELECT model_key, threshold, count(*) FILTER (failure_label = 1) AS pos, count(*) FILTER (failure_label = 0) AS neg FROM l GROUP BY 1, 2), "
        "k AS (SELECT *, CAST(sum(pos) OVER w AS BIGINT) AS tp, CAST(sum(neg) OVER w AS BIGINT) AS fp, CAST(sum(pos) OVER (PARTITION BY model_key) AS BIGINT) AS p, "
        "CAST(sum(neg) OVER (PARTITION BY model_key) AS BIGINT) AS n FROM g WINDOW w AS (PARTITION BY model_key ORDER BY threshold DESC))"
    )


@query(
    "best_models_top3",
    f"WITH {curve_sql()}, r AS (SELECT model_key, sum(neg * (tp - pos + pos / 2.0)) / (max(p) * max(n)) AS roc_auc, sum(pos / p * (tp / (tp + fp))) AS pr_auc FROM k GROUP BY 1), "
    "b AS (SELECT model_key, threshold, 2.0 * tp / (tp + fp + p) AS f1, tp, fp FROM k QUALIFY row_number() OVER (PARTITION BY model_key ORDER BY 2.0 * tp / (tp + fp + p) DESC, threshold) = 1) "
    "SELECT model_key, round(roc_auc, 9) AS roc_auc, round(pr_auc, 9) AS pr_auc, threshold, round(f1, 9) AS f1, tp, fp, row_number() OVER (ORDER BY f1 DESC, pr_auc DESC, model_key) AS place FROM r JOIN b USING (model_key)",
)
def _best(spark, folder):
    report = me.anomaly_report(cycles(spark, folder), "failure_label", TWO)
    # one row per score column
    placed = report.withColumn("place", F.row_number().over(W.orderBy(F.desc("f1"), F.desc("pr_auc"), "model_key")).cast("long"))
    named = placed.select("model_key", "roc_auc", "pr_auc", "threshold", "f1", "tp", "fp", "place")
    return named.withColumns({c: F.round(c, 9) for c in ("roc_auc", "pr_auc", "f1")})


@query(
    "top_sensors_top4",
    "SELECT sensor, rows FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS sensor, stddev_samp({c}) AS std, count(*) AS rows FROM lineitem" for c in _NUMERIC) + ") ORDER BY std DESC LIMIT 2",
)
def _top(spark, folder):
    rows = table(spark, folder, "lineitem")
    best = po.top_sensors(po.sensor_variability(rows, _NUMERIC), [F.desc("std"), "sensor"], 2)
    long = po.unpivot_sensors(rows, [], _NUMERIC)
    return long.join(F.broadcast(best.select("sensor")), "sensor", "left_semi").groupBy("sensor").agg(F.count(F.lit(1)).alias("rows"))


# --- detection -------------------------------------------------------------------------------------


def _injected_sql(append: bool) -> str:
    h = lambda salt: q.row_hash("unit", "cycle", salt)
    n = len(ELEMENTS)
    ranks = ", ".join(h(SEED + 1000 + i) for i in range(1, n + 1))
    outs = []
    for i, s in enumerate(ELEMENTS, start=1):
        u1, u2 = q.uniform("unit", "cycle", SEED + 2000 + i), q.uniform("unit", "cycle", SEED + 2500 + i)
        noise = f"sqrt(-2.0 * ln({u1})) * cos(2.0 * pi() * {u2})"
        share = f"(0.01 + 0.07 * {q.uniform('unit', 'cycle', SEED + 3000 + i)})"
        new = f"CASE kind WHEN 'spike' THEN {s} + 24.0 + 4.5 * {noise} WHEN 'dropout' THEN {s} * {share} ELSE {s} + 10.0 + 2.0 * {noise} END"
        outs.append(f"round(CASE WHEN chosen AND ranks[{i}] <= cut THEN {new} ELSE {s} END, 5) AS {s}")
    base = (
        f"{q.WIDE_MATRIX}, a AS (SELECT *, {h(SEED)} AS hash, cycle >= ceil(0.7 * max(cycle) OVER (PARTITION BY unit)) AS late FROM ev), "
        "b AS (SELECT *, late AND row_number() OVER (PARTITION BY late ORDER BY hash, unit, cycle) <= greatest(1, round_even((SELECT count(*) FROM ev) * 0.08, 0)) AS chosen FROM a), "
        f"c AS (SELECT *, ['spike', 'dropout', 'drift_jump'][{h(SEED + 1)} % 3 + 1] AS kind, [{ranks}] AS ranks FROM b), "
        "d AS (SELECT *, list_sort(ranks)[CASE kind WHEN 'spike' THEN 4 WHEN 'dropout' THEN 3 ELSE 6 END] AS cut FROM c), "
        f"inj AS (SELECT unit, cycle, {', '.join(outs)}, CAST(chosen AS INTEGER) AS is_anomaly, CASE WHEN chosen THEN kind ELSE 'normal' END AS injected_anomaly_type FROM d)"
    )
    if not append:
        return base
    clean = ", ".join(f"round({s}, 5) AS {s}" for s in ELEMENTS)
    return base + f", app AS (SELECT unit, cycle, {clean}, 0 AS is_anomaly, 'normal' AS injected_anomaly_type FROM ev UNION ALL SELECT * FROM inj WHERE is_anomaly = 1)"


def _injected(spark, folder, append: bool) -> DataFrame:
    holdout = matrix(spark, folder, ELEMENTS).select("unit", "cycle", *ELEMENTS)
    return de.inject_anomalies(holdout, 0.08, SEED, ELEMENTS, append)


@query("inject_anomalies_ano1", f"WITH {_injected_sql(False)} SELECT * FROM inj")
def _inject(spark, folder):
    return rounded(_injected(spark, folder, False), 5)


@query("append_anomalies_set1", f"WITH {_injected_sql(True)} SELECT * FROM app")
def _append(spark, folder):
    return rounded(_injected(spark, folder, True), 5)


@query(
    "paired_changes_joi7",
    f"WITH {_injected_sql(True)}, l AS ({q.unpivot('app', ['unit', 'cycle', 'is_anomaly', 'injected_anomaly_type'], ELEMENTS)}), "
    "j AS (SELECT a.unit, a.cycle, a.injected_anomaly_type, a.sensor, c.value AS clean, a.value AS anomalous, a.value - c.value AS delta, "
    "row_number() OVER (PARTITION BY a.unit, a.cycle ORDER BY abs(a.value - c.value) DESC, a.sensor) AS rank FROM l a JOIN l c USING (unit, cycle, sensor) WHERE a.is_anomaly = 1 AND c.is_anomaly = 0) "
    "SELECT unit, cycle, injected_anomaly_type, sensor, round(delta, 7) AS delta FROM j WHERE rank <= 3",
)
def _paired(spark, folder):
    pairs = de.paired_changes(rounded(_injected(spark, folder, True), 5), ELEMENTS, top=3)
    return pairs.select("unit", "cycle", "injected_anomaly_type", "sensor", F.round("delta", 7).alias("delta"))


def _distance(map_sql: str, source: str, features: list[str], name: str) -> str:
    squares = " + ".join(
        f"pow(({c} - (SELECT center FROM {map_sql} WHERE feature = '{c}')) / (SELECT scale FROM {map_sql} WHERE feature = '{c}'), 2)" for c in features
    )
    return f"round(sqrt(({squares}) / {len(features)}), 4) AS {name}"


_SCORED = ["l_quantity", "l_extendedprice", "l_tax"]


@query(
    "statistical_scores_ano2",
    "WITH z AS (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, avg({c}) AS center, stddev_pop({c}) AS scale FROM lineitem" for c in _SCORED) + "), "
    f"m AS ({_mad_sql('lineitem', _SCORED).replace('round(max(m), 6)', 'max(m)')}) "
    f"SELECT l_orderkey, l_linenumber, l_partkey, {_distance('z', 'lineitem', _SCORED, 'zscore_score')}, {_distance('m', 'lineitem', _SCORED, 'mad_score')} FROM lineitem",
)
def _scores(spark, folder):
    rows = table(spark, folder, "lineitem")
    out = de.score_statistics(rows, rows, _SCORED)
    return rounded(out.select("l_orderkey", "l_linenumber", "l_partkey", "zscore_score", "mad_score"), 4)


@query(
    "standardize_ano3",
    "SELECT l_orderkey, l_partkey, l_linenumber, round((l_quantity - (SELECT avg(l_quantity) FROM lineitem)) / (SELECT stddev_pop(l_quantity) FROM lineitem), 6) AS l_quantity FROM lineitem",
)
def _standardize(spark, folder):
    rows = table(spark, folder, "lineitem")
    out = de.standardize(rows, rows, ["l_quantity"])
    return out.select("l_orderkey", "l_partkey", "l_linenumber", F.round("l_quantity", 6).alias("l_quantity"))


@query("reconstruction_scores_ano6")
def _reconstruction(spark, folder):
    train = matrix(spark, folder).select("unit", "cycle", *SENSORS)
    return de.reconstruction_scores(train, _injected(spark, folder, False), SENSORS, length=10, stride=2)[0]


_LOF_K = 10


def _lof_sql(k: int) -> str:
    return (
        "WITH t AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), e AS (SELECT vec_id, list_transform(v, lambda x: x * 1.25) AS v FROM t), "
        "tn AS (SELECT a.vec_id AS q, b.vec_id AS r, list_distance(a.v, b.v) AS d, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.v, b.v), b.vec_id) AS p FROM t a JOIN t b ON a.vec_id <> b.vec_id), "
        f"kt AS (SELECT * FROM tn WHERE p <= {k}), kd AS (SELECT q AS r, max(d) AS reach FROM kt GROUP BY 1), "
        "td AS (SELECT q, 1.0 / (avg(greatest(d, reach)) + 1e-10) AS lrd FROM kt JOIN kd USING (r) GROUP BY 1), "
        "en AS (SELECT a.vec_id AS q, b.vec_id AS r, list_distance(a.v, b.v) AS d, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.v, b.v), b.vec_id) AS p FROM e a CROSS JOIN t b), "
        f"ke AS (SELECT * FROM en WHERE p <= {k}), "
        "ed AS (SELECT q, 1.0 / (avg(greatest(d, reach)) + 1e-10) AS lrd FROM ke JOIN kd USING (r) GROUP BY 1), "
        "s AS (SELECT ke.q, avg(td.lrd) AS mean FROM ke JOIN td ON ke.r = td.q GROUP BY 1) "
    )


def _stretched(spark, folder) -> tuple[DataFrame, DataFrame]:
    train = table(spark, folder, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    return train, train.withColumn("v", F.transform("v", lambda x: x * 1.25))


@query("nearest_join_joi9", _lof_sql(5) + "SELECT q, r AS ref, p AS place, round(d, 6) AS dist FROM ke")
def _nearest(spark, folder):
    train, asked = _stretched(spark, folder)
    refs = ne.distinct_vectors(train, "vec_id", "v")
    out = ne.nearest(asked.select(F.col("vec_id").alias("q"), F.col("v").alias("vec")), refs, 5)
    return out.select("q", "ref", (F.col("place") + 1).alias("place"), F.round("dist", 6).alias("dist"))


@query("local_outlier_factor_ano5", _lof_sql(_LOF_K) + "SELECT s.q AS vec_id, round(mean / lrd, 5) AS local_outlier_factor_score FROM s JOIN ed USING (q)")
def _lof(spark, folder):
    train, asked = _stretched(spark, folder)
    return rounded(ne.local_outlier_factor(train, asked, "vec_id", "v", _LOF_K), 5)


@query("isolation_forest_ano4")
def _forest(spark, folder):
    train = matrix(spark, folder, ELEMENTS)
    rows = _injected(spark, folder, False)
    out = fo.isolation_scores(train, rows, "vec_id", ELEMENTS)
    return out.select("unit", "cycle", "is_anomaly", "isolation_forest_score")


# --- evaluation ------------------------------------------------------------------------------------


def _score_curve(spark, folder):
    return me.score_curve(cycles(spark, folder), "failure_label", TWO)


@query(
    "roc_auc_eva1",
    f"WITH {curve_sql()} SELECT model_key, round(sum(neg * (tp - pos + pos / 2.0)) / (max(p) * max(n)), 9) AS roc_auc FROM k GROUP BY 1",
)
def _roc_auc(spark, folder):
    return rounded(me.ranking_metrics(_score_curve(spark, folder)).select("model_key", "roc_auc"), 9)


@query(
    "average_precision_eva2",
    f"WITH {curve_sql()} SELECT model_key, round(sum(pos / p * (tp / (tp + fp))), 9) AS pr_auc, count(*) + 1 AS pr_curve_points FROM k GROUP BY 1",
)
def _average_precision(spark, folder):
    return rounded(me.ranking_metrics(_score_curve(spark, folder)).select("model_key", "pr_auc", "pr_curve_points"), 9)


@query(
    "pr_curve_eva3",
    f"WITH {curve_sql()} SELECT model_key, threshold, round(tp / (tp + fp), 9) AS precision, round(tp / p, 9) AS recall FROM k "
    "UNION ALL SELECT DISTINCT model_key, CAST(NULL AS DOUBLE), 1.0, 0.0 FROM k",
)
def _pr_curve(spark, folder):
    return me.pr_curve(_score_curve(spark, folder)).select("model_key", "threshold", F.round("precision", 9).alias("precision"), F.round("recall", 9).alias("recall"))


@query("roc_curve_eva3", f"WITH {curve_sql()} SELECT model_key, threshold, round(fp / n, 9) AS fpr, round(tp / p, 9) AS tpr FROM k")
def _roc_curve(spark, folder):
    return me.roc_curve(_score_curve(spark, folder)).select("model_key", "threshold", F.round("fpr", 9).alias("fpr"), F.round("tpr", 9).alias("tpr"))


@query(
    "best_threshold_eva4",
    f"WITH {curve_sql()} SELECT model_key, threshold, round(tp / (tp + fp), 9) AS precision, round(tp / p, 9) AS recall, round(2.0 * tp / (tp + fp + p), 9) AS f1, "
    "round(fp / n, 9) AS false_alarm_rate, tp, fp, n - fp AS tn, p - tp AS fn FROM k QUALIFY row_number() OVER (PARTITION BY model_key ORDER BY 2.0 * tp / (tp + fp + p) DESC, threshold) = 1",
)
def _best_threshold(spark, folder):
    out = me.best_thresholds(_score_curve(spark, folder))
    rates = ["precision", "recall", "f1", "false_alarm_rate"]
    return out.withColumns({c: F.round(c, 9) for c in rates})


@query(
    "regression_metrics_eva5",
    f"WITH {q.UNIT_CYCLES} SELECT round(sqrt(avg(pow(rul - prediction, 2))), 5) AS rmse, round(avg(abs(rul - prediction)), 5) AS mae, "
    "round(1 - sum(pow(rul - prediction, 2)) / sum(pow(rul - m, 2)), 5) AS r2 FROM uv, (SELECT avg(rul) AS m FROM uv)",
)
def _regression(spark, folder):
    return rounded(me.regression_metrics(unit_cycles(spark, folder), "rul", "prediction"), 5)


@query(
    "rul_report_eva6",
    f"WITH {q.UNIT_CYCLES}, e AS (SELECT rul, abs(rul - prediction) AS e FROM uv) SELECT count(*) AS row_count, round(sqrt(avg(e * e)), 5) AS rmse, round(avg(e), 5) AS mae, "
    "round(1 - sum(e * e) / (var_pop(rul) * count(*)), 5) AS r2, round(avg(e / rul) FILTER (rul <> 0), 5) AS mape, round(100 * avg(e / rul) FILTER (rul <> 0), 5) AS mape_percent, "
    "round(median(e), 5) AS median_absolute_error, round(avg(CAST(e <= 10 AS DOUBLE)), 5) AS within_10_cycles_rate, round(avg(CAST(e <= 20 AS DOUBLE)), 5) AS within_20_cycles_rate FROM e",
)
def _rul_report(spark, folder):
    return rounded(me.rul_report(unit_cycles(spark, folder)), 5)


@query(
    "classification_metrics_eva7",
    f"WITH {curve_sql()}, s AS (SELECT failure_label AS y, CAST(sensor_2 >= 50 AS INTEGER) AS h FROM tv) SELECT round(avg(CAST(y = h AS DOUBLE)), 9) AS accuracy, "
    "round(count(*) FILTER (y = 1 AND h = 1) / count(*) FILTER (h = 1), 9) AS precision, round(count(*) FILTER (y = 1 AND h = 1) / count(*) FILTER (y = 1), 9) AS recall, "
    "(SELECT round(sum(neg * (tp - pos + pos / 2.0)) / (max(p) * max(n)), 9) FROM k WHERE model_key = 'sensor_2') AS roc_auc, "
    "(SELECT round(sum(pos / p * (tp / (tp + fp))), 9) FROM k WHERE model_key = 'sensor_2') AS pr_auc FROM s",
)
def _classification(spark, folder):
    return rounded(me.classification_metrics(cycles(spark, folder), "failure_label", "sensor_2", 50.0), 9)


_CALIBRATION_SQL = f"""WITH {q.UNIT_CYCLES},
e AS (SELECT list_distinct(quantile_cont(prediction, [{', '.join(str(i / 10) for i in range(11))}])) AS e FROM uv),
b AS (SELECT rul, prediction, len(list_filter(list_sort(e)[2:len(e) - 1], lambda x: x < prediction)) AS bin FROM uv, e),
g AS (SELECT abs(avg(rul) - avg(prediction)) AS gap FROM b GROUP BY bin)
SELECT round(regr_slope(rul, prediction), 5) AS calibration_slope, round(regr_intercept(rul, prediction), 5) AS calibration_intercept,
  (SELECT round(avg(gap), 5) FROM g) AS calibration_mae FROM uv"""


@query("calibration_eva8", _CALIBRATION_SQL)
def _calibration(spark, folder):
    return rounded(me.calibration(unit_cycles(spark, folder), "rul", "prediction"), 5)


@query(
    "compare_predictions_eva9",
    f"WITH {q.UNIT_CYCLES}, l AS (SELECT rul, 'prediction' AS model_key, prediction AS p FROM uv UNION ALL SELECT rul, 'sensor_2', sensor_2 FROM uv) "
    "SELECT model_key, round(sqrt(avg(pow(rul - p, 2))), 5) AS rmse, round(avg(abs(rul - p)), 5) AS mae, round(1 - sum(pow(rul - p, 2)) / (var_pop(rul) * count(*)), 5) AS r2 FROM l GROUP BY 1",
)
def _compare(spark, folder):
    return rounded(me.compare_predictions(unit_cycles(spark, folder), "rul", ["prediction", "sensor_2"]), 5)
