"""Data profile: unit summaries, column statistics, degradation, spectrum and stationarity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.joins import attach_facts
from ..functions.ordered import CYCLE_BUCKET, row_index, with_neighbours
from ..functions.quantiles import exact_medians, exact_quantiles, to_long
from ..schemas import SETTINGS
from .features import unpivot_sensors
from .spectrum import WHOLE, largest_amplitudes

#: What tells one series from another.
SERIES = ["unit", "sensor", "segment"]


def unit_summary(df: DataFrame, settings: list[str] | None = None) -> DataFrame:
    """Last cycle and number of distinct settings per unit."""
    settings = settings or SETTINGS
    return df.groupBy("unit").agg(
        F.max("cycle").alias("cycles"),
        *[F.count_distinct(c).alias(f"unique_{c.replace('setting_', 'settings_')}") for c in settings],
    )


def describe_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """count, mean, sample std, min, exact quartiles and max per column."""
    long = to_long(df, columns)
    quartiles = (
        exact_quantiles(long, [0.25, 0.5, 0.75])
        .groupBy("feature")
        .agg(*[F.max(F.when(F.col("probability") == p, F.col("quantile"))).alias(n) for n, p in
               (("q25", 0.25), ("q50", 0.5), ("q75", 0.75))])
    )
    basic = long.groupBy("feature").agg(
        F.count(F.lit(1)).alias("count"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )
    return basic.join(quartiles, "feature")


def cycle_summary(df: DataFrame) -> DataFrame:
    """Units, and min, median and max of their last cycle as whole numbers."""
    lives = df.groupBy("unit").agg(F.max("cycle").cast("double").alias("life"))
    median = exact_medians(lives.select(F.lit("life").alias("feature"), F.col("life").alias("value")))
    return lives.agg(
        F.count(F.lit(1)).alias("units"),
        F.min("life").cast("long").alias("min_cycles"),
        F.max("life").cast("long").alias("max_cycles"),
    ).withColumn("median_cycles", median.select("median").scalar().cast("long"))


def constant_columns(df: DataFrame, exclude: tuple[str, ...] = ()) -> DataFrame:
    """Columns with at most one distinct value, null counting as a value; one pass, no distinct."""
    columns = [c for c in df.columns if c not in exclude]
    tests = [
        (F.min(c).eqNullSafe(F.max(c)) & (F.count_if(F.isnull(c)).isin(0) | (F.count(c) == 0))).alias(c) for c in columns
    ]
    row = df.agg(*tests)
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("constant")) for c in columns])
    return row.select(F.explode(pairs).alias("p")).where("p.constant").select("p.column")


def sensor_variability(df: DataFrame, sensors: list[str], approximate: bool = False) -> DataFrame:
    """Sample std and distinct values per sensor, most variable first."""
    distinct = F.approx_count_distinct if approximate else F.count_distinct
    long = unpivot_sensors(df, [], sensors)
    ranked = long.groupBy("sensor").agg(F.stddev_samp("value").alias("std"), distinct("value").alias("distinct_values"))
    return ranked.orderBy(F.desc("std"), F.desc("distinct_values"), "sensor")


def sensor_degradation(df: DataFrame, sensors: list[str]) -> DataFrame:
    """Mean over units of last minus first non-null value per sensor, largest change first."""
    long = unpivot_sensors(df, ["unit", "cycle"], sensors).where("value IS NOT NULL")
    ends = long.groupBy("unit", "sensor").agg(
        (F.max_by("value", "cycle") - F.min_by("value", "cycle")).alias("change")
    )
    mean = ends.groupBy("sensor").agg(F.avg("change").alias("avg_end_minus_start"))
    return mean.orderBy(F.desc(F.abs("avg_end_minus_start")), "sensor")


def top_sensors(ranked: DataFrame, order: list, rows: int) -> DataFrame:
    """The first `rows` sensors of a ranking, to restrict the next step."""
    return ranked.orderBy(*order).limit(rows)


def _series(df: DataFrame, sensors: list[str], segment: int | None) -> DataFrame:
    """Values per unit, sensor and segment with the facts of their series. A segment length is asked for by the caller; without
    one a series is a whole life. Null and NaN values are left out."""
    long = unpivot_sensors(df, ["unit", "cycle"], sensors).where("value IS NOT NULL AND NOT isnan(value)")
    cut = F.floor((F.col("cycle") - 1) / segment) if segment else F.lit(0).cast("long")
    rows = long.select("unit", "sensor", cut.alias("segment"), "cycle", F.col("value").cast("double").alias("value"))
    facts = rows.groupBy(*SERIES).agg(
        F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), (F.min("value") == F.max("value")).alias("constant")
    )
    return attach_facts(rows, facts, SERIES, "cycle", "inner")


def series_spectrum(df: DataFrame, sensors: list[str], top: int = 5, segment: int | None = None, whole: int = WHOLE) -> DataFrame:
    """Top Fourier amplitudes of the centred series per unit and sensor, rounded to 4 places.

    Series of more than `whole` values are transformed by many tasks. Missing ranks are null; a series of one value has all of
    them null, one without values has no row.
    """
    series = _series(df, sensors, segment)
    found = largest_amplitudes(series, SERIES, top, whole).groupBy(*SERIES).agg(
        *[F.round(F.max(F.when(F.col("place") == i, F.col("amplitude"))), 4).alias(f"fft_amp_{i}") for i in range(1, top + 1)]
    )
    single = series.where("n = 1").select(*SERIES, *[F.lit(None).cast("double").alias(f"fft_amp_{i}") for i in range(1, top + 1)])
    return found.unionByName(single)


# Published critical values at the given significance levels (constant, no trend).
KPSS_LEVELS = ((0.347, 0.10), (0.463, 0.05), (0.574, 0.025), (0.739, 0.01))
UNIT_ROOT_LEVELS = ((-3.43, 0.01), (-2.86, 0.05), (-2.57, 0.10), (-1.57, 0.50), (-0.44, 0.90), (0.60, 0.99))

#: A variance that falls below this share of itself has been explained by the other inputs.
EXPLAINED = 1e-12


def _read_off(stat: Column, levels: tuple[tuple[float, float], ...]) -> Column:
    """The value between published ones on a straight line, and the outer ones beyond them."""
    value = F.when(stat <= levels[0][0], F.lit(levels[0][1]))
    for (low, first), (high, second) in zip(levels, levels[1:], strict=False):
        value = value.when(stat <= high, first + (second - first) * (stat - low) / (high - low))
    return value.when(stat.isNotNull(), F.lit(levels[-1][1]))


def level_statistics(numbered: DataFrame, lags: Column) -> DataFrame:
    """`kpss_stat` per series: squared running totals of the errors over their long-run variance (Bartlett weights).

    The weighted sum of all lagged products is the sum of squared totals over every stretch of lags + 1 errors, divided by lags + 1;
    such a total is the difference of two running totals, which meet at the later one's position.
    """
    run = F.floor((F.col("j") - 1) / CYCLE_BUCKET)
    rows = numbered.withColumns({"run": run, "error": F.col("value") - F.col("mean"), "reach": lags.cast("long") + 1})
    before = W.partitionBy(*SERIES).orderBy("run").rowsBetween(W.unboundedPreceding, -1)
    offsets = rows.groupBy(*SERIES, "run").agg(F.sum("error").alias("part")).select(
        *SERIES, "run", F.coalesce(F.sum("part").over(before), F.lit(0.0)).alias("offset")
    )
    inside = W.partitionBy(*SERIES, "run").orderBy("j").rowsBetween(W.unboundedPreceding, 0)
    totals = rows.join(offsets, [*SERIES, "run"]).withColumn("total", F.col("offset") + F.sum("error").over(inside))
    ends = F.array(
        F.struct(F.col("j").alias("at"), F.col("total").alias("signed"), F.col("total").alias("own")),
        F.struct((F.col("j") + F.col("reach")).alias("at"), (-F.col("total")).alias("signed"), F.lit(None).cast("double").alias("own")),
    )
    stretches = totals.select(*SERIES, "n", "constant", "reach", F.inline(ends)).groupBy(*SERIES, "n", "constant", "reach", "at").agg(
        F.sum("signed").alias("stretch"), F.max("own").alias("own")
    )
    n = F.col("n")
    variance = F.sum(F.col("stretch") * F.col("stretch")) / F.col("reach") / n
    stat = F.sum(F.col("own") * F.col("own")) / (n * n) / variance
    defined = (n >= 4) & ~F.col("constant") & (variance > 0)
    return stretches.groupBy(*SERIES, "n", "constant", "reach").agg(F.when(defined, stat).alias("kpss_stat")).select(*SERIES, "kpss_stat")


def unit_root_statistics(numbered: DataFrame, lags: int) -> DataFrame:
    """`adf_stat` per series: t statistic of the level in a regression of the change on level, constant and lagged changes.

    Covariances of the inputs are summed over the rows; eliminating the lagged changes one by one leaves the level's equation.
    An input that the others explain is left out.
    """
    lent = with_neighbours(numbered.withColumn("error", F.col("value") - F.col("mean")), "j", max(CYCLE_BUCKET, lags + 1), before=lags + 1)
    order = W.partitionBy(*SERIES, "_run").orderBy("j")
    back = [F.col("error")] + [F.lag("error", k).over(order) for k in range(1, lags + 2)]
    names = ["level", *[f"past_{k}" for k in range(1, lags + 1)], "change"]
    inputs = [back[1], *[back[k] - back[k + 1] for k in range(1, lags + 1)], back[0] - back[1]]
    rows = lent.select(*SERIES, "n", "constant", "j", "_own", *[c.alias(name) for c, name in zip(inputs, names, strict=True)])
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    used = rows.where(F.col("_own") & (F.col("j") > lags + 1))
    sums = used.groupBy(*SERIES, "n", "constant").agg(
        F.count(F.lit(1)).alias("rows"), *[F.covar_pop(a, b).alias(f"{a}.{b}") for a, b in pairs]
    )
    sums = sums.toDF(*[c.replace(".", "__") for c in sums.columns])

    def cell(a: str, b: str) -> Column:
        return F.col(f"{a}__{b}" if (a, b) in pairs else f"{b}__{a}")

    sums = sums.withColumns({f"full_{a}": cell(a, a) for a in names})
    left = list(names)
    for out in names[1:-1]:
        left.remove(out)
        free = cell(out, out) > EXPLAINED * F.col(f"full_{out}")
        share = {(a, b): F.when(free, cell(a, out) * cell(out, b) / cell(out, out)).otherwise(0.0) for a, b in pairs if a in left and b in left}
        sums = sums.withColumns({f"{a}__{b}": cell(a, b) - taken for (a, b), taken in share.items()})
    level, both, change = cell("level", "level"), cell("level", "change"), cell("change", "change")
    slope = both / level
    freedom = F.greatest(F.col("rows") - (lags + 2), F.lit(1))
    variance = (change - both * slope) / freedom / level
    defined = (F.col("rows") >= lags + 4) & ~F.col("constant") & (level > EXPLAINED * F.col("full_level")) & (change - both * slope > EXPLAINED * F.col("full_change"))
    return sums.select(*SERIES, F.when(defined, slope / F.sqrt(F.when(variance > 0, variance))).alias("adf_stat"))


def stationarity(df: DataFrame, sensors: list[str], lags: int = 1, segment: int | None = None) -> DataFrame:
    """Unit-root and level-stationarity tests per unit and sensor, p-values read off published tables.

    Built-in functions only; no task holds a series. A series that is constant, too short or explained without an error has null tests.
    """
    numbered = row_index(_series(df, sensors, segment), SERIES, ["cycle", "value"], F.floor(F.col("cycle") / CYCLE_BUCKET), "j")
    reach = F.ceil(12.0 * F.pow(F.col("n") / 100.0, F.lit(0.25)))
    tested = level_statistics(numbered, reach).join(unit_root_statistics(numbered, lags), SERIES, "left")
    tested = tested.withColumns(
        {"adf_pvalue": _read_off(F.col("adf_stat"), UNIT_ROOT_LEVELS), "kpss_pvalue": _read_off(F.col("kpss_stat"), KPSS_LEVELS)}
    )
    rounded = [F.round(c, 6).alias(c) for c in ("adf_stat", "adf_pvalue", "kpss_stat", "kpss_pvalue")]
    return tested.select(*SERIES, *rounded).withColumns(
        {"adf_stationary": F.col("adf_pvalue") < 0.05, "kpss_stationary": F.col("kpss_pvalue") >= 0.05}
    )


def label_composition(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("rows"))
