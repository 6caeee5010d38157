"""Rolling time statistics, lags, spectra and ratios per equipment and sensor.

Frames that reach back 24 h are not computed with one window per equipment: Spark re-adds every row of a
sliding frame for each output row, and one equipment may hold a third of all rows. Instead time is cut
into buckets (default: the greatest common divisor of the windows) and every frame (t-w, t] is put
together from three exact pieces: the end of the oldest bucket, whole buckets in between, and the
beginning of the newest bucket. Each row takes part in a constant number of growing frames.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import ratio
from ..functions.ordered import with_neighbours

HOUR = 3_600_000_000
ROLLING_WINDOWS = {"1h": HOUR, "8h": 8 * HOUR, "24h": 24 * HOUR}
STATS = ("mean", "std", "min", "max")
LAGS = tuple(range(1, 13))
SPECTRUM_TOP = 5
#: Values transformed at once by the rolling spectrum.
FFT_BLOCK = 2_000_000
LAG_RUN = 65_536


def unpivot_sensors(df: DataFrame, ids: list[str], sensors: list[str]) -> DataFrame:
    """One row per reading and sensor: `sensor`, `value`."""
    typed = df.select(*ids, *[F.col(c).cast("double").alias(c) for c in sensors])
    return typed.unpivot(ids, sensors, "sensor", "value")


def _moments(value: Column, over) -> dict[str, Column]:
    count = F.count(value).over(over)
    return {
        "n": count,
        "mean": F.avg(value).over(over),
        "m2": F.var_pop(value).over(over) * count,
        "min": F.min(value).over(over),
        "max": F.max(value).over(over),
    }


def _merged(parts: list[str], stat: str) -> Column:
    """Combine count/mean/squared deviation/min/max of disjoint pieces (pairwise update, no subtraction of sums)."""
    total = reduce(Column.__add__, [F.coalesce(F.col(f"{p}.n"), F.lit(0)) for p in parts])
    weighted = reduce(Column.__add__, [F.coalesce(F.col(f"{p}.n") * F.col(f"{p}.mean"), F.lit(0.0)) for p in parts])
    mean = weighted / F.nullif(total, F.lit(0))
    if stat == "mean":
        return mean
    if stat == "std":
        spread = [
            F.coalesce(F.col(f"{p}.m2") + F.col(f"{p}.n") * F.pow(F.col(f"{p}.mean") - mean, F.lit(2)), F.lit(0.0))
            for p in parts
        ]
        return F.coalesce(F.sqrt(reduce(Column.__add__, spread) / F.nullif(total, F.lit(0))), F.lit(0.0))
    pick = F.least if stat == "min" else F.greatest
    return pick(*[F.col(f"{p}.{stat}") for p in parts]) if len(parts) > 1 else F.col(f"{parts[0]}.{stat}")


def _whole_buckets(rows: DataFrame, keys: list[str], steps: dict[str, int]) -> DataFrame:
    """Per (key, bucket): pieces made of the whole buckets strictly inside each frame."""
    one = rows.groupBy(*keys, "bucket").agg(
        F.count("value").alias("n"),
        F.avg("value").alias("mean"),
        (F.var_pop("value") * F.count("value")).alias("m2"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )
    pieces = []
    for name, step in steps.items():
        if step < 2:
            continue
        frame = W.partitionBy(*keys).orderBy("bucket").rangeBetween(-(step - 1), -1)
        listed = F.filter(
            F.collect_list(F.struct("n", "mean", "m2", "min", "max")).over(frame), lambda b: b["n"] > 0
        )
        pieces.append(listed.alias(f"list_{name}"))
    listed = one.select(*keys, F.col("bucket").alias("slot"), *pieces)
    for name, step in steps.items():
        if step < 2:
            continue
        source = F.col(f"list_{name}")
        n = F.aggregate(source, F.lit(0).cast("long"), lambda a, b: a + b["n"])
        weighted = F.aggregate(source, F.lit(0.0), lambda a, b: a + b["n"] * b["mean"])
        listed = listed.withColumn(f"n_{name}", n).withColumn(
            f"mean_{name}", weighted / F.nullif(F.col(f"n_{name}"), F.lit(0).cast("long"))
        )
        mean = F.col(f"mean_{name}")
        spreads = F.transform(source, lambda b: b["m2"] + b["n"] * F.pow(b["mean"] - mean, F.lit(2)))
        m2 = F.aggregate(spreads, F.lit(0.0), lambda a, b: a + b)
        piece = F.struct(
            F.col(f"n_{name}").alias("n"),
            F.col(f"mean_{name}").alias("mean"),
            m2.alias("m2"),
            F.array_min(F.transform(source, lambda b: b["min"])).alias("min"),
            F.array_max(F.transform(source, lambda b: b["max"])).alias("max"),
        )
        listed = listed.withColumn(f"middle_{name}", piece)
    return listed.select(*keys, "slot", *[f"middle_{n}" for n, s in steps.items() if s > 1])


def rolling_stats(
    readings: DataFrame,
    keys: list[str],
    time_us: str,
    windows: dict[str, int] | None = None,
    bucket: int | None = None,
) -> DataFrame:
    """Mean, population std, min and max of `value` over (t-w, t] per key, for every window w (micros).

    Keeps all input columns and adds `{window}_{stat}`. Rows of one key with the same time see each other.
    """
    windows = windows or ROLLING_WINDOWS
    width = bucket or math.gcd(*windows.values())
    if any(w % width for w in windows.values()):
        raise ValueError("The bucket must divide every window.")
    steps = {name: w // width for name, w in windows.items()}
    rows = readings.withColumn("bucket", F.floor(F.col(time_us) / width)).withColumn(
        "phase", F.col(time_us) - F.col("bucket") * width
    )
    # A row serves its own bucket and, as the oldest piece, the bucket one window later.
    roles = [F.struct(F.lit(0).alias("step"), F.col("bucket").alias("slot"))] + [
        F.struct(F.lit(step).alias("step"), (F.col("bucket") + step).alias("slot")) for step in set(steps.values())
    ]
    spread = rows.withColumn("role", F.explode(F.array(*roles))).select("*", "role.step", "role.slot").drop("role")
    begun = W.partitionBy(*keys, "slot").orderBy("phase").rangeBetween(W.unboundedPreceding, W.currentRow)
    later = W.partitionBy(*keys, "slot").orderBy(F.col("back")).rangeBetween(W.unboundedPreceding, -1)
    spread = spread.withColumn("back", -F.col("phase"))
    # Copies are kept only where the later bucket has rows of its own. The join partitions by the same keys
    # as the frames below (or is a broadcast, if the bucket summary proves small at run time).
    spread = spread.join(_whole_buckets(rows, keys, steps), [*keys, "slot"])

    def piece(step: int, over) -> Column:
        value = F.when(F.col("step") == step, F.col("value"))
        return F.struct(*[c.alias(n) for n, c in _moments(value, over).items()])

    pieced = spread.withColumn("head", piece(0, begun))
    for name, step in steps.items():
        pieced = pieced.withColumn(f"tail_{name}", piece(step, later))
    own = pieced.where(F.col("step") == 0)
    outputs = []
    for name, step in steps.items():
        parts = ["head", f"tail_{name}"] + ([f"middle_{name}"] if step > 1 else [])
        outputs += [_merged(parts, stat).alias(f"{name}_{stat}") for stat in STATS]
    return own.select(*[F.col(c) for c in readings.columns], *outputs)


def lag_values(
    readings: DataFrame, keys: list[str], index: str, values: list[str], steps: tuple[int, ...] = LAGS, run: int = LAG_RUN
) -> DataFrame:
    """`{value}_lag_{k}`: the value k rows earlier of the same key; `index` is the row position inside the key."""
    lent = with_neighbours(readings, index, run, before=max(steps))
    order = W.partitionBy(*keys, "_run").orderBy(index)
    lags = [F.lag(v, k).over(order).alias(f"{v}_lag_{k}") for v in values for k in steps]
    return lent.select("*", *lags).where("_own").drop("_run", "_own")


def top_amplitudes(windows: pd.Series, top: int) -> pd.Series:
    """Largest Fourier amplitudes of each centred window without the constant term, largest first.

    Windows of equal length are transformed together. Fewer than two values give an empty list.
    """
    lengths = windows.map(len).to_numpy()
    found: list = [[] for _ in range(len(windows))]
    for length in np.unique(lengths[lengths >= 2]):
        places = np.flatnonzero(lengths == length)
        block = np.stack([np.asarray(windows.iat[i], dtype=float) for i in places])
        amplitudes = np.abs(np.fft.rfft(block - block.mean(axis=1, keepdims=True), axis=1))[:, 1:]
        ranked = -np.sort(-amplitudes, axis=1)[:, :top]
        for place, row in zip(places, ranked):
            found[place] = row.tolist()
    return pd.Series(found)


def rolling_spectrum(
    readings: DataFrame,
    keys: list[str],
    time_us: str,
    ids: list[str],
    window: int = 24 * HOUR,
    chunk: int = 24 * HOUR,
    top: int = SPECTRUM_TOP,
) -> DataFrame:
    """Top Fourier amplitudes of `value` over [t-w, t] per key.

    Time is cut into chunks that also receive the last `window` of the chunks before. A task goes through its chunks in
    order, holds one of them at a time and moves over it with a start index, so no window is copied into a row. Null values are
    left out of the windows; a row without a value has the spectrum of the values around it.
    """
    reach = -(-window // chunk)
    position = F.floor(F.col(time_us) / chunk)
    last = F.least(F.floor((F.col(time_us) + window) / chunk), position + reach)
    lent = (
        readings.select(*keys, *ids, time_us, "value", position.alias("_home"))
        .withColumn("_chunk", F.explode(F.sequence("_home", last)))
        .withColumn("_own", F.col("_home") == F.col("_chunk"))
        .drop("_home")
    )
    names, places = [*keys, *ids, time_us], [*keys, "_chunk"]
    amplitudes = [f"fft_amp_{i + 1}" for i in range(top)]

    def whole_chunks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:
            rows = batch if held is None else pd.concat([held, batch], ignore_index=True)
            fresh = np.flatnonzero(_new_group(rows, places))
            held = rows.iloc[fresh[-1] :] if len(rows) else rows
            if len(rows) and fresh[-1]:
                yield spectra(rows.iloc[: fresh[-1]])
        if held is not None and len(held):
            yield spectra(held)

    def spectra(rows: pd.DataFrame) -> pd.DataFrame:
        time = rows[time_us].to_numpy(np.int64)
        # one axis for all chunks, with a gap of more than a window between them
        axis = time - time.min() + np.cumsum(_new_group(rows, places)) * (time.max() - time.min() + window + 1)
        values = rows["value"].to_numpy(float)
        known = ~np.isnan(values)
        own = rows["_own"].to_numpy(bool)
        start = np.searchsorted(axis[known], axis[own] - window, "left")
        length = np.searchsorted(axis[known], axis[own], "right") - start
        found = np.full((own.sum(), top), np.nan)
        for n in np.unique(length[length >= 2]):
            at = np.flatnonzero(length == n)
            for part in np.array_split(at, -(-len(at) * n // FFT_BLOCK)):
                block = values[known][start[part][:, None] + np.arange(n)]
                strength = np.abs(np.fft.rfft(block - block.mean(axis=1, keepdims=True), axis=1))[:, 1:]
                ranked = -np.sort(-strength, axis=1)[:, :top]
                found[part, : ranked.shape[1]] = ranked
        out = rows.loc[own, names].reset_index(drop=True)
        for i, name in enumerate(amplitudes):
            out[name] = pd.Series(found[:, i], dtype="Float64").mask(np.isnan(found[:, i]))
        return out

    kinds = T.StructType([lent.schema[c] for c in names] + [T.StructField(c, T.DoubleType()) for c in amplitudes])
    dealt = lent.repartition(*places).sortWithinPartitions(*places, time_us)
    return dealt.mapInPandas(whole_chunks, kinds)


def _new_group(rows: pd.DataFrame, columns: list[str]) -> np.ndarray:
    """Whether a row differs from the one before it in one of the columns; the first row does."""
    fresh = np.zeros(len(rows), bool)
    fresh[:1] = True
    for c in columns:
        codes = pd.factorize(rows[c], use_na_sentinel=False)[0]
        fresh[1:] |= codes[1:] != codes[:-1]
    return fresh


def ratio_pairs(sensors: list[str]) -> list[tuple[str, str]]:
    """Each sensor over the one before it."""
    return list(zip(sensors[1:], sensors[:-1]))


def with_ratios(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    return df.withColumns({f"{n}_to_{d}_ratio": ratio(F.col(n), F.col(d)) for n, d in pairs})


def feature_blocks(
    sensors: list[str], windows: dict[str, int] | None = None, lags: tuple[int, ...] = LAGS, top: int = SPECTRUM_TOP
) -> dict[str, list[str]]:
    """The feature names of each block of values that `engineer_features` makes with `blocks`."""
    parts = {
        "rolled": [f"{w}_{s}" for w in windows or ROLLING_WINDOWS for s in STATS],
        "lagged": [f"lag_{k}" for k in lags],
        "spectrum": [f"fft_amp_{i + 1}" for i in range(top)],
    }
    names = {f"{s}_{part}": [f"{s}_{c}" for c in columns] for s in sensors for part, columns in parts.items()}
    return names | {"ratios": [f"{n}_to_{d}_ratio" for n, d in ratio_pairs(sensors)]}


def engineer_features(
    prepared: DataFrame,
    sensors: list[str],
    windows: dict[str, int] | None = None,
    lags: tuple[int, ...] = LAGS,
    top: int = SPECTRUM_TOP,
    partition_keys: tuple[str, ...] = ("equipment_id",),
    blocks: bool = False,
) -> DataFrame:
    """All features of a prepared batch in long form: reading key, cycle, `feature`, `feature_value`.
    With `blocks`, a row holds the `values` of a whole `block`, whose names `feature_blocks` has.

    `prepared` carries `row_index` (position per equipment). The long form keeps the row narrow (the wide
    form has 629 columns for 21 sensors) and spreads one equipment over its sensors.
    """
    windows = windows or ROLLING_WINDOWS
    keys = [*partition_keys, "sensor"]
    meta = [c for c in ("event_time", "equipment_id", "run_id", "cycle", "source_file") if c in prepared.columns]
    base = prepared.withColumn("event_us", F.unix_micros("event_time"))
    long = unpivot_sensors(base, [*meta, "row_index", "event_us"], sensors)

    def melt(df: DataFrame, columns: list[str], name: Column, block: str) -> DataFrame:
        if blocks:
            values = F.array(*[F.col(c).cast("double") for c in columns])
            return df.select(*meta, F.concat_ws("_", "sensor", F.lit(block)).alias("block"), values.alias("values"))
        flat = df.unpivot([*meta, "sensor"], columns, "part", "feature_value")
        return flat.select(*meta, name.alias("feature"), "feature_value")

    prefixed = F.concat_ws("_", "sensor", "part")
    rolled = rolling_stats(long, keys, "event_us", windows)
    stats = melt(rolled, [f"{w}_{s}" for w in windows for s in STATS], prefixed, "rolled")
    lagged = lag_values(long.withColumnRenamed("value", "v"), keys, "row_index", ["v"], lags)
    lag_rows = melt(
        lagged.withColumnsRenamed({f"v_lag_{k}": f"lag_{k}" for k in lags}), [f"lag_{k}" for k in lags], prefixed, "lagged"
    )
    longest = max(windows.values())
    ids = [c for c in meta if c not in partition_keys]
    spectrum = rolling_spectrum(long, keys, "event_us", ids, longest, longest, top)
    fft_rows = melt(spectrum, [f"fft_amp_{i + 1}" for i in range(top)], prefixed, "spectrum")
    parts = [stats, lag_rows, fft_rows]
    pairs = ratio_pairs(sensors)
    if pairs:
        names = [f"{n}_to_{d}_ratio" for n, d in pairs]
        wide = with_ratios(prepared, pairs).select(*meta, *names)
        if blocks:
            values = F.array(*[F.col(c).cast("double") for c in names])
            parts.append(wide.select(*meta, F.lit("ratios").alias("block"), values.alias("values")))
        else:
            parts.append(wide.unpivot(meta, names, "feature", "feature_value"))
    return reduce(DataFrame.unionByName, parts)
