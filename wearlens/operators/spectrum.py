"""Fourier amplitudes of whole series, however long: a transform in three shuffles whose groups hold the root of a length.

A series of n values becomes a convolution with a chirp (Bluestein), so that any n, also a prime one, is transformed in
a length M = rows * columns, both powers of two. Index j is dealt by j mod columns; a task transforms one such group, turns it by
its twiddle factors and deals the results by frequency mod rows. There the second half of the forward transforms, the product
with the chirp and the first half of the inverse transform follow, and a last deal finishes it. The largest amplitudes
are chosen per group first.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.ordered import CYCLE_BUCKET, row_index

#: Longest series that one task transforms at once.
WHOLE = 100_000


def shape_of(n: int) -> tuple[int, int]:
    """Powers of two (rows, columns) with rows * columns >= 2n - 1."""
    bits = max(int(2 * n - 2).bit_length(), 2)
    return 1 << bits // 2, 1 << (bits - bits // 2)


def _turn(places: np.ndarray, length: int) -> np.ndarray:
    """exp(-2 pi i place / length); places are whole numbers below 2^63."""
    return np.exp(-2j * np.pi * ((places % length) / length))


def _chirp(j: np.ndarray, n: int) -> np.ndarray:
    """exp(pi i j^2 / n); the square is reduced as a whole number, so that no digits are lost. |j| is below 3 * 10^9."""
    return np.conj(_turn(j * j, 2 * n))


def _largest(amplitudes: np.ndarray, top: int) -> np.ndarray:
    return np.sort(np.partition(amplitudes, -top)[-top:] if len(amplitudes) > top else amplitudes)[::-1]


def _frame(keys: list, n: int, amplitudes: np.ndarray, names: list[str]) -> pd.DataFrame:
    return pd.DataFrame([(*keys, n, float(a)) for a in amplitudes], columns=names)


def largest_amplitudes(series: DataFrame, keys: list[str], top: int, whole: int = WHOLE) -> DataFrame:
    """`keys`, `n`, `place` (1..top) and `amplitude` of the centred series, largest first; frequency 0 is left out.

    `series` has the keys, `cycle` (the order), `value` (not null), `n` (values of the series) and `mean`. Equal cycles are ordered by
    value. Series up to `whole` values are transformed by one task each, longer ones over many. A series of one value
    has no amplitude and no row.
    """
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in series.schema if f.name in keys)
    keys = [f.name for f in series.schema if f.name in keys]
    names = [*keys, "n", "amplitude"]

    def at_once(found: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        values = rows.sort_values(["cycle", "value"])["value"].to_numpy()
        return _frame(list(found), len(values), _largest(np.abs(np.fft.rfft(values - values.mean()))[1:], top), names)

    def deal_columns(found: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        *key, n, column = found
        height, width = shape_of(n)
        place = np.arange(height, dtype=np.int64) * width + column
        signal = np.zeros(height, complex)
        j = rows["j"].to_numpy()
        signal[j // width] = rows["error"].to_numpy() * np.conj(_chirp(j, n))
        # the chirp belongs at j and at M - j; between them are zeros
        distance = np.minimum(place, height * width - place)
        filtered = np.where(distance < n, _chirp(distance, n), 0)
        frequency = np.arange(height, dtype=np.int64)
        turned = _turn(frequency * column, height * width)
        a, h = np.fft.fft(signal) * turned, np.fft.fft(filtered) * turned
        parts = {"line": frequency, "place": column, "ar": a.real, "ai": a.imag, "hr": h.real, "hi": h.imag}
        return pd.DataFrame({**dict(zip(keys, key, strict=True)), "n": n, **parts})

    def deal_lines(found: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        *key, n, line = found
        height, width = shape_of(n)
        both = np.zeros((2, width), complex)
        both[:, rows["place"].to_numpy()] = [rows["ar"] + 1j * rows["ai"], rows["hr"] + 1j * rows["hi"]]
        a, h = np.fft.fft(both)
        places = np.arange(width, dtype=np.int64)
        y = np.fft.ifft(a * h) * np.conj(_turn(places * line, height * width))
        return pd.DataFrame({**dict(zip(keys, key, strict=True)), "n": n, "column": places, "line": line, "yr": y.real, "yi": y.imag})

    def finish(found: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        *key, n, column = found
        height, width = shape_of(n)
        y = np.zeros(height, complex)
        y[rows["line"].to_numpy()] = rows["yr"] + 1j * rows["yi"]
        frequency = np.arange(height, dtype=np.int64) * width + column
        wanted = (frequency >= 1) & (frequency <= n // 2)
        return _frame(key, n, _largest(np.abs(np.fft.ifft(y))[wanted], top), names)

    short = series.where(F.col("n") <= whole).groupBy(*keys).applyInPandas(at_once, f"{kinds}, n bigint, amplitude double")
    numbered = row_index(series.where(F.col("n") > whole), keys, ["cycle", "value"], F.floor(F.col("cycle") / CYCLE_BUCKET), "j")
    # the number of bits of 2n - 2 is that of shape_of; its larger half is the number of columns
    bits = F.length(F.bin(2 * F.col("n") - 2))
    width = F.pow(F.lit(2.0), bits - F.floor(bits / 2)).cast("bigint")
    long = (
        numbered.select(*keys, "n", (F.col("j") - 1).alias("j"), (F.col("value") - F.col("mean")).alias("error"))
        .withColumn("column", F.col("j") % width)
        .groupBy(*keys, "n", "column")
        .applyInPandas(deal_columns, f"{kinds}, n bigint, line bigint, place bigint, ar double, ai double, hr double, hi double")
        .groupBy(*keys, "n", "line")
        .applyInPandas(deal_lines, f"{kinds}, n bigint, column bigint, line bigint, yr double, yi double")
        .groupBy(*keys, "n", "column")
        .applyInPandas(finish, f"{kinds}, n bigint, amplitude double")
    )
    ranked = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("amplitude")))
    return short.unionByName(long).withColumn("place", ranked).where(F.col("place") <= top)
