"""Scalar column expressions shared by the operators."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS = 1_000_000
HASH_SPAN = 2**32


def parse_time(c: Column) -> Column:
    """Timestamp or null; text without an offset is read in the session zone (UTC)."""
    return F.try_to_timestamp(c.cast("string"))


def parse_double(c: Column) -> Column:
    """Double or null: text that is no number and NaN both become null."""
    value = c.try_cast("double")
    return F.when(~F.isnan(value), value)


def ratio(numerator: Column, denominator: Column) -> Column:
    """Quotient, null where the denominator is zero."""
    return numerator / F.nullif(denominator, F.lit(0.0))


def at_least(value: Column, threshold: float | Column) -> Column:
    """1 where the value reaches the threshold, else 0."""
    return (value >= F.lit(threshold)).cast("int")


def peak_index(values: Column) -> Column:
    """0-based place of the first largest element."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def blend(first: Column, second: Column, first_weight: float, second_weight: float) -> Column:
    """Weighted sum of two predictions; the first alone where the second is missing."""
    for name, weight in (("first", first_weight), ("second", second_weight)):
        if not 0.0 <= weight <= 1.0:
            raise ValueError(f"The {name} weight lies outside 0 to 1.")
    if not math.isclose(first_weight + second_weight, 1.0, rel_tol=0.0, abs_tol=1e-9):
        raise ValueError("Both weights together have to make 1.")
    return F.coalesce(first * first_weight + second * second_weight, first)


def row_hash(a: Column, b: Column, salt: int | Column) -> Column:
    """Integer in [0, HASH_SPAN) from two keys and a salt, equal on every run and partitioning."""
    salt = salt if isinstance(salt, Column) else F.lit(salt)
    text = F.concat_ws(":", *[c.cast("string") for c in (a, b, salt)])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def uniform(a: Column, b: Column, salt: int | Column) -> Column:
    """Number strictly between 0 and 1 from the row hash."""
    return (row_hash(a, b, salt) + 0.5) / float(HASH_SPAN)


def normal(a: Column, b: Column, salt: Column) -> Column:
    """Standard normal number from two uniforms (Box-Muller)."""
    radius = F.sqrt(-2.0 * F.log(uniform(a, b, salt)))
    return radius * F.cos(2.0 * math.pi * uniform(a, b, salt + 500))
