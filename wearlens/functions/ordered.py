"""Positions, neighbours and running totals in an order, without one task per key.

A key may hold a third of all rows, so no window here spans a whole key of the big table. Rows are
grouped by (key, bucket of the order); only the bucket summary, whose length is set by the time span or
by a fixed number of buckets, is ordered per key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Positions are numbered inside an hour of a key; only counts per hour are put in order for the whole key.
HOUR = 3_600_000_000
CYCLE_BUCKET = 4096


def row_index(df: DataFrame, keys: list[str], order: list[str], bucket: Column, name: str = "row_index") -> DataFrame:
    """Add the 1-based position of each row inside its key; `bucket` must not decrease along `order`."""
    rows = df.withColumn("_bucket", bucket)
    earlier = W.partitionBy(*keys).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        rows.groupBy(*keys, "_bucket")
        .agg(F.count(F.lit(1)).alias("_rows"))
        .select(*keys, "_bucket", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"))
    )
    inside = W.partitionBy(*keys, "_bucket").orderBy(*order)
    return (
        rows.join(offsets, [*keys, "_bucket"])
        .withColumn(name, F.row_number().over(inside) + F.col("_before"))
        .drop("_bucket", "_before")
    )


def with_neighbours(df: DataFrame, index: str, size: int, before: int = 0, after: int = 0) -> DataFrame:
    """Cut each key into runs of `size` rows by position and lend rows across the cuts.

    Adds `_run` and `_own`. Every run receives copies (`_own` false) of the `before` rows ahead of it and
    the `after` rows behind it, so frames of that reach can be computed per (key, run).
    """
    if max(before, after) > size:
        raise ValueError("A run must be at least as long as the reach of the frame.")
    place = F.col(index)
    run = F.floor(place / size)
    inner = place - run * size
    homes = [F.struct(run.alias("run"), F.lit(True).alias("own"))]
    if before:
        homes.append(F.when(inner >= size - before, F.struct((run + 1).alias("run"), F.lit(False).alias("own"))))
    if after:
        homes.append(F.when(inner < after, F.struct((run - 1).alias("run"), F.lit(False).alias("own"))))
    return (
        df.withColumn("_home", F.explode(F.array_compact(F.array(*homes))))
        .withColumn("_run", F.col("_home.run"))
        .withColumn("_own", F.col("_home.own"))
        .drop("_home")
    )


def running_totals(df: DataFrame, by: str, order: str, totals: dict[str, str], coarse: int = 32) -> DataFrame:
    """Running sums along `order`, largest first, for each value of `by`.

    `df` holds one row per (by, order) and `by` names a handful of things (score columns). Cut points are
    approximate quantiles: coarse*coarse buckets per name, a broadcast of fixed size per name. They only
    steer the parallelism; the totals are exact for any cut points.
    """
    buckets = coarse * coarse
    shares = [i / buckets for i in range(1, buckets)]
    cuts = df.groupBy(by).agg(F.percentile_approx(order, shares, 10_000).alias("_cuts"))
    # Two short scans (every `coarse`-th cut, then the cuts in between) instead of one long scan.
    first = F.transform(F.sequence(F.lit(1), F.lit(coarse - 1)), lambda i: F.get("_cuts", i * coarse - 1))
    block = F.size(F.filter("_first", lambda c: c <= F.col(order)))
    inner = F.size(F.filter(F.slice("_cuts", F.col("_block") * coarse + 1, coarse - 1), lambda c: c <= F.col(order)))
    placed = (
        df.join(F.broadcast(cuts.withColumn("_first", first)), by)
        .withColumn("_block", block)
        .withColumn("_bucket", F.col("_block") * coarse + inner)
        .drop("_cuts", "_first", "_block")
    )
    higher = W.partitionBy(by).orderBy(F.desc("_bucket")).rowsBetween(W.unboundedPreceding, -1)
    sums = placed.groupBy(by, "_bucket").agg(*[F.sum(c).alias(f"_sum_{c}") for c in totals])
    offsets = sums.select(
        by, "_bucket", *[F.coalesce(F.sum(f"_sum_{c}").over(higher), F.lit(0)).alias(f"_off_{c}") for c in totals]
    )
    inside = W.partitionBy(by, "_bucket").orderBy(F.desc(order)).rowsBetween(W.unboundedPreceding, 0)
    out = placed.join(F.broadcast(offsets), [by, "_bucket"])
    for source, name in totals.items():
        out = out.withColumn(name, F.sum(source).over(inside) + F.col(f"_off_{source}"))
    return out.drop("_bucket", *[f"_off_{c}" for c in totals])
