"""Repeatable exact-size samples: the same rows on every run and partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .columns import HASH_SPAN

BUCKETS = 65_536


def cut_point(candidates: DataFrame, order: list[str], wanted: int) -> Column | None:
    """The `wanted`-th smallest `order` tuple as a literal (the largest one if there are fewer rows).

    `order[0]` is a row hash. Hash values are even, so equal-width buckets are of equal size: BUCKETS counts
    find the bucket that holds the cut, and only that bucket is sorted. Two single rows reach the driver.
    """
    placed = candidates.select(*order, F.floor(F.col(order[0]) * BUCKETS / HASH_SPAN).alias("bucket"))
    upto = W.orderBy("bucket").rowsBetween(W.unboundedPreceding, 0)
    counts = placed.groupBy("bucket").agg(F.count(F.lit(1)).alias("rows"))
    reached = counts.withColumn("reached", F.sum("rows").over(upto))
    enough = F.when(F.col("reached") >= wanted, F.col("bucket"))
    at = reached.agg(
        F.coalesce(F.min(enough), F.max("bucket")).alias("bucket"),
        F.coalesce(F.max(F.when(F.col("reached") < wanted, F.col("reached"))), F.lit(0)).alias("before"),
        F.max("reached").alias("total"),
    ).first()
    if wanted < 1 or at["bucket"] is None:
        return None
    if wanted >= at["total"]:
        last = placed.agg(F.max(F.struct(*order)).alias("cut")).select("cut.*").first()
    else:
        inside = placed.where(F.col("bucket") == at["bucket"])
        place = F.row_number().over(W.partitionBy("bucket").orderBy(*order))
        last = inside.withColumn("place", place).where(F.col("place") == wanted - at["before"]).first()
    kinds = dict(candidates.dtypes)
    return F.struct(*[F.lit(last[c]).cast(kinds[c]).alias(c) for c in order])


def up_to(order: list[str], cut: Column | None) -> Column:
    """Whether a row lies at or before the cut."""
    return F.lit(False) if cut is None else F.struct(*order) <= cut
