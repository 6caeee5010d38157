"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SALTS = 16


def attach_facts(
    rows: DataFrame, facts: DataFrame, keys: list[str], spread: str, how: str = "left", salts: int = SALTS
) -> DataFrame:
    """Join one row of facts per key to many rows.

    Rows of one key are spread over `salts` partitions by the column `spread` (one that varies inside a key)
    and the facts are repeated for each. Adaptive execution still turns this into a broadcast when the facts
    prove small enough at run time.
    """
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    repeated = facts.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(repeated, [*keys, "_salt"], how).drop("_salt")
