"""Helpers for work dealt over shards: bit sets of fixed size, rows of one shard together, connected components."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wearlens.session import written


def bit_set(values: DataFrame, column: str, bits: int) -> np.ndarray:
    """A bit per possible value of the top `bits` bits of a long column, set where a row has it: 2^bits bits at any size of input.

    The driver gets at most 2^(bits - 5) rows of two numbers.
    """
    filled = (
        values.select(F.expr(f"shiftrightunsigned({column}, {64 - bits})").alias("slot"))
        .select(F.expr("shiftright(slot, 5)").alias("word"), F.expr("shiftleft(1L, cast(slot & 31 as int))").alias("bit"))
        .groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    )
    table = np.zeros(1 << (bits - 5), np.uint32)
    table[filled["word"].to_numpy()] = filled["bits"].to_numpy().astype(np.uint32)
    return table


def in_bit_set(table: np.ndarray, values: np.ndarray) -> np.ndarray:
    slot = values.view(np.uint64) >> np.uint64(64 - (len(table) * 32 - 1).bit_length())
    return (table[(slot >> np.uint64(5)).astype(np.int64)] >> (slot & np.uint64(31)).astype(np.uint32)) & np.uint32(1) == 1


#: Rows that carry whole texts or sets, at a time.
ROWS = 1000
IN_BATCH, IN_SCAN = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize"


def limit_rows(spark: SparkSession, key: str, rows: int = ROWS) -> str:
    """Lower a setting of the session to `rows` rows; what it was before."""
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(before)) if int(before) > 0 else rows))
    return before


@contextmanager
def few_rows(spark: SparkSession, rows: int = ROWS) -> Iterator[None]:
    """At most `rows` rows in an Arrow batch of the jobs run meanwhile: rows that carry long texts or sets stay few at a time."""
    before = limit_rows(spark, IN_BATCH, rows)
    try:
        yield
    finally:
        spark.conf.set(IN_BATCH, before)


def stored(df: DataFrame, name: str, rows: int = ROWS) -> DataFrame:
    """`written` with `few_rows`."""
    with few_rows(df.sparkSession, rows):
        return written(df, name)


def shard_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[pa.RecordBatch]]]:
    """The rows of each shard, from batches in which equal values of `shard` follow each other."""
    current, parts = None, []
    for batch in batches:
        shards = batch.column("shard").to_numpy(zero_copy_only=False)
        edges = [0, *(np.flatnonzero(shards[1:] != shards[:-1]) + 1).tolist(), len(shards)]
        for a, b in zip(edges, edges[1:], strict=False):
            if a == b:
                continue
            if current is not None and shards[a] != current:
                yield current, parts
                parts = []
            current = int(shards[a])
            parts.append(batch.slice(a, b - a))
    if parts:
        yield current, parts


def joined(parts: list[pa.RecordBatch], column: str, dtype: type) -> np.ndarray:
    """The arrays kept as bytes in a column, one after another."""
    cells = [np.frombuffer(x.as_buffer(), dtype) for p in parts for x in p.column(column) if x.is_valid]
    return np.concatenate(cells) if cells else np.empty(0, dtype)


def dealt(rows: DataFrame) -> DataFrame:
    """Rows of a shard in one partition, shard after shard; there are more shards than partitions, each small enough for a task."""
    return rows.repartition("shard").sortWithinPartitions("shard")


def components(edges: DataFrame) -> DataFrame:
    """node, label: the smallest node reachable over the rows (a, b). Labels are halved towards their root after every pass.

    Each pass is written to the shared folder, so that no lineage grows and lost executors cost one pass.
    """
    both = written(edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = written(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")), "labels")
    while True:
        near = (
            both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        )
        lower = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        roots = labels.select(F.col("node").alias("label"), F.col("label").alias("root"))
        after = written(
            lower.join(roots, "label", "left").select("node", F.least("label", F.coalesce("root", "label")).alias("label"), "old"), "labels"
        )
        moved = after.where("label <> old").limit(1).count()
        labels = after.select("node", "label")
        if not moved:
            return labels
