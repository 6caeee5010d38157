"""Centroid clustering of integer vectors over an incrementally kept distance matrix.

Components become integers, so that every sum is exact. Each vector keeps its exact dot product with every centroid. When
centroids move, a vector's dot products change by the changed components alone: the change of a centroid, taken at its nonzero
components, times the vector there. The nearest centroid is then the argmin of |c|^2 - 2 c.v; |v|^2 is added for the distance.
Vectors are never shuffled. A round writes the table of dot products anew, adds up each cluster within tasks and moves
`k x dimensions` numbers between them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wearlens.session import written

DIMENSIONS = 64
SCALE = 64
CLUSTERS = 16
ROUNDS = 3
SEED = 1


def largest(dimensions: int) -> int:
    """Components up to this size keep every squared distance, and twice every dot product, below 2^63."""
    return math.isqrt((1 << 62) // dimensions) // 2


def integer_vectors(embeddings: DataFrame, dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """vec_id and v, the floor of `scale` times each component, of the vectors with `dimensions` finite components."""
    x = F.col("embedding")
    finite = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e.cast("double")) & (F.abs(e.cast("double")) < float("inf")))
    whole = F.transform(x, lambda e: F.floor(e.cast("double") * scale))
    kept = embeddings.where(x.isNotNull() & (F.size(x) == dimensions)).where(F.coalesce(finite, F.lit(False))).select("vec_id", whole.alias("v"))
    limit = largest(dimensions)
    small = F.forall("v", lambda e: e.between(-limit, limit))
    return kept.select("vec_id", F.when(small, F.col("v")).otherwise(F.raise_error(F.lit(f"A vector component exceeds {limit} after scaling."))).alias("v"))


def first_centroids(vectors: DataFrame, clusters: int, seed: int) -> list[list[int]]:
    """The vectors of the smallest sha256 of `seed:vec_id`, in that order; equal hashes in the order of their components."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    return [list(r["v"]) for r in vectors.select(digest.alias("hash"), "v").orderBy("hash", "v").limit(clusters).collect()]


def _vectors(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(batch.num_rows, -1)


def _changes(old: np.ndarray, new: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per centroid the components that change, and by how much."""
    return [(at := np.flatnonzero(delta), delta[at]) for delta in new - old]


def _assigned(batches: Iterator[pa.RecordBatch], old: np.ndarray, new: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Dot products brought from `old` to `new` centroids, the nearest of these, and its squared distance."""
    moves, squares = _changes(old, new), (new * new).sum(1)
    for batch in batches:
        v, k = _vectors(batch), len(new)
        dots = batch.column("dots").flatten().to_numpy(zero_copy_only=False).reshape(-1, k).copy() if "dots" in batch.schema.names else np.zeros((len(v), k), np.int64)
        for c, (at, by) in enumerate(moves):
            if len(at):
                dots[:, c] += v[:, at] @ by
        relative = squares - 2 * dots
        cluster = relative.argmin(1)  # the first of equal ones
        distance = relative[np.arange(len(v)), cluster] + (v * v).sum(1)
        edges = pa.array(np.arange(0, k * len(v) + 1, k), pa.int32())
        yield pa.RecordBatch.from_arrays(
            [batch.column("vec_id"), batch.column("v"), pa.ListArray.from_arrays(edges, pa.array(dots.reshape(-1))), pa.array(cluster, pa.int32()), pa.array(distance)],
            names=["vec_id", "v", "dots", "cluster", "distance"],
        )


def _sums(batches: Iterator[pa.RecordBatch], clusters: int) -> Iterator[pa.RecordBatch]:
    """Counts and component sums of the clusters in a batch."""
    for batch in batches:
        v, cluster = _vectors(batch), batch.column("cluster").to_numpy()
        order = np.argsort(cluster, kind="stable")
        found, first, counts = np.unique(cluster[order], return_index=True, return_counts=True)
        sums = np.add.reduceat(v[order], first, axis=0) if len(v) else np.empty((0, v.shape[1]), np.int64)
        n = v.shape[1]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.repeat(found, n).astype(np.int32)), pa.array(np.tile(np.arange(n), len(found)).astype(np.int32)),
                pa.array(sums.reshape(-1)), pa.array(np.repeat(counts, n).astype(np.int64)),
            ],
            names=["cluster", "component", "total", "size"],
        )


def moved_centroids(assigned: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Floor of the mean of each cluster's vectors; a cluster without vectors keeps its centroid."""
    parts = assigned.select("v", "cluster").mapInArrow(lambda b: _sums(b, len(centroids)), "cluster int, component int, total bigint, size bigint")
    whole = parts.groupBy("cluster", "component").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("size").alias("size"))
    out = centroids.copy()
    for r in whole.collect():  # one row per cluster and component
        out[r["cluster"], r["component"]] = int(r["total"]) // r["size"]
    return out


def clustered(
    embeddings: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED, dimensions: int = DIMENSIONS, scale: int = SCALE
) -> DataFrame:
    """Per kept vector: vec_id, cluster, distance (squared), centroid (the final one's components).

    Vectors of another length, null vectors and those with a null or non-finite component are left out. Fewer vectors than
    `clusters` make as many centroids as there are vectors; none give no rows. Equal vectors, repeated vec_ids and a null vec_id
    are vectors of their own, the last with the hash of the empty id. Of equally near centroids the smaller number counts. A
    component beyond `largest(dimensions)` after scaling raises, since distances would leave 64 bits. Other columns are not read.
    """
    kind = embeddings.schema["vec_id"].dataType.simpleString()
    table = written(integer_vectors(embeddings.select("vec_id", "embedding"), dimensions, scale).select("vec_id", F.col("v").cast("array<int>").alias("v")), "vectors")
    chosen = first_centroids(table, clusters, seed)
    if not chosen:
        return table.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("bigint").alias("distance"), F.col("v").cast("array<bigint>").alias("centroid"))
    schema = f"vec_id {kind}, v array<int>, dots array<bigint>, cluster int, distance bigint"
    before, now = np.zeros((len(chosen), dimensions), np.int64), np.array(chosen, np.int64)
    for i in range(rounds + 1):
        table = written(table.mapInArrow(lambda b, old=before, new=now: _assigned(b, old, new), schema), f"dot-products-{i}")
        if i < rounds:
            before, now = now, moved_centroids(table, now)
    spark = embeddings.sparkSession
    names = spark.createDataFrame([(i, [int(x) for x in c]) for i, c in enumerate(now)], "cluster int, centroid array<bigint>")  # `clusters` rows
    return table.select("vec_id", "cluster", "distance").join(F.broadcast(names), "cluster").select("vec_id", "cluster", "distance", "centroid")


def with_inertia(rows: DataFrame) -> DataFrame:
    """`cluster_inertia` and `inertia`: distances summed over the row's cluster and over all rows."""
    sums = rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("sum")).collect()  # one row per cluster
    total = sum(int(r["sum"]) for r in sums)
    spark = rows.sparkSession
    known = spark.createDataFrame([(r["cluster"], int(r["sum"]), total) for r in sums], "cluster int, cluster_inertia bigint, inertia bigint")
    return rows.join(F.broadcast(known), "cluster")

