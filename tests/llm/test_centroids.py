import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wearlens.llm import centroids
from wearlens.llm.catalog import QUERIES

from . import helpers

SCHEMA = "vec_id bigint, embedding array<float>"


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def expected(rows, k=16, rounds=3, size=64):
    """vec_id, cluster, distance, cluster_inertia, inertia, hash of the centroid, all distances taken anew each time."""
    kept = [
        (d, [math.floor(64 * float(np.float32(x))) for x in v]) for d, v in rows
        if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)
    ]
    means = [v for _, v in sorted(kept, key=lambda r: (digest(f"1:{'' if r[0] is None else r[0]}"), r[1]))[:k]]
    for i in range(rounds + 1):
        spans = [[sum((a - b) ** 2 for a, b in zip(v, c, strict=True)) for c in means] for _, v in kept]
        own = [s.index(min(s)) for s in spans]
        for c in range(len(means)):
            members = [v for (_, v), o in zip(kept, own, strict=True) if o == c]
            if i < rounds and members:
                means[c] = [sum(x) // len(members) for x in zip(*members, strict=True)]
    spans = [min(s) for s in spans]
    sums = [sum(d for d, o in zip(spans, own, strict=True) if o == c) for c in range(len(means))]
    return [(d, o, s, sums[o], sum(spans), digest(",".join(map(str, means[o])))) for (d, _), o, s in zip(kept, own, spans, strict=True)]


def rows_of(df):
    text = F.array_join(F.transform("centroid", lambda c: c.cast("string")), ",")
    return [tuple(r) for r in centroids.with_inertia(df).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", F.sha2(text, 256)).collect()]


def test_against_plain_rounds(spark):
    r = random.Random(2)
    rows = [(i, [r.gauss(i % 7, 0.6) for _ in range(64)]) for i in range(250)]
    common = [r.gauss(3, 1) for _ in range(64)]
    rows += [(1000 + i, common) for i in range(120)] + [(5, common), (5, rows[0][1]), (None, common)]
    bad = [r.random() for _ in range(64)]
    rows += [(2000, None), (2001, []), (2002, bad[:63]), (2003, [*bad, 1.0]), (2004, [None, *bad[1:]]), (2005, [float("nan"), *bad[1:]]), (2006, [float("-inf"), *bad[1:]])]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("cluster", F.lit("x")).withColumn("v", F.lit(1)).withColumn("dots", F.lit(1))
    assert sorted(rows_of(centroids.clustered(docs)), key=str) == sorted(expected(rows), key=str)


def test_ties_few_vectors_and_none(spark):
    rows = [(i, [float(i % 2)] * 64) for i in range(40)]  # many equal centroids: the smallest number takes all
    docs = spark.createDataFrame(rows, SCHEMA)
    assert sorted(rows_of(centroids.clustered(docs))) == sorted(expected(rows))
    few = rows[:3]
    assert sorted(rows_of(centroids.clustered(spark.createDataFrame(few, SCHEMA)))) == sorted(expected(few))
    assert centroids.with_inertia(centroids.clustered(docs.limit(0))).count() == 0


def test_dot_products_follow_the_centroids():
    import pyarrow as pa

    r = np.random.default_rng(0)
    v, old = r.integers(-50, 50, (30, 64)), r.integers(-50, 50, (4, 64))
    new = old.copy()
    new[1, [3, 60]] += [5, -2]
    new[2] = r.integers(-50, 50, 64)
    assert [len(at) for at, _ in centroids._changes(old, new)][:2] == [0, 2]
    batch = pa.RecordBatch.from_arrays([pa.array(range(30)), pa.array(v.astype(np.int32).tolist(), pa.list_(pa.int32()))], names=["vec_id", "v"])
    first = next(centroids._assigned(iter([batch]), np.zeros_like(old), old))
    second = next(centroids._assigned(iter([first]), old, new))
    assert second.column("dots").to_pylist() == (v @ new.T).tolist()
    assert second.column("distance").to_pylist() == ((v[:, None] - new[None]) ** 2).sum(2).min(1).tolist()


def test_components_beyond_the_limit_raise(spark):
    docs = spark.createDataFrame([(1, [1e30] * 64)], SCHEMA)
    with pytest.raises(Exception, match="exceeds"):
        centroids.clustered(docs)
    edge = centroids.largest(64) / 64
    rows = [(i, [edge * (-1) ** i] * 64) for i in range(4)]
    assert sorted(rows_of(centroids.clustered(spark.createDataFrame(rows, SCHEMA), clusters=1))) == sorted(expected(rows, k=1))


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{helpers.SF}/embeddings.parquet").select("vec_id", "embedding").collect()]
    found = QUERIES["op13_centroid_clustering"](spark, helpers.SF)
    names = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert found.columns == names and sorted(tuple(r) for r in found.collect()) == sorted(expected(rows))
