"""Isolation forest: small random trees on bounded samples, built and applied in parallel."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import HASH_SPAN, row_hash

TREES = 300
SAMPLE = 256
# Fixed value: Euler's constant in the expected path length of an unsuccessful search.
EULER = 0.5772156649015329
NODE = "tree int, node int, feature int, split double, left int, right int, depth double"


def path_length(n: np.ndarray | float) -> np.ndarray:
    """Expected depth left below a leaf of n rows."""
    n = np.asarray(n, dtype=float)
    out = np.where(n == 2, 1.0, 0.0)
    big = n > 2
    m = np.where(big, n, 3.0)
    return np.where(big, 2.0 * (np.log(m - 1.0) + EULER) - 2.0 * (m - 1.0) / m, out)


def tree_samples(df: DataFrame, key: str, trees: int = TREES, sample: int = SAMPLE, seed: int = 42) -> DataFrame:
    """`tree` and the row, `sample` rows per tree (all rows if there are fewer), drawn by hash without replacement.

    A first draw keeps about trees * sample rows of the table; only these meet the trees. The oversized
    second draw (twice the sample) is then cut to the exact size.
    """
    total = df.count()
    share = min(1.0, 2.0 * trees * sample / max(total, 1))
    pool = df.where(row_hash(F.col(key), F.lit(1), seed) < share * HASH_SPAN)
    drawn_share = min(1.0, 2.0 * sample / max(total * share, 1.0))
    spread = pool.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))))
    hashed = spread.withColumn("_hash", row_hash(F.col(key), F.col("tree"), seed + 7))
    drawn = hashed.where(F.col("_hash") < drawn_share * HASH_SPAN)
    order = W.partitionBy("tree").orderBy("_hash", key)
    return drawn.withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= sample).drop("_place", "_hash")


def grow_tree(values: np.ndarray, rng: np.random.Generator, limit: int) -> list[tuple]:
    """Nodes `(node, feature, split, left, right, depth)`; leaves have feature -1 and their final depth."""
    nodes: list[tuple] = []
    waiting = [(0, np.arange(len(values)), 0)]
    size = 1
    while waiting:
        node, rows, depth = waiting.pop()
        part = values[rows]
        low, high = part.min(axis=0), part.max(axis=0)
        open_features = np.flatnonzero(high > low)
        if depth >= limit or len(rows) <= 1 or not len(open_features):
            nodes.append((node, -1, 0.0, -1, -1, depth + float(path_length(len(rows)))))
            continue
        feature = int(rng.choice(open_features))
        split = float(rng.uniform(low[feature], high[feature]))
        goes_left = part[:, feature] <= split
        nodes.append((node, feature, split, size, size + 1, 0.0))
        waiting += [(size, rows[goes_left], depth + 1), (size + 1, rows[~goes_left], depth + 1)]
        size += 2
    return nodes


def fit_forest(df: DataFrame, key: str, features: list[str], trees: int = TREES, sample: int = SAMPLE, seed: int = 42) -> DataFrame:
    """The nodes of all trees; a tree has at most 2 * sample - 1 of them."""
    vector = F.array(*[F.col(f).cast("double") for f in features]).alias("x")
    samples = tree_samples(df.select(key, vector), key, trees, sample, seed)

    def build(group: pd.DataFrame) -> pd.DataFrame:
        tree = int(group["tree"].iloc[0])
        group = group.sort_values(key)
        values = np.stack(group["x"].to_numpy())
        limit = int(np.ceil(np.log2(max(len(values), 2))))
        nodes = grow_tree(values, np.random.default_rng([seed, tree]), limit)
        out = pd.DataFrame(nodes, columns=["node", "feature", "split", "left", "right", "depth"])
        out.insert(0, "tree", tree)
        return out

    return samples.groupBy("tree").applyInPandas(build, NODE)


def forest_score(nodes: DataFrame, features: list[str], sample_rows: int) -> Column:
    """Anomaly score in (0, 1] of a row; higher is more isolated. The forest's size is set by its parameters."""
    frame = nodes.toPandas().sort_values(["tree", "node"])
    trees = [
        tuple(g[c].to_numpy() for c in ("feature", "split", "left", "right", "depth")) for _, g in frame.groupby("tree")
    ]
    scale = float(path_length(sample_rows)) or 1.0

    @F.pandas_udf("double")
    def score(vectors: pd.Series) -> pd.Series:
        x = np.stack(vectors.to_numpy())
        rows = np.arange(len(x))
        total = np.zeros(len(x))
        for feature, split, left, right, depth in trees:
            at = np.zeros(len(x), dtype=int)
            inside = feature[at] >= 0
            while inside.any():
                value = x[rows, np.maximum(feature[at], 0)]
                step = np.where(value <= split[at], left[at], right[at])
                at = np.where(inside, step, at)
                inside = feature[at] >= 0
            total += depth[at]
        return pd.Series(np.power(2.0, -total / len(trees) / scale))

    return score(F.array(*[F.col(f).cast("double") for f in features]))


def isolation_scores(
    train: DataFrame, rows: DataFrame, key: str, features: list[str], contamination: float = 0.08,
    trees: int = TREES, sample: int = SAMPLE, seed: int = 42,
) -> DataFrame:
    """Add `isolation_forest_score`: the score less its (1 - contamination) quantile on the train rows."""
    from .detect import upper_threshold

    nodes = fit_forest(train, key, features, trees, sample, seed)
    score = forest_score(nodes, features, min(sample, train.count()))
    shift = upper_threshold(train.select(score.alias("score")), "score", contamination).first()["threshold"]
    return rows.withColumn("isolation_forest_score", score - F.lit(shift))
