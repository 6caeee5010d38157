"""Exact nearest neighbours and the local outlier factor built on them.

Vectors are placed on rings around a few pivots. By the triangle inequality a ring can only hold a nearest
neighbour of a query if its lower distance bound does not exceed the query's upper bound. Rings next to each
other are gathered into areas of bounded size, busy rings are cut into several; each query visits the areas with
rings that it needs and no others. A task holds one area and one chunk of queries. It estimates distances by a
matrix product, whose rounding error is bounded, and takes the exact distance of every pair that the bound does
not rule out; it returns the nearest of the area for each query. Equal vectors are one row with a weight, so a
large group of copies costs as much as one vector.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.joins import attach_facts
from ..session import written

SLACK = 1e-9
#: Vectors of an area and queries of a chunk; queries and vectors compared at once; pairs whose exact distances are taken at once.
BLOCK = 32_768
ASKED_AT_ONCE = 256
KNOWN_AT_ONCE = 4_096
PAIRS_AT_ONCE = 1 << 17
#: A product in single precision is made anew in double precision if it leaves more than one pair in so many.
SPARSE = 32


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of all rows of a to all rows of b, one dimension at a time."""
    total = np.zeros((len(a), len(b)))
    for d in range(a.shape[1]):
        total += np.square(a[:, d, None] - b[None, :, d])
    return np.sqrt(total)


class Known:
    """Vectors of an area that are compared at once, moved to their mean, and the squares of their lengths."""

    def __init__(self, vectors: np.ndarray):
        self.vectors, self.center = vectors, vectors.mean(axis=0)
        moved = vectors - self.center
        squares = np.square(moved).sum(axis=1)
        self.widest = squares.max()
        self.double = np.vstack([moved.T, squares])
        self.single = self.double.astype(np.float32)

    def not_ruled_out(self, asked: np.ndarray, k: int, limit: np.ndarray, kind: type = np.float32) -> np.ndarray:
        """Flat places of all pairs that can be among the `k` nearest of a query, or nearer than the root of `limit`.

        The squared distance less the query's own square is one product. Its rounding error is at most a multiple of the
        lengths of both vectors, which is added on either side. Values that are none, or too large, rule nothing out."""
        moved = asked - self.center
        own = np.square(moved).sum(axis=1)
        if not own.max() + self.widest < np.finfo(np.float32).max / 64:
            return np.arange(len(asked) * len(self.vectors))
        single = kind is np.float32
        rough = np.column_stack([-2 * moved, np.ones(len(asked))]).astype(kind) @ (self.single if single else self.double)
        reach = np.finfo(kind).eps * (2 * np.sqrt(own * self.widest) + self.widest) + np.finfo(float).eps * own
        error = 4 * (asked.shape[1] + 8) * reach + np.finfo(kind).tiny
        bound = limit - own
        fresh = np.flatnonzero(limit == np.inf)
        if len(fresh) and rough.shape[1] >= k:
            bound[fresh] = np.partition(rough[fresh], k - 1, axis=1)[:, k - 1] + error[fresh]
        found = np.flatnonzero(rough <= np.nextafter((bound + error).astype(kind), kind(np.inf))[:, None])
        if single and len(found) * SPARSE > rough.size + SPARSE * k * len(asked):
            return self.not_ruled_out(asked, k, limit, np.float64)
        return found


def nearest_pairs(asked: np.ndarray, known: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """`rows, cols, dist` of the `k` nearest rows of `known` for each row of `asked`, nearest first, equal distances in the
    order of `known`. The distances are those of `distances`."""
    out = []
    blocks = [Known(known[i : i + KNOWN_AT_ONCE]) for i in range(0, len(known), KNOWN_AT_ONCE)]
    for start in range(0, len(asked), ASKED_AT_ONCE):
        part = asked[start : start + ASKED_AT_ONCE]
        rows, cols, dist = np.empty(0, int), np.empty(0, int), np.empty(0)
        limit = np.full(len(part), np.inf)
        for i, block in enumerate(blocks):
            places = block.not_ruled_out(part, k, limit)
            for cut in range(0, len(places), PAIRS_AT_ONCE):
                r, c = np.divmod(places[cut : cut + PAIRS_AT_ONCE], len(block.vectors))
                squares = np.square(part[r] - block.vectors[c])
                total = np.zeros(len(r))
                for d in range(squares.shape[1]):
                    total += squares[:, d]
                rows, cols = np.concatenate([rows, r]), np.concatenate([cols, c + i * KNOWN_AT_ONCE])
                dist = np.concatenate([dist, np.sqrt(total)])
                order = np.lexsort((cols, dist, rows))
                rows, cols, dist = rows[order], cols[order], dist[order]
                place = np.arange(len(rows)) - np.searchsorted(rows, rows)
                last = place == k - 1
                limit[rows[last]] = np.nan_to_num(np.square(dist[last]) * (1 + 1e-12), nan=np.inf, posinf=np.inf)
                rows, cols, dist = rows[place < k], cols[place < k], dist[place < k]
        out.append((rows + start, cols, dist))
    return tuple(np.concatenate([o[i] for o in out]) for i in range(3))


def distinct_vectors(df: DataFrame, key: str, vector: str) -> DataFrame:
    """`ref, vec, weight`: one row per distinct vector, named after its smallest key."""
    doubles = df.select(key, F.col(vector).cast("array<double>").alias("vec"))
    return doubles.groupBy("vec").agg(F.min(key).alias("ref"), F.count(F.lit(1)).alias("weight"))


def nearest(
    queries: DataFrame, refs: DataFrame, k: int, pivots: int = 16, rings: int = 8, block: int = BLOCK
) -> DataFrame:
    """The `k` nearest rows of `refs (ref, vec, weight)` for each row of `queries (q, vec)`, nearest first:
    `q, dist, ref, weight, place`. Equal distances are ordered by `ref`."""
    # `pivots` vectors, then at most pivots * rings summary rows, reach the driver.
    centers = np.array([r["vec"] for r in refs.orderBy(F.xxhash64("ref"), "ref").limit(pivots).collect()])

    @F.pandas_udf("cell int, radius double")
    def place(vectors: pd.Series) -> pd.DataFrame:
        d = distances(np.stack(vectors.to_numpy()), centers)
        cell = d.argmin(axis=1)
        return pd.DataFrame({"cell": cell.astype("int32"), "radius": d[np.arange(len(d)), cell]})

    placed = written(refs.withColumn("p", place("vec")).select("ref", "vec", "weight", "p.cell", "p.radius"), "placed")
    widest = placed.agg(F.max("radius")).first()[0] or 0.0
    width = widest / rings if widest > 0 else 1.0
    ring = F.least(F.floor(F.col("radius") / width), F.lit(rings - 1)).cast("int")
    home = (F.col("cell") * rings + ring).cast("int")
    summary = (
        placed.groupBy(home.alias("home"), "cell")
        .agg(F.count(F.lit(1)).alias("n"), F.count("radius").alias("whole"), F.min("radius").alias("low"), F.max("radius").alias("high"))
        .orderBy("home")
        .collect()
    )
    homes = np.array([r["home"] for r in summary], dtype="int32")
    cells = np.array([r["cell"] for r in summary])
    sizes = np.array([r["n"] for r in summary])
    low = np.array([r["low"] for r in summary])
    high = np.array([r["high"] for r in summary])

    # Rings of less than a block share an area with those next to them, larger ones have areas of their own.
    firsts, counts, room = [], [], 0
    for n in sizes.tolist():
        if n > room or not firsts:
            firsts.append(firsts[-1] + counts[-1] if firsts else 0)
            room = block
        else:
            firsts.append(firsts[-1] + counts[-1] - 1)
        counts.append(-(-n // block))
        room = room - n if n <= block else 0
    last = firsts[-1] + counts[-1] if firsts else 0
    held = np.zeros((len(homes), last + 1), dtype="float32")
    for i, (first, n) in enumerate(zip(firsts, counts)):
        held[i, first : first + n] = 1
    # Vectors with missing elements have no distance. They fill up the ring they fall into where it holds fewer than k whole
    # vectors, from an area of their own.
    gaps = [(i, k - r["whole"]) for i, r in enumerate(summary) if r["whole"] < min(r["n"], k)]
    filling = [r["ref"] for _, n in gaps for r in placed.where("radius IS NULL").orderBy("ref").limit(n).select("ref").collect()]
    held[[i for i, _ in gaps], last] = 1

    @F.pandas_udf("array<int>")
    def visits(vectors: pd.Series) -> pd.Series:
        to_pivot = distances(np.stack(vectors.to_numpy()), centers)[:, cells]
        upper, lower = to_pivot + high, np.maximum(np.maximum(to_pivot - high, low - to_pivot), 0.0)
        order = np.argsort(upper, axis=1)
        reached = np.cumsum(sizes[order], axis=1) >= k
        first = np.where(reached.any(axis=1), reached.argmax(axis=1), len(homes) - 1)
        rows = np.arange(len(upper))
        bound = np.where(reached.any(axis=1), upper[rows, order[rows, first]], np.inf)
        needed = (lower <= bound[:, None] + SLACK).astype("float32") @ held > 0
        return pd.Series([np.flatnonzero(n).astype("int32") for n in needed])

    visiting = written(queries.select("q", "vec", visits("vec").alias("areas")), "visits")
    visitors = {r["area"]: r["count"] for r in visiting.select(F.explode("areas").alias("area")).groupBy("area").count().collect()}

    def looked_up(values: dict[int, int], at: str):
        return F.element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), F.col(at))

    chunks = {area: -(-n // block) for area, n in visitors.items()}
    first_area, areas = ({int(h): n for h, n in zip(homes, ns)} for ns in (firsts, counts))
    if not chunks:
        chunks, first_area, areas = {0: 1}, first_area or {0: 0}, areas or {0: 1}
    left = visiting.withColumn("area", F.explode("areas")).drop("areas").withColumn(
        "chunk", F.pmod(F.xxhash64("q"), looked_up(chunks, "area")).cast("int")
    )
    right = (
        placed.where(F.col("radius").isNotNull() | F.col("ref").isin(filling))
        .select("ref", "vec", "weight", "radius", home.alias("home"))
        .withColumn("area", looked_up(first_area, "home") + F.pmod(F.xxhash64("ref"), looked_up(areas, "home")).cast("int"))
        .withColumn("area", F.when(F.col("radius").isNull(), F.lit(last)).otherwise(F.col("area")))
        .where(F.col("area").isin(list(chunks)))
        .withColumn("chunk", F.explode(F.sequence(F.lit(0), looked_up(chunks, "area") - 1)))
        .drop("home", "radius")
    )
    q_type, ref_type = dict(queries.dtypes)["q"], dict(refs.dtypes)["ref"]
    schema = f"q {q_type}, dist double, ref {ref_type}, weight long"

    def compare(asked: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        if asked.empty or known.empty:
            return pd.DataFrame(columns=["q", "dist", "ref", "weight"])
        known = known.sort_values("ref")
        rows, cols, dist = nearest_pairs(np.stack(asked["vec"].to_numpy()), np.stack(known["vec"].to_numpy()), k)
        return pd.DataFrame(
            {
                "q": asked["q"].to_numpy()[rows],
                "dist": dist,
                "ref": known["ref"].to_numpy()[cols],
                "weight": known["weight"].to_numpy()[cols],
            }
        )

    keys = ["area", "chunk"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(compare, schema)
    ordered = F.slice(F.array_sort(F.collect_list(F.struct("dist", "ref", "weight"))), 1, k)
    return (
        found.groupBy("q").agg(ordered.alias("near")).select("q", F.posexplode("near").alias("place", "n")).select("q", "n.*", "place")
    )


def _within(neighbours: DataFrame, k: int) -> DataFrame:
    """Keep neighbours until their weights add up to `k`; the last weight is cut to fit."""
    listed = neighbours.where("weight > 0").groupBy("q").agg(
        F.array_sort(F.collect_list(F.struct("dist", "ref", "weight"))).alias("near")
    )
    counted = F.aggregate(
        "near",
        F.struct(F.lit(0).cast("long").alias("seen"), F.array().cast("array<struct<dist:double,ref:long,used:long>>").alias("kept")),
        lambda a, n: F.struct(
            (a["seen"] + n["weight"]).alias("seen"),
            F.when(
                a["seen"] < k,
                F.concat(a["kept"], F.array(F.struct(n["dist"].alias("dist"), n["ref"].cast("long").alias("ref"), F.least(n["weight"], k - a["seen"]).alias("used")))),
            ).otherwise(a["kept"]).alias("kept"),
        ),
    )
    return listed.select("q", counted["kept"].alias("near"))


def local_outlier_factor(
    train: DataFrame, rows: DataFrame, key: str, vector: str, k: int = 35, pivots: int = 16
) -> DataFrame:
    """`key, local_outlier_factor_score` of `rows` against `train`: mean local density of the k nearest train
    vectors over the own local density. `key` is a whole number."""
    refs = written(distinct_vectors(train, key, vector), "train-vectors")
    total = refs.agg(F.sum("weight")).first()[0]
    k = max(1, min(k, total - 1))
    asked = written(distinct_vectors(rows, key, vector).select(F.col("ref").alias("q"), "vec"), "asked-vectors")
    # A train vector is not its own neighbour, but its copies are.
    own = refs.select(F.col("ref").alias("q"), "vec")
    known = nearest(own, refs, k + 1, pivots)
    others = known.withColumn("weight", F.when(F.col("q") == F.col("ref"), F.col("weight") - 1).otherwise(F.col("weight")))
    train_near = written(_within(others, k), "train-neighbours")
    reach = train_near.select(F.col("q").alias("ref"), F.element_at("near", -1)["dist"].alias("reach"))

    def density(near: DataFrame) -> DataFrame:
        flat = near.select("q", F.explode("near").alias("n")).select("q", "n.*")
        met = attach_facts(flat, reach, ["ref"], "q", "inner")
        far = F.sum(F.col("used") * F.greatest("reach", "dist")) / F.sum("used")
        return met.groupBy("q").agg((1.0 / (far + 1e-10)).alias("density"))

    train_density = density(train_near).select(F.col("q").alias("ref"), F.col("density").alias("near_density"))
    near = written(_within(nearest(asked, refs, k, pivots), k), "asked-neighbours")
    flat = near.select("q", F.explode("near").alias("n")).select("q", "n.*")
    around = attach_facts(flat, train_density, ["ref"], "q", "inner")
    mean = around.groupBy("q").agg((F.sum(F.col("used") * F.col("near_density")) / F.sum("used")).alias("mean"))
    scores = mean.join(density(near), "q").select("q", (F.col("mean") / F.col("density")).alias("local_outlier_factor_score"))
    # Back from distinct vectors to rows, by a hash; vectors are compared only where two of them share one.
    same = F.xxhash64(F.transform("vec", lambda x: x + F.lit(0.0))).alias("same")
    several = F.collect_list(F.struct("vec", "local_outlier_factor_score"))
    scored = asked.join(scores, "q", "left").select(same, "vec", "local_outlier_factor_score").groupBy("same").agg(several.alias("several"))
    alone = F.size("several") == 1
    facts = scored.select(
        "same",
        F.when(alone, F.col("several")[0]["local_outlier_factor_score"]).alias("only"),
        F.when(~alone, F.col("several")).alias("several"),
    )
    wanted = rows.select(key, F.col(vector).cast("array<double>").alias("vec")).where("vec is not null").select(key, "vec", same)
    met = attach_facts(wanted, facts, ["same"], key, "inner")
    own_score = F.get(F.filter("several", lambda s: s["vec"] == F.col("vec")), F.lit(0))["local_outlier_factor_score"]
    score = F.when(F.col("several").isNull(), F.col("only")).otherwise(own_score)
    return met.select(key, score.alias("local_outlier_factor_score")).where("local_outlier_factor_score IS NOT NULL")
