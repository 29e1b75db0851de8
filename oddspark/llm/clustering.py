"""Centroid clustering of integer vectors with a table of distances to fixed pivots."""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from oddspark.llm.shared import Work

DIM, CENTROIDS, ROUNDS = 64, 16, 3
#: Components are taken in steps of one part in so many.
STEPS = 64
#: Components up to this size have squared distances that fit a long.
LARGEST = 1 << 27
#: How far a bound in floating point may be off, relatively.
SLACK = 1e-9
#: Vectors that are compared in one go.
BLOCK = 8192


def whole_steps(vectors: DataFrame, dim: int) -> DataFrame:
    """vec_id, v: the vectors of ``dim`` finite components, as integers; v is null where one is too large."""
    exact = F.transform("embedding", lambda x: F.floor(F.lit(float(STEPS)) * x.cast("double")))
    fit = F.forall("embedding", lambda x: F.abs(F.lit(float(STEPS)) * x.cast("double")) < LARGEST)
    finite = F.forall("embedding", lambda x: F.coalesce(
        ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")), F.lit(False)))
    kept = vectors.select("vec_id", "embedding").where((F.size("embedding") == dim) & finite)
    return kept.select("vec_id", F.when(fit, exact).alias("v"))


def least_by_hash(vectors: DataFrame, prefix: str, n: int) -> np.ndarray:
    """The ``n`` vectors with the smallest hash of their id, so a bounded number; missing ids come last."""
    key = F.sha2(F.concat(F.lit(prefix), F.col("vec_id").cast("string")), 256)
    rows = vectors.where("v is not null").orderBy(key.asc_nulls_last(), "v").limit(n).collect()
    return np.array([r["v"] for r in rows], np.int64)


def distances(vectors: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Distances of all vectors to a few others, from exact squares."""
    return np.sqrt(np.stack([((vectors - o) ** 2).sum(axis=1) for o in others], axis=1).astype(float))


def nearest(v: np.ndarray, to_pivots: np.ndarray, centroids: np.ndarray, c_pivots: np.ndarray):
    """(number, squared distance, distances computed) of the nearest centroid of each vector; ties to the smaller number.

    The difference of two distances to a pivot is no more than the distance between the two. The
    centroid with the least such bound is measured first; of the others, those whose bound is
    above the best distance so far can't win and are left out.
    """
    bound = np.abs(to_pivots[:, None, :] - c_pivots[None, :, :]).max(axis=2)
    bound -= SLACK * (to_pivots.max(axis=1)[:, None] + c_pivots.max(axis=1)[None, :])
    number = bound.argmin(axis=1)
    best = ((v - centroids[number]) ** 2).sum(axis=1)
    measured, first = len(v), number.copy()
    for k in range(len(centroids)):
        open_ = np.flatnonzero((bound[:, k] <= np.sqrt(best.astype(float)) * (1 + SLACK)) & (first != k))
        d = ((v[open_] - centroids[k]) ** 2).sum(axis=1)
        nearer = (d < best[open_]) | ((d == best[open_]) & (k < number[open_]))
        number[open_[nearer]], best[open_[nearer]] = k, d[nearer]
        measured += len(open_)
    return number, best, measured


def matrix(column: pa.Array, kind) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(column), -1)


def parts_of(batches):
    for batch in batches:
        for lo in range(0, batch.num_rows, BLOCK):
            yield batch.slice(lo, BLOCK)


def with_pivots(vectors: DataFrame, pivots: np.ndarray) -> DataFrame:
    """``vectors`` (vec_id, v) with their distances to the pivots."""
    def run(batches):
        for part in parts_of(batches):
            far = distances(matrix(part.column(1), np.int64), pivots)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(list(far), pa.list_(pa.float64()))], ["vec_id", "v", "far"])

    kind = vectors.schema["vec_id"].dataType.simpleString()
    return vectors.mapInArrow(run, f"vec_id {kind}, v array<bigint>, far array<double>")


def sums_of(table: DataFrame, centroids: np.ndarray, pivots: np.ndarray) -> DataFrame:
    """cluster, place, total: sums over the vectors nearest to each centroid. Place 0 holds their number,
    place 1 the distances computed, the others the components. Every block of vectors is added up first."""
    c_pivots = distances(centroids, pivots)

    def run(batches):
        for part in parts_of(batches):
            v = matrix(part.column(0), np.int64)
            number, _, measured = nearest(v, matrix(part.column(1), float), centroids, c_pivots)
            held = np.unique(number)
            rows = [[int((number == k).sum()), 0, *v[number == k].sum(axis=0).tolist()] for k in held]
            rows[0][1] = measured
            yield pa.RecordBatch.from_arrays(
                [pa.array(held.astype(np.int32)), pa.array(rows, pa.list_(pa.int64()))], ["cluster", "total"])

    sums = table.select("v", "far").mapInArrow(run, "cluster int, total array<bigint>")
    return sums.select("cluster", F.posexplode("total").alias("place", "x")).groupBy("cluster", "place").agg(
        F.sum(F.col("x").cast("decimal(38,0)")).alias("total"))


def assigned(table: DataFrame, centroids: np.ndarray, pivots: np.ndarray) -> DataFrame:
    """vec_id, cluster, distance (squared) for every vector."""
    c_pivots = distances(centroids, pivots)

    def run(batches):
        for part in parts_of(batches):
            number, best, _ = nearest(matrix(part.column(1), np.int64), matrix(part.column(2), float), centroids, c_pivots)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(number.astype(np.int32)), pa.array(best)], ["vec_id", "cluster", "distance"])

    kind = table.schema["vec_id"].dataType.simpleString()
    return table.mapInArrow(run, f"vec_id {kind}, cluster int, distance bigint")


def cluster_vectors(
    vectors: DataFrame, centroids: int = CENTROIDS, rounds: int = ROUNDS, dim: int = DIM, on_round=None
) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 for every vector of ``dim`` finite components.

    The pivots are the starting centroids, so in the first round the bounds are the distances
    themselves. Distances to the pivots are computed once and stored beside the vectors; every round
    reads them, bounds all centroids and measures those left exactly. What a round returns to the
    driver is one list of sums per centroid. ``on_round(n, measured)`` hears after each round how many
    vectors there were and how many exact distances were needed.

    Vectors that are null, of another length, or hold null or non-finite components have no row.
    A vector with a component beyond ``LARGEST`` steps has a row of nulls but for its id, as its
    squared distances don't fit a long; it moves no centroid. An inertia that fits no long is null. Repeated rows count each;
    equal hashes (repeated or null ids) are ordered by the vector. With fewer vectors than centroids
    there are as many centroids; an empty table gives no rows. Only vec_id and embedding are read.
    """
    spark = vectors.sparkSession
    work = Work(spark, "clusters")
    kept = work.store(whole_steps(vectors, dim), "steps")
    usable = kept.where("v is not null").select("vec_id", "v")
    centres = least_by_hash(kept, "1:", centroids)
    empty = "cast(null as int) cluster", "cast(null as long) distance", "cast(null as long) cluster_inertia", \
        "cast(null as long) inertia", "cast(null as string) centroid_sha256"
    if not len(centres):
        return kept.selectExpr("vec_id", *empty)
    pivots = centres.copy()
    table = work.store(with_pivots(usable, pivots), "to-pivots")
    for _ in range(rounds):
        sums = np.zeros((len(centres), dim + 2), object)
        for r in sums_of(table, centres, pivots).collect():
            sums[r["cluster"], r["place"]] = int(r["total"])
        for k in np.flatnonzero(sums[:, 0]):
            centres[k] = sums[k, 2:] // sums[k, 0]
        if on_round:
            on_round(sums[:, 0].sum(), sums[:, 1].sum())
    final = work.store(assigned(table, centres, pivots), "assigned")
    work.drop("to-pivots")
    exact = final.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("own"))
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres.tolist()]
    # One row per centroid.
    per_cluster = exact.withColumn("all", F.sum("own").over(Window.partitionBy())).select(
        "cluster", F.expr("try_cast(own as long)").alias("cluster_inertia"), F.expr("try_cast(all as long)").alias("inertia"),
        F.element_at(F.array(*[F.lit(d) for d in digests]), F.col("cluster") + 1).alias("centroid_sha256"))
    done = final.join(F.broadcast(per_cluster), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
    return done.unionByName(kept.where("v is null").selectExpr("vec_id", *empty))
