"""Centroid clustering whose nearest centroids are found by the threshold algorithm.

Vectors become integers (floor of ``scale`` times each component), so distances and means are exact and a rerun agrees. The
first centroids are the vectors with the smallest SHA-256 of ``<seed>:<id>``; each round assigns every vector to its
nearest centroid (squared distance, ties to the smaller number) and replaces each centroid that has vectors by the floor of
their mean; then vectors are assigned once more.

Nearest centroids: for each dimension the centroids are kept in a list sorted by their value there. From a vector's value
all lists are walked outward at once, nearest entry first. A centroid that comes up for the first time gets its exact
distance. The squares of the entries last seen, summed over the lists, bound the distance of every centroid not yet seen
from below; a vector stops when that sum strictly exceeds its best exact distance (an equal one might still be a centroid
of a smaller number). Vectors are walked in blocks, one step for all that are still open.

Scale: a round is one pass over the vectors and no shuffle of them; each partition hands on one sum per centroid and
dimension, which Spark adds up. Only centroids reach the driver (``clusters`` x ``dimensions`` numbers, whatever the number of
vectors), and only they are sent to the tasks. The integer vectors are written once to the shared folder.

Nulls and ties: vectors that are null, have another number of components, or hold a null, an infinite or a NaN are left out;
so are those with a component of 2^20 or more in size, whose squared distances need not fit a long. A null id never
starts a centroid but is assigned. Rows that repeat an id are vectors of their own (of equal hashes, the lesser
components come first). With fewer vectors than clusters there are as many centroids as vectors with an id; without any there are no
rows. Only id and vector are read, so further columns of any name do no harm.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanveil.llm.common import column, kept

CLUSTERS, DIMENSIONS, ROUNDS, SCALE, SEED = 40, 64, 5, 256.0, 2
LIMIT = float(1 << 20)
BLOCK = 1024  # vectors walked at once: a few MB whatever the partition holds
FAR = np.int64(1) << np.int64(31)  # of a list that is used up; 64 x FAR^2 is never summed, see ``nearest``


def integer_vectors(table: DataFrame, id_column: str, vector_column: str, dimensions: int, scale: float) -> DataFrame:
    """id, v (little-endian 64-bit integers) of every vector that counts."""

    def work(batches):
        for batch in batches:
            ids, lists = batch.column(0), batch.column(1)
            sizes = np.array([n if n is not None else -1 for n in pa.compute.list_value_length(lists).to_pylist()])
            apt = np.flatnonzero(sizes == dimensions)
            flat = lists.take(pa.array(apt)).flatten()
            values = np.where(
                flat.is_null().to_numpy(zero_copy_only=False), np.nan, flat.to_numpy(zero_copy_only=False).astype(np.float64)
            ).reshape(-1, dimensions)
            with np.errstate(invalid="ignore"):
                good = (np.abs(values) < LIMIT).all(1)  # false for NaN
            whole = np.floor(values[good] * scale).astype("<i8")
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(apt[good])), pa.array([row.tobytes() for row in whole], pa.binary())], names=["id", "v"]
            )

    narrow = table.select(column(id_column).cast("bigint").alias("id"), column(vector_column).cast("array<double>").alias("vec"))
    return narrow.mapInArrow(work, "id bigint, v binary")


def first_centroids(vectors: DataFrame, clusters: int, seed: int) -> np.ndarray:
    sha = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    rows = vectors.where(F.col("id").isNotNull()).select(sha.alias("sha"), "v").orderBy("sha").limit(clusters)
    found = [(r.sha, tuple(np.frombuffer(r.v, "<i8").tolist())) for r in rows.collect()]
    return np.array([v for _, v in sorted(found)], np.int64)


def nearest(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of ``vectors`` its nearest row of ``centroids`` and the squared distance, by the threshold algorithm."""
    k, dims = centroids.shape
    order = np.argsort(centroids, axis=0, kind="stable")
    values = np.take_along_axis(centroids, order, 0)
    n = len(vectors)
    best, number = np.full(n, np.iinfo(np.int64).max), np.full(n, k)
    high = np.stack([np.searchsorted(values[:, d], vectors[:, d]) for d in range(dims)], 1)
    low, seen = high - 1, np.zeros((n, k), bool)
    open_rows, each = np.arange(n), np.arange(dims)
    for _ in range(k):
        own = vectors[open_rows]
        lo, hi = low[open_rows], high[open_rows]
        down = np.where(lo >= 0, own - values[np.maximum(lo, 0), each], FAR)
        up = np.where(hi < k, values[np.minimum(hi, k - 1), each] - own, FAR)
        below = down <= up
        centroid = order[np.where(below, np.maximum(lo, 0), np.minimum(hi, k - 1)), each]
        low[open_rows], high[open_rows] = lo - below, hi + ~below
        fresh = np.zeros((len(open_rows), k), bool)
        fresh[np.arange(len(open_rows))[:, None], centroid] = True
        fresh &= ~seen[open_rows]
        seen[open_rows] |= fresh
        row, met = np.nonzero(fresh)
        exact = ((own[row] - centroids[met]) ** 2).sum(1)
        distance = np.full((len(open_rows), k), np.iinfo(np.int64).max)
        distance[row, met] = exact
        least = distance.argmin(1)  # the smaller number of equal ones
        found = distance[np.arange(len(open_rows)), least]
        better = (found < best[open_rows]) | ((found == best[open_rows]) & (least < number[open_rows]))
        best[open_rows[better]], number[open_rows[better]] = found[better], least[better]
        frontier = (np.where(below, down, up) ** 2).sum(1)
        open_rows = open_rows[~((frontier > best[open_rows]) | seen[open_rows].all(1))]
        if not len(open_rows):
            break
    return number, best


def _blocks(batches, dimensions: int):
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            part = batch.slice(at, BLOCK)
            yield part, np.frombuffer(b"".join(part.column(1).to_pylist()), "<i8").reshape(-1, dimensions).astype(np.int64)


def new_centroids(vectors: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """One round: the floor of the mean of each centroid's vectors; a centroid without any stays."""
    k, dims = centroids.shape

    def work(batches):
        sums, counts = np.zeros((k, dims), np.int64), np.zeros(k, np.int64)
        for _, own in _blocks(batches, dims):
            number, _ = nearest(own, centroids)
            np.add.at(sums, number, own)
            counts += np.bincount(number, minlength=k)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(some), pa.array(counts[some]), pa.array(sums[some].tolist(), pa.list_(pa.int64()))],
            names=["cluster", "n", "sums"],
        )

    parts = vectors.mapInArrow(work, "cluster bigint, n bigint, sums array<bigint>")
    each = parts.select("cluster", "n", F.posexplode("sums").alias("d", "s"))
    whole = "decimal(38,0)"
    added = each.groupBy("cluster", "d").agg(F.sum(F.col("n").cast(whole)).alias("n"), F.sum(F.col("s").cast(whole)).alias("s"))
    out = centroids.copy()
    for r in added.collect():  # clusters x dimensions rows
        out[r.cluster, r.d] = int(r.s) // int(r.n)
    return out


def assigned(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """id, cluster, distance."""
    dims = centroids.shape[1]

    def work(batches):
        for part, own in _blocks(batches, dims):
            number, distance = nearest(own, centroids)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(number.astype(np.int32)), pa.array(distance)], names=["id", "cluster", "distance"]
            )

    return vectors.mapInArrow(work, "id bigint, cluster int, distance bigint")


def clustered(
    table: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", clusters: int = CLUSTERS,
    dimensions: int = DIMENSIONS, rounds: int = ROUNDS, scale: float = SCALE, seed: int = SEED,
) -> tuple[DataFrame, DataFrame]:
    """(id, cluster, distance) of every vector, and (cluster, centroid, centroid_sha256, cluster_inertia, inertia) of every
    centroid that has vectors."""
    spark = table.sparkSession
    vectors = kept(integer_vectors(table, id_column, vector_column, dimensions, scale))
    centroids = first_centroids(vectors, clusters, seed)
    if not len(centroids):
        none = "cluster int, centroid array<bigint>, centroid_sha256 string, cluster_inertia bigint, inertia bigint"
        return spark.createDataFrame([], "id bigint, cluster int, distance bigint"), spark.createDataFrame([], none)
    for _ in range(rounds):
        centroids = new_centroids(vectors, centroids)
    found = kept(assigned(vectors, centroids))
    rows = [
        (k, [int(x) for x in c], hashlib.sha256(",".join(str(int(x)) for x in c).encode()).hexdigest())
        for k, c in enumerate(centroids)
    ]
    known = spark.createDataFrame(rows, "cluster int, centroid array<bigint>, centroid_sha256 string")
    inertia = found.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    whole = found.agg(F.sum("distance").alias("inertia"))
    return found, known.join(inertia, "cluster").join(F.broadcast(whole))


def with_inertia(found: DataFrame, centres: DataFrame) -> DataFrame:
    """Every vector with what its centroid has; there are ``clusters`` centroids at most, which bounds the broadcast."""
    return found.join(F.broadcast(centres), "cluster")
