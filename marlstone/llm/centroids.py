"""Centroid clustering of integer vectors with an incremental distance matrix.

Vectors and centroids are integers, so every dot product is exact. Each row keeps
its dot products with all centroids. A round moves few components of few
centroids; only those components' changes are multiplied and added to the kept
products, and the nearest centroid follows from ``|v|^2 - 2 v.c + |c|^2``.
Component sums are kept the same way: only rows that changed their cluster
are added to one and taken from another.

A round is one pass over the rows, written to the shared folder with their
products, and an aggregate over the rows that moved. The driver holds ``k``
centroids, their sums and nothing that grows with the rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from marlstone.storage import discard, stash

#: Components beyond this could overflow a squared distance in 64 bits (64 components: 2^6 * 2^56).
MOST_COMPONENT = 2**27


def integer_vectors(rows: DataFrame, id: str, vector: str, dims: int, scale: int) -> DataFrame:
    """``(id, v)``: floor(scale * x) of vectors with exactly ``dims`` components, none null, NaN or infinite; other rows are left out."""
    x = F.col(vector)
    whole = F.size(x).eqNullSafe(dims) & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < math.inf))
    kept = rows.where(whole)
    # what is beyond the bound stays beyond it; the rows' first pass refuses it
    scaled = F.transform(x, lambda e: F.greatest(F.least(F.floor(e.cast("double") * scale), F.lit(2**30)), F.lit(-(2**30))).cast("int"))
    return kept.select(F.col(id).alias("id"), scaled.alias("v"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _lists(values: np.ndarray) -> pa.ListArray:
    n, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(values.reshape(-1)))


def changes(before: list[list[int]], after: list[list[int]]) -> list[tuple[int, list[int], list[int]]]:
    """``(centroid, components, differences)`` of the centroids that moved: nonzero differences only."""
    found = []
    for c, (old, new) in enumerate(zip(before, after, strict=True)):
        moved = [j for j in range(len(old)) if old[j] != new[j]]
        if moved:
            found.append((c, moved, [new[j] - old[j] for j in moved]))
    return found


def _assign(state: DataFrame, centroids: list[list[int]], moved: list[tuple[int, list[int], list[int]]] | None) -> DataFrame:
    """The rows with their products brought up to date, their nearest centroid, and the one before.

    ``moved`` None: the first round, products are computed in full.
    """
    first = moved is None
    k, dims = len(centroids), len(centroids[0])
    centres = np.array(centroids, np.int64)
    lengths = (centres**2).sum(axis=1)
    schema = state.select("id", "v").schema.add("norm", "long").add("dots", ArrayType(LongType())).add("cluster", "integer").add("before", "integer").add("distance", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            v = _matrix(batch.column("v"), dims)
            if first:
                if len(v) and max(int(v.max()), -int(v.min())) > MOST_COMPONENT:
                    raise ValueError(f"a component is beyond {MOST_COMPONENT}: its squared distances would not fit in 64 bits")
                v64 = v.astype(np.int64)
                norm, dots = (v64**2).sum(axis=1), v64 @ centres.T
                before = pa.nulls(len(v), pa.int32())
            else:
                norm, dots = batch.column("norm").to_numpy(), _matrix(batch.column("dots"), k).copy()
                for c, components, differences in moved:
                    dots[:, c] += v[:, components].astype(np.int64) @ np.array(differences, np.int64)
                before = batch.column("cluster")
            squared = norm[:, None] - 2 * dots + lengths
            nearest = squared.argmin(axis=1)  # of equal distances the smaller number
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("v"), pa.array(norm), _lists(dots), pa.array(nearest.astype(np.int32)), before, pa.array(squared[np.arange(len(v)), nearest])],
                ["id", "v", "norm", "dots", "cluster", "before", "distance"],
            )

    return state.mapInArrow(run, schema)


def _moves(state: DataFrame, dims: int) -> DataFrame:
    """What rows that changed their cluster add to one and take from another: ``(cluster, n, s0 ... )``, a row a cluster."""
    moved = state.where(~F.col("cluster").eqNullSafe(F.col("before")))
    signed = moved.select("v", F.explode(F.array(F.struct(F.col("cluster").alias("c"), F.lit(1).cast("long").alias("sign")), F.struct(F.col("before").alias("c"), F.lit(-1).cast("long").alias("sign")))).alias("x"))
    signed = signed.where("x.c IS NOT NULL").select(F.col("x.c").alias("c"), F.col("x.sign").alias("sign"), "v")
    sums = (F.sum(F.col("sign") * F.col("v")[j]).alias(f"s{j}") for j in range(dims))
    return signed.groupBy("c").agg(F.sum("sign").alias("n"), *sums)


@dataclass
class Clusters:
    """``rows(id, v, cluster, distance)``, the final centroids, and how many rounds moved one."""

    rows: DataFrame
    centroids: list[list[int]]
    rounds: int


def first_centroids(vectors: DataFrame, k: int, seed: int) -> list[list[int]]:
    """The ``k`` vectors with the smallest SHA-256 of ``seed:id``, in that order; of repeated ids, by components; null ids last."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")).cast("binary"), 256)
    least = vectors.select("v", order.alias("h")).orderBy(F.col("h").asc_nulls_last(), "v").limit(k)
    return [r.v for r in least.collect()]


def cluster(rows: DataFrame, id: str = "vec_id", vector: str = "embedding", k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, seed: int = 3) -> Clusters:
    """Assign every vector to one of ``k`` centroids, after ``rounds`` rounds of assigning and averaging.

    Vectors of another size, and those with null, NaN or infinite components, are
    left out. Repeated rows count each; a null id is kept. With fewer than ``k``
    vectors there are fewer centroids; with none there are no rows. An empty
    cluster keeps its centroid; of equal distances the smaller number wins.
    Components beyond 2^27 after scaling raise an error. Other columns are left out.

    Rounds after one that moves no centroid change nothing and are not run.
    """
    vectors = stash(integer_vectors(rows, id, vector, dims, scale), "vectors")
    centroids = first_centroids(vectors, k, seed)
    if not centroids:
        none = vectors.select("id", "v", F.lit(None).cast("int").alias("cluster"), F.lit(None).cast("long").alias("distance"))
        return Clusters(none, [], 0)
    counts, sums = [0] * len(centroids), [[0] * dims for _ in centroids]
    state, moved, done = vectors, None, 0
    for _ in range(rounds):
        following = stash(_assign(state, centroids, moved), "clusters")
        discard(state)
        state = following
        for row in _moves(state, dims).collect():  # a row a cluster
            counts[row.c] += row.n
            sums[row.c] = [s + row[f"s{j}"] for j, s in enumerate(sums[row.c])]
        updated = [[s // n for s in own] if n else old for old, own, n in zip(centroids, sums, counts, strict=True)]
        moved = changes(centroids, updated)
        if not moved:
            break
        centroids, done = updated, done + 1
    if moved or moved is None:
        following = stash(_assign(state, centroids, moved), "clusters")
        discard(state)
        state = following
    return Clusters(state.select("id", "v", "cluster", "distance"), centroids, done)


def centroid_digest(centroid: list[int]) -> str:
    """SHA-256 of the components as decimals with commas between."""
    return hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()


def report(found: Clusters) -> DataFrame:
    """``(id, cluster, distance, cluster_inertia, inertia, centroid_sha256)``: sums of distances by cluster and over all, from a row a cluster."""
    by_cluster = {r.cluster: r.inertia for r in found.rows.groupBy("cluster").agg(F.sum("distance").alias("inertia")).collect()}
    total = sum(by_cluster.values())

    def of(values: dict[int, object], kind: str) -> Column:
        pairs = [F.lit(x) for c, value in values.items() for x in (c, value)]
        return (F.create_map(*pairs)[F.col("cluster")] if pairs else F.lit(None)).cast(kind)

    digests = {c: centroid_digest(x) for c, x in enumerate(found.centroids)}
    return found.rows.select(
        "id", "cluster", "distance", of(by_cluster, "long").alias("cluster_inertia"), F.lit(total).cast("long").alias("inertia"), of(digests, "string").alias("centroid_sha256")
    )
