"""Clusters with kept products against a plain loop over all distances."""

import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from marlstone.llm import centroids


def brute(rows, k, rounds, dims, scale, seed):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]

    def order(row):
        return (row[0] is None, hashlib.sha256(f"{seed}:{row[0]}".encode()).hexdigest(), row[1])

    centres = [list(v) for _, v in sorted(kept, key=order)[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), i) for i, c in enumerate(centres))

    for _ in range(rounds):
        own = [[] for _ in centres]
        for _, v in kept:
            own[nearest(v)[1]].append(v)
        centres = [[sum(x) // len(vs) for x in zip(*vs, strict=True)] if vs else c for c, vs in zip(centres, own, strict=True)]
    return sorted(((i, *nearest(v)[::-1]) for i, v in kept), key=str), centres


def rows_of(seed, n, dims):
    rnd = random.Random(seed)
    middles = [[rnd.uniform(-1, 1) for _ in range(dims)] for _ in range(4)]
    rows = [(i, [x + rnd.gauss(0, 0.3) for x in rnd.choice(middles)]) for i in range(n)]
    bad = [None, [], [1.0] * (dims + 1), [math.nan] + [0.0] * (dims - 1), [math.inf] + [0.0] * (dims - 1), [None] + [0.0] * (dims - 1)]
    rows += [(1000 + i, v) for i, v in enumerate(bad)]
    return [*rows, *rows[:5], *[(2000 + i, rows[0][1]) for i in range(60)], (None, [0.5] * dims)]


@pytest.mark.parametrize(("n", "k", "rounds"), [(80, 8, 10), (80, 5, 1), (40, 3, 0), (3, 200, 4)])
def test_matches_brute_force(spark, n, k, rounds):
    rows = rows_of(n + k, n, 4)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("cluster", F.lit("clash")).withColumn("v", F.lit(1))
    found = centroids.cluster(df.repartition(3), k=k, rounds=rounds, dims=4, scale=64)
    want, centres = brute(rows, k, rounds, 4, 64, 3)
    assert found.centroids == centres
    assert sorted(((r.id, r.cluster, r.distance) for r in found.rows.collect()), key=str) == want
    for r in centroids.report(found).collect():
        assert r.inertia == sum(d for *_, d in want) and r.cluster_inertia == sum(d for _, c, d in want if c == r.cluster)
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, centres[r.cluster])).encode()).hexdigest()


def test_only_changes_are_applied():
    assert centroids.changes([[1, 2, 3], [4, 5, 6]], [[1, 2, 3], [4, 9, 5]]) == [(1, [1, 2], [4, -1])]


def test_an_empty_cluster_keeps_its_centroid(spark):
    rows = [(i, [1.0, 1.0]) for i in range(6)]  # equal centroids: the first takes all
    found = centroids.cluster(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), k=3, dims=2, scale=1)
    assert found.centroids == [[1, 1]] * 3 and {r.cluster for r in found.rows.collect()} == {0} and found.rounds == 0


def test_no_vectors(spark):
    df = spark.createDataFrame([(1, [math.nan])], "vec_id long, embedding array<double>")
    for empty in (df, df.limit(0)):
        got = centroids.report(centroids.cluster(empty, dims=1))
        assert got.collect() == [] and got.columns == ["id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_huge_components_are_refused(spark):
    df = spark.createDataFrame([(1, [1e30]), (2, [0.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="would not fit"):
        centroids.cluster(df, dims=1)
