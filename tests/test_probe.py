"""The probe against MLlib and plain loops."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from marlstone.operators import probe as P


def rows_of(n, dims):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(n, dims))
    y = (x[:, 0] - 0.5 * x[:, 1] + rng.normal(size=n) > 0.9).astype(int)
    return [(i, [float(v) for v in x[i]], int(y[i])) for i in range(n)]


def test_newton_equals_mllib(spark):
    rows = rows_of(400, 5)
    df = spark.createDataFrame(rows, "id long, x array<double>, label int")
    found = P.fit(df.select("x", F.array("label").alias("y")).repartition(3), 5, 1, penalty=1.0)
    n, p = len(rows), sum(r[2] for r in rows)
    weight = F.when(F.col("label") == 1, n / (2 * p)).otherwise(n / (2 * (n - p)))
    data = df.select(array_to_vector("x").alias("features"), F.col("label").cast("double").alias("label"), weight.alias("w"))
    model = LogisticRegression(weightCol="w", regParam=1.0 / n, standardization=False, tol=1e-12, maxIter=500).fit(data)
    assert np.allclose(found.weights[0, :5], model.coefficients.toArray(), atol=1e-4) and abs(found.weights[0, 5] - model.intercept) < 1e-4
    assert found.steps < 15


def test_permutations_hold_all_labels(spark):
    rows = [(i, int(i % 7 == 0)) for i in range(60)]
    random.Random(2).shuffle(rows)
    got = P.permuted(spark.createDataFrame(rows, "id long, label int").repartition(4), "id", "label", [3, 4]).collect()
    labels = dict(rows)
    for k, seed in enumerate((3, 4), 1):
        order = sorted(labels, key=lambda i: hashlib.sha256(f"{seed}:{i}".encode()).hexdigest())
        assert {r.id: r.y[k] for r in got} == {i: labels[order[n]] for n, i in enumerate(sorted(labels))}
    assert {r.id: r.y[0] for r in got} == labels


def test_report_matches_plain_scores(spark):
    rows = rows_of(300, 4)
    df = spark.createDataFrame([*rows, (999, None, 1), (998, [1.0] * 4, None)], "id long, x array<double>, odd int")
    got = P.probe(df, "id", "x", "odd", F.col("id") % 3 == 0, [1, 2], 4).first()
    train = [r for r in rows if r[0] % 3]
    models = []
    for seed in (None, 1, 2):
        ids = sorted(r[0] for r in train)
        label = {r[0]: r[2] for r in train}
        order = sorted(ids, key=lambda i: hashlib.sha256(f"{seed}:{i}".encode()).hexdigest()) if seed else ids
        own = [(None, r[1], label[order[ids.index(r[0])]]) for r in train]
        models.append(P.fit(spark.createDataFrame([(x, [y]) for _, x, y in own], "x array<double>, y array<int>"), 4, 1).weights[0])
    held = [r for r in rows if r[0] % 3 == 0]
    score = [[float(np.dot(w[:4], r[1]) + w[4]) for r in held] for w in models]
    acc = [np.mean([(s > 0) == r[2] for s, r in zip(own, held, strict=True)]) for own in score]
    assert got.n_train == len(train) and got.n_test == len(held)
    assert got.accuracy == pytest.approx(acc[0]) and got.control_accuracy == pytest.approx(np.mean(acc[1:]))
    assert got.selectivity == pytest.approx(acc[0] - np.mean(acc[1:])) and got.least_selectivity == pytest.approx(acc[0] - max(acc[1:]))
    hits, ap = 0, 0.0
    for n, (_, r) in enumerate(sorted(zip(score[0], held, strict=True), key=lambda x: (-x[0], x[1][0])), 1):
        hits += r[2]
        ap += r[2] * hits / n
    assert got.average_precision == pytest.approx(ap / sum(r[2] for r in held))


def test_one_class_only(spark):
    df = spark.createDataFrame([([1.0], [1, 0]), ([2.0], [1, 0])], "x array<double>, y array<int>")
    assert P.fit(df, 1, 2).weights.tolist() == [[0.0, 1.0], [0.0, -1.0]]
