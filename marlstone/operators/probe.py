"""A linear probe: how well a straight line through vectors tells two classes, and how much of that is memory.

Logistic regression by Newton steps. A step needs the gradient and the matrix of second derivatives, which
are sums over rows: each task adds up its own, and the sums meet in one aggregate of ``(dims + 1)^2`` numbers for a model. The
driver solves that small system and holds no rows. The true labels and their permutations are
fitted in the same passes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.operators.evaluation import average_precision
from marlstone.operators.windows import numbered
from marlstone.storage import stash


@dataclass
class Fit:
    """Weights of each model, the intercept last, and the steps that were taken."""

    weights: np.ndarray
    steps: int


def _design(column: pa.Array, dims: int) -> np.ndarray:
    x = column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dims)
    return np.hstack([x, np.ones((len(x), 1))])


def fit(rows: DataFrame, dims: int, models: int, penalty: float = 1.0, most_steps: int = 25, still: float = 1e-8) -> Fit:
    """Fit ``models`` logistic regressions to ``rows(x array<double>, y array<int>)``; ``y`` has a 0 or 1 for each model.

    Classes are weighted so that both weigh half of all rows. The loss is the weighted sum of log losses plus
    ``penalty / 2`` times the squared weights without the intercept. A model without rows of both
    classes has zero weights but for an intercept that tells its class. Steps end when no weight moves by ``still``.
    """
    counts = rows.select(F.posexplode("y").alias("m", "v")).groupBy("m").agg(F.count("*").alias("n"), F.sum("v").alias("p")).collect()  # a row a model
    n, p = np.zeros(models), np.zeros(models)
    for r in counts:
        n[r.m], p[r.m] = r.n, r.p
    both = (p > 0) & (p < n)
    weight = np.ones((models, 2))
    weight[both] = np.stack([n[both] / (2 * (n - p)[both]), n[both] / (2 * p[both])], axis=1)
    size = dims + 1
    w = np.zeros((models, size))
    w[~both, -1] = np.where(p[~both] > 0, 1.0, -1.0)
    ridge = penalty * np.diag([1.0] * dims + [0.0])
    taken = 0
    for _ in range(most_steps if both.any() else 0):
        current = w.copy()

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            gradient, second = np.zeros((models, size)), np.zeros((models, size, size))
            for batch in batches:
                if not batch.num_rows:
                    continue
                x, y = _design(batch.column("x"), dims), batch.column("y").flatten().to_numpy(zero_copy_only=False).reshape(-1, models)
                for m in range(models):
                    guess = 1 / (1 + np.exp(-np.clip(x @ current[m], -500, 500)))
                    own = weight[m][y[:, m]]
                    gradient[m] += x.T @ (own * (guess - y[:, m]))
                    second[m] += (x * (own * guess * (1 - guess))[:, None]).T @ x
            flat = np.concatenate([gradient.ravel(), second.ravel()])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat)], ["at", "v"])

        flat = np.zeros(models * size * (size + 1))
        for r in rows.select("x", "y").mapInArrow(sums, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).collect():
            flat[r["at"]] = r["v"]
        gradient, second = flat[: models * size].reshape(models, size), flat[models * size :].reshape(models, size, size)
        for m in np.flatnonzero(both):
            w[m] -= np.linalg.solve(second[m] + ridge + 1e-12 * np.eye(size), gradient[m] + ridge @ w[m])
        taken += 1
        if np.abs(w - current).max() < still:
            break
    return Fit(w, taken)


def permuted(rows: DataFrame, id: str, label: str, seeds: list[int]) -> DataFrame:
    """``rows`` with ``y``: the label, and for each seed a permutation of all labels, by SHA-256 of seed and id.

    The label at a place of the order by hash goes to the row at that place of the order by id.
    """
    key = F.col(id).cast("string")
    placed = numbered(rows, [F.col(id)], "__i")
    out = placed.withColumn("y", F.array(F.col(label).cast("int")))
    for s in seeds:
        other = numbered(rows.select(id, F.col(label).cast("int").alias("__other")), [F.sha2(F.concat(F.lit(f"{s}:"), key).cast("binary"), 256), F.col(id)], "__i").select("__i", "__other")
        out = out.join(other, "__i").withColumn("y", F.concat("y", F.array("__other"))).drop("__other")
    return out.drop("__i")


def scores(rows: DataFrame, dims: int, found: Fit) -> DataFrame:
    """``rows`` with ``score``: each model's log odds."""
    dot = [sum_of_products(F.col("x"), row[:-1].tolist()) + float(row[-1]) for row in found.weights]
    return rows.withColumn("score", F.array(*dot))


def sum_of_products(x: Column, weights: list[float]) -> Column:
    return F.aggregate(F.zip_with(x, F.array(*map(F.lit, weights)), lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)


def probe(rows: DataFrame, id: str, vector: str, label: str, held_out: Column, seeds: list[int], dims: int, penalty: float = 1.0) -> DataFrame:
    """One row: ``accuracy`` and ``control_accuracy`` on the rows held out, ``selectivity`` and its least over the seeds, ``average_precision``, ``n_train``, ``n_test``.

    Labels are 0 and 1. The controls are fitted to permuted labels of the training rows and judged by the true ones. Ids must be unique; rows with a null vector,
    label or id are left out.
    """
    x = F.transform(vector, lambda v: v.cast("double"))
    whole = rows.where(F.col(id).isNotNull() & F.col(label).isNotNull() & F.size(vector).eqNullSafe(dims))
    whole = stash(whole.select(F.col(id).alias("id"), x.alias("x"), F.col(label).cast("int").alias("label"), held_out.alias("held")), "probe")
    train = stash(permuted(whole.where("NOT held"), "id", "label", seeds).select("x", "y"), "train")
    found = fit(train, dims, 1 + len(seeds), penalty)
    judged = stash(scores(whole.where("held"), dims, found).select("id", "label", "score"), "scores")
    right = [F.avg((F.get("score", F.lit(m)) > 0).cast("int").eqNullSafe(F.col("label")).cast("double")) for m in range(1 + len(seeds))]
    one = judged.agg(F.array(*right).alias("a"), F.count("*").alias("n_test"))
    controls = F.slice("a", 2, len(seeds)) if seeds else F.array().cast("array<double>")
    gaps = F.transform(controls, lambda c: F.get("a", F.lit(0)) - c)
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v) / F.nullif(F.size(a), F.lit(0))
    ap = average_precision(judged, [F.get("score", F.lit(0)).desc(), F.col("id")], "label")
    out = one.select(F.get("a", F.lit(0)).alias("accuracy"), mean(controls).alias("control_accuracy"), mean(gaps).alias("selectivity"), F.array_min(gaps).alias("least_selectivity"), "n_test")
    return out.crossJoin(ap.select(F.col("ap").alias("average_precision"))).withColumn("n_train", F.lit(train.count()))  # one row each
