"""Vectors: cosine, nearest rows, diversity, late interaction, TF-IDF, clusters."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.operators.windows import numbered
from marlstone.storage import stash


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda t, x: t + x)


def norm(a: Column) -> Column:
    return F.greatest(F.sqrt(dot(a, a)), F.lit(1e-9))


def normalised(a: Column) -> Column:
    """SIM-07: a unit vector; the norm is at least 1e-9."""
    n = norm(a)
    return F.transform(a, lambda x: x.cast("double") / n)


def cosine(a: Column, b: Column) -> Column:
    """SIM-01."""
    return dot(a, b) / (norm(a) * norm(b))


def _blocks(df: DataFrame, id: str, vector: str, rows: int) -> DataFrame:
    """Rows packed in blocks of about ``rows`` unit vectors."""
    n = max(1, -(-df.count() // rows))
    dealt = df.select(F.pmod(F.xxhash64(id), F.lit(n)).cast("int").alias("block"), F.struct(F.col(id).cast("long").alias("i"), normalised(F.col(vector)).alias("v")).alias("row"))
    return dealt.groupBy("block").agg(F.sort_array(F.collect_list("row")).alias("rows"))


def nearest(queries: DataFrame, corpus: DataFrame, id: str, vector: str, k: int, block_rows: int = 2048, exclude_self: bool = True) -> DataFrame:
    """SIM-11, JOI-21/22: the ``k`` nearest corpus rows of a stated query set, by exact cosine, ties by id.

    Queries and corpus are dealt in blocks; each pair of blocks is one matrix
    product in a task that keeps its ``k`` best a query, and a window keeps the
    best of these. The blocks, a row each, are crossed, so each corpus block moves once for each block of queries:
    the queries must be few beside the corpus. Ids are whole numbers of any width. A row without one
    is no neighbour where a row is kept from itself; elsewhere it takes part, last among equals.
    """
    if exclude_self:
        queries, corpus = (df.where(F.col(id).isNotNull()) for df in (queries, corpus))
    q, c = _blocks(queries, id, vector, block_rows), _blocks(corpus, id, vector, block_rows)
    cells = q.select(F.col("block").alias("qb"), F.col("rows").alias("qrows")).crossJoin(c.select(F.col("block").alias("cb"), F.col("rows").alias("crows")))

    def part(rows: pa.Scalar) -> tuple[pa.Array, np.ndarray]:
        """Ids and vectors of a block, as they lie in the batch."""
        held = rows.values
        ids, vectors = held.field("i"), held.field("v")
        return ids, vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)

    def run(batches):
        for batch in batches:
            for qrows, crows in zip(batch.column("qrows"), batch.column("crows"), strict=True):
                (qi, qv), (ci, cv) = part(qrows), part(crows)
                places = ci.fill_null(np.iinfo(np.int64).max).to_numpy(zero_copy_only=False)
                for at in range(0, len(qi), 256):  # few queries at a time: their scores and orders are what a worker holds beside the batch
                    own = qi.slice(at, 256)
                    scores = np.round(qv[at : at + 256] @ cv.T, 9)
                    if exclude_self:
                        scores[own.to_numpy(zero_copy_only=False)[:, None] == places[None, :]] = -np.inf
                    order = np.lexsort((np.broadcast_to(places, scores.shape), -scores), axis=1)[:, :k]
                    best = np.take_along_axis(scores, order, axis=1).ravel()
                    there = np.isfinite(best)
                    at_query = np.repeat(np.arange(len(own)), order.shape[1])[there]
                    yield pa.RecordBatch.from_arrays([own.take(pa.array(at_query)), ci.take(pa.array(order.ravel()[there])), pa.array(best[there])], ["query", "neighbour", "score"])

    # a batch holds few pairs of blocks, however many a task has
    spark, few = cells.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(few)
    spark.conf.set(few, "4")
    try:
        found = stash(cells.mapInArrow(run, "query long, neighbour long, score double"), "nearest")
    finally:
        spark.conf.set(few, before)
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("neighbour")))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def _best(a: np.ndarray, b: np.ndarray, tile: int, ids: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The greatest product of each row of ``a`` and of ``b`` with the other side's rows; ``-inf`` where there is none.

    With ``ids``, in order, both sides are the same rows: a row meets those of other ids, and each pair is met once.
    """
    left, right = np.full(len(a), -np.inf), np.full(len(b), -np.inf)
    for x in range(0, len(a), tile):
        for y in range(0 if ids is None else x, len(b), tile):
            scores = a[x : x + tile] @ b[y : y + tile].T
            if ids is not None and ids[x : x + tile][-1] >= ids[y]:
                scores[ids[x : x + tile, None] == ids[None, y : y + tile]] = -np.inf
            for best, at, axis in ((left, x, 1), (right, y, 0)):
                np.maximum(best[at : at + tile], scores.max(axis), out=best[at : at + tile])
    return left, right


def nearest_of_all(df: DataFrame, id: str, vector: str, numbers: int = 2**22, least_groups: int = 8, tile: int = 512) -> DataFrame:
    """JOI-21: ``(id, score)``: the exact cosine of every row with the nearest of all rows that have another id.

    Rows are dealt by id in groups of about ``numbers`` vector elements. A pair of groups is a cell, and the
    cells form a triangle: a cell's matrix products, a tile at a time, serve the rows of both its groups, and
    it returns a row for each of them. Work grows with the square of the rows, and what is
    shuffled with the rows times the groups. Rows without an id have no neighbour and are none; a missing
    vector counts as an id without a score.
    """
    rows = df.where(F.col(id).isNotNull()).select(F.col(id).cast("long").alias("id"), F.col(vector).alias("v"))
    size = rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width")).first()
    groups = max(least_groups, -(-size["n"] * max(1, size["width"] or 1) // numbers))
    dealt = rows.withColumn("g", F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int")).withColumn("h", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    placed = dealt.select("id", "v", "g", F.least("g", "h").alias("i"), F.greatest("g", "h").alias("j"))

    def unit(held: pa.Table) -> np.ndarray:
        flat = held.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float)
        m = flat.reshape(held.num_rows, -1) if held.num_rows else np.zeros((0, 1))
        return m / np.maximum(np.sqrt(np.einsum("ij,ij->i", m, m)), 1e-9)[:, None]

    def run(key: tuple, cell: pa.Table) -> pa.Table:
        i, j = (x.as_py() for x in key)
        sides = []
        for g in (i, j) if i != j else (i,):
            side = cell.filter(pc.equal(cell.column("g"), g)).sort_by("id")
            ids, there = side.column("id").to_numpy(), side.column("v").is_valid()
            sides.append((ids, there.to_numpy(), unit(side.filter(there))))
        (a, ina, u), (b, inb, v) = sides[0], sides[-1]
        if i == j:
            left, right = _best(u, u, tile, a[ina])
            found = [(a, ina, np.maximum(left, right))] if len(a) and a[0] != a[-1] else []
        else:
            left, right = _best(u, v, tile)
            found = [(a, ina, left), (b, inb, right)] if len(a) and len(b) else []
        out = []
        for ids, there, best in found:
            score = np.full(len(ids), -np.inf)
            score[there] = best
            out.append(pa.table({"id": ids, "score": pa.array(score, mask=np.isneginf(score))}))
        return pa.concat_tables(out) if out else pa.table({"id": pa.array([], "int64"), "score": pa.array([], "float64")})

    found = placed.groupBy("i", "j").applyInArrow(run, "id long, score double")
    return found.groupBy("id").agg(F.max("score").alias("score"))


def mmr(df: DataFrame, group: str, id: str, vector: str, relevance: str, k: int, weight: float = 0.7) -> DataFrame:
    """SIM-02: maximal marginal relevance; ties go to the lowest id.

    A pick is one aggregate over all candidates, so a group may hold any share of
    the rows; only the picks of before, ``k`` a group at most, are joined back.
    """
    rows = df.select(group, id, vector, F.col(relevance).cast("double").alias("__rel"))
    picked = None
    for place in range(1, k + 1):
        if picked is None:
            scored = rows.withColumn("__score", weight * F.col("__rel"))
        else:
            before = picked.groupBy(group).agg(F.collect_list(F.struct(F.col(id).alias("i"), F.col(vector).alias("v"))).alias("__before"))
            held = rows.join(before, group).where(~F.array_contains(F.col("__before.i"), F.col(id)))
            near = F.array_max(F.transform("__before", lambda x: cosine(F.col(vector), x["v"])))
            scored = held.withColumn("__score", weight * F.col("__rel") - (1 - weight) * near)
        best = scored.groupBy(group).agg(F.min_by(F.struct(id, vector), F.struct(-F.col("__score"), id)).alias("__best"))
        best = best.select(group, F.col("__best")[id].alias(id), F.col("__best")[vector].alias(vector), F.lit(place).cast("long").alias("place"))
        picked = stash(best if picked is None else picked.union(best), "picks")
    return picked.select(group, id, "place")


def max_sim(queries: DataFrame, docs: DataFrame, how: str = "mean", block_rows: int = 2048) -> DataFrame:
    """SIM-05: late interaction: each query token's best document token, as mean or sum.

    ``queries(q, tok, v)`` and ``docs(d, v)`` hold one token vector a row; queries are a
    stated set. Both are dealt in blocks, and a pair of blocks is one matrix product
    that keeps a token's best of each document.
    """

    def packed(df: DataFrame, *keys: str) -> DataFrame:
        n = max(1, -(-df.count() // block_rows))
        dealt = df.withColumn("block", F.pmod(F.xxhash64(*keys, "v"), F.lit(n)))
        return dealt.groupBy("block").agg(F.collect_list(F.struct(*keys, F.transform("v", lambda x: x.cast("double")).alias("v"))).alias("rows")).drop("block")

    cells = packed(queries, "q", "tok").withColumnRenamed("rows", "a").crossJoin(packed(docs, "d").withColumnRenamed("rows", "b"))
    schema = queries.select("q", "tok").schema.add(docs.schema["d"]).add("m", "double")

    def run(batches):
        for pdf in batches:
            for a, b in zip(pdf["a"], pdf["b"], strict=True):
                scores = np.stack([r["v"] for r in a]) @ np.stack([r["v"] for r in b]).T
                names, of = np.unique(np.array([r["d"] for r in b]), return_inverse=True)
                best = np.full((len(names), len(a)), -np.inf)
                np.maximum.at(best, of, scores.T)
                yield pd.DataFrame({"q": [r["q"] for r in a] * len(names), "tok": [r["tok"] for r in a] * len(names), "d": np.repeat(names, len(a)), "m": best.ravel()})

    best = cells.mapInPandas(run, schema).groupBy("q", "tok", "d").agg(F.max("m").alias("m"))
    return best.groupBy("q", "d").agg((F.avg("m") if how == "mean" else F.sum("m")).alias("score"))


def shuffled_null(df: DataFrame, id: str, vector: str, permutations: int) -> DataFrame:
    """SIM-08: mean cosine of each row with the row that a permutation puts in its place; a row in its own place meets the next.

    Rows are numbered through range partitions, never in one window; only ids are sorted.
    """
    ids = numbered(df.select(id), [F.col(id)], "i")
    n = ids.count()
    turned = ids.select(F.explode(F.sequence(F.lit(0), F.lit(permutations - 1))).alias("permutation"), "i", id)
    key = F.sha2(F.concat_ws(":", F.col("permutation").cast("string"), F.col(id).cast("string")).cast("binary"), 256)
    placed = numbered(turned.select("permutation", "i", key.alias("h")), [F.col("permutation"), F.col("h")], "j").withColumn("j", F.col("j") - F.col("permutation") * n)
    placed = placed.select("permutation", "i", F.when(F.col("i") == F.col("j"), (F.col("j") + 1) % n).otherwise(F.col("j")).alias("j"))
    vectors = df.select(id, vector).join(ids, id)
    met = placed.join(vectors.select("i", F.col(vector).alias("a")), "i").join(vectors.select(F.col("i").alias("j"), F.col(vector).alias("b")), "j")
    return met.groupBy("permutation").agg(F.avg(cosine(F.col("a"), F.col("b"))).alias("mean"))


def tf_idf(docs: DataFrame, id: str, tokens: str, min_df: int = 2) -> DataFrame:
    """SIM-11: ``(id, term, weight)`` with smooth idf ``ln((1 + n) / (1 + df)) + 1`` and unit length.

    The texts are split once: counts are written and read for both uses.
    """
    n = docs.select(F.count("*").alias("n"))
    tf = stash(docs.select(id, F.explode(tokens).alias("term")).groupBy(id, "term").agg(F.count("*").alias("tf")), "tf")
    df = _small(tf.groupBy("term").agg(F.count("*").alias("df")).where(F.col("df") >= min_df))  # where terms are few, the counts stay where they are
    raw = tf.join(df, "term").crossJoin(F.broadcast(n)).withColumn("w", F.col("tf") * (F.ln((1 + F.col("n")) / (1 + F.col("df"))) + 1))  # n is one row
    length = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(id)))  # one document's terms
    return raw.select(id, "term", (F.col("w") / length).alias("weight"))


def centroids(df: DataFrame, label: str, vector: str) -> DataFrame:
    """Mean vector of each label, element by element: partial aggregates, no gathered group."""
    cells = df.select(label, F.posexplode(vector).alias("i", "x")).groupBy(label, "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return cells.groupBy(label).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda c: c["x"]).alias("centroid"))


def _small(df: DataFrame, most: int = 50_000) -> DataFrame:
    """``df``, written, to be sent to all tasks if it has ``most`` rows or fewer; beyond that Spark chooses how it meets the others."""
    held = stash(df, "small")
    return F.broadcast(held) if held.count() <= most else held


def assign(df: DataFrame, id: str, vector: str, centres: DataFrame, label: str) -> DataFrame:
    """SIM-17: labels ranked by cosine to a small set of centres, 0-based; ties by label."""
    scored = df.select(id, vector).crossJoin(_small(centres)).select(id, label, F.round(cosine(F.col(vector), F.col("centroid")), 9).alias("score"))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(id).orderBy(F.desc("score"), label)) - 1)


def silhouette(df: DataFrame, id: str, label: str, vector: str) -> DataFrame:
    """STA-30: mean cosine silhouette, exactly: by sums of unit vectors of each label rather than by pairs.

    The mean cosine to a label's rows is the dot product with the sum of their
    unit vectors, so a row needs one product a label.
    """
    unit = df.select(id, label, normalised(F.col(vector)).alias("u"))
    sums = centroids(unit, label, "u").join(unit.groupBy(label).agg(F.count("*").alias("n")), label)
    sums = sums.select(F.col(label).alias("other"), F.col("centroid").alias("c"), "n")
    met = unit.crossJoin(_small(sums))  # as many rows as labels
    own = F.col(label) == F.col("other")
    total = dot(F.col("u"), F.col("c")) * F.col("n")
    distance = F.when(own, 1 - (total - 1) / (F.col("n") - 1)).otherwise(1 - total / F.col("n"))
    by = met.select(id, label, own.alias("own"), F.col("n"), distance.alias("x")).groupBy(id, label).agg(F.max(F.when(F.col("own") & (F.col("n") > 1), F.col("x"))).alias("a"), F.min(F.when(~F.col("own"), F.col("x"))).alias("b"))
    return by.where("a IS NOT NULL AND b IS NOT NULL").groupBy(label).agg(F.avg((F.col("b") - F.col("a")) / F.greatest("a", "b")).alias("silhouette"))


def participation_ratio(df: DataFrame, vector: str, size: int) -> float:
    """STA-33: of the covariance's eigenvalues; the covariance is one aggregate of ``size**2`` sums."""
    def sums(pdfs):
        total, cross, n = np.zeros(size), np.zeros((size, size)), 0
        for pdf in pdfs:
            if len(pdf):
                m = np.stack(pdf[vector].to_list()).astype(float)
                total, cross, n = total + m.sum(0), cross + m.T @ m, n + len(m)
        yield pd.DataFrame({"n": [n], "total": [total.tolist()], "cross": [cross.ravel().tolist()]})

    rows = df.select(vector).mapInPandas(sums, "n long, total array<double>, cross array<double>")
    cells = rows.select("n", F.posexplode(F.concat("total", "cross")).alias("i", "x")).groupBy("i").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
    got = sorted(cells.collect(), key=lambda r: r.i)  # size + size**2 sums
    n, x = got[0].n, np.array([r.x for r in got])
    mean = x[:size] / n
    values = np.linalg.eigvalsh(x[size:].reshape(size, size) / n - np.outer(mean, mean))
    values = values[values > 1e-9]
    return float(values.sum() ** 2 / (values**2).sum())


def window_mean(df: DataFrame, id: str, vectors: Sequence[str]) -> DataFrame:
    """SIM-09: the unit mean of a row's window vectors."""
    mean = F.transform(F.col(vectors[0]), lambda x, i: x.cast("double") + sum((F.get(F.col(v), i).cast("double") for v in vectors[1:]), F.lit(0.0)))
    return df.select(id, normalised(mean).alias("vector"))


def assignment(cost: np.ndarray) -> np.ndarray:
    """SIM-18: for each row the column of the assignment with the least total cost (as many columns as rows at least)."""
    n, m = cost.shape
    u, v = np.zeros(n + 1), np.zeros(m + 1)
    owner = np.zeros(m + 1, int)  # the row that holds each column; 0 is none
    for row in range(1, n + 1):
        owner[0], at = row, 0
        least, back, used = np.full(m + 1, np.inf), np.zeros(m + 1, int), np.zeros(m + 1, bool)
        while owner[at]:  # grow a tree of tight edges until a free column is met
            used[at] = True
            slack = np.where(used[1:], np.inf, cost[owner[at] - 1] - u[owner[at]] - v[1:])
            better = slack < least[1:]
            least[1:][better], back[1:][better] = slack[better], at
            nearest = int(np.argmin(np.where(used[1:], np.inf, least[1:]))) + 1
            step = least[nearest]
            u[owner[used]] += step
            v[used] -= step
            least[~used] -= step
            at = nearest
        while at:
            owner[at] = owner[back[at]]
            at = back[at]
    out = np.empty(n, int)
    out[owner[1:][owner[1:] > 0] - 1] = np.flatnonzero(owner[1:] > 0)
    return out


def aligned(left: DataFrame, right: DataFrame, label: str, vector: str) -> DataFrame:
    """SIM-18: ``(label, other, cosine)`` of the one-to-one match of two sets of centroids with the largest mean cosine.

    Centroids are as many as labels, a hundred at most; one task solves.
    """
    a, b = (df.select(F.lit(side).alias("side"), F.col(label).alias("l"), F.col(vector).alias("v")) for side, df in ((0, left), (1, right)))
    schema = left.select(F.col(label).alias("label"), F.col(label).alias("other")).schema.add("cosine", "double")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["side", "l"])
        mine, theirs = (pdf[pdf["side"] == k] for k in (0, 1))
        unit = lambda x: np.stack(x["v"].to_list()) / np.maximum(np.linalg.norm(np.stack(x["v"].to_list()), axis=1, keepdims=True), 1e-9)
        scores = unit(mine) @ unit(theirs).T
        best = assignment(-scores)
        return pd.DataFrame({"label": mine["l"].to_numpy(), "other": theirs["l"].to_numpy()[best], "cosine": scores[np.arange(len(best)), best]})

    return a.union(b).withColumn("one", F.lit(0)).groupBy("one").applyInPandas(run, schema)


def lloyd(df: DataFrame, id: str, vector: str, k: int, rounds: int = 10) -> tuple[DataFrame, DataFrame]:
    """SIM-14/20: k-means by cosine: ``(centres(cluster, centroid), members(id, cluster, score))``.

    The first centres are the rows with the least hashes of their ids; each round is one
    look-up of the nearest centre and one aggregate by element.
    """
    rows = df.select(id, normalised(F.col(vector)).alias(vector))
    first = rows.orderBy(F.xxhash64(id), id).limit(k).withColumn("cluster", F.row_number().over(Window.orderBy(F.xxhash64(id), id)) - 1)  # k rows
    centres = stash(first.select("cluster", F.col(vector).alias("centroid")), "centres")
    for _ in range(rounds):
        placed = closest(rows, id, vector, centres)
        centres = stash(centroids(placed, "cluster", vector), "centres")
    return centres, closest(rows, id, vector, centres).select(id, "cluster", "score")


def closest(df: DataFrame, id: str, vector: str, centres: DataFrame) -> DataFrame:
    """``df`` with the nearest of a few centres and its cosine; ties by cluster."""
    held = F.broadcast(centres.agg(F.sort_array(F.collect_list(F.struct("cluster", "centroid"))).alias("__c")))  # k centres in one row
    scored = F.transform("__c", lambda c: F.struct((-F.round(cosine(F.col(vector), c["centroid"]), 9)).alias("d"), c["cluster"].alias("cluster")))
    best = F.array_min(scored)
    return df.crossJoin(held).withColumn("__b", best).select(*df.columns, F.col("__b.cluster").alias("cluster"), (-F.col("__b.d")).alias("score"))
