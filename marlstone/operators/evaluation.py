"""Evaluation statistics as DataFrame work."""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence
from functools import reduce
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from marlstone.operators.windows import running
from marlstone.storage import stash


def brier(belief: Column, right: Column) -> Column:
    """STA-22: of one belief."""
    return F.when(right, (1 - belief) * (1 - belief)).otherwise(belief * belief)


def hit_rate(rank: Column, k: int) -> Column:
    """AGG-18: the share of 1-based ranks up to ``k``."""
    return F.avg((rank <= k).cast("int"))


def register_score(lead: Column, machine: Column, entropy: Column) -> Column:
    """STA-03."""
    return F.round(0.4 * (1 - lead) + 0.4 * (1 - machine) + 0.2 * F.greatest(F.lit(0.0), 1 - F.abs(entropy - 0.516) / 0.516), 3)


def null_normalised(raw: Column, mean: Column, p95: Column) -> Column:
    """STA-36: 0 at the null's mean, 1 at its 95th percentile; 0.5 without spread."""
    return F.when(F.abs(p95 - mean) < 1e-6, 0.5).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), (raw - mean) / (p95 - mean))))


def banded(x: Column, points: Sequence[tuple[float, float]]) -> Column:
    """STA-38: piecewise linear between band points, clamped at both ends."""
    out = F.when(x <= points[0][0], float(points[0][1]))
    for (a, ya), (b, yb) in zip(points, points[1:], strict=False):
        out = out.when(x <= b, ya + (yb - ya) * (x - a) / (b - a))
    return out.otherwise(float(points[-1][1]))


def compression_ratio(df: DataFrame, text: str) -> DataFrame:
    """STA-06: raw bytes over deflated bytes of each text; 0 for empty ones."""

    @F.pandas_udf("long")
    def packed(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: len(zlib.compress(t.encode(), 6)) if t else 0)

    return df.select(*(c for c in df.columns if c != text), F.octet_length(text).alias("raw"), packed(F.col(text)).alias("packed")).withColumn("ratio", F.when(F.col("packed") > 0, F.col("raw") / F.col("packed")).otherwise(0.0))


def jensen_shannon(counts: DataFrame, a: str, b: str) -> DataFrame:
    """STA-10: divergence in bits of two count columns."""
    total = counts.agg(F.sum(a).alias("__ta"), F.sum(b).alias("__tb"))
    p, q = F.col(a) / F.col("__ta"), F.col(b) / F.col("__tb")
    part = lambda x: F.when(x > 0, x * F.log2(2 * x / (p + q))).otherwise(0.0)
    return counts.crossJoin(F.broadcast(total)).agg((0.5 * F.sum(part(p)) + 0.5 * F.sum(part(q))).alias("jsd"))  # one row of totals


def wasserstein(left: DataFrame, right: DataFrame, value: str, most: int) -> DataFrame:
    """STA-13: distance of two integer histograms over 1..most; larger values count as the last bin."""
    spark = left.sparkSession
    v = F.least(F.col(value), F.lit(most)).cast("long").alias("v")
    a = left.groupBy(v).agg(F.count("*").alias("a"))
    b = right.groupBy(v).agg(F.count("*").alias("b"))
    bins = spark.range(1, most + 1).select(F.col("id").alias("v")).join(a, "v", "left").join(b, "v", "left").fillna(0)
    every = Window.partitionBy()  # as many rows as bins
    x = F.col("a") / F.sum("a").over(every) - F.col("b") / F.sum("b").over(every)
    running = bins.select("v", x.alias("x")).select(F.sum("x").over(Window.orderBy("v")).alias("y"))
    return running.agg(F.round(F.sum(F.abs("y")), 3).alias("distance"))


def spearman(df: DataFrame, keys: Sequence[str], a: str, b: str, tie: str) -> DataFrame:
    """STA-18: rank correlation with ties broken by ``tie``."""
    w = Window.partitionBy(*keys)
    ranked = df.select(*keys, F.row_number().over(w.orderBy(a, tie)).alias("__a"), F.row_number().over(w.orderBy(b, tie)).alias("__b"))
    return ranked.groupBy(*keys).agg(F.corr("__a", "__b").alias("rho"))


def _mixed(x: np.ndarray) -> np.ndarray:
    """Well-spread 64-bit numbers from any."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def draws(ids: np.ndarray, n: int, seed: int) -> np.ndarray:
    """A 64-bit draw for each id (row) and each of ``n`` rounds (column)."""
    rounds = _mixed(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))
    return _mixed(ids.view(np.uint64)[:, None] ^ rounds[None, :])


def poisson_weights(ids: np.ndarray, n: int, seed: int) -> np.ndarray:
    """Poisson(1) weights from draws."""
    steps, term, total = [], 1.0, 0.0
    for k in range(8):  # the distribution function at 0, 1, 2, ...
        total += term * 0.36787944117144233
        steps.append(total)
        term /= k + 1
    return np.searchsorted(np.array(steps), (draws(ids, n, seed) >> np.uint64(11)) * 2.0**-53, side="right").astype(float)


def _round_sums(df: DataFrame, keys: Sequence[str], id: str, value: str, n: int, weigh) -> DataFrame:
    """``(keys, b, s, w)``: for each round the sums of weighted values and of weights.

    A task adds up whole rounds at a time, one array a key, and only the sums are shuffled.
    """
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.xxhash64(id).alias("__id"), F.col(value).cast("double").alias("__x"))
    schema = df.select(*keys).schema.add("__s", ArrayType(DoubleType())).add("__w", ArrayType(DoubleType()))
    names = schema.fieldNames()

    def run(pdfs):
        held: dict[tuple, np.ndarray] = {}

        def out():
            table = pd.DataFrame([(*k, s.tolist(), w.tolist()) for k, (s, w) in held.items()], columns=names)
            held.clear()
            return table

        for pdf in pdfs:
            for key, part in pdf.groupby(list(keys), dropna=False) if keys else [((), pdf)]:
                for at in range(0, len(part), 2048):
                    piece = part.iloc[at : at + 2048]
                    w = weigh(piece["__id"].to_numpy(np.int64), n)
                    sums = np.stack((piece["__x"].to_numpy(float) @ w, w.sum(axis=0)))
                    held[key] = held[key] + sums if key in held else sums
            if len(held) > 512:
                yield out()
        if held:
            yield out()

    parts = rows.mapInPandas(run, schema)
    cells = parts.select(*keys, F.posexplode(F.arrays_zip("__s", "__w")).alias("b", "x"))
    return cells.groupBy(*keys, "b").agg(F.sum("x.__s").alias("s"), F.sum("x.__w").alias("w"))


def bootstrap_mean(df: DataFrame, keys: Sequence[str], id: str, value: str, replicates: int = 1000, alpha: float = 0.05, seed: int = 7) -> DataFrame:
    """STA-19: percentile interval of resampled means.

    Every row has in every replicate a Poisson(1) weight from its id, so rows are never gathered.
    """
    means = _round_sums(df, keys, id, value, replicates, lambda ids, n: poisson_weights(ids, n, seed)).select(*keys, (F.col("s") / F.col("w")).alias("__m"))
    return means.groupBy(*keys).agg(F.avg("__m").alias("mean"), F.percentile("__m", alpha / 2).alias("low"), F.percentile("__m", 1 - alpha / 2).alias("high"))


def bca_mean(df: DataFrame, keys: Sequence[str], id: str, value: str, replicates: int = 1000, alpha: float = 0.05, seed: int = 7) -> DataFrame:
    """STA-20: bias-corrected and accelerated interval of the mean.

    The jackknife's acceleration of a mean is its skewness over ``6 sqrt(n)``, one
    aggregate; what is grouped in one place is a key's replicates.
    """
    means = _round_sums(df, keys, id, value, replicates, lambda ids, n: poisson_weights(ids, n, seed)).select(*keys, (F.col("s") / F.col("w")).alias("m"))
    seen = df.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.avg(value).cast("double").alias("mean"), (F.skewness(value) / (6 * F.sqrt(F.count("*")))).alias("a"))
    schema = df.select(*keys).schema.add("mean", "double").add("low", "double").add("high", "double")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        mean, a = pdf["mean"].iloc[0], pdf["a"].iloc[0]
        low, high = bca_interval(pdf["m"].to_numpy(float), mean, 0.0 if a is None or np.isnan(a) else a, alpha)
        return pd.DataFrame([(*(pdf[k].iloc[0] for k in keys), mean, low, high)], columns=schema.fieldNames())

    return means.join(seen, list(keys)).groupBy(*keys).applyInPandas(run, schema)


def bca_interval(means: np.ndarray, mean: float, a: float, alpha: float) -> tuple[float, float]:
    """The percentiles of the replicates at the corrected levels."""
    normal = NormalDist()
    share = min(max(float((means < mean).mean()), 1 / (len(means) + 1)), len(means) / (len(means) + 1))
    z0 = normal.inv_cdf(share)
    levels = [normal.cdf(z0 + (z0 + z) / (1 - a * (z0 + z))) for z in (normal.inv_cdf(alpha / 2), normal.inv_cdf(1 - alpha / 2))]
    return float(np.quantile(means, levels[0])), float(np.quantile(means, levels[1]))


def sign_flip_test(df: DataFrame, keys: Sequence[str], id: str, diff: str, rounds: int = 1000, seed: int = 11) -> DataFrame:
    """STA-21: two-sided paired permutation test, ``(hits + 1) / (rounds + 1)``."""
    flipped = _round_sums(df, keys, id, diff, rounds, lambda ids, n: 1.0 - 2.0 * (draws(ids, n, seed) & np.uint64(1)).astype(float))
    seen = df.groupBy(*keys).agg(F.abs(F.sum(F.col(diff).cast("double"))).alias("__seen"))
    hits = flipped.join(seen, list(keys))
    return hits.groupBy(*keys).agg(((F.count_if(F.abs("s") >= F.col("__seen") - 1e-9) + 1) / (rounds + 1)).alias("p"))


#: Runs of bytes that a task holds at a time.
_RUNS = 1 << 21


def _numbers(k: int, runs: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(runs), k, np.int32)), pa.array(runs.view(np.int64))], ["k", "g"])


def _ends(ends: set[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
    for k in sorted({k for k, _ in ends}):
        yield _numbers(k, np.array([x for j, x in ends if j == k], np.uint64))


def byte_grams(df: DataFrame, text: str, most: int = 8) -> DataFrame:
    """STA-07: ``(k, grams)``: how many different runs of ``k`` bytes come, for ``k`` up to eight.

    A run of eight bytes is one 64-bit number, so runs are told apart exactly. Only runs of
    ``most`` bytes leave a task, and the shorter ones that end a text: every other run begins a longer one, so runs of
    ``k`` bytes are the different beginnings of runs of ``k + 1``. A task holds about ``_RUNS`` runs
    at a time, however long its batches and texts are.
    """

    def run(batches):
        held = np.zeros(0, np.uint64)
        fresh: list[np.ndarray] = []
        ends: set[tuple[int, int]] = set()
        waiting = 0

        def merged() -> np.ndarray:
            return np.unique(np.concatenate([held, *fresh]))

        for batch in batches:
            for value in batch.column(0):
                raw = np.frombuffer(value.as_buffer(), np.uint8) if value.is_valid else np.zeros(0, np.uint8)
                for k in range(1, min(most - 1, len(raw)) + 1):
                    ends.add((k, int.from_bytes(raw[len(raw) - k :].tobytes(), "big")))
                for at in range(0, len(raw) - most + 1, _RUNS // 4):
                    piece = raw[at : at + _RUNS // 4 + most - 1].astype(np.uint64)
                    grams = np.zeros(len(piece) - most + 1, np.uint64)
                    for k in range(most):
                        grams = grams << np.uint64(8) | piece[k : k + len(grams)]
                    fresh.append(grams)
                    waiting += len(grams)
                    if waiting >= _RUNS // 2:
                        held, fresh, waiting = merged(), [], 0
                        if len(held) >= _RUNS:
                            yield _numbers(most, held)
                            held = np.zeros(0, np.uint64)
                if len(ends) >= _RUNS // 16:
                    yield from _ends(ends)
                    ends.clear()
        yield _numbers(most, merged())
        yield from _ends(ends)

    runs = stash(df.select(F.col(text).cast("binary").alias("t")).mapInArrow(run, "k int, g long").distinct(), "runs")
    longest = runs.where(F.col("k") == most).select("g")
    counts = []
    for k in range(most, 0, -1):
        if k < most:
            cut = longest.select(F.shiftrightunsigned("g", 8).alias("g"))
            longest = stash(cut.union(runs.where(F.col("k") == k).select("g")).distinct(), "runs")
        counts.append(longest.agg(F.lit(k).alias("k"), F.count("*").alias("grams")))
    return reduce(DataFrame.union, counts).where("grams > 0")


def auc(df: DataFrame, score: str, truth: str) -> DataFrame:
    """STA-23: by average ranks, from counts of equal scores."""
    counts = df.groupBy(F.col(score).alias("__s")).agg(F.count("*").alias("__n"), F.count_if(F.col(truth) == 1).alias("__p"))
    ranked = running(counts, [], [F.col("__s")], {"__before": ("sum", "__n")})
    ranked = ranked.withColumn("__r", F.coalesce("__before", F.lit(0)) + (F.col("__n") + 1) / 2)
    p, n = F.sum("__p"), F.sum(F.col("__n") - F.col("__p"))
    return ranked.agg(((F.sum(F.col("__r") * F.col("__p")) - p * (p + 1) / 2) / (p * n)).alias("auc"))


def average_precision(df: DataFrame, order: Sequence[Column], truth: str) -> DataFrame:
    """STA-24: precision summed over the hits of one ranking.

    The ranking is made with one range sort: rows get their place within a
    partition, and partitions their offset from a small table of counts.
    """
    sized = df.orderBy(*order).select(F.col(truth).alias("__t"), F.spark_partition_id().alias("__p"), F.monotonically_increasing_id().alias("__m"))
    offsets = sized.groupBy("__p").agg(F.count("*").alias("__n"), F.sum("__t").alias("__h"))
    w = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = offsets.select("__p", F.coalesce(F.sum("__n").over(w), F.lit(0)).alias("__i0"), F.coalesce(F.sum("__h").over(w), F.lit(0)).alias("__h0"))
    inside = Window.partitionBy("__p").orderBy("__m")
    placed = sized.withColumns({"__i": F.row_number().over(inside), "__hits": F.sum("__t").over(inside)}).join(F.broadcast(offsets), "__p")  # a row for each partition
    precision = (F.col("__hits") + F.col("__h0")) / (F.col("__i") + F.col("__i0"))
    return placed.agg((F.sum(precision * F.col("__t")) / F.sum("__t")).alias("ap"))


def f1(df: DataFrame, truth: str, guess: str) -> DataFrame:
    """STA-27: micro and macro F1 over the labels of either column."""
    cells = df.groupBy(F.col(truth).alias("t"), F.col(guess).alias("g")).agg(F.count("*").alias("n"))
    sides = cells.select(F.inline(F.array(F.struct(F.col("t").alias("label"), F.col("n"), (F.col("t") == F.col("g")).alias("hit"), F.lit(True).alias("is_truth")), F.struct(F.col("g").alias("label"), F.col("n"), (F.col("t") == F.col("g")).alias("hit"), F.lit(False).alias("is_truth")))))
    total = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    by = sides.groupBy("label").agg(total(F.col("hit") & F.col("is_truth")).alias("tp"), total(~F.col("hit") & F.col("is_truth")).alias("fn"), total(~F.col("hit") & ~F.col("is_truth")).alias("fp"))
    return by.agg((2 * F.sum("tp") / (2 * F.sum("tp") + F.sum("fp") + F.sum("fn"))).alias("micro"), F.avg(2 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn"))).alias("macro"))


def cluster_scores(df: DataFrame, cluster: str, truth: str) -> DataFrame:
    """STA-28/29: B-cubed precision and recall, their F1, and purity, from a table of counts."""
    n = df.groupBy(F.col(cluster).alias("c"), F.col(truth).alias("t")).agg(F.count("*").alias("n"))
    s = n.withColumns({"nc": F.sum("n").over(Window.partitionBy("c")), "nt": F.sum("n").over(Window.partitionBy("t")), "top": F.row_number().over(Window.partitionBy("c").orderBy(F.desc("n"), "t")) == 1})
    total = F.sum("n")
    out = s.agg((F.sum(F.col("n") * F.col("n") / F.col("nc")) / total).alias("precision"), (F.sum(F.col("n") * F.col("n") / F.col("nt")) / total).alias("recall"), (F.sum(F.when(F.col("top"), F.col("n")).otherwise(0)) / total).alias("purity"))
    return out.withColumn("f1", 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall")))
