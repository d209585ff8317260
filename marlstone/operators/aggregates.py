"""Aggregates that Spark has under no name of its own."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.operators.windows import running


def shares(df: DataFrame, key: str | Column, digits: int = 4) -> DataFrame:
    """AGG-03: counts by key and their share of all rows."""
    column = F.col(key) if isinstance(key, str) else key
    counted = df.groupBy(column.alias("key")).agg(F.count("*").alias("n"))
    return counted.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), digits))


def index_quantile(values: Column, q: float) -> Column:
    """STA-15: the sorted value at place ``min(n - 1, floor(q n))`` of an array."""
    n = F.size(values)
    return F.when(n > 0, F.get(F.array_sort(values), F.least(n - 1, F.floor(n * q).cast("int"))))


def rounded_quantile(values: Column, percent: float) -> Column:
    """STA-16: the sorted value at place ``round(p / 100 (n - 1))``, halves to even."""
    n = F.size(values)
    return F.when(n > 0, F.get(F.array_sort(values), F.bround((n - 1) * (percent / 100), 0).cast("int")))


def ranked_quantiles(df: DataFrame, keys: Sequence[str], value: str, quantiles: dict[str, float], rounded: dict[str, float] | None = None) -> DataFrame:
    """STA-15 (and STA-16 for ``rounded``) for groups of any size: from counts of equal values, without gathering or sorting a group in one task.

    A value's places are those behind the counts of smaller ones, summed by ranges; a group may hold any share of the rows and values.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("__k"))
    placed = running(counts, list(keys), [F.col(value)], {"__before": ("sum", "__k")}).withColumn("__before", F.coalesce("__before", F.lit(0)))
    whole = placed.groupBy(*(F.col(k).alias(f"__g{i}") for i, k in enumerate(keys))).agg(F.sum("__k").alias("__n"))
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__g{i}"))
    ranked = placed.join(whole, same) if keys else placed.crossJoin(F.broadcast(whole))  # without keys one row
    places = {name: F.least(F.col("__n"), F.floor(F.col("__n") * q) + 1) for name, q in quantiles.items()}
    places |= {name: F.bround((F.col("__n") - 1) * F.lit(q), 0).cast("long") + 1 for name, q in (rounded or {}).items()}
    return ranked.groupBy(*keys).agg(*(F.max(F.when((F.col("__before") < at) & (at <= F.col("__before") + F.col("__k")), F.col(value))).alias(name) for name, at in places.items()))


def entropy(df: DataFrame, keys: Sequence[str], item: str, name: str = "entropy") -> DataFrame:
    """STA-01: bits of the distribution of ``item`` within ``keys``; nulls do not count."""
    counts = df.where(F.col(item).isNotNull()).groupBy(*keys, item).agg(F.count("*").alias("__n"))
    total, weighted = F.sum("__n"), F.sum(F.col("__n") * F.log2("__n"))
    return counts.groupBy(*keys).agg(F.greatest(F.log2(total) - weighted / total, F.lit(0.0)).alias(name))


def first_cell(value: str, order: str) -> Column:
    """AGG-02: the value of the first matching row in a given order."""
    return F.min_by(value, order)


def best(value: Column, score: Column, tie: Column) -> Column:
    """AGG-29: the value of the highest score, null last, the lowest tie breaker first."""
    return F.max_by(value, F.struct(F.coalesce(score, F.lit(-1.0)), -tie))


def gini(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """STA-12: 0 where all values are zero."""
    w = Window.partitionBy(*keys)
    ranked = df.select(*keys, F.col(value).alias("__x"), F.row_number().over(w.orderBy(value)).alias("__i"))
    n, total = F.count("*"), F.sum("__x")
    return ranked.groupBy(*keys).agg(F.when(total > 0, 2 * F.sum(F.col("__i") * F.col("__x")) / (n * total) - (n + 1) / n).otherwise(0.0).alias("gini"))


def geometric_mean(values: Sequence[Column]) -> Column:
    """STA-09: of the values that are there; 0 if any is not positive."""
    there = F.array_compact(F.array(*values))
    logs = F.aggregate(there, F.lit(0.0), lambda a, x: a + F.ln(x))
    return F.when(F.exists(there, lambda x: x <= 0), 0.0).otherwise(F.exp(logs / F.size(there)))
