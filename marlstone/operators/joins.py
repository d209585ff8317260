"""Joins beyond a plain equality."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_wins(df: DataFrame, key: str, order: str) -> DataFrame:
    """JOI-03: one row a key, the last in a given order."""
    rest = [c for c in df.columns if c != key]
    picked = df.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("__row"))
    return picked.select(key, *(F.col(f"__row.{c}").alias(c) for c in rest))


def unpivot_values(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """JOI-05, SCH-13: entity, attribute, value rows; every value as text."""
    texts = [F.col(c).cast("string").alias(c) for c in columns]
    return df.select(F.col(key).alias("entity"), *texts).unpivot("entity", list(columns), "attribute", "value")


def pivot_values(eav: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The inverse of :func:`unpivot_values`."""
    return eav.groupBy("entity").pivot("attribute", list(columns)).agg(F.first("value"))


def orphans(facts: DataFrame, fk: str, dims: DataFrame, pk: str) -> DataFrame:
    """SCH-23: facts whose key is not null and has no row in ``dims``."""
    keys = dims.select(F.col(pk).alias("__pk"))
    return facts.where(F.col(fk).isNotNull()).join(keys, F.col(fk) == F.col("__pk"), "left_anti")


def interval_join(points: DataFrame, at: str, ranges: DataFrame, start: str, end: str, width: float) -> DataFrame:
    """Points within half-open ranges, as an equality of buckets of ``width`` and a check.

    Every range is put in each bucket that it touches, so ``width`` is best near
    a range's usual length.
    """
    bucket = lambda c: F.floor(F.col(c) / width)
    spread = ranges.where(F.col(end) > F.col(start)).withColumn("__b", F.explode(F.sequence(bucket(start), bucket(end))))
    met = points.withColumn("__b", bucket(at)).join(spread, "__b")
    return met.where((F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))).drop("__b")


def as_of_join(left: DataFrame, right: DataFrame, by: str, left_at: str, right_at: str, value: str) -> DataFrame:
    """Each left row with the latest ``value`` of the right at or before it: one union, one window, no pairs."""
    rest = [c for c in left.columns if c not in (by, left_at)]
    a = left.select(F.col(by).alias("__by"), F.col(left_at).alias("__at"), F.lit(1).alias("__side"), F.struct(*rest).alias("__left"), F.lit(None).cast(right.schema[value].dataType).alias("__value"))
    b = right.select(F.col(by).alias("__by"), F.col(right_at).alias("__at"), F.lit(0).alias("__side"), F.lit(None).cast(a.schema["__left"].dataType).alias("__left"), F.col(value).alias("__value"))
    w = Window.partitionBy("__by").orderBy("__at", "__side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    known = a.unionByName(b).withColumn("__found", F.last("__value", ignorenulls=True).over(w)).where("__side = 1")
    return known.select(F.col("__by").alias(by), F.col("__at").alias(left_at), "__left.*", F.col("__found").alias(value))


def containment(items: DataFrame, group: str, item: str, covered: DataFrame) -> DataFrame:
    """JOI-11: groups all of whose items are covered; empty groups are not there."""
    known = covered.select(F.col(item).alias("__item")).distinct().withColumn("__hit", F.lit(True))
    met = items.join(known, F.col(item) == F.col("__item"), "left")
    return met.groupBy(group).agg(F.every(F.coalesce("__hit", F.lit(False))).alias("closed"), F.count("*").alias("n"))


def inclusion(values: DataFrame, keys: DataFrame, floor: float = 0.5) -> DataFrame:
    """JOI-16: of ``values(col, value)``, the key set of ``keys(target, value)`` that covers most of a column, from ``floor`` on.

    Ties go to the first target by name.
    """
    distinct = values.distinct()
    total = distinct.groupBy("col").agg(F.count("*").alias("n"))
    hits = distinct.join(keys.distinct(), "value").groupBy("col", "target").agg(F.count("*").alias("hits"))
    scored = hits.join(total, "col").withColumn("share", F.col("hits") / F.col("n")).where(F.col("share") >= floor)
    ranked = scored.withColumn("__r", F.row_number().over(Window.partitionBy("col").orderBy(F.desc("share"), "target")))
    return ranked.where("__r = 1").select("col", "target", "share")


def pairs(df: DataFrame, group: str, item: str) -> DataFrame:
    """JOI-20: pairs a < b of a group's items; for groups that are small by their nature."""
    a, b = df.select(group, F.col(item).alias("a")), df.select(group, F.col(item).alias("b"))
    return a.join(b, group).where("a < b")


def coalesce_joins(df: DataFrame, keys: Sequence[Column], dims: Sequence[DataFrame], found: str) -> DataFrame:
    """JOI-13: the first dimension that knows its key wins; each dimension is ``(key, value)`` with unique keys."""
    names = []
    for i, (key, dim) in enumerate(zip(keys, dims, strict=True)):
        names.append(f"__v{i}")
        df = df.join(dim.select(F.col("key").alias(f"__k{i}"), F.col("value").alias(f"__v{i}")), key == F.col(f"__k{i}"), "left").drop(f"__k{i}")
    return df.withColumn(found, F.coalesce(*names)).drop(*names)
