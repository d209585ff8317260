"""Sources and sinks in the formats of table-and-text corpora."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.functions import hashing as H

#: Fixed value: the letter between documents of a delimited corpus.
END_OF_TEXT = "\x03"


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """SRC-07: with a header; bad rows become nulls."""
    return spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE").csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    """SNK-09."""
    df.write.option("header", True).csv(path)


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """SRC-08: one object a line, gzip by suffix; broken lines are dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def write_json_lines(df: DataFrame, path: str) -> None:
    """SNK-06."""
    df.write.option("compression", "gzip").json(path)


def write_delimited(df: DataFrame, text: str, path: str) -> None:
    """Documents with an end-of-text letter between them; the letter itself is taken out of the texts."""
    df.select(F.translate(text, END_OF_TEXT, "").alias("value")).write.option("lineSep", END_OF_TEXT).text(path)


def read_delimited(spark: SparkSession, path: str, least: int = 200) -> DataFrame:
    """SRC-11: documents of at least ``least`` characters."""
    return spark.read.option("lineSep", END_OF_TEXT).text(path).where(F.length("value") >= least).withColumnRenamed("value", "text")


def cursor_window(df: DataFrame, order: str, skip: int, take: int) -> DataFrame:
    """SRC-12: ``take`` rows after the first ``skip`` in a total order."""
    return df.orderBy(order).offset(skip).limit(take)


def postings(df: DataFrame, name: str, columns: Sequence[str], most: int = 2048) -> DataFrame:
    """SRC-30: a C row for each column and V rows for its values of 2 to 64 characters; columns with more than ``most`` values have none."""
    cells = df.select(F.inline(F.array(*(F.struct(F.lit(c).alias("col"), F.col(c).cast("string").alias("token")) for c in columns)))).where(F.length("token").between(2, 64) & ~F.col("token").rlike("[\t\n]"))
    values = cells.groupBy("col", "token").agg(F.count("*").alias("n"))
    few = values.groupBy("col").agg(F.count("*").alias("k")).where(F.col("k") <= most).select("col")
    kept = values.join(few, "col", "left_semi").select(F.lit("V").alias("kind"), "token", F.concat(F.lit(f"{name}:"), "col").alias("lineage"), "n")
    heads = df.sparkSession.createDataFrame([("C", c, name, 1) for c in columns], "kind string, token string, lineage string, n long")
    return kept.unionByName(heads)


def write_parquet(df: DataFrame, path: str, rows_per_file: int = 32_000) -> None:
    """SNK-02: files of bounded length, zstd."""
    df.write.option("maxRecordsPerFile", rows_per_file).option("compression", "zstd").parquet(path)


def exact_split(df: DataFrame, id: str, share: float, name: str, seed: str = "val") -> DataFrame:
    """SNK-03: exactly ``max(1, floor(n share))`` rows by the least draws.

    The cut is found by one ordered limit, not by numbering all rows.
    """
    k = max(1, int(df.count() * share))
    drawn = df.withColumn("__u", H.draw(F.col(id), seed))
    edge = drawn.select("__u", F.col(id).alias("__id")).orderBy("__u", "__id").offset(k - 1).limit(1)
    inside = (F.col("d.__u") < F.col("e.__u")) | ((F.col("d.__u") == F.col("e.__u")) & (F.col(f"d.{id}") <= F.col("e.__id")))
    met = drawn.alias("d").crossJoin(F.broadcast(edge.alias("e")))  # one edge row
    return met.select(*(F.col(f"d.{c}") for c in df.columns), inside.alias(name))


def newest(df: DataFrame, key: str, version: str) -> DataFrame:
    """SRC-22: later files win."""
    w = Window.partitionBy(key).orderBy(F.desc(version))
    return df.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")
