"""Embeddings of table columns behind a table keyed by content.

A column's key is a hash of the cells that would be encoded, so equal content is
encoded once, whatever it is called and wherever it lies. The cache is a
Parquet table of keys and half-precision vectors; what it lacks is found by
an anti-join, encoded in batches inside the tasks, and appended by one job. A second
run over the same columns encodes nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from marlstone.operators.windows import first_rows
from marlstone.storage import stash

#: An encoder: texts in, one row of a float matrix for each out.
Encoder = Callable[[list[str]], np.ndarray]


def first_cells(cells: DataFrame, keys: list[str], order: list[str], cell: str, most: int = 50) -> DataFrame:
    """``(*keys, cells)``: the first ``most`` cells of each column by ``order``, as an array; null cells are left out.

    Parts of a column are cut to their first cells before they meet, so a
    column with most of the rows costs no task more than its share.
    """
    rows = cells.where(F.col(cell).isNotNull()).select(*keys, *order, F.col(cell).cast("string").alias("__cell"))
    rows = first_rows(rows, keys, [*order, "__cell"], most, "__n")
    listed = F.array_sort(F.collect_list(F.struct("__n", "__cell")))
    return rows.groupBy(*keys).agg(F.transform(listed, lambda x: x["__cell"]).alias("cells"))


def content_key(cells: Column) -> Column:
    """16 bytes of SHA-256 over the cells with NUL between them."""
    return F.unhex(F.substring(F.sha2(F.array_join(cells, "\0").cast("binary"), 256), 1, 32))


class EmbeddingCache:
    """A table ``(key binary, vec binary)`` in ``path``, a folder that all executors share; ``vec`` is little-endian half precision."""

    def __init__(self, spark: SparkSession, path: str, dims: int):
        self.spark, self.path, self.dims = spark, path, dims

    def table(self) -> DataFrame:
        """What is cached; of a key that was put twice (by runs at one time) one row."""
        spark = self.spark
        folder = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        schema = "key binary, vec binary"
        if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
            return spark.createDataFrame([], schema)
        rows = spark.read.schema(schema).parquet(self.path).where(F.octet_length("vec") == 2 * self.dims)
        return rows.groupBy("key").agg(F.min("vec").alias("vec"))

    def put_missing(self, columns: DataFrame, encode: Encoder, at_once: int = 256) -> int:
        """Encode the columns ``(cells)`` whose content is not cached, each content once; returns how many that were.

        The rows are written by one append: a task that runs again replaces its own file.
        """
        wanted = columns.select(content_key(F.col("cells")).alias("key"), F.array_join("cells", " ").alias("text"))
        missing = wanted.join(self.table().select("key"), "key", "left_anti").groupBy("key").agg(F.min("text").alias("text"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for at in range(0, whole.num_rows, at_once):
                    batch = whole.slice(at, at_once)
                    halves = np.asarray(encode(batch.column("text").to_pylist()), np.float32).astype("<f2")
                    yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array([v.tobytes() for v in halves], pa.binary())], ["key", "vec"])

        before = self.table().count()
        missing.mapInArrow(run, "key binary, vec binary").write.mode("append").parquet(self.path)
        return self.table().count() - before

    def embed(self, columns: DataFrame, encode: Encoder, keys: list[str]) -> DataFrame:
        """``(*keys, key, hit, vector)`` for ``columns(*keys, cells)``: ``hit`` says whether the content was cached before.

        Columns without cells are encoded as empty text. No columns give no rows. The result is written: Spark takes two reads of one
        folder in a plan for the same, also where the folder grew between them.
        """
        known = self.table().select("key", F.lit(True).alias("__hit"))
        keyed = columns.select(*keys, "cells", content_key(F.col("cells")).alias("key"))
        keyed = stash(keyed.join(known, "key", "left").select(*keys, "cells", "key", F.coalesce("__hit", F.lit(False)).alias("hit")), "columns")
        self.put_missing(keyed, encode)
        return stash(keyed.join(self.table(), "key").select(*keys, "key", "hit", floats(F.col("vec"), self.dims).alias("vector")), "vectors")


def floats(vec: Column, dims: int) -> Column:
    """Half-precision bytes as an array of floats, by a vectorised function over Arrow batches."""

    @F.pandas_udf(ArrayType(FloatType()))
    def decode(values: pd.Series) -> pd.Series:
        matrix = np.frombuffer(b"".join(values), "<f2").reshape(len(values), dims).astype(np.float32)
        return pd.Series(list(matrix))

    return decode(vec)
