"""An append log as a table of the session's catalog.

The table is created once, with its partitions and the order of rows in its files; later calls find it. Many
records are one commit. A record has an id, and an append leaves out the ids that
are there, so an append that runs again doubles nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Layout:
    """How the table lies on disk: its columns as DDL, what it is partitioned by, and the order of rows in a file."""

    columns: str
    partitions: tuple[str, ...]
    order: tuple[str, ...]
    id: str


class Exchange:
    """The log ``name``; ``path`` None leaves the place to the catalog's warehouse."""

    def __init__(self, spark: SparkSession, name: str, layout: Layout, path: str | None = None):
        self.spark, self.name, self.layout, self.path = spark, name, layout, path

    def create_or_load(self) -> DataFrame:
        """The table; created empty if the catalog has none of this name."""
        if not self.spark.catalog.tableExists(self.name):
            empty = self.spark.createDataFrame([], self.layout.columns)
            writer = empty.writeTo(self.name).using("parquet").partitionedBy(*(F.col(c) for c in self.layout.partitions))
            if self.path is not None:
                writer = writer.option("path", self.path)
            writer.create()
        return self.spark.table(self.name)

    def append(self, records: DataFrame) -> None:
        """Add the records whose ids the table lacks, in one commit; of one id in the batch the least row counts.

        Only the partitions that the batch touches are searched for its ids: a record keeps its id and
        partition together. Records with a null id are an error. Rows are dealt by partition values and a hash of the id,
        so that a partition with most of the rows is written by many tasks.
        """
        table, how = self.create_or_load(), self.layout
        names = table.columns
        rest = [c for c in names if c != how.id]
        checked = F.when(F.col(how.id).isNull(), F.raise_error(F.lit("a record has no id"))).otherwise(F.col(how.id))
        batch = records.select(checked.alias(how.id), *rest).groupBy(how.id).agg(F.min(F.struct(*rest)).alias("r")).select(how.id, "r.*")
        there = table.select(how.id, *how.partitions)
        new = batch.join(there, [how.id, *how.partitions], "left_anti").select(*names)
        spread = F.pmod(F.xxhash64(how.id), F.lit(16))
        new.repartition(*how.partitions, spread).sortWithinPartitions(*how.partitions, *how.order).write.insertInto(self.name)
        self.spark.catalog.refreshTable(self.name)

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def drop(self) -> None:
        """Forget the table; its files stay where a path was named."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
