"""Schemas: inferred types, keys, dimensions, column classes, DDL."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: The shapes of typed values, and what stands for nothing.
INTEGER, DECIMAL = r"^[+-]?\d+$", r"^[+-]?\d+(\.\d+)?$"
BOOLEAN, TIMESTAMP, DATE = r"(?i)^(true|false|yes|no)$", r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2})?", r"^\d{4}-\d{2}-\d{2}$"
PLACEHOLDER = r"(?i)^(tbd|n/a|na|none|null|todo|xxx+|-+|\{.*\})$"


def infer_types(cells: DataFrame, column: str, value: str) -> DataFrame:
    """SCH-01/02/34: one row a column: the SQL type that all its values have, its kind and width.

    One aggregate over long cells; blanks do not count.
    """
    v = F.trim(F.col(value))
    seen = F.when(v != "", v)
    every = lambda p: F.coalesce(F.every(seen.rlike(p)), F.lit(False))
    typed = F.avg(F.coalesce(seen.rlike(f"{DECIMAL}|{DATE}|{BOOLEAN}"), F.lit(False)).cast("int"))
    sql_type = F.when(every(INTEGER), "integer").when(every(DECIMAL), "decimal").when(every(BOOLEAN), "boolean").when(every(DATE), "date").when(every(TIMESTAMP), "timestamp").otherwise("text")
    kind = F.when(F.count(seen) == 0, "Empty").when(typed >= 0.6, "Data").otherwise("Class")
    return cells.groupBy(column).agg(sql_type.alias("sql_type"), kind.alias("kind"), F.coalesce(F.max(F.length(seen)), F.lit(0)).alias("width"))


def sized_types(cells: DataFrame, column: str, value: str) -> DataFrame:
    """SCH-34: one row a column: boolean, integer, decimal (with a point), date, timestamp, or VARCHAR with room to spare."""
    v = F.trim(F.col(value))
    seen = F.when(v != "", v)
    every = lambda p: F.coalesce(F.every(seen.rlike(p)), F.lit(False))
    width = F.least(F.lit(512), F.greatest(F.lit(32), F.max(F.length(seen)) + 8)).cast("string")
    typed = F.when(every(BOOLEAN), "BOOLEAN").when(every(INTEGER), "INTEGER").when(every(r"^[+-]?\d+\.\d+$"), "DECIMAL").when(every(DATE), "DATE").when(every(TIMESTAMP), "TIMESTAMP")
    return cells.groupBy(column).agg(F.when(F.count(seen) == 0, "VARCHAR(255)").otherwise(F.coalesce(typed, F.concat(F.lit("VARCHAR("), width, F.lit(")")))).alias("sql_type"))


def column_class(cells: DataFrame, column: str, value: str) -> DataFrame:
    """SCH-32: empty, constant, placeholder or informative."""
    v = F.trim(F.coalesce(F.col(value), F.lit("")))
    seen = F.when(v != "", v)
    out = F.when(F.count(seen) == 0, "empty").when(F.every(seen.rlike(PLACEHOLDER)), "placeholder").when(F.min(seen) == F.max(seen), "constant").otherwise("informative")
    return cells.groupBy(column).agg(out.alias("class"))


def key_shape(name: Column, table: Column) -> Column:
    """SCH-30: bare_id, table_id, other_id or natural."""
    n = F.lower(name)
    return F.when(n == "id", "bare_id").when(n == F.concat(F.lower(table), F.lit("_id")), "table_id").when(n.rlike("_id$"), "other_id").otherwise("natural")


def dimension(df: DataFrame, columns: Sequence[str], key: str) -> DataFrame:
    """SCH-15/16: the distinct values of a few columns with a dense surrogate key in their order.

    The values of a dimension are few by nature; the numbering is one window over them.
    """
    return df.select(*columns).distinct().withColumn(key, (F.row_number().over(Window.orderBy(*columns)) - 1).cast("long"))


def create_table(name: str, schema: StructType) -> str:
    """SCH-09."""
    return f"CREATE TABLE {name} (" + ", ".join(f"{f.name} {f.dataType.simpleString().upper()}" + ("" if f.nullable else " NOT NULL") for f in schema) + ")"
