"""Windows, spans and pieces of texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.storage import stash


def byte_ids(text: Column) -> Column:
    """TOK-01: UTF-8 bytes plus 16; the first sixteen numbers are special."""
    digits = F.hex(text.cast("binary"))
    n = F.length(digits) / 2
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), (n - 1).cast("int")), lambda i: F.conv(F.substr(digits, i * 2 + 1, F.lit(2)), 16, 10).cast("int") + 16)).otherwise(F.expr("cast(array() as array<int>)"))


def token_windows(n: Column, size: int, stride: int) -> Column:
    """DOC-01: ``(start, end)`` of token windows; the last ends with the last token."""
    last = F.greatest(F.lit(0), F.ceil((n - size) / stride)).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.struct((i * stride).alias("start"), F.least(i * stride + size, n).alias("end")))


def overlapping(df: DataFrame, id: str, text: str, size: int) -> DataFrame:
    """TOK-05: ``(id, ix, piece)`` windows of ``size + 1`` characters that share one with the next."""
    starts = F.sequence(F.lit(0), F.floor((F.length(text) - 1) / size).cast("int"))
    return df.select(id, text, F.explode(starts).alias("ix")).select(id, "ix", F.substr(text, F.col("ix") * size + 1, F.lit(size + 1)).alias("piece"))


def byte_chunks(df: DataFrame, id: str, text: str, size: int, least: int) -> DataFrame:
    """SNK-04: fixed chunks of UTF-8 bytes; a tail under ``least`` goes unless it is the first chunk."""
    body = F.col(text).cast("binary")
    last = F.greatest(F.lit(0), F.ceil(F.octet_length(body) / size) - 1).cast("int")
    cut = df.select(id, body.alias("__b"), F.explode(F.sequence(F.lit(0), last)).alias("chunk"))
    pieces = cut.select(id, "chunk", F.substring(F.col("__b"), F.col("chunk") * size + 1, F.lit(size)).alias("piece"))
    return pieces.where((F.col("chunk") == 0) | (F.octet_length("piece") >= least))


def greedy_spans(df: DataFrame, group: str, start: str, end: str, score: str) -> DataFrame:
    """SRT-10, DOC-04: of a group's spans, the best that overlap none kept before, by score, start, end.

    Spans that no overlap connects do not touch each other's fate, so a group is first split at its gaps. Each
    part streams through a task in the order of its scores; the kept spans are disjoint and stay sorted, so a span is
    tested by one search among them. Spans with a null end are left out.
    """
    from bisect import bisect_left, insort

    import pyarrow as pa

    spans = df.select(F.col(group).alias("g"), F.col(start).alias("a"), F.col(end).alias("b"), F.col(score).alias("s")).where("a IS NOT NULL AND b IS NOT NULL")
    reach = running(spans, ["g"], [F.col("a"), F.col("b"), F.col("s")], {"reach": ("max", "b")})
    gap = reach["reach"].isNull() | (reach["a"] >= reach["reach"])
    parts = running(reach.withColumn("at", F.when(gap, F.col("a"))), ["g"], [F.col("a"), F.col("b"), F.col("s")], {"island": ("max", "at")})
    parts = parts.select("g", F.coalesce("at", "island").alias("island"), "s", "a", "b")
    schema = parts.select("g", "a", "b", "s").schema

    def keep(batches):
        now, starts, ends = None, [], []
        for batch in batches:
            flags = []
            for g, island, a, b in zip(*(batch.column(c).to_pylist() for c in ("g", "island", "a", "b")), strict=True):
                if (g, island) != now:
                    now, starts, ends = (g, island), [], []
                i = bisect_left(starts, b)
                free = not (i and ends[i - 1] > a)
                if free:
                    insort(starts, a)
                    insort(ends, b)
                flags.append(free)
            kept = batch.filter(pa.array(flags, pa.bool_()))
            yield pa.RecordBatch.from_arrays([kept.column(c) for c in ("g", "a", "b", "s")], ["g", "a", "b", "s"])

    found = parts.repartition("g", "island").sortWithinPartitions("g", "island", F.desc("s"), "a", "b").mapInArrow(keep, schema)
    return found.select(F.col("g").alias(group), F.col("a").alias(start), F.col("b").alias(end), F.col("s").alias(score))


def running(df: DataFrame, by: list[str], order: list[Column], values: dict[str, tuple[str, str]]) -> DataFrame:
    """``df`` with sums or maxima over the rows before each, in its group ``by`` and the total order ``order``.

    ``values`` maps a new name to ("sum" or "max", column); the first row of a group has null. Rows are dealt by ranges of
    group and order, so a group with most of the rows is many parts: each part is summed by itself and
    then raised by what the parts before it hold, a row for each group and part.
    """
    placed = stash(df.orderBy(*by, *order).withColumns({"__run_part": F.spark_partition_id(), "__run_place": F.monotonically_increasing_id()}), "running")
    fold = {c: {"sum": F.sum, "max": F.max}[kind] for c, (kind, _) in values.items()}
    whole = placed.groupBy(*by, "__run_part").agg(*(fold[c](v).alias(f"__w_{c}") for c, (_, v) in values.items()))
    earlier = Window.partitionBy(*by).orderBy("__run_part").rowsBetween(Window.unboundedPreceding, -1)
    before = whole.select(*(F.col(b).alias(f"__b_{i}") for i, b in enumerate(by)), F.col("__run_part").alias("__run_other"), *(fold[c](f"__w_{c}").over(earlier).alias(f"__e_{c}") for c in values))
    inside = Window.partitionBy(*by, "__run_part").orderBy("__run_place").rowsBetween(Window.unboundedPreceding, -1)
    local = placed.withColumns({f"__i_{c}": fold[c](v).over(inside) for c, (_, v) in values.items()})
    same = F.col("__run_part") == F.col("__run_other")
    for i, b in enumerate(by):
        same = same & F.col(b).eqNullSafe(F.col(f"__b_{i}"))
    met = local.join(before, same)

    def both(c: str) -> Column:
        x, y = F.col(f"__e_{c}"), F.col(f"__i_{c}")
        return F.greatest(x, y) if fold[c] is F.max else F.when(x.isNotNull() | y.isNotNull(), F.coalesce(x, F.lit(0)) + F.coalesce(y, F.lit(0)))

    return met.select(*df.columns, *(both(c).alias(c) for c in values))


def first_rows(df: DataFrame, by: list[str], order: list[str], most: int, name: str = "r") -> DataFrame:
    """The first ``most`` rows of each group by ``order``, with their number from 1; 64 parts of a group are cut before they meet."""
    rows = df.withColumn("__part", F.pmod(F.xxhash64(*order), F.lit(64)))
    for own in ([*by, "__part"], by):
        rows = rows.withColumn(name, F.row_number().over(Window.partitionBy(*own).orderBy(*order))).where(F.col(name) <= most)
    return rows.drop("__part")


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` with the 0-based place of each row in a total order: one range sort, and a small table of partition sizes."""
    placed = stash(df.orderBy(*order).withColumn("__m", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("__m", 33)
    sizes = placed.groupBy(part.alias("__p")).agg(F.count("*").alias("__n"))
    before = sizes.select("__p", (F.sum("__n").over(Window.orderBy("__p")) - F.col("__n")).alias("__b"))  # a row for each partition
    return placed.withColumn("__p", part).join(F.broadcast(before), "__p").select(*df.columns, (F.col("__b") + F.col("__m").bitwiseAND(F.lit((1 << 33) - 1))).alias(name))
