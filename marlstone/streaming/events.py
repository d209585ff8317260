"""Event-time windows, sessions, rosters and idempotent ingest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from marlstone.storage import scratch


def tumbling(events: DataFrame, at: str, width: str, keys: list[str], late: str = "10 minutes") -> DataFrame:
    """Counts and sums a window; on a stream, windows close ``late`` after their end."""
    timed = events.withColumn(at, F.col(at).cast("timestamp"))
    timed = timed.withWatermark(at, late) if events.isStreaming else timed
    return timed.groupBy(F.window(at, width).alias("w"), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), *keys, "n", "total")


def sessions(events: DataFrame, at: str, gap: str, keys: list[str], late: str = "10 minutes") -> DataFrame:
    """Session windows by key."""
    timed = events.withColumn(at, F.col(at).cast("timestamp"))
    timed = timed.withWatermark(at, late) if events.isStreaming else timed
    return timed.groupBy(F.session_window(at, gap).alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n")


def ready_windows(tokens: F.Column, size: int, stride: int, flush: F.Column) -> F.Column:
    """STM-03: how many token windows are stable: one more stride must have come, or the end."""
    whole = F.greatest(F.lit(0), F.floor((tokens - size) / stride) + 1)
    waiting = F.greatest(F.lit(0), F.floor((tokens - size - stride) / stride) + 1)
    return F.when(flush, F.greatest(F.lit(1), whole)).otherwise(waiting)


def clamp_ttl(seconds: F.Column, default: int = 60, least: int = 5, most: int = 3600) -> F.Column:
    """STM-08."""
    return F.when(seconds <= 0, default).otherwise(F.greatest(F.lit(least), F.least(F.lit(most), seconds)))


def roster(announced: DataFrame, key: str, at: str, ttl: str, now: F.Column) -> DataFrame:
    """STM-07: the latest row of each key that has not expired."""
    rest = [c for c in announced.columns if c != key]
    last = announced.groupBy(key).agg(F.max_by(F.struct(*rest), at).alias("r")).select(key, *(F.col(f"r.{c}").alias(c) for c in rest))
    return last.where(F.col(at).cast("timestamp") + F.make_interval(secs=F.col(ttl)) > now)


def replace_frames(frames: DataFrame, session: str, seq: str, arrival: str, text: str) -> DataFrame:
    """SET-16, STM-02: the text of each session when a repeated ``seq`` drops what came after it.

    A frame survives if no later arrival has its number or a smaller one. That
    is one window of the later arrivals' least number.
    """
    from pyspark.sql import Window

    after = Window.partitionBy(session).orderBy(arrival).rowsBetween(1, Window.unboundedFollowing)
    kept = frames.withColumn("__later", F.min(seq).over(after)).where(F.col("__later").isNull() | (F.col("__later") > F.col(seq)))
    ordered = F.sort_array(F.collect_list(F.struct(seq, text)))
    return kept.groupBy(session).agg(F.array_join(F.transform(ordered, lambda x: x[text]), "").alias("text"))


def trails(clicks: DataFrame, user: str, order: str, panel: str, most: int = 5) -> DataFrame:
    """STM-09: ``(user, trail)``: a click on a panel of the trail cuts it there, any other extends it, and the last ``most`` stay.

    A click depends on all before it, so a user's clicks are one sorted run of
    one task; they stream through it in batches, and no more than one trail is
    held, however many clicks a user has. Clicks without a panel are left out.
    """
    from pyspark.sql.types import ArrayType, StructField, StructType

    schema = StructType([StructField(user, clicks.schema[user].dataType), StructField("trail", ArrayType(clicks.schema[panel].dataType))])

    def walk(batches):
        import pyarrow as pa

        to = None
        now, trail, met = None, [], False
        for batch in batches:
            to = to or pa.schema([(user, batch.schema.field(0).type), ("trail", pa.list_(batch.schema.field(1).type))])
            users, out = [], []
            for u, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if met and u != now:
                    users.append(now)
                    out.append(trail)
                    trail = []
                now, met = u, True
                trail = trail[: trail.index(x) + 1] if x in trail else [*trail, x][-most:]
            yield pa.RecordBatch.from_arrays([pa.array(users, to.field(0).type), pa.array(out, to.field(1).type)], schema=to)
        if met:
            yield pa.RecordBatch.from_arrays([pa.array([now], to.field(0).type), pa.array([trail], to.field(1).type)], schema=to)

    runs = clicks.where(F.col(panel).isNotNull()).repartition(user).sortWithinPartitions(user, order)
    return runs.select(user, panel).mapInArrow(walk, schema)


def ingest(spark: SparkSession, source: str, schema: StructType, target: str, key: str) -> int:
    """STM-12/14: append new files' rows once; the checkpoint is the cursor, broken rows go to a side folder.

    Returns the number of rows of this run; running it again over the same folder gives 0.
    """
    done: list[int] = []

    def put(batch: DataFrame, epoch: int) -> None:
        good = batch.where(F.col(key).isNotNull()).dropDuplicates([key])
        good.write.mode("overwrite").parquet(f"{target}/rows/epoch={epoch}")  # a batch that runs again replaces itself
        batch.where(F.col(key).isNull()).write.mode("overwrite").parquet(f"{target}/broken/epoch={epoch}")
        done.append(spark.read.parquet(f"{target}/rows/epoch={epoch}").count())

    stream = spark.readStream.schema(schema).option("mode", "PERMISSIVE").json(source)
    query = stream.writeStream.foreachBatch(put).option("checkpointLocation", f"{target}/cursor").trigger(availableNow=True).start()
    query.awaitTermination()
    return sum(done)


def run_stream(spark: SparkSession, df: DataFrame, transform) -> DataFrame:
    """A transformation over a file stream of ``df``'s rows, run to its end; returns what the sink got."""
    source, out = scratch(spark, "stream-in"), scratch(spark, "stream-out")
    df.write.parquet(source)
    stream = spark.readStream.schema(df.schema).parquet(source)
    query = transform(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", scratch(spark, "stream-cursor")).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(transform(df).schema).parquet(out)


def with_state_store(spark: SparkSession, idle_batches: bool = True) -> SparkSession:
    """A session beside the caller's, with the state store that state of one's own needs; the caller's settings stay as they are.

    State that expires by the clock asks for a batch without data after every batch, so a query that is to
    end when its input is read needs ``idle_batches`` off; event-time timers need it on.
    """
    own = spark.newSession()
    for name in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        own.conf.set(name, spark.conf.get(name))
    own.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    own.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", str(idle_batches).lower())
    return own


def run_in_parts(spark: SparkSession, parts: list[DataFrame], transform) -> DataFrame:
    """A transformation over a file stream to which ``parts`` are added one after the other.

    The query is started anew for each part and goes on from its checkpoint; returns what the sink got.
    """
    source, out, cursor = scratch(spark, "stream-in"), scratch(spark, "stream-out"), scratch(spark, "stream-cursor")
    schema = parts[0].schema
    for part in parts:
        part.write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        query = transform(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", cursor).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
    return spark.read.schema(transform(spark.readStream.schema(schema).parquet(source)).schema).parquet(out)
