"""A roster of announced keys that expire, and a view that is refreshed at most so often."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import StructType

from marlstone.storage import stash
from marlstone.streaming.events import clamp_ttl

CHANGES = "key string, target string, at_ms long, number long, expires_ms long, live boolean"
_NAMES = ["key", "target", "at_ms", "number", "expires_ms", "live"]


class Roster(StatefulProcessor):
    """STM-07: the latest announcement of each key, until its time is over.

    An announcement that changes the target or moves the end is passed on as live; at the end of the
    latest one the key is passed on as not live and forgotten. With ``event_time`` time is
    the watermark and an announcement counts from its own time, else both are the clock's.

    A block of keys is one entry of the state with one timer, at its earliest end: each call into the state store
    costs far more than a row does, so a batch makes a few calls a block and none a key.
    """

    def __init__(self, event_time: bool):
        self.event_time = event_time

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "key array<string>, target array<string>, at_ms array<long>, number array<long>, expires_ms array<long>")

    def _known(self) -> dict[str, tuple]:
        columns = self.last.get()
        return {} if columns is None else {key: tuple(rest) for key, *rest in zip(*columns, strict=True)}

    def _keep(self, known: dict[str, tuple], timer: int | None) -> None:
        """Write the block's keys and move its timer, which stands at ``timer`` now, to their earliest end."""
        due = min((end for *_, end in known.values()), default=None)
        due = None if due is None else due - 1  # timers fire behind their time; a row is over at its end
        if due != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if due is not None:
                self.handle.registerTimer(due)
        if known:
            self.last.update(tuple(map(list, zip(*((key, *row) for key, row in known.items()), strict=True))))
        else:
            self.last.clear()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = self._known()
        timer = min((end for *_, end in known.values()), default=0) - 1 if known else None
        now = timerValues.getCurrentProcessingTimeInMs()
        changed = set()
        for chunk in rows:
            for name, target, at_ms, number, ttl in chunk[["key", "target", "at_ms", "number", "ttl"]].itertuples(index=False):
                at_ms, number = int(at_ms) if self.event_time else now, int(number)
                best = known.get(name)
                if best is None or (at_ms, number) > (best[1], best[2]):
                    known[name] = (target, at_ms, number, at_ms + 1000 * int(ttl))
                    changed.add(name)
        if changed:
            self._keep(known, timer)
        yield pd.DataFrame([(name, *known[name], True) for name in sorted(changed)], columns=_NAMES)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        known = self._known()
        now = timerValues.getCurrentWatermarkInMs() if self.event_time else timerValues.getCurrentProcessingTimeInMs()
        over = max(expiredTimerInfo.getExpiryTimeInMs(), now - 1)
        gone = [(name, *row, False) for name, row in known.items() if row[3] - 1 <= over]
        if gone:
            # Spark deletes the timer that fired
            self._keep({name: row for name, row in known.items() if row[3] - 1 > over}, None)
        yield pd.DataFrame(gone, columns=_NAMES)

    def close(self) -> None:
        pass


def roster_changes(announced: DataFrame, event_time: bool = True, late: str = "0 seconds", blocks: int = 4096) -> DataFrame:
    """``announced(key, target, at, number, ttl)`` as a stream, to its changes ``(key, target, at_ms, number, expires_ms, live)``.

    ``ttl`` is in seconds and clamped (:func:`clamp_ttl`); a null one is the default. Of one key the greatest ``at`` counts, of equal ones the
    greatest ``number``. Rows with a null key or time are left out. In event time, rows later than the watermark are dropped by Spark.
    Keys lie in ``blocks`` blocks by hash, and a batch reads and writes the live keys of the blocks that it touches: some hundred keys a block
    are cheap, so many millions of live keys want more blocks. The session must use the RocksDB state store.
    """
    rows = announced.where("key IS NOT NULL AND at IS NOT NULL")
    rows = rows.select(
        F.col("key").cast("string").alias("key"), "target", "at", F.unix_millis("at").alias("at_ms"), F.coalesce(F.col("number").cast("long"), F.lit(0)).alias("number"),
        clamp_ttl(F.coalesce(F.col("ttl"), F.lit(0))).cast("long").alias("ttl"),
    ).withColumn("block", F.pmod(F.xxhash64("key"), F.lit(blocks)))
    if event_time:
        rows = rows.withWatermark("at", late)
    mode = "EventTime" if event_time else "ProcessingTime"
    return rows.groupBy("block").transformWithStateInPandas(Roster(event_time), CHANGES, "Append", mode)


def live(changes: DataFrame) -> DataFrame:
    """``(key, target)`` of the keys whose latest announcement has not expired, from the changes."""
    order = F.struct("at_ms", "number", ~F.col("live"))
    last = changes.groupBy("key").agg(F.max_by("target", order).alias("target"), F.max_by("live", order).alias("live"))
    return last.where("live").select("key", "target")


class EpochView:
    """STM-13: a view of counts that is merged batch by batch.

    Each batch writes its own partial aggregate to the folder of its epoch, so a batch that runs again after a failure
    replaces its part and changes nothing. The view is the parts' merge. ``every`` bounds
    how often it is refreshed: the trigger's interval.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str]):
        self.spark, self.path, self.keys = spark, path, keys
        self.schema: StructType | None = None

    def _partial(self, rows: DataFrame) -> DataFrame:
        return rows.groupBy(*self.keys).agg(F.count("*").alias("n"), F.max("at").alias("last"))

    def put(self, batch: DataFrame, epoch: int) -> None:
        self._partial(batch).write.mode("overwrite").parquet(f"{self.path}/epoch={epoch}")

    def start(self, stream: DataFrame, cursor: str, every: str | None = "120 seconds") -> StreamingQuery:
        """Follow ``stream(*keys, at)``; with ``every`` None what is there is taken and the query ends."""
        self.schema = self._partial(stream).schema
        trigger = {"availableNow": True} if every is None else {"processingTime": every}
        return stream.writeStream.foreachBatch(self.put).option("checkpointLocation", cursor).trigger(**trigger).start()

    def read(self) -> DataFrame:
        parts = self.spark.read.schema(self.schema).parquet(f"{self.path}/epoch=*")
        return parts.groupBy(*self.keys).agg(F.sum("n").alias("n"), F.max("last").alias("last"))

    def compact(self) -> DataFrame:
        """The view, written as one table."""
        return stash(self.read(), "view")
