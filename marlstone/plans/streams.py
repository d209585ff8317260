"""Queries of the streaming operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.plans.catalog import query
from marlstone.storage import scratch, table
from marlstone.streaming import events as E
from marlstone.streaming import roster as R


@query("stm_x1_tumbling", "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def _(s, d):
    w = E.tumbling(table(s, d, "events"), "ts", "1 hour", ["event_type"])
    return w.select(F.date_format("start", "yyyy-MM-dd HH").alias("hour"), "event_type", "n", F.round("total", 4).alias("total"))


@query("stm_x2_sessions", "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, count(DISTINCT k) AS sessions, count(*) AS n FROM s GROUP BY 1")
def _(s, d):
    return E.sessions(table(s, d, "events"), "ts", "2 hours", ["user_id"]).groupBy("user_id").agg(F.count("*").alias("sessions"), F.sum("n").alias("n"))


@query("stm_02_replaced_frames", "WITH f AS (SELECT user_id, event_id, event_id % 5 AS seq FROM events), l AS (SELECT *, min(seq) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS later FROM f) SELECT user_id, string_agg(seq::VARCHAR, '' ORDER BY seq) AS text FROM l WHERE later IS NULL OR later > seq GROUP BY 1")
def _(s, d):
    f = table(s, d, "events").select("user_id", "event_id", (F.col("event_id") % 5).alias("seq"), (F.col("event_id") % 5).cast("string").alias("text"))
    return E.replace_frames(f, "user_id", "seq", "event_id", "text")


@query("stm_03_04_readiness", "SELECT doc_id, (CASE WHEN doc_id % 2 = 0 THEN greatest(1, floor((n_chars - 512) / 256) + 1) ELSE greatest(0, floor((n_chars - 768) / 256) + 1) END)::BIGINT AS ready FROM documents")
def _(s, d):
    return table(s, d, "documents").select("doc_id", E.ready_windows(F.col("n_chars"), 512, 256, F.col("doc_id") % 2 == 0).cast("long").alias("ready"))


@query("stm_07_08_roster", "SELECT user_id, max_by(event_type, event_id) AS event_type FROM events GROUP BY 1 HAVING max_by(ts, event_id) + INTERVAL 3600 SECOND > TIMESTAMP '2024-01-30 20:00:00'")
def _(s, d):
    e = table(s, d, "events").select("user_id", "event_id", "event_type", "ts", E.clamp_ttl(F.lit(999_999)).alias("ttl"))
    return E.roster(e, "user_id", "ts", "ttl", F.lit("2024-01-30 20:00:00").cast("timestamp")).select("user_id", "event_type")


@query("stm_12_14_ingest", "SELECT count(*) AS first, 0::BIGINT AS second FROM events")
def _(s, d):
    source, target = scratch(s, "ingest-in"), scratch(s, "ingest-out")
    rows = table(s, d, "events").select("event_id", "event_type")
    rows.write.json(source)
    counts = [E.ingest(s, source, rows.schema, target, "event_id") for _ in range(2)]
    return s.createDataFrame([tuple(counts)], "first long, second long")


@query("stm_x3_stream_equals_batch", "SELECT count(*) AS n FROM events WHERE event_type = 'click'")
def _(s, d):
    rows = table(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return E.run_stream(s, rows, lambda x: x.where("event_type = 'click'").select("event_id")).agg(F.count("*").alias("n"))


@query("stm_07_08_roster_stream", "SELECT user_id::VARCHAR AS key, max_by(event_type, (ts, event_id)) AS target FROM events GROUP BY 1 HAVING max(ts) + INTERVAL 1800 SECOND > (SELECT max(ts) FROM events)")
def _(s, d):
    """The roster as a stream in event time, in three starts: who is live at the last event."""
    own = E.with_state_store(s)
    rows = table(own, d, "events").select(F.col("user_id").alias("key"), F.col("event_type").alias("target"), F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("number"), F.lit(1800).alias("ttl"))
    day = F.day("at")
    parts = [rows.where(day <= 10), rows.where((day > 10) & (day <= 20)), rows.where(day > 20)]
    return R.live(E.run_in_parts(own, parts, R.roster_changes))


@query("stm_13_refreshed_view", "SELECT event_type, user_id % 100 AS shard, count(*) AS n, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last FROM events GROUP BY 1, 2")
def _(s, d):
    """A view that two starts of a stream merge, the second part run twice."""
    source, cursor = scratch(s, "view-in"), scratch(s, "view-cursor")
    rows = table(s, d, "events").select("event_type", (F.col("user_id") % 100).alias("shard"), F.col("ts").cast("timestamp").alias("at"), "event_id")
    view = R.EpochView(s, scratch(s, "view"), ["event_type", "shard"])
    for half in range(2):
        rows.where(F.col("event_id") % 2 == half).write.mode("append").parquet(source)
        view.start(s.readStream.schema(rows.schema).parquet(source), cursor, None).awaitTermination()
    view.put(rows.where(F.col("event_id") % 2 == 1), 1)  # an epoch that runs again
    return view.read().select("event_type", "shard", "n", F.date_format("last", "yyyy-MM-dd HH:mm:ss").alias("last"))
