"""The stateful streams against plain loops over what each batch brought."""

import random
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from marlstone.storage import scratch
from marlstone.streaming import events as E
from marlstone.streaming import roster as R
from marlstone.streaming.sessions import SessionWindows, Survivors, session_windows, term_labels

SCHEMA = "session string, seq int, arrival long, text string, flush boolean"
TERMS = ("a", "bb", "c d")


def surviving(frames):
    return sorted((s, a) for s, a in frames if not any(b > a and t <= s for t, b in frames))


def test_survivors_do_not_depend_on_order():
    rnd = random.Random(3)
    for _ in range(400):
        frames = [(rnd.randrange(6), a) for a in rnd.sample(range(50), rnd.randrange(1, 10))]
        want = surviving(frames)
        for _ in range(3):
            rnd.shuffle(frames)
            held = Survivors([])
            for s, a in frames + frames[:2]:
                held.add(s, a)
            assert list(zip(held.seqs, held.arrivals, strict=True)) == want


def windows(text, size, stride, flush):
    import re

    t = [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]
    n = max(0, (len(t) - size - stride) // stride + 1)
    if flush:
        n = max(1, (len(t) - size) // stride + 1) if t else 0
    return [(t[k * stride][0], t[min(len(t), k * stride + size) - 1][1]) for k in range(n)]


def brute(batches, size, stride):
    """What is sent after each batch: labels of the settled windows of the text as it stands then, each once."""
    frames, texts, flushed, sent, out = {}, {}, set(), set(), []
    for batch in batches:
        for session, seq, arrival, text, flush in batch:
            frames.setdefault(session, set()).add((seq, arrival))
            texts[session, seq, arrival] = text or ""
            if flush:
                flushed.add(session)
        for session in {r[0] for r in batch}:
            whole = "".join(texts[session, s, a] for s, a in surviving(list(frames[session])))
            for a, b in windows(whole, size, stride, session in flushed):
                for label in TERMS:
                    if label in whole[a:b] and (session, a, b, label) not in sent:
                        sent.add((session, a, b, label))
                        out.append((session, a, b, label))
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_session_windows_match_brute_force(spark, seed):
    rnd = random.Random(seed)
    arrival, batches = 0, []
    for b in range(4):
        batch = []
        for session in ("s", "t", "u", "hot"):
            for _ in range(rnd.randrange(0, 12) if session != "hot" else 40):
                arrival += 1
                seq = arrival if rnd.random() < 0.85 else rnd.randrange(max(1, arrival - 30), arrival + 1)
                text = "".join(rnd.choice(["a ", "bb", " ", "c d", "x", "\n", "é ", ""]) for _ in range(rnd.randrange(6)))
                batch.append((session, seq, arrival, rnd.choice([text, text, text, None]), b == 3 and session == "t"))
        rnd.shuffle(batch)
        batches.append(batch + batch[:3])
    own = E.with_state_store(spark, idle_batches=False)
    own.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # several chunks a session
    parts = [own.createDataFrame(b, SCHEMA).repartition(3) for b in batches]
    got = E.run_in_parts(own, parts, lambda x: session_windows(x, term_labels(TERMS), 6, 3))
    assert sorted(tuple(r) for r in got.collect()) == brute(batches, 6, 3)


def test_the_callers_session_keeps_its_settings(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    E.with_state_store(spark)
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", None) == before


def test_roster_stream_equals_batch(spark):
    rnd = random.Random(5)
    own = E.with_state_store(spark)
    rows, base = [], 1_700_000_000
    for n in range(300):
        rows.append((rnd.choice("abcdefgh") * rnd.choice([1, 1, 2]), rnd.choice(["x", "y"]), base + 20 * n, n, rnd.choice([0, -5, 1, 40, 99_999, None])))
    df = own.createDataFrame(rows, "key string, target string, at long, number long, ttl int").withColumn("at", F.timestamp_seconds("at"))
    parts = [df.where(f"number BETWEEN {a} AND {a + 99}") for a in (0, 100, 200)]
    got = E.run_in_parts(own, parts, R.roster_changes)
    now = F.timestamp_seconds(F.lit(base + 20 * 299))
    clamped = df.withColumn("ttl", E.clamp_ttl(F.coalesce("ttl", F.lit(0))))
    want = E.roster(clamped, "key", "at", "ttl", now)
    assert sorted(tuple(r) for r in R.live(got).collect()) == sorted((r.key, r.target) for r in want.collect())
    assert got.where("NOT live").count() > 5


def test_rows_expire_in_processing_time(spark):
    """A key announced for the least time goes by itself, one announced for long stays."""
    own = E.with_state_store(spark)
    source = scratch(own, "roster-in")
    df = own.createDataFrame([("short", "x", 1, 1), ("long", "y", 1, 3600)], "key string, target string, number long, ttl int").withColumn("at", F.current_timestamp())
    df.write.parquet(source)
    seen = []

    def keep(batch, epoch):
        seen.extend(tuple(r) for r in batch.select("key", "live").collect())

    stream = R.roster_changes(own.readStream.schema(df.schema).parquet(source), event_time=False)
    query = stream.writeStream.foreachBatch(keep).option("checkpointLocation", scratch(own, "roster-cursor")).trigger(processingTime="1 second").start()
    try:
        until = time.time() + 60
        while ("short", False) not in seen and time.time() < until:
            time.sleep(0.5)
    finally:
        query.stop()
    assert sorted(seen) == [("long", True), ("short", False), ("short", True)]


def test_roster_keeps_blocks_of_keys(spark):
    """However keys lie in blocks, the changes are those of each key by itself; state and timers are counted by blocks."""
    rnd = random.Random(6)
    own = E.with_state_store(spark)
    base, batches, n = 1_700_000_000, [], 0
    for b in range(3):
        batch = []
        for _ in range(500):
            n += 1
            batch.append((f"k{rnd.randrange(120)}", rnd.choice(["x", "y", None]), base + 900 * b + rnd.randrange(1, 900), n, rnd.choice([0, 5, 40, 700, 3600])))
        batches.append(batch)
    last, want, mark = {}, [], 0
    for batch in batches:  # rows before the watermark are late; keys end once a batch has moved it
        new = {}
        for key, target, at, number, ttl in batch:
            row = (target, at * 1000, number, at * 1000 + 1000 * (ttl or 60))
            if at * 1000 >= mark and row[1:3] > new.get(key, last.get(key, (None, 0, 0)))[1:3]:
                new[key] = row
        want += [(k, *v, True) for k, v in new.items()]
        last |= new
        mark = max(mark, *(at * 1000 for _, _, at, *_ in batch))
        want += [(k, *v, False) for k, v in last.items() if v[3] <= mark]
        last = {k: v for k, v in last.items() if v[3] > mark}
    schema = "key string, target string, at long, number long, ttl int"
    parts = [own.createDataFrame(b, schema).withColumn("at", F.timestamp_seconds("at")) for b in batches]
    for blocks in (1, 7, 4096):
        got = E.run_in_parts(own, parts, lambda x, blocks=blocks: R.roster_changes(x, blocks=blocks))
        assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want)), blocks
    source = scratch(own, "roster-in")
    parts[0].write.parquet(source)
    stream = R.roster_changes(own.readStream.schema(parts[0].schema).parquet(source), blocks=7)
    query = stream.writeStream.format("noop").option("checkpointLocation", scratch(own, "roster-cursor")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress) <= 3 * 7  # a value and a timer, which has two entries


class Store:
    """State by name, with the calls counted; also the handle that gives it."""

    def __init__(self):
        self.calls, self.held = 0, {}

    def getMapState(self, name, key, value, ttl=None):
        return self.held.setdefault(name, type(self)())

    getValueState = getMapState

    def total(self):
        return sum(x.calls for x in self.held.values())

    def updateValue(self, key, value):
        self.calls += 1
        self.held[key] = value

    def getValue(self, key):
        self.calls += 1
        return self.held.get(key)

    def containsKey(self, key):
        self.calls += 1
        return key in self.held

    def removeKey(self, key):
        self.calls += 1
        self.held.pop(key, None)

    def keys(self):
        self.calls += 1
        return iter([*self.held])

    def iterator(self):
        self.calls += 1
        return iter([*self.held.items()])

    def get(self):
        return self.getValue(())

    def exists(self):
        return self.containsKey(())

    def update(self, value):
        self.updateValue((), value)


class Clock:
    def __init__(self, now):
        self.now = now

    def getCurrentProcessingTimeInMs(self):
        return self.now


def test_windows_share_entries_of_the_state():
    """Calls into the state store follow frames and blocks of windows, not windows; a text is scored once wherever it stands."""
    scored = []

    def score(texts):
        scored.extend(texts)
        return [["odd" if len(x) % 2 else "even", "any"] for x in texts]

    state = Store()
    own = SessionWindows(score, 6, 3, 3600)
    own.init(state)

    def send(now, *frames):
        rows = pd.DataFrame([(*x, False) for x in frames], columns=["seq", "arrival", "text", "flush"])
        before = state.total()
        out = pd.concat(own.handleInputRows(("s",), iter([rows]), Clock(now)))
        return list(out.itertuples(index=False, name=None)), state.total() - before

    words = "".join(f"w{i} " for i in range(6000))
    sent, calls = send(0, (1, 1, words[:20000]), (2, 2, words[20000:]))
    assert len(sent) == 2 * (6000 // 3 - 2) and len(scored) == len(set(scored)) == 6000 // 3 - 2
    assert calls < 400  # 1,998 windows
    sizes = [len(x[1]) for x in state.held["memo"].held.values()]
    assert sum(sizes) == len(scored) and max(sizes) < 200
    again, _ = send(1000, (2, 3, words[20000:]))  # the same text after a rewind
    assert again == [] and len(scored) == 6000 // 3 - 2
    moved, calls = send(2000, (3, 4, words[:15000]))  # known texts at another place, but for those around the seam
    assert len(moved) > 1500 and len(scored) < 6000 // 3 + 2 and calls < 400
    late, _ = send(3600_000, (2, 5, words[20000:]))  # what the first batch sent is forgotten
    assert late and {x for x in late} <= {x for x in sent}
    assert len(scored) < 6000 // 3 + 2
