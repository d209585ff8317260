"""Operators that SQL cannot check, against brute force."""

import random
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from marlstone.functions import text as T
from marlstone.operators import evaluation as E
from marlstone.operators import graph as G
from marlstone.operators import similarity as S
from marlstone.operators import windows as X
from marlstone.streaming.events import replace_frames
from marlstone.streaming.sessions import session_spans


def test_mmr_matches_brute_force(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(12, 4))
    rel = rng.random(12)
    df = spark.createDataFrame([(0, i, v[i].tolist(), float(rel[i])) for i in range(12)], "g int, id long, v array<double>, r double")
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    picked = []
    while len(picked) < 5:
        score = lambda i: 0.7 * rel[i] - 0.3 * max((u[i] @ u[j] for j in picked), default=0)
        picked.append(max((i for i in range(12) if i not in picked), key=score))
    assert [r.id for r in S.mmr(df, "g", "id", "v", "r", 5).orderBy("place").collect()] == picked


def test_nearest_with_many_blocks(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(60, 5))
    df = spark.createDataFrame([(i, v[i].tolist()) for i in range(60)], "id long, v array<double>")
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    sims = np.round(u @ u.T, 9)
    np.fill_diagonal(sims, -9)
    want = {(i, int(j)) for i in range(60) for j in np.argsort(-sims[i], kind="stable")[:3]}
    got = {(r["query"], r["neighbour"]) for r in S.nearest(df, df, "id", "v", 3, block_rows=7).collect()}
    assert got == want


def test_components_closure_and_cycles(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)]
    label = {x: x for e in edges for x in e}
    for _ in range(60):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    got = dict(G.connected(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect())
    assert got == label
    chain = [(i + 1, i) for i in range(20)]
    paths = {(r.ancestor, r.node, r.distance) for r in G.reachable(spark.createDataFrame(chain, "child long, parent long")).collect()}
    assert paths == {(a, b, b - a) for a in range(21) for b in range(a, 21)}
    assert G.cycle_nodes(spark.createDataFrame(chain, "child long, parent long")).count() == 0


def test_greedy_spans(spark):
    rng = random.Random(4)
    rows = [(i % 3, s := rng.randrange(50), s + rng.randrange(1, 12), rng.randrange(1000) / 7) for i in range(90)]
    want = set()
    for g in range(3):
        kept = []
        for _, a, b, m in sorted((r for r in rows if r[0] == g), key=lambda r: (-r[3], r[1], r[2])):
            if all(b <= x or y <= a for x, y in kept):
                kept.append((a, b))
                want.add((g, a, b))
    df = spark.createDataFrame(rows, "g long, a long, b long, m double")
    assert {(r.g, r.a, r.b) for r in X.greedy_spans(df, "g", "a", "b", "m").collect()} == want


def test_paragraph_chunks(spark):
    texts = ["a" * 1500, "one\ntwo\n\n" + "x" * 699 + "\ny", "", "short"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.chunk_paragraphs(F.col("t")).alias("c")).collect()
    for r in rows:
        assert all(len(c) <= 700 for c in r.c) and "".join(r.c).replace("\n", "") == r.t.replace("\n", "")


def test_bootstrap_and_sign_flip(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(3, 1, 400)
    df = spark.createDataFrame([(0, i, float(v)) for i, v in enumerate(x)], "g int, id long, x double")
    r = E.bootstrap_mean(df, ["g"], "id", "x", replicates=200).first()
    half = 1.96 * x.std() / 20
    assert abs(r["mean"] - x.mean()) < 0.02 and abs(r["high"] - r["low"] - 2 * half) < 0.08
    assert E.sign_flip_test(df, ["g"], "id", "x", rounds=50).first().p == 1 / 51


def test_participation_ratio(spark):
    rng = np.random.default_rng(6)
    m = rng.normal(size=(300, 6)) * [3, 2, 1, 1, 0.5, 0.1]
    values = np.linalg.eigvalsh(np.cov(m.T, bias=True))
    df = spark.createDataFrame(pd.DataFrame({"v": m.tolist()}))
    assert abs(S.participation_ratio(df, "v", 6) - values.sum() ** 2 / (values**2).sum()) < 1e-6


def test_markov_clusters_split_two_cliques(spark):
    edges = [(i, j, 1.0) for base in (0, 10) for i in range(base, base + 4) for j in range(i + 1, base + 4)] + [(3, 10, 0.1)]
    got = dict(G.markov_clusters(spark.createDataFrame(edges, "i long, j long, v double")).collect())
    assert len({got[i] for i in range(4)}) == 1 and len({got[i] for i in range(10, 14)}) == 1 and got[0] != got[10]


def frames(seed):
    rng = random.Random(seed)
    return [(f"s{k % 3}", rng.randrange(6), k, rng.choice(["red ", "ring ", "blue ", "re", "d "])) for k in range(40)]


def test_frames_rewind(spark):
    rows = frames(7)
    want = {}
    for s, seq, _, t in rows:
        kept = {k: v for k, v in want.get(s, {}).items() if k < seq}
        want[s] = kept | {seq: t}
    df = spark.createDataFrame(rows, "session string, seq int, arrival long, text string")
    assert dict(replace_frames(df, "session", "seq", "arrival", "text").collect()) == {s: "".join(v for _, v in sorted(f.items())) for s, f in want.items()}


def test_session_stream_sends_each_span_once(spark, tmp_path):
    rows = frames(8)
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "session string, seq int, arrival long, text string"
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    for part in range(2):
        spark.createDataFrame(rows[part * 20 : part * 20 + 20], schema).coalesce(1).write.mode("append").parquet(source)
        stream = session_spans(spark.readStream.schema(schema).parquet(source), ("red", "ring"))
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    got = [tuple(r) for r in spark.read.parquet(out).collect()]
    assert got and max(Counter(got).values()) == 1


def test_assignment_against_all_permutations():
    from itertools import permutations

    rng = np.random.default_rng(4)
    for n, m in ((1, 1), (2, 3), (4, 4), (5, 6), (6, 6)):
        for _ in range(20):
            cost = rng.integers(0, 9, (n, m)).astype(float)
            got = S.assignment(cost)
            assert len(set(got.tolist())) == n
            assert cost[np.arange(n), got].sum() == min(sum(cost[i, p[i]] for i in range(n)) for p in permutations(range(m), n))


def test_lloyd_against_numpy(spark):
    rng = np.random.default_rng(8)
    v = np.concatenate([rng.normal(c, 0.3, (30, 3)) for c in ((3, 0, 0), (0, 3, 0), (0, 0, 3))])
    df = spark.createDataFrame([(i, v[i].tolist()) for i in range(90)], "id long, v array<double>")
    first = [r.id for r in df.orderBy(F.xxhash64("id"), "id").limit(3).collect()]
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    c = u[first]
    for _ in range(3):
        own = np.argmax(np.round(u @ (c / np.linalg.norm(c, axis=1, keepdims=True)).T, 9), axis=1)
        c = np.stack([u[own == k].mean(axis=0) for k in range(3)])
    want = np.argmax(np.round(u @ (c / np.linalg.norm(c, axis=1, keepdims=True)).T, 9), axis=1)
    _, members = S.lloyd(df, "id", "v", 3, 3)
    assert {r.id: r.cluster for r in members.collect()} == dict(enumerate(want.tolist()))


def test_bca_is_the_corrected_interval(spark):
    rng = np.random.default_rng(9)
    x = rng.exponential(2, 300)
    df = spark.createDataFrame([(0, i, float(v)) for i, v in enumerate(x)], "g int, id long, x double")
    r = E.bca_mean(df, ["g"], "id", "x", replicates=400).first()
    ids = np.array([row.h for row in df.orderBy("id").select(F.xxhash64("id").alias("h")).collect()], np.int64)
    w = E.poisson_weights(ids, 400, 7)
    means = (x @ w) / w.sum(axis=0)
    jack = (x.sum() - x) / (len(x) - 1)
    d = jack.mean() - jack
    low, high = E.bca_interval(means, x.mean(), (d**3).sum() / (6 * (d**2).sum() ** 1.5), 0.05)
    assert abs(r.low - low) < 1e-9 and abs(r.high - high) < 1e-9 and low < x.mean() < high


def test_line_windows_keep_fences(spark):
    texts = ["", "a", "aaaa\nbbbb\ncc", "x\n```\n" + "code\n" * 9 + "```\nafter\nmore text here", "```\nnever closed\n" + "y\n" * 20]
    for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.line_windows(F.col("t"), 8).alias("w")).collect():
        want, now, fence = [], [], False
        for line in r.t.split("\n"):
            now.append(line)
            fence ^= line.startswith("```")
            if not fence and len("\n".join(now)) >= 8:
                want.append("\n".join(now))
                now = []
        assert r.w == want + (["\n".join(now)] if now else []) and "\n".join(r.w) == r.t


def test_greedy_spans_against_a_loop(spark):
    rng = np.random.default_rng(3)
    rows = [(int(g), int(a), int(a + n), float(q)) for g, a, n, q in zip(rng.integers(0, 9, 200), rng.integers(0, 60, 200), rng.integers(1, 12, 200), rng.integers(0, 9, 200), strict=True)]
    got = sorted(tuple(r) for r in X.greedy_spans(spark.createDataFrame(rows, "g int, a int, b int, q double"), "g", "a", "b", "q").collect())
    want = []
    for g in range(9):
        kept = []
        for _, a, b, q in sorted((r for r in rows if r[0] == g), key=lambda r: (-r[3], r[1], r[2])):
            if not any(x < b and a < y for x, y in kept):
                kept.append((a, b))
                want.append((g, a, b, q))
    assert got == sorted(want)


def test_numbering_and_hubs(spark):
    df = spark.range(0, 500, numPartitions=7).select((F.col("id") * 37 % 501).alias("k"))
    assert [r.i for r in X.numbered(df, [F.col("k")], "i").orderBy("k").collect()] == list(range(500))
    edges = [(1, 2), (2, 3), (1, 3), (3, 4), *((99, i) for i in range(200, 230))]
    got = {tuple(r) for r in G.pruned_hubs(spark.createDataFrame(edges, "a long, b long"), 5, 0.3).collect()}
    assert got == {(1, 2), (1, 3), (2, 3)}


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    from marlstone import storage

    spark = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None))
    with pytest.raises(RuntimeError):
        storage.shared_dir(spark)


def test_trails_hold_one_trail_at_a_time(spark):
    import random

    from marlstone.streaming.events import trails

    rng = random.Random(5)
    rows = [(u, i, rng.choice("abcdefgh")) for u in (1, 2, None) for i in range(400 if u == 1 else 7)]
    want = {}
    for u, _, x in sorted(rows, key=lambda r: r[1]):
        t = want.get(u, [])
        want[u] = t[: t.index(x) + 1] if x in t else (t + [x])[-5:]
    rng.shuffle(rows)
    df = spark.createDataFrame([*rows, (3, 1, None)], "u long, i long, p string")
    assert {r.u: list(r.trail) for r in trails(df, "u", "i", "p").collect()} == want
    assert trails(df.limit(0), "u", "i", "p").collect() == []
