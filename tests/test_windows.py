"""Running sums, first rows and spans against plain loops; hot groups and null groups among them."""

import random

import pytest
from pyspark.sql import functions as F

from marlstone.operators import graph as G
from marlstone.operators import windows as W


def rows_of(seed):
    rnd = random.Random(seed)
    return [(rnd.choice(["hot"] * 6 + ["a", "b", None]), i, rnd.choice([None, 1, 2, 5])) for i in rnd.sample(range(2000), 400)]


@pytest.mark.parametrize("by", [["g"], []])
def test_running_matches_a_loop(spark, by):
    rows = rows_of(len(by))
    df = spark.createDataFrame(rows, "g string, i int, v long").repartition(5)
    got = {(r.g, r.i): (r.before, r.most) for r in W.running(df, by, [F.col("i")], {"before": ("sum", "v"), "most": ("max", "v")}).collect()}
    held, want = {}, {}
    for g, i, v in sorted(rows, key=lambda r: r[1]):
        k = g if by else 0
        seen = held.setdefault(k, [])
        want[g, i] = (sum(seen), max(seen)) if seen else (None, None)
        if v is not None:
            seen.append(v)
    assert got == want
    assert W.running(df.limit(0), by, [F.col("i")], {"before": ("sum", "v")}).count() == 0


def test_first_rows(spark):
    rows = rows_of(3)
    df = spark.createDataFrame(rows, "g string, i int, v long")
    got = {(r.g, r.i, r.r) for r in W.first_rows(df, ["g"], ["i"], 7).collect()}
    want = {(g, i, n) for x in {r[0] for r in rows} for n, (g, i) in enumerate(sorted((g, i) for g, i, _ in rows if g == x), 1) if n <= 7}
    assert got == want


def test_greedy_spans_match_a_loop(spark):
    rnd = random.Random(9)
    rows = []
    for _ in range(600):
        a = rnd.randrange(0, 900)
        rows.append((rnd.choice(["hot", "hot", "x", None]), a, a + rnd.choice([0, 1, 4, 9, 40]), float(rnd.randrange(5))))
    rows += rows[:5]
    got = sorted(map(tuple, W.greedy_spans(spark.createDataFrame(rows, "g string, a int, b int, s double").repartition(4), "g", "a", "b", "s").collect()), key=str)
    want = []
    for g in ("hot", "x", None):
        kept = []
        for _, a, b, s in sorted((r for r in rows if r[0] == g), key=lambda r: (-r[3], r[1], r[2])):
            if not any(y < b and a < z for y, z, _ in kept):
                kept.append((a, b, s))
        want += [(g, *k) for k in kept]
    assert got == sorted(want, key=str)


def test_expansion_refuses_other_depths(spark):
    edges = spark.createDataFrame([(1, 2)], "a long, b long")
    for depth in (0, 6):
        with pytest.raises(ValueError):
            G.expand(edges, edges.select(F.col("a").alias("node")), depth)
