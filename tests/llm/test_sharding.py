import numpy as np
import pytest

from marlstone.llm import sharding


def plain_table(shards, slots):
    orders = []
    for s in shards:
        a, b = sharding._number(s, b"offset") % slots, sharding._number(s, b"stride") % (slots - 1) + 1
        orders.append([(a + b * j) % slots for j in range(slots)])
    held = {}
    turn = 0
    while len(held) < slots:
        order = orders[turn % len(shards)]
        held[next(x for x in order if x not in held)] = turn % len(shards)
        turn += 1
    return [held[i] for i in range(slots)]


@pytest.mark.parametrize(("n", "slots"), [(1, 13), (3, 13), (5, 101), (13, 13)])
def test_table_matches_brute_force(n, slots):
    shards = [f"s{i}" for i in range(n)]
    assert sharding.table_of(shards, slots).tolist() == plain_table(shards, slots)


def test_balance_and_little_movement():
    shards = [f"s{i}" for i in range(20)]
    before = sharding.table_of(shards, 10007)
    assert np.ptp(np.bincount(before)) <= 1
    after = sharding.table_of(shards[:-1], 10007)
    stayed = (before == after)[before != 19].mean()
    assert stayed > 0.9
    for bad in (([], 13), (["a", "a"], 13), (["a"], 12), (["a"], 2_000_029)):
        with pytest.raises(ValueError):
            sharding.table_of(*bad)


def test_place(spark):
    df = spark.createDataFrame([(i % 50, "x") for i in range(200)] + [(None, "x"), (None, "y")], "id long, shard string")
    rows = sharding.place(df, "id", ["a", "b", "c"], 101).collect()
    assert len(rows) == 202 and len({(r.id, r.slot, r.shard) for r in rows}) == 51
    held = sharding.table_of(["a", "b", "c"], 101)
    assert all("abc"[held[r.slot]] == r.shard for r in rows)
    assert sharding.place(df.limit(0), "id", ["a"]).count() == 0


def test_place_with_clashing_names(spark):
    df = spark.createDataFrame([(1, "a", 5, "k"), (None, "b", 6, None)], "slot long, __slot string, row int, shard string")
    got = sharding.place(df, "slot", ["a", "b", "c"], 101)
    assert got.columns == ["__slot", "row", "slot", "shard"] and sorted((r[0], r[1]) for r in got.collect()) == [("a", 5), ("b", 6)]
    by_shard = {r.row: r.slot for r in sharding.place(df, "shard", ["a", "b"], 101).collect()}
    want = sharding.place(df.withColumnRenamed("shard", "key"), "key", ["a", "b"], 101).collect()
    assert by_shard == {r.row: r.slot for r in want}
