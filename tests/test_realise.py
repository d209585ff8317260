"""Layouts of one template: order, keys and values."""

import pytest

from marlstone.operators import realise as R

TEMPLATE = (R.Entity("a", "id", ("x", "y"), (("b_id", "b"), ("c_id", "c"))), R.Entity("b", "bid", ("name",), (("c_id", "c"),)), R.Entity("c", "cid", ()))


def frames(spark):
    return {
        "a": spark.createDataFrame([(1, 10, 5, "x1", None), (2, 11, None, None, 7), (3, None, 6, "x3", 8)], "id long, b_id long, c_id long, x string, y int"),
        "b": spark.createDataFrame([(10, 5, "ten"), (11, 6, "eleven")], "bid long, c_id long, name string"),
        "c": spark.createDataFrame([(5,), (6,)], "cid long"),
    }


def test_order():
    assert [e.name for e in R.in_order(TEMPLATE)] == ["c", "b", "a"]
    with pytest.raises(ValueError):
        R.in_order((R.Entity("a", "id", (), (("b", "b"),)), R.Entity("b", "id", (), (("a", "a"),))))
    with pytest.raises(ValueError):
        R.in_order((R.Entity("a", "id", (), (("b", "b"),)),))


@pytest.mark.parametrize("layout", R.LAYOUTS)
def test_no_layout_has_an_orphan(spark, layout):
    tables = R.realised(TEMPLATE, frames(spark), layout)
    assert all(r.n_orphans == 0 for r in R.orphans(tables).collect())
    rows = {name: sorted(map(tuple, t.rows.collect()), key=str) for name, t in tables.items()}
    if layout == "eav":
        assert rows["a_values"] == sorted([(1, "x", "x1"), (2, "y", "7"), (3, "x", "x3"), (3, "y", "8")], key=str) and "c_values" not in rows
    if layout == "junction":
        assert rows["a_b_id"] == [(1, 10), (2, 11)] and rows["a_c_id"] == [(1, 5), (3, 6)] and rows["a"] == [(1, "x1", None), (2, None, 7), (3, "x3", 8)]
    if layout == "star":
        assert set(rows) == {"a", "b", "c"} and rows["b"] == [(10, 5, "ten"), (11, 6, "eleven")]
    if layout == "snowflake":
        assert rows["a"] == sorted([(1, 10, 5), (2, 11, None), (3, None, 6)], key=str) and list(tables)[-1] == "a"


def test_orphans_are_counted(spark):
    own = frames(spark)
    own["c"] = own["c"].where("cid = 5")
    counts = {r["name"]: r.n_orphans for r in R.orphans(R.realised(TEMPLATE, own, "normalised")).collect()}
    assert counts == {"a": 1, "b": 1, "c": 0}


def test_drawn_keys_all_resolve(spark):
    rows = spark.range(500).selectExpr("id AS k")
    pool = spark.createDataFrame([(i % 7 * 3,) for i in range(40)] + [(None,)], "p long")
    got = R.drawn_keys(rows, "k", pool, "p", "ref", seed=1).collect()
    assert len(got) == 500 and {r.ref for r in got} == {0, 3, 6, 9, 12, 15, 18}
    with pytest.raises(ValueError):
        R.drawn_keys(rows, "k", pool.where("p > 99"), "p", "ref")
    with pytest.raises(ValueError):
        R.realised(TEMPLATE, frames(spark), "none")
