"""Queries of schema realisation: customers and their orders as one template in every layout."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.operators import realise as R
from marlstone.plans.catalog import query
from marlstone.storage import stash, table

TEMPLATE = (
    R.Entity("orders", "o_orderkey", ("o_orderstatus", "o_orderpriority"), (("o_custkey", "customer"), ("part", "part"))),
    R.Entity("customer", "c_custkey", ("c_name", "c_mktsegment"), (("c_nationkey", "nation"),)),
    R.Entity("nation", "n_nationkey", ("n_name",), (("n_regionkey", "region"),)),
    R.Entity("region", "r_regionkey", ("r_name",)),
    R.Entity("part", "p_partkey", ("p_name", "p_brand", "p_type")),
)
_RANKED = "SELECT o_orderkey, p_partkey FROM (SELECT o_orderkey, ('0x' || sha256('7:' || o_orderkey)[1:15])::BIGINT % (SELECT count(DISTINCT p_partkey) FROM part) AS k FROM orders) JOIN (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) - 1 AS k FROM (SELECT DISTINCT p_partkey FROM part)) USING (k)"


def frames(s, d):
    """The entities' rows; orders have no part of their own, so keys are drawn."""
    own = {name: table(s, d, name) for name in ("customer", "nation", "region", "part")}
    return own | {"orders": stash(R.drawn_keys(table(s, d, "orders"), "o_orderkey", own["part"], "p_partkey", "part", seed=7), "orders")}


@query("sch_18_drawn_keys", _RANKED)
def _(s, d):
    return frames(s, d)["orders"].select("o_orderkey", F.col("part").alias("p_partkey"))


@query(
    "sch_07_12_27_layouts",
    """WITH n AS (SELECT (SELECT count(*) FROM orders) AS o, (SELECT count(*) FROM customer) AS c, (SELECT count(*) FROM nation) AS n, (SELECT count(*) FROM region) AS r, (SELECT count(*) FROM part) AS p),
t AS (SELECT unnest([{'layout': l, 'name': 'orders', 'n_rows': o}, {'layout': l, 'name': 'customer', 'n_rows': c}, {'layout': l, 'name': 'part', 'n_rows': p}]) AS x FROM n, (VALUES ('normalised'), ('eav'), ('junction'), ('star'), ('snowflake')) v(l)
UNION ALL SELECT unnest([{'layout': l, 'name': 'nation', 'n_rows': n}, {'layout': l, 'name': 'region', 'n_rows': r}]) FROM n, (VALUES ('normalised'), ('eav'), ('junction'), ('snowflake')) v(l)
UNION ALL SELECT unnest([{'layout': 'eav', 'name': 'orders_values', 'n_rows': 2 * o}, {'layout': 'eav', 'name': 'customer_values', 'n_rows': 2 * c}, {'layout': 'eav', 'name': 'nation_values', 'n_rows': n}, {'layout': 'eav', 'name': 'region_values', 'n_rows': r}, {'layout': 'eav', 'name': 'part_values', 'n_rows': 3 * p},
{'layout': 'junction', 'name': 'orders_o_custkey', 'n_rows': o}, {'layout': 'junction', 'name': 'orders_part', 'n_rows': o}, {'layout': 'junction', 'name': 'customer_c_nationkey', 'n_rows': c}, {'layout': 'junction', 'name': 'nation_n_regionkey', 'n_rows': n}, {'layout': 'snowflake', 'name': 'orders_details', 'n_rows': o}]) FROM n)
SELECT x.layout AS layout, x.name AS name, x.n_rows AS n_rows, 0::BIGINT AS n_orphans FROM t""",
)
def _(s, d):
    own, found = frames(s, d), None
    for layout in R.LAYOUTS:
        counts = R.orphans(R.realised(TEMPLATE, own, layout)).select(F.lit(layout).alias("layout"), "name", "n_rows", "n_orphans")
        found = counts if found is None else found.union(counts)
    return found


@query(
    "sch_15_star_dimension",
    "SELECT c_custkey, c_name, c_nationkey_n_name AS nation, c_nationkey_n_regionkey_r_name AS region FROM (SELECT c_custkey, c_name, n_name AS c_nationkey_n_name, r_name AS c_nationkey_n_regionkey_r_name FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey)",
)
def _(s, d):
    own = {name: table(s, d, name) for name in ("orders", "customer", "nation", "region", "part")}
    own["orders"] = own["orders"].withColumn("part", F.lit(None).cast("long"))
    dimension = R.realised(TEMPLATE, own, "star")["customer"].rows
    return dimension.select("c_custkey", "c_name", F.col("c_nationkey_n_name").alias("nation"), F.col("c_nationkey_n_regionkey_r_name").alias("region"))
