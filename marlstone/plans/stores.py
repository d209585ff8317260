"""Queries of tables that outlive a run: the embedding cache, the exchange log, the graph's vertex and edge tables."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import functions as F

from marlstone.operators import embedding_cache as C
from marlstone.operators import patterns as P
from marlstone.plans.catalog import query
from marlstone.sources.exchange import Exchange, Layout
from marlstone.storage import scratch, stash, table

_DIMS = 16


def _letter_counts(texts: list[str]) -> np.ndarray:
    """An encoder that needs no model: how many code points of a text have each remainder by 16."""
    return np.array([np.bincount([ord(c) % _DIMS for c in t], minlength=_DIMS) if t else np.zeros(_DIMS) for t in texts])


_COLUMNS = "(VALUES ('p_name'), ('p_type'), ('p_retailprice')) AS c(name)"
_COUNTS = ", ".join(f"count(*) FILTER (u % 16 = {i})" for i in range(_DIMS))


@query(
    "sim_03_04_cache",
    f"""WITH cells AS (SELECT p_brand, p_size, name, CASE name WHEN 'p_name' THEN p_name WHEN 'p_type' THEN p_type ELSE p_retailprice::VARCHAR END AS cell, row_number() OVER (PARTITION BY p_brand, p_size, name ORDER BY p_partkey) AS n FROM part, {_COLUMNS}),
cols AS (SELECT p_brand, p_size, name, string_agg(cell, chr(1) ORDER BY n) AS key, string_agg(cell, ' ' ORDER BY n) AS body FROM cells WHERE n <= 50 GROUP BY ALL),
vecs AS (SELECT p_brand, p_size, name, array_to_string([{_COUNTS}], ',') AS vector FROM (SELECT p_brand, p_size, name, unicode(unnest(string_split(body, ''))) AS u FROM cols) GROUP BY ALL)
SELECT run::INT AS run, p_brand, p_size, name AS "column", CASE run WHEN 1 THEN false WHEN 3 THEN true ELSE key IN (SELECT key FROM cols WHERE name <> 'p_retailprice') END AS hit, vector
FROM cols JOIN vecs USING (p_brand, p_size, name), range(1, 4) AS t(run) WHERE run > 1 OR name <> 'p_retailprice'""",
)
def _(s, d):
    """Three runs over one cache: two columns of every table, all columns, and all again. A table is the parts of a brand and size."""
    named = [F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("cell")) for c in ("p_name", "p_type", "p_retailprice")]
    cells = table(s, d, "part").select("p_brand", "p_size", "p_partkey", F.explode(F.array(*named)).alias("c")).select("p_brand", "p_size", "p_partkey", "c.*")
    columns = stash(C.first_cells(cells, ["p_brand", "p_size", "column"], ["p_partkey"], "cell"), "columns")
    cache = C.EmbeddingCache(s, scratch(s, "cache"), _DIMS)
    found = None
    for run, part in enumerate((columns.where("column <> 'p_retailprice'"), columns, columns), 1):
        own = cache.embed(part, _letter_counts, ["p_brand", "p_size", "column"]).withColumn("run", F.lit(run))
        found = own if found is None else found.union(own)
    vector = F.array_join(F.transform("vector", lambda x: x.cast("int").cast("string")), ",")
    return found.select("run", "p_brand", "p_size", "column", "hit", vector.alias("vector"))


_EXCHANGE = Layout("event_id bigint, user_id bigint, event_type string, value double, day date", ("day",), ("user_id", "event_id"), "event_id")


@query("src_27_snk_07_exchange", "SELECT ts::DATE AS day, event_type, count(*) AS n, count(DISTINCT event_id) AS n_ids FROM events GROUP BY ALL")
def _(s, d):
    """The whole table of events in two commits, the second of which also holds all of the first; then both again."""
    log = Exchange(s, f"exchange_{uuid.uuid4().hex}", _EXCHANGE, scratch(s, "exchange"))
    rows = table(s, d, "events").select("event_id", "user_id", "event_type", "value", F.to_date("ts").alias("day"))
    for part in (rows.where("event_type = 'click'"), rows, rows):
        log.append(part)
    counts = stash(log.read().groupBy("day", "event_type").agg(F.count("*").alias("n"), F.countDistinct("event_id").alias("n_ids")), "counts")
    log.drop()
    return counts


def supply_graph(s, d):
    """Customers, orders, order lines and parts as vertices; who placed, what it has, and of what part."""
    line = F.concat_ws("-", F.lit("l"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    c, o, l, p = (table(s, d, x) for x in ("customer", "orders", "lineitem", "part"))
    lines = l.select(line.alias("id"), F.lit("Line").alias("label"), P.properties("l_quantity", "l_returnflag"))
    vertices = (
        c.select(key("c", "c_custkey").alias("id"), F.lit("Customer").alias("label"), P.properties("c_name", "c_mktsegment"))
        .union(o.select(key("o", "o_orderkey"), F.lit("Order"), P.properties("o_orderpriority", "o_orderstatus")))
        .union(lines)
        .union(p.select(key("p", "p_partkey"), F.lit("Part"), P.properties("p_name", "p_brand")))
    )
    edges = (
        o.select(key("c", "o_custkey").alias("src"), key("o", "o_orderkey").alias("dst"), F.lit("PLACED").alias("label"), P.properties("o_orderdate"))
        .union(l.select(key("o", "l_orderkey"), line, F.lit("HAS"), P.properties("l_linenumber")))
        .union(l.select(line, key("p", "l_partkey"), F.lit("OF"), P.properties("l_discount")))
    )
    return vertices, edges


_LINE = "concat_ws('-', 'l', l_orderkey, l_linenumber, l_partkey, l_suppkey)"


@query(
    "src_28_graph_pattern",
    f"""WITH v AS (SELECT {_LINE} AS id, l_quantity FROM lineitem WHERE l_returnflag = 'R'), has AS (SELECT l_orderkey AS o, {_LINE} AS id, l_linenumber FROM lineitem), of_part AS (SELECT {_LINE} AS id, l_partkey AS p FROM lineitem WHERE l_discount >= 0.05)
SELECT 'c' || c_custkey AS customer, 'o' || o_orderkey AS "order", v.id AS line, 'p' || p_partkey AS part, c_name, l_quantity, l_linenumber::VARCHAR AS line_number, p_name
FROM customer JOIN orders ON o_custkey = c_custkey JOIN has ON has.o = o_orderkey JOIN v ON v.id = has.id JOIN of_part ON of_part.id = v.id JOIN part ON p_partkey = of_part.p
WHERE c_mktsegment = 'BUILDING' AND o_orderpriority = '1-URGENT'""",
)
def _(s, d):
    vertices, edges = supply_graph(s, d)
    pattern = P.Pattern(
        (P.Vertex("customer", "Customer", "props['c_mktsegment'] = 'BUILDING'"), P.Vertex("order", "Order", "props['o_orderpriority'] = '1-URGENT'"), P.Vertex("line", "Line", "props['l_returnflag'] = 'R'"), P.Vertex("part", "Part")),
        (P.Edge("customer", "order", "PLACED"), P.Edge("order", "line", "HAS", name="has"), P.Edge("line", "part", "OF", "CAST(props['l_discount'] AS double) >= 0.05")),
    )
    found = P.match(vertices, edges, pattern)
    of = lambda name, key: F.col(f"{name}_props")[key]
    return found.select(
        "customer", "order", "line", "part", of("customer", "c_name").alias("c_name"), of("line", "l_quantity").cast("double").alias("l_quantity"), of("has", "l_linenumber").alias("line_number"), of("part", "p_name").alias("p_name")
    )


@query("tok_02_03_roles")
def _(s, d):
    """Every column of every table of parts (a table is a brand and size) with two contexts: tokens and roles, as digests and counts."""
    from marlstone.operators.serialise import serialised

    shown = ["p_name", "p_type", "p_size", "p_retailprice"]
    where = F.concat_ws("/", "p_brand", F.col("p_size").cast("string")).alias("table")
    each = F.posexplode(F.array(*(F.col(c).cast("string") for c in shown))).alias("ix", "value")
    cells = stash(table(s, d, "part").select(where, F.col("p_partkey").alias("place"), each), "cells")
    names = cells.select("table", "ix").distinct().select("table", "ix", F.get(F.array(*map(F.lit, shown)), F.col("ix")).alias("name"))
    columns = C.first_cells(cells, ["table", "ix"], ["place"], "value")
    vectors = C.EmbeddingCache(s, scratch(s, "cache"), _DIMS).embed(columns, _letter_counts, ["table", "ix"]).select("table", "ix", "vector")
    found = serialised(cells, names, vectors, most=128, k=2)
    joined = lambda c: F.sha2(F.array_join(F.transform(c, lambda x: x.cast("string")), ",").cast("binary"), 256)
    return found.select("table", "target", F.size("tokens").cast("long").alias("n_tokens"), joined("tokens").alias("tokens"), joined("roles").alias("roles"))
