"""Queries of corpus scans, harvests, report metrics and read models."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from marlstone.functions import hashing as H
from marlstone.functions.text import words
from marlstone.operators import graph as G
from marlstone.operators import similarity as S
from marlstone.plans.catalog import query
from marlstone.sources import io
from marlstone.storage import scratch, table
from marlstone.streaming.events import trails

# ---- scans


@query("src_13_manifest", "SELECT doc_id, quality IS NOT NULL AS listed FROM documents LEFT JOIN labels USING (doc_id)")
def _(s, d):
    listed = table(s, d, "labels").select("doc_id", F.lit(True).alias("hit"))
    return table(s, d, "documents").select("doc_id").join(listed, "doc_id", "left").select("doc_id", F.coalesce("hit", F.lit(False)).alias("listed"))


@query("src_14_15_resumed_harvest", "SELECT min(doc_id) AS doc_id, lang FROM documents WHERE doc_id >= 100 AND length(text) >= 500 AND sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id < 100) GROUP BY sha256(text), lang")
def _(s, d):
    docs = table(s, d, "documents").withColumn("h", F.sha2(F.col("text").cast("binary"), 256))
    seen = docs.where("doc_id < 100").select("h").distinct()
    fresh = docs.where((F.col("doc_id") >= 100) & (F.length("text") >= 500)).join(seen, "h", "left_anti")
    return fresh.groupBy("h", "lang").agg(F.min("doc_id").alias("doc_id")).select("doc_id", "lang")


def _scanned(s, d, name, text, sep):
    """Text of all customers' entries, a file for each part of the table, read back entry by entry."""
    path = scratch(s, name)
    table(s, d, "customer").select(text.alias("value")).write.option("lineSep", sep).text(path)
    return s.read.option("lineSep", sep).text(path)


def _key(c="c_custkey"):
    return F.col(c).cast("string")


def _parent():
    return F.floor(F.col("c_custkey") / 3).cast("string")


@query("src_21_22_turtle", "SELECT 'c' || c_custkey AS id, c_name AS label, 'c' || (c_custkey // 3) AS broader FROM customer")
def _(s, d):
    block = F.concat(F.lit(":c"), _key(), F.lit(' a skos:Concept ;\n skos:prefLabel "'), "c_name", F.lit('" ;\n skos:broader :c'), _parent(), F.lit(" ."))
    blocks = _scanned(s, d, "turtle", block, "\n\n")
    part = lambda p: F.regexp_extract("value", p, 1)
    return blocks.select(part(r":(\w+) a skos:Concept").alias("id"), part(r'skos:prefLabel "([^"]*)"').alias("label"), part(r"skos:broader :(\w+)").alias("broader"))


@query("src_20_owl_xml", "SELECT c_name AS class, 'C' || (c_custkey // 3) AS parent FROM customer")
def _(s, d):
    xml = F.concat(F.lit('<Class ID="'), "c_name", F.lit('"><subClassOf resource="C'), _parent(), F.lit('"/></Class>'))
    rows = _scanned(s, d, "owl", xml, "\n").select(F.explode(F.regexp_extract_all("value", F.lit(r"(?s)(<Class .*?</Class>)"), F.lit(1))).alias("c"))
    return rows.select(F.regexp_extract("c", 'ID="([^"]*)"', 1).alias("class"), F.regexp_extract("c", 'resource="([^"]*)"', 1).alias("parent"))


@query("src_19_graph_json", "SELECT c_name AS id, 'C' || (c_custkey // 3) AS parent FROM customer UNION ALL SELECT c_name, c_mktsegment FROM customer WHERE c_custkey % 2 = 0")
def _(s, d):
    parents = F.when(F.col("c_custkey") % 2 == 0, F.array(F.concat(F.lit("C"), _parent()), F.col("c_mktsegment"))).otherwise(F.array(F.concat(F.lit("C"), _parent())))
    graph = F.to_json(F.struct(F.array(F.struct(F.col("c_name").alias("id"), parents.alias("parent"))).alias("g")))
    rows = _scanned(s, d, "graph", graph, "\n").select(F.explode(F.from_json("value", "g array<struct<id string, parent array<string>>>")["g"]).alias("n"))
    return rows.select("n.id", F.explode("n.parent").alias("parent"))


@query("src_23_24_catalog", "SELECT p_brand AS template, count(*) AS slots FROM part GROUP BY 1")
def _(s, d):
    path = scratch(s, "catalog")
    made = table(s, d, "part").groupBy("p_brand", F.floor(F.col("p_partkey") / 1000)).agg(F.collect_list("p_name").alias("slots"))  # a line has a thousand slots at most
    made.select(F.col("p_brand").alias("template"), "slots").write.json(path)
    read = s.read.schema("template string, slots array<string>").json(path)
    return read.groupBy("template").agg(F.sum(F.size("slots")).alias("slots"))


@query("src_25_front_matter", "SELECT doc_id, lang, doc_id + 1 AS link FROM documents")
def _(s, d):
    note = F.concat(F.lit('---\n{"lang": "'), "lang", F.lit('"}\n---\n# T\nsee [['), (F.col("doc_id") + 1).cast("string"), F.lit("]]"))
    path = scratch(s, "notes")
    table(s, d, "documents").select(F.concat(F.col("doc_id").cast("string"), F.lit("\t"), note)).write.option("lineSep", "\x03").text(path)
    stored = s.read.option("lineSep", "\x03").text(path).select(F.split("value", "\t", 2).alias("v"))
    notes = stored.select(F.col("v")[0].cast("long").alias("doc_id"), F.col("v")[1].alias("n"))
    head = F.from_json(F.regexp_extract("n", r"(?s)^---\n(.*?)\n---", 1), "lang string")["lang"]
    links = notes.select("doc_id", head.alias("lang"), F.explode(F.array_distinct(F.regexp_extract_all("n", F.lit(r"\[\[(\d+)\]\]"), F.lit(1)))).alias("link"))
    return links.withColumn("link", F.col("link").cast("long"))


_SUMS = ", ".join(f"sum(('0x' || h[{1 + 15 * i}:{15 + 15 * i}])::BIGINT::HUGEINT)::VARCHAR" for i in range(4))


@query("src_29_state_digest", f"SELECT sha256(count(*) || ':' || concat_ws(':', {_SUMS})) AS state FROM (SELECT sha256(vec_id || ':' || label) AS h FROM embeddings)")
def _(s, d):
    """In no order and in partial sums: rows' hashes are added up, four numbers of 60 bits each."""
    h = F.sha2(F.concat_ws(":", F.col("vec_id").cast("string"), F.col("label").cast("string")).cast("binary"), 256)
    sums = [F.sum(F.conv(F.substring("h", 1 + 15 * i, 15), 16, 10).cast("decimal(19,0)")).cast("string") for i in range(4)]
    state = F.concat_ws(":", F.count("*").cast("string"), *sums)
    return table(s, d, "embeddings").select(h.alias("h")).agg(F.sha2(state.cast("binary"), 256).alias("state"))


@query("src_33_34_rendered_rows", "SELECT n_nationkey, 'CREATE TABLE n_' || n_nationkey || ' (id INT PRIMARY KEY);' || chr(10) || '-- Q: name of ' || n_nationkey || '?' || chr(10) || 'SELECT ''' || n_name || '''' AS doc FROM nation")
def _(s, d):
    k = F.col("n_nationkey").cast("string")
    doc = F.concat_ws("\n", F.concat(F.lit("CREATE TABLE n_"), k, F.lit(" (id INT PRIMARY KEY);")), F.concat(F.lit("-- Q: name of "), k, F.lit("?")), F.concat(F.lit("SELECT '"), "n_name", F.lit("'")))
    return table(s, d, "nation").select("n_nationkey", doc.alias("doc"))


# ---- sinks


@query("snk_07_append", "SELECT c_custkey FROM customer")
def _(s, d):
    path = scratch(s, "log")
    for part in range(2):
        table(s, d, "customer").where(F.col("c_custkey") % 2 == part).select("c_custkey").write.mode("append").parquet(path)
    return s.read.parquet(path)


@query("snk_08_inserts", "SELECT 'INSERT INTO region VALUES (' || r_regionkey || ', ''' || r_name || ''')' AS stmt FROM region")
def _(s, d):
    return table(s, d, "region").select(F.concat(F.lit("INSERT INTO region VALUES ("), F.col("r_regionkey").cast("string"), F.lit(", '"), F.replace("r_name", F.lit("'"), F.lit("''")), F.lit("')")).alias("stmt"))


@query("snk_11_snapshot", "SELECT '2024Q1/' || r_regionkey AS id, r_name FROM region")
def _(s, d):
    path = scratch(s, "archive")
    table(s, d, "region").select(F.concat(F.lit("2024Q1/"), F.col("r_regionkey").cast("string")).alias("id"), "r_name").write.parquet(f"{path}/key=2024Q1")
    return s.read.parquet(path).select("id", "r_name")


@query("snk_16_bundles", "SELECT lang, count(*) AS docs FROM documents GROUP BY 1")
def _(s, d):
    path = scratch(s, "bundles")
    table(s, d, "documents").select("doc_id", "lang").write.partitionBy("lang").parquet(path)
    return s.read.parquet(path).groupBy("lang").agg(F.count("*").alias("docs"))


# ---- filters, joins and aggregates


@query("fil_10_eligible", "SELECT p_partkey FROM part WHERE p_type <> 'PROMO' AND length(p_name) > 0 AND p_size > 5")
def _(s, d):
    return table(s, d, "part").where("p_type <> 'PROMO' AND length(p_name) > 0 AND p_size > 5").select("p_partkey")


_EDGES = "SELECT c_custkey AS c, c_custkey // 3 AS p FROM customer WHERE c_custkey > 0"


@query("joi_19_chain_credit", f"WITH RECURSIVE e(c, p) AS ({_EDGES}), w(a, n, k) AS (SELECT x, x, 0 FROM (SELECT c AS x FROM e UNION SELECT p FROM e) UNION SELECT a, c, k + 1 FROM w JOIN e ON n = p), q AS (SELECT p_partkey, p_partkey % 40 AS truth, p_size AS guess FROM part) SELECT p_partkey, round(coalesce(max(1 / (1 + k)), 0), 6) AS credit FROM q LEFT JOIN (SELECT a, n, k FROM w UNION SELECT n, a, k FROM w) ON a = truth AND n = guess GROUP BY 1")
def _(s, d):
    edges = table(s, d, "customer").where("c_custkey > 0").select(F.col("c_custkey").alias("child"), F.floor(F.col("c_custkey") / 3).cast("long").alias("parent"))
    q = table(s, d, "part").select("p_partkey", (F.col("p_partkey") % 40).alias("truth"), F.col("p_size").cast("long").alias("guess"))
    asked = q.select("truth", "guess").distinct()  # only these climb
    paths = G.ancestors(edges, asked.select(F.col("truth").alias("node")).union(asked.select("guess")))
    both = paths.select(F.col("ancestor").alias("truth"), F.col("node").alias("guess"), "distance").union(paths.select("node", "ancestor", "distance")).distinct().join(asked, ["truth", "guess"], "left_semi")
    return q.join(both, ["truth", "guess"], "left").groupBy("p_partkey").agg(F.round(F.coalesce(F.max(1 / (1 + F.col("distance"))), F.lit(0.0)), 6).alias("credit"))


@query("agg_10_12_13_registers", "SELECT p_brand, round(count(*) FILTER (p_size > 25) / count(*), 6) AS wide, round(avg(length(p_name)), 6) AS mean_name, count(DISTINCT p_type) AS types FROM part GROUP BY 1")
def _(s, d):
    n = F.count("*")
    return table(s, d, "part").groupBy("p_brand").agg(F.round(F.count_if(F.col("p_size") > 25) / n, 6).alias("wide"), F.round(F.avg(F.length("p_name")), 6).alias("mean_name"), F.count_distinct("p_type").alias("types"))


@query("agg_16_strong_roots", "SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_totalprice > 250000 GROUP BY 1")
def _(s, d):
    return table(s, d, "orders").where("o_totalprice > 250000").groupBy("o_orderpriority").agg(F.count("*").alias("n"))


@query("agg_22_share_trend", "WITH m AS (SELECT year(o_orderdate)::INT AS y, count(*) FILTER (o_orderstatus = 'F') / count(*) AS r FROM orders GROUP BY 1) SELECT y, round(r, 6) AS share, round(r - lag(r) OVER (ORDER BY y), 6) AS velocity, round(r + 3 * (r - lag(r) OVER (ORDER BY y)), 6) AS projected FROM m")
def _(s, d):
    m = table(s, d, "orders").groupBy(F.year("o_orderdate").alias("y")).agg((F.count_if(F.col("o_orderstatus") == "F") / F.count("*")).alias("r"))
    v = F.col("r") - F.lag("r").over(Window.orderBy("y"))  # a row a year
    return m.select("y", F.round("r", 6).alias("share"), F.round(v, 6).alias("velocity"), F.round(F.col("r") + 3 * v, 6).alias("projected"))


@query("agg_24_25_answer_metrics", "SELECT count(*) AS n, count(r_name) AS coded, round(count(r_name) / count(*), 6) AS grounded FROM nation LEFT JOIN (SELECT * FROM region WHERE r_regionkey < 3) ON n_regionkey = r_regionkey")
def _(s, d):
    met = table(s, d, "nation").join(table(s, d, "region").where("r_regionkey < 3"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return met.agg(F.count("*").alias("n"), F.count("r_name").alias("coded"), F.round(F.count("r_name") / F.count("*"), 6).alias("grounded"))


@query("agg_26_skeleton_shares", "WITH c AS (SELECT regexp_replace(p_name, '[a-z]+', 'w', 'g') AS k, count(*) AS n FROM part GROUP BY 1) SELECT count(*) AS skeletons, round(max(n) / sum(n), 6) AS top FROM c")
def _(s, d):
    c = table(s, d, "part").groupBy(F.regexp_replace("p_name", "[a-z]+", "w").alias("k")).agg(F.count("*").alias("n"))
    return c.agg(F.count("*").alias("skeletons"), F.round(F.max("n") / F.sum("n"), 6).alias("top"))


@query("agg_32_giant_component", "WITH c AS (SELECT o_custkey, count(*) + sum(lines) + 1 AS n FROM (SELECT o_custkey, (SELECT count(DISTINCT l_linenumber) FROM lineitem WHERE l_orderkey = o_orderkey) AS lines FROM orders) GROUP BY 1) SELECT count(*) AS components, round(max(n) / sum(n), 6) AS giant FROM c")
def _(s, d):
    from marlstone.plans.graphs import forest

    sizes = G.connected(forest(s, d), "a", "b").groupBy("component").agg(F.count("*").alias("n"))
    return sizes.agg(F.count("*").alias("components"), F.round(F.max("n") / F.sum("n"), 6).alias("giant"))


@query("agg_37_run_metrics", "SELECT event_type, count(*) AS n, round(quantile_cont(value, 0.5), 4) AS p50, round(avg((value < 20)::INT), 6) AS low FROM events WHERE event_type <> 'error' GROUP BY 1")
def _(s, d):
    return table(s, d, "events").where("event_type <> 'error'").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.percentile("value", 0.5), 4).alias("p50"), F.round(F.avg((F.col("value") < 20).cast("int")), 6).alias("low"))


@query("win_03_04_lineage_margin", "WITH r AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS r FROM customer), f AS (SELECT c_nationkey, c_mktsegment AS seg, c_acctbal AS s0 FROM r WHERE r = 1), o AS (SELECT r.c_nationkey, max(c_acctbal) AS s1 FROM r JOIN f USING (c_nationkey) WHERE r.r > 1 AND c_mktsegment <> seg GROUP BY 1) SELECT c_nationkey, round(coalesce(s0 - s1, s0), 4) AS margin FROM f LEFT JOIN o USING (c_nationkey)")
def _(s, d):
    c = table(s, d, "customer")
    top = c.groupBy("c_nationkey").agg(F.min_by(F.struct(F.col("c_mktsegment").alias("seg"), F.col("c_acctbal").alias("s0")), F.struct(-F.col("c_acctbal"), "c_custkey")).alias("f"))
    rivals = c.join(top, "c_nationkey").where("c_mktsegment <> f.seg").groupBy("c_nationkey").agg(F.max("c_acctbal").alias("s1"))
    return top.join(rivals, "c_nationkey", "left").select("c_nationkey", F.round(F.coalesce(F.col("f.s0") - F.col("s1"), F.col("f.s0")), 4).alias("margin"))


# ---- samples and sets


@query("srt_01_top_edges", "SELECT a, b, n FROM (SELECT least(c.c_nationkey, s_nationkey) AS a, greatest(c.c_nationkey, s_nationkey) AS b, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer c ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE c.c_nationkey <> s_nationkey GROUP BY 1, 2) ORDER BY n DESC, a, b LIMIT 50")
def _(s, d):
    met = table(s, d, "lineitem").join(table(s, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(s, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    pairs = met.where("c_nationkey <> s_nationkey").groupBy(F.least("c_nationkey", "s_nationkey").alias("a"), F.greatest("c_nationkey", "s_nationkey").alias("b")).agg(F.count("*").alias("n"))
    return pairs.orderBy(F.desc("n"), "a", "b").limit(50)


@query("srt_09_topic_terms", r"WITH t AS (SELECT lang, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS term FROM documents), c AS (SELECT lang, term, count(*) AS n FROM t GROUP BY 1, 2), k AS (SELECT term FROM c GROUP BY 1 HAVING count(*) = 1) SELECT lang, term FROM (SELECT lang, term, row_number() OVER (PARTITION BY lang ORDER BY n DESC, term) AS r FROM c WHERE term IN (SELECT term FROM k)) WHERE r <= 25")
def _(s, d):
    c = table(s, d, "documents").select("lang", F.explode(words(F.lower("text"))).alias("term")).groupBy("lang", "term").agg(F.count("*").alias("n"))
    own = c.groupBy("term").agg(F.count("*").alias("k"), F.first("lang").alias("lang"), F.first("n").alias("n")).where("k = 1")
    r = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "term"))
    return own.withColumn("r", r).where("r <= 25").select("lang", "term")


@query("srt_11_width_bins", "SELECT p_brand, i // 6 AS bin, count(*) AS width FROM (SELECT p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey) - 1 AS i FROM part) GROUP BY 1, 2")
def _(s, d):
    i = F.row_number().over(Window.partitionBy("p_brand").orderBy("p_size", "p_partkey")) - 1
    return table(s, d, "part").select("p_brand", F.floor(i / 6).cast("long").alias("bin")).groupBy("p_brand", "bin").agg(F.count("*").alias("width"))


@query("srt_12_due_queue", "SELECT event_id FROM events WHERE event_type = 'signup' ORDER BY ts, event_id LIMIT 10")
def _(s, d):
    return table(s, d, "events").where("event_type = 'signup'").orderBy("ts", "event_id").limit(10).select("event_id")


@query("srt_13_weighted_draw", "SELECT source FROM (SELECT source, count(*) AS n FROM documents GROUP BY 1) ORDER BY pow((('0x' || sha256('w:' || source)[1:12])::BIGINT + 1) / 281474976710657.0, 1 + n / 50.0) DESC, source LIMIT 5")
def _(s, d):
    n = table(s, d, "documents").groupBy("source").agg(F.count("*").alias("n"))
    u = (H.draw(F.col("source"), "w") + 1) / 281474976710657.0
    return n.orderBy(F.desc(F.pow(u, 1 + F.col("n") / 50.0)), "source").limit(5).select("source")


@query("set_05_near_copies", "SELECT count(*) AS n FROM (SELECT a.vec_id FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0 AND list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.5 GROUP BY 1)")
def _(s, d):
    e = table(s, d, "embeddings")
    return S.nearest(e.where("vec_id % 20 = 0"), e, "vec_id", "embedding", 1).where("score >= 0.5").agg(F.count("*").alias("n"))


@query("set_06_merged_entities", "SELECT p_name, min_by(p_type, p_partkey) AS genus, max(p_size) AS widest, count(DISTINCT p_brand) > 1 AS varied FROM part GROUP BY 1")
def _(s, d):
    return table(s, d, "part").groupBy("p_name").agg(F.min_by("p_type", "p_partkey").alias("genus"), F.max("p_size").alias("widest"), (F.count_distinct("p_brand") > 1).alias("varied"))


@query("set_09_containment", "SELECT doc_id, round(len(list_intersect(list_distinct(regexp_extract_all(lower(text), '[a-z]+')), ['the', 'of', 'and', 'to'])) / 4, 6) AS recall FROM documents")
def _(s, d):
    names = F.array(*map(F.lit, ("the", "of", "and", "to")))
    found = F.array_intersect(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), F.lit(1)), names)
    return table(s, d, "documents").select("doc_id", F.round(F.size(found) / 4, 6).alias("recall"))


# ---- texts


@query("str_12_13_markdown_table", "SELECT n_nationkey, n_name FROM nation")
def _(s, d):
    rows = F.sort_array(F.collect_list(F.struct("n_nationkey", F.concat(F.lit("| "), F.col("n_nationkey").cast("string"), F.lit(" | "), "n_name", F.lit(" |")).alias("line"))))
    note = table(s, d, "nation").agg(F.concat(F.lit("| key | name |\n|---|---|\n"), F.array_join(F.transform(rows, lambda r: r["line"]), "\n")).alias("t"))
    lines = note.select(F.posexplode(F.split("t", "\n")).alias("i", "line")).where((F.col("i") > 1) & F.col("line").startswith("|"))
    cells = F.transform(F.split(F.regexp_replace("line", r"^\||\|$", ""), r"\|"), lambda c: F.trim(c))
    return lines.select(F.get(cells, F.lit(0)).cast("int").alias("n_nationkey"), F.get(cells, F.lit(1)).alias("n_name"))


@query("str_33_wiki_links", "SELECT doc_id, CASE WHEN doc_id + 3 IN (SELECT doc_id FROM documents) THEN (doc_id + 3) || '__note.md' ELSE 'label' END AS target FROM documents")
def _(s, d):
    docs = table(s, d, "documents").select("doc_id")
    there = docs.select((F.col("doc_id") - 3).alias("doc_id"), F.lit(True).alias("hit"))
    return docs.join(there, "doc_id", "left").select("doc_id", F.when(F.col("hit"), F.concat((F.col("doc_id") + 3).cast("string"), F.lit("__note.md"))).otherwise("label").alias("target"))


# ---- evaluation


@query("sta_25_linear_probe")
def _(s, d):
    """Whether a vector's label is odd, from the vector; a fifth is held out, five permutations of the labels are the control."""
    from marlstone.operators.probe import probe

    rows = table(s, d, "embeddings").withColumn("odd", F.col("label") % 2)
    found = probe(rows, "vec_id", "embedding", "odd", F.col("vec_id") % 5 == 0, [1, 2, 3, 4, 5], 64)
    rounded = [F.round(c, 4).alias(c) for c in ("accuracy", "control_accuracy", "selectivity", "least_selectivity", "average_precision")]
    return found.select(*rounded, "n_train", "n_test")


@query("sta_32_class_distance", "WITH p AS (SELECT a.label = b.label AS same, 1 - list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS x FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id) SELECT round(avg(x) FILTER (same), 5) AS within, round(avg(x) FILTER (NOT same), 5) AS between FROM p")
def _(s, d):
    # sums of unit vectors give all pair sums without pairs
    e = table(s, d, "embeddings").select("label", S.normalised(F.col("embedding")).alias("u"))
    by = S.centroids(e, "label", "u").join(e.groupBy("label").agg(F.count("*").alias("n")), "label")
    every = S.centroids(e.withColumn("all", F.lit(1)), "all", "u").select(F.col("centroid").alias("c"))
    inner = by.select(F.col("n"), (S.dot(F.col("centroid"), F.col("centroid")) * F.col("n") * F.col("n")).alias("q"))
    sums = inner.agg(F.sum("n").alias("n"), F.sum((F.col("q") - F.col("n")) / 2).alias("w"), F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("k"))
    met = sums.crossJoin(every).withColumn("t", (S.dot(F.col("c"), F.col("c")) * F.col("n") * F.col("n") - F.col("n")) / 2)  # one row each
    pairs = F.col("n") * (F.col("n") - 1) / 2
    return met.select(F.round(1 - F.col("w") / F.col("k"), 5).alias("within"), F.round(1 - (F.col("t") - F.col("w")) / (pairs - F.col("k")), 5).alias("between"))


@query("doc_08_09_rescored", "SELECT c_custkey, c_acctbal >= 5000 AS assigned FROM customer WHERE c_nationkey IN (1, 2, 3)")
def _(s, d):
    return table(s, d, "customer").where(F.col("c_nationkey").isin(1, 2, 3)).select("c_custkey", (F.col("c_acctbal") >= 5000).alias("assigned"))


@query("doc_21_on_off", "SELECT round(avg(a.n_chars - b.n_chars), 4) AS delta FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1")
def _(s, d):
    docs = table(s, d, "documents").select("doc_id", "n_chars")
    other = docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("n_chars").alias("m"))
    return docs.join(other, "doc_id").agg(F.round(F.avg(F.col("n_chars") - F.col("m")), 4).alias("delta"))


@query("doc_22_transit", "SELECT source, least(min(n_chars), count(*)) AS transit, max(n_chars) - min(n_chars) AS lost FROM documents GROUP BY 1")
def _(s, d):
    return table(s, d, "documents").groupBy("source").agg(F.least(F.min("n_chars"), F.count("*")).alias("transit"), (F.max("n_chars") - F.min("n_chars")).alias("lost"))


# ---- schemas and hierarchies


@query("sch_03_04_categories", "SELECT p_partkey, a, b, a IN ('int', 'long') AND b IN ('int', 'long', 'integer') OR a = 'decimal' AND b = 'decimal' OR a = 'float' AND b IN ('float', 'double') OR a = 'date' AND b IN ('date', 'dateTime') OR a = 'text' AND b = 'text' AS same FROM (SELECT p_partkey, ['int', 'decimal', 'float', 'date', 'text', 'long'][p_partkey % 6 + 1] AS a, ['integer', 'double', 'decimal', 'dateTime', 'text'][p_size % 5 + 1] AS b FROM part)")
def _(s, d):
    kind = lambda c: F.when(F.col(c).isin("int", "integer", "long"), "whole").when(F.col(c).isin("decimal"), "exact").when(F.col(c).isin("float", "double"), "real").when(F.col(c).isin("date", "dateTime"), "time").otherwise("text")
    pick = lambda at, *names: F.get(F.array(*map(F.lit, names)), at.cast("int"))
    pairs = table(s, d, "part").select("p_partkey", pick(F.col("p_partkey") % 6, "int", "decimal", "float", "date", "text", "long").alias("a"), pick(F.col("p_size") % 5, "integer", "double", "decimal", "dateTime", "text").alias("b"))
    return pairs.select("p_partkey", "a", "b", (kind("a") == kind("b")).alias("same"))


@query("sch_06_fidelity", "SELECT round(avg((l_shipdate >= o_orderdate)::INT), 6) AS score FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def _(s, d):
    met = table(s, d, "lineitem").join(table(s, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return met.agg(F.round(F.avg((F.col("l_shipdate") >= F.col("o_orderdate")).cast("int")), 6).alias("score"))


@query("sch_08_restrictions", "SELECT p_partkey, 'has' || p_type AS property, 'some' AS quantifier, string_split(p_name, ' ')[1] AS filler FROM part UNION ALL SELECT p_partkey, 'of' || p_size, 'only', string_split(p_name, ' ')[-1] FROM part WHERE p_partkey % 3 > 0")
def _(s, d):
    pieces = F.split("p_name", " ")
    one = F.concat(F.lit("has"), "p_type", F.lit(" some "), F.element_at(pieces, 1))
    other = F.when(F.col("p_partkey") % 3 > 0, F.concat(F.lit("of"), F.col("p_size").cast("string"), F.lit(" only "), F.element_at(pieces, -1)))
    p = F.lit(r"(\w+) (some|only) (\w+)")
    found = F.arrays_zip(*(F.regexp_extract_all("t", p, F.lit(i)).alias(n) for i, n in enumerate(("property", "quantifier", "filler"), 1)))
    return table(s, d, "part").select("p_partkey", F.concat_ws(" and ", one, other).alias("t")).select("p_partkey", F.inline(found))


@query("sch_22_26_generators", "SELECT c_custkey AS id, CASE WHEN u < 0.5227 THEN 'bare_id' WHEN u < 0.7254 THEN 'natural' ELSE 'table_id' END AS shape FROM (SELECT c_custkey, ('0x' || sha256('k:' || c_custkey)[1:12])::BIGINT / 281474976710656.0 AS u FROM customer)")
def _(s, d):
    u = H.unit(F.col("c_custkey"), "k")
    return table(s, d, "customer").select(F.col("c_custkey").alias("id"), F.when(u < 0.5227, "bare_id").when(u < 0.7254, "natural").otherwise("table_id").alias("shape"))


@query("sch_28_views", "SELECT s_name, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def _(s, d):
    return s.sql("SELECT s_name, n_name FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey", supplier=table(s, d, "supplier"), nation=table(s, d, "nation"))


# ---- read models, trails and functions of the caller


@query("stm_09_trail", "SELECT user_id, array_to_string(list_reduce(c, lambda t, x: CASE WHEN list_contains(t, x[1]) THEN t[:list_position(t, x[1])] ELSE list_append(t[-2:], x[1]) END), '>') AS trail FROM (SELECT user_id, list([event_type] ORDER BY event_id) AS c FROM events GROUP BY 1)")
def _(s, d):
    clicks = table(s, d, "events").select("user_id", "event_id", F.col("event_type").alias("panel"))
    return trails(clicks, "user_id", "event_id", "panel", most=3).select("user_id", F.array_join("trail", ">").alias("trail"))


@query("stm_10_peer_walk", "WITH RECURSIVE e AS (SELECT c_custkey AS a, c_custkey // 3 AS b FROM customer WHERE c_custkey > 0 UNION SELECT c_custkey // 3, c_custkey FROM customer WHERE c_custkey > 0), w(node, distance) AS (SELECT 5::BIGINT, 0 UNION SELECT b, distance + 1 FROM w JOIN e ON node = a WHERE distance < 3) SELECT node, min(distance)::INT AS distance FROM w GROUP BY 1")
def _(s, d):
    links = table(s, d, "customer").where("c_custkey > 0").select(F.col("c_custkey").alias("a"), F.floor(F.col("c_custkey") / 3).cast("long").alias("b"))
    return G.expand(links, s.createDataFrame([(5,)], "node long"), 3)


@query("api_04_10_latest", "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (ORDER BY event_id DESC) AS r FROM events) WHERE r = 1")
def _(s, d):
    return table(s, d, "events").orderBy(F.desc("event_id")).limit(1).select("user_id", "event_id")


@query("api_12_13_type_list", "SELECT label, count(*) AS n FROM embeddings GROUP BY 1 ORDER BY 1")
def _(s, d):
    return table(s, d, "embeddings").groupBy("label").agg(F.count("*").alias("n")).orderBy("label")


@query("orc_12_two_arms", "SELECT lang, round(avg(n_chars) FILTER (doc_id % 2 = 0) - avg(n_chars) FILTER (doc_id % 2 = 1), 4) AS delta FROM documents GROUP BY 1")
def _(s, d):
    arm = lambda k: F.avg(F.when(F.col("doc_id") % 2 == k, F.col("n_chars")))
    return table(s, d, "documents").groupBy("lang").agg(F.round(arm(0) - arm(1), 4).alias("delta"))


@query("udf_01_06_injected", "SELECT p_partkey, p_size * 2.0::DOUBLE AS scored FROM part")
def _(s, d):
    def scorer(batches):  # a caller's function, with its model made once a task
        factor = 2.0
        for x in batches:
            yield x * factor

    from collections.abc import Iterator

    scorer.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    scored = F.pandas_udf(scorer, "double")
    return table(s, d, "part").select("p_partkey", scored(F.col("p_size").cast("double")).alias("scored"))


@query("src_22_overlay", "SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN 'later' ELSE n_name END AS n_name FROM nation")
def _(s, d):
    base = table(s, d, "nation").select("n_nationkey", "n_name", F.lit(0).alias("file"))
    later = base.where("n_nationkey % 2 = 0").select("n_nationkey", F.lit("later").alias("n_name"), F.lit(1).alias("file"))
    return io.newest(base.union(later), "n_nationkey", "file").select("n_nationkey", "n_name")
