"""Queries of vectors, graphs and hierarchies."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from marlstone.functions.text import words
from marlstone.operators import graph as G
from marlstone.operators import similarity as S
from marlstone.plans.catalog import query
from marlstone.storage import table

_DOT = "list_sum([x * y FOR (x, y) IN list_zip({a}, {b})])"


def _cos(a: str, b: str) -> str:
    return f"list_cosine_similarity({a}::DOUBLE[], {b}::DOUBLE[])"


@query("sim_01_cosine", f"SELECT a.vec_id, round({_cos('a.embedding', 'b.embedding')}, 6) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = 0")
def _(s, d):
    e = table(s, d, "embeddings")
    one = e.where("vec_id = 0").select(F.col("embedding").alias("probe"))
    return e.crossJoin(F.broadcast(one)).select("vec_id", F.round(S.cosine(F.col("embedding"), F.col("probe")), 6).alias("cosine"))  # one probe


@query("sim_11_22_nearest", f"SELECT query, neighbour, rank FROM (SELECT a.vec_id AS query, b.vec_id AS neighbour, row_number() OVER (PARTITION BY a.vec_id ORDER BY round({_cos('a.embedding', 'b.embedding')}, 9) DESC, b.vec_id) AS rank FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0) WHERE rank <= 5")
def _(s, d):
    e = table(s, d, "embeddings")
    return S.nearest(e.where("vec_id % 20 = 0"), e, "vec_id", "embedding", 5).select("query", "neighbour", F.col("rank").cast("long").alias("rank"))


@query("sim_02_mmr")
def _(s, d):
    e = table(s, d, "embeddings").withColumn("relevance", F.get("embedding", F.lit(0)).cast("double"))
    return S.mmr(e, "label", "vec_id", "embedding", "relevance", 5)


@query("sim_05_06_max_sim", f"WITH t AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), m AS (SELECT q.label AS q, q.vec_id AS qt, x.label AS d, max(list_dot_product(q.v, x.v)) AS m FROM t q, t x WHERE q.vec_id % 20 = 0 GROUP BY ALL) SELECT q, d, round(avg(m), 6) AS score FROM m GROUP BY ALL")
def _(s, d):
    e = table(s, d, "embeddings")
    q = e.where("vec_id % 20 = 0").select(F.col("label").alias("q"), F.col("vec_id").alias("tok"), F.col("embedding").alias("v"))
    return S.max_sim(q, e.select(F.col("label").alias("d"), F.col("embedding").alias("v"))).withColumn("score", F.round("score", 6))


@query("sim_08_shuffled_null", f"WITH e AS (SELECT vec_id, embedding, row_number() OVER (ORDER BY vec_id) - 1 AS i, count(*) OVER () AS n FROM embeddings), p AS (SELECT k, i, n, row_number() OVER (PARTITION BY k ORDER BY sha256(k || ':' || vec_id)) - 1 AS j FROM e, range(25) t(k)), q AS (SELECT k, i, CASE WHEN i = j THEN (j + 1) % n ELSE j END AS j FROM p) SELECT q.k::INT AS permutation, round(avg({_cos('a.embedding', 'b.embedding')}), 6) AS mean FROM q JOIN e a USING (i) JOIN e b ON b.i = q.j GROUP BY 1")
def _(s, d):
    return S.shuffled_null(table(s, d, "embeddings"), "vec_id", "embedding", 25).select("permutation", F.round("mean", 6).alias("mean"))


_TFIDF = r"""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS term FROM documents), tf AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1 HAVING count(*) >= 2), n AS (SELECT count(*) AS n FROM documents), r AS (SELECT doc_id, term, tf * (ln((1 + n) / (1 + df)) + 1) AS w FROM tf JOIN df USING (term), n)"""


@query("sim_11_tf_idf", _TFIDF + " SELECT doc_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS weight FROM r")
def _(s, d):
    docs = table(s, d, "documents").select("doc_id", words(F.lower("text")).alias("t"))
    return S.tf_idf(docs, "doc_id", "t").select("doc_id", "term", F.round("weight", 6).alias("weight"))


@query("sim_12_13_feature_cosine", "WITH f AS (SELECT DISTINCT o_custkey % 12 AS g, o_orderpriority || o_orderstatus || (o_orderkey % 7) AS t FROM orders ), n AS (SELECT g, count(*) AS n FROM f GROUP BY 1) SELECT a.g AS a, b.g AS b, round(count(*) / sqrt(max(na.n) * max(nb.n)), 6) AS cosine FROM f a JOIN f b ON a.t = b.t AND a.g < b.g JOIN n na ON na.g = a.g JOIN n nb ON nb.g = b.g GROUP BY 1, 2")
def _(s, d):
    f = table(s, d, "orders").select((F.col("o_custkey") % 12).alias("g"), F.concat("o_orderpriority", "o_orderstatus", (F.col("o_orderkey") % 7).cast("string")).alias("t")).distinct()
    n = f.groupBy("g").agg(F.count("*").alias("n"))
    k = f.select(F.col("g").alias("a"), "t").join(f.select(F.col("g").alias("b"), "t"), "t").where("a < b").groupBy("a", "b").agg(F.count("*").alias("k"))
    met = k.join(n.select(F.col("g").alias("a"), F.col("n").alias("na")), "a").join(n.select(F.col("g").alias("b"), F.col("n").alias("nb")), "b")
    return met.select("a", "b", F.round(F.col("k") / F.sqrt(F.col("na") * F.col("nb")), 6).alias("cosine"))


@query("sim_10_17_centroid_recovery", f"WITH c AS (SELECT label, list(m ORDER BY i) AS c FROM (SELECT label, i, avg(x::DOUBLE) AS m FROM (SELECT label, unnest(embedding) AS x, unnest(range(len(embedding))) AS i FROM embeddings) GROUP BY 1, 2) GROUP BY 1), r AS (SELECT e.label, c.label = e.label AS own, row_number() OVER (PARTITION BY vec_id ORDER BY round({_cos('embedding', 'c')}, 9) DESC, c.label) - 1 AS rank FROM embeddings e, c) SELECT label, round(avg((rank = 0)::INT), 6) AS hit1, round(avg((rank < 5)::INT), 6) AS hit5 FROM r WHERE own GROUP BY 1")
def _(s, d):
    e = table(s, d, "embeddings")
    centres = S.centroids(e, "label", "embedding").withColumnRenamed("label", "guess")
    ranked = S.assign(e, "vec_id", "embedding", centres, "guess").join(e.select("vec_id", "label"), "vec_id").where("guess = label")
    return ranked.groupBy("label").agg(F.round(F.avg((F.col("rank") == 0).cast("int")), 6).alias("hit1"), F.round(F.avg((F.col("rank") < 5).cast("int")), 6).alias("hit5"))


@query("sim_14_20_kmeans")
def _(s, d):
    _, members = S.lloyd(table(s, d, "embeddings"), "vec_id", "embedding", 10, 5)
    return members.select("vec_id", "cluster")


@query("sim_21_insufficiency", f"WITH c AS (SELECT label, list(m ORDER BY i) AS c FROM (SELECT label, i, avg(x::DOUBLE) AS m FROM (SELECT label, unnest(embedding) AS x, unnest(range(len(embedding))) AS i FROM embeddings) GROUP BY 1, 2) GROUP BY 1) SELECT a.label, round(max({_cos('a.c', 'b.c')}), 6) AS nearest, max({_cos('a.c', 'b.c')}) > 0.92 AS close FROM c a JOIN c b ON a.label <> b.label GROUP BY 1")
def _(s, d):
    c = S.centroids(table(s, d, "embeddings"), "label", "embedding")
    near = c.crossJoin(F.broadcast(c.select(F.col("label").alias("other"), F.col("centroid").alias("oc")))).where("label <> other")  # labels, not rows
    best = F.max(S.cosine(F.col("centroid"), F.col("oc")))
    return near.groupBy("label").agg(F.round(best, 6).alias("nearest"), (best > 0.92).alias("close"))


@query("sim_22_23_markov")
def _(s, d):
    parts = table(s, d, "nation").select("n_regionkey", "n_nationkey")
    edges = parts.join(parts.select("n_regionkey", F.col("n_nationkey").alias("j")), "n_regionkey").where("n_nationkey < j").select(F.col("n_nationkey").alias("i"), "j", F.lit(1.0).alias("v"))
    return G.markov_clusters(edges)


@query("sim_25_26_self_retrieval", f"WITH n AS (SELECT a.vec_id, a.label, b.label AS other, row_number() OVER (PARTITION BY a.vec_id ORDER BY round({_cos('a.embedding', 'b.embedding')}, 9) DESC, b.vec_id) AS r FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0) SELECT round(avg((label = other)::INT), 6) AS rank1 FROM n WHERE r = 1")
def _(s, d):
    e = table(s, d, "embeddings")
    top = S.nearest(e.where("vec_id % 20 = 0"), e, "vec_id", "embedding", 1)
    met = top.join(e.select(F.col("vec_id").alias("query"), "label"), "query").join(e.select(F.col("vec_id").alias("neighbour"), F.col("label").alias("other")), "neighbour")
    return met.agg(F.round(F.avg((F.col("label") == F.col("other")).cast("int")), 6).alias("rank1"))


@query("sim_29_30_label_search", "SELECT DISTINCT p_name, round(len(list_intersect(string_split(p_name, ' '), ['red', 'ring'])) / len(list_distinct(list_concat(string_split(p_name, ' '), ['red', 'ring']))), 6) AS score FROM part WHERE len(list_intersect(string_split(p_name, ' '), ['red', 'ring'])) > 0 ORDER BY score DESC, p_name LIMIT 8")
def _(s, d):
    sought, t = F.array(F.lit("red"), F.lit("ring")), F.split("p_name", " ")
    score = F.size(F.array_intersect(t, sought)) / F.size(F.array_union(t, sought))
    return table(s, d, "part").select("p_name").distinct().withColumn("score", F.round(score, 6)).where("score > 0").orderBy(F.desc("score"), "p_name").limit(8)


@query("sta_30_silhouette", f"WITH p AS (SELECT a.vec_id, a.label, b.label AS other, avg(1 - {_cos('a.embedding', 'b.embedding')}) AS x FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id GROUP BY 1, 2, 3), s AS (SELECT vec_id, label, max(x) FILTER (label = other) AS a, min(x) FILTER (label <> other) AS b FROM p GROUP BY 1, 2) SELECT label, round(avg((b - a) / greatest(a, b)), 5) AS silhouette FROM s GROUP BY 1")
def _(s, d):
    return S.silhouette(table(s, d, "embeddings"), "vec_id", "label", "embedding").withColumn("silhouette", F.round("silhouette", 5))


@query("sta_33_participation")
def _(s, d):
    return s.createDataFrame([(round(S.participation_ratio(table(s, d, "embeddings"), "embedding", 64), 6),)], "ratio double")


# ---- graphs


def supply(s, d):
    return table(s, d, "lineitem").select(F.col("l_orderkey").alias("a"), (F.col("l_suppkey") + 1_000_000).alias("b"))


_SUPPLY = "(SELECT l_orderkey AS a, l_suppkey + 1000000 AS b FROM lineitem)"


@query("grf_01_02_upsert", "SELECT n_nationkey, CASE WHEN n_nationkey < 3 THEN 'new' ELSE n_name END AS n_name FROM nation")
def _(s, d):
    old = table(s, d, "nation").select("n_nationkey", "n_name", F.lit(1).alias("v"))
    new = old.where("n_nationkey < 3").select("n_nationkey", F.lit("new").alias("n_name"), F.lit(2).alias("v"))
    return G.upsert(old, new, "n_nationkey", "v").select("n_nationkey", "n_name")


@query("grf_03_05_run_edges", "SELECT user_id, event_id, CASE WHEN event_type IN ('click', 'view') THEN 'INPUT_TO' ELSE 'OUTPUTS' END AS etype FROM events")
def _(s, d):
    e = table(s, d, "events")
    reads = e.where("event_type IN ('click', 'view')").select("user_id", "event_id", F.lit("INPUT_TO").alias("etype"))
    writes = e.where("event_type NOT IN ('click', 'view')").select("user_id", "event_id", F.lit("OUTPUTS").alias("etype"))
    return reads.union(writes)


@query("grf_06_up_down", "SELECT DISTINCT o_custkey AS up, l_suppkey AS down FROM orders JOIN lineitem ON l_orderkey = o_orderkey")
def _(s, d):
    return table(s, d, "orders").join(table(s, d, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("up"), F.col("l_suppkey").alias("down")).distinct()


@query("grf_07_expansion", f"WITH RECURSIVE e AS (SELECT a, b FROM {_SUPPLY} UNION SELECT b, a FROM {_SUPPLY}), w(node, distance) AS (SELECT 1::BIGINT, 0 UNION SELECT b, distance + 1 FROM w JOIN e ON node = a WHERE distance < 3) SELECT node, min(distance)::INT AS distance FROM w GROUP BY 1")
def _(s, d):
    return G.expand(supply(s, d), s.createDataFrame([(1,)], "node long"), 3)


@query("grf_08_ego", f"SELECT b AS other, 'out' AS direction, count(*) OVER () > 40 AS truncated FROM (SELECT DISTINCT b FROM {_SUPPLY} WHERE a = 1)")
def _(s, d):
    return G.ego(supply(s, d), 1)


@query("grf_09_10_tokens", "SELECT s_suppkey, coalesce(nullif(NULL::VARCHAR, ''), nullif('', ''), s_name) AS shown, lower(s_name) || '|' || array_to_string([x FOR x IN regexp_extract_all(lower(s_name), '[a-z0-9&]+') IF length(x) >= 2], '|') AS tokens FROM supplier")
def _(s, d):
    low = F.lower("s_name")
    pieces = F.filter(F.regexp_extract_all(low, F.lit("([a-z0-9&]+)"), F.lit(1)), lambda x: F.length(x) >= 2)
    return table(s, d, "supplier").select("s_suppkey", F.coalesce(F.nullif(F.lit(None).cast("string"), F.lit("")), F.nullif(F.lit(""), F.lit("")), "s_name").alias("shown"), F.array_join(F.concat(F.array(low), pieces), "|").alias("tokens"))


@query("grf_14_chain_check", "SELECT l_orderkey, l_linenumber AS step, l_suppkey % 4 AS missing FROM lineitem a WHERE NOT EXISTS (SELECT 1 FROM lineitem b WHERE b.l_orderkey = a.l_orderkey AND b.l_partkey % 4 = a.l_suppkey % 4 AND b.l_linenumber < a.l_linenumber)")
def _(s, d):
    """Steps of chains (lines of orders) whose input no earlier step of the chain gives: each output's first step, joined to the inputs."""
    lines = table(s, d, "lineitem")
    given = lines.groupBy("l_orderkey", (F.col("l_partkey") % 4).alias("missing")).agg(F.min("l_linenumber").alias("first"))
    wanted = lines.select("l_orderkey", F.col("l_linenumber").alias("step"), (F.col("l_suppkey") % 4).alias("missing"))
    met = wanted.join(given, ["l_orderkey", "missing"], "left")
    return met.where("first IS NULL OR first >= step").select("l_orderkey", "step", "missing")


#: Orders, their customers and their lines: a forest of stars on stars, so components have a closed form.
_FOREST = "SELECT o_orderkey AS a, 1000000000000 + o_custkey AS b FROM orders UNION ALL SELECT l_orderkey, 2000000000000 + l_orderkey * 8 + l_linenumber FROM lineitem"


def forest(s, d):
    held = table(s, d, "orders").select(F.col("o_orderkey").alias("a"), (F.lit(1_000_000_000_000) + F.col("o_custkey")).alias("b"))
    return held.union(table(s, d, "lineitem").select("l_orderkey", F.lit(2_000_000_000_000) + F.col("l_orderkey") * 8 + F.col("l_linenumber")))


@query("grf_16_components", f"WITH e AS ({_FOREST}), top AS (SELECT o_orderkey AS k, min(o_orderkey) OVER (PARTITION BY o_custkey) AS r FROM orders), n AS (SELECT a, b, coalesce(r, a) AS r FROM e LEFT JOIN top ON k = a) SELECT a AS node, min(r) AS component FROM n GROUP BY 1 UNION ALL SELECT b, min(r) FROM n GROUP BY 1")
def _(s, d):
    return G.connected(forest(s, d), "a", "b")


#: Orders, their parts, and parts on neighbouring lines: triangles, with parts as hubs.
_BASKETS = "SELECT DISTINCT 1000000000000 + l_orderkey AS a, l_partkey AS b FROM lineitem UNION SELECT x.l_partkey, y.l_partkey FROM lineitem x JOIN lineitem y ON x.l_orderkey = y.l_orderkey AND y.l_linenumber = x.l_linenumber + 1 WHERE x.l_partkey <> y.l_partkey"


def baskets(s, d):
    lines = table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    after = lines.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("l_partkey").alias("b"))
    held = lines.select((F.lit(1_000_000_000_000) + F.col("l_orderkey")).alias("a"), F.col("l_partkey").alias("b"))
    return held.union(lines.join(after, ["l_orderkey", "l_linenumber"]).select("l_partkey", "b").where("l_partkey <> b"))


_PRUNED = f"""WITH raw AS ({_BASKETS}), e AS (SELECT a, b FROM raw UNION SELECT b, a FROM raw), keep AS (SELECT a FROM e GROUP BY 1 HAVING count(*) <= 90),
live AS (SELECT * FROM e WHERE a IN (SELECT a FROM keep) AND b IN (SELECT a FROM keep)), n AS (SELECT a, count(*) AS n FROM live GROUP BY 1),
k AS (SELECT x.a, x.b, count(*) AS k FROM live x JOIN live y ON y.a = x.a JOIN live z ON z.a = x.b AND z.b = y.b WHERE x.a < x.b GROUP BY 1, 2),
s AS (SELECT l.a, l.b, coalesce(k.k, 0) AS k, na.n + nb.n - 2 - coalesce(k.k, 0) AS u FROM live l LEFT JOIN k ON k.a = l.a AND k.b = l.b JOIN n na ON na.a = l.a JOIN n nb ON nb.a = l.b WHERE l.a < l.b)
SELECT a, b FROM s WHERE CASE WHEN u > 0 THEN k / u ELSE 0 END >= 0.015"""


@query("grf_17_18_pruned", _PRUNED)
def _(s, d):
    return G.pruned_hubs(baskets(s, d), 90, 0.015)


#: A hierarchy over all customers: each is below the one with a third of its number.
_EDGES = "SELECT c_custkey AS c, c_custkey // 3 AS p FROM customer WHERE c_custkey > 0"


def tree(s, d):
    return table(s, d, "customer").where("c_custkey > 0").select(F.col("c_custkey").alias("child"), F.floor(F.col("c_custkey") / 3).cast("long").alias("parent"))


@query("hie_03_04_closure", f"WITH RECURSIVE e(c, p) AS ({_EDGES}), w(ancestor, node, distance) AS (SELECT x, x, 0 FROM (SELECT c AS x FROM e UNION SELECT p FROM e) UNION SELECT ancestor, c, distance + 1 FROM w JOIN e ON node = p) SELECT ancestor::BIGINT AS ancestor, node::BIGINT AS node, distance FROM w")
def _(s, d):
    return G.reachable(tree(s, d))


@query("hie_05_06_root", f"WITH RECURSIVE e(c, p) AS ({_EDGES}), w(node, top, distance) AS (SELECT c, p, 1 FROM e UNION ALL SELECT node, p, distance + 1 FROM w JOIN e ON top = c) SELECT node::BIGINT AS node, max_by(top, distance)::BIGINT AS root, max(distance) AS depth FROM w GROUP BY 1")
def _(s, d):
    return G.climbed(tree(s, d)).where("distance > 0").select("node", F.col("top").alias("root"), F.col("distance").alias("depth"))


#: Parts point at the part before; every tenth stretch of ten closes in a ring.
_RINGS = "SELECT p_partkey AS c, CASE WHEN p_partkey % 10 = 1 AND p_partkey // 10 % 10 = 0 THEN p_partkey + 9 ELSE p_partkey - 1 END AS p FROM part"


@query("grf_19_21_cycles", f"WITH RECURSIVE e AS ({_RINGS}), w(x, y) AS (SELECT c, p FROM e UNION SELECT x, p FROM w JOIN e ON y = c WHERE y > x - 12 AND y < x + 12) SELECT DISTINCT x AS node FROM w WHERE x = y")
def _(s, d):
    k = F.col("p_partkey")
    ring = (k % 10 == 1) & (F.floor(k / 10) % 10 == 0)
    return G.cycle_nodes(table(s, d, "part").select(k.alias("child"), F.when(ring, k + 9).otherwise(k - 1).alias("parent")))


@query("grf_23_24_backlinks", "SELECT l_partkey, count(DISTINCT l_orderkey) AS backlinks FROM lineitem GROUP BY 1")
def _(s, d):
    return table(s, d, "lineitem").groupBy("l_partkey").agg(F.count_distinct("l_orderkey").alias("backlinks"))


_CODE = "n_regionkey || '.' || (n_nationkey % 3) || '.' || n_nationkey"


@query("hie_01_02_codes", f"SELECT n_nationkey, n_regionkey || ',' || n_regionkey || '.' || (n_nationkey % 3) AS ancestors, starts_with({_CODE}, '1.') AS below_1, string_split({_CODE}, '.')[1] AS top FROM nation")
def _(s, d):
    code = F.concat_ws(".", F.col("n_regionkey").cast("string"), (F.col("n_nationkey") % 3).cast("string"), F.col("n_nationkey").cast("string"))
    parts = F.split(code, r"\.")
    ancestors = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "."))
    return table(s, d, "nation").select("n_nationkey", F.array_join(ancestors, ",").alias("ancestors"), code.startswith("1.").alias("below_1"), F.coalesce(F.split_part(code, F.lit("."), F.lit(1)), F.lit("_unassigned")).alias("top"))


@query("hie_07_inherited", f"WITH RECURSIVE e(c, p) AS ({_EDGES}), w(ancestor, node) AS (SELECT x, x FROM (SELECT c AS x FROM e UNION SELECT p FROM e) UNION SELECT ancestor, c FROM w JOIN e ON node = p) SELECT node::BIGINT AS node, count(*) FILTER (ancestor % 3 = 0) AS properties FROM w GROUP BY 1")
def _(s, d):
    return G.climbed(tree(s, d), (F.col("node") % 3 == 0).cast("long")).select("node", F.col("total").alias("properties"))


@query("hie_08_family_coverage", "SELECT n_regionkey, count(*) AS members, bool_and(n_nationkey IN (SELECT c_nationkey FROM customer)) AS covered, count(*) * (count(*) - 1) // 2 AS pairs FROM nation GROUP BY 1")
def _(s, d):
    hit = table(s, d, "customer").select(F.col("c_nationkey").alias("n_nationkey")).distinct().withColumn("hit", F.lit(True))
    met = table(s, d, "nation").join(hit, "n_nationkey", "left")
    n = F.count("*")
    return met.groupBy("n_regionkey").agg(n.alias("members"), F.every(F.coalesce("hit", F.lit(False))).alias("covered"), F.floor(n * (n - 1) / 2).alias("pairs"))


@query("hie_09_10_signatures", "SELECT sig, count(*) AS n FROM (SELECT p_brand, string_agg(DISTINCT p_type, '|' ORDER BY p_type) AS sig FROM part GROUP BY 1) GROUP BY 1 HAVING count(*) > 1")
def _(s, d):
    sig = table(s, d, "part").groupBy("p_brand").agg(F.array_join(F.sort_array(F.collect_set("p_type")), "|").alias("sig"))
    return sig.groupBy("sig").agg(F.count("*").alias("n")).where("n > 1")


@query("hie_12_13_contract", "SELECT n_nationkey, r_name IS NOT NULL AS has_broader, n_regionkey = 2 AS disjoint FROM nation LEFT JOIN region ON n_regionkey = r_regionkey")
def _(s, d):
    met = table(s, d, "nation").join(table(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return met.select("n_nationkey", F.col("r_name").isNotNull().alias("has_broader"), (F.col("n_regionkey") == 2).alias("disjoint"))
