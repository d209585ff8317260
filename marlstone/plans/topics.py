"""Queries of topics, alignment of vector sets, and passages held against them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from marlstone.functions.text import words
from marlstone.operators import similarity as S
from marlstone.operators import windows as W
from marlstone.plans.catalog import query
from marlstone.storage import scratch, table

_C = "SELECT label, list(m ORDER BY i) AS c FROM (SELECT label, i, avg(x::DOUBLE) AS m FROM (SELECT label, unnest(embedding) AS x, unnest(range(len(embedding))) AS i FROM {t}) GROUP BY 1, 2) GROUP BY 1"


def _cos(a, b):
    return f"list_cosine_similarity({a}::DOUBLE[], {b}::DOUBLE[])"


@query("joi_21_nearest_of_all", f"SELECT a.vec_id, round(max({_cos('a.embedding', 'b.embedding')}), 6) AS nearest FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id GROUP BY 1")
def _(s, d):
    found = S.nearest_of_all(table(s, d, "embeddings"), "vec_id", "embedding")
    return found.select(F.col("id").alias("vec_id"), F.round("score", 6).alias("nearest"))


@query("joi_22_related_pairs", f"SELECT DISTINCT least(q, n) AS a, greatest(q, n) AS b FROM (SELECT a.vec_id AS q, b.vec_id AS n, row_number() OVER (PARTITION BY a.vec_id ORDER BY round({_cos('a.embedding', 'b.embedding')}, 9) DESC, b.vec_id) AS r FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0) WHERE r <= 3")
def _(s, d):
    e = table(s, d, "embeddings")
    return S.nearest(e.where("vec_id % 20 = 0"), e, "vec_id", "embedding", 3).select(F.least("query", "neighbour").alias("a"), F.greatest("query", "neighbour").alias("b")).distinct()


_WINDOWS = r"""WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM documents), p AS (SELECT doc_id, i, unnest(w[i * 180 + 1:i * 180 + 180]) AS t FROM (SELECT *, unnest(range(0, least(12, greatest(1, ceil(len(w) / 180)::INT)))) AS i FROM w)),
v AS (SELECT doc_id, i, length(t) % 4 AS k, count(*) AS n FROM p GROUP BY 1, 2, 3), u AS (SELECT doc_id, i, k, n / sqrt(sum(n * n) OVER (PARTITION BY doc_id, i)) AS x FROM v), m AS (SELECT doc_id, k, sum(x) AS x FROM u GROUP BY 1, 2)
SELECT doc_id, k::INT AS k, round(x / sqrt(sum(x * x) OVER (PARTITION BY doc_id)), 6) AS x FROM m"""


@query("sim_07_09_document_vectors", _WINDOWS)
def _(s, d):
    """Windows of 180 words, twelve at most, each a unit vector; a document is their unit mean. Here a window counts its words by length."""
    w = table(s, d, "documents").select("doc_id", F.posexplode(words(F.lower("text"))).alias("p", "t")).where(F.col("p") < 12 * 180)
    n = w.groupBy("doc_id", F.floor(F.col("p") / 180).alias("i"), (F.length("t") % 4).alias("k")).agg(F.count("*").alias("n"))
    length = lambda c, *by: F.sqrt(F.sum(F.col(c) * F.col(c)).over(Window.partitionBy(*by)))
    unit = n.select("doc_id", "k", (F.col("n") / length("n", "doc_id", "i")).alias("x"))
    mean = unit.groupBy("doc_id", "k").agg(F.sum("x").alias("x"))
    return mean.select("doc_id", "k", F.round(F.col("x") / length("x", "doc_id"), 6).alias("x"))


@query("sim_15_representative", f"WITH c AS ({_C.format(t='embeddings')}), s AS (SELECT label, vec_id, round({_cos('embedding', 'c')}, 9) AS x FROM embeddings JOIN c USING (label)) SELECT label, count(*) AS n, min(vec_id) FILTER (x = top) AS representative, CASE WHEN max(x) >= 0.8 THEN 'covered' WHEN max(x) >= 0.5 THEN 'partial' ELSE 'gap' END AS status FROM (SELECT *, max(x) OVER (PARTITION BY label) AS top FROM s) GROUP BY 1")
def _(s, d):
    e = table(s, d, "embeddings")
    x = F.round(S.cosine(F.col("embedding"), F.col("centroid")), 9)
    scored = e.join(S.centroids(e, "label", "embedding"), "label").select("label", "vec_id", x.alias("x"))
    status = F.when(F.max("x") >= 0.8, "covered").when(F.max("x") >= 0.5, "partial").otherwise("gap")
    return scored.groupBy("label").agg(F.count("*").alias("n"), F.max_by("vec_id", F.struct("x", -F.col("vec_id"))).alias("representative"), status.alias("status"))


@query("sim_16_coverage", f"WITH c AS ({_C.format(t='embeddings')}) SELECT label, vec_id AS template, r AS rank FROM (SELECT c.label, vec_id, row_number() OVER (PARTITION BY c.label ORDER BY round({_cos('c', 'embedding')}, 9) DESC, vec_id) AS r FROM c, embeddings e) WHERE r <= 3")
def _(s, d):
    e = table(s, d, "embeddings")
    topics = S.centroids(e, "label", "embedding").select(F.col("label").alias("vec_id"), F.col("centroid").alias("embedding"))
    found = S.nearest(topics, e, "vec_id", "embedding", 3, exclude_self=False)
    return found.select(F.col("query").alias("label"), F.col("neighbour").alias("template"), F.col("rank").cast("long").alias("rank"))


@query("sim_18_alignment")
def _(s, d):
    e = table(s, d, "embeddings")
    halves = [S.centroids(e.where(F.col("vec_id") % 2 == k), "label", "embedding") for k in (0, 1)]
    return S.aligned(*halves, "label", "centroid").withColumn("cosine", F.round("cosine", 6))


@query("sim_19_k_sweep")
def _(s, d):
    """Inertia (one minus cosine) for each number of clusters, and its second difference: the elbow."""
    e = table(s, d, "embeddings")
    swept = None
    for k in (2, 6, 10):
        _, members = S.lloyd(e, "vec_id", "embedding", k, 2)
        own = members.agg(F.lit(k).alias("k"), F.count_distinct("cluster").alias("clusters"), F.round(F.sum(1 - F.col("score")), 4).alias("inertia"))
        swept = own if swept is None else swept.union(own)
    w = Window.orderBy("k")  # a row for each k
    return swept.withColumn("bend", F.round(F.lag("inertia").over(w) - 2 * F.col("inertia") + F.lead("inertia").over(w), 4))


@query("sim_24_max_of_max", f"SELECT label, round(avg(m), 6) AS score FROM (SELECT a.vec_id, b.label, max({_cos('a.embedding', 'b.embedding')}) AS m FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 7 GROUP BY 1, 2) GROUP BY 1")
def _(s, d):
    """The best chunk of each topic for every anchor, mean over the anchors."""
    e = table(s, d, "embeddings").select("vec_id", "label", S.normalised(F.col("embedding")).alias("v"))
    anchors = e.where("vec_id % 20 = 7").select(F.lit(0).alias("q"), F.col("vec_id").alias("tok"), "v")
    return S.max_sim(anchors, e.select(F.col("label").alias("d"), "v")).select(F.col("d").alias("label"), F.round("score", 6).alias("score"))


def _recovery(a, b):
    return f"SELECT e.label, '{a}{b}' AS lens, avg((r.label = e.label)::INT) AS top1 FROM (SELECT e.vec_id, c.label, row_number() OVER (PARTITION BY e.vec_id ORDER BY round({_cos('e.embedding', 'c.c')}, 9) DESC, c.label) AS r FROM (SELECT * FROM embeddings WHERE vec_id % 2 = {b}) e, ({_C.format(t=f'(SELECT * FROM embeddings WHERE vec_id % 2 = {a})')}) c) r JOIN embeddings e USING (vec_id) WHERE r.r = 1 GROUP BY 1"


@query("sim_27_28_congruence", f"SELECT label, lens, round(top1, 6) AS top1 FROM ({_recovery(0, 1)} UNION ALL {_recovery(1, 0)})")
def _(s, d):
    """Each half of the rows against the other half's centroids: the share that finds its own label."""
    e = table(s, d, "embeddings")

    def lens(a, b):
        centres = S.centroids(e.where(F.col("vec_id") % 2 == a), "label", "embedding").withColumnRenamed("label", "cluster")
        found = S.closest(e.where(F.col("vec_id") % 2 == b), "vec_id", "embedding", centres)
        return found.groupBy("label").agg(F.lit(f"{a}{b}").alias("lens"), F.round(F.avg((F.col("cluster") == F.col("label")).cast("int")), 6).alias("top1"))

    return lens(0, 1).union(lens(1, 0))


@query("doc_02_tail_windows", "SELECT doc_id, array_to_string(list_sort(list_distinct(list_concat(range(0, greatest(n_chars - 512, 0) + 1, 256), [greatest(n_chars - 512, 0)]))), ',') AS starts FROM documents")
def _(s, d):
    last = F.greatest(F.col("n_chars") - 512, F.lit(0))
    return table(s, d, "documents").select("doc_id", F.array_join(F.array_sort(F.array_union(F.sequence(F.lit(0).cast("long"), last, F.lit(256).cast("long")), F.array(last))), ",").alias("starts"))


@query("doc_05_one_or_none", f"WITH c AS ({_C.format(t='embeddings')}), r AS (SELECT vec_id, c.label, round({_cos('embedding', 'c')}, 9) AS x, row_number() OVER (PARTITION BY vec_id ORDER BY round({_cos('embedding', 'c')}, 9) DESC, c.label) AS r FROM embeddings, c) SELECT vec_id, CASE WHEN max(x) FILTER (r = 1) - max(x) FILTER (r = 2) >= 0.05 THEN max(label) FILTER (r = 1) END AS topic FROM r WHERE r <= 2 GROUP BY 1")
def _(s, d):
    e = table(s, d, "embeddings")
    ranked = S.assign(e, "vec_id", "embedding", S.centroids(e, "label", "embedding").withColumnRenamed("label", "guess"), "guess").where("rank < 2")
    at = lambda k, c: F.max(F.when(F.col("rank") == k, F.col(c)))
    return ranked.groupBy("vec_id").agg(F.when(at(0, "score") - at(1, "score") >= 0.05, at(0, "guess")).alias("topic"))


@query("doc_07_store_report", "SELECT sha256(lang)[1:8] AS state, count(*) AS docs, count(*) FILTER (n_chars >= 1000) AS associated FROM documents GROUP BY 1")
def _(s, d):
    """Associations written by the state they belong to, and the report of each."""
    path = scratch(s, "associations")
    state = F.substring(F.sha2(F.col("lang").cast("binary"), 256), 1, 8)
    table(s, d, "documents").select("doc_id", (F.col("n_chars") >= 1000).alias("hit"), F.concat(F.lit("s"), state).alias("state")).write.partitionBy("state").parquet(path)
    return s.read.parquet(path).groupBy(F.substring("state", 2, 8).alias("state")).agg(F.count("*").alias("docs"), F.count_if("hit").alias("associated"))


@query("doc_13_table_density", "SELECT n_regionkey, count(*) AS n_rows, round(0.5::DOUBLE * least(1, count(*) / 4) + 0.5::DOUBLE * least(1, avg(length(n_name)) / 10), 6) AS density FROM nation GROUP BY 1")
def _(s, d):
    """Ramps of row count and of cell length over Markdown tables read back from their lines."""
    line = F.concat(F.lit("| "), F.col("n_regionkey").cast("string"), F.lit(" | "), "n_name", F.lit(" |"))
    cells = F.transform(F.split(F.regexp_replace(line, r"^\||\|$", ""), r"\|"), lambda c: F.trim(c))
    rows = table(s, d, "nation").select(F.get(cells, F.lit(0)).cast("int").alias("n_regionkey"), F.get(cells, F.lit(1)).alias("name"))
    n = F.count("*")
    density = 0.5 * F.least(F.lit(1.0), n / 4) + 0.5 * F.least(F.lit(1.0), F.avg(F.length("name")) / 10)
    return rows.groupBy("n_regionkey").agg(n.alias("n_rows"), F.round(density, 6).alias("density"))


_MEETS = "len([t FOR t IN string_split(p_name, ' ') IF len([v FOR v IN ['cold', 'ring', 'bolts', 'widget s', 'red'] IF contains(v, t) OR contains(t, v)]) > 0])"


@query("doc_14_16_vocabulary", f"SELECT p_partkey, round({_MEETS} / len(string_split(p_name, ' ')), 6) AS share FROM part")
def _(s, d):
    vocabulary = F.array(*map(F.lit, ("cold", "ring", "bolts", "widget s", "red")))
    t = F.split("p_name", " ")
    met = F.filter(t, lambda x: F.exists(vocabulary, lambda v: F.contains(v, x) | F.contains(x, v)))
    return table(s, d, "part").select("p_partkey", F.round(F.size(met) / F.size(t), 6).alias("share"))


@query("doc_17_entailment", "SELECT doc_id, round(CASE WHEN c IS NULL AND v IS NULL THEN 0 WHEN c IS NULL THEN v WHEN v IS NULL THEN c ELSE 0.6 * c + 0.4 * v END, 6)::DOUBLE AS score FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE len([x FOR x IN ['the', 'que', 'and'] IF contains(lower(text), x)]) / 3 END AS c, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE len([x FOR x IN ['of', 'der'] IF contains(lower(text), x)]) / 2 END AS v FROM documents)")
def _(s, d):
    """Concepts weigh 0.6 and values 0.4; a side that a document lacks leaves the other alone."""
    share = lambda *x: sum(F.contains(F.lower("text"), F.lit(t)).cast("int") for t in x) / len(x)
    c = F.when(F.col("doc_id") % 3 != 0, share("the", "que", "and"))
    v = F.when(F.col("doc_id") % 5 != 0, share("of", "der"))
    score = F.coalesce(0.6 * c + 0.4 * v, c, v, F.lit(0.0))
    return table(s, d, "documents").select("doc_id", F.round(score, 6).alias("score"))


@query("doc_06_item_windows", "SELECT doc_id, i AS ix, s AS start, least(s + 40, n) AS stop FROM (SELECT doc_id, unnest(range(0, k)) AS i, unnest(range(0, k)) * 20 AS s, n FROM (SELECT doc_id, len(string_split(text, ' ')) AS n, greatest(0, ceil((len(string_split(text, ' ')) - 40) / 20)::INT) + 1 AS k FROM documents))")
def _(s, d):
    n = F.size(F.split("text", " ")).cast("long")
    found = table(s, d, "documents").select("doc_id", F.posexplode(W.token_windows(n, 40, 20)).alias("ix", "x"))
    return found.select("doc_id", F.col("ix").cast("long").alias("ix"), F.col("x.start").cast("long").alias("start"), F.col("x.end").alias("stop"))
