"""Queries of aggregates, statistics, arrays and maps."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from marlstone.functions import hashing as H
from marlstone.functions.text import EDGE, number, words
from marlstone.operators import aggregates as A
from marlstone.operators import evaluation as E
from marlstone.operators import windows as W
from marlstone.plans.catalog import query
from marlstone.storage import table

_W = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')"

# ---- aggregates


@query("agg_01_filtered", "SELECT c_nationkey, count(*) AS n, round(sum(c_acctbal), 2) AS total, min(c_acctbal) AS least, max(c_acctbal) AS most, round(avg(c_acctbal), 4) AS mean FROM customer WHERE c_mktsegment = 'BUILDING' GROUP BY 1")
def _(s, d):
    x = F.col("c_acctbal")
    return table(s, d, "customer").where("c_mktsegment = 'BUILDING'").groupBy("c_nationkey").agg(F.count("*").alias("n"), F.round(F.sum(x), 2).alias("total"), F.min(x).alias("least"), F.max(x).alias("most"), F.round(F.avg(x), 4).alias("mean"))


@query("agg_02_first_cell", "SELECT p_brand, min_by(p_retailprice, p_partkey) AS first FROM part WHERE p_size > 20 GROUP BY 1")
def _(s, d):
    return table(s, d, "part").where("p_size > 20").groupBy("p_brand").agg(A.first_cell("p_retailprice", "p_partkey").alias("first"))


@query("agg_03_shares", "SELECT p_type AS key, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 4) AS share FROM part GROUP BY 1")
def _(s, d):
    return A.shares(table(s, d, "part"), "p_type")


@query("agg_04_profile", "SELECT l_returnflag, list_sort(list(l_quantity))[least(count(*), floor(0.5 * count(*))::INT + 1)] AS p50, list_sort(list(l_quantity))[least(count(*), floor(0.9 * count(*))::INT + 1)] AS p90, list_sort(list(l_quantity))[least(count(*), floor(0.99 * count(*))::INT + 1)] AS p99 FROM lineitem GROUP BY 1")
def _(s, d):
    return A.ranked_quantiles(table(s, d, "lineitem"), ["l_returnflag"], "l_quantity", {"p50": 0.5, "p90": 0.9, "p99": 0.99})


@query("agg_05_summary", "SELECT p_brand, round(avg(p_size), 6) AS mean, median(p_size) AS median, max(p_size) AS most FROM part GROUP BY 1")
def _(s, d):
    return table(s, d, "part").groupBy("p_brand").agg(F.round(F.avg("p_size"), 6).alias("mean"), F.median("p_size").alias("median"), F.max("p_size").alias("most"))


@query("agg_06_group_entropy", "SELECT p_brand, round(-sum(p * log2(p)), 6) AS entropy FROM (SELECT p_brand, count(*) / sum(count(*)) OVER (PARTITION BY p_brand) AS p FROM part GROUP BY p_brand, p_type) GROUP BY 1")
def _(s, d):
    return A.entropy(table(s, d, "part"), ["p_brand"], "p_type").withColumn("entropy", F.round("entropy", 6))


@query("agg_07_08_gate", "WITH g AS (SELECT p_brand, count(DISTINCT p_name) / count(*) AS ratio FROM part GROUP BY 1), f AS (SELECT avg(ratio) AS m, stddev_pop(ratio) AS sd, quantile_cont(ratio, 0.1) AS p10 FROM g) SELECT p_brand, ratio < p10 AS below, round(ratio - m, 6) AS off FROM g, f")
def _(s, d):
    g = table(s, d, "part").groupBy("p_brand").agg((F.count_distinct("p_name") / F.count("*")).alias("ratio"))
    f = g.agg(F.avg("ratio").alias("m"), F.percentile("ratio", 0.1).alias("p10"))
    return g.crossJoin(F.broadcast(f)).select("p_brand", (F.col("ratio") < F.col("p10")).alias("below"), F.round(F.col("ratio") - F.col("m"), 6).alias("off"))  # one row of norms


@query("agg_09_cell_ratios", "SELECT round(avg((c_name IS NULL OR c_name = '')::INT), 6) AS blank, round(avg(regexp_matches(c_name, '[0-9]')::INT), 6) AS typed, round(avg((length(c_mktsegment) > 8)::INT), 6) AS long FROM customer")
def _(s, d):
    share = lambda c: F.round(F.avg(c.cast("int")), 6)
    return table(s, d, "customer").agg(share(F.coalesce(F.col("c_name"), F.lit("")) == "").alias("blank"), share(F.col("c_name").rlike("[0-9]")).alias("typed"), share(F.length("c_mktsegment") > 8).alias("long"))


@query("agg_11_conditional", "SELECT lang, source, count(*) AS n, count(*) FILTER (quality = 1) AS ok, round(count(*) FILTER (quality = 1) / count(*), 6) AS rate FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1, 2")
def _(s, d):
    ok = F.count_if(F.col("quality") == 1)
    return table(s, d, "documents").select("doc_id", "lang", "source").join(table(s, d, "labels"), "doc_id", "left").groupBy("lang", "source").agg(F.count("*").alias("n"), ok.alias("ok"), F.round(ok / F.count("*"), 6).alias("rate"))


@query("agg_14_alignment", "SELECT label, count(*) AS n, round(avg(embedding[1]), 5) AS mean FROM embeddings GROUP BY 1")
def _(s, d):
    return table(s, d, "embeddings").groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg(F.get("embedding", F.lit(0)).cast("double")), 5).alias("mean"))


@query("agg_15_basins", "SELECT coalesce(a.source, b.source) AS source, coalesce(old, 0) AS old, coalesce(new, 0) AS new, coalesce(new, 0) >= 5 AND coalesce(new, 0) >= 1.2 * greatest(coalesce(old, 0), 1) AS grew FROM (SELECT source, count(*) AS old FROM documents WHERE doc_id % 2 = 0 GROUP BY 1) a FULL JOIN (SELECT source, count(*) AS new FROM documents WHERE doc_id % 2 = 1 GROUP BY 1) b ON a.source = b.source")
def _(s, d):
    docs = table(s, d, "documents")
    runs = docs.groupBy("source").agg(F.count_if(F.col("doc_id") % 2 == 0).alias("old"), F.count_if(F.col("doc_id") % 2 == 1).alias("new"))
    return runs.withColumn("grew", (F.col("new") >= 5) & (F.col("new") >= 1.2 * F.greatest("old", F.lit(1))))


@query("agg_17_scorecard", "SELECT coalesce(lang, 'overall') AS slice, count(*) AS n, round(avg(quality), 6) AS accuracy, round(avg((1 - 0.8) * (1 - 0.8) * quality + 0.64 * (1 - quality)), 6) AS brier FROM documents JOIN labels USING (doc_id) GROUP BY ROLLUP (lang)")
def _(s, d):
    met = table(s, d, "documents").select("doc_id", "lang").join(table(s, d, "labels"), "doc_id")
    brier = E.brier(F.lit(0.8), F.col("quality") > 0)
    return met.rollup("lang").agg(F.count("*").alias("n"), F.round(F.avg("quality"), 6).alias("accuracy"), F.round(F.avg(brier), 6).alias("brier")).select(F.coalesce("lang", F.lit("overall")).alias("slice"), "n", "accuracy", "brier")


@query("agg_18_hit_at_k", "WITH r AS (SELECT c_mktsegment AS arm, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rank FROM customer) SELECT arm, round(avg(rank), 6) AS mean_rank, round(avg((rank <= 1)::INT), 6) AS hit1, round(avg((rank <= 3)::INT), 6) AS hit3, round(avg((rank <= 10)::INT), 6) AS hit10 FROM r GROUP BY 1")
def _(s, d):
    rank = F.row_number().over(Window.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey"))
    ranked = table(s, d, "customer").select(F.col("c_mktsegment").alias("arm"), rank.alias("rank"))
    return ranked.groupBy("arm").agg(F.round(F.avg("rank"), 6).alias("mean_rank"), *(F.round(E.hit_rate(F.col("rank"), k), 6).alias(f"hit{k}") for k in (1, 3, 10)))


@query("agg_19_gini", "SELECT p_brand, round(2 * sum(i * x) / (count(*) * sum(x)) - (count(*) + 1) / count(*), 6) AS gini FROM (SELECT p_brand, p_size AS x, row_number() OVER (PARTITION BY p_brand ORDER BY p_size) AS i FROM part) GROUP BY 1")
def _(s, d):
    return A.gini(table(s, d, "part"), ["p_brand"], "p_size").withColumn("gini", F.round("gini", 6))


@query("agg_20_confounds", "SELECT q, count(*) AS n, sum(n_chars)::BIGINT AS chars, count(*) FILTER (lang = 'en') AS en FROM (SELECT n_chars, lang, ntile(4) OVER (ORDER BY n_chars, doc_id)::INT AS q FROM documents) GROUP BY 1")
def _(s, d):
    docs = table(s, d, "documents").select("n_chars", "doc_id", "lang")
    n = docs.count()
    size, more, i = n // 4, n % 4, F.col("i")  # the first quartiles have one row more
    edge = more * (size + 1)
    q = F.when(i < edge, F.floor(i / (size + 1)) + 1).otherwise(F.floor((i - edge) / max(size, 1)) + more + 1).cast("int")
    placed = W.numbered(docs, [F.col("n_chars").asc_nulls_last(), F.col("doc_id").asc_nulls_last()], "i").withColumn("q", q)
    return placed.groupBy("q").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"), F.count_if(F.col("lang") == "en").alias("en"))


@query("agg_21_throughput", "SELECT event_type, count(*) AS n, round(sum(value), 2) AS tokens, round(count(*) / ((epoch(max(ts)) - epoch(min(ts))) / 3600), 4) AS per_hour FROM events GROUP BY 1")
def _(s, d):
    ts = F.col("ts").cast("timestamp")
    hours = (F.unix_micros(F.max(ts)) - F.unix_micros(F.min(ts))) / 3600e6
    return table(s, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("tokens"), F.round(F.count("*") / hours, 4).alias("per_hour"))


@query("agg_23_rubric", r"SELECT p AS pattern, sum(len(regexp_extract_all(lower(text), p)))::BIGINT AS hits FROM documents, (VALUES ('licensed?'), ('\bthe\b'), ('[0-9]+')) v(p) GROUP BY 1")
def _(s, d):
    patterns = ["licensed?", r"\bthe\b", "[0-9]+"]
    counts = [F.sum(F.regexp_count(F.lower("text"), F.lit(p.replace(r"\b", EDGE)))).alias(f"p{i}") for i, p in enumerate(patterns)]
    one = table(s, d, "documents").agg(*counts)
    return one.select(F.inline(F.array(*(F.struct(F.lit(p).alias("pattern"), F.col(f"p{i}").alias("hits")) for i, p in enumerate(patterns)))))


@query("agg_27_naming", "SELECT lead, count(*) AS n FROM (SELECT string_split(p_name, ' ')[1] AS lead FROM part WHERE contains(p_name, ' ')) GROUP BY 1 ORDER BY n DESC, lead LIMIT 5")
def _(s, d):
    return table(s, d, "part").where(F.contains("p_name", F.lit(" "))).groupBy(F.split_part("p_name", F.lit(" "), F.lit(1)).alias("lead")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lead").limit(5)


@query("agg_28_grouping_sets", "SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY GROUPING SETS ((p_brand), (p_type))")
def _(s, d):
    return s.sql("SELECT p_brand, p_type, count(*) AS n FROM {part} GROUP BY GROUPING SETS ((p_brand), (p_type))", part=table(s, d, "part"))


@query("agg_29_best_epoch", "SELECT c_nationkey, c_custkey AS best FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS r FROM customer) WHERE r = 1")
def _(s, d):
    return table(s, d, "customer").groupBy("c_nationkey").agg(A.best(F.col("c_custkey"), F.col("c_acctbal") + 2000, F.col("c_custkey")).alias("best"))


@query("agg_30_31_stat_cards", "SELECT count(*) AS docs, sum(n_chars)::BIGINT AS chars, count(DISTINCT source) AS sources, count(DISTINCT lang) AS langs FROM documents")
def _(s, d):
    return table(s, d, "documents").agg(F.count("*").alias("docs"), F.sum("n_chars").alias("chars"), F.count_distinct("source").alias("sources"), F.count_distinct("lang").alias("langs"))


@query("agg_33_bands", "SELECT CASE WHEN n >= 20 THEN 'wide' WHEN n >= 10 THEN 'some' ELSE 'few' END AS band, count(*) AS users FROM (SELECT user_id, count(DISTINCT event_type) * 4 AS n FROM events GROUP BY 1) GROUP BY 1")
def _(s, d):
    n = table(s, d, "events").groupBy("user_id").agg((F.count_distinct("event_type") * 4).alias("n"))
    return n.groupBy(F.when(F.col("n") >= 20, "wide").when(F.col("n") >= 10, "some").otherwise("few").alias("band")).agg(F.count("*").alias("users"))


@query("agg_34_family_sets", "WITH f AS (SELECT o_orderkey, o_totalprice, fams FROM orders JOIN (SELECT l_orderkey, string_agg(DISTINCT l_returnflag, '+' ORDER BY l_returnflag) AS fams FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey) SELECT fams, count(*) AS n, round(avg(o_totalprice), 4) AS mean, round(stddev_samp(o_totalprice), 4) AS sd FROM f GROUP BY 1 HAVING count(*) >= 5")
def _(s, d):
    fams = table(s, d, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_set("l_returnflag")), "+").alias("fams"))
    met = table(s, d, "orders").join(fams, F.col("o_orderkey") == F.col("l_orderkey"))
    return met.groupBy("fams").agg(F.count("*").alias("n"), F.round(F.avg("o_totalprice"), 4).alias("mean"), F.round(F.stddev_samp("o_totalprice"), 4).alias("sd")).where("n >= 5")


@query("agg_35_usage", "SELECT n_nationkey, count(c_custkey) AS used FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1")
def _(s, d):
    used = table(s, d, "customer").groupBy("c_nationkey").agg(F.count("*").alias("used"))
    return table(s, d, "nation").join(used, F.col("n_nationkey") == F.col("c_nationkey"), "left").select("n_nationkey", F.coalesce("used", F.lit(0)).alias("used"))


@query("agg_36_density", "SELECT round(avg(n), 6) AS mean, quantile_cont(n, 0.5) AS p50, round(quantile_cont(n, 0.9), 6) AS p90, max(n) AS most, round(avg((n = 0)::INT), 6) AS none FROM (SELECT o_orderkey, count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_discount >= 0.05 GROUP BY 1)")
def _(s, d):
    hits = table(s, d, "lineitem").where("l_discount >= 0.05").groupBy("l_orderkey").agg(F.count("*").alias("k"))
    n = table(s, d, "orders").join(hits, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(F.coalesce("k", F.lit(0)).alias("n"))
    return n.agg(F.round(F.avg("n"), 6).alias("mean"), F.percentile("n", 0.5).alias("p50"), F.round(F.percentile("n", 0.9), 6).alias("p90"), F.max("n").alias("most"), F.round(F.avg((F.col("n") == 0).cast("int")), 6).alias("none"))


@query("agg_38_type_list", "SELECT lang, count(*) AS n FROM documents GROUP BY 1 ORDER BY 1")
def _(s, d):
    return table(s, d, "documents").groupBy("lang").agg(F.count("*").alias("n")).orderBy("lang")


@query("agg_39_lineage_summary", "SELECT p_type, count(*) AS n, count(DISTINCT p_brand) AS brands FROM (SELECT *, row_number() OVER (PARTITION BY p_type, p_brand ORDER BY p_partkey) AS r FROM part) WHERE r <= 10 GROUP BY 1")
def _(s, d):
    r = F.row_number().over(Window.partitionBy("p_type", "p_brand").orderBy("p_partkey"))
    return table(s, d, "part").withColumn("r", r).where("r <= 10").groupBy("p_type").agg(F.count("*").alias("n"), F.count_distinct("p_brand").alias("brands"))


# ---- statistics


@query("sta_02_mask_entropy", "WITH c AS (SELECT p_brand, m, count(*) AS n FROM (SELECT p_brand, regexp_replace(regexp_replace(p_name || p_size, '\\p{L}+', 'X', 'g'), '\\p{Nd}', '9', 'g') AS m FROM part) GROUP BY 1, 2) SELECT p_brand, round(CASE WHEN count(*) = 1 THEN 0 ELSE -sum(n / t * log2(n / t)) / log2(count(*)) END, 6) AS normed, round(max(n) / max(t), 6) AS top FROM (SELECT *, sum(n) OVER (PARTITION BY p_brand) AS t FROM c) GROUP BY 1")
def _(s, d):
    m = F.regexp_replace(F.regexp_replace(F.concat("p_name", F.col("p_size").cast("string")), r"\p{L}+", "X"), r"\p{Nd}", "9")
    c = table(s, d, "part").groupBy("p_brand", m.alias("m")).agg(F.count("*").alias("n"))
    t = F.sum("n")
    bits = F.log2(t) - F.sum(F.col("n") * F.log2("n")) / t
    return c.groupBy("p_brand").agg(F.round(F.when(F.count("*") == 1, 0.0).otherwise(bits / F.log2(F.count("*"))), 6).alias("normed"), F.round(F.max("n") / t, 6).alias("top"))


@query("sta_03_register_score", "SELECT l_orderkey, l_linenumber, round(0.4::DOUBLE * (1 - x) + 0.4::DOUBLE * (1 - m) + 0.2::DOUBLE * greatest(0, 1 - abs(e - 0.516::DOUBLE) / 0.516::DOUBLE), 3) AS score FROM (SELECT l_orderkey, l_linenumber, l_discount::DOUBLE AS x, l_tax::DOUBLE AS m, l_quantity::DOUBLE / 64 AS e FROM lineitem)")
def _(s, d):
    number = lambda c: F.col(c).cast("double")
    return table(s, d, "lineitem").select("l_orderkey", "l_linenumber", E.register_score(number("l_discount"), number("l_tax"), number("l_quantity") / 64).alias("score"))


@query("sta_04_05_distinct_n", f"SELECT doc_id, round(len(list_distinct(g)) / greatest(len(g), 1), 6) AS distinct2 FROM (SELECT doc_id, [w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))] AS g FROM (SELECT doc_id, {_W} AS w FROM documents))")
def _(s, d):
    w = F.col("w")
    g = F.when(F.size(w) >= 2, F.transform(F.sequence(F.lit(0), F.size(w) - 2), lambda i: F.concat_ws(" ", F.get(w, i), F.get(w, i + 1)))).otherwise(F.expr("cast(array() as array<string>)"))
    return table(s, d, "documents").select("doc_id", words(F.lower("text")).alias("w")).select("doc_id", g.alias("g")).select("doc_id", F.round(F.size(F.array_distinct("g")) / F.greatest(F.size("g"), F.lit(1)), 6).alias("distinct2"))


@query("sta_06_compression")
def _(s, d):
    return E.compression_ratio(table(s, d, "documents").select("doc_id", "text"), "text")


_LEADS = ", ".join("x" + "".join(f" || lead(x, {j}) OVER w" for j in range(1, k)) + f" AS g{k}" for k in range(1, 9))
_BYTE_GRAMS = f"WITH b AS (SELECT doc_id, unnest(regexp_extract_all(hex(encode(text)), '..')) AS x, generate_subscripts(regexp_extract_all(hex(encode(text)), '..'), 1) AS i FROM documents), g AS (SELECT {_LEADS} FROM b WINDOW w AS (PARTITION BY doc_id ORDER BY i)), c AS (" + " UNION ALL ".join(f"SELECT {k} AS k, count(DISTINCT g{k}) AS grams FROM g" for k in range(1, 9)) + ") SELECT k, grams, round(log2(grams) / k, 6) AS rate, round((SELECT sum(octet_length(encode(text))) FROM documents) * log2((SELECT grams FROM c WHERE k = 8)) / 8 / 8, 2) AS ceiling FROM c"


@query("sta_07_08_byte_entropy", _BYTE_GRAMS)
def _(s, d):
    docs = table(s, d, "documents").select("text")
    rates = E.byte_grams(docs, "text", 8).select("k", "grams", (F.log2("grams") / F.col("k")).alias("rate"))
    total = docs.agg(F.sum(F.octet_length(F.col("text").cast("binary"))).alias("bytes"))
    last = rates.where("k = 8").select(F.col("rate").alias("h8"))
    met = rates.crossJoin(F.broadcast(total)).crossJoin(F.broadcast(last))  # eight rows, one, one
    return met.select("k", "grams", F.round("rate", 6).alias("rate"), F.round(F.col("bytes") * F.col("h8") / 8, 2).alias("ceiling"))


@query("sta_09_geometric_mean", "SELECT p_partkey, round(CASE WHEN p_size <= 1 THEN 0 ELSE exp((ln(p_size - 1) + ln(p_retailprice)) / 2) END, 4) AS g FROM part")
def _(s, d):
    return table(s, d, "part").select("p_partkey", F.round(A.geometric_mean([(F.col("p_size") - 1).cast("double"), F.col("p_retailprice"), F.lit(None).cast("double")]), 4).alias("g"))


_JSD = """WITH w AS (SELECT lang, unnest({w}) AS t FROM documents WHERE lang IN ('en', 'fr')), c AS (SELECT t, count(*) FILTER (lang = 'en') AS a, count(*) FILTER (lang = 'fr') AS b FROM w GROUP BY 1),
p AS (SELECT a / sum(a) OVER () AS p, b / sum(b) OVER () AS q FROM c) SELECT round(0.5 * sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END) + 0.5 * sum(CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END), 6) AS jsd FROM p"""


@query("sta_10_11_jsd", _JSD.format(w=_W))
def _(s, d):
    w = table(s, d, "documents").where("lang IN ('en', 'fr')").select("lang", F.explode(words(F.lower("text"))).alias("t"))
    c = w.groupBy("t").agg(F.count_if(F.col("lang") == "en").alias("a"), F.count_if(F.col("lang") == "fr").alias("b"))
    return E.jensen_shannon(c, "a", "b").withColumn("jsd", F.round("jsd", 6))


@query("sta_13_14_wasserstein", "WITH b AS (SELECT unnest(range(1, 51)) AS v), h AS (SELECT v, count(p_partkey) FILTER (p_type = 'ECONOMY') AS a, count(p_partkey) FILTER (p_type = 'PROMO') AS c FROM b LEFT JOIN part ON p_size = v GROUP BY 1), f AS (SELECT v, a / sum(a) OVER () - c / sum(c) OVER () AS x FROM h) SELECT round(sum(abs(y)), 3) AS distance FROM (SELECT sum(x) OVER (ORDER BY v) AS y FROM f)")
def _(s, d):
    parts = table(s, d, "part")
    return E.wasserstein(parts.where("p_type = 'ECONOMY'"), parts.where("p_type = 'PROMO'"), "p_size", 50)


@query("sta_15_16_quantiles", "SELECT p_brand, list_sort(list(p_size))[least(count(*), floor(0.25 * count(*))::INT + 1)] AS low, list_sort(list(p_size))[round_even(0.9::DOUBLE * (count(*) - 1), 0)::INT + 1] AS high FROM part GROUP BY 1")
def _(s, d):
    return A.ranked_quantiles(table(s, d, "part"), ["p_brand"], "p_size", {"low": 0.25}, {"high": 0.9})


@query("sta_17_linear_quantile", "SELECT p_brand, round(quantile_cont(p_retailprice, 0.1), 4) AS p10, round(quantile_cont(p_retailprice, 0.9), 4) AS p90, round(stddev_pop(p_retailprice) / avg(p_retailprice), 6) AS cv FROM part GROUP BY 1")
def _(s, d):
    x = F.col("p_retailprice")
    return table(s, d, "part").groupBy("p_brand").agg(F.round(F.percentile(x, 0.1), 4).alias("p10"), F.round(F.percentile(x, 0.9), 4).alias("p90"), F.round(F.stddev_pop(x) / F.avg(x), 6).alias("cv"))


@query("sta_18_spearman", "SELECT c_nationkey, round(corr(a, b), 6) + 0::DOUBLE AS rho FROM (SELECT c_nationkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) AS a, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment, c_custkey) AS b FROM customer) GROUP BY 1")
def _(s, d):
    return E.spearman(table(s, d, "customer"), ["c_nationkey"], "c_acctbal", "c_mktsegment", "c_custkey").withColumn("rho", F.round("rho", 6) + F.lit(0.0))


@query("sta_19_bootstrap")
def _(s, d):
    return E.bootstrap_mean(table(s, d, "customer"), ["c_mktsegment"], "c_custkey", "c_acctbal", replicates=100)


@query("sta_20_bca")
def _(s, d):
    return E.bca_mean(table(s, d, "customer"), ["c_mktsegment"], "c_custkey", "c_acctbal", replicates=200)


@query("sta_21_permutation")
def _(s, d):
    diffs = table(s, d, "customer").select("c_mktsegment", "c_custkey", (F.col("c_acctbal") - 4500).alias("x"))
    return E.sign_flip_test(diffs, ["c_mktsegment"], "c_custkey", "x", rounds=100)


@query("sta_22_brier", "SELECT round(avg(CASE WHEN quality = 1 THEN (1 - p) ** 2 ELSE p ** 2 END), 6) AS brier FROM (SELECT quality, doc_id % 10 / 10.0 AS p FROM labels)")
def _(s, d):
    return table(s, d, "labels").agg(F.round(F.avg(E.brier(F.col("doc_id") % 10 / 10.0, F.col("quality") == 1)), 6).alias("brier"))


@query("sta_23_auc", "WITH r AS (SELECT quality, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2 AS r FROM (SELECT quality, n_chars % 97 AS x FROM documents JOIN labels USING (doc_id))) SELECT round((sum(r) FILTER (quality = 1) - count(*) FILTER (quality = 1) * (count(*) FILTER (quality = 1) + 1) / 2) / (count(*) FILTER (quality = 1) * count(*) FILTER (quality = 0)), 6) AS auc FROM r")
def _(s, d):
    met = table(s, d, "documents").join(table(s, d, "labels"), "doc_id").select("quality", (F.col("n_chars") % 97).alias("x"))
    return E.auc(met, "x", "quality").withColumn("auc", F.round("auc", 6))


@query("sta_24_average_precision", "WITH r AS (SELECT quality, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS i, sum(quality) OVER (ORDER BY n_chars DESC, doc_id ROWS UNBOUNDED PRECEDING) AS hits FROM documents JOIN labels USING (doc_id)) SELECT round(sum(hits / i * quality) / sum(quality), 6) AS ap FROM r")
def _(s, d):
    met = table(s, d, "documents").join(table(s, d, "labels"), "doc_id").select("doc_id", "n_chars", "quality")
    return E.average_precision(met, [F.desc("n_chars"), F.asc("doc_id")], "quality").withColumn("ap", F.round("ap", 6))


@query("sta_26_27_f1", "WITH c AS (SELECT quality AS t, (doc_id % 3 > 0)::INT AS p FROM labels), l AS (SELECT k, count(*) FILTER (t = k AND p = k) AS tp, count(*) FILTER (t <> k AND p = k) AS fp, count(*) FILTER (t = k AND p <> k) AS fn FROM c, (VALUES (0), (1)) v(k) GROUP BY 1) SELECT round(2 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)), 6) AS micro, round(avg(2 * tp / (2 * tp + fp + fn)), 6) AS macro FROM l")
def _(s, d):
    pairs = table(s, d, "labels").select(F.col("quality").cast("string").alias("truth"), (F.col("doc_id") % 3 > 0).cast("int").cast("string").alias("guess"))
    return E.f1(pairs, "truth", "guess").select(F.round("micro", 6).alias("micro"), F.round("macro", 6).alias("macro"))


@query("sta_28_29_bcubed_purity", "WITH n AS (SELECT p_brand AS c, p_type AS t, count(*) AS n FROM part GROUP BY 1, 2), s AS (SELECT *, sum(n) OVER (PARTITION BY c) AS nc, sum(n) OVER (PARTITION BY t) AS nt, sum(n) OVER () AS a FROM n) SELECT round(sum(n * n / nc) / max(a), 6) AS precision, round(sum(n * n / nt) / max(a), 6) AS recall, round((SELECT sum(m) FROM (SELECT max(n) AS m FROM n GROUP BY c)) / max(a), 6) AS purity FROM s")
def _(s, d):
    return E.cluster_scores(table(s, d, "part"), "p_brand", "p_type").select(F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"), F.round("purity", 6).alias("purity"))


@query("sta_31_collapse", "SELECT round(max(n) / sum(n), 6) AS top1, count(*) AS uniq, max(n) / sum(n) >= 0.5 AS collapsed FROM (SELECT lang, count(*) AS n FROM documents GROUP BY 1)")
def _(s, d):
    n = table(s, d, "documents").groupBy("lang").agg(F.count("*").alias("n"))
    top = F.max("n") / F.sum("n")
    return n.agg(F.round(top, 6).alias("top1"), F.count("*").alias("uniq"), (top >= 0.5).alias("collapsed"))


@query("sta_34_36_scores", "SELECT p_partkey, round(least(1, 0.45 + 0.15 * least(p_size, 3) + 0.25::DOUBLE * (p_size % 2)), 2) AS confidence, round(0.5 * (0.4 * 0.3 + 0.2 * 0.5 + 0.4::DOUBLE * p_size / 50), 6) AS composite, round(least(1, greatest(0, (p_size - 10) / 30)), 6) AS normed FROM part")
def _(s, d):
    z = F.col("p_size")
    return table(s, d, "part").select(
        "p_partkey",
        F.round(F.least(F.lit(1.0), 0.45 + 0.15 * F.least(z, F.lit(3)) + 0.25 * (z % 2)), 2).alias("confidence"),
        F.round(0.5 * (0.4 * 0.3 + 0.2 * 0.5 + 0.4 * z / 50), 6).alias("composite"),
        F.round(E.null_normalised(z, F.lit(10.0), F.lit(40.0)), 6).alias("normed"),
    )


@query("sta_37_null_threshold", "SELECT list_sort(list(x))[least(count(*), floor(0.95 * count(*))::INT + 1)] AS tau FROM (SELECT doc_id % 89 / 89.0 AS x FROM documents)")
def _(s, d):
    return A.ranked_quantiles(table(s, d, "documents").select((F.col("doc_id") % 89 / 89.0).alias("x")), [], "x", {"tau": 0.95})


@query("sta_38_banding", "SELECT p_partkey, round(CASE WHEN p_size <= 5 THEN 1 WHEN p_size <= 20 THEN 1 + 2 * (p_size - 5) / 15 WHEN p_size <= 45 THEN 3 + 2 * (p_size - 20) / 25 ELSE 5 END, 2) AS band FROM part")
def _(s, d):
    return table(s, d, "part").select("p_partkey", F.round(E.banded(F.col("p_size"), [(5, 1), (20, 3), (45, 5)]), 2).alias("band"))


# ---- arrays, maps and JSON


@query("arr_01_list_or_string", "SELECT p_partkey, CASE p_partkey % 4 WHEN 3 THEN '' ELSE replace(p_name, ' ', ',') END AS items FROM part")
def _(s, d):
    """Lists as JSON, as a written list with single quotes, or as neither."""
    double, single = (F.concat(F.lit(f"[{q}"), F.replace("p_name", F.lit(" "), F.lit(f"{q}, {q}")), F.lit(f"{q}]")) for q in ('"', "'"))
    df = table(s, d, "part").select("p_partkey", F.when(F.col("p_partkey") % 4 == 3, F.col("p_name")).when(F.col("p_partkey") % 4 == 1, single).otherwise(double).alias("v"))
    return df.select("p_partkey", F.array_join(F.coalesce(F.from_json(F.translate("v", "'", '"'), "array<string>"), F.expr("cast(array() as array<string>)")), ",").alias("items"))


@query("arr_02_03_json_facets", "SELECT event_id, (props->>'$.k')::BIGINT AS k, event_type || '_k' AS facet FROM events")
def _(s, d):
    return table(s, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), F.concat("event_type", F.lit("_k")).alias("facet"))


@query("arr_04_05_transpose", "SELECT 'c_acctbal' AS col, true AS numeric, count(*) AS n FROM customer UNION ALL SELECT 'c_mktsegment', false, count(*) FROM customer")
def _(s, d):
    cells = table(s, d, "customer").select(F.inline(F.array(*(F.struct(F.lit(c).alias("col"), F.col(c).cast("string").alias("v")) for c in ("c_acctbal", "c_mktsegment")))))
    return cells.groupBy("col").agg((F.avg(number(F.col("v")).isNotNull().cast("int")) >= 0.8).alias("numeric"), F.count("*").alias("n"))


@query("arr_06_vocabulary", "SELECT source, row_number() OVER (ORDER BY source) - 1 AS ix FROM (SELECT DISTINCT source FROM documents)")
def _(s, d):
    return table(s, d, "documents").select("source").distinct().withColumn("ix", (F.row_number().over(Window.orderBy("source")) - 1).cast("long"))


@query("arr_07_histogram", "SELECT '{' || string_agg('\"' || p_size || '\":' || n, ',' ORDER BY p_size) || '}' AS histogram FROM (SELECT p_size, count(*) AS n FROM part GROUP BY 1)")
def _(s, d):
    counts = table(s, d, "part").groupBy("p_size").agg(F.count("*").alias("n"))
    return counts.agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct("p_size", "n"))))).alias("histogram"))


@query("arr_08_sample_rows", "SELECT p_brand, string_agg(p_name || '/' || p_size, ';' ORDER BY p_partkey) AS sample FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS r FROM part) WHERE r <= 4 GROUP BY 1")
def _(s, d):
    r = F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey"))
    few = table(s, d, "part").withColumn("r", r).where("r <= 4")
    listed = F.sort_array(F.collect_list(F.struct("p_partkey", "p_name", "p_size")))
    return few.groupBy("p_brand").agg(F.array_join(F.transform(listed, lambda x: F.concat(x["p_name"], F.lit("/"), x["p_size"].cast("string"))), ";").alias("sample"))


@query("arr_09_10_inverse", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS children FROM nation GROUP BY 1")
def _(s, d):
    return table(s, d, "nation").groupBy("n_regionkey").agg(F.array_join(F.sort_array(F.collect_set("n_name")), ",").alias("children"))


@query("arr_11_sibling_mix", "SELECT p_type, p_name FROM (SELECT p_type, p_name, row_number() OVER (PARTITION BY p_type ORDER BY ('0x' || sha256('mix:' || p_name)[1:12])::BIGINT, p_name) AS r FROM (SELECT DISTINCT p_type, p_name FROM part)) WHERE r <= 40")
def _(s, d):
    r = F.row_number().over(Window.partitionBy("p_type").orderBy(H.draw(F.col("p_name"), "mix"), "p_name"))
    return table(s, d, "part").select("p_type", "p_name").distinct().withColumn("r", r).where("r <= 40").drop("r")


@query("arr_12_profile_overlap", "WITH p AS (SELECT p_name AS t, count(*) FILTER (p_type = 'PROMO') / sum(count(*) FILTER (p_type = 'PROMO')) OVER () AS a, count(*) FILTER (p_type = 'ECONOMY') / sum(count(*) FILTER (p_type = 'ECONOMY')) OVER () AS b FROM part GROUP BY 1) SELECT round(sum(least(a, b)), 6) AS overlap FROM p")
def _(s, d):
    c = table(s, d, "part").groupBy("p_name").agg(F.count_if(F.col("p_type") == "PROMO").alias("a"), F.count_if(F.col("p_type") == "ECONOMY").alias("b"))
    total = c.agg(F.sum("a").alias("ta"), F.sum("b").alias("tb"))
    return c.crossJoin(F.broadcast(total)).agg(F.round(F.sum(F.least(F.col("a") / F.col("ta"), F.col("b") / F.col("tb"))), 6).alias("overlap"))  # one row of totals


@query("arr_13_json_round_trip", "SELECT doc_id, '{\"doc_id\":' || doc_id || ',\"lang\":\"' || lang || '\"}' AS note FROM documents")
def _(s, d):
    made = F.to_json(F.struct("doc_id", "lang"))
    back = F.from_json(made, "doc_id long, lang string")
    return table(s, d, "documents").select("doc_id", F.to_json(back).alias("note"))
