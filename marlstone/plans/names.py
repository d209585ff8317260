"""Queries of names, spans, splits and scores over whole columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.functions import hashing as H
from marlstone.functions import text as T
from marlstone.operators import aggregates as A
from marlstone.operators import schemas
from marlstone.operators import windows as W
from marlstone.plans.catalog import query
from marlstone.storage import table


def _camel(c="p_name"):
    return F.replace(F.initcap(c), F.lit(" "), F.lit(""))


@query("str_17_20_case_keys", "SELECT p_partkey, replace(p_name, ' ', '_') AS snake, array_to_string([regexp_replace(x, 's$', '') FOR x IN string_split(p_name, ' ')], '_') AS key FROM part")
def _(s, d):
    return table(s, d, "part").select("p_partkey", T.snake(_camel()).alias("snake"), T.column_key(_camel()).alias("key"))


_LAST = "string_split(p_name, ' ')[-1] || CASE p_partkey % 5 WHEN 0 THEN 'y' WHEN 1 THEN 'ey' WHEN 2 THEN 's' WHEN 3 THEN 'ch' ELSE '' END"
_PLURAL = "CASE WHEN regexp_matches(n, '[^aeiou]y$') THEN n[:-2] || 'ies' WHEN regexp_matches(n, '(s|x|z|ch|sh)$') THEN n || 'es' ELSE n || 's' END"


@query("str_18_19_numbers", f"SELECT p_partkey, p AS plural, CASE WHEN p LIKE '%ies' THEN p[:-4] || 'y' WHEN p LIKE '%ses' THEN p[:-3] WHEN regexp_matches(p, '[^s]s$') THEN p[:-2] ELSE p END AS singular FROM (SELECT p_partkey, {_PLURAL} AS p FROM (SELECT p_partkey, {_LAST} AS n FROM part))")
def _(s, d):
    k = F.col("p_partkey") % 5
    noun = F.concat(F.element_at(F.split("p_name", " "), -1), F.when(k == 0, "y").when(k == 1, "ey").when(k == 2, "s").when(k == 3, "ch").otherwise(""))
    p = table(s, d, "part").select("p_partkey", noun.alias("n")).select("p_partkey", T.plural(F.col("n")).alias("plural"))
    return p.select("p_partkey", "plural", T.singular(F.col("plural")).alias("singular"))


@query("str_21_22_short_names", "SELECT p_partkey, array_to_string([CASE WHEN length(x) > 4 THEN (x[1] || regexp_replace(x[2:], '[aeiou]', '', 'g'))[:5] ELSE x END FOR x IN string_split(p_name, ' ')], '_') AS short, lower(p_type) || string_split(p_name, ' ')[1] AS stem FROM part")
def _(s, d):
    long = F.concat("p_type", F.split("p_name", " ")[0], F.when(F.col("p_partkey") % 2 == 0, "s_table").otherwise("s_ID"))
    return table(s, d, "part").select("p_partkey", T.abbreviate(F.replace("p_name", F.lit(" "), F.lit("_"))).alias("short"), T.stem(long).alias("stem"))


@query("str_23_echo", "WITH n AS (SELECT p_partkey, string_split(p_name, ' ') AS a, string_split(CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN string_split(p_name, ' ')[1] || ' item' WHEN 2 THEN '' ELSE lower(p_type) || ' ' || p_size END, ' ') AS b FROM part) SELECT p_partkey, CASE WHEN array_to_string(b, '') = '' THEN 'invalid' WHEN list_sort(a) = list_sort(b) THEN 'echo' WHEN len(list_intersect(a, b)) / len(list_distinct(b)) > 0.4 THEN 'shared' ELSE 'ok' END AS reason FROM n")
def _(s, d):
    k = F.col("p_partkey") % 4
    offer = F.when(k == 0, F.col("p_name")).when(k == 1, F.concat(F.split("p_name", " ")[0], F.lit(" item"))).when(k == 2, "").otherwise(F.concat_ws(" ", F.lower("p_type"), F.col("p_size").cast("string")))
    return table(s, d, "part").select("p_partkey", T.echo_reason(F.split("p_name", " "), F.split(offer, " "), 0.4).alias("reason"))


@query("str_30_line_windows")
def _(s, d):
    text = F.replace(F.replace("text", F.lit(". "), F.lit(".\n")), F.lit("\nT"), F.lit("\n```\nT"))
    return table(s, d, "documents").select("doc_id", F.posexplode(T.line_windows(text, 400)).alias("ix", "piece"))


@query("str_38_slug", "SELECT p_partkey, regexp_replace(lower(p_brand || ': ' || p_name || '/' || p_type), '[^a-z0-9:/.\\-]+', '-', 'g') AS slug FROM part")
def _(s, d):
    return table(s, d, "part").select("p_partkey", T.slug(F.concat("p_brand", F.lit(": "), "p_name", F.lit("/"), "p_type")).alias("slug"))


@query("dtm_08_span_seconds", "SELECT user_id, floor(epoch(max(ts)))::BIGINT - floor(epoch(min(ts)))::BIGINT AS seconds FROM events GROUP BY 1")
def _(s, d):
    return table(s, d, "events").groupBy("user_id").agg((F.unix_seconds(F.max("ts").cast("timestamp")) - F.unix_seconds(F.min("ts").cast("timestamp"))).alias("seconds"))


@query("sta_01_entropy", "WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2) SELECT user_id, round(greatest(log2(sum(n)) - sum(n * log2(n)) / sum(n), 0), 6) AS bits FROM c GROUP BY 1")
def _(s, d):
    return A.entropy(table(s, d, "events"), ["user_id"], "event_type", "bits").withColumn("bits", F.round("bits", 6))


@query("sta_12_gini", "SELECT p_brand, round(2 * sum(i * p_size) / (count(*) * sum(p_size)) - (count(*) + 1) / count(*), 6) AS gini FROM (SELECT p_brand, p_size, row_number() OVER (PARTITION BY p_brand ORDER BY p_size) AS i FROM part) GROUP BY 1")
def _(s, d):
    return A.gini(table(s, d, "part"), ["p_brand"], "p_size").withColumn("gini", F.round("gini", 6))


@query("sta_35_composite", "SELECT l_orderkey, l_linenumber, round((1 - l_discount) * (0.5::DOUBLE * l_tax + 0.3::DOUBLE * l_quantity / 50 + 0.2::DOUBLE * l_discount), 6) AS score FROM lineitem")
def _(s, d):
    q = lambda c: F.col(c).cast("double")
    return table(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.round((1 - q("l_discount")) * (0.5 * q("l_tax") + 0.3 * q("l_quantity") / 50 + 0.2 * q("l_discount")), 6).alias("score"))


_DRAW = "('0x' || sha256({k})[1:12])::BIGINT"


@query("hsh_02_03_splits", f"SELECT doc_id, CASE WHEN a < 0.1 THEN 'test' WHEN a < 0.2 THEN 'val' ELSE 'train' END AS three, CASE WHEN b < 80 THEN 'train' WHEN b < 90 THEN 'val' ELSE 'test' END AS percent FROM (SELECT doc_id, {_DRAW.format(k='doc_id::VARCHAR')} / 281474976710655.0::DOUBLE AS a, {_DRAW.format(k=repr('t:') + ' || doc_id')} % 100 AS b FROM documents)")
def _(s, d):
    return table(s, d, "documents").select("doc_id", H.three_way(F.col("doc_id"), 0.1, 0.1).alias("three"), H.percent_split(F.col("doc_id"), "t").alias("percent"))


@query("hsh_07_run_id", "SELECT doc_id, sha256('{\"seed\": 7}' || sha256(text) || sha256(source))[1:16] AS run_id FROM documents")
def _(s, d):
    """An id of arguments and of the files' hashes, in their order."""
    file = lambda c: F.sha2(F.col(c).cast("binary"), 256)
    return table(s, d, "documents").select("doc_id", F.substring(F.sha2(F.concat(F.lit('{"seed": 7}'), file("text"), file("source")).cast("binary"), 256), 1, 16).alias("run_id"))


@query("sch_34_sized_types", "SELECT 'p_name' AS col, 'VARCHAR(' || least(512, greatest(32, max(length(p_name)) + 8)) || ')' AS sql_type FROM part UNION ALL SELECT 'p_size', 'INTEGER' UNION ALL SELECT 'p_retailprice', 'DECIMAL' UNION ALL SELECT 'flag', 'BOOLEAN' UNION ALL SELECT 'day', 'DATE' UNION ALL SELECT 'blank', 'VARCHAR(255)'")
def _(s, d):
    p = table(s, d, "part")
    price = F.concat(F.floor("p_retailprice").cast("string"), F.lit(".5"))
    cells = {"p_name": F.col("p_name"), "p_size": F.col("p_size").cast("string"), "p_retailprice": price, "flag": (F.col("p_size") > 20).cast("string"), "day": F.lit("2024-01-02"), "blank": F.lit(" ")}
    long = p.select(F.inline(F.array(*(F.struct(F.lit(k).alias("col"), v.alias("v")) for k, v in cells.items()))))
    return schemas.sized_types(long, "col", "v")


@query("srt_10_greedy_spans")
def _(s, d):
    spans = table(s, d, "lineitem").select("l_orderkey", (F.col("l_partkey") % 60).alias("a"), (F.col("l_partkey") % 60 + 5 + F.col("l_linenumber")).alias("b"), F.col("l_quantity").cast("double").alias("score"))
    return W.greedy_spans(spans, "l_orderkey", "a", "b", "score")


@query("tok_07_magic_prime", "WITH n AS (SELECT sum(octet_length(encode(text)))::BIGINT // 1024 AS n FROM documents), c AS (SELECT unnest(range(greatest(2, n - 2000), n + 1)) AS k FROM n) SELECT max(k) AS prime FROM c WHERE k % 3 = 2 AND NOT EXISTS (SELECT 1 FROM range(2, 40000) t(q) WHERE q * q <= k AND k % q = 0)")
def _(s, d):
    """The largest prime with rest 2 modulo 3 that is not above the number of windows."""
    n = table(s, d, "documents").agg(F.floor(F.sum(F.octet_length(F.col("text").cast("binary"))) / 1024).cast("long").alias("n")).first().n
    prime = lambda k: k > 1 and all(k % q for q in range(2, int(k**0.5) + 1))
    return s.createDataFrame([(next((k for k in range(n, 1, -1) if k % 3 == 2 and prime(k)), None),)], "prime long")
