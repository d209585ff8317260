"""Queries of schemas, constraints, screens, serialisation, sources and sinks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from marlstone.functions import hashing as H
from marlstone.functions.text import EDGE, words
from marlstone.operators import joins as J
from marlstone.operators import schemas as C
from marlstone.operators import windows as X
from marlstone.operators.windows import first_rows, running
from marlstone.plans.catalog import query
from marlstone.sources import io
from marlstone.storage import scratch, table

# ---- schemas


@query(
    "sch_01_02_types",
    r"""WITH cells AS (SELECT 'c_acctbal' AS col, trim(c_acctbal::VARCHAR) AS v FROM customer UNION ALL SELECT 'c_custkey', c_custkey::VARCHAR FROM customer UNION ALL SELECT 'c_mktsegment', trim(c_mktsegment) FROM customer UNION ALL SELECT 'c_name', trim(c_name) FROM customer)
SELECT col, CASE WHEN bool_and(regexp_matches(v, '^[+-]?\d+$')) FILTER (v <> '') THEN 'integer' WHEN bool_and(regexp_matches(v, '^[+-]?\d+(\.\d+)?$')) FILTER (v <> '') THEN 'decimal' WHEN bool_and(lower(v) IN ('true', 'false', 'yes', 'no')) FILTER (v <> '') THEN 'boolean'
WHEN bool_and(regexp_matches(v, '^\d{4}-\d{2}-\d{2}$')) FILTER (v <> '') THEN 'date' WHEN bool_and(regexp_matches(v, '^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}')) FILTER (v <> '') THEN 'timestamp' ELSE 'text' END AS sql_type,
CASE WHEN count(*) FILTER (v <> '') = 0 THEN 'Empty' WHEN avg(coalesce(regexp_matches(v, '^[+-]?\d+(\.\d+)?$|^\d{4}-\d{2}-\d{2}$') OR lower(v) IN ('true', 'false', 'yes', 'no'), false)::INT) >= 0.6 THEN 'Data' ELSE 'Class' END AS kind FROM cells GROUP BY col""",
)
def _(s, d):
    c = table(s, d, "customer")
    cells = J.unpivot_values(c.withColumn("k", F.col("c_custkey")), "k", ["c_acctbal", "c_custkey", "c_mktsegment", "c_name"]).withColumnRenamed("attribute", "col")
    return C.infer_types(cells, "col", "value").select("col", "sql_type", "kind")


@query("sch_05_23_24_ri", "SELECT 'lineitem.l_orderkey' AS fk, (SELECT count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)) AS orphans UNION ALL SELECT 'orders.o_custkey', (SELECT count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)) UNION ALL SELECT 'labels.doc_id+500', (SELECT count(*) FROM labels WHERE doc_id + 500 NOT IN (SELECT doc_id FROM documents))")
def _(s, d):
    cases = [("lineitem.l_orderkey", table(s, d, "lineitem").select("l_orderkey"), table(s, d, "orders").select("o_orderkey")), ("orders.o_custkey", table(s, d, "orders").select("o_custkey"), table(s, d, "customer").select("c_custkey")), ("labels.doc_id+500", table(s, d, "labels").select(F.col("doc_id") + 500), table(s, d, "documents").select("doc_id"))]
    out = None
    for name, facts, dims in cases:
        one = J.orphans(facts.toDF("fk"), "fk", dims.toDF("pk"), "pk").agg(F.lit(name).alias("fk"), F.count("*").alias("orphans"))
        out = one if out is None else out.union(one)
    return out


@query("sch_09_ddl", "SELECT 'CREATE TABLE region (r_regionkey INT, r_name STRING)' AS ddl")
def _(s, d):
    return s.createDataFrame([(C.create_table("region", table(s, d, "region").schema),)], "ddl string")


@query("sch_11_sql_features", "SELECT p_partkey, p_size % 4 AS joins, (p_partkey % 2)::INT AS groups FROM part")
def _(s, d):
    join = F.repeat(F.lit(" join u on x"), F.col("p_size") % 4)
    made = F.concat(F.lit("select k from t"), join, F.when(F.col("p_partkey") % 2 == 1, " group by k").otherwise(""))
    df = table(s, d, "part").select("p_partkey", made.alias("q"))
    return df.select("p_partkey", F.regexp_count("q", F.lit(r"(?i)\bjoin\b")).alias("joins"), F.regexp_count("q", F.lit(r"(?i)\bgroup by\b")).alias("groups"))


@query("sch_13_14_junction", "SELECT DISTINCT l_partkey, l_suppkey FROM lineitem")
def _(s, d):
    return table(s, d, "lineitem").select("l_partkey", "l_suppkey").distinct()


@query("sch_15_star", "SELECT p_partkey, dense_rank() OVER (ORDER BY p_brand) - 1 AS brand_key FROM part")
def _(s, d):
    dim = C.dimension(table(s, d, "part"), ["p_brand"], "brand_key")
    return table(s, d, "part").join(dim, "p_brand").select("p_partkey", "brand_key")


@query("sch_16_lookup", "SELECT o_orderkey, dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS code FROM orders")
def _(s, d):
    dim = C.dimension(table(s, d, "orders"), ["o_orderpriority"], "code")
    return table(s, d, "orders").join(dim, "o_orderpriority").select("o_orderkey", "code")


@query("sch_17_wide_names", "WITH m AS (SELECT DISTINCT p_brand AS member, string_split(p_name, ' ')[1] || CASE WHEN p_size <= 3 THEN p_partkey::VARCHAR ELSE '' END AS col FROM part) SELECT member, col, CASE WHEN count(*) OVER (PARTITION BY col) > 1 THEN member || '_' || col ELSE col END AS wide FROM m")
def _(s, d):
    col = F.concat(F.split("p_name", " ")[0], F.when(F.col("p_size") <= 3, F.col("p_partkey").cast("string")).otherwise(""))
    df = table(s, d, "part").select(F.col("p_brand").alias("member"), col.alias("col")).distinct()
    shared = df.groupBy("col").agg(F.count("*").alias("n"))
    return df.join(shared, "col").select("member", "col", F.when(F.col("n") > 1, F.concat_ws("_", "member", "col")).otherwise(F.col("col")).alias("wide"))


@query("sch_18_19_synthesis", "SELECT o_orderkey AS pk, ('0x' || sha256('fk:' || o_orderkey)[1:12])::BIGINT % (SELECT count(*) FROM nation) AS fk FROM orders")
def _(s, d):
    parents = table(s, d, "nation").agg(F.count("*").alias("n"))  # one row
    return table(s, d, "orders").crossJoin(F.broadcast(parents)).select(F.col("o_orderkey").alias("pk"), (H.draw(F.col("o_orderkey"), "fk") % F.col("n")).alias("fk"))


@query("sch_20_precedence", "SELECT p_partkey, coalesce(CASE WHEN p_size < 5 THEN 'enum' END, CASE WHEN p_size < 10 THEN 'typed' END, CASE WHEN p_size < 40 THEN p_name END, 'placeholder') AS v FROM part")
def _(s, d):
    z = F.col("p_size")
    return table(s, d, "part").select("p_partkey", F.coalesce(F.when(z < 5, "enum"), F.when(z < 10, "typed"), F.when(z < 40, F.col("p_name")), F.lit("placeholder")).alias("v"))


@query("sch_21_30_31_key_names", "SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'bare_id' WHEN 1 THEN 'table_id' WHEN 2 THEN CASE WHEN string_split(p_name, ' ')[1] = string_split(p_name, ' ')[-1] THEN 'table_id' ELSE 'other_id' END WHEN 3 THEN 'other_id' ELSE 'natural' END AS shape FROM part")
def _(s, d):
    words_of = F.split("p_name", " ")
    first, last = F.element_at(words_of, 1), F.element_at(words_of, -1)
    names = F.array(F.lit("ID"), F.concat(last, F.lit("_id")), F.concat(first, F.lit("_id")), F.concat(F.lit("parent_"), last, F.lit("_id")), F.concat(first, F.lit("_key")), F.lit("uuid"))
    return table(s, d, "part").select("p_partkey", C.key_shape(F.element_at(names, (F.col("p_partkey") % 6 + 1).cast("int")), last).alias("shape"))


@query(
    "sch_25_convention",
    "SELECT 'n_regionkey' AS fk, 'region' AS target, (SELECT count(*) FROM nation WHERE n_regionkey NOT IN (SELECT r_regionkey FROM region)) AS orphans UNION ALL SELECT 'c_nationkey', 'nation', (SELECT count(*) FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation))",
)
def _(s, d):
    a = J.orphans(table(s, d, "nation"), "n_regionkey", table(s, d, "region"), "r_regionkey").agg(F.lit("n_regionkey").alias("fk"), F.lit("region").alias("target"), F.count("*").alias("orphans"))
    return a.union(J.orphans(table(s, d, "customer"), "c_nationkey", table(s, d, "nation"), "n_nationkey").agg(F.lit("c_nationkey"), F.lit("nation"), F.count("*")))


@query("sch_29_rename", "SELECT r_regionkey AS region_id, r_name AS title FROM region")
def _(s, d):
    return table(s, d, "region").withColumnsRenamed({"r_regionkey": "region_id", "r_name": "title"})


@query(
    "sch_32_33_utility",
    r"""WITH cells AS (SELECT 'l_returnflag' AS col, trim(l_returnflag) AS v FROM lineitem UNION ALL SELECT 'l_linenumber', l_linenumber::VARCHAR FROM lineitem UNION ALL SELECT 'zero', '0' FROM lineitem)
SELECT col, CASE WHEN count(*) FILTER (v <> '') = 0 THEN 'empty' WHEN bool_and(regexp_matches(v, '^(?i:tbd|n/a|na|none|null|todo|xxx+|-+|\{.*\})$')) FILTER (v <> '') THEN 'placeholder' WHEN min(v) FILTER (v <> '') = max(v) FILTER (v <> '') THEN 'constant' ELSE 'informative' END AS class FROM cells GROUP BY col""",
)
def _(s, d):
    cells = J.unpivot_values(table(s, d, "lineitem").withColumn("zero", F.lit(0)).withColumn("k", F.col("l_orderkey")), "k", ["l_returnflag", "l_linenumber", "zero"]).withColumnRenamed("attribute", "col")
    return C.column_class(cells, "col", "value").select("col", "class")


@query("sch_35_generic_names", "SELECT p_partkey, replace(p_brand, 'Brand#', 'make ') AS generic FROM part")
def _(s, d):
    return table(s, d, "part").select("p_partkey", F.regexp_replace("p_brand", "Brand#", "make ").alias("generic"))


@query("sch_36_global_names", "SELECT p_partkey, p_name || CASE WHEN row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) > 1 THEN '_' || row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) ELSE '' END AS name FROM part")
def _(s, d):
    r = F.row_number().over(Window.partitionBy("p_name").orderBy("p_partkey"))
    return table(s, d, "part").select("p_partkey", "p_name", r.alias("r")).select("p_partkey", F.concat("p_name", F.when(F.col("r") > 1, F.concat(F.lit("_"), F.col("r").cast("string"))).otherwise("")).alias("name"))


@query("sch_37_38_answer_key", "SELECT n_nationkey, r_name AS code, count(*) OVER (PARTITION BY n_nationkey) > 1 AS duplicate FROM nation JOIN region ON n_regionkey = r_regionkey")
def _(s, d):
    met = table(s, d, "nation").join(table(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return met.select("n_nationkey", F.col("r_name").alias("code"), (F.count("*").over(Window.partitionBy("n_nationkey")) > 1).alias("duplicate"))


# ---- screens


@query("dq_01_04_terms", r"SELECT doc_id, len(regexp_extract_all(text, '\b(Apache|GNU|MIT|CC)\b')) AS hits FROM documents WHERE regexp_matches(text, '\b(Apache|GNU|MIT|CC)\b')")
def _(s, d):
    p = f"{EDGE}(Apache|GNU|MIT|CC){EDGE}"
    return table(s, d, "documents").where(F.col("text").rlike(p)).select("doc_id", F.regexp_count("text", F.lit(p)).alias("hits"))


@query("dq_02_membrane", "SELECT p_brand, CASE WHEN count(*) < 5 THEN 'few' WHEN count(DISTINCT p_name) / count(*) < 0.9 THEN 'repeats' ELSE 'ok' END AS reason FROM part GROUP BY 1")
def _(s, d):
    n = F.count("*")
    return table(s, d, "part").groupBy("p_brand").agg(F.when(n < 5, "few").when(F.count_distinct("p_name") / n < 0.9, "repeats").otherwise("ok").alias("reason"))


@query("dq_03_09_claims", "SELECT p_name, count(*) AS n FROM part WHERE p_name NOT IN (SELECT p_name FROM part WHERE p_partkey % 50 = 0) GROUP BY 1")
def _(s, d):
    backed = table(s, d, "part").where("p_partkey % 50 = 0").select("p_name").distinct()
    return table(s, d, "part").join(backed, "p_name", "left_anti").groupBy("p_name").agg(F.count("*").alias("n"))


@query("dq_06_07_shapes", r"SELECT lang, count(*) FILTER (regexp_matches(text, '[\w.]+@[\w.]+\.[a-z]{2,}')) AS mails, count(*) FILTER (regexp_matches(text, '\(\d{3}\) \d{3}-\d{4}')) AS phones FROM documents GROUP BY 1")
def _(s, d):
    hit = lambda p: F.count_if(F.col("text").rlike(p))
    return table(s, d, "documents").groupBy("lang").agg(hit(r"[\w.]+@[\w.]+\.[a-z]{2,}").alias("mails"), hit(r"\(\d{3}\) \d{3}-\d{4}").alias("phones"))


@query("dq_08_filler", "SELECT source, count(*) FILTER (contains(lower(text), 'all rights')) >= 2 AS dropped FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents) WHERE r <= 40 GROUP BY 1")
def _(s, d):
    first = first_rows(table(s, d, "documents").select("source", "doc_id", "text"), ["source"], ["doc_id"], 40)
    return first.groupBy("source").agg((F.count_if(F.contains(F.lower("text"), F.lit("all rights"))) >= 2).alias("dropped"))


@query("dq_10_notation", "SELECT p_partkey, p_partkey % 5 NOT IN (3, 4) AS ok FROM part")
def _(s, d):
    """A child's notation is its parent's, or that and a point and more; without a parent any will do. Here 3 is another branch and 4 lacks the point."""
    own, k = F.col("p_size").cast("string"), F.col("p_partkey") % 5
    child = F.when(k == 0, F.concat(own, F.lit(".2"))).when(k == 1, own).when(k == 2, "x").when(k == 3, F.concat(F.lit("0."), own)).otherwise(F.concat(own, F.lit("2")))
    df = table(s, d, "part").select("p_partkey", child.alias("child"), F.when(k != 2, own).alias("parent"))
    ok = F.col("parent").isNull() | (F.col("child") == F.col("parent")) | F.col("child").startswith(F.concat("parent", F.lit(".")))
    return df.select("p_partkey", ok.alias("ok"))


@query("dq_11_common_values", "SELECT p_name, count(DISTINCT p_brand) AS brands FROM part GROUP BY 1 HAVING count(DISTINCT p_brand) >= 10")
def _(s, d):
    return table(s, d, "part").groupBy("p_name").agg(F.count_distinct("p_brand").alias("brands")).where("brands >= 10")


@query("dq_12_slots", "WITH p AS (SELECT p_partkey, string_split(p_name, ' ')[1] AS a, string_split(p_name, ' ')[-1] AS b, lower(p_type) AS c FROM part) SELECT p_partkey, a AS slot, 'missing' AS error FROM p WHERE a NOT IN (b, c) UNION ALL SELECT p_partkey, c, 'unused' FROM p WHERE c NOT IN (a, b)")
def _(s, d):
    words_of = F.split("p_name", " ")
    text = F.format_string("x {%s} and {%s}", F.element_at(words_of, 1), F.element_at(words_of, -1))
    p = table(s, d, "part").select("p_partkey", F.regexp_extract_all(text, F.lit(r"\{(\w+)\}"), F.lit(1)).alias("used"), F.array(F.element_at(words_of, -1), F.lower("p_type")).alias("declared"))
    wrong = lambda a, b, name: F.transform(F.array_except(a, b), lambda x: F.struct(x.alias("slot"), F.lit(name).alias("error")))
    return p.select("p_partkey", F.inline(F.concat(wrong("used", "declared", "missing"), wrong("declared", "used", "unused"))))


# ---- synthetic statements


@query("syn_01_04_statements", "SELECT c_nationkey, c_mktsegment, round(sum(c_acctbal), 2) AS value, round(sum(c_acctbal), 2) > 10000 AS label FROM customer GROUP BY 1, 2")
def _(s, d):
    v = F.round(F.sum("c_acctbal"), 2)
    return table(s, d, "customer").groupBy("c_nationkey", "c_mktsegment").agg(v.alias("value"), (v > 10000).alias("label"))


@query("syn_05_swap", "SELECT p_partkey, replace('a ' || p_name || ' of ' || p_type, p_type, CASE WHEN p_type = 'PROMO' THEN 'ECONOMY' ELSE 'PROMO' END) AS swapped FROM part")
def _(s, d):
    text = F.concat_ws(" ", F.lit("a"), "p_name", F.lit("of"), "p_type")
    other = F.when(F.col("p_type") == "PROMO", "ECONOMY").otherwise("PROMO")
    return table(s, d, "part").select("p_partkey", F.replace(text, F.col("p_type"), other).alias("swapped"))


@query("syn_07_typed_table", "SELECT c_custkey AS id, 'item_' || c_custkey % 7 AS label, ('0x' || sha256('v:' || c_custkey)[1:12])::BIGINT % 1000 / 10.0 AS v FROM customer")
def _(s, d):
    k = F.col("c_custkey")
    return table(s, d, "customer").select(k.alias("id"), F.concat(F.lit("item_"), (k % 7).cast("string")).alias("label"), (H.draw(k, "v") % 1000 / 10.0).alias("v"))


# ---- bytes, serialisation, mixtures


@query("tok_01_bytes", "SELECT p_partkey, strlen(p_name)::INT AS n, (ascii(p_name) + 16)::INT AS first FROM part")
def _(s, d):
    ids = X.byte_ids(F.col("p_name"))
    return table(s, d, "part").select("p_partkey", F.size(ids).alias("n"), F.get(ids, F.lit(0)).alias("first"))


@query("tok_02_03_serialise", "SELECT p_brand, string_agg(p_name, ' | ' ORDER BY p_partkey) AS line FROM (SELECT *, sum(length(p_name) + 3) OVER (PARTITION BY p_brand ORDER BY p_partkey) AS used FROM part) WHERE used <= 200 GROUP BY 1")
def _(s, d):
    used = F.sum(F.length("p_name") + 3).over(Window.partitionBy("p_brand").orderBy("p_partkey"))
    cells = table(s, d, "part").withColumn("used", used).where("used <= 200")
    return cells.groupBy("p_brand").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("p_partkey", "p_name"))), lambda x: x["p_name"]), " | ").alias("line"))


@query("tok_04_mixture", "SELECT lang, round(n * w / sum(n * w) OVER (), 6) AS share FROM (SELECT lang, count(*) AS n, CASE lang WHEN 'en' THEN 1.0 ELSE 2.0 END AS w FROM documents GROUP BY 1)")
def _(s, d):
    w = F.when(F.col("lang") == "en", 1.0).otherwise(2.0)
    n = table(s, d, "documents").groupBy("lang").agg(F.count("*").alias("n")).select("lang", (F.col("n") * w).alias("x"))
    return n.select("lang", F.round(F.col("x") / F.sum("x").over(Window.partitionBy()), 6).alias("share"))


@query("tok_05_windows", "SELECT doc_id, i // 256 AS ix, length(text[i + 1:i + 257]) AS n FROM (SELECT doc_id, text, unnest(range(0, length(text), 256)) AS i FROM documents)")
def _(s, d):
    docs = table(s, d, "documents").where(F.length("text") > 0)
    return X.overlapping(docs, "doc_id", "text", 256).select("doc_id", F.col("ix").cast("long").alias("ix"), F.length("piece").cast("long").alias("n"))


@query("tok_06_duplication", "SELECT doc_id, copy FROM documents, range(0, 3) r(copy) WHERE copy < CASE lang WHEN 'de' THEN 3 WHEN 'fr' THEN 2 ELSE 1 END")
def _(s, d):
    factor = F.when(F.col("lang") == "de", 3).when(F.col("lang") == "fr", 2).otherwise(1)
    return table(s, d, "documents").select("doc_id", F.explode(F.sequence(F.lit(0).cast("long"), (factor - 1).cast("long"))).alias("copy"))


@query("tok_08_eval_slices", "SELECT doc_id, lang FROM (SELECT doc_id, lang, coalesce(sum(n_chars) OVER (PARTITION BY lang ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM documents) WHERE before < 20000")
def _(s, d):
    docs = running(table(s, d, "documents").select("lang", "doc_id", "n_chars"), ["lang"], [F.col("doc_id")], {"before": ("sum", "n_chars")})
    return docs.where(F.coalesce("before", F.lit(0)) < 20000).select("doc_id", "lang")


# ---- document windows


@query("doc_01_03_windows", r"SELECT doc_id, greatest(1, ceil((len(w) - 512) / 256.0)::INT + 1) AS n FROM (SELECT doc_id, regexp_extract_all(text, '[\p{L}\p{N}_]+') AS w FROM documents) WHERE len(w) > 0")
def _(s, d):
    n = F.size(X.token_windows(F.size(words(F.col("text"))), 512, 256))
    return table(s, d, "documents").where(F.size(words(F.col("text"))) > 0).select("doc_id", n.alias("n"))


@query("doc_04_06_non_overlap")
def _(s, d):
    spans = table(s, d, "events").select("user_id", (F.col("event_id") % 500).alias("start"), (F.col("event_id") % 500 + 20).alias("end"), F.col("value").alias("margin"))
    return X.greedy_spans(spans, "user_id", "start", "end", "margin")


@query("doc_10_admission", "SELECT source, bool_or(n_chars > 5000) AS admitted, max(n_chars) AS best FROM documents GROUP BY 1")
def _(s, d):
    return table(s, d, "documents").groupBy("source").agg(F.bool_or(F.col("n_chars") > 5000).alias("admitted"), F.max("n_chars").alias("best"))


@query("doc_11_composite", "SELECT doc_id, CASE WHEN s >= 0.6 THEN 'accept' WHEN s >= 0.3 THEN 'review' ELSE 'reject' END AS status FROM (SELECT doc_id, CASE WHEN toxic = 1 AND quality = 0 THEN 0 ELSE sqrt((0.2 + 0.7 * quality) * (1 - 0.6 * toxic)) END AS s FROM labels)")
def _(s, d):
    score = F.when((F.col("toxic") == 1) & (F.col("quality") == 0), 0.0).otherwise(F.sqrt((0.2 + 0.7 * F.col("quality")) * (1 - 0.6 * F.col("toxic"))))
    return table(s, d, "labels").select("doc_id", F.when(score >= 0.6, "accept").when(score >= 0.3, "review").otherwise("reject").alias("status"))


@query("doc_12_18_mentions", r"SELECT doc_id, contains(text, 'License') OR contains(text, 'rights') AS mentioned, len(regexp_extract_all(text, '\{[^}]*\}|\bTBD\b')) AS placeholders FROM documents")
def _(s, d):
    keywords = F.array(F.lit("License"), F.lit("rights"))
    return table(s, d, "documents").select("doc_id", F.exists(keywords, lambda k: F.contains("text", k)).alias("mentioned"), F.regexp_count("text", F.lit(rf"\{{[^}}]*\}}|{EDGE}TBD{EDGE}")).alias("placeholders"))


@query("doc_15_fidelity", "SELECT count(*) AS pairs, count(*) FILTER (contains('small ring red widget', p_name)) AS found FROM part")
def _(s, d):
    return table(s, d, "part").agg(F.count("*").alias("pairs"), F.count_if(F.contains(F.lit("small ring red widget"), F.col("p_name"))).alias("found"))


@query("doc_19_20_report", "SELECT lang, count(*) AS n, round(avg(n_chars), 4) AS mean_chars, count(DISTINCT text) AS distinct_texts FROM documents GROUP BY 1")
def _(s, d):
    return table(s, d, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.round(F.avg("n_chars"), 4).alias("mean_chars"), F.count_distinct(F.sha2(F.col("text").cast("binary"), 256)).alias("distinct_texts"))


# ---- sources and sinks


@query("src_01_03_budget", "SELECT doc_id FROM (SELECT doc_id, coalesce(sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM documents) WHERE before < 10000")
def _(s, d):
    docs = running(table(s, d, "documents").select("source", "doc_id", "n_chars"), ["source"], [F.col("doc_id")], {"before": ("sum", "n_chars")})
    return docs.where(F.coalesce("before", F.lit(0)) < 10000).select("doc_id")


@query("src_07_csv_round_trip", "SELECT n_nationkey, n_name FROM nation")
def _(s, d):
    path = scratch(s, "csv")
    io.write_csv(table(s, d, "nation").select("n_nationkey", "n_name"), path)
    return io.read_csv(s, path, "n_nationkey int, n_name string")


@query("src_08_json_lines", "SELECT c_custkey, c_name FROM customer")
def _(s, d):
    path = scratch(s, "jsonl")
    io.write_json_lines(table(s, d, "customer").select("c_custkey", "c_name"), path)
    return io.read_json_lines(s, path, "c_custkey long, c_name string")


@query("src_11_delimited_text", "SELECT count(*) AS n, sum(length(trim(text, chr(3) || chr(10)))) AS chars FROM documents WHERE length(text) >= 200")
def _(s, d):
    path = scratch(s, "delimited")
    io.write_delimited(table(s, d, "documents").where(F.length("text") >= 200), "text", path)
    return io.read_delimited(s, path).agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


@query("src_12_cursor_window", "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS r FROM documents WHERE length(text) >= 500) WHERE r BETWEEN 101 AND 150")
def _(s, d):
    return io.cursor_window(table(s, d, "documents").where(F.length("text") >= 500), "doc_id", 100, 50).select("doc_id")


@query("src_10_json_column", "SELECT event_id, (props->>'$.k')::INT AS k FROM events")
def _(s, d):
    return table(s, d, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


@query("src_30_32_postings", "SELECT 'V' AS kind, p_name AS token, 'part:p_name' AS lineage, count(*) AS n FROM part WHERE length(p_name) BETWEEN 2 AND 64 GROUP BY 2 UNION ALL SELECT 'C', 'p_name', 'part', 1")
def _(s, d):
    return io.postings(table(s, d, "part"), "part", ["p_name"])


@query("snk_01_02_parquet", "SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY 1")
def _(s, d):
    path = scratch(s, "sharded")
    io.write_parquet(table(s, d, "lineitem"), path, rows_per_file=20_000)
    return s.read.parquet(path).groupBy("l_returnflag").agg(F.count("*").alias("n"))


@query("snk_03_split", "SELECT doc_id, row_number() OVER (ORDER BY ('0x' || sha256('val:' || doc_id)[1:12])::BIGINT, doc_id) <= greatest(1, floor((SELECT count(*) FROM documents) * 0.1)) AS val FROM documents")
def _(s, d):
    return io.exact_split(table(s, d, "documents").select("doc_id"), "doc_id", 0.1, "val")


@query("snk_04_byte_chunks", "SELECT doc_id, i AS chunk, strlen(text) - i * 1024 >= 1024 AS full FROM (SELECT doc_id, text, unnest(range(0, greatest(1, ceil(strlen(text) / 1024.0)::INT))) AS i FROM documents) WHERE i = 0 OR strlen(text) - i * 1024 >= 64")
def _(s, d):
    return X.byte_chunks(table(s, d, "documents"), "doc_id", "text", 1024, 64).select("doc_id", F.col("chunk").cast("long").alias("chunk"), (F.octet_length("piece") >= 1024).alias("full"))


@query("snk_13_15_overwrite", "SELECT n_regionkey, count(*) AS n FROM nation GROUP BY 1")
def _(s, d):
    path = scratch(s, "rebuilt")
    for _ in range(2):  # a full rebuild leaves one copy
        table(s, d, "nation").write.mode("overwrite").parquet(path)
    return s.read.parquet(path).groupBy("n_regionkey").agg(F.count("*").alias("n"))


# ---- read models and governance


@query("api_01_03_leaderboard", "SELECT user_id AS run, max(event_id) AS newest, count(*) AS n FROM events GROUP BY 1 ORDER BY newest DESC, run LIMIT 20")
def _(s, d):
    return table(s, d, "events").groupBy(F.col("user_id").alias("run")).agg(F.max("event_id").alias("newest"), F.count("*").alias("n")).orderBy(F.desc("newest"), "run").limit(20)


@query("api_07_subsumption", "SELECT p_partkey, CASE WHEN contains(p_name, 'ring') THEN 0.9 WHEN contains(p_name, 'red') THEN 0.5 ELSE 0.05 END::DOUBLE AS score FROM part")
def _(s, d):
    n = F.col("p_name")
    return table(s, d, "part").select("p_partkey", F.when(F.contains(n, F.lit("ring")), 0.9).when(F.contains(n, F.lit("red")), 0.5).otherwise(0.05).alias("score"))


@query("api_11_lists", "SELECT DISTINCT source FROM documents")
def _(s, d):
    return table(s, d, "documents").select("source").distinct()


@query("orc_03_stage_key", "SELECT n_regionkey, sha256(string_agg(x, '|' ORDER BY x))[1:12] AS key FROM (SELECT n_regionkey, n_name || ':' || sha256(n_name)[1:8] AS x FROM nation) GROUP BY 1")
def _(s, d):
    """A stage's key from its inputs' names and hashes: a region is a stage, its nations are the inputs (few for any stage)."""
    one = F.concat_ws(":", "n_name", F.substring(F.sha2(F.col("n_name").cast("binary"), 256), 1, 8))
    listed = F.array_join(F.sort_array(F.collect_list(one)), "|")
    return table(s, d, "nation").groupBy("n_regionkey").agg(F.substring(F.sha2(listed.cast("binary"), 256), 1, 12).alias("key"))


@query("orc_05_matrix", "SELECT DISTINCT c_mktsegment, r_name FROM customer, region")
def _(s, d):
    return table(s, d, "customer").select("c_mktsegment").distinct().crossJoin(F.broadcast(table(s, d, "region").select("r_name")))  # two short dimensions


@query("orc_10_mask", r"SELECT c_custkey, regexp_replace(regexp_replace(regexp_replace(c_name, '[A-Z]', 'X', 'g'), '[a-z]', 'x', 'g'), '[0-9]', 'n', 'g') AS masked FROM customer")
def _(s, d):
    return table(s, d, "customer").select("c_custkey", F.mask("c_name").alias("masked"))


@query("orc_11_gate", "SELECT source, bool_and(coalesce(quality = 1, false)) AS publish FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1")
def _(s, d):
    met = table(s, d, "documents").select("doc_id", "source").join(table(s, d, "labels"), "doc_id", "left")
    return met.groupBy("source").agg(F.every(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("publish"))


@query("udf_05_rules", "SELECT p_partkey, CASE WHEN p_size > 40 THEN 'large' WHEN p_type = 'PROMO' THEN 'promo' ELSE 'plain' END AS rule FROM part")
def _(s, d):
    rules = [(2, 1, 0, "large", F.col("p_size") > 40), (1, 2, 1, "promo", F.col("p_type") == "PROMO"), (0, 0, 2, "plain", F.lit(True))]
    ordered = sorted(rules, key=lambda r: (-r[0], -r[1], r[2]))
    return table(s, d, "part").select("p_partkey", F.coalesce(*(F.when(c, name) for *_, name, c in ordered)).alias("rule"))
