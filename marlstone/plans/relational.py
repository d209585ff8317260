"""Queries of filters, joins, sets, windows, sorts and samples."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from marlstone.functions import hashing as H
from marlstone.functions.text import EDGE
from marlstone.operators import joins as J
from marlstone.operators.windows import running
from marlstone.plans.catalog import query
from marlstone.storage import table

# ---- filters and projections


@query("fil_01_equality", "SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING'")
def _(s, d):
    return table(s, d, "customer").where("c_mktsegment = 'BUILDING'").select("c_custkey", "c_name")


@query("fil_02_tolerant_numbers", "SELECT l_orderkey, l_linenumber, l_discount < 0.05 AS lt, l_discount <= 0.05 OR abs(l_discount - 0.05) <= 1e-6 * greatest(abs(l_discount), 0.05) AS le, abs(l_discount - 0.05) <= 1e-6 * greatest(abs(l_discount), 0.05) AS eq FROM lineitem")
def _(s, d):
    x = F.col("l_discount")
    near = F.abs(x - 0.05) <= 1e-6 * F.greatest(F.abs(x), F.lit(0.05))
    return table(s, d, "lineitem").select("l_orderkey", "l_linenumber", (x < 0.05).alias("lt"), ((x <= 0.05) | near).alias("le"), near.alias("eq"))


@query("fil_03_keyword", "SELECT p_partkey FROM part WHERE contains(' ' || p_name || ' ', ' ring ')")
def _(s, d):
    return table(s, d, "part").where(F.contains(F.concat(F.lit(" "), "p_name", F.lit(" ")), F.lit(" ring "))).select("p_partkey")


@query("fil_04_flag", "SELECT doc_id FROM labels WHERE toxic = 1")
def _(s, d):
    return table(s, d, "labels").where("toxic = 1").select("doc_id")


@query("fil_05_range_and_terms", "SELECT p_partkey, p_name FROM part WHERE p_size BETWEEN 10 AND 30 AND (contains(lower(p_name), 'red') OR contains(lower(p_name), 'small'))")
def _(s, d):
    terms = F.array(F.lit("red"), F.lit("small"))
    return table(s, d, "part").where(F.col("p_size").between(10, 30) & F.exists(terms, lambda t: F.contains(F.lower("p_name"), t))).select("p_partkey", "p_name")


@query("fil_06_two_stage_keywords", r"SELECT doc_id FROM documents WHERE regexp_matches(text, 'License|rights') AND len(regexp_extract_all(text, '\b(License|Version|reserved|under)\b')) >= 2")
def _(s, d):
    hits = F.regexp_count("text", F.lit(f"{EDGE}(License|Version|reserved|under){EDGE}")) >= 2
    return table(s, d, "documents").where(F.col("text").rlike("License|rights") & hits).select("doc_id")


@query("fil_07_clean_value", "SELECT c_custkey, CASE WHEN v <> '' AND length(v) <= 12 AND NOT regexp_matches(v, '(?i)^(null|none|n/a)$|[<>{}]') THEN v END AS v FROM (SELECT c_custkey, trim(regexp_replace(' \"' || c_mktsegment || '\"  ', '[\"\\s]+', ' ', 'g')) AS v FROM customer)")
def _(s, d):
    v = F.trim(F.regexp_replace(F.concat(F.lit(' "'), "c_mktsegment", F.lit('"  ')), r'["\s]+', " "))
    ok = (v != "") & (F.length(v) <= 12) & ~v.rlike("(?i)^(null|none|n/a)$|[<>{}]")
    return table(s, d, "customer").select("c_custkey", F.when(ok, v).alias("v"))


@query("fil_08_type_gate", "SELECT p_brand, CASE WHEN count(*) FILTER (regexp_matches(p_name, '^[a-z]+ [a-z]+$')) >= greatest(2, count(*) // 3) THEN 'product' END AS gate FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS r FROM part) WHERE r <= 20 GROUP BY 1")
def _(s, d):
    first = table(s, d, "part").withColumn("r", F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey"))).where("r <= 20")
    return first.groupBy("p_brand").agg(F.when(F.count_if(F.col("p_name").rlike("^[a-z]+ [a-z]+$")) >= F.greatest(F.lit(2), F.floor(F.count("*") / 3)), "product").alias("gate"))


@query("fil_09_rejected_values", "SELECT p_partkey, regexp_matches(p_type, '(?i)^(varchar|text|int)$') OR regexp_matches(p_name, '^[a-z]+_[a-z]+_[a-z_]+$') OR len([t FOR t IN string_split(p_name, ' ') IF NOT list_contains(['small', 'ring'], t)]) = 0 AS bad FROM part")
def _(s, d):
    echo = F.size(F.array_except(F.split("p_name", " "), F.array(F.lit("small"), F.lit("ring")))) == 0
    return table(s, d, "part").select("p_partkey", (F.col("p_type").rlike("(?i)^(varchar|text|int)$") | F.col("p_name").rlike("^[a-z]+_[a-z]+_[a-z_]+$") | echo).alias("bad"))


@query("fil_11_subtree", "SELECT n_nationkey FROM nation WHERE list_contains(['1', '2'], n_regionkey::VARCHAR) OR list_contains(['1', '2'], n_regionkey || '.' || n_nationkey)")
def _(s, d):
    roots = F.array(F.lit("1"), F.lit("2"))
    lineage = F.array(F.col("n_regionkey").cast("string"), F.concat_ws(".", F.col("n_regionkey").cast("string"), F.col("n_nationkey").cast("string")))
    return table(s, d, "nation").where(F.arrays_overlap(lineage, roots)).select("n_nationkey")


@query("fil_12_exclusion", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderpriority NOT IN (SELECT * FROM (VALUES ('1-URGENT'), ('2-HIGH')) v(p)) ORDER BY o_totalprice DESC, o_orderkey LIMIT 50")
def _(s, d):
    out = s.createDataFrame([("1-URGENT",), ("2-HIGH",)], "o_orderpriority string")
    return table(s, d, "orders").join(out, "o_orderpriority", "left_anti").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(50).select("o_orderkey", "o_totalprice")


_MAXIMAL = [["A", "N", "R"], ["F", "R"], ["A", "F"], ["O"]]
_PUNCTURED = [["A", "N", "R"]]


@query(
    "fil_13_14_closure",
    """WITH o AS (SELECT list_sort(list_distinct(list(l_returnflag) || list(l_linestatus))) AS s FROM lineitem GROUP BY l_orderkey), c AS (SELECT s, count(*) AS n FROM o GROUP BY 1),
    f AS (SELECT s, n, [s[i] FOR i IN range(1, len(s) + 1) IF (b >> (i - 1)) & 1 = 1] AS face FROM c, range(1, 32) t(b) WHERE b < 2 ** len(s)),
    a AS (SELECT *, face <> ['A', 'N', 'R'] AND (list_has_all(['A', 'N', 'R'], face) OR list_has_all(['F', 'R'], face) OR list_has_all(['A', 'F'], face) OR list_has_all(['O'], face)) AS ok FROM f)
    SELECT array_to_string(s, ',') AS flags, any_value(n) AS n, bool_or(ok AND len(face) = len(a.s)) AS allowed, arg_min(array_to_string(face, ','), printf('%d', 9 - len(face)) || array_to_string(face, ',')) FILTER (ok) AS face FROM a GROUP BY a.s""",
)
def _(s, d):
    """Orders' sets of line flags against a closure: which are allowed, and the largest allowed part of each. Flags are five, so are a set's members at most."""
    flags = F.sort_array(F.array_union(F.collect_set("l_returnflag"), F.collect_set("l_linestatus")))
    sets = table(s, d, "lineitem").groupBy("l_orderkey").agg(flags.alias("s")).groupBy("s").agg(F.count("*").alias("n"))
    maximal, punctured = (F.array(*(F.array(*map(F.lit, m)) for m in ms)) for ms in (_MAXIMAL, _PUNCTURED))

    def allowed(x):
        return F.exists(maximal, lambda m: F.size(F.array_except(x, m)) == 0) & ~F.exists(punctured, lambda p: F.array_sort(x) == p)

    faces = sets.select("s", F.explode(F.sequence(F.lit(1), (F.pow(2, F.size("s")) - 1).cast("int"))).alias("bits"))
    faces = faces.select("s", F.expr("filter(s, (x, k) -> (shiftright(bits, k) & 1) = 1)").alias("face")).where(allowed(F.col("face")))
    best = faces.groupBy("s").agg(F.min_by(F.array_join("face", ","), F.struct(-F.size("face"), F.array_join("face", ","))).alias("face"))
    return sets.join(best, "s", "left").select(F.array_join("s", ",").alias("flags"), "n", allowed(F.col("s")).alias("allowed"), "face")


@query("fil_15_path_safe", r"SELECT c_custkey, regexp_matches(c_name, '^[\p{L}\p{N}_-]{1,64}$') AS safe FROM customer")
def _(s, d):
    return table(s, d, "customer").select("c_custkey", F.col("c_name").rlike(r"^[\p{L}\p{N}_-]{1,64}$").alias("safe"))


@query("fil_16_17_presentation", "SELECT s_name AS a_name, s_acctbal AS a_acctbal, n_name AS b_name FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def _(s, d):
    return table(s, d, "supplier").join(table(s, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_name").alias("a_name"), F.col("s_acctbal").alias("a_acctbal"), F.col("n_name").alias("b_name"))


# ---- joins


@query("joi_01_equi", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def _(s, d):
    return table(s, d, "orders").join(table(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name")


@query("joi_02_view", "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def _(s, d):
    return s.sql("SELECT n_name, r_name FROM {nation} JOIN {region} ON n_regionkey = r_regionkey", nation=table(s, d, "nation"), region=table(s, d, "region"))


@query("joi_03_last_wins", "SELECT c_custkey, o_orderkey AS last_order FROM customer JOIN (SELECT o_custkey, max(o_orderkey) AS o_orderkey FROM orders GROUP BY 1) ON c_custkey = o_custkey")
def _(s, d):
    last = J.last_wins(table(s, d, "orders").select("o_custkey", "o_orderkey", F.col("o_orderkey").alias("order")), "o_custkey", "order")
    return table(s, d, "customer").join(last, F.col("c_custkey") == F.col("o_custkey")).select("c_custkey", F.col("o_orderkey").alias("last_order"))


@query("joi_04_junction", "SELECT l_orderkey, l_linenumber, p_name, s_name FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey")
def _(s, d):
    return table(s, d, "lineitem").join(table(s, d, "part"), F.col("l_partkey") == F.col("p_partkey")).join(table(s, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).select("l_orderkey", "l_linenumber", "p_name", "s_name")


@query("joi_05_eav", "SELECT p_partkey AS entity, 'p_name' AS attribute, p_name AS value FROM part UNION ALL SELECT p_partkey, 'p_size', p_size::VARCHAR FROM part")
def _(s, d):
    return J.unpivot_values(table(s, d, "part"), "p_partkey", ["p_name", "p_size"])


@query("joi_06_star", "SELECT r_name, c_mktsegment, count(*) AS n, sum(l_quantity) AS quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2")
def _(s, d):
    nations = table(s, d, "nation").join(table(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    facts = table(s, d, "lineitem").join(table(s, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return facts.join(nations, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("r_name", "c_mktsegment").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("quantity"))


@query("joi_07_left_default", "SELECT doc_id, coalesce(quality, -1) AS quality FROM documents LEFT JOIN labels USING (doc_id)")
def _(s, d):
    return table(s, d, "documents").select("doc_id").join(table(s, d, "labels"), "doc_id", "left").select("doc_id", F.coalesce("quality", F.lit(-1)).alias("quality"))


@query("joi_08_bridge", "SELECT o_custkey, p_brand AS top1 FROM (SELECT o_custkey, p_brand, row_number() OVER (PARTITION BY o_custkey ORDER BY count(*) DESC, p_brand) AS r FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey GROUP BY 1, 2) WHERE r = 1")
def _(s, d):
    votes = table(s, d, "orders").join(table(s, d, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(s, d, "part"), F.col("p_partkey") == F.col("l_partkey")).groupBy("o_custkey", "p_brand").agg(F.count("*").alias("n"))
    return votes.groupBy("o_custkey").agg(F.min_by("p_brand", F.struct(-F.col("n"), "p_brand")).alias("top1"))


@query("joi_09_semi", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def _(s, d):
    return table(s, d, "customer").join(table(s, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("joi_10_anti", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def _(s, d):
    return table(s, d, "documents").join(table(s, d, "labels"), "doc_id", "left_anti").select("doc_id")


@query("joi_11_containment", "SELECT l_orderkey, bool_and(p_size <= 40) AS closed, count(*) AS n FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1")
def _(s, d):
    items = table(s, d, "lineitem").select("l_orderkey", "l_partkey")
    covered = table(s, d, "part").where("p_size <= 40").select(F.col("p_partkey").alias("l_partkey"))
    return J.containment(items, "l_orderkey", "l_partkey", covered)


@query("joi_12_three_inputs", "SELECT doc_id, quality, lang FROM documents JOIN labels USING (doc_id) JOIN (SELECT DISTINCT conv_id AS doc_id FROM conversations) USING (doc_id)")
def _(s, d):
    convs = table(s, d, "conversations").select(F.col("conv_id").alias("doc_id")).distinct()
    return table(s, d, "documents").join(table(s, d, "labels"), "doc_id").join(convs, "doc_id").select("doc_id", "quality", "lang")


@query("joi_13_multi_key", "SELECT p_partkey, CASE WHEN p_size <= 2 THEN 'by-size' ELSE 'by-type-' || lower(p_type) END AS code FROM part WHERE p_size <= 2 OR p_type IN ('ECONOMY', 'STANDARD') UNION ALL SELECT p_partkey, NULL FROM part WHERE NOT (p_size <= 2 OR p_type IN ('ECONOMY', 'STANDARD'))")
def _(s, d):
    sizes = s.createDataFrame([("1", "by-size"), ("2", "by-size")], "key string, value string")
    types = s.createDataFrame([("ECONOMY", "by-type-economy"), ("STANDARD", "by-type-standard")], "key string, value string")
    return J.coalesce_joins(table(s, d, "part"), [F.col("p_size").cast("string"), F.col("p_type")], [sizes, types], "code").select("p_partkey", "code")


@query("joi_14_ego", "SELECT other, direction FROM (SELECT l_suppkey AS other, 'out' AS direction FROM lineitem WHERE l_partkey = 7 UNION SELECT l_orderkey, 'in' FROM lineitem WHERE l_partkey = 7)")
def _(s, d):
    own = table(s, d, "lineitem").where("l_partkey = 7")
    return own.select(F.col("l_suppkey").alias("other"), F.lit("out").alias("direction")).union(own.select("l_orderkey", F.lit("in"))).distinct()


@query("joi_15_confirmed_links", "SELECT p_partkey, EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_suppkey = 3) AS confirmed FROM part")
def _(s, d):
    links = table(s, d, "lineitem").where("l_suppkey = 3").select(F.col("l_partkey").alias("p_partkey")).distinct().withColumn("hit", F.lit(True))
    return table(s, d, "part").join(links, "p_partkey", "left").select("p_partkey", F.coalesce("hit", F.lit(False)).alias("confirmed"))


@query(
    "joi_16_inclusion",
    """WITH v AS (SELECT DISTINCT 'l_orderkey' AS col, l_orderkey AS x FROM lineitem UNION ALL SELECT DISTINCT 'o_custkey', o_custkey FROM orders), k AS (SELECT 'orders' AS target, o_orderkey AS x FROM orders UNION SELECT 'customer', c_custkey FROM customer UNION SELECT 'supplier', s_suppkey FROM supplier),
h AS (SELECT col, target, count(*) AS hits FROM v JOIN k USING (x) GROUP BY ALL), n AS (SELECT col, count(*) AS n FROM v GROUP BY 1), r AS (SELECT col, target, hits / n AS share, row_number() OVER (PARTITION BY col ORDER BY hits / n DESC, target) AS r FROM h JOIN n USING (col) WHERE hits / n >= 0.5)
SELECT col, target, share::DOUBLE AS share FROM r WHERE r = 1""",
)
def _(s, d):
    values = table(s, d, "lineitem").select(F.lit("l_orderkey").alias("col"), F.col("l_orderkey").alias("value")).union(table(s, d, "orders").select(F.lit("o_custkey"), "o_custkey"))
    keys = table(s, d, "orders").select(F.lit("orders").alias("target"), F.col("o_orderkey").alias("value")).union(table(s, d, "customer").select(F.lit("customer"), "c_custkey")).union(table(s, d, "supplier").select(F.lit("supplier"), "s_suppkey"))
    return J.inclusion(values, keys)


@query("joi_17_reverse_fk", "SELECT key, string_agg(DISTINCT name, ',' ORDER BY name) AS referenced_by FROM (SELECT n_nationkey AS key, 'customer' AS name FROM nation JOIN customer ON c_nationkey = n_nationkey UNION ALL SELECT n_nationkey, 'supplier' FROM nation JOIN supplier ON s_nationkey = n_nationkey) GROUP BY 1")
def _(s, d):
    """Which tables' rows point at each nation: a set of two table names at most."""
    uses = table(s, d, "customer").select(F.col("c_nationkey").alias("key"), F.lit("customer").alias("name")).union(table(s, d, "supplier").select("s_nationkey", F.lit("supplier"))).distinct()
    known = uses.join(table(s, d, "nation").select(F.col("n_nationkey").alias("key")), "key", "left_semi")
    return known.groupBy("key").agg(F.array_join(F.sort_array(F.collect_set("name")), ",").alias("referenced_by"))


@query("joi_18_chain", "SELECT round(avg(a::INT), 6) AS ordered, round(avg((a AND b)::INT), 6) AS shipped FROM (SELECT c_custkey IN (SELECT o_custkey FROM orders) AS a, c_custkey IN (SELECT o_custkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_linestatus = 'F') AS b FROM customer)")
def _(s, d):
    orders = table(s, d, "orders")
    a = orders.select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("a", F.lit(1))
    b = orders.join(table(s, d, "lineitem").where("l_linestatus = 'F'"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("b", F.lit(1))
    met = table(s, d, "customer").select("c_custkey").join(a, "c_custkey", "left").join(b, "c_custkey", "left").fillna(0, ["a", "b"])
    return met.agg(F.round(F.avg("a"), 6).alias("ordered"), F.round(F.avg(F.col("a") * F.col("b")), 6).alias("shipped"))


@query("joi_20_pairs", "SELECT x.n_regionkey, x.n_nationkey AS a, y.n_nationkey AS b FROM nation x JOIN nation y ON x.n_regionkey = y.n_regionkey AND x.n_nationkey < y.n_nationkey")
def _(s, d):
    return J.pairs(table(s, d, "nation"), "n_regionkey", "n_nationkey")


@query("joi_23_shared_terms", "SELECT x.p_brand, x.p_name, count(*) AS others FROM (SELECT DISTINCT p_brand, p_name FROM part) x JOIN (SELECT DISTINCT p_brand, p_name FROM part) y ON x.p_name = y.p_name AND x.p_brand <> y.p_brand GROUP BY 1, 2")
def _(s, d):
    terms = table(s, d, "part").select("p_brand", "p_name").distinct()
    counted = terms.withColumn("others", F.count("*").over(Window.partitionBy("p_name")) - 1)  # a count serves: no pairs
    return counted.where("others > 0")


@query("joi_24_preferred_target", "SELECT s_suppkey, c_custkey FROM (SELECT s_suppkey, c_custkey, row_number() OVER (PARTITION BY s_suppkey ORDER BY c_acctbal DESC, c_custkey) AS r FROM supplier LEFT JOIN customer ON s_nationkey = c_nationkey) WHERE r = 1")
def _(s, d):
    best = table(s, d, "customer").groupBy("c_nationkey").agg(F.min_by("c_custkey", F.struct(-F.col("c_acctbal"), "c_custkey")).alias("c_custkey"))
    return table(s, d, "supplier").join(best, F.col("s_nationkey") == F.col("c_nationkey"), "left").select("s_suppkey", "c_custkey")


@query("joi_x1_as_of", "SELECT event_id, (SELECT max(p.event_id) FROM events p WHERE p.user_id = e.user_id AND p.event_type = 'signup' AND p.event_id <= e.event_id) AS signup FROM events e WHERE event_type = 'purchase'")
def _(s, d):
    events = table(s, d, "events").select("event_id", "user_id", "event_type")
    right = events.where("event_type = 'signup'").select("user_id", F.col("event_id").alias("at"), F.col("event_id").alias("signup"))
    return J.as_of_join(events.where("event_type = 'purchase'").withColumn("at", F.col("event_id")), right, "user_id", "at", "at", "signup").select("event_id", "signup")


@query("joi_x2_interval", "SELECT o_orderkey, band FROM orders JOIN (VALUES (0.0, 100000.0, 'low'), (100000.0, 250000.0, 'mid'), (250000.0, 1e9, 'high')) b(lo, hi, band) ON o_totalprice >= lo AND o_totalprice < hi")
def _(s, d):
    bands = s.createDataFrame([(0.0, 100000.0, "low"), (100000.0, 250000.0, "mid"), (250000.0, 1e9, "high")], "lo double, hi double, band string")
    return J.interval_join(table(s, d, "orders"), "o_totalprice", bands, "lo", "hi", 100000.0).select("o_orderkey", "band")


# ---- sets


@query("set_01_ordered_distinct", "SELECT o_custkey, string_agg(o_orderstatus, ',' ORDER BY first) AS seen FROM (SELECT o_custkey, o_orderstatus, min(o_orderkey) AS first FROM orders GROUP BY 1, 2) GROUP BY 1")
def _(s, d):
    first = table(s, d, "orders").groupBy("o_custkey", "o_orderstatus").agg(F.min("o_orderkey").alias("first"))  # a customer has few statuses, however many orders
    listed = F.transform(F.sort_array(F.collect_list(F.struct("first", "o_orderstatus"))), lambda x: x["o_orderstatus"])
    return first.groupBy("o_custkey").agg(F.array_join(listed, ",").alias("seen"))


@query("set_02_case_distinct", "SELECT lower(p_type) AS k, min_by(p_type, p_partkey) AS spelling FROM part WHERE lower(p_type) <> 'promo' GROUP BY 1")
def _(s, d):
    return table(s, d, "part").where(F.lower("p_type") != "promo").groupBy(F.lower("p_type").alias("k")).agg(F.min_by("p_type", "p_partkey").alias("spelling"))


_SHA = r"sha256(trim(regexp_replace(text, '[ \t\n\r\f\x0B]+', ' ', 'g')))"


@query("set_03_exact_dedup", f"SELECT min(doc_id) AS doc_id, {_SHA} AS sha FROM documents GROUP BY 2")
def _(s, d):
    return table(s, d, "documents").groupBy(H.normalized_sha(F.col("text")).alias("sha")).agg(F.min("doc_id").alias("doc_id"))


@query("set_04_duplicate_count", "SELECT count(*) - count(DISTINCT text) AS copies FROM documents")
def _(s, d):
    # by digest first: the distinct keys are small
    hashed = table(s, d, "documents").groupBy(F.sha2(F.col("text").cast("binary"), 256).alias("h")).agg(F.count("*").alias("n"))
    return hashed.agg((F.sum("n") - F.count("*")).alias("copies"))


@query("set_07_08_jaccard", "SELECT a.r_regionkey AS a, b.r_regionkey AS b, round(len(list_intersect(a.s, b.s)) / len(list_distinct(list_concat(a.s, b.s))), 6) AS jaccard FROM (SELECT n_regionkey AS r_regionkey, list_distinct(list(c_mktsegment || (c_custkey % 40))) AS s FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1) a JOIN (SELECT n_regionkey AS r_regionkey, list_distinct(list(c_mktsegment || (c_custkey % 40))) AS s FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1) b ON a.r_regionkey < b.r_regionkey")
def _(s, d):
    token = F.concat("c_mktsegment", (F.col("c_custkey") % 40).cast("string"))
    sets = table(s, d, "customer").join(table(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_regionkey").alias("g"), token.alias("t")).distinct()
    sizes = sets.groupBy("g").agg(F.count("*").alias("n"))
    common = sets.select(F.col("g").alias("a"), "t").join(sets.select(F.col("g").alias("b"), "t"), "t").where("a < b").groupBy("a", "b").agg(F.count("*").alias("k"))
    met = common.join(sizes.select(F.col("g").alias("a"), F.col("n").alias("na")), "a").join(sizes.select(F.col("g").alias("b"), F.col("n").alias("nb")), "b")
    return met.select("a", "b", F.round(F.col("k") / (F.col("na") + F.col("nb") - F.col("k")), 6).alias("jaccard"))


@query("set_10_manifest_drift", "SELECT doc_id, CASE WHEN quality IS NULL THEN '-' WHEN lang IS NULL THEN '+' WHEN quality = 0 THEN '~' END AS drift FROM documents FULL JOIN labels USING (doc_id) WHERE quality IS NULL OR lang IS NULL OR quality = 0")
def _(s, d):
    met = table(s, d, "documents").select("doc_id", "lang").join(table(s, d, "labels"), "doc_id", "full_outer")
    drift = F.when(F.col("quality").isNull(), "-").when(F.col("lang").isNull(), "+").when(F.col("quality") == 0, "~")
    return met.select("doc_id", drift.alias("drift")).where("drift IS NOT NULL")


@query("set_11_gap", "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def _(s, d):
    return table(s, d, "documents").select("doc_id").exceptAll(table(s, d, "labels").select("doc_id")).distinct()


@query("set_12_disambiguate", "SELECT p_partkey, p_name || CASE WHEN r > 1 THEN '_' || r ELSE '' END AS name FROM (SELECT p_partkey, p_name, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS r FROM part)")
def _(s, d):
    r = F.row_number().over(Window.partitionBy("p_name").orderBy("p_partkey"))
    return table(s, d, "part").withColumn("r", r).select("p_partkey", F.concat("p_name", F.when(F.col("r") > 1, F.concat(F.lit("_"), F.col("r").cast("string"))).otherwise("")).alias("name"))


@query("set_13_ngram_redundancy", r"WITH g AS (SELECT DISTINCT doc_id, unnest([w[i] || ' ' || w[i+1] || ' ' || w[i+2] || ' ' || w[i+3] || ' ' || w[i+4] FOR i IN range(1, len(w) - 3)]) AS g FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM documents)) SELECT round(count(*) FILTER (n > 1) / count(*), 6) AS redundancy FROM (SELECT g, count(*) AS n FROM g GROUP BY 1)")
def _(s, d):
    from marlstone.functions.text import words

    w = words(F.lower("text"))
    # behind a generator of one row the words are built once, not for every use
    listed = table(s, d, "documents").select("doc_id", F.explode(F.array(w)).alias("w")).where(F.size("w") >= 5)
    # a run of five words moves as two 64-bit hashes
    five = F.arrays_zip(*(F.slice("w", k + 1, F.size("w") - 4).alias(f"w{k}") for k in range(5)))
    names = [f"x.w{k}" for k in range(5)]
    runs = listed.select("doc_id", five.alias("five")).select("doc_id", F.explode("five").alias("x"))
    keys = runs.select(F.coalesce("doc_id", F.lit(-(2**63))).alias("doc_id"), F.xxhash64(*names).alias("a"), F.xxhash64(F.lit(1), *names).alias("b"))
    # more than one document has a run if the first and the last differ: runs move once, and once a task
    met = keys.groupBy("a", "b").agg((F.min("doc_id") != F.max("doc_id")).alias("more"))
    return met.agg(F.round(F.count_if("more") / F.count("*"), 6).alias("redundancy"))


@query("set_14_union_all", "SELECT c_name AS name FROM customer UNION ALL SELECT s_name FROM supplier")
def _(s, d):
    return table(s, d, "customer").select(F.col("c_name").alias("name")).union(table(s, d, "supplier").select("s_name"))


@query("set_15_accrete", "SELECT o_custkey, string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS union_of, max_by(o_orderkey, o_orderdate * 1) AS last FROM (SELECT o_custkey, o_orderpriority, o_orderkey, o_orderkey AS o_orderdate FROM orders) GROUP BY 1")
def _(s, d):
    return table(s, d, "orders").groupBy("o_custkey").agg(F.array_join(F.sort_array(F.collect_set("o_orderpriority")), ",").alias("union_of"), F.max("o_orderkey").alias("last"))


# ---- windows


@query("win_01_top_k", "SELECT c_nationkey, c_custkey, r::INT AS r FROM (SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS r FROM customer) WHERE r <= 3")
def _(s, d):
    r = F.row_number().over(Window.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey"))
    return table(s, d, "customer").select("c_nationkey", "c_custkey", r.alias("r")).where("r <= 3")


@query("win_02_margins", "SELECT c_nationkey, round(s0 - coalesce(s1, 0), 3) AS margin, round(CASE WHEN s1 IS NULL OR s0 = 0 THEN 1.0 ELSE (s0 - s1) / s0 END, 3) AS relative, round(s0 / total, 3) AS belief FROM (SELECT c_nationkey, max(b) FILTER (r = 1) AS s0, max(b) FILTER (r = 2) AS s1, sum(b) AS total FROM (SELECT c_nationkey, c_acctbal + 1000 AS b, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS r FROM customer) WHERE r <= 5 GROUP BY 1)")
def _(s, d):
    r = F.row_number().over(Window.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey"))
    top = table(s, d, "customer").select("c_nationkey", (F.col("c_acctbal") + 1000).alias("b"), r.alias("r")).where("r <= 5")
    top = top.groupBy("c_nationkey").agg(F.max(F.when(F.col("r") == 1, F.col("b"))).alias("s0"), F.max(F.when(F.col("r") == 2, F.col("b"))).alias("s1"), F.sum("b").alias("total"))
    s0, s1 = F.col("s0"), F.col("s1")
    relative = F.when(s1.isNull() | (s0 == 0), 1.0).otherwise((s0 - s1) / s0)
    return top.select("c_nationkey", F.round(s0 - F.coalesce(s1, F.lit(0)), 3).alias("margin"), F.round(relative, 3).alias("relative"), F.round(s0 / F.col("total"), 3).alias("belief"))


@query("win_05_rank_of_known", "SELECT c_nationkey, min(r)::INT AS best FROM (SELECT c_nationkey, c_mktsegment, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS r FROM customer) WHERE c_mktsegment = 'BUILDING' GROUP BY 1")
def _(s, d):
    r = F.row_number().over(Window.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey"))
    return table(s, d, "customer").withColumn("r", r).where("c_mktsegment = 'BUILDING'").groupBy("c_nationkey").agg(F.min("r").alias("best"))


@query("win_06_balanced_quartiles", "SELECT lang, q::INT AS q, count(*) AS n FROM (SELECT lang, least(3, floor(4 * coalesce(sum(n_chars) OVER (PARTITION BY lang ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / sum(n_chars) OVER (PARTITION BY lang))) AS q FROM documents) GROUP BY 1, 2")
def _(s, d):
    docs = running(table(s, d, "documents").select("lang", "doc_id", "n_chars"), ["lang"], [F.col("doc_id")], {"before": ("sum", "n_chars")})
    total = docs.groupBy("lang").agg(F.sum("n_chars").alias("total"))
    q = F.least(F.lit(3), F.floor(4 * F.coalesce("before", F.lit(0)) / F.col("total"))).cast("int")
    return docs.join(total, "lang").select("lang", q.alias("q")).groupBy("lang", "q").agg(F.count("*").alias("n"))


@query("win_07_08_trend", "SELECT user_id, round(max(m) FILTER (b = 1), 8) AS first, round(max(m) FILTER (b = 4), 8) AS last, CASE WHEN max(m) FILTER (b = 4) > 1.1 * max(m) FILTER (b = 1) THEN 'up' WHEN max(m) FILTER (b = 4) < 0.9 * max(m) FILTER (b = 1) THEN 'down' ELSE 'flat' END AS trend FROM (SELECT user_id, b, avg(value) AS m FROM (SELECT user_id, value, ntile(4) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM events) GROUP BY 1, 2) GROUP BY 1")
def _(s, d):
    b = F.ntile(4).over(Window.partitionBy("user_id").orderBy("event_id"))
    means = table(s, d, "events").withColumn("b", b).groupBy("user_id", "b").agg(F.avg("value").alias("m"))
    first, last = (F.max(F.when(F.col("b") == k, F.col("m"))) for k in (1, 4))
    out = means.groupBy("user_id").agg(first.alias("a"), last.alias("z"))
    return out.select("user_id", F.round("a", 8).alias("first"), F.round("z", 8).alias("last"), F.when(F.col("z") > 1.1 * F.col("a"), "up").when(F.col("z") < 0.9 * F.col("a"), "down").otherwise("flat").alias("trend"))


@query("win_09_10_lags", "SELECT event_id, lag(event_id) OVER w AS prev, round(value - lag(value) OVER w, 6) AS velocity, round(value - 2 * lag(value) OVER w + lag(value, 2) OVER w, 6) AS acceleration FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)")
def _(s, d):
    w = Window.partitionBy("user_id").orderBy("event_id")
    one, two = F.lag("value").over(w), F.lag("value", 2).over(w)
    return table(s, d, "events").select("event_id", F.lag("event_id").over(w).alias("prev"), F.round(F.col("value") - one, 6).alias("velocity"), F.round(F.col("value") - 2 * one + two, 6).alias("acceleration"))


@query("win_11_segments", "SELECT event_id, CASE WHEN before = total THEN 'scratch' WHEN before = total - 1 THEN 'current' ELSE 'archive' END AS segment FROM (SELECT event_id, sum((event_type = 'signup')::INT) OVER (PARTITION BY user_id ORDER BY event_id) - (event_type = 'signup')::INT AS before, sum((event_type = 'signup')::INT) OVER (PARTITION BY user_id) AS total FROM events)")
def _(s, d):
    w = Window.partitionBy("user_id")
    cut = (F.col("event_type") == "signup").cast("int")
    before, total = F.sum(cut).over(w.orderBy("event_id")) - cut, F.sum(cut).over(w)
    return table(s, d, "events").select("event_id", F.when(before == total, "scratch").when(before == total - 1, "current").otherwise("archive").alias("segment"))


@query("win_12_13_latest", "SELECT user_id, max(event_id) AS last_event, max_by(event_type, event_id) AS kind FROM events GROUP BY 1")
def _(s, d):
    return table(s, d, "events").groupBy("user_id").agg(F.max("event_id").alias("last_event"), F.max_by("event_type", "event_id").alias("kind"))


@query("win_14_rolling_count", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY date_trunc('second', ts) RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW) AS n FROM events")
def _(s, d):
    w = Window.partitionBy("user_id").orderBy(F.unix_timestamp(F.col("ts").cast("timestamp"))).rangeBetween(-86400, 0)
    return table(s, d, "events").select("event_id", F.count("*").over(w).alias("n"))


@query("win_15_offsets", "SELECT conv_id, turn, (coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS start FROM conversations")
def _(s, d):
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    return table(s, d, "conversations").select("conv_id", "turn", F.coalesce(F.sum(F.length("text")).over(w), F.lit(0)).alias("start"))


@query("win_16_mattr", r"SELECT doc_id, round(CASE WHEN len(w) <= 100 THEN len(list_distinct(w)) / greatest(len(w), 1) ELSE list_avg([len(list_distinct(w[i+1:i+100])) / 100.0 FOR i IN range(0, len(w) - 100, 50)]) END, 8) AS mattr FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM documents)")
def _(s, d):
    from marlstone.functions.text import words

    w, n = F.col("w"), F.size("w")
    starts = F.sequence(F.lit(0), n - 101, F.lit(50))
    windows = F.transform(starts, lambda i: F.size(F.array_distinct(F.slice(w, i + 1, 100))) / 100.0)
    long = F.aggregate(windows, F.lit(0.0), lambda a, x: a + x) / F.size(windows)
    return table(s, d, "documents").select("doc_id", words(F.lower("text")).alias("w")).select("doc_id", F.round(F.when(n <= 100, F.size(F.array_distinct(w)) / F.greatest(n, F.lit(1))).otherwise(long), 8).alias("mattr"))


@query("win_17_elbow", "SELECT max_by(k, bend) AS elbow FROM (SELECT k, lag(v) OVER (ORDER BY k) - 2 * v + lead(v) OVER (ORDER BY k) AS bend FROM (SELECT p_size AS k, sum(p_retailprice) AS v FROM part GROUP BY 1)) WHERE bend IS NOT NULL")
def _(s, d):
    w = Window.orderBy("k")  # one row a cluster count
    v = table(s, d, "part").groupBy(F.col("p_size").alias("k")).agg(F.sum("p_retailprice").alias("v"))
    bend = v.select("k", (F.lag("v").over(w) - 2 * F.col("v") + F.lead("v").over(w)).alias("bend"))
    return bend.where("bend IS NOT NULL").agg(F.max_by("k", "bend").alias("elbow"))


@query("win_18_order_violations", "SELECT count(*) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderdate > l_shipdate")
def _(s, d):
    return table(s, d, "orders").join(table(s, d, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey")).where("o_orderdate > l_shipdate").agg(F.count("*").alias("n"))


# ---- sorts, limits and samples

_U = "('0x' || sha256('s1:' || {k})[1:12])::BIGINT"


@query("srt_02_sample", f"SELECT c_custkey FROM customer ORDER BY {_U.format(k='c_custkey')}, c_custkey LIMIT 100")
def _(s, d):
    return table(s, d, "customer").orderBy(H.draw(F.col("c_custkey"), "s1"), "c_custkey").limit(100).select("c_custkey")


@query("srt_03_windowed_sample", f"SELECT doc_id FROM (SELECT doc_id FROM documents WHERE length(text) >= 200 ORDER BY doc_id LIMIT 500) ORDER BY {_U.format(k='doc_id')}, doc_id LIMIT 50")
def _(s, d):
    window = table(s, d, "documents").where(F.length("text") >= 200).select("doc_id").orderBy("doc_id").limit(500)
    return window.orderBy(H.draw(F.col("doc_id"), "s1"), "doc_id").limit(50)


@query("srt_04_labelled_sample", f"SELECT d.doc_id, lang FROM documents d JOIN (SELECT doc_id FROM labels ORDER BY {_U.format(k='doc_id')}, doc_id LIMIT 16) USING (doc_id)")
def _(s, d):
    few = table(s, d, "labels").orderBy(H.draw(F.col("doc_id"), "s1"), "doc_id").limit(16).select("doc_id")
    return table(s, d, "documents").join(few, "doc_id").select("doc_id", "lang")


@query("srt_05_mixture", "SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS r FROM documents) WHERE r <= CASE lang WHEN 'en' THEN 60 WHEN 'fr' THEN 25 ELSE 10 END")
def _(s, d):
    quota = F.when(F.col("lang") == "en", 60).when(F.col("lang") == "fr", 25).otherwise(10)
    r = F.row_number().over(Window.partitionBy("lang").orderBy("doc_id"))
    return table(s, d, "documents").withColumn("r", r).where(F.col("r") <= quota).select("doc_id", "lang")


@query("srt_06_inverse_cdf", f"SELECT c_custkey, CASE WHEN {_U.format(k='c_custkey')} / 281474976710656.0 < 0.5 THEN 'a' WHEN {_U.format(k='c_custkey')} / 281474976710656.0 < 0.8 THEN 'b' ELSE 'c' END AS pick FROM customer")
def _(s, d):
    table_of_shares = s.createDataFrame([("a", 0.0, 0.5), ("b", 0.5, 0.8), ("c", 0.8, 1.0)], "pick string, lo double, hi double")
    drawn = table(s, d, "customer").select("c_custkey", H.unit(F.col("c_custkey"), "s1").alias("u"))
    return J.interval_join(drawn, "u", table_of_shares, "lo", "hi", 0.5).select("c_custkey", "pick")


@query("srt_07_most_common", "SELECT p_name, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, p_name LIMIT 20")
def _(s, d):
    return table(s, d, "part").groupBy("p_name").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "p_name").limit(20)


@query("srt_08_contrastive_terms", r"WITH w AS (SELECT lang, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS t FROM documents WHERE lang IN ('en', 'de')), c AS (SELECT t, count(*) FILTER (lang = 'en') AS a, count(*) FILTER (lang = 'de') AS b FROM w GROUP BY 1), n AS (SELECT sum(a) AS na, sum(b) AS nb FROM c) SELECT t, round(z, 4) AS z FROM (SELECT t, (ln((a + 0.01) / (na - a + 0.01)) - ln((b + 0.01) / (nb - b + 0.01))) / sqrt(1 / (a + 0.01) + 1 / (b + 0.01)) AS z FROM c, n WHERE a >= 3) ORDER BY round(z, 4) DESC, t LIMIT 24")
def _(s, d):
    from marlstone.functions.text import words

    w = table(s, d, "documents").where("lang IN ('en', 'de')").select("lang", F.explode(words(F.lower("text"))).alias("t"))
    c = w.groupBy("t").agg(F.count_if(F.col("lang") == "en").alias("a"), F.count_if(F.col("lang") == "de").alias("b"))
    n = c.agg(F.sum("a").alias("na"), F.sum("b").alias("nb"))
    a, b, na, nb = (F.col(x) for x in ("a", "b", "na", "nb"))
    z = (F.ln((a + 0.01) / (na - a + 0.01)) - F.ln((b + 0.01) / (nb - b + 0.01))) / F.sqrt(1 / (a + 0.01) + 1 / (b + 0.01))
    return c.where("a >= 3").crossJoin(F.broadcast(n)).select("t", F.round(z, 4).alias("z")).orderBy(F.desc("z"), "t").limit(24)  # one row of totals


@query("srt_14_family_rounds", "SELECT p_partkey, p_type FROM (SELECT *, min(r2) OVER (PARTITION BY p_type) AS f FROM (SELECT p_partkey, p_type, row_number() OVER (PARTITION BY p_type ORDER BY p_retailprice DESC, p_partkey) AS r1, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS r2 FROM part)) ORDER BY r1, f LIMIT 12")
def _(s, d):
    order = [F.desc("p_retailprice"), F.asc("p_partkey")]
    best = F.max(F.struct("p_retailprice", -F.col("p_partkey"))).over(Window.partitionBy("p_type"))
    ranked = table(s, d, "part").select("p_partkey", "p_type", F.row_number().over(Window.partitionBy("p_type").orderBy(*order)).alias("r1"), best.alias("best"))
    return ranked.orderBy("r1", F.desc("best")).limit(12).select("p_partkey", "p_type")
