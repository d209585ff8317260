"""Queries of table corpora, text-proto, token files and small files."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from marlstone.operators import windows as W
from marlstone.plans.catalog import query
from marlstone.sources import columnar as C
from marlstone.sources import io
from marlstone.storage import scratch, table


def _corpus(s, d):
    """A Parquet file for each brand and 20,000 part numbers, whole: names and types with labels, sizes without one."""
    parts = table(s, d, "part")
    cells = lambda c: F.transform(F.sort_array(F.collect_list(F.struct("p_partkey", F.col(c).cast("string").alias("v")))), lambda x: x["v"])
    column = lambda name, label, c: F.struct(F.lit(name).alias("name"), label.alias("label"), cells(c).alias("cells"))
    none = F.lit(None).cast("string")
    by = parts.groupBy(F.concat(F.replace("p_brand", F.lit("#"), F.lit("-")), F.lit("-"), F.floor(F.col("p_partkey") / 20000).cast("string")).alias("table"))
    made = by.agg(F.array(column("name", F.concat(F.lit("label/"), F.min("p_type")), "p_name"), column("size", none, "p_size"), column("type", F.concat(F.lit("label/"), F.max("p_type")), "p_type")).alias("columns"))
    folder = scratch(s, "tables")
    C.write_tables(made, folder, "dbpedia")
    return folder


@query(
    "src_04_table_corpus",
    """WITH p AS (SELECT *, row_number() OVER (PARTITION BY p_brand, p_partkey // 20000 ORDER BY p_partkey) AS r, min(p_type) OVER (PARTITION BY p_brand, p_partkey // 20000) AS lo, max(p_type) OVER (PARTITION BY p_brand, p_partkey // 20000) AS hi FROM part)
    SELECT replace(p_brand, '#', '-') || '-' || (p_partkey // 20000) AS table_id, k::INT AS column_ix, CASE k WHEN 0 THEN 'name' ELSE 'type' END AS name, 'label/' || CASE k WHEN 0 THEN lo ELSE hi END AS label, count(*) AS cells, string_agg(CASE k WHEN 0 THEN p_name ELSE p_type END, '|' ORDER BY r) AS text
    FROM p, (VALUES (0), (2)) v(k) WHERE r <= 200 GROUP BY 1, 2, 3, 4""",
)
def _(s, d):
    found = C.scan_tables(s, _corpus(s, d), "dbpedia")
    return found.select("table_id", "column_ix", "name", "label", F.size("cells").cast("long").alias("cells"), F.array_join("cells", "|").alias("text"))


@query(
    "src_05_06_labels",
    """WITH l AS (SELECT min(p_type) AS x FROM part GROUP BY p_brand, p_partkey // 20000 UNION SELECT max(p_type) FROM part GROUP BY p_brand, p_partkey // 20000)
    SELECT 'label/' || x AS label, (row_number() OVER (ORDER BY x) - 1)::INT AS id, first AS hit_first, true AS hit_again FROM l, (SELECT false AS first)""",
)
def _(s, d):
    folder, cache = _corpus(s, d), scratch(s, "labels")
    _, first = C.cached_labels(s, folder, "dbpedia", cache)
    labels, again = C.cached_labels(s, folder, "dbpedia", cache)
    return labels.select("label", "id", F.lit(first).alias("hit_first"), F.lit(again).alias("hit_again"))


@query("src_09_split_paths", "SELECT split, space, CASE WHEN space = 'two' THEN 'gt/' || CASE split WHEN 'train' THEN 'training' WHEN 'val' THEN 'validation' ELSE 'test' END || '.csv' ELSE 'gt_' || split || '.csv' END AS path FROM (SELECT DISTINCT CASE doc_id % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'val' ELSE 'test' END AS split, CASE WHEN doc_id % 2 = 0 THEN 'two' ELSE 'one' END AS space FROM documents)")
def _(s, d):
    k = F.col("doc_id")
    kinds = table(s, d, "documents").select(F.when(k % 3 == 0, "train").when(k % 3 == 1, "val").otherwise("test").alias("split"), F.when(k % 2 == 0, "two").otherwise("one").alias("space")).distinct()
    long = F.create_map(*map(F.lit, ("train", "training", "val", "validation", "test", "test")))
    return kinds.select("split", "space", F.when(F.col("space") == "two", F.concat(F.lit("gt/"), long[F.col("split")], F.lit(".csv"))).otherwise(F.concat(F.lit("gt_"), "split", F.lit(".csv"))).alias("path"))


def _proto(s, d):
    """Gzipped text-proto, a record a line: an order with its lines as a table, and a question."""
    lines = table(s, d, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))).alias("l"))
    row = F.transform("l", lambda x: F.concat(F.lit('rows { cells { text: "'), x["l_partkey"].cast("string"), F.lit('" } cells { text: "'), x["l_suppkey"].cast("string"), F.lit('" } }')))
    record = F.concat(F.lit('id: "'), F.col("l_orderkey").cast("string"), F.lit('" table { columns { text: "part" } columns { text: "supplier" } '), F.array_join(row, " "), F.lit(' } questions { original_text: "order '), F.col("l_orderkey").cast("string"), F.lit('?" }'))
    path = scratch(s, "proto")
    lines.select(record.alias("value")).write.option("compression", "gzip").text(path)
    texts = lambda c, p: F.regexp_extract_all(c, F.lit(p), F.lit(1))
    read = s.read.text(path)
    head = F.split("value", "questions \\{", 2)
    parsed = read.select(
        F.regexp_extract("value", r'^id: "(\d+)"', 1).cast("long").alias("id"),
        texts(head[0], r'columns \{ text: "([^"]*)" \}').alias("columns"),
        texts(head[0], r"rows \{ ((?:cells \{[^}]*\} ?)+)\}").alias("rows"),
        texts(head[1], r'original_text: "([^"]*)"').alias("questions"),
    )
    cells = F.transform("rows", lambda r: F.regexp_extract_all(r, F.lit(r'cells \{ text: "([^"]*)" \}'), F.lit(1)))
    return parsed.select("id", "columns", cells.alias("rows"), "questions").where((F.size("columns") >= 2) & (F.size("rows") >= 2))


@query("src_17_text_proto", "SELECT l_orderkey AS id, count(*) AS n_rows, string_agg(l_partkey || ',' || l_suppkey, ';' ORDER BY l_linenumber, l_partkey, l_suppkey) AS cells, 'order ' || l_orderkey || '?' AS question FROM lineitem GROUP BY 1 HAVING count(*) >= 2")
def _(s, d):
    return _proto(s, d).select("id", F.size("rows").cast("long").alias("n_rows"), F.array_join(F.transform("rows", lambda r: F.array_join(r, ",")), ";").alias("cells"), F.get("questions", F.lit(0)).alias("question"))


@query(
    "src_18_proto_sequence",
    """WITH r AS (SELECT l_orderkey AS id, string_agg(' ' || length(l_partkey::VARCHAR) || ' ' || length(l_suppkey::VARCHAR), '' ORDER BY l_linenumber, l_partkey, l_suppkey) AS s, sum(length(l_partkey::VARCHAR) + length(l_suppkey::VARCHAR) + 2) AS n FROM lineitem GROUP BY 1 HAVING count(*) >= 2)
    SELECT id, least(48, 3 + length('order ' || id || '?') + n)::BIGINT AS n_ids, 1 AS first_id, 2 AS last_id, (ascii('o') + 16)::INT AS second_id FROM r""",
)
def _(s, d):
    """BOS context SEP (BOUNDARY cell)* EOS, cut to 48 ids that end with EOS; bytes come after the sixteen special ids."""
    ids = lambda *x: F.array(*map(F.lit, x))
    cells = F.flatten(F.transform(F.flatten("rows"), lambda c: F.concat(ids(4), W.byte_ids(c))))
    whole = F.concat(ids(1), W.byte_ids(F.get("questions", F.lit(0))), ids(3), cells)
    cut = _proto(s, d).select("id", F.concat(F.slice(whole, 1, 47), ids(2)).alias("ids"))
    return cut.select("id", F.size("ids").cast("long").alias("n_ids"), F.element_at("ids", 1).alias("first_id"), F.element_at("ids", -1).alias("last_id"), F.element_at("ids", 2).alias("second_id"))


@query("src_26_latest_match", "SELECT 'run-' || max(n_nationkey + 100) || '.json' AS latest, NULL::VARCHAR AS missing, 'run-100.json' AS chosen FROM nation")
def _(s, d):
    folder = scratch(s, "runs")
    for r in table(s, d, "nation").select("n_nationkey").toLocalIterator():  # as many files as nations
        C.replace_file(folder, f"run-{r.n_nationkey + 100}.json", "{}")
    found = [C.latest(folder, ("none-*", "run-*")), C.latest(folder, ("run-*",), "run-1.json"), C.latest(folder, ("run-*",), "run-100.json")]
    return s.createDataFrame([tuple(found)], "latest string, missing string, chosen string")


@query("src_31_document_postings", r"WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z][a-z0-9]{2,23}')) AS token FROM documents), c AS (SELECT doc_id, token, count(*) AS n FROM t GROUP BY 1, 2) SELECT token, doc_id || ':' || (SELECT sha256(text)[:8] FROM documents x WHERE x.doc_id = c.doc_id) AS lineage, n FROM c QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, token) <= 4096")
def _(s, d):
    from pyspark.sql import Window

    held = table(s, d, "documents").select("doc_id", F.substring(F.sha2(F.col("text").cast("binary"), 256), 1, 8).alias("sha"), F.lower("text").alias("low"))

    def counts(docs):
        tokens = docs.select("doc_id", "sha", F.explode(F.regexp_extract_all("low", F.lit("([a-z][a-z0-9]{2,23})"), F.lit(1))).alias("token"))
        return tokens.groupBy("doc_id", "sha", "token").agg(F.count("*").alias("n"))

    # a token has three letters at least, so a shorter text has 4,096 at most and needs no order
    long = F.length("low") > 3 * 4096
    r = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("n"), "token"))  # one document's tokens
    kept = counts(held.where(~long)).union(counts(held.where(long)).withColumn("r", r).where("r <= 4096").drop("r"))
    return kept.select("token", F.concat_ws(":", F.col("doc_id").cast("string"), "sha").alias("lineage"), "n")


@query("snk_05_token_files", "SELECT count(*) AS n_rows, sum(octet_length(encode(p_name)))::BIGINT AS n_ids, sum(ascii(p_name[1]) + 16)::BIGINT AS firsts FROM part")
def _(s, d):
    held = C.write_bin(table(s, d, "part").select(W.byte_ids(F.col("p_name")).alias("ids")), "ids")
    return C.read_bin(held).agg(F.count("*").alias("n_rows"), F.sum(F.size("ids")).alias("n_ids"), F.sum(F.get("ids", F.lit(0))).alias("firsts"))


@query("snk_06_json_lines", "SELECT doc_id, lang, strlen(text) AS bytes FROM documents UNION ALL SELECT doc_id, lang, strlen(text) FROM documents WHERE lang = 'en'")
def _(s, d):
    path = scratch(s, "jsonl")
    docs = table(s, d, "documents").select("doc_id", "lang", "text")
    for admitted in (docs, docs.where("lang = 'en'")):
        admitted.write.mode("append").option("compression", "gzip").json(path)
    return io.read_json_lines(s, path, "doc_id long, lang string, text string").select("doc_id", "lang", F.octet_length("text").cast("long").alias("bytes"))


@query("snk_09_csv_padded", "SELECT n_regionkey::INT AS r, i::INT AS i, coalesce(n[i], '') AS name, coalesce(k[i], '') AS k FROM (SELECT n_regionkey, list(n_name ORDER BY n_nationkey) AS n, list(n_nationkey::VARCHAR ORDER BY n_nationkey) FILTER (n_nationkey % 2 = 0) AS k, unnest(range(1, count(*) + 1)) AS i FROM nation GROUP BY 1)")
def _(s, d):
    """Columns of unequal length, padded with empty cells to the longest."""
    ordered = lambda c: F.sort_array(F.collect_list(F.when(c, F.struct("n_nationkey", "n_name"))))
    made = table(s, d, "nation").groupBy("n_regionkey").agg(ordered(F.lit(True)).alias("a"), ordered(F.col("n_nationkey") % 2 == 0).alias("b"))
    zipped = made.select("n_regionkey", F.posexplode(F.arrays_zip(F.transform("a", lambda x: x["n_name"]).alias("name"), F.transform("b", lambda x: x["n_nationkey"].cast("string")).alias("k"))).alias("i", "x"))
    path = scratch(s, "csv")
    zipped.select(F.col("n_regionkey").alias("r"), (F.col("i") + 1).alias("i"), F.coalesce("x.name", F.lit("")).alias("name"), F.coalesce("x.k", F.lit("")).alias("k")).write.option("header", True).option("emptyValue", "").csv(path)
    return s.read.schema("r int, i int, name string, k string").option("header", True).csv(path).fillna("", ["name", "k"])


@query("snk_10_12_index_note", "SELECT lang, count(*) AS n FROM documents GROUP BY 1")
def _(s, d):
    """Counts by language in an index note, replaced in one move and read again."""
    folder = scratch(s, "kb")
    counts = table(s, d, "documents").groupBy("lang").agg(F.count("*").alias("n")).orderBy("lang").collect()  # a row a language
    C.replace_file(folder, "index.json", "stale")
    C.replace_file(folder, "index.json", json.dumps([{"lang": r.lang, "n": r.n} for r in counts]))
    return s.read.schema("lang string, n long").option("multiLine", True).json(f"{folder}/index.json")


@query("snk_14_vector_index", "SELECT label, (vec_id // 64)::BIGINT AS batch, count(*) AS points, round(sum(sqrt(list_sum([x * x FOR x IN embedding::DOUBLE[]]))), 4) AS lengths FROM embeddings GROUP BY 1, 2")
def _(s, d):
    """Vectors with their payload in stable batches of 64, partitioned by label."""
    path = scratch(s, "vectors")
    length = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    table(s, d, "embeddings").select("vec_id", "embedding", "label", F.floor(F.col("vec_id") / 64).cast("long").alias("batch"), length.alias("length")).write.partitionBy("label").parquet(path)
    stored = s.read.schema("vec_id long, batch long, length double, label long").parquet(path)
    return stored.groupBy("label", "batch").agg(F.count("*").alias("points"), F.round(F.sum("length"), 4).alias("lengths"))
