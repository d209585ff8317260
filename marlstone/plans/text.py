"""Queries of the text, date and hash functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions import hashing as H
from marlstone.functions import temporal as D
from marlstone.functions import text as T
from marlstone.operators.windows import first_rows
from marlstone.plans.catalog import query
from marlstone.storage import table

MESSY = "concat_ws(' ', c_name, 'owes', format_string('%,.2f', c_acctbal), 'in', c_mktsegment)"
WORDS = r"regexp_extract_all(text, '[\p{L}\p{N}_]+')"


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


@query("str_01_number", "SELECT o_orderkey, CAST(replace(nullif(regexp_extract('total: ' || format('{:,.2f}', o_totalprice) || ' now', '-?\\d{1,3}(?:,\\d{3})+(?:\\.\\d+)?|-?\\d+(?:\\.\\d+)?'), ''), ',', '') AS DOUBLE) AS amount FROM orders")
def _(spark, sf_dir):
    messy = F.concat(F.lit("total: "), F.format_number("o_totalprice", 2), F.lit(" now"))
    return table(spark, sf_dir, "orders").select("o_orderkey", T.number(messy).alias("amount"))


@query("str_02_thousands", "SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity = floor(l_quantity) THEN format('{:,}', l_quantity::BIGINT) ELSE format('{:,.2f}', l_quantity) END AS shown FROM lineitem")
def _(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", T.thousands(F.col("l_quantity")).alias("shown"))


@query("str_03_mask", r"SELECT regexp_replace(regexp_replace(c_name, '\p{L}+', 'X', 'g'), '\p{Nd}+', '9', 'g') AS mask, count(*) AS n FROM customer GROUP BY 1")
def _(spark, sf_dir):
    return table(spark, sf_dir, "customer").groupBy(T.mask(F.col("c_name")).alias("mask")).agg(F.count("*").alias("n"))


#: The first and the last word of a part's name, the last with a capital, and the name with capitals.
_FIRST = "string_split(p_name, ' ')[1]"
_LAST = ("upper(string_split(p_name, ' ')[-1][1]) || string_split(p_name, ' ')[-1][2:]", "string_split(p_name, ' ')[-1]")
_TITLE = "array_to_string([upper(x[1]) || x[2:] FOR x IN string_split(p_name, ' ')], ' ')"


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts with the first and the last word of their names."""
    pieces = F.split("p_name", " ")
    return table(spark, sf_dir, "part").withColumns({"first": F.element_at(pieces, 1), "last": F.element_at(pieces, -1)})


def spelt(key: str, *forms: Column) -> Column:
    """One of several forms, by a row's key."""
    return F.element_at(F.array(*forms), (F.col(key) % len(forms) + 1).cast("int"))


@query(
    "str_04_05_header_register",
    f"""SELECT p_partkey, h, regexp_matches(h, '(?i)^(id|.*_id|no|no\\.|nr|#|index|key|code|uuid|guid)$') AS is_id,
    CASE WHEN regexp_matches(h, '\\((%|[a-z]{{1,4}}(/[a-z]{{1,4}})?)\\)|_(pct|usd|eur|kg|km|ms|sec)$') THEN 'unit' WHEN regexp_matches(h, '^[a-z0-9]+(_[a-z0-9]+)+$|^[a-z]+[A-Z][A-Za-z0-9]*$') THEN 'machine'
    WHEN regexp_matches(h, '^[A-Z][A-Za-z]*([ -][A-Za-z]+)*$') THEN 'human' ELSE 'other' END AS register
    FROM (SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN replace(p_name, ' ', '_') WHEN 1 THEN {_TITLE} WHEN 2 THEN {_TITLE} || ' (kg)' WHEN 3 THEN {_FIRST} || '_id' WHEN 4 THEN {_FIRST} || {_LAST[0]} WHEN 5 THEN p_brand ELSE {_FIRST} || '_usd' END AS h FROM part)""",
)
def _(spark, sf_dir):
    df = parts(spark, sf_dir).select("p_partkey", spelt("p_partkey", F.replace("p_name", F.lit(" "), F.lit("_")), F.initcap("p_name"), F.concat(F.initcap("p_name"), F.lit(" (kg)")), F.concat("first", F.lit("_id")), F.concat("first", F.initcap("last")), F.col("p_brand"), F.concat("first", F.lit("_usd"))).alias("h"))
    return df.select("p_partkey", "h", T.is_identifier_header(F.col("h")).alias("is_id"), T.header_register(F.col("h")).alias("register"))


_SYL = "greatest(1, len(regexp_extract_all(lower({w}), '[aeiouy]+')) - CASE WHEN regexp_matches(lower({w}), '[^aeiouy]e$') THEN 1 ELSE 0 END)"
_SENT = r"[n FOR n IN [len(regexp_extract_all(s, '[\p{L}\p{N}_]+')) FOR s IN string_split_regex(text, '[.!?]+')] IF n > 0]"


@query("str_06_syllables", f"SELECT p_name, {_SYL.format(w='p_name')}::INT AS syllables FROM part")
def _(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_name", T.syllables(F.col("p_name")).cast("int").alias("syllables"))


@query(
    "str_07_reading_ease",
    f"""SELECT doc_id, CASE WHEN len(w) > 0 THEN round(206.835 - 1.015 * len(w) / greatest(len(s), 1) - 84.6 * list_sum([{_SYL.format(w='x')} FOR x IN w]) / len(w), 1) ELSE 0.0 END AS ease
    FROM (SELECT doc_id, {WORDS} AS w, {_SENT} AS s FROM documents)""",
)
def _(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", T.reading_ease(F.col("text")).alias("ease"))


@query(
    "str_08_sentence_cv",
    f"SELECT doc_id, round(CASE WHEN len(s) < 2 THEN 0 ELSE sqrt(greatest(list_sum([x * x FOR x IN s]) / len(s) - (list_sum(s) / len(s)) ** 2, 0)) / (list_sum(s) / len(s)) END, 6) AS cv FROM (SELECT doc_id, {_SENT} AS s FROM documents)",
)
def _(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.round(T.sentence_length_cv(F.col("text")), 6).alias("cv"))


@query("str_09_phrase_rate", f"SELECT doc_id, round(CASE WHEN len(w) > 0 THEN (len(regexp_extract_all(lower(text), '\\bof the\\b')) + len(regexp_extract_all(lower(text), '\\bto the\\b'))) * 1000.0 / len(w) ELSE 0 END, 6) AS rate FROM (SELECT doc_id, text, {WORDS} AS w FROM documents WHERE lang = 'en')")
def _(spark, sf_dir):
    return docs(spark, sf_dir).where("lang = 'en'").select("doc_id", F.round(T.phrase_rate(F.col("text"), ("of the", "to the")), 6).alias("rate"))


_NOTE = "'# Note ' || doc_id || chr(10) || '```json' || chr(10) || '{\"a\": ' || doc_id || '}' || chr(10) || '```' || chr(10) || '| a | b |' || chr(10) || 'Prose  of ' || source || '.'"


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Small notes with a heading, a fenced block, a table line and prose."""
    made = F.concat(F.lit("# Note "), F.col("doc_id").cast("string"), F.lit('\n```json\n{"a": '), F.col("doc_id").cast("string"), F.lit("}\n```\n| a | b |\nProse  of "), F.col("source"), F.lit("."))
    return docs(spark, sf_dir).select("doc_id", made.alias("note"))


@query(
    "str_10_11_prose",
    f"""SELECT doc_id, regexp_replace(note, '(?s)```.*?```', ' ', 'g') AS unfenced,
    trim(regexp_replace(array_to_string([x FOR x IN string_split(regexp_replace(note, '(?s)```.*?```', ' ', 'g'), chr(10)) IF NOT starts_with(trim(x), '|')], ' '), '[ \\t\\n\\r]+', ' ', 'g')) AS prose FROM (SELECT doc_id, {_NOTE} AS note FROM documents)""",
)
def _(spark, sf_dir):
    return notes(spark, sf_dir).select("doc_id", T.strip_fences(F.col("note")).alias("unfenced"), T.prose(F.col("note")).alias("prose"))


@query("str_14_15_fenced_json", f"SELECT doc_id, CAST(json_extract_string(regexp_extract(note, '(?s)```json\\s*(.*?)```', 1), '$.a') AS BIGINT) AS a FROM (SELECT doc_id, {_NOTE} AS note FROM documents)")
def _(spark, sf_dir):
    fenced = F.regexp_extract("note", r"(?s)```json\s*(.*?)```", 1)
    return notes(spark, sf_dir).select("doc_id", F.from_json(fenced, "a long")["a"].alias("a"))


@query("str_32_heading", f"SELECT doc_id, regexp_extract(note, '(?m)^# (.*)$', 1) AS title FROM (SELECT doc_id, {_NOTE} AS note FROM documents)")
def _(spark, sf_dir):
    return notes(spark, sf_dir).select("doc_id", T.heading(F.col("note")).alias("title"))


_CAMEL = "[t FOR t IN string_split(lower(regexp_replace(regexp_replace(n, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '[_\\W]+', ' ', 'g')), ' ') IF t <> '']"


@query(
    "str_16_24_names",
    f"""SELECT p_partkey, n, array_to_string({_CAMEL}, ' ') AS parts, lower(n[1] || regexp_replace(n[2:], '([A-Z])', '_\\1', 'g')) AS snake,
    CASE WHEN regexp_matches(n, '[^aeiou]y$') THEN regexp_replace(n, 'y$', 'ies') WHEN regexp_matches(n, '(s|x|z|ch|sh)$') THEN n || 'es' ELSE n || 's' END AS plural,
    CASE WHEN regexp_matches(n, 'ies$') THEN regexp_replace(n, 'ies$', 'y') WHEN regexp_matches(n, 'ses$') THEN regexp_replace(n, 'es$', '') WHEN regexp_matches(n, '[^s]s$') THEN regexp_replace(n, 's$', '') ELSE n END AS singular,
    array_to_string([regexp_replace(t, 's$', '') FOR t IN {_CAMEL}], '_') AS key,
    regexp_replace(regexp_replace(lower(n), '_(id|key|code|name|tbl|table)$', ''), '([^s])s$', '\\1') AS stem,
    CASE WHEN regexp_matches(lower(regexp_replace(n, '[^A-Za-z0-9_]+', '_', 'g')), '^[a-z_]') THEN lower(regexp_replace(n, '[^A-Za-z0-9_]+', '_', 'g')) ELSE 't_' || lower(regexp_replace(n, '[^A-Za-z0-9_]+', '_', 'g')) END AS identifier,
    array_to_string([CASE WHEN length(t) > 4 THEN (t[1] || regexp_replace(t[2:], '[aeiou]', '', 'g'))[1:5] ELSE t END FOR t IN string_split(n, '_')], '_') AS short,
    regexp_replace(lower(n), '[^a-z0-9:/.\\-]+', '-', 'g') AS slug
    FROM (SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN {_FIRST} || {_LAST[0]} WHEN 1 THEN {_FIRST} || '_' || {_LAST[1]} || '_id' WHEN 2 THEN {_TITLE} WHEN 3 THEN p_size || ' ' || p_name WHEN 4 THEN p_brand || 'Boxes' ELSE p_type || {_LAST[0]} || 's' END AS n FROM part)""",
)
def _(spark, sf_dir):
    n = F.col("n")
    last = F.initcap("last")
    forms = (F.concat("first", last), F.concat("first", F.lit("_"), "last", F.lit("_id")), F.initcap("p_name"), F.concat(F.col("p_size").cast("string"), F.lit(" "), "p_name"), F.concat("p_brand", F.lit("Boxes")), F.concat("p_type", last, F.lit("s")))
    return parts(spark, sf_dir).select("p_partkey", spelt("p_partkey", *forms).alias("n")).select(
        "p_partkey",
        "n",
        F.array_join(T.camel_tokens(n), " ").alias("parts"),
        T.snake(n).alias("snake"),
        T.plural(n).alias("plural"),
        T.singular(n).alias("singular"),
        T.column_key(n).alias("key"),
        T.stem(n).alias("stem"),
        T.identifier(n).alias("identifier"),
        T.abbreviate(n).alias("short"),
        T.slug(n).alias("slug"),
    )


@query("str_25_first_match", "SELECT doc_id, coalesce(length(nullif(regexp_extract(lower(text), '^((?s).*?)\\bthe\\b', 0), '')) - 2, 0)::INT AS place FROM documents WHERE lang = 'en'")
def _(spark, sf_dir):
    return docs(spark, sf_dir).where("lang = 'en'").select("doc_id", T.first_word_match(F.col("text"), "the").alias("place"))


@query("str_26_28_templates", "SELECT s_suppkey, 'each supplier name of supplier ' || s_name || ' has balance ' || floor(s_acctbal)::BIGINT AS filled, '{supplier_name}' AS slot, 'supplier name' AS stripped FROM supplier")
def _(spark, sf_dir):
    template = F.lit("{supplier_name}")
    filled = T.fill(F.concat(F.lit("each "), T.strip_slots(template), F.lit(" of supplier {n} has balance {b}")), {"n": F.col("s_name"), "b": F.floor("s_acctbal").cast("string")})
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.regexp_replace(filled, "x^", "").alias("filled"), template.alias("slot"), T.strip_slots(template).alias("stripped"))


_FIRST_LINE = "string_split(text, chr(10))[1]"
_KEPT = ", ".join(f"'{w}'" for w in T.STRUCTURE_WORDS)


@query(
    "str_27_skeleton",
    f"""SELECT k AS skeleton, count(*) AS n FROM (SELECT regexp_replace(array_to_string([CASE WHEN regexp_matches(t, '^\\{{.*\\}}$') THEN '§' WHEN t IN ({_KEPT}) THEN t ELSE '·' END FOR t IN
    [x FOR x IN string_split_regex(regexp_replace(lower({_FIRST_LINE}), '[.,;:!?]', '', 'g'), '[ \\t\\n\\r]+') IF x <> '']], ' '), '·( ·)+', '·', 'g') AS k FROM documents WHERE lang = 'en') GROUP BY 1""",
)
def _(spark, sf_dir):
    first = F.element_at(F.split("text", "\n"), 1)
    return docs(spark, sf_dir).where("lang = 'en'").groupBy(T.skeleton(first).alias("skeleton")).agg(F.count("*").alias("n"))


_HTML = "html"
for _p, _r in ((r"(?is)<(script|style|nav|header|footer|aside)\b.*?</(script|style|nav|header|footer|aside)>", "' '"), (r"(?s)<!--.*?-->", "' '"), (r"(?s)<[^>]*>", "chr(10)")):
    _HTML = f"regexp_replace({_HTML}, '{_p}', {_r}, 'g')"
for _e, _l in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " "), ("&amp;", "&")):
    _HTML = f"replace({_HTML}, '{_e}', '{_l}')"
_HTML = f"regexp_replace(regexp_replace({_HTML}, '[ \\t]+', ' ', 'g'), ' ?\\n ?', chr(10), 'g')"
_HTML = f"regexp_replace(regexp_replace({_HTML}, '\\n{{2,}}', chr(10), 'g'), '^\\n|\\n$', '', 'g')"


@query("str_29_html_text", f"SELECT page_id, {_HTML} AS body FROM pages")
def _(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.html_text(F.col("html")).alias("body"))


@query("str_31_paragraph_chunks")
def _(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.posexplode(T.chunk_paragraphs(F.col("text"))).alias("chunk", "body"))


@query("str_34_35_sql_parts", f"SELECT p_partkey, {_FIRST} || ',top_' || p_size || ',' || {_LAST[1]} AS names, lower(p_type) || ',s.' || {_FIRST} AS tables FROM part")
def _(spark, sf_dir):
    """Statements made of every part's words: a plain column, one with another name, a call of two arguments; two tables, one of a schema."""
    made = F.format_string("SELECT a.%s, max(v) AS top_%d, count(x, %s) FROM %s JOIN s.%s ON 1 = 1", "first", "p_size", "last", F.lower("p_type"), "first")
    listed = F.regexp_extract("sql", r"(?i)^select (.*?) from ", 1)
    return parts(spark, sf_dir).select("p_partkey", made.alias("sql")).select("p_partkey", F.array_join(T.select_names(listed), ",").alias("names"), F.array_join(T.table_references(F.col("sql")), ",").alias("tables"))


@query("str_36_closed_list", f"SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'open|' || {_FIRST} || '|' || {_LAST[1]} WHEN 3 THEN {_FIRST} || '|' || p_size ELSE '' END AS options FROM part")
def _(spark, sf_dir):
    given = (F.format_string("The state (open, %s or %s).", "first", "last"), F.format_string("No list (only %s).", "first"), F.format_string("Some (e.g. %s, %s).", "first", "last"), F.format_string("Two (%s, %d) here", "first", "p_size"))
    return parts(spark, sf_dir).select("p_partkey", F.array_join(T.closed_list(spelt("p_partkey", *given)), "|").alias("options"))


@query("str_37_39_lengths", "SELECT lang, count(*) FILTER (length(text) BETWEEN 400 AND 20000) AS fits, sum(length(text[1:300]))::BIGINT AS cut FROM documents GROUP BY 1")
def _(spark, sf_dir):
    return docs(spark, sf_dir).groupBy("lang").agg(F.count_if(F.length("text").between(400, 20000)).alias("fits"), F.sum(F.length(F.substring("text", 1, 300))).alias("cut"))


@query("dtm_01_02_parse_format", "SELECT o_orderkey, strftime(try_strptime(strftime(o_orderdate, '%Y-%m-%d'), '%Y-%m-%d'), '%d/%m/%Y') AS day, try_strptime('2024-13-01', '%Y-%m-%d') IS NULL AS bad FROM orders")
def _(spark, sf_dir):
    day = D.parse_iso(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.date_format(day, "dd/MM/yyyy").alias("day"), D.parse_iso(F.lit("2024-13-01")).isNull().alias("bad"))


@query("dtm_03_end_of", "SELECT event_id, strftime(date_trunc('second', ts) + greatest(1, floor(value)::INT) * INTERVAL 1 second, '%Y-%m-%d %H:%M:%S') AS finished FROM events")
def _(spark, sf_dir):
    end = D.end_of(F.date_trunc("second", F.col("ts").cast("timestamp")), F.floor("value").cast("int"))
    return table(spark, sf_dir, "events").select("event_id", F.date_format(end, "yyyy-MM-dd HH:mm:ss").alias("finished"))


@query("dtm_04_role", f"SELECT p_partkey, CASE WHEN regexp_matches(n, 'start|begin|created|issued|effective|opened') THEN 'start' WHEN regexp_matches(n, 'end|finish|stop|closed|completed|expir') THEN 'end' END AS role FROM (SELECT p_partkey, {_FIRST} || ['_start_date', 'closedat', '_begin_end', '_amount', '_expiry', '_issued', ''][p_partkey % 7 + 1] AS n FROM part)")
def _(spark, sf_dir):
    name = spelt("p_partkey", *(F.concat("first", F.lit(x)) for x in ("_start_date", "ClosedAt", "_begin_end", "_amount", "_expiry", "_issued", "")))
    return parts(spark, sf_dir).select("p_partkey", D.role(name).alias("role"))


@query("dtm_05_06_quarters", "SELECT CASE WHEN o_orderdate < date_trunc('quarter', DATE '1998-05-20') THEN year(o_orderdate) || 'Q' || quarter(o_orderdate) END AS archive, count(*) AS n, CAST(min(date_trunc('quarter', o_orderdate)) AS DATE) AS first_quarter FROM orders GROUP BY 1")
def _(spark, sf_dir):
    day = F.to_date("o_orderdate")
    return table(spark, sf_dir, "orders").groupBy(D.archive_key(day, F.lit("1998-05-20").cast("date")).alias("archive")).agg(F.count("*").alias("n"), F.min(D.quarter_start(day)).alias("first_quarter"))


@query("dtm_07_09_spans", "SELECT user_id, strftime(min(ts), '%Y%m%dT%H%M%SZ') || '_' || user_id AS run_id, (epoch(date_trunc('second', max(ts))) - epoch(date_trunc('second', min(ts))))::BIGINT AS seconds, CAST(DATE '2022-03-01' + (17 * user_id)::INT AS DATE) AS day FROM events GROUP BY 1")
def _(spark, sf_dir):
    ts = F.col("ts").cast("timestamp")
    return (
        table(spark, sf_dir, "events")
        .groupBy("user_id")
        .agg(
            F.concat_ws("_", F.date_format(F.min(ts), "yyyyMMdd'T'HHmmss'Z'"), F.col("user_id").cast("string")).alias("run_id"),
            (F.unix_timestamp(F.max(ts)) - F.unix_timestamp(F.min(ts))).alias("seconds"),
        )
        .withColumn("day", F.date_add(F.lit("2022-03-01").cast("date"), (F.col("user_id") * 17).cast("int")))
    )


_DRAW = "('0x' || sha256({k})[1:{n}])::BIGINT"


@query("hsh_01_04_splits", f"""SELECT doc_id, {_DRAW.format(k='doc_id::VARCHAR', n=12)} % 10000 / 10000.0 < 0.05 AS held,
  CASE WHEN {_DRAW.format(k='doc_id::VARCHAR', n=12)} / 281474976710655.0 < 0.1 THEN 'test' WHEN {_DRAW.format(k='doc_id::VARCHAR', n=12)} / 281474976710655.0 < 0.2 THEN 'val' ELSE 'train' END AS three,
  CASE WHEN {_DRAW.format(k="'7:' || doc_id", n=12)} % 100 < 80 THEN 'train' WHEN {_DRAW.format(k="'7:' || doc_id", n=12)} % 100 < 90 THEN 'val' ELSE 'test' END AS percent,
  {_DRAW.format(k='source', n=8)} / 4294967295.0 < 0.3 AS topic_held FROM documents""")
def _(spark, sf_dir):
    k = F.col("doc_id").cast("string")
    return docs(spark, sf_dir).select("doc_id", H.permille_split(k, 0.05).alias("held"), H.three_way(k, 0.1, 0.1).alias("three"), H.percent_split(k, "7").alias("percent"), H.holdout(F.col("source"), 0.3).alias("topic_held"))


@query("hsh_05_column_key", "SELECT p_brand, sha256(string_agg(p_name, chr(0) ORDER BY p_partkey)) AS key FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS r FROM part) WHERE r <= 50 GROUP BY 1")
def _(spark, sf_dir):
    first = first_rows(table(spark, sf_dir, "part").select("p_brand", "p_partkey", "p_name"), ["p_brand"], ["p_partkey"], 50)
    cells = F.transform(F.sort_array(F.collect_list(F.struct("p_partkey", "p_name"))), lambda x: x["p_name"])
    return first.groupBy("p_brand").agg(cells.alias("cells")).select("p_brand", H.column_key(F.col("cells")).alias("key"))


@query("hsh_06_uuid5", "SELECT n_nationkey, 5 AS version, 36 AS size FROM nation")
def _(spark, sf_dir):
    run = H.uuid5("6ba7b8119dad11d180b400c04fd430c8", F.concat(F.lit("https://jobs/"), "n_name"))
    return table(spark, sf_dir, "nation").select("n_nationkey", F.substring(run, 15, 1).cast("int").alias("version"), F.length(run).alias("size"))


@query("hsh_08_09_rank_path", "SELECT n_name, row_number() OVER (ORDER BY n_name) - 1 AS rank, sha256('v1|' || (row_number() OVER (ORDER BY n_name) - 1)) AS path_id FROM nation")
def _(spark, sf_dir):
    from pyspark.sql import Window

    ranked = table(spark, sf_dir, "nation").select("n_name", (F.row_number().over(Window.orderBy("n_name")) - 1).cast("long").alias("rank"))
    return ranked.withColumn("path_id", F.sha2(F.concat(F.lit("v1|"), F.col("rank").cast("string")).cast("binary"), 256))


@query("hsh_10_manifest_root", "SELECT sha256(string_agg(h, '' ORDER BY h))[1:12] AS root FROM (SELECT sha256(r_name) AS h FROM region)")
def _(spark, sf_dir):
    hashes = F.sort_array(F.collect_list(F.sha2(F.col("r_name").cast("binary"), 256)))
    return table(spark, sf_dir, "region").agg(F.substring(F.sha2(F.array_join(hashes, "").cast("binary"), 256), 1, 12).alias("root"))


@query("hsh_11_choice", "SELECT c_custkey, ('0x' || sha256('pick:' || c_custkey)[1:12])::BIGINT % 5 AS choice FROM customer")
def _(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", (H.draw(F.col("c_custkey"), "pick") % 5).alias("choice"))


@query("hsh_12_uuid7", "SELECT event_id, u, event_id % 5 > 0 AS ok FROM (SELECT event_id, m[1:8] || '-' || m[9:12] || CASE WHEN event_id % 5 > 0 THEN '-7' ELSE '-4' END || r[1:3] || '-' || '89ab'[('0x' || r[4])::INT % 4 + 1] || r[5:7] || '-' || r[8:19] AS u FROM (SELECT event_id, lpad(lower(to_hex(epoch_us(ts) // 1000)), 12, '0') AS m, sha256('id:' || event_id) AS r FROM events))")
def _(spark, sf_dir):
    minted = H.uuid7(F.col("ts").cast("timestamp"), F.concat(F.lit("id:"), F.col("event_id").cast("string")))
    # a fifth with another version: these are refused
    u = F.when(F.col("event_id") % 5 > 0, minted).otherwise(F.overlay(minted, F.lit("4"), F.lit(15)))
    return table(spark, sf_dir, "events").select("event_id", u.alias("u")).withColumn("ok", H.is_uuid7(F.col("u")))
