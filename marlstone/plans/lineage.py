"""Queries of lineage events, lowered schemas, statements, session streams and read models."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from marlstone.operators import graph as G
from marlstone.operators import windows as W
from marlstone.plans.catalog import query
from marlstone.storage import scratch, table

# ---- lineage


@query("grf_04_column_lineage", "WITH p AS (SELECT p_partkey, string_split(p_name, ' ') AS w FROM part), x AS (SELECT p_partkey, w, unnest(range(1, len(w) + 1)) AS i FROM p) SELECT 'part' || p_partkey AS a, 'part' || p_partkey || '.' || w[i] AS b, 'HAS_COLUMN' AS kind FROM x UNION SELECT 'part' || p_partkey || '.' || w[i], 'source.' || w[i], 'DERIVES_FROM' FROM x")
def _(s, d):
    k = F.concat(F.lit("part"), F.col("p_partkey").cast("string"))
    x = table(s, d, "part").select(k.alias("t"), F.explode(F.split("p_name", " ")).alias("w")).select("t", "w", F.concat_ws(".", "t", "w").alias("c"))
    return x.select(F.col("t").alias("a"), F.col("c").alias("b"), F.lit("HAS_COLUMN").alias("kind")).union(x.select("c", F.concat(F.lit("source."), "w"), F.lit("DERIVES_FROM"))).distinct()


@query("grf_11_token_backed", "SELECT c_custkey, EXISTS (SELECT 1 FROM events WHERE user_id = c_custkey) AS backed FROM customer")
def _(s, d):
    tokens = table(s, d, "events").select(F.col("user_id").alias("c_custkey")).distinct().withColumn("hit", F.lit(True))
    return table(s, d, "customer").select("c_custkey").join(tokens, "c_custkey", "left").select("c_custkey", F.coalesce("hit", F.lit(False)).alias("backed"))


@query("grf_12_pool_lineage", "SELECT sha256('pools:' || source)[1:12] AS run, 'pool/' || source || '/' || lang AS dataset, count(*) AS n FROM documents GROUP BY source, lang")
def _(s, d):
    """One run a job key, one dataset a pool."""
    pools = table(s, d, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"))
    return pools.select(F.substring(F.sha2(F.concat(F.lit("pools:"), "source").cast("binary"), 256), 1, 12).alias("run"), F.concat_ws("/", F.lit("pool"), "source", "lang").alias("dataset"), "n")


@query("grf_13_corpus_lineage", "SELECT 'run/' || lang AS a, 'doc/' || doc_id AS b, 'OUTPUTS' AS kind FROM documents UNION ALL SELECT 'source/' || source, 'run/' || lang, 'INPUT_TO' FROM (SELECT DISTINCT source, lang FROM documents) UNION ALL SELECT DISTINCT 'run/' || lang, 'corpus', 'PART_OF' FROM documents")
def _(s, d):
    docs = table(s, d, "documents").select("doc_id", F.concat(F.lit("source/"), "source").alias("source"), F.concat(F.lit("run/"), "lang").alias("run"))
    out = docs.select(F.col("run").alias("a"), F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("b"), F.lit("OUTPUTS").alias("kind"))
    return out.union(docs.select("source", "run", F.lit("INPUT_TO")).distinct()).union(docs.select("run", F.lit("corpus"), F.lit("PART_OF")).distinct())


@query("grf_15_step_events", "SELECT event_id, event_type AS step, CASE event_type WHEN 'click' THEN value::VARCHAR ELSE json_extract_string(props, '$.k') END AS facet, CASE WHEN event_type = 'error' THEN 'FAIL' ELSE 'COMPLETE' END AS state FROM events WHERE event_type <> 'click'")
def _(s, d):
    e = table(s, d, "events").where("event_type <> 'click'")
    facets = F.struct(F.get_json_object("props", "$.k").alias("k"), F.col("value").alias("value"))
    built = e.select("event_id", F.col("event_type").alias("step"), facets.alias("facets"), F.when(F.col("event_type") == "error", "FAIL").otherwise("COMPLETE").alias("state"))
    return built.select("event_id", "step", F.col("facets.k").alias("facet"), "state")


@query("grf_20_reference_depth", "WITH RECURSIVE w(node, spot, depth) AS (SELECT c_custkey, c_custkey, 0 FROM customer UNION ALL SELECT node, spot // 3, depth + 1 FROM w WHERE spot > 0) SELECT node % 7 AS part, max(depth) AS depth FROM w GROUP BY 1")
def _(s, d):
    """The longest chain of references within each part of the nodes."""
    c = table(s, d, "customer").where("c_custkey > 0").select(F.col("c_custkey").alias("child"), F.floor(F.col("c_custkey") / 3).cast("long").alias("parent"))
    return G.climbed(c).groupBy((F.col("node") % 7).alias("part")).agg(F.max("distance").alias("depth"))


@query("hie_11_domain_group", "SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN '_unassigned' ELSE string_split(p_brand, '#')[1] || (p_size % 5) END AS grp FROM part")
def _(s, d):
    code = F.when(F.col("p_size") % 5 != 0, F.concat(F.split_part("p_brand", F.lit("#"), F.lit(1)), (F.col("p_size") % 5).cast("string"), F.lit("."), "p_type"))
    return table(s, d, "part").select("p_partkey", F.coalesce(F.split_part(code, F.lit("."), F.lit(1)), F.lit("_unassigned")).alias("grp"))


@query("hie_14_chapter_check", "WITH v AS (SELECT l_orderkey, l_linenumber, l_discount > 0.08 AND l_tax > 0.04 AS bad FROM lineitem) SELECT l_orderkey, bool_or(bad) AS failed, min(l_linenumber) FILTER (bad) AS first FROM v GROUP BY 1")
def _(s, d):
    """A chapter's values in one pass: whether any breaks the gate, and which does first."""
    bad = (F.col("l_discount") > 0.08) & (F.col("l_tax") > 0.04)
    return table(s, d, "lineitem").groupBy("l_orderkey").agg(F.bool_or(bad).alias("failed"), F.min(F.when(bad, F.col("l_linenumber"))).alias("first"))


# ---- schemas

_TEMPLATE = "SELECT lower(replace(p_brand, '#', '_')) AS tab, lower(p_type) AS slot, count(*) AS n, min(p_size) AS least FROM part GROUP BY 1, 2"


def _slots(s, d):
    return table(s, d, "part").groupBy(F.lower(F.replace("p_brand", F.lit("#"), F.lit("_"))).alias("tab"), F.lower("p_type").alias("slot")).agg(F.count("*").alias("n"), F.min("p_size").alias("least"))


@query("sch_07_lowered_tables", f"SELECT tab, slot AS col, CASE WHEN n > 3 THEN 'DECIMAL' ELSE 'VARCHAR(255)' END AS kind, least <= 2 AS required FROM ({_TEMPLATE}) UNION ALL SELECT DISTINCT tab, tab || '_id', 'INTEGER', true FROM ({_TEMPLATE}) UNION ALL SELECT DISTINCT tab, 'valid_from', 'DATE', false FROM ({_TEMPLATE})")
def _(s, d):
    """A template's table: a key, a column for each slot (required by its restriction), and the anchor's attribute."""
    slots = _slots(s, d)
    own = slots.select("tab", F.col("slot").alias("col"), F.when(F.col("n") > 3, "DECIMAL").otherwise("VARCHAR(255)").alias("kind"), (F.col("least") <= 2).alias("required"))
    tabs = slots.select("tab").distinct()
    fixed = F.array(F.struct(F.concat("tab", F.lit("_id")).alias("col"), F.lit("INTEGER").alias("kind"), F.lit(True).alias("required")), F.struct(F.lit("valid_from").alias("col"), F.lit("DATE").alias("kind"), F.lit(False).alias("required")))
    return own.union(tabs.select("tab", F.inline(fixed)))


@query("sch_12_realised", f"WITH t AS (SELECT tab, list(slot ORDER BY slot) AS s FROM ({_TEMPLATE}) GROUP BY 1), k AS (SELECT *, length(tab) % 3 AS p FROM t) SELECT CASE p WHEN 0 THEN tab WHEN 1 THEN tab || '_eav' ELSE tab || '_' || x END AS tab, CASE p WHEN 0 THEN array_to_string(s, ',') WHEN 1 THEN 'entity,attribute,value' ELSE tab || '_id,' || x || '_id' END AS cols FROM (SELECT tab, s, p, unnest(CASE WHEN p = 2 THEN s ELSE [''] END) AS x FROM k)")
def _(s, d):
    """Each template in the layout of its profile: wide, entity-attribute-value, or a junction for each slot."""
    t = _slots(s, d).groupBy("tab").agg(F.array_sort(F.collect_set("slot")).alias("s")).withColumn("p", F.length("tab") % 3)
    x = t.select("tab", "s", "p", F.explode(F.when(F.col("p") == 2, F.col("s")).otherwise(F.array(F.lit("")))).alias("x"))
    name = F.when(F.col("p") == 0, F.col("tab")).when(F.col("p") == 1, F.concat("tab", F.lit("_eav"))).otherwise(F.concat_ws("_", "tab", "x"))
    cols = F.when(F.col("p") == 0, F.array_join("s", ",")).when(F.col("p") == 1, "entity,attribute,value").otherwise(F.concat("tab", F.lit("_id,"), "x", F.lit("_id")))
    return x.select(name.alias("tab"), cols.alias("cols"))


@query("sch_27_construct", "SELECT 'order_' || o_orderkey AS tab, count(*) FILTER (l_linenumber IS NOT NULL) AS n_rows, CASE WHEN count(l_linenumber) > 4 THEN 'fact' ELSE 'detail' END AS role, 'customer_' || any_value(o_custkey) AS fk, any_value(o_orderdate)::DATE AS audit_at FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey")
def _(s, d):
    lines = table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    met = table(s, d, "orders").join(lines, "o_orderkey", "left")
    n = F.coalesce("n", F.lit(0))
    return met.select(F.concat(F.lit("order_"), F.col("o_orderkey").cast("string")).alias("tab"), n.cast("long").alias("n_rows"), F.when(n > 4, "fact").otherwise("detail").alias("role"), F.concat(F.lit("customer_"), F.col("o_custkey").cast("string")).alias("fk"), F.to_date("o_orderdate").alias("audit_at"))


@query("dq_05_spine_cells", "SELECT doc_id, n_chars FROM documents WHERE length(text) > 2000 AND NOT regexp_matches(text, '^[0-9]')")
def _(s, d):
    return table(s, d, "documents").where((F.length("text") > 2000) & ~F.col("text").rlike("^[0-9]")).select("doc_id", "n_chars")


# ---- statements and examples


@query("syn_02_cell_statements", "SELECT l_orderkey, l_linenumber, 'quantity of line ' || l_linenumber || ' is ' || CASE WHEN (l_orderkey + l_linenumber) % 2 = 0 THEN l_quantity::BIGINT ELSE l_quantity::BIGINT + 1 END AS statement, (l_orderkey + l_linenumber) % 2 = 0 AS label FROM lineitem")
def _(s, d):
    """A cell against a constant: the filter is another column than the target."""
    true = (F.col("l_orderkey") + F.col("l_linenumber")) % 2 == 0
    q = F.col("l_quantity").cast("long")
    text = F.concat(F.lit("quantity of line "), F.col("l_linenumber").cast("string"), F.lit(" is "), F.when(true, q).otherwise(q + 1).cast("string"))
    return table(s, d, "lineitem").select("l_orderkey", "l_linenumber", text.alias("statement"), true.alias("label"))


@query("syn_03_aggregate_pairs", "WITH a AS (SELECT p_brand, min(p_size) AS lo, max(p_size) AS hi, sum(p_size) AS total FROM part GROUP BY 1), f AS (UNPIVOT a ON lo, hi, total INTO NAME k VALUE v) SELECT x.p_brand, x.k AS a, y.k AS b, x.v > y.v AS label FROM f x JOIN f y ON x.p_brand = y.p_brand AND x.k < y.k")
def _(s, d):
    """An aggregate against another of the same group; counts take no part."""
    a = table(s, d, "part").groupBy("p_brand").agg(F.min("p_size").alias("lo"), F.max("p_size").alias("hi"), F.sum("p_size").alias("total"))
    v = {c: F.col(c).cast("long") for c in ("hi", "lo", "total")}
    pairs = [F.struct(F.lit(x).alias("a"), F.lit(y).alias("b"), (v[x] > v[y]).alias("label")) for x in v for y in v if x < y]
    return a.select("p_brand", F.inline(F.array(*pairs)))


@query("syn_06_fixed_budget", "SELECT doc_id, least(n_table, 128 - 4 - least(n_second, 62)) + least(n_second, 62) + 5 - 1 AS n_ids FROM (SELECT doc_id, octet_length(encode(text)) AS n_table, octet_length(encode(source || '/' || lang)) AS n_second FROM documents)")
def _(s, d):
    """BOS table SEP second SEP label EOS within 128 ids: the second part has at most half, the table the rest."""
    second = F.slice(W.byte_ids(F.concat_ws("/", "source", "lang")), 1, 62)
    ids = lambda *x: F.array(*map(F.lit, x))
    room = 128 - 4 - F.size(second)
    body = F.slice(W.byte_ids(F.substring("text", 1, 128)), F.lit(1), room)
    example = F.concat(ids(1), body, ids(3), second, ids(3, 2))
    return table(s, d, "documents").select("doc_id", F.size(example).cast("long").alias("n_ids"))


# ---- streams


def _frames(s, d):
    return table(s, d, "conversations").select(F.col("conv_id").cast("string").alias("session"), F.col("turn").cast("int").alias("seq"), F.col("turn").cast("int").alias("arrival"), "text")


_TERMS = ("the ", "on ", "que")
_WINDOWS = r"""WITH w AS (SELECT conv_id, regexp_replace(string_agg(text, '' ORDER BY turn), '[\x09-\x0D]', ' ', 'g') AS t, string_agg(text, '' ORDER BY turn) AS raw FROM conversations GROUP BY 1),
p AS (SELECT conv_id, raw, unnest(string_split(t, ' ')) AS x, generate_subscripts(string_split(t, ' '), 1) AS i FROM w),
o AS (SELECT conv_id, raw, x, i, sum(length(x) + 1) OVER (PARTITION BY conv_id ORDER BY i) - length(x) - 1 AS pos FROM p),
k AS (SELECT conv_id, raw, pos::BIGINT AS a, (pos + length(x))::BIGINT AS b, row_number() OVER (PARTITION BY conv_id ORDER BY i) - 1 AS j, count(*) OVER (PARTITION BY conv_id) AS n FROM o WHERE x <> ''),
s AS (SELECT *, j // 12 AS k FROM k WHERE j % 12 = 0 AND j // 12 < CASE WHEN conv_id % 2 = 0 THEN greatest(1, floor((n - 24) / 12) + 1) ELSE greatest(0, floor((n - 36) / 12) + 1) END),
v AS (SELECT s.conv_id, s.a, e.b, substring(s.raw, s.a + 1, e.b - s.a) AS body FROM s JOIN k e ON e.conv_id = s.conv_id AND e.j = least(s.n, s.j + 24) - 1)
SELECT conv_id::VARCHAR AS session, a AS start, b AS stop, label FROM v, (VALUES ('the '), ('on '), ('que')) t(label) WHERE contains(body, label)"""


@query("stm_01_06_session_stream", _WINDOWS)
def _(s, d):
    """Frames of sessions through the stateful stream, in three starts of one query; windows that were sent are not sent again."""
    from marlstone.streaming.events import run_in_parts, with_state_store
    from marlstone.streaming.sessions import session_windows, term_labels

    own = with_state_store(s, idle_batches=False)
    turns = table(own, d, "conversations")
    last = turns.groupBy("conv_id").agg(F.max("turn").alias("last"))
    frames = turns.join(last, "conv_id").select(
        F.col("conv_id").cast("string").alias("session"), F.col("turn").cast("int").alias("seq"), F.col("turn").alias("arrival"), "text", ((F.col("turn") == F.col("last")) & (F.col("conv_id") % 2 == 0)).alias("flush")
    )
    parts = [frames.where("arrival < 2"), frames.where("arrival BETWEEN 2 AND 3"), frames.where("arrival > 3")]
    return run_in_parts(own, parts, lambda x: session_windows(x, term_labels(_TERMS), 24, 12))


@query("stm_05_finished_frames", "SELECT conv_id::VARCHAR AS session, turn::INT AS seq, (length(text) - length(replace(text, 'the ', ''))) // 4 AS hits FROM conversations WHERE contains(text, 'the ')")
def _(s, d):
    """Each finished frame is scored at once, without state."""
    from marlstone.streaming.events import run_stream

    def admit(x):
        hits = F.floor((F.length("text") - F.length(F.replace("text", F.lit("the "), F.lit("")))) / 4).cast("long")
        return x.select("session", "seq", hits.alias("hits")).where("hits > 0")

    return run_stream(s, _frames(s, d), admit)


# ---- read models and functions of the caller


@query("api_02_run_detail", "SELECT user_id AS run, count(*) AS n, max(event_id) AS last, round(avg(value), 4) AS metric FROM events WHERE user_id IN (3, 5) GROUP BY 1")
def _(s, d):
    return table(s, d, "events").where(F.col("user_id").isin(3, 5)).groupBy(F.col("user_id").alias("run")).agg(F.count("*").alias("n"), F.max("event_id").alias("last"), F.round(F.avg("value"), 4).alias("metric"))


@query("api_05_06_tree", "SELECT r_name AS root, string_agg(n_name, ',' ORDER BY n_name) AS children FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY 1")
def _(s, d):
    met = table(s, d, "nation").join(table(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return met.groupBy(F.col("r_name").alias("root")).agg(F.array_join(F.array_sort(F.collect_list("n_name")), ",").alias("children"))


@query("api_08_ego_fallback", "SELECT DISTINCT l_suppkey + 1000000 AS other, 'live' AS origin FROM lineitem WHERE l_orderkey = 2")
def _(s, d):
    """A node's neighbours from the table that was built before, from the edges where it has none."""
    edges = table(s, d, "lineitem").select(F.col("l_orderkey").alias("a"), (F.col("l_suppkey") + 1_000_000).alias("b"))
    path = scratch(s, "ego")
    G.ego(edges, 1).select(F.lit(1).cast("long").alias("a"), "other").write.parquet(path)
    stored = s.read.parquet(path).where("a = 2").select("other", F.lit("stored").alias("origin"))
    return stored if not stored.isEmpty() else G.ego(edges, 2).select("other", F.lit("live").alias("origin"))


@query("api_09_note_resolution", "SELECT k AS id, min_by(root, prio) AS root FROM (SELECT c_custkey % 50 AS k, c_mktsegment AS root, length(c_mktsegment) * 1000 + ascii(c_mktsegment[1]) AS prio FROM customer) GROUP BY 1")
def _(s, d):
    prio = F.length("c_mktsegment") * 1000 + F.ascii("c_mktsegment")
    return table(s, d, "customer").groupBy((F.col("c_custkey") % 50).alias("id")).agg(F.min_by("c_mktsegment", prio).alias("root"))


@query("udf_02_generate", "SELECT n_nationkey, 'about ' || n_name AS text FROM nation")
def _(s, d):
    """A caller's generator over prompts, in batches."""
    @F.pandas_udf("string")
    def generate(prompts: pd.Series) -> pd.Series:
        return "about " + prompts

    return table(s, d, "nation").select("n_nationkey", generate("n_name").alias("text"))


@query("udf_03_statistic", "SELECT n_regionkey, round(max(length(n_name)) - min(length(n_name)), 4)::DOUBLE AS stat FROM nation GROUP BY 1")
def _(s, d):
    """A caller's statistic of small groups."""
    @F.pandas_udf("double")
    def spread(x: pd.Series) -> float:
        return float(x.max() - x.min())

    return table(s, d, "nation").groupBy("n_regionkey").agg(spread(F.length("n_name").cast("double")).alias("stat"))


@query("udf_04_handlers", "SELECT event_type, CASE event_type WHEN 'click' THEN count(*) WHEN 'view' THEN max(event_id) ELSE -1 END AS handled FROM events GROUP BY 1")
def _(s, d):
    """A registry of handlers by task type; types without one are marked."""
    handlers = {"click": F.count("*"), "view": F.max("event_id")}
    e = table(s, d, "events")
    done = None
    for kind, handler in handlers.items():
        own = e.where(F.col("event_type") == kind).groupBy("event_type").agg(handler.alias("handled"))
        done = own if done is None else done.union(own)
    rest = e.where(~F.col("event_type").isin(*handlers)).select("event_type", F.lit(-1).cast("long").alias("handled")).distinct()
    return done.union(rest)


@query("set_16_frame_replacement", "WITH f AS (SELECT user_id, event_id, event_id % 7 AS seq FROM events), l AS (SELECT *, min(seq) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS later FROM f) SELECT user_id, string_agg(seq::VARCHAR, '' ORDER BY seq) AS text FROM l WHERE later IS NULL OR later > seq GROUP BY 1")
def _(s, d):
    from marlstone.streaming.events import replace_frames

    seq = F.col("event_id") % 7
    return replace_frames(table(s, d, "events").select("user_id", "event_id", seq.alias("seq"), seq.cast("string").alias("text")), "user_id", "seq", "event_id", "text")
