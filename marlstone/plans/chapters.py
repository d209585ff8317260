"""Queries of chapter scores: documents against words of benchmark items, tables' headers against a vocabulary."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.operators import chapters as C
from marlstone.plans.catalog import query
from marlstone.storage import table

_N = "(SELECT count(*) FROM benchmark)"


def _words(s, d):
    """Of each document the words of the benchmark item whose place is the document's id, modulo the items."""
    from marlstone.operators.windows import numbered

    items = numbered(table(s, d, "benchmark").select("item_id", "text"), [F.col("item_id")], "k")
    n = items.count()
    each = items.select("k", F.split("text", " ").alias("w"))
    return table(s, d, "documents").select(F.col("doc_id").alias("id"), (F.col("doc_id") % n).alias("k")).join(each, "k")


def _some(words, every):
    return words.where(every).select("id", F.explode("w").alias("item"))


@query(
    "doc_15_cell_fidelity",
    f"SELECT doc_id AS id, len(w)::BIGINT AS n_items, len([x FOR x IN w IF contains(lower(text), x)])::BIGINT AS n_found FROM (SELECT doc_id, d.text, list_distinct([lower(trim(x)) FOR x IN string_split(b.text, ' ') IF trim(x) <> '']) AS w FROM documents d JOIN (SELECT row_number() OVER (ORDER BY item_id) - 1 AS k, text FROM benchmark) b ON k = doc_id % {_N})",
)
def _(s, d):
    texts = table(s, d, "documents").select(F.col("doc_id").alias("id"), "text")
    return C.found_shares(texts, _some(_words(s, d), "true"))


@query(
    "doc_17_text_entailment",
    f"""WITH w AS (SELECT doc_id, d.text, [lower(trim(x)) FOR x IN string_split(b.text, ' ') IF trim(x) <> ''] AS w FROM documents d JOIN (SELECT row_number() OVER (ORDER BY item_id) - 1 AS k, text FROM benchmark) b ON k = doc_id % {_N}),
p AS (SELECT doc_id, text, CASE WHEN doc_id % 3 > 0 THEN list_distinct([x FOR x IN w IF length(x) > 4]) END AS c, CASE WHEN doc_id % 5 > 0 THEN list_distinct([x FOR x IN w IF length(x) <= 4]) END AS v FROM w),
q AS (SELECT doc_id, CASE WHEN len(c) > 0 THEN len([x FOR x IN c IF contains(lower(text), x)]) / len(c) END AS c, CASE WHEN len(v) > 0 THEN len([x FOR x IN v IF contains(lower(text), x)]) / len(v) END AS v FROM p)
SELECT doc_id AS id, round(coalesce(0.6::DOUBLE * c + 0.4::DOUBLE * v, c, v, 0), 6)::DOUBLE AS score FROM q""",
)
def _(s, d):
    """Long words of the item are concepts, short ones values; every third document has no concepts, every fifth no values."""
    texts, words = table(s, d, "documents").select(F.col("doc_id").alias("id"), "text"), _words(s, d)
    found = C.entailment(texts, _some(words, "id % 3 > 0").where(F.char_length(F.trim("item")) > 4), _some(words, "id % 5 > 0").where(F.char_length(F.trim("item")) <= 4))
    return found.select("id", F.round("score", 6).alias("score"))


@query(
    "doc_14_16_headers",
    """WITH v AS (SELECT DISTINCT lower(left(string_split(p_name, ' ')[2], 3 + p_size % 4)) AS x FROM part WHERE p_brand = 'Brand#1'), w AS (SELECT DISTINCT p_brand, p_name, unnest(string_split(lower(p_name), ' ')) AS t FROM part), k AS (SELECT DISTINCT t FROM w JOIN v ON contains(v.x, t) OR contains(t, v.x))
SELECT p_brand AS id, round(avg(met::INT), 6) AS share FROM (SELECT p_brand, p_name, bool_or(t IN (SELECT t FROM k)) AS met FROM w GROUP BY 1, 2) GROUP BY 1""",
)
def _(s, d):
    """Part names stand for the headers of their brand's table; one brand's name endings, cut at several lengths, are the vocabulary."""
    parts = table(s, d, "part")
    ending = F.substr(F.get(F.split("p_name", " "), F.lit(1)), F.lit(1), 3 + F.col("p_size") % 4)
    vocabulary = parts.where("p_brand = 'Brand#1'").select(ending.alias("word"))
    return C.header_shares(parts.select(F.col("p_brand").alias("id"), F.col("p_name").alias("header")), vocabulary).select("id", F.round("share", 6).alias("share"))
