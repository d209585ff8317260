"""Queries of term screens; the terms are words of the benchmark, whose passages occur in the documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.operators.screens import screen_documents, screen_values
from marlstone.plans.catalog import query
from marlstone.storage import table


def benchmark_terms(s, d):
    """Of every item the first three words are a clear term and the fifth an ambiguous one; those of every seventh item are allowed."""
    w = F.split(F.trim("text"), r"[\x20\x09-\x0D]+")
    items = table(s, d, "benchmark").where("text IS NOT NULL").select("item_id", w.alias("w")).where(F.size("w") >= 5)
    each = F.array(F.struct(F.array_join(F.slice("w", 1, 3), " ").alias("term"), F.lit("clear").alias("tier")), F.struct(F.get("w", F.lit(4)).alias("term"), F.lit("ambiguous").alias("tier")))
    return items.select(F.explode(each).alias("t"), (F.col("item_id") % 7 == 0).alias("allowed")).select("t.term", "t.tier", "allowed")


@query("dq_03_04_term_screen")
def _(s, d):
    """All lines of all documents."""
    return screen_documents(table(s, d, "documents"), benchmark_terms(s, d))


@query(
    "dq_01_entity_values",
    "SELECT p_partkey, p_name, CASE WHEN p_name LIKE '% ring%' OR p_name LIKE 'ring %' OR p_name = 'ring' THEN 'ring' ELSE 'small bolt' END AS term, 'clear' AS tier FROM part WHERE regexp_matches(p_name, '\\b(ring|small bolt)\\b')",
)
def _(s, d):
    terms = s.createDataFrame([("ring", "clear", False), ("Small Bolt", "clear", False), ("red", "ambiguous", False)], "term string, tier string, allowed boolean")
    return screen_values(table(s, d, "part").select("p_partkey", "p_name"), terms, "p_name")
