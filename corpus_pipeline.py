"""From raw documents to packed sequences, in five stages.

Each stage gets what its predecessor kept, written as Parquet and read again;
all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm import decontaminate, pii, quality, simhash
from marlstone.llm.queries import DEMONSTRATION_KEY, packed
from marlstone.llm.text import hashable
from marlstone.storage import discard, stash, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _row(columns: list[str]) -> Column:
    """Columns in one struct, out of the way of every name that a stage adds."""
    return F.struct(*(F.col(f"`{c}`") for c in columns), F.lit(0).alias("__none")).alias("doc")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go; the others lose their failing lines, and ``n_chars`` follows.

    Null and empty texts have too few words and go; very long ones are judged
    whole; repeated rows are judged alike; no rows give no rows; other columns
    stay, also those with the names of the figures.
    """
    rest = [c for c in docs.columns if c not in ("text", "n_chars")]
    kept = quality.quality(docs.select("text", _row(rest))).where("kept")
    new = {"text": F.col("cleaned"), "n_chars": F.char_length("cleaned").cast("long")}
    return kept.select(*(new[c].alias(c) if c in new else F.col("doc").getField(c).alias(c) for c in docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates, one row stays: that with the smallest id (rows without an id come last).

    Rows are told apart by a key of their own, not by their id: ids may be null or shared by unrelated texts.
    Among rows of one id two hashes of the row decide, and the written number only between equal rows.
    Null, empty and blank texts are near duplicates of each other; very long ones are
    compared whole; no rows give no rows; other columns of any name and type stay.
    """
    keyed = stash(docs.select(_row(docs.columns), F.monotonically_increasing_id().alias("row")), "rows")
    seen = [F.col("doc").getField(f.name) for f in docs.schema if hashable(f.dataType)]
    doc_id, text = (F.col("doc").getField(c) for c in ("doc_id", "text"))
    key = F.struct(doc_id.isNull(), doc_id, F.xxhash64(*seen), F.xxhash64(F.lit(1), *seen), F.col("row").alias("number"))
    found = simhash.near_duplicates(keyed.select(key.alias("key"), text.alias("text")), id="key", radius=4)
    least = found.where("key.number = component_id.number").select(F.col("component_id.number").alias("row"))
    return keyed.join(least, "row", "left_semi").select(*(F.col("doc").getField(c).alias(c) for c in docs.columns))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold a benchmark passage go, whatever their id; null and empty texts hold none.

    Very long texts are searched whole; repeated rows are judged alike; no rows
    give no rows; other columns stay.
    """
    return decontaminate.without_matches(docs, table(spark, sf_dir, "benchmark"))


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data become pseudonyms of their format; all rows and columns stay, null and empty texts as they are.

    Very long texts are worked on whole; repeated rows get equal texts; no rows give no rows.
    """
    return pii.pseudonyms(docs, pii.session_key(spark, DEMONSTRATION_KEY), counts=False).select(docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, as sequences of at most 1024 tokens; null and empty texts are their end id alone, other columns go.

    Very long texts are cut and packed whole; repeated rows are documents of their own; no rows give no rows.
    """
    return packed(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("private data", private_data),
    ("packing", packing),
]

#: The fingerprints' hash and the tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs, written = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = stash(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if written is not None:
            discard(written)  # nothing reads it again
        written = docs
    return docs
