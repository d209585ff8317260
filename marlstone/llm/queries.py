"""The queries of this subpackage, with the SQL they are held against.

Each query applies its operator with production parameters to the whole
intended table and derives the contract's digest columns from its output.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm import decontaminate, packing, pii, quality, queries_dialogue, secrets, sharding, simhash, simple8b, substring, warc
from marlstone.storage import table

#: For the registered query and the pipeline where the session names no key: anyone can undo these pseudonyms.
DEMONSTRATION_KEY = b"demonstration key, not a secret"

CONVERSATION_LIMITS = packing.Limits(tokens=2048, segments=6, loss=1024)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**queries_dialogue.QUERIES}
ORACLES: dict[str, str] = {**queries_dialogue.ORACLES}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.quality(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lines_removed"
    )


ORACLES["op6_quality_rules"] = r"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
words AS (SELECT r, [x FOR x IN string_split_regex(text, '[\x20\x09-\x0D]+') IF x <> ''] AS w FROM docs),
windows AS (
  SELECT r, unnest(range(1, len(w) - 1)) AS i, unnest([w[j] || ' ' || w[j + 1] || ' ' || w[j + 2] FOR j IN range(1, len(w) - 1)]) AS g
  FROM words WHERE len(w) >= 3
),
twice AS (SELECT r, i FROM windows QUALIFY count(*) OVER (PARTITION BY r, g) > 1),
repeats AS (
  SELECT r, sum(least(3, i - before)) AS n FROM (SELECT r, i, coalesce(lag(i) OVER (PARTITION BY r ORDER BY i), i - 3) AS before FROM twice) GROUP BY r
),
lines AS (
  SELECT r, l, regexp_matches(l, '[.!?…:;。！？]["''”’)\]»]*([\x20\x09-\x0D]|\z)')
    AND length(regexp_replace(l, '[\p{L}\p{M}\p{N}\x20\x09-\x0D]+', '', 'g')) <= 0.2 * length(l)
    AND length(l) - length(translate(l, '|»›', '')) < 3
    AND NOT regexp_matches(l, '(?i)\b(all rights reserved|licen[sc]ed under|released under the|creative commons|terms of (use|service)|privacy policy|cookie policy|uses cookies|enable javascript|lorem ipsum)\b') AS good
  FROM (SELECT r, unnest(string_split(text, chr(10))) AS l FROM docs) WHERE regexp_matches(l, '[^\x20\x09-\x0D]')
),
by_line AS (
  SELECT r, count(*) - count(DISTINCT l) AS dup, count(*) FILTER (NOT good) AS removed, sum(length(l)) AS total, coalesce(sum(length(l)) FILTER (good), 0) AS rest
  FROM lines GROUP BY r
),
figures AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    (length(text) - length(translate(text, '#*$%&|<>', '')))::BIGINT AS n_symbols, coalesce(dup, 0)::BIGINT AS n_dup_lines,
    coalesce(n, 0)::BIGINT AS n_repeat_words, coalesce(removed, 0)::BIGINT AS lines_removed, total, rest
  FROM docs JOIN words USING (r) LEFT JOIN repeats USING (r) LEFT JOIN by_line USING (r)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND coalesce(1 - rest / total, 0) <= 0.35 AS kept, lines_removed
FROM figures
"""


@query
def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = simhash.near_duplicates(docs, radius=4)
    return found.select("doc_id", simhash.hexadecimal(F.col("fp")).alias("fingerprint"), "component_id")


@query
def op4_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.pseudonyms(docs, pii.session_key(spark, DEMONSTRATION_KEY))


@query
def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.matches(docs, table(spark, sf_dir, "benchmark"))


def packed(docs: DataFrame) -> DataFrame:
    """The packing contract's columns for ``docs``."""
    found = packing.pack_documents(docs, "byte_bpe_50k.json", end_id=0, limits=packing.Limits(tokens=1024, segments=1024, loss=1024))
    return found.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query
def op10_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def pack_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instruction data under three limits that all bind: tokens, segments, and tokens of the assistant's turns."""
    found = packing.conversation_tokens(table(spark, sf_dir, "conversations"), "byte_bpe_50k.json", end_id=50256)
    return packing.pack_examples(found, "n_tokens", "n_loss", CONVERSATION_LIMITS)


@query
def op8_lookup_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id")
    return sharding.place(docs, "doc_id", [f"shard-{i:03}" for i in range(128)])


@query
def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"] != "entropy")
    return found.select("doc_id", *(count(k) for k in secrets.KINDS), F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


@query
def op2_simple8b_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    read = simple8b.read_ids(simple8b.write_ids(docs, "word_bpe_49k.json", end_id=1))
    return read.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query
def op3_warc_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return warc.read_archives(warc.write_archives(pages)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query
def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    left = substring.remove_repeats(docs, width=35)
    return left.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
