"""How well texts and tables say what they should: cells found in texts, headers met by a vocabulary, concepts and values entailed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Weights of concepts and values in :func:`entailment`.
CONCEPTS, VALUES = 0.6, 0.4
_AT_ONCE = 256


def found_shares(texts: DataFrame, items: DataFrame) -> DataFrame:
    """DOC-15: ``(id, n_items, n_found)``: how many distinct items that are not blank of ``items(id, item)`` stand in the text ``texts(id, text)``.

    A text without items has no row. Case and blanks at the ends of items do not count. Items meet their text in lists of about
    256, so that a text with most of the items is many tasks' work; a null text holds nothing.
    """
    clean = items.select("id", F.lower(F.trim("item")).alias("word")).where("word <> ''").distinct().withColumnRenamed("word", "item")
    part = F.pmod(F.xxhash64("item"), F.greatest(F.lit(1), F.ceil(F.col("n") / _AT_ONCE)))
    counts = clean.groupBy("id").agg(F.count("*").alias("n"))
    listed = clean.join(counts, "id").groupBy("id", part.alias("part")).agg(F.collect_list("item").alias("items"))
    low = texts.select("id", F.lower("text").alias("text"))
    met = listed.join(low, "id")
    hits = F.size(F.filter("items", lambda x: F.coalesce(F.contains(F.col("text"), x), F.lit(False))))
    return met.select("id", F.size("items").alias("n"), hits.alias("hits")).groupBy("id").agg(F.sum("n").alias("n_items"), F.sum("hits").alias("n_found"))


def entailment(texts: DataFrame, concepts: DataFrame, values: DataFrame) -> DataFrame:
    """DOC-17: ``(id, score)`` for every text: 0.6 of the share of its concepts and 0.4 of that of its values; where a side is missing the other counts alone, where both are 0."""
    share = lambda items, name: found_shares(texts, items).select("id", (F.col("n_found") / F.col("n_items")).alias(name))
    both = texts.select("id").join(share(concepts, "c"), "id", "left").join(share(values, "v"), "id", "left")
    return both.select("id", F.coalesce(CONCEPTS * F.col("c") + VALUES * F.col("v"), "c", "v", F.lit(0.0)).alias("score"))


def _substrings(word: Column) -> Column:
    size = F.char_length(word)
    starts = F.sequence(F.lit(1), F.greatest(size, F.lit(1)))
    return F.array_distinct(F.flatten(F.transform(starts, lambda i: F.transform(F.sequence(F.lit(1), F.greatest(size - i + 1, F.lit(1))), lambda n: F.substr(word, i, n)))))


def met_words(words: DataFrame, vocabulary: DataFrame, most: int = 64) -> DataFrame:
    """DOC-16: ``(word)``: the distinct words of ``words(word)`` that lie in a word of ``vocabulary(word)`` or hold one.

    Both ways are joins on equal strings, with the substrings of the longer side; nothing is crossed. Words longer than ``most`` are an error.
    """
    size = F.char_length("word")
    bounded = F.when(size > most, F.raise_error(F.lit(f"a word is longer than {most} letters"))).otherwise(F.col("word"))
    mine, theirs = (x.where("word <> ''").select(bounded.alias("word")).distinct() for x in (words, vocabulary))
    holds = mine.select("word", F.explode(_substrings(F.col("word"))).alias("s")).join(theirs.select(F.col("word").alias("s")), "s", "left_semi").select("word")
    lies = mine.join(theirs.select(F.explode(_substrings(F.col("word"))).alias("word")), "word", "left_semi")
    return holds.union(lies).distinct()


def header_shares(headers: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """DOC-14: ``(id, share)``: of each table's distinct headers ``headers(id, header)``, the share with a word that the vocabulary meets. Words are cut at all but letters and digits, in lower case."""
    split = headers.where("header IS NOT NULL").select("id", "header").distinct().select("id", "header", F.explode(F.split(F.lower("header"), r"[^\p{L}\p{N}]+")).alias("word"))
    low = vocabulary.select(F.lower("word").alias("word"))
    met = met_words(split.select("word"), low).select("word", F.lit(True).alias("met"))
    by = split.join(met, "word", "left").groupBy("id", "header").agg(F.coalesce(F.bool_or("met"), F.lit(False)).alias("met"))
    return by.groupBy("id").agg(F.avg(F.col("met").cast("int")).alias("share"))
