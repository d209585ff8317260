"""String functions as column expressions (all JVM-side)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Patterns and word lists that the results depend on.
NUMBER = r"-?\d{1,3}(?:,\d{3})+(?:\.\d+)?|-?\d+(?:\.\d+)?"
IDENTIFIER_HEADER = r"(?i)^(id|.*_id|no|no\.|nr|#|index|key|code|uuid|guid)$"
UNIT_HEADER = r"\((%|[a-z]{1,4}(/[a-z]{1,4})?)\)|_(pct|usd|eur|kg|km|ms|sec)$"
MACHINE_HEADER = r"^[a-z0-9]+(_[a-z0-9]+)+$|^[a-z]+[A-Z][A-Za-z0-9]*$"
HUMAN_HEADER = r"^[A-Z][A-Za-z]*([ -][A-Za-z]+)*$"
STRUCTURE_WORDS = ("the", "of", "and", "to", "in", "is", "that", "a", "for", "with")

WORD = r"[\p{L}\p{N}_]+"

#: The edge of a word by ASCII letters, digits and underscore. Java 17's own edge also counts other letters and marks as a word's.
EDGE = r"(?:(?<![0-9A-Za-z_])(?=[0-9A-Za-z_])|(?<=[0-9A-Za-z_])(?![0-9A-Za-z_]))"


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1))


def number(text: Column) -> Column:
    """STR-01: the first number in a messy string; thousands commas go; null if there is none."""
    found = F.regexp_extract(text, f"({NUMBER})", 1)
    return F.regexp_replace(F.when(found != "", found), ",", "").try_cast("double")


def thousands(x: Column) -> Column:
    """STR-02: ``1,234`` for whole numbers, else ``1,234.56``."""
    return F.when(x == F.floor(x), F.format_number(x, 0)).otherwise(F.format_number(x, 2))


def mask(value: Column) -> Column:
    """STR-03: letter runs become X and digit runs 9."""
    return F.regexp_replace(F.regexp_replace(value, r"\p{L}+", "X"), r"\p{Nd}+", "9")


def is_identifier_header(header: Column) -> Column:
    """STR-04."""
    return F.trim(header).rlike(IDENTIFIER_HEADER)


def header_register(header: Column) -> Column:
    """STR-05: unit, machine, human or other, tested in that order."""
    return F.when(header.rlike(UNIT_HEADER), "unit").when(header.rlike(MACHINE_HEADER), "machine").when(header.rlike(HUMAN_HEADER), "human").otherwise("other")


def syllables(word: Column) -> Column:
    """STR-06: vowel groups, less a final silent e, at least one."""
    w = F.lower(word)
    groups = F.regexp_count(w, F.lit("[aeiouy]+"))
    return F.greatest(F.lit(1), groups - F.when(w.rlike("[^aeiouy]e$"), 1).otherwise(0))


def sentence_lengths(text: Column) -> Column:
    """Words of each sentence that has any."""
    return F.filter(F.transform(F.split(text, r"[.!?]+"), lambda s: F.size(words(s))), lambda n: n > 0)


def rounded(x: Column, digits: int) -> Column:
    """``x`` rounded as C's ``round`` does: the binary value times a power of ten, halves away from zero.

    Spark's own ``round`` goes by the shortest decimal that prints the value, so values next to a half fall elsewhere.
    """
    scale = float(10**digits)

    def one(v: Column) -> Column:
        y = F.abs(v) * scale
        return F.signum(v) * (F.floor(y) + F.when(y - F.floor(y) >= 0.5, 1).otherwise(0)) / scale

    return F.get(F.transform(F.array(x), one), F.lit(0))  # a lambda's value is computed once


def ease_score(n_words: Column, n_sentences: Column, n_syllables: Column) -> Column:
    """STR-07: the Flesch score from its counts, one decimal; 0 without words. The factors count as decimals, so products are exact before they are divided."""
    long_sentences = 1015 * n_words.cast("long") / 1000.0 / F.greatest(n_sentences, F.lit(1))
    return F.when(n_words > 0, rounded(206.835 - long_sentences - 846 * n_syllables.cast("long") / 10.0 / n_words, 1)).otherwise(0.0)


def reading_ease(text: Column) -> Column:
    """STR-07: Flesch reading ease, one decimal; 0 without words."""
    w = words(text)
    syl = F.aggregate(w, F.lit(0), lambda a, x: a + syllables(x))
    counts = F.array(F.struct(F.size(w).alias("n"), F.size(sentence_lengths(text)).alias("s"), syl.alias("k")))
    return F.get(F.transform(counts, lambda c: ease_score(c["n"], c["s"], c["k"])), F.lit(0))  # counts are taken once


def sentence_length_cv(text: Column) -> Column:
    """STR-08: population deviation over mean of words a sentence; 0 under two sentences."""
    s = sentence_lengths(text)
    n = F.size(s)
    total = F.aggregate(s, F.lit(0.0), lambda a, x: a + x)
    squares = F.aggregate(s, F.lit(0.0), lambda a, x: a + x * x)
    mean = total / n
    return F.when(n < 2, 0.0).otherwise(F.sqrt(F.greatest(squares / n - mean * mean, F.lit(0.0))) / mean)


def phrase_rate(text: Column, phrases: tuple[str, ...]) -> Column:
    """STR-09: phrase hits for each thousand words."""
    low = F.lower(text)
    hits = reduce(lambda a, b: a + b, (F.regexp_count(low, F.lit(f"{EDGE}{p}{EDGE}")) for p in phrases))
    n = F.size(words(text))
    return F.when(n > 0, hits * 1000.0 / n).otherwise(0.0)


def strip_fences(text: Column) -> Column:
    """STR-10: without fenced blocks."""
    return F.regexp_replace(text, r"(?s)```.*?```", " ")


def prose(text: Column) -> Column:
    """STR-11: without fenced blocks and table lines, blanks collapsed."""
    lines = F.filter(F.split(strip_fences(text), "\n"), lambda x: ~F.trim(x).startswith("|"))
    return F.trim(F.regexp_replace(F.array_join(lines, " "), r"[ \t\n\r]+", " "))


def camel_tokens(name: Column) -> Column:
    """STR-16: lower-case parts of camel or snake names."""
    spaced = F.regexp_replace(name, r"([a-z0-9])([A-Z])", "$1 $2")
    return F.filter(F.split(F.lower(F.regexp_replace(spaced, r"[_\W]+", " ")), " "), lambda t: t != "")


def snake(name: Column) -> Column:
    """STR-17: an underscore before each capital but the first letter."""
    return F.lower(F.regexp_replace(name, r"(?<!^)(?=[A-Z])", "_"))


def plural(noun: Column) -> Column:
    """STR-18."""
    return (
        F.when(noun.rlike("[^aeiou]y$"), F.regexp_replace(noun, "y$", "ies"))
        .when(noun.rlike("(s|x|z|ch|sh)$"), F.concat(noun, F.lit("es")))
        .otherwise(F.concat(noun, F.lit("s")))
    )


def singular(noun: Column) -> Column:
    """STR-19."""
    return (
        F.when(noun.rlike("ies$"), F.regexp_replace(noun, "ies$", "y"))
        .when(noun.rlike("ses$"), F.regexp_replace(noun, "es$", ""))
        .when(noun.rlike("[^s]s$"), F.regexp_replace(noun, "s$", ""))
        .otherwise(noun)
    )


def column_key(name: Column) -> Column:
    """STR-20: the same for camel, spaced and underscored names; a trailing s of each part goes."""
    return F.array_join(F.transform(camel_tokens(name), lambda t: F.regexp_replace(t, "s$", "")), "_")


def abbreviate(name: Column) -> Column:
    """STR-21: parts over four letters keep the first letter and the consonants, five at most."""
    return F.array_join(
        F.transform(F.split(name, "_"), lambda t: F.when(F.length(t) > 4, F.substring(F.concat(F.substring(t, 1, 1), F.regexp_replace(F.substring(t, 2, 1000), "[aeiou]", "")), 1, 5)).otherwise(t)), "_"
    )


def stem(name: Column) -> Column:
    """STR-22: without a table suffix and a plural s."""
    return F.regexp_replace(F.regexp_replace(F.lower(name), "_(id|key|code|name|tbl|table)$", ""), "([^s])s$", "$1")


def identifier(name: Column) -> Column:
    """STR-24: a safe SQL identifier."""
    flat = F.lower(F.regexp_replace(name, "[^A-Za-z0-9_]+", "_"))
    return F.when(flat.rlike("^[a-z_]"), flat).otherwise(F.concat(F.lit("t_"), flat))


def first_word_match(text: Column, term: str) -> Column:
    """STR-25: the 1-based place of the first whole-word hit in either case; 0 if none."""
    return F.regexp_instr(text, F.lit(f"(?i){EDGE}{term}{EDGE}"))


def strip_slots(template: Column) -> Column:
    """STR-26: ``{a_b}`` becomes ``a b``."""
    return F.array_join(F.transform(F.split(template, r"[{}]"), lambda x, i: F.when(i % 2 == 1, F.replace(x, F.lit("_"), F.lit(" "))).otherwise(x)), "")


def skeleton(sentence: Column, kept: tuple[str, ...] = STRUCTURE_WORDS) -> Column:
    """STR-27: slots as §, structure words as they are, other words as one dot a run."""
    marked = F.transform(F.filter(F.split(F.regexp_replace(F.lower(sentence), r"[.,;:!?]", ""), r"[ \t\n\r]+"), lambda t: t != ""), lambda t: F.when(t.rlike(r"^\{.*\}$"), "§").when(t.isin(*kept), t).otherwise("·"))
    return F.regexp_replace(F.array_join(marked, " "), "·( ·)+", "·")


def fill(template: Column, values: dict[str, Column]) -> Column:
    """STR-28: slots replaced by their values."""
    for slot, value in values.items():
        template = F.replace(template, F.lit("{" + slot + "}"), value)
    return template


def html_text(html: Column) -> Column:
    """STR-29: readable text of a page by patterns alone: furniture, comments and tags go, entities of markup are undone."""
    body = F.regexp_replace(html, r"(?is)<(script|style|nav|header|footer|aside)" + EDGE + r".*?</(script|style|nav|header|footer|aside)>", " ")
    body = F.regexp_replace(body, r"(?s)<!--.*?-->", " ")
    body = F.regexp_replace(body, r"(?s)<[^>]*>", "\n")
    for entity, letter in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " "), ("&amp;", "&")):
        body = F.replace(body, F.lit(entity), F.lit(letter))
    body = F.regexp_replace(F.regexp_replace(body, r"[ \t]+", " "), r" ?\n ?", "\n")
    return F.regexp_replace(F.regexp_replace(body, r"\n{2,}", "\n"), r"^\n|\n$", "")


def heading(text: Column) -> Column:
    """STR-32: the first top heading of a note."""
    return F.regexp_extract(text, r"(?m)^# (.*)$", 1)


def select_names(columns: Column) -> Column:
    """STR-34: names of a SELECT list: the alias or the last dotted part of each item."""
    return F.transform(F.split(columns, r",(?![^()]*\))"), lambda c: F.regexp_extract(F.trim(c), r"(?i)([A-Za-z0-9_]+)\)?$", 1))


def table_references(sql: Column) -> Column:
    """STR-35: the tables after FROM and JOIN."""
    return F.regexp_extract_all(sql, F.lit(r"(?i)\b(?:from|join)\s+([A-Za-z_][A-Za-z0-9_.]*)"), F.lit(1))


def closed_list(definition: Column) -> Column:
    """STR-36: the values of a bracketed list of two or more; empty otherwise."""
    inner = F.regexp_extract(definition, r"\(((?!e\.g)[^()]*,[^()]*)\)", 1)
    return F.filter(F.transform(F.split(inner, r",| or "), lambda v: F.trim(v)), lambda v: v != "")


def slug(name: Column) -> Column:
    """STR-38: a wiki slug; colons, slashes, dots and hyphens stay."""
    return F.regexp_replace(F.lower(name), r"[^a-z0-9:/.\-]+", "-")


def chunk_paragraphs(text: Column, size: int = 700) -> Column:
    """STR-31: greedy paragraphs up to ``size`` characters; a longer paragraph is cut hard."""
    cut = F.flatten(
        F.transform(
            F.filter(F.split(text, "\n"), lambda p: F.trim(p) != ""),
            lambda p: F.transform(F.sequence(F.lit(0), F.floor((F.length(p) - 1) / size).cast("int")), lambda i: F.substr(p, i * size + 1, F.lit(size))),
        )
    )
    return F.aggregate(
        cut,
        F.expr("cast(array() as array<string>)"),
        lambda acc, p: F.when((F.size(acc) > 0) & (F.length(F.element_at(acc, -1)) + F.length(p) + 1 <= size), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.concat(F.element_at(acc, -1), F.lit("\n"), p)))).otherwise(F.array_append(acc, p)),
    )


def echo_reason(name: Column, offer: Column, most: float) -> Column:
    """STR-23: why an offered name (in words, as the meant one) is refused: invalid, an echo, or too many shared words; else ok."""
    shared = F.size(F.array_intersect(name, offer)) / F.size(F.array_distinct(offer))
    return F.when(F.array_join(offer, "") == "", "invalid").when(F.array_sort(name) == F.array_sort(offer), "echo").when(shared > most, "shared").otherwise("ok")


def line_windows(text: Column, size: int) -> Column:
    """STR-30: windows of whole lines that close at ``size`` characters, never inside a fence; joined again they are the text."""
    start = F.struct(F.expr("cast(array() as array<string>)").alias("done"), F.lit(None).cast("string").alias("now"), F.lit(False).alias("fence"))

    def step(acc: Column, line: Column) -> Column:
        fence = F.when(line.startswith("```"), ~acc["fence"]).otherwise(acc["fence"])
        now = F.when(acc["now"].isNull(), line).otherwise(F.concat(acc["now"], F.lit("\n"), line))
        full = ~fence & (F.length(now) >= size)
        return F.struct(F.when(full, F.array_append(acc["done"], now)).otherwise(acc["done"]).alias("done"), F.when(~full, now).alias("now"), fence.alias("fence"))

    return F.aggregate(F.split(text, "\n"), start, step, lambda acc: F.when(acc["now"].isNull(), acc["done"]).otherwise(F.array_append(acc["done"], acc["now"])))
