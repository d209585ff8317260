"""Quality rules, line first, in DataFrame functions only.

Every line of a text is held against punctuation, navigation and boilerplate
rules; failing lines go, and a document that loses too much of its text, or
fails the base rules, is rejected. One pass over the rows, no shuffle: every
figure is built inside the row from arrays, and the only super-linear step is
one sort of a document's three-word windows.

Defined cases: a null text counts as empty; a text without words has all
figures zero and is rejected; blank lines are neither counted nor removed;
repeated rows are judged alike and separately; very long texts are judged whole;
no rows give no rows; other columns pass through. A text's three-word windows
are told apart by their 64-bit hashes.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Everything but the symbols that are counted.
NO_SYMBOL = r"[^#*$%&|<>]+"

#: A line with any of these is boilerplate (licences, notices, page furniture).
BOILERPLATE = (
    r"(?i)\b(all rights reserved|licen[sc]ed under|released under the|creative commons"
    r"|terms of (use|service)|privacy policy|cookie policy|uses cookies|enable javascript|lorem ipsum)\b"
)
#: The end of a sentence, after any closing quotes or brackets.
SENTENCE_END = r"[.!?…:;。！？][\"'”’)\]»]*([\x20\x09-\x0D]|\z)"


@dataclass(frozen=True)
class LineRules:
    """Limits of the line rules and of the document verdict."""

    max_marks: float = 0.20  # share of a line's characters that are neither letters, digits nor blanks
    max_navigation: int = 3  # separators of menu items (|, », ›) in a line
    max_loss: float = 0.35  # share of the characters of the non-blank lines that may go
    min_words: int = 50
    max_repeat_percent: int = 50


def _words(text: Column) -> Column:
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def _length(text: Column) -> Column:
    return F.char_length(text)


def line_fails(line: Column, rules: LineRules = LineRules()) -> Column:
    """True where a non-blank line fails a rule."""
    marks = F.regexp_replace(line, r"[\p{L}\p{M}\p{N}\x20\x09-\x0D]+", "")
    return (
        ~line.rlike(SENTENCE_END)
        | (_length(marks) > rules.max_marks * _length(line))
        | line.rlike(r"^(?:[^|»›]*[|»›]){%d}" % rules.max_navigation)
        | line.rlike(BOILERPLATE)
    )


def quality(docs: DataFrame, text: str = "text", rules: LineRules = LineRules()) -> DataFrame:
    """``docs`` with the base figures, ``lines_removed``, ``cleaned`` and ``kept``.

    A column of the input that bears the name of a new one is replaced.
    """
    taken = "__marlstone_"
    t, words, ids, grams, lines, good, at = (F.col(taken + x) for x in ("text", "words", "ids", "grams", "lines", "good", "at"))
    n = F.size(words).cast("int")
    step = docs.withColumn(taken + "text", F.coalesce(F.col(text), F.lit("")))
    step = step.withColumns({taken + "words": _words(t), taken + "lines": F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))})
    # A window's identity; where none comes twice, there is nothing to place.
    step = step.withColumn(
        taken + "ids",
        F.when(n >= 3, F.slice(F.transform(words, lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2))), 1, n - 2)),
    )
    # Windows with their places, sorted: equal ones are neighbours.
    step = step.withColumn(
        taken + "grams",
        F.when(
            F.size(F.array_distinct(ids)) < F.size(ids),
            F.sort_array(F.transform(ids, lambda g, i: F.struct(g.alias("g"), i.alias("p")))),
        ).otherwise(F.expr("cast(array() as array<struct<g:bigint,p:int>>)")),
    )
    twice = F.filter(
        grams,
        lambda x, i: (F.coalesce(F.get(grams, i - 1)["g"] == x["g"], F.lit(False)))
        | (F.coalesce(F.get(grams, i + 1)["g"] == x["g"], F.lit(False))),
    )
    step = step.withColumns({taken + "at": F.sort_array(F.transform(twice, lambda x: x["p"])), taken + "good": F.filter(lines, lambda x: ~line_fails(x, rules))})
    covered = F.aggregate(
        at,
        F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(-3).alias("last")),
        lambda acc, p: F.struct((acc["n"] + F.least(F.lit(3), p - acc["last"])).alias("n"), p.alias("last")),
        lambda acc: acc["n"],
    )
    total = F.aggregate(lines, F.lit(0), lambda acc, x: acc + _length(x))
    left = F.aggregate(good, F.lit(0), lambda acc, x: acc + _length(x))
    step = step.withColumns(
        {
            "n_words": n.cast("bigint"),
            "word_chars": _length(F.array_join(words, "")).cast("bigint"),
            "n_symbols": _length(F.regexp_replace(t, NO_SYMBOL, "")).cast("bigint"),
            "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("bigint"),
            "n_repeat_words": covered,
            "lines_removed": (F.size(lines) - F.size(good)).cast("bigint"),
            "lost_share": F.when(total > 0, 1 - left / total).otherwise(F.lit(0.0)),
            "cleaned": F.array_join(good, "\n"),
        }
    )
    step = step.withColumn("base_failed", (F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words")))
    step = step.withColumn("kept", ~F.col("base_failed") & (F.col("lost_share") <= rules.max_loss))
    return _sealed(step.drop(*(taken + x for x in ("text", "words", "ids", "grams", "lines", "good", "at"))))


def _sealed(df: DataFrame) -> DataFrame:
    """``df`` behind a generator of one row, which no filter passes.

    A caller's filter on a figure would otherwise be pushed below the arrays it
    is built from and would build them anew for every element.
    """
    return df.select(F.inline(F.array(F.struct(*df.columns))))
