"""Secret scans: fixed kinds, and high entropy in a sliding window.

The fixed kinds are assignments, access keys and long hexadecimal runs. Beyond
them, every candidate string is scanned with a window that keeps character
counts: each step adds one character, drops one and updates the Shannon entropy
and the window's character class from the two alone. Every window's entropy is
held against the limit of its own class (digits, hexadecimal, one case with
digits, base 64); one window that reaches it is enough. An allow-list
suppresses well-known harmless forms. One pass in Arrow batches, no shuffle.

Null and empty texts have no spans; very long texts are scanned whole; repeated
rows are reported alike; spans with one start are in the order of ``KINDS``; no
rows give no rows; other columns are left out.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from marlstone.llm.text import apart

#: The kinds in their order, their patterns and least lengths (of group 2 for assignments).
KINDS = ("assign", "access", "hex", "entropy")
ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
LEAST_VALUE, LEAST_ACCESS = 6, 20
_ASSIGN_HINT = re.compile(r"(?ai)passw|secret|token|api_?key")

#: What is never a secret by entropy alone, beside words.
ALLOWED = (
    r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}",  # UUIDs
    r"[0-9]{4}-?[0-9]{2}-?[0-9]{2}T[0-9]{2,6}(?:[+-][0-9]{2,4})?Z?",  # times
)
_WORDS = re.compile(r"[A-Za-z]+(?:[-_/.=+][A-Za-z]+)*")
_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
_CONSONANTS = re.compile(r"[bcdfghjklmnpqrstvwxz]{5}")
_VOWELS, _SELDOM = "aeiouy", "jkqvwxz"
_CANDIDATE = re.compile(r"(?a)(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}")


@dataclass(frozen=True)
class Entropy:
    """Bits a character, by the character class of a window, from which it counts as random.

    The limits leave out 2 to 3 % of random windows of 20 characters of their class. ``words``: letters that look like words are allowed too.
    """

    window: int = 20
    digits: float = 2.6
    hexadecimal: float = 2.95
    one_case: float = 3.28
    mixed: float = 3.68
    allowed: tuple[str, ...] = ALLOWED
    words: bool = True


#: Which letters a window holds: lower or upper case, up to f or past it, or none of letters and digits.
_DIGIT, _LOWER_HEX, _LOWER, _UPPER_HEX, _UPPER, _OTHER = range(6)


def _sort(c: str) -> int:
    if c.isdigit():
        return _DIGIT
    if not c.isalpha():
        return _OTHER
    if c.islower():
        return _LOWER_HEX if c <= "f" else _LOWER
    return _UPPER_HEX if c <= "F" else _UPPER


_SORTS = {chr(i): _sort(chr(i)) for i in range(128)}


def _character_class(sorts: list[int]) -> str:
    """The class of a window, from how many characters of each sort it holds."""
    lower, upper = sorts[_LOWER_HEX] + sorts[_LOWER], sorts[_UPPER_HEX] + sorts[_UPPER]
    if sorts[_OTHER] or lower and upper:
        return "mixed"
    if not lower and not upper:
        return "digits"
    return "one_case" if sorts[_LOWER] or sorts[_UPPER] else "hexadecimal"


def entropy_windows(s: str, width: int) -> Iterator[tuple[float, int, str]]:
    """Entropy, start and class of each window of ``s``; all counts move with the window."""
    width = min(width, len(s))
    if not width:
        return
    term = [0.0] + [n * math.log2(n) for n in range(1, width + 1)]
    counts: dict[str, int] = {}
    sorts = [0] * 6
    total = 0.0  # sum of n log n over the window's counts
    for i, c in enumerate(s):
        n = counts.get(c, 0)
        if i >= width:
            old = s[i - width]
            if old != c:
                k = counts[old]
                total += term[k - 1] - term[k]
                counts[old] = k - 1
                sorts[_SORTS.get(old, _OTHER)] -= 1
                total += term[n + 1] - term[n]
                counts[c] = n + 1
                sorts[_SORTS.get(c, _OTHER)] += 1
        else:
            total += term[n + 1] - term[n]
            counts[c] = n + 1
            sorts[_SORTS.get(c, _OTHER)] += 1
        if i >= width - 1:
            yield term[width] / width - total / width, i - width + 1, _character_class(sorts)


def entropy_peak(s: str, width: int) -> tuple[float, int]:
    """The largest entropy of a window of ``s``, and where it starts."""
    best, at = -1.0, 0
    for bits, start, _ in entropy_windows(s, width):
        if bits > best + 1e-12:
            best, at = bits, start
    return max(best, 0.0), at


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Spans of the fixed kinds, in order of start, then kind."""
    found = []
    if _ASSIGN_HINT.search(text):
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m.group(2)) >= LEAST_VALUE]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2])))


def like_words(s: str) -> bool:
    """Whether letters, joined by single marks or by capitals, may be words.

    Words have vowels (3 in 10 letters), few of the seldom letters (2 in 10 at most), no five consonants in a
    row between capitals, and few parts between capitals that are one letter, two letters or without a vowel (two, or a third of all).
    """
    if not _WORDS.fullmatch(s):
        return False
    low = [c for c in s.lower() if c.isalpha()]
    if 10 * sum(c in _VOWELS for c in low) < 3 * len(low) or 5 * sum(c in _SELDOM for c in low) > len(low):
        return False
    parts = _PART.findall(s)
    if any(_CONSONANTS.search(p.lower()) for p in parts):
        return False
    odd = sum(len(p) <= 2 or not any(c in _VOWELS for c in p.lower()) for p in parts)
    return odd <= max(2, len(parts) / 3)


def entropy_spans(text: str, limits: Entropy, allowed: re.Pattern[str]) -> list[tuple[int, int, str]]:
    found = []
    least = {"digits": limits.digits, "hexadecimal": limits.hexadecimal, "one_case": limits.one_case, "mixed": limits.mixed}
    for m in _CANDIDATE.finditer(text):
        s = m.group()
        bare = s.strip("=-_/+")
        if allowed.fullmatch(bare) or allowed.fullmatch(s) or limits.words and like_words(bare):
            continue
        if any(bits >= least[kind] for bits, _, kind in entropy_windows(s, limits.window)):
            found.append((m.start(), m.end(), "entropy"))
    return found


def _outside(more: list[tuple[int, int, str]], base: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Those of ``more`` that lie within no span of ``base``; both are in order of their starts."""
    out, k, reach = [], 0, -1
    for x in more:
        while k < len(base) and base[k][0] <= x[0]:
            reach = max(reach, base[k][1])
            k += 1
        if x[1] > reach:
            out.append(x)
    return out


def scan(docs: DataFrame, id: str = "doc_id", text: str = "text", limits: Entropy = Entropy()) -> DataFrame:
    """``(id, spans array<struct<kind, start, end>>)``: one row per input row, code points, end exclusive.

    An id column called ``spans`` is returned as ``doc_id``.

    Spans of different kinds may overlap; an entropy span within a span of a
    fixed kind adds nothing and is left out.
    """
    part = docs.select(F.col(id).alias(apart(id, ("spans",))), F.col(text).alias("__text"))
    schema = part.select(part.columns[0]).schema
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        allowed = re.compile("|".join(f"(?:{x})" for x in limits.allowed)) if limits.allowed else re.compile(r"(?!)")
        for batch in batches:
            rows = []
            for value in batch.column(1).to_pylist():
                base = base_spans(value) if value else []
                more = entropy_spans(value, limits, allowed) if value else []
                every = sorted(base + _outside(more, base), key=lambda x: (x[0], KINDS.index(x[2])))
                rows.append([{"kind": k, "start": a, "end": b} for a, b, k in every])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(span))], [schema.fieldNames()[0], "spans"])

    out = schema.add("spans", ArrayType(StructType([StructField("kind", StringType()), StructField("start", LongType()), StructField("end", LongType())])))
    return part.mapInArrow(run, out)

