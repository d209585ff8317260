"""Screens for named terms in values and in documents.

Terms come as a table of two tiers. A clear term is a hit wherever its words stand together. An ambiguous one,
which is also an ordinary word, is a hit only in context: before a company's suffix or a capitalised word,
or as a whole value in title case. A trie of tokens, built once a worker from a file in the shared
folder, finds all terms in one pass over a text's tokens; the cost does not depend on the number of terms.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.dataset
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from marlstone.storage import stash

#: What makes an ambiguous term a company's name when it follows.
SUFFIXES = ("inc", "corp", "llc", "ltd", "plc", "group", "systems", "health", "healthcare", "cloud", "lab", "labs")
_TOKEN = re.compile(r"\w+|[^\w\s]")
_PRODUCT = re.compile(r"[A-Z][A-Za-z0-9]+")


@dataclass
class Trie:
    """Terms by their tokens in lower case. ``tier`` is set where a term ends."""

    below: dict[str, Trie] = field(default_factory=dict)
    tier: str | None = None
    term: str = ""

    def add(self, term: str, tier: str) -> None:
        node, tokens = self, [t.lower() for t in _TOKEN.findall(term)]
        for t in tokens:
            node = node.below.setdefault(t, Trie())
        if tokens and node.tier != "clear":
            node.tier, node.term = tier, term.lower()


def tokens_of(text: str) -> tuple[list[str], list[tuple[int, int]]]:
    spans = [m.span() for m in _TOKEN.finditer(text)]
    return [text[a:b] for a, b in spans], spans


def hit(value: str, trie: Trie, in_heading: bool = False) -> tuple[str, str, str] | None:
    """``(term, tier, matched text)``: the first clear term of a value, else the first ambiguous one in context, else the value itself if it is one in title case.

    Of clear terms at one place the longest counts. In a heading, where every word has a capital, only a
    suffix is context.
    """
    words, spans = tokens_of(value)
    low = [w.lower() for w in words]
    context = None
    for i in range(len(words)):
        node, j, clear, unclear = trie, i, None, None
        while j < len(low) and low[j] in node.below:
            if j > i and not value[spans[j - 1][1] : spans[j][0]].isspace() and spans[j - 1][1] != spans[j][0]:
                break
            node = node.below[low[j]]
            j += 1
            if node.tier == "clear":
                clear = (j, node.term)
            elif node.tier is not None:
                unclear = (j, node.term)
        if clear:
            return clear[1], "clear", value[spans[i][0] : spans[clear[0] - 1][1]]
        if unclear and context is None and unclear[0] < len(words):
            end, term = unclear
            apart = spans[end - 1][1] < spans[end][0]
            if apart and (low[end] in SUFFIXES or not in_heading and _PRODUCT.fullmatch(words[end])):
                context = (term, "ambiguous", value[spans[i][0] : spans[end - 1][1]])
    if context or in_heading:
        return context
    bare = value.strip()
    node = trie
    for w in low:
        node = node.below.get(w)
        if node is None:
            return None
    return (node.term, "ambiguous", bare) if node.tier == "ambiguous" and bare == node.term.title() else None


def spells(text_initials: str, sizes: list[int], name: str) -> bool:
    """Whether some run of the text's words has the initials ``name`` and three letters a word on average."""
    low, at = name.lower(), text_initials.find(name.lower())
    while at >= 0:
        if sizes[at + len(low)] - sizes[at] >= 3 * len(low):
            return True
        at = text_initials.find(low, at + 1)
    return False


def document_hits(text: str, trie: Trie, allowed: frozenset[str], quoted: str) -> list[tuple[int, str, str, str]]:
    """``(line, term, tier, lane)`` for each line with a hit, lines from 0.

    Not reported: terms that are allowed; capitals of two to five letters that are the initials of a phrase in the document, and the same
    capitals on its later lines. A line with the mark ``quoted`` is in the lane of quotations.
    """
    out, words = [], None
    initialisms: set[str] = set()
    for number, line in enumerate(text.splitlines()):
        found = hit(line.strip(), trie, line.lstrip().startswith("#"))
        if found is None or found[0] in allowed:
            continue
        term, tier, matched = found
        if 2 <= len(matched) <= 5 and matched.isalpha() and matched.isupper():
            if matched not in initialisms:
                if words is None:
                    own = re.findall(r"[a-z]+", text.lower())
                    sizes = [0]
                    for w in own:
                        sizes.append(sizes[-1] + len(w))
                    words = ("".join(w[0] for w in own), sizes)
                if spells(*words, matched):
                    initialisms.add(matched)
            if matched in initialisms:
                continue
        out.append((number, term, tier, "quoted" if quoted in line else "own"))
    return out


_HELD: dict[str, tuple[Trie, frozenset[str]]] = {}


def _terms_file(terms: DataFrame, most_bytes: int) -> str:
    """The folder of the written terms ``(term, tier, allowed)``; an error where they are too large for a worker."""
    held = stash(terms.where("term <> ''").distinct(), "terms")
    size = held.agg(F.sum(F.octet_length("term"))).first()[0] or 0
    if size > most_bytes:
        raise ValueError(f"{size} bytes of terms are over the bound of {most_bytes} that a worker holds")
    return held.inputFiles()[0].rsplit("/", 1)[0] if held.inputFiles() else ""


def _held(folder: str) -> tuple[Trie, frozenset[str]]:
    """This worker's trie of a folder's terms; it keeps one."""
    if folder not in _HELD:
        _HELD.clear()
        trie, allowed = Trie(), set()
        if folder:
            system, path = fs.FileSystem.from_uri(folder)
            rows = pyarrow.dataset.dataset(path, filesystem=system, format="parquet").to_table(["term", "tier", "allowed"]).to_pylist()
            for row in sorted(rows, key=lambda r: (r["term"], r["tier"])):
                trie.add(row["term"], row["tier"])
                if row["allowed"]:
                    allowed.add(row["term"].lower())
        _HELD[folder] = (trie, frozenset(allowed))
    return _HELD[folder]


def screen_documents(docs: DataFrame, terms: DataFrame, id: str = "doc_id", text: str = "text", quoted: str = ">", most_bytes: int = 64 << 20) -> DataFrame:
    """``(id, line, term, tier, lane)`` for every line of ``docs`` with a hit that no rule exempts.

    ``terms(term, tier, allowed)``: ``tier`` is clear or ambiguous; a term in both is clear; ``allowed`` terms are backed
    elsewhere and not reported. Null and empty texts have no hits; whole texts are read; repeated rows are reported alike; no
    documents or no terms give no rows. Other columns are left out.
    """
    folder = _terms_file(terms, most_bytes)
    part = docs.select(F.col(id).alias("id"), F.col(text).alias("text"))
    row = StructType().add("line", "integer").add("term", "string").add("tier", "string").add("lane", "string")
    kind = pa.list_(pa.struct([("line", pa.int32()), ("term", pa.string()), ("tier", pa.string()), ("lane", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, allowed = _held(folder)
        for batch in batches:
            found = [[dict(zip(("line", "term", "tier", "lane"), h, strict=True)) for h in document_hits(x, trie, allowed, quoted)] if x else [] for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(found, kind)], ["id", "hits"])

    schema = StructType(part.select("id").schema.fields).add("hits", ArrayType(row))
    return part.mapInArrow(run, schema).select(F.col("id").alias(id), F.explode("hits").alias("h")).select(id, "h.*")


def screen_values(values: DataFrame, terms: DataFrame, value: str, most_bytes: int = 64 << 20) -> DataFrame:
    """``values`` with ``term`` and ``tier`` of the hit in each; rows without one, or whose term is allowed, are left out."""
    folder = _terms_file(terms, most_bytes)
    columns = [c for c in values.columns if c not in ("term", "tier")]
    schema = StructType(values.select(columns).schema.fields).add("term", "string").add("tier", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, allowed = _held(folder)
        for batch in batches:
            found = [hit(x, trie) if x else None for x in batch.column(value).to_pylist()]
            keep = [h is not None and h[0] not in allowed for h in found]
            kept = batch.filter(pa.array(keep, pa.bool_()))
            own = [h for h, k in zip(found, keep, strict=True) if k]
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array([h[0] for h in own], pa.string()), pa.array([h[1] for h in own], pa.string())], schema.fieldNames())

    return values.select(columns).mapInArrow(run, schema)
