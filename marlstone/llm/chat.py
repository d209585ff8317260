"""Chat formatting of reply trees: every chosen root-to-leaf path becomes one conversation.

Messages name their parents. Iterative self-joins double the reach of a pointer in
each round (1, 2, 4, ... messages up), so a chain of ``n`` replies takes about
``log2 n`` rounds; rows whose pointer has passed the root leave the rounds. The
same pointers sum the scores of each path. Leaves are ranked in their tree by
mean score, and only the chosen leaves' paths are then enumerated, again by
doubling. Joins are on message ids and never on trees, so a tree may hold most
of the rows; ranking takes the best of each of 64 parts of a tree first.

Rounds carry ids and sums; texts are joined to the chosen paths once, at the end.
A path is one output row, so its texts meet in one task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

from marlstone.storage import discard, stash

_PARTS = 64


@dataclass(frozen=True)
class Template:
    """Marks around turns. Each stands on a line of its own; no text can hold one after :meth:`escaped`.

    ``roles`` maps a role to its opening and closing mark; any other role is
    written out between ``named``'s first two marks and its text ends at the third.
    """

    roles: dict[str, tuple[str, str]] = field(default_factory=lambda: {"user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>"), "system": ("<<SYS>>", "<</SYS>>")})
    named: tuple[str, str, str] = ("[ROLE]", "[/ROLE]", "[END]")
    taught: str = "assistant"

    def __post_init__(self) -> None:
        marks = self.marks()
        if len({*marks}) < len(marks) or any(len(m) < 2 or "\\" in m or "\n" in m for m in marks):
            raise ValueError("marks must differ, have two characters or more, and no backslash or line break")
        for a in marks:
            if any(b in a[i:] for b in marks for i in range(len(a)) if (i, b) != (0, a)):
                raise ValueError("a mark must not lie in another")

    def marks(self) -> list[str]:
        return [*(m for pair in self.roles.values() for m in pair), *self.named]

    def escaped(self, text: Column) -> Column:
        """Backslashes doubled, and one put behind the first character of everything that reads as a mark."""
        ahead = "|".join(f"(?={re.escape(m)}){re.escape(m[0])}" for m in self.marks())
        return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), f"({ahead})", "$1\\\\")

    def turn(self, role: Column, text: Column) -> tuple[Column, Column, Column]:
        """What stands before the text, the escaped text, and what follows it."""
        known = F.lit(None).cast("string")
        close = F.lit(self.named[2])
        for name, (first, last) in self.roles.items():
            known = F.when(role == name, first).otherwise(known)
            close = F.when(role == name, last).otherwise(close)
        named = F.concat(F.lit(f"{self.named[0]}\n"), self.escaped(role), F.lit(f"\n{self.named[1]}"))
        return F.concat(F.coalesce(known, named), F.lit("\n")), self.escaped(text), F.concat(F.lit("\n"), close, F.lit("\n"))


def unescaped(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


@dataclass
class Trees:
    """Ends of all branches, and the pointers ``1, 2, 4, ...`` messages up."""

    leaves: DataFrame
    jumps: list[DataFrame]


def trees(messages: DataFrame) -> Trees:
    """Branches of ``messages(id, parent, score)``: ``leaves(leaf, root, score, n)``, the mean score and number of their messages.

    A null parent, or one that is no message, makes a root. A null score counts
    as zero. Ids must be unique (see :func:`reply_paths`) and not null. Messages that reach no root
    because their parents form a cycle lie on no path.
    """
    nodes = stash(messages.select("id", "parent", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("total")), "messages")
    known = nodes.select(F.col("id").alias("known"))
    nodes = stash(nodes.join(known, nodes["parent"] == known["known"], "left").select("id", F.col("known").alias("up"), "total", F.lit(1).cast("long").alias("n")), "nodes")
    ended = [nodes.where("up IS NULL").select("id", F.col("id").alias("root"), "total", "n")]
    jumps, reach = [nodes.where("up IS NOT NULL")], 1
    longest = nodes.count()
    while reach <= longest and not jumps[-1].isEmpty():
        live = jumps[-1]
        # what the pointer meets: a message whose own path is complete, or one with a pointer of the same reach
        top = _union(ended).select(F.col("id").alias("met"), "root", F.lit(None).cast(live.schema["up"].dataType).alias("further"), F.col("total").alias("t2"), F.col("n").alias("n2"))
        mid = live.select(F.col("id").alias("met"), F.lit(None).cast(live.schema["up"].dataType).alias("root"), F.col("up").alias("further"), F.col("total").alias("t2"), F.col("n").alias("n2"))
        step = live.join(top.union(mid), F.col("up") == F.col("met"))
        step = stash(step.select("id", F.col("further").alias("up"), "root", (F.col("total") + F.col("t2")).alias("total"), (F.col("n") + F.col("n2")).alias("n")), "jumps")
        ended.append(step.where("up IS NULL").select("id", "root", "total", "n"))
        jumps.append(step.where("up IS NOT NULL").select("id", "up", "total", "n"))
        reach *= 2
    parents = nodes.where("up IS NOT NULL").select(F.col("up").alias("id"))
    leaves = _union(ended).join(parents, "id", "left_anti")
    return Trees(leaves.select(F.col("id").alias("leaf"), "root", (F.col("total") / F.col("n")).alias("score"), "n"), [j.select("id", "up") for j in jumps[:-1]])


def _union(parts: list[DataFrame]) -> DataFrame:
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.union(p)
    return whole


def best_branches(leaves: DataFrame, branches: int) -> DataFrame:
    """The ``branches`` best leaves of each root with their rank from 1: by mean score, of equal ones the smaller leaf."""
    best = [F.col("score").desc(), F.col("leaf")]
    part = F.pmod(F.xxhash64("leaf"), F.lit(_PARTS))
    some = leaves.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("root", "part").orderBy(*best))).where(F.col("rank") <= branches)
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("root").orderBy(*best))).where(F.col("rank") <= branches).drop("part")


def paths(found: Trees, chosen: DataFrame) -> DataFrame:
    """``(leaf, id, up)``: every message on the paths of the ``chosen`` leaves, and how far above the leaf it stands."""
    parts = [stash(chosen.select("leaf", F.col("leaf").alias("id"), F.lit(0).cast("long").alias("up")), "paths")]
    for k, jump in enumerate(found.jumps):
        step = jump.select("id", F.col("up").alias("target"))
        parts.append(stash(_union(parts).join(step, "id").select("leaf", F.col("target").alias("id"), (F.col("up") + 2**k).alias("up")), "paths"))
    return _union(parts)


def reply_paths(messages: DataFrame, branches: int | None = 1, unique: bool = False) -> DataFrame:
    """``(leaf, root, rank, score, position, role, text)``: the messages of the best branches of each tree, from position 1 at the root.

    ``messages(id, parent, role, text, score)``. Rows with a null id are left out. Of several
    rows with one id the least by (parent, role, text, score) stands for all, unless
    ``unique`` says that there are none. Null roles and texts are empty. ``branches`` None
    keeps all branches (rank 1 to n is then not computed, but null). Other columns are left
    out; no rows give no rows.
    """
    rows = messages.select("id", "parent", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.col("score").cast("double").alias("score")).where("id IS NOT NULL")
    if not unique:
        rows = rows.groupBy("id").agg(F.min(F.struct("parent", "role", "text", "score")).alias("m")).select("id", "m.*")
    rows = stash(rows, "texts")
    found = trees(rows)
    chosen = found.leaves.withColumn("rank", F.lit(None).cast("int")) if branches is None else best_branches(found.leaves, branches)
    chosen = stash(chosen, "branches")
    placed = paths(found, chosen).join(chosen, "leaf").join(rows.select("id", "role", "text"), "id")
    return placed.select("leaf", "root", "rank", chosen["score"], (F.col("n") - F.col("up")).alias("position"), "role", "text")


def formatted(turns: DataFrame, keys: list[str], template: Template = Template()) -> DataFrame:
    """One conversation a row: the keys, ``text``, and ``loss``, the code points [start, end) of ``text`` that are taught.

    ``turns(*keys, position, role, text)``. The first key alone tells conversations apart.
    Turns follow each other by position; of one position by text. Very long texts are formatted whole; no rows give no rows. The mask covers the escaped texts of the taught role and no marks.
    Empty taught texts have an empty span.
    """
    first, *rest = keys
    before, body, after = template.turn(F.col("role"), F.col("text"))
    marked = turns.select(*keys, "position", (F.col("role") == template.taught).alias("taught"), before.alias("before"), body.alias("body"), after.alias("after"))
    size = F.char_length("before") + F.char_length("body") + F.char_length("after")
    ends = F.sum(size.cast("long")).over(Window.partitionBy(first).orderBy("position").rowsBetween(Window.unboundedPreceding, -1))
    start = (F.coalesce(ends, F.lit(0)) + F.char_length("before")).alias("start")
    placed = marked.select(*keys, "position", F.concat("before", "body", "after").alias("turn"), F.when(F.col("taught"), F.struct(start, (start + F.char_length("body")).alias("end"))).alias("span"))
    whole = placed.groupBy(first).agg(*(F.first(k).alias(k) for k in rest), F.array_sort(F.collect_list(F.struct("position", "turn", "span"))).alias("turns"))
    spans = F.filter(F.transform("turns", lambda t: t["span"]), lambda s: s.isNotNull())
    return whole.select(*keys, F.array_join(F.transform("turns", lambda t: t["turn"]), "").alias("text"), spans.alias("loss"))


def read_back(conversations: DataFrame, keys: list[str], template: Template = Template()) -> DataFrame:
    """``(*keys, turns, taught)`` from formatted text and its mask alone: ``turns`` of role and text, and the texts under the mask, unescaped.

    A text that is not a sequence of whole turns raises an error.
    """
    name = {first: role for role, (first, _) in template.roles.items()}
    opening = "|".join(re.escape(m) for m in name)
    a, b, c = map(re.escape, template.named)
    closing = "|".join([*(re.escape(last) for _, last in template.roles.values()), c])
    turn = re.compile(rf"(?:({opening})|{a}\n(.*?)\n{b})\n(.*?)\n(?:{closing})\n", re.DOTALL)
    turns = ArrayType(StructType().add("role", "string").add("text", "string"))
    schema = StructType(conversations.select(*keys).schema.fields).add("turns", turns).add("taught", ArrayType(StringType()))
    kinds = [pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())])), pa.list_(pa.string())]

    def parsed(text: str) -> list[dict[str, str]]:
        found, at = [], 0
        for m in turn.finditer(text):
            if m.start() != at:
                break
            found.append({"role": name[m[1]] if m[1] else unescaped(m[2]), "text": unescaped(m[3])})
            at = m.end()
        if at != len(text):
            raise ValueError(f"no turn at code point {at}")
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                texts = [x.as_py() for x in batch.column("text")]
                masks = batch.column("loss").to_pylist()
                taught = [[unescaped(t[s["start"] : s["end"]]) for s in mask] for t, mask in zip(texts, masks, strict=True)]
                yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), pa.array(map(parsed, texts), kinds[0]), pa.array(taught, kinds[1])], schema.fieldNames())

    return conversations.select(*keys, "text", "loss").mapInArrow(run, schema)


def as_messages(turns: DataFrame, id: str = "conv_id", turn: str = "turn") -> DataFrame:
    """Linear conversations as reply trees: each turn answers the one before it.

    ``id`` is (conversation, number); turns are numbered by turn (null first), then role and text (null: empty),
    so equal rows stay apart. Rows with a null id are one conversation. Other columns are left out.
    """
    order = Window.partitionBy(id).orderBy(turn, "role", "text")
    plain = turns.select(id, turn, *(F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text")))
    numbered = plain.select(F.col(id).alias("conv"), "role", "text", F.row_number().over(order).alias("number"))
    parent = F.when(F.col("number") > 1, F.struct("conv", (F.col("number") - 1).alias("number")))
    return numbered.select(F.struct("conv", "number").alias("id"), parent.alias("parent"), "role", "text", F.lit(0.0).alias("score"))
