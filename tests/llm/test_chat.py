"""Reply trees against plain enumeration; formatting as an exact round trip."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from marlstone.llm import chat

SCHEMA = "id string, parent string, role string, text string, score double"


def brute(rows, branches):
    """The chosen paths as (leaf, root, rank, score, position, role, text), by walking up from every leaf."""
    best = {}
    for id, parent, role, text, score in rows:
        if id is not None:
            row = ((parent is not None, parent or ""), role or "", text or "", (score is not None, score or 0.0))
            best[id] = min(best.get(id, row), row)
    parents = {i: r[0][1] if r[0][0] and r[0][1] in best else None for i, r in best.items()}
    answered = {p for p in parents.values() if p is not None}
    trees = defaultdict(list)
    for leaf in best:
        if leaf in answered:
            continue
        path, at = [], leaf
        while at is not None and len(path) <= len(best):
            path.append(at)
            at = parents[at]
        if at is None:
            score = sum(best[i][3][1] for i in path) / len(path)
            trees[path[-1]].append((-score, leaf, path[::-1]))
    out = set()
    for root, found in trees.items():
        for rank, (score, leaf, path) in enumerate(sorted(found), 1):
            if branches is None or rank <= branches:
                out |= {(leaf, root, rank if branches else None, -score, n, best[i][1], best[i][2]) for n, i in enumerate(path, 1)}
    return out


def forest(seed):
    rnd = random.Random(seed)
    rows = []
    for i in range(120):
        parent = rnd.choice([None, "hub", "absent", *(str(j) for j in range(max(0, i - 6), i))])
        rows.append((str(i), parent, rnd.choice(["user", "assistant", None]), rnd.choice(["a", "", None, "b" * 9]), rnd.choice([None, 0.25, 0.5, -1.0])))
    rows += [("hub", None, "user", "h", 1.0)]
    rows += [(f"chain{i}", f"chain{i - 1}" if i else None, "user", str(i), float(i % 3)) for i in range(37)]
    rows += [("loop1", "loop2", "user", "x", 0.0), ("loop2", "loop1", "user", "x", 0.0), ("under", "loop1", "user", "x", 0.0), ("self", "self", "user", "x", 0.0)]
    rows += [rows[3], ("5", "0", "user", "another of this id", 2.0), (None, "0", "user", "no id", 0.0)]
    return rows


@pytest.mark.parametrize("branches", [1, 3, None])
def test_paths_match_brute_force(spark, branches):
    rows = forest(branches or 7)
    df = spark.createDataFrame(rows, SCHEMA).withColumn("leaf", F.lit("clash")).withColumn("up", F.lit(1))
    got = chat.reply_paths(df, branches=branches)
    assert {tuple(r) for r in got.collect()} == brute(rows, branches)


def test_no_messages(spark):
    df = spark.createDataFrame([], SCHEMA)
    paths = chat.reply_paths(df)
    assert paths.count() == 0
    assert chat.read_back(chat.formatted(paths, ["leaf"]), ["leaf"]).count() == 0


def test_texts_come_back(spark):
    rnd = random.Random(5)
    parts = [*chat.Template().marks(), "\\", "\n", "<", "[", "]", ">", "/", "s>", "INST]", "é", "😀", " ", "</", "$1", "\\\\"]
    turns, want = [], {}
    for c in range(150):
        own = []
        for i in range(rnd.randint(1, 6)):
            role = rnd.choice(["user", "assistant", "system", "", "tool", "[INST]", "a\n[/ROLE]\\"])
            own.append((role, "".join(rnd.choices(parts, k=rnd.randint(0, 12)))))
            turns.append((c, i + 1, *own[-1]))
        want[c] = own
    turns += [(200, i, "assistant", "long " * 40_000) for i in range(2)]
    want[200] = [("assistant", "long " * 40_000)] * 2
    df = spark.createDataFrame(turns, "conv long, position long, role string, text string")
    written = chat.formatted(df, ["conv"])
    for r in chat.read_back(written, ["conv"]).collect():
        assert [tuple(t) for t in r.turns] == want[r.conv]
        assert r.taught == [t for role, t in want[r.conv] if role == "assistant"]
    for r in written.collect():
        for s in r.loss:  # the mask holds no mark
            assert not any(m in r.text[s.start : s.end] for m in chat.Template().marks())


def test_linear_conversations(spark):
    rows = [(1, 2, "b", "y"), (1, None, None, "first"), (1, 2, "b", None), (1, 2, "b", "y"), (None, 0, "user", "a"), (2, 5, "assistant", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("number", F.lit(3)).withColumn("conv", F.lit("clash"))
    paths = chat.reply_paths(chat.as_messages(df), unique=True)
    back = chat.read_back(chat.formatted(paths.select("leaf", "position", "role", "text"), ["leaf"]), ["leaf"]).collect()
    got = {r.leaf.conv: [tuple(t) for t in r.turns] for r in back}
    assert got == {1: [("", "first"), ("b", ""), ("b", "y"), ("b", "y")], None: [("user", "a")], 2: [("assistant", "")]}


def test_marks_are_checked():
    with pytest.raises(ValueError):
        chat.Template(named=("[ROLE]", "[/ROLE]", "[INST]"))
    with pytest.raises(ValueError):
        chat.Template(named=("[ROLE]", "[/ROLE]", "x[INST]"))
    with pytest.raises(ValueError):
        chat.Template(named=("[ROLE]", "[/ROLE]", "\\E"))


def test_broken_text_is_refused(spark):
    df = spark.createDataFrame([(1, "[INST]\nno end", [])], "k long, text string, loss array<struct<start:long,end:long>>")
    with pytest.raises(Exception, match="no turn"):
        chat.read_back(df, ["k"]).collect()
