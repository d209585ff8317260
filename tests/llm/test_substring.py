import random

import numpy as np
import pytest

from marlstone.llm import substring


def brute(rows, width):
    texts = [(t or "").encode().split() for _, t in rows]
    seen = {}
    for t in texts:
        for p in range(len(t) - width + 1):
            w = tuple(t[p : p + width])
            seen[w] = seen.get(w, 0) + 1
    out = []
    for (i, _), t in zip(rows, texts, strict=True):
        gone = {p + k for p in range(len(t) - width + 1) if seen[tuple(t[p : p + width])] > 1 for k in range(width)}
        out.append((str(i), len(t), len(gone), b" ".join(w for k, w in enumerate(t) if k not in gone).decode()))
    return sorted(out)


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(2000)}é"
    passages = [" ".join(word() for _ in range(rng.randrange(20, 90))) for _ in range(6)]
    common = " ".join(f"hot{i}" for i in range(50))
    rows = []
    for i in range(160):
        parts = [" ".join(word() for _ in range(rng.randrange(0, 120)))]
        if rng.random() < 0.5:
            parts.insert(rng.randrange(2), rng.choice(passages))
        if rng.random() < 0.4:
            parts.insert(rng.randrange(len(parts) + 1), common)
        rows.append((i, rng.choice([" ", "\n", " \t"]).join(parts)))
    rows += [(500 + k, rows[k][1]) for k in range(30)] + [(600, rows[3][1] + " tail"), (601, "a " * 200), (602, "x y " * 40), (603, None), (604, ""), (605, "one"), (3, rows[3][1]), (7, "other text " + rows[9][1]), (None, rows[11][1]), (None, "q " * 36)]
    rows += [(700, " ".join(f"u{i}" for i in range(35))), (701, " ".join(f"u{i}" for i in range(35)) + " more"), (702, " ".join(f"v{i}" for i in range(34))), (703, " ".join(f"v{i}" for i in range(34)))]
    return rows


@pytest.mark.parametrize("group", [500, 60, 8, 1])
def test_matches_brute_force(spark, group):
    rows = corpus(group)
    df = spark.createDataFrame([(i, t, "x", -1) for i, t in rows], "doc_id long, text string, kept string, pos long").repartition(5)
    got = sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept) for r in substring.remove_repeats(df, group=group).collect())
    assert got == brute(rows, 35)


def test_empty_table(spark):
    assert substring.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_any_columns(spark):
    """Columns with the names used inside, and of types without a hash, come through."""
    text = " ".join(f"w{i % 50}" for i in range(120))
    rows = [(1, {"a": 1}, ["x"], "s", True, None, text), (2, None, None, "t", None, 3, "short one"), (None, {}, [], None, False, 0, None)]
    df = spark.createDataFrame(rows, "k1 long, m map<string,int>, starts array<string>, __text string, whole boolean, `rest` int, text string")
    got = substring.remove_repeats(df)
    assert got.columns == ["k1", "m", "starts", "__text", "whole", "rest", "kept", "n_words", "n_removed"]
    assert sorted(map(repr, (tuple(r)[:6] for r in got.collect()))) == sorted(repr(r[:6]) for r in rows)
    assert {r.k1: (r.n_words, r.n_removed) for r in got.collect()} == {1: (120, 120), 2: (2, 0), None: (0, 0)}
    assert substring.remove_repeats(spark.createDataFrame([("a b",)], "text string")).collect()[0].kept == "a b"


@pytest.mark.parametrize("group", [500, 20])
def test_repeated_rows(spark, group):
    """Many equal rows beside others that hold a part of them."""
    same = " ".join(f"r{i}" for i in range(300))
    rows = [(1, same)] * 300 + [(2, "head " + same[:600] + " tail"), (3, " ".join(f"z{i}" for i in range(90)))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept) for r in substring.remove_repeats(df, group=group).collect())
    assert got == brute(rows, 35)


def test_subtree_against_plain_sorting():
    rng = np.random.default_rng(2)
    for n, letters in ((1, 1), (2, 1), (40, 1), (300, 2), (300, 30)):
        cuts = sorted(set(rng.integers(1, n + 1, 5).tolist()) | {n})
        runs = [rng.integers(0, letters, b - a).tolist() for a, b in zip([0, *cuts], cuts, strict=False)]
        tokens = [x for i, r in enumerate(runs) for x in [*r, letters + i]]
        tree = substring.Subtree(np.array(tokens), max(map(len, runs)))
        order = sorted(range(len(tokens)), key=lambda i: tokens[i:])
        assert tree.order.tolist() == order

        def shared(a, b):
            k = 0
            while max(a, b) + k < len(tokens) and tokens[a + k] == tokens[b + k]:
                k += 1
            return k

        assert tree.common.tolist() == [shared(a, b) for a, b in zip(order, order[1:], strict=False)]
        for depth in (1, 3, 9):
            want = {i for i in range(len(tokens)) for j in range(len(tokens)) if i != j and shared(i, j) >= depth}
            assert set(tree.deep(depth).tolist()) == want
