import random

import numpy as np
import xxhash

from marlstone.llm import simhash
from marlstone.llm.components import components


def plain(text):
    w = "".join(c.lower() if c.isascii() else c for c in text or "").encode().split()
    sh = [b" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or ([b" ".join(w)] if w else [])
    if not sh:
        return 0
    h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def smallest(ids, fps, radius=4):
    best = dict(enumerate(range(len(ids))))
    for _ in ids:
        for i in range(len(ids)):
            for j in range(len(ids)):
                if bin(fps[i] ^ fps[j]).count("1") <= radius:
                    best[i] = min(best[i], best[j])
    return {ids[i]: ids[best[i]] for i in range(len(ids))}


def test_fingerprint_of_odd_texts():
    for t in (None, "", " \n\t", "One", "a b c", "a b c d", "a  b\tc d e\x0bf", "É É é é x", "A B C D " * 50, "x y z w v u", "\x1c a b c d e"):
        assert simhash.fingerprint(t) == plain(t), t


def test_components_match_brute_force(spark):
    rng = random.Random(1)
    base = [[f"w{rng.randrange(999)}" for _ in range(300)] for _ in range(12)]
    texts = []
    for b in base:
        for k in range(6):
            c = list(b)
            for _ in range(k):
                c[rng.randrange(300)] = f"v{rng.randrange(99)}"
            texts.append(" ".join(c))
    texts += ["", None, "same same", "same same"]
    ids = list(range(len(texts)))
    df = spark.createDataFrame(list(zip(ids, texts, texts, strict=True)), "doc_id long, text string, fp string")
    got = {r.doc_id: (r.fp & (2**64 - 1), r.component_id) for r in simhash.near_duplicates(df, per_group=9).collect()}
    fps = [plain(t) for t in texts]
    want = smallest(ids, fps)
    assert got == {i: (fps[i], want[i]) for i in ids}


def test_empty_table_and_repeated_rows(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(none).count() == 0
    df = spark.createDataFrame([(7, "a b c d e"), (7, "a b c d e"), (None, "a b c d e"), (None, "q r s t u")], "doc_id long, text string")
    assert sorted(str(r.component_id) for r in simhash.near_duplicates(df).collect()) == ["7", "7", "7", "None"]


def test_chain_and_star_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + k) for k in range(1, 60)] + [(5, 5), (None, 3)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert all(got[i] == 0 for i in range(41)) and all(got[100 + k] == 100 for k in range(60)) and len(got) == 101


def test_tiles_find_every_link():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 2**63, 700, dtype=np.uint64)
    b = np.concatenate((a[:300] ^ np.uint64(0b1011), rng.integers(0, 2**63, 50, dtype=np.uint64)))
    values, label, moved = simhash._forest(a, b, 4)
    assert (label[700:1000] == label[:300]).all() and len(moved) == 300
