"""Chapter scores on odd cases; their queries hold whole tables against SQL."""

import random

import pytest

from marlstone.operators import chapters as C


def test_met_words_match_a_loop(spark):
    rnd = random.Random(3)
    words = ["".join(rnd.choices("abc", k=rnd.randint(1, 6))) for _ in range(60)] + ["", None, "é😀x"]
    vocabulary = ["".join(rnd.choices("abcd", k=rnd.randint(2, 7))) for _ in range(12)] + ["😀", "", None]
    got = {r.word for r in C.met_words(spark.createDataFrame([(w,) for w in words], "word string"), spark.createDataFrame([(v,) for v in vocabulary], "word string")).collect()}
    assert got == {w for w in words if w and any(v and (v in w or w in v) for v in vocabulary)}
    with pytest.raises(Exception, match="longer than"):
        C.met_words(spark.createDataFrame([("x" * 65,)], "word string"), spark.createDataFrame([("x",)], "word string")).collect()


def test_found_shares_and_missing_sides(spark):
    texts = spark.createDataFrame([(1, "Alpha beta"), (2, None), (3, "gamma"), (4, "x")], "id long, text string")
    items = spark.createDataFrame([(1, "ALPHA "), (1, "alpha"), (1, "delta"), (2, "a"), (3, " "), (3, None), (9, "none")] + [(1, f"beta{i}") for i in range(600)], "id long, item string")
    got = {r.id: (r.n_items, r.n_found) for r in C.found_shares(texts, items).collect()}
    assert got == {1: (602, 1), 2: (1, 0)}
    values = spark.createDataFrame([(1, "beta"), (3, "gamma")], "id long, item string")
    concepts = spark.createDataFrame([(1, "alpha"), (1, "zeta"), (2, "q")], "id long, item string")
    scores = {r.id: r.score for r in C.entailment(texts, concepts, values).collect()}
    assert scores == {1: pytest.approx(0.6 * 0.5 + 0.4), 2: 0.0, 3: 1.0, 4: 0.0}


def test_header_shares(spark):
    headers = spark.createDataFrame([("t", "Unit-Price"), ("t", "Unit-Price"), ("t", "zz"), ("u", None), ("u", "PRICES")], "id string, header string")
    got = {r.id: r.share for r in C.header_shares(headers, spark.createDataFrame([("price",)], "word string")).collect()}
    assert got == {"t": 0.5, "u": 1.0}
