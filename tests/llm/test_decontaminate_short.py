import random

from marlstone.llm import decontaminate as D
from tests.llm.test_decontaminate import brute_passages, spoiled


def test_short_items_are_met_as_whole_words():
    m = D.Matcher([(1, "what is pi"), (2, "pi"), (3, D.fold("日本で一番高い山は何ですか")), (4, "한국의 수도는 어디"), (5, "a a")], 0.08)
    found = lambda t: sorted({h[0] for h in m.search(D.fold(t))})
    assert found("So: What is -- PI?") == [1, 2]
    assert found("somewhat is pi") == [2] and found("what is pie, piano") == [] and found("what iz pi") == [2]
    assert found("問題:日本で一番高い山は何ですか。") == [3] and found("では日本で一番高い山は何ですかと問う") == [3]
    assert found("日本で一番高い川は何ですか") == [3] and found("日本で一番低い川は何ですか") == []  # thirteen letters: one edit
    assert found("그 한국의 수도는 어디?") == [4] and found("남한국의 수도는 어디") == []
    assert m.search("a a a a a") == [(5, 0, 3, 0), (5, 4, 7, 0)] and m.search("aa a ab a a") == [(5, 8, 11, 0)]


def test_short_items_against_brute_force():
    rng = random.Random(8)
    for _ in range(400):
        items = [(i, D.fold("".join(rng.choice("ab ") for _ in range(rng.randrange(1, 8))))) for i in range(5)]
        text = D.fold("".join(rng.choice("ab ") for _ in range(40)))
        got = {h[0] for h in D.Matcher([x for x in items if x[1]], 0.08).search(text)}
        assert got == {i for i, x in items if x and f" {x} " in f" {text} "}


def test_short_items_in_tables(spark):
    df = spark.createDataFrame([(1, "问:中国的首都是哪一座城市?"), (2, "nothing"), (3, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(7, "中国的首都是哪一座城市"), (8, "?!"), (9, ""), (10, None)], "item_id long, text string")
    assert [(r.doc_id, r.item_id, r.distance) for r in D.matches(df, bench).collect()] == [(1, 7, 0)]
    assert sorted(r.doc_id for r in D.without_matches(df, bench).collect()) == [2, 3]


def test_one_rule_from_eight_letters_to_forty():
    """Budget, pieces and passages follow from the rate alone; where the budget is zero, whole words."""
    rng = random.Random(13)
    with_budget = 0
    for k in range(600):
        n = 8 + k % 33
        item = D.fold("".join(rng.choice("abcde ") for _ in range(3 * n)))[:n].strip()
        if len(item) < 8:
            continue
        parts = [spoiled(rng, item, rng.randrange(0, 4)) if i % 2 else "".join(rng.choice("abcde ") for _ in range(20)) for i in range(7)]
        text = D.fold(rng.choice(["", " "]).join(parts))
        errors = int(0.08 * len(item))
        got = [h[1:] for h in D.Matcher([(1, item)], 0.08).search(text)]
        if errors:
            assert got == brute_passages(item, errors, text), (item, text)
            with_budget += len(got)
        else:
            assert bool(got) == (f" {item} " in f" {text} ")
    assert with_budget > 100


def test_an_edit_in_twenty_letters_is_found():
    text = D.fold("He asked what the capitol of France is, and then the capitol of France iz.")
    for item in ("the capital of france is", "capital of france is"):
        assert [h[3] for h in D.Matcher([(1, item)], 0.08).search(text)][:1] == [1]
