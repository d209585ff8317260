import random

import numpy as np

from marlstone.llm import decontaminate as D


def edit(item, text):
    """Least distance of item to any substring of text, by the full table."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


def spoiled(rng, s, n):
    s = list(s)
    for _ in range(n):
        i = rng.randrange(len(s))
        kind = rng.randrange(3)
        s[i : i + 1] = [rng.choice("xyz")] if kind == 0 else [] if kind == 1 else [s[i], rng.choice("xyz")]
    return "".join(s)


def ends(item, text):
    """For each end, the least distance of item to a substring of text that ends there, by the full table."""
    codes, steps = np.array([ord(c) for c in text]), np.arange(len(text) + 1)
    row = np.zeros(len(text) + 1, int)
    for i, c in enumerate(item, 1):
        new = np.minimum(row + 1, i)
        new[0] = i
        new[1:] = np.minimum(row[1:] + 1, row[:-1] + (codes != ord(c)))
        row = np.minimum.accumulate(new - steps) + steps
    return row


def brute_passages(item, errors, text):
    out, done = [], 0
    while len(near := np.flatnonzero((row := ends(item, text[done:])) <= errors)):
        within = row[near[0] : near[0] + 2 * errors + 1]
        end, distance = int(near[0] + np.argmin(within)), int(within.min())
        tail = text[done : done + end]
        length = next(n for n in range(len(tail) + 1) if int(whole(item, tail[len(tail) - n :])) == distance)
        out.append((done + end - length, done + end, distance))
        done += end
    return out


def whole(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_myers_is_the_edit_distance():
    rng = random.Random(5)
    for _ in range(300):
        item = "".join(rng.choice("ab c") for _ in range(rng.randrange(1, 90)))
        text = "".join(rng.choice("ab c") for _ in range(rng.randrange(0, 120)))
        assert (D.myers(len(item), D.letter_masks(item), text, len(item)) or [0])[0] == edit(item, text[: 2 * len(item) + 1]) or not text
        if 0 < (least := edit(item, text)) < len(item):
            assert D.myers(len(item), D.letter_masks(item), text, least)[0] == least and D.myers(len(item), D.letter_masks(item), text, least - 1) is None


def test_every_passage_against_brute_force():
    """Repetitive items, copies close together, edits of every kind: all passages with their places and distances."""
    rng = random.Random(11)
    for k in range(250):
        unit = "".join(rng.choice("abc ") for _ in range(rng.choice([2, 5, 9, 40])))
        item = D.fold((unit * 40)[: rng.randrange(26, 80)])
        if len(item) < 24:
            continue
        parts = [rng.choice(["", "zz", " ", item[:9], item[-12:]]) for _ in range(6)]
        for i in range(0, 5, 2):
            parts[i] += spoiled(rng, item, rng.randrange(0, 9))
        text = D.fold(" ".join(parts) if k % 2 else "".join(parts))
        rate = rng.choice([0.08, 0.2])
        got = [h[1:] for h in D.Matcher([(1, item)], rate).search(text)]
        assert got == brute_passages(item, int(rate * len(item)), text), (item, text, rate)


def test_a_worse_passage_before_a_better_one():
    item = D.fold("abcab " * 12)
    text = D.fold("x" + item[1:] + " zz " + item)
    assert [d for *_, d in D.Matcher([(1, item)], 0.08).search(text)] == [1, 0]


def test_letters_that_grow_keep_their_places(spark):
    item = "the city of lisbon lies upon the river tagus and seven hills"
    text = f"İstanbul İzmir İznik ΑΣ, {item} more words follow İ"
    df = spark.createDataFrame([(1, text), (2, "ΑΣ " + item.upper())], "start long, end string")
    bench = spark.createDataFrame([(4, item), (5, "ΑΣ " + item)], "item_id long, text string")
    got = D.matches(df, bench, id="start", text="end")
    assert got.columns == ["doc_id", "item_id", "start", "end", "distance"]
    by = {(r.doc_id, r.item_id): r for r in got.collect()}
    assert text[by[1, 4].start : by[1, 4].end] == item + " " and by[2, 5].distance == 0 and by[1, 5].distance == 0


def test_every_item_within_its_budget_is_found(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9)))
    items = [(i, " ".join(word() for _ in range(30))) for i in range(8)]
    docs, want = [], set()
    for d in range(120):
        around = [" ".join(word() for _ in range(rng.randrange(0, 60))) for _ in range(2)]
        item_id, item = items[d % 8]
        middle = spoiled(rng, item, rng.randrange(0, 24)) if d % 3 else ""
        text = f"{around[0]} {middle} {around[1]}"
        docs.append((d, text, "x"))
        for i, t in items:
            f = D.fold(t)
            if edit(f, D.fold(text)) <= int(0.08 * len(f)):
                want.add((d, i))
    df = spark.createDataFrame(docs, "doc_id long, text string, item_id string")
    bench = spark.createDataFrame([*items, (99, None), (98, "short")], "item_id long, text string")
    for block_bytes in (1 << 20, 300):
        got = {(r.doc_id, r.item_id) for r in D.matches(df, bench, block_bytes=block_bytes).collect()}
        assert got == want and want


def test_spans_and_repeats():
    item = D.fold("The quick, brown fox jumps over the lazy dog today.")
    m = D.Matcher([(1, item)], 0.08)
    text = f"Oh! {item} -- and again: {item}"
    hits = m.search(D.fold(text))
    assert [(i, d) for i, _, _, d in hits] == [(1, 0), (1, 0)]
    assert m.search("") == [] and D.Matcher([], 0.1).search("abc") == []


def test_places_null_empty_and_repeated_rows(spark):
    item = "Alpha beta gamma delta epsilon zeta eta theta."
    rows = [(1, "Intro. " + item.upper().replace(" ", "  ") + " End."), (1, "Intro. " + item.upper().replace(" ", "  ") + " End."), (2, None), (3, ""), (None, item)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(5, item), (5, item)], "item_id long, text string")
    got = D.matches(df, bench).collect()
    assert sorted((str(r.doc_id), r.item_id, r.distance) for r in got) == [("1", 5, 0), ("1", 5, 0), ("None", 5, 0)]
    r = next(r for r in got if r.doc_id == 1)
    assert rows[0][1][r.start : r.end].startswith("ALPHA") and rows[0][1][r.end :] == "End."
    assert D.matches(df, bench.limit(0)).count() == 0 and D.matches(df.limit(0), bench).count() == 0
