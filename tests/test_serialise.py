"""Token sequences of tables against a plain loop."""

import math
import random

import pytest

from marlstone.operators.serialise import serialised

SHOWN = {"hot": 4, "one": 1, "wide": 6}


def ids(x):
    return [b + 16 for b in (x or "").encode()]


def plain(tables, vectors, most, k, weight, boundary):
    out = {}
    for t, columns in tables.items():
        n = 1 + min(k, len(columns) - 1)
        budget = max(1, (most - 2 * n) // n)

        def one(name, values):
            tokens = [1, *ids(name)[: budget // 4], 2]
            room = budget - len(tokens)
            for v in values:
                cost = len(ids(v)) + 1 + boundary
                if cost > room:
                    break
                tokens += [5] * boundary + ids(v) + [2]
                room -= cost
            return tokens

        def cos(a, b):
            return sum(x * y for x, y in zip(a, b, strict=True)) / (math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b)))

        for target in range(len(columns)):
            left, picked = [i for i in range(len(columns)) if i != target], []
            while left and len(picked) < k:
                v = vectors[t]
                best = max(left, key=lambda i: (weight * cos(v[target], v[i]) - (1 - weight) * max((cos(v[i], v[j]) for j in picked), default=0), -i))
                picked.append(best)
                left.remove(best)
            tokens, roles = [], []
            for role, i in enumerate([target, *picked]):
                own = one(*columns[i])
                tokens += own
                roles += [role] * len(own)
            out[t, target] = (tokens[:most], roles[:most])
    return out


@pytest.mark.parametrize(("most", "k", "boundary"), [(64, 2, False), (200, 3, True), (9, 5, False)])
def test_tokens_and_roles_match_a_loop(spark, most, k, boundary):
    rnd = random.Random(most)
    tables, vectors, cells, names, vecs = {}, {}, [], [], []
    for t, width in SHOWN.items():
        columns = []
        for ix in range(width):
            name = rnd.choice(["name", "ß and é", "", "x" * 40])
            values = [rnd.choice([None, "", "a", "bb", "ç", "long " * 9]) for _ in range(300 if t == "hot" else rnd.randrange(5))]
            columns.append((name, values))
            names.append((t, ix, name))
            cells += [(t, ix, p, v) for p, v in enumerate(values)]
            vecs.append((t, ix, [rnd.uniform(0.1, 1) for _ in range(4)]))
        tables[t] = columns
        vectors[t] = [v for x, _, v in vecs if x == t]
    rnd.shuffle(cells)
    got = serialised(
        spark.createDataFrame(cells, "table string, ix int, place int, value string"), spark.createDataFrame(names, "table string, ix int, name string"),
        spark.createDataFrame(vecs, "table string, ix int, vector array<double>"), most, k, 0.5, boundary,
    ).collect()
    assert {(r.table, r.target): (r.tokens, r.roles) for r in got} == plain(tables, vectors, most, k, 0.5, boundary)
