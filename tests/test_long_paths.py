from marlstone.operators import graph as G


def test_a_chain_and_a_cycle_past_64_steps(spark):
    n = 140
    chain = [(i + 1, i) for i in range(n)]
    got = {(r.ancestor, r.node, r.distance) for r in G.reachable(spark.createDataFrame(chain, "child long, parent long")).collect()}
    assert got == {(a, b, b - a) for b in range(n + 1) for a in range(b + 1)}
    ring = [((i + 1) % n, i) for i in range(n)] + [(1000, 0)]
    assert {r.node for r in G.cycle_nodes(spark.createDataFrame(ring, "child long, parent long")).collect()} == set(range(n))
