"""Cycles and strongly connected components against plain searches."""

import numpy as np

from graphloom.operators import strong, traverse


def plain_cycles(edges):
    """The sequential search: roots in the order of their first edge, edges in order; the last of equal member sets is kept."""
    nexts = {}
    for s, t in edges:
        nexts.setdefault(s, []).append(t)
    seen, found = set(), {}

    def visit(node, path):
        seen.add(node)
        path.append(node)
        for t in nexts.get(node, ()):
            if t in path:
                cycle = path[path.index(t) :]
                found[tuple(sorted(cycle))] = cycle
            elif t not in seen:
                visit(t, path)
        path.pop()

    for root in nexts:
        if root not in seen:
            visit(root, [])
    return list(found.values())


def random_graphs(n, seed=7):
    rng = np.random.default_rng(seed)
    for g in range(n):
        nodes, m = int(rng.integers(1, 9)), int(rng.integers(0, 16))
        yield g, [(f"g{g:04d}_{a}", f"g{g:04d}_{b}") for a, b in rng.integers(0, nodes, (m, 2))]


def test_a_thousand_random_graphs_equal_the_sequential_search(spark):
    rows, want = [], []
    for g, edges in random_graphs(1000):
        rows += [(f"{g:04d}:{k:03d}", s, t) for k, (s, t) in enumerate(edges)]
        want += plain_cycles(edges)
    got = [list(r["members"]) for r in traverse.cycles_of(spark.createDataFrame(rows, "ord string, source string, target string").repartition(4)).collect()]
    assert sorted(got) == sorted(want)


def test_strongly_connected_components(spark):
    rows = [e for _, edges in random_graphs(200, 3) for e in edges]
    reach = {}
    for s, t in rows:
        reach.setdefault(s, set()).add(t)
        reach.setdefault(t, set())
    for k in reach:
        for i in reach:
            if k in reach[i]:
                reach[i] |= reach[k]
    want = {a: min(b for b in reach if b == a or b in reach[a] and a in reach[b]) for a in reach}
    sizes = {c: list(want.values()).count(c) for c in want.values()}
    got = {r["node"]: r["component"] for r in strong.strongly_connected(spark.createDataFrame(rows, "source string, target string")).collect()}
    assert got == {a: c for a, c in want.items() if sizes[c] > 1}


def test_no_edges_and_only_a_chain(spark):
    none = spark.createDataFrame([], "ord string, source string, target string")
    assert traverse.cycles_of(none).count() == 0 and strong.strongly_connected(none).count() == 0
    chain = spark.createDataFrame([(str(i), f"n{i}", f"n{i + 1}") for i in range(6)], "ord string, source string, target string")
    assert traverse.cycles_of(chain).count() == 0
