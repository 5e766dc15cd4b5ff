"""The graph's operators on small inputs, against plain Python models."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from graphloom.functions import text
from graphloom.operators import contains, snapshots, traverse
from graphloom.plans import catalog
from graphloom.schema import DIAGNOSTIC, EDGE, NODE, RUN, Graph, empty, shaped

DATA = "/root/testdata/sf0.001"


def graph(spark, n, links):
    nodes = shaped(spark.createDataFrame([(f"{i:03d}", str(i), "function", str(i)) for i in range(n)], "ord string, id string, kind string, name string"), NODE)
    edges = shaped(spark.createDataFrame([(f"{k:04d}", str(k), str(a), str(b), "calls", "exact", "code") for k, (a, b) in enumerate(links)], "ord string, id string, source string, target string, kind string, confidence string, graph_domain string"), EDGE)
    return Graph(nodes, edges, empty(spark, DIAGNOSTIC), empty(spark, RUN))


def walk(start, links, depth, most):
    visited, frontier = [start], {start}
    for _ in range(depth):
        fresh = []
        for a, b in links:
            if a in frontier or b in frontier:
                other = b if a in frontier else a
                if other not in visited and other not in fresh:
                    fresh.append(other)
        fresh = fresh[: most - len(visited)]
        visited += fresh
        frontier = set(fresh)
    return visited


def test_neighborhood_equals_a_plain_search(spark):
    rng = random.Random(1)
    links = [(rng.randrange(12), rng.randrange(12)) for _ in range(20)]
    got = traverse.neighborhood(graph(spark, 12, links), "0", 3, 6)
    assert {r["id"] for r in got.nodes.collect()} == {str(x) for x in walk(0, links, 3, 6)}


def test_cycles_and_self_loops(spark):
    found = traverse.cycles(graph(spark, 6, [(0, 1), (1, 2), (2, 0), (3, 3), (4, 5)])).collect()
    assert sorted(sorted(r["members"]) for r in found) == [["0", "1", "2"], ["3"]]


def test_unknown_symbols_are_an_error(spark):
    with pytest.raises(traverse.NotFound):
        traverse.neighborhood(graph(spark, 1, [(0, 0)]), "none")


def test_containment_join_with_short_and_long_needles(spark):
    texts = spark.createDataFrame([(1, "one two three four"), (2, "xtwo"), (3, None)], "i int, t string")
    needles = spark.createDataFrame([("a", "e two three fo"), ("b", "two"), ("c", "five six seven")], "k string, n string")
    assert sorted((r["i"], r["k"]) for r in contains.containment_join(texts, needles, "t", "n").collect()) == [(1, "a"), (1, "b"), (2, "b")]


def test_changes(spark):
    f = lambda rows: snapshots.fingerprints(spark.createDataFrame(rows, "path string, content string"))
    got = snapshots.changes(f([("a", "1"), ("b", "2"), ("c", "3")]), f([("a", "1"), ("b", "x"), ("d", "4")])).collect()
    assert sorted(map(tuple, got)) == [("b", "modified"), ("c", "deleted"), ("d", "added")]


def test_path_and_slug_functions(spark):
    row = spark.range(1).select(text.normalize(F.lit("a/./b/../c")), text.slug(F.lit("Hello, `World`!")), text.package_of(F.lit("@a/b/c"))).first()
    assert tuple(row) == ("a/c", "hello-world", "@a/b")


@pytest.mark.parametrize("name", ["callers", "symbol_lookup", "mentions", "status_modified"])
def test_queries_equal_their_sql(spark, name):
    c = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "benchmark", "labels", "conversations"):
        c.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    got = catalog.QUERIES[name](spark, DATA)
    want = c.sql(f"select {', '.join(got.columns)} from ({catalog.ORACLE_SQL[name]})").fetchall()
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
