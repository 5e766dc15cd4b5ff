"""The graph's large steps: ends known by the rows' own keys, one pass for all counts, stored edges in bounded ranges, look-ups by statistics."""

import os
from collections import Counter
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from graphloom.operators import architecture, lookups, snapshots
from graphloom.operators.scope import placed_edges, scoped_edges
from graphloom.sources import store, tables

SCOPES = ("code", "code+docs", "full")
SMALL = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows(df):
    return Counter(map(tuple, df.collect()))


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Tables whose keys often lead nowhere, with nulls and repeated rows."""
    folder = tmp_path_factory.mktemp("odd")
    for name in os.listdir(SMALL):
        df = spark.read.parquet(f"{SMALL}/{name}")
        if name == "part.parquet":
            df = df.where("p_partkey % 3 <> 0")
        elif name == "customer.parquet":
            df = df.where("c_custkey % 4 <> 0").withColumn("c_nationkey", F.when(F.col("c_custkey") % 5 == 0, 99).otherwise(F.col("c_nationkey")))
        elif name == "supplier.parquet":
            df = df.where("s_suppkey % 2 = 0")
        elif name == "events.parquet":
            df = df.withColumn("user_id", F.when(F.col("event_id") % 7 != 0, F.col("user_id")))
        elif name == "documents.parquet":
            df = df.where("doc_id % 2 = 0").limit(60)
        elif name == "region.parquet":
            df = df.where("r_regionkey <> 1")
        df.write.parquet(f"{folder}/{name}")
    return str(folder)


def test_ends_by_keys_are_those_by_nodes(spark, odd):
    graph = tables.graph_of(spark, odd)
    plain = replace(graph, nodes=graph.nodes.dropDuplicates(["id"]), placed=None)
    columns = ("id", "source_category", "target_category")
    given = rows(graph.placed.select(*columns))
    assert given == rows(placed_edges(plain).select(*columns)) and any(None in r for r in given)
    for scope in SCOPES:
        options = {"scope": scope, "unresolved": True}
        assert rows(scoped_edges(graph, **options).select("id")) == rows(scoped_edges(plain, **options).select("id"))
    joins = [line for line in plan_of(scoped_edges(graph, "full", unresolved=True).where("kind = 'calls'")).splitlines() if "Join" in line]
    assert joins and not any("source#" in line or "target#" in line for line in joins)


def test_counts_take_one_pass_and_are_those_by_joins(spark, odd, monkeypatch):
    graph = tables.graph_of(spark, odd)
    plain = replace(graph, nodes=graph.nodes.dropDuplicates(["id"]), placed=None)
    taken = []
    kept = lookups.census
    monkeypatch.setattr(lookups, "census", lambda g: (taken.append(g), kept(g))[1])
    lookups.overview(graph, "code")
    assert len(taken) == 1
    for scope in SCOPES:
        edges = scoped_edges(plain, scope)
        assert lookups.overview_counts(graph, scope).first()["edges"] == edges.count()
        assert rows(lookups.overview_edges(graph, scope)) == rows(edges.groupBy("kind").count())
    assert lookups.overview_counts(graph).first()["total_edges"] == graph.edges.count()


def test_runs_count_edges_without_meeting_them(spark):
    graph = tables.graph_of(spark, SMALL)
    edges = graph.edges.where("kind = 'contains'")
    twice = edges.unionByName(edges)
    counted = tables.runs(graph.nodes, twice, graph.diagnostics)
    assert counted.first()["edge_count"] == twice.count()


def test_stored_edges_lie_in_bounded_ranges(spark, odd, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "TASK_EDGES", 500)
    graph = tables.graph_of(spark, odd)
    base = store.write(graph, str(tmp_path / "index"), {}, counted=tables.runs)
    n = graph.edges.count()
    for end in ("source", "target"):
        spread = spark.read.parquet(f"{base}/edges_by_{end}").groupBy(F.input_file_name()).count().agg(F.max("count"), F.count("*")).first()
        assert spread[1] >= n // 1000 and spread[0] < 1500
    back = store.read(spark, str(tmp_path / "index"))
    columns = [c for c in graph.edges.columns if c != "evidence"]
    assert rows(back.edges.select(*columns, F.to_json("evidence"))) == rows(graph.edges.select(*columns, F.to_json("evidence")))
    assert rows(scoped_edges(back, "full").select("id")) == rows(scoped_edges(graph, "full").select("id"))
    assert rows(back.runs) == rows(graph.runs)
    ids = [r[0] for r in graph.edges.where("kind = 'calls'").select("source").distinct().limit(25).collect()]
    found = back.incident(ids, ("source", "target"))
    assert rows(found.select("id")) == rows(graph.edges.where(F.col("source").isin(*ids) | F.col("target").isin(*ids)).select("id"))
    # lists of more than ten values would be read as one range from the least to the greatest
    plan = back.incident(ids, ("source",))._jdf.queryExecution().optimizedPlan().toString()
    assert "INSET" not in plan and plan.count(" IN (") >= 3


def test_nodes_of_changed_files_go_to_the_edges(spark):
    graph = tables.graph_of(spark, SMALL)
    changed = spark.createDataFrame([("standard/Brand1.ts", "modified")], "path string, change string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = snapshots.crossing_edges(graph.edges, graph.nodes, changed).where("kind = 'imports'").select("id")
        assert plan_of(found).count("BroadcastHashJoin") >= 2
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_only_edges_between_shown_units_are_ranked(spark):
    graph = tables.graph_of(spark, SMALL)
    flows = architecture.unit_edges(graph)
    want = architecture.first_underlying(flows)
    edges = architecture.architecture(graph, 20, flows=flows)[1]
    assert "LeftSemi" in plan_of(edges)
    joined = edges.select("source", "target", "underlying").join(want.withColumnRenamed("underlying", "all"), ["source", "target"])
    assert joined.count() == edges.count() and joined.where("underlying <> all").isEmpty()
