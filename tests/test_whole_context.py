"""A context is chosen from all candidates, however many have more edges."""

from pyspark.sql import functions as F

from graphloom.operators import context
from graphloom.schema import DIAGNOSTIC, EDGE, NODE, RUN, Graph, empty, shaped


def crowded(spark):
    """2,100 functions of degree 4 each, and two symbols that say what the task says, of degree 2 and 1."""
    more = [("brand", "src/brand.ts"), ("brandy", "src/brand.ts"), ("t", "tests/a.test.ts")]
    few = spark.createDataFrame([(f"9{k}", name, name, file) for k, (name, file) in enumerate(more)], "ord string, id string, name string, file string")
    text = lambda c: F.concat(F.lit("n"), c.cast("string"))
    nodes = spark.range(2100).select(F.lpad("id", 5, "0").alias("ord"), text(F.col("id")).alias("id"), text(F.col("id")).alias("name"), F.lit("src/n.ts").alias("file")).unionByName(few)
    ring = spark.range(4200).select(text(F.col("id") % 2100).alias("source"), text((F.col("id") % 2100 + 1 + F.floor(F.col("id") / 2100)) % 2100).alias("target"))
    edges = ring.unionByName(spark.createDataFrame([("brand", "t"), ("brandy", "brand")], "source string, target string"))
    edges = edges.select(F.concat_ws(">", "source", "target").alias("ord"), F.concat_ws(">", "source", "target").alias("id"), "source", "target", F.lit("calls").alias("kind"), F.lit("exact").alias("confidence"), F.lit("code").alias("graph_domain"))
    nodes = nodes.withColumns({"kind": F.lit("function"), "qualified_name": F.col("name"), "graph_domain": F.lit("code")})
    return Graph(shaped(nodes, NODE), shaped(edges, EDGE), empty(spark, DIAGNOSTIC), empty(spark, RUN))


def test_related_tests_of_symbols_beyond_the_first_by_degree(spark):
    graph = crowded(spark)
    assert [r["file"] for r in context.context(graph, "brand", 2).related_tests.collect()] == ["tests/a.test.ts"]
    assert context.context(graph, "brand", 2, pool=2000).related_tests.count() == 0


def test_relationships_between_symbols_beyond_the_first_by_degree(spark):
    graph = crowded(spark)
    assert [r["id"] for r in context.context(graph, "brand", 2).relationships.collect()] == ["brandy>brand"]
    assert "brandy>brand" not in [r["id"] for r in context.context(graph, "brand", 2, pool=2000).relationships.collect()]
