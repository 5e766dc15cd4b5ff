"""The base graph: the repository, a directory for each path prefix, and what contains what."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import dirname
from .base import Corpus, Found, edge_rows, id_of, node_rows

ADAPTER, RANK = "core", 0


class Files:
    name, version = ADAPTER, "1"

    def detect(self, corpus: Corpus) -> bool:
        return True

    def extract(self, corpus: Corpus, graph: Found) -> Found:
        c = F.col
        root = corpus.spark.range(1).select(F.lit(corpus.name).alias("name"))
        parts = F.split("path", "/")
        prefixes = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
        folders = corpus.files.where(F.size(parts) > 1).select(F.explode(prefixes).alias("folder")).distinct()
        root_id = id_of(corpus, "repository", F.lit(corpus.name))
        above = dirname(c("folder"))
        own, parent = id_of(corpus, "directory", c("folder"), c("folder")), id_of(corpus, "directory", above, above)
        nodes = node_rows(root, corpus, ADAPTER, RANK, "repository", c("name"), c("name")).unionByName(node_rows(folders, corpus, ADAPTER, RANK, "directory", F.element_at(F.split("folder", "/"), -1), c("folder"), file=c("folder")))
        edges = edge_rows(folders, ADAPTER, RANK, "contains", F.when(above == "", root_id).otherwise(parent), own, "exact", c("folder"), 1, 1, "directory")
        return Found(nodes, edges)
