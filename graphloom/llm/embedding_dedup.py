"""Near-duplicate removal of embeddings by random-hyperplane sign hashing in several tables.

Equal vectors of a label first collapse into one class with a weight, so copies never meet pairwise.
A class enters one bucket per table (label, table, sign bits). A bucket of more than TILE classes is cut by a hash into
tiles, and each two tiles are a task's work, so dense groups spread over tasks and none is held whole. There blocks of
exact cosines in double precision are compared, without making a row per pair: a class gets the weighted number of
its links, and a spanning forest of the bucket's links goes on to the distributed connected
components. A pair that meets in several tables is counted in the first of them only.

The number of sign bits follows the logarithm of the largest label's size, and the number of tables
follows from the recall asked for at the threshold's angle (pairs above it are found more surely).

Defined results: a null label, or a vector that is null, empty, zero or holds null or non-finite
components, links with nothing (0 links, its own component); vectors of different lengths never link;
repeated rows are copies of each other; extra columns play no part; a null id never names a component unless all ids of it are null.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from ..operators.components import components

THRESHOLD, RECALL = 0.93, 0.998
#: Classes that a bucket should hold about, and rows of the cosine block that is computed at a time.
BUCKET, BLOCK = 256, 1024
#: Classes that a tile holds about.
TILE = 512


def plan(largest: int, threshold: float = THRESHOLD, recall: float = RECALL, bucket: int = BUCKET) -> tuple[int, int]:
    """Sign bits per table, and tables."""
    bits = max(1, min(30, round(math.log2(max(largest, 1) / bucket)) if largest > bucket else 1))
    same = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(1 - recall) / math.log(1 - same)))


def planes(dim: int, bits: int, tables: int, seed: int = 3) -> np.ndarray:
    return np.random.default_rng([seed, dim]).standard_normal((dim, bits * tables))


def _bucket_links(vectors: np.ndarray, codes: np.ndarray, table: int, weight: np.ndarray, threshold: float, tile: np.ndarray | None = None) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Weighted links that each row first meets in this table, and a spanning forest of these links; between two tiles only, if tile is given."""
    n = len(vectors)
    unit = vectors / np.linalg.norm(vectors, axis=1)[:, None]
    links = np.zeros(n, np.int64)
    root = np.arange(n)
    forest: list[tuple[int, int]] = []
    for i in range(0, n, BLOCK):
        for j in range(i, n, BLOCK):
            near = unit[i : i + BLOCK] @ unit[j : j + BLOCK].T >= threshold
            if i == j:
                np.fill_diagonal(near, False)
            if tile is not None:
                near &= tile[i : i + BLOCK, None] != tile[None, j : j + BLOCK]
            if not near.any():
                continue
            a, b = np.nonzero(near)
            a, b = a + i, b + j
            first = ~(codes[a, :table] == codes[b, :table]).any(axis=1) if table else np.ones(len(a), bool)
            links += np.bincount(a[first], weight[b[first]], n).astype(np.int64)
            if i != j:
                links += np.bincount(b[first], weight[a[first]], n).astype(np.int64)
            # the trees that a row touches become one; rows whose neighbours are all in their tree add nothing
            for x in np.unique(a[root[a] != root[b]]):
                near_x = b[np.searchsorted(a, x) : np.searchsorted(a, x, "right")]
                trees, at = np.unique(root[near_x], return_index=True)
                if len(trees) > 1 or trees[0] != root[x]:
                    forest += [(int(x), int(near_x[k])) for t, k in zip(trees, at, strict=True) if t != root[x]]
                    trees = np.append(trees, root[x])
                    root[np.isin(root, trees)] = trees.min()
    return links, forest


def near_duplicates(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    spark = vectors.sparkSession
    v = F.col(embedding).cast("array<double>")
    fine = F.col(label).isNotNull() & v.isNotNull() & F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))), F.lit(False)) & F.coalesce(F.exists(v, lambda x: x != 0), F.lit(False))
    # -0.0 and 0.0 are one number: adding 0.0 makes copies equal
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(label).cast("string").alias("label"), F.when(fine, F.transform(v, lambda x: x + F.lit(0.0))).alias("v"))
    rows = cut(rows.withColumn("key", F.when(F.col("v").isNotNull(), F.sha2(F.concat_ws("|", F.col("label"), F.array_join(F.transform("v", lambda x: x.cast("string")), ",")), 256))))
    valid = rows.where("v is not null")
    classes = cut(valid.groupBy("key").agg(F.min("vec_id").alias("rep"), F.count("*").alias("w"), F.min("label").alias("label"), F.any_value("v").alias("v")))
    # the largest number of classes of any label and vector length decides the bits: a handful of numbers
    largest = classes.groupBy("label", F.size("v").alias("dim")).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    bits, tables = plan(largest, threshold, recall)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, np.ndarray] = {}
        for batch in batches:
            lists = batch.column(3)
            flat, off = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            for i in range(0, batch.num_rows, 2000):
                part = batch.slice(i, 2000)
                lo = off[i : i + part.num_rows + 1]
                codes = np.zeros((part.num_rows, tables), np.int64)
                dims = np.diff(lo)
                for d in np.unique(dims):
                    at = np.flatnonzero(dims == d)
                    x = np.stack([flat[lo[k] : lo[k + 1]] for k in at])
                    p = made.setdefault(int(d), planes(int(d), bits, tables))
                    codes[at] = ((x @ p > 0).reshape(len(at), tables, bits) << np.arange(bits)).sum(2)
                code_lists = pa.ListArray.from_arrays(pa.array(np.arange(part.num_rows + 1) * tables, pa.int32()), pa.array(codes.ravel().astype(np.int32)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), pa.array(dims.astype(np.int32)), part.column(3), code_lists], ["key", "w", "label", "dim", "v", "codes"])

    coded = classes.select("key", "w", "label", "v").mapInArrow(sign, "key string, w long, label string, dim int, v array<double>, codes array<int>")
    coded = cut(coded)
    bucket = ["label", "dim", "t", "code"]
    # which class goes to which tiles is settled without the vectors, which follow by key
    entries = coded.select("key", "label", "dim", F.posexplode("codes").alias("t", "code"))
    parts = entries.groupBy(*bucket).agg(F.ceil(F.count("*") / TILE).cast("int").alias("parts")).where("parts > 1")
    dealt = entries.join(cut(parts), bucket, "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    dealt = dealt.withColumn("tile", F.pmod(F.xxhash64("key", F.lit(9)), "parts").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.select("key", *bucket, F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"), "tile")
    bucketed = dealt.join(coded.select("key", "w", "v", "codes"), "key")

    def compare(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        keys = group.column("key").to_pylist()
        n = len(keys)
        x = group.column("v").combine_chunks().values.to_numpy(zero_copy_only=False).reshape(n, -1)
        codes = group.column("codes").combine_chunks().values.to_numpy(zero_copy_only=False).reshape(n, -1)
        links, forest = _bucket_links(x, codes, group.column("t")[0].as_py(), group.column("w").to_numpy(), threshold, None if group.column("i")[0] == group.column("j")[0] else group.column("tile").to_numpy())
        some = np.flatnonzero(links)
        a = [keys[i] for i in some] + [keys[i] for i, _ in forest]
        b = [None] * len(some) + [keys[j] for _, j in forest]
        return pa.table({"a": pa.array(a, pa.string()), "b": pa.array(b, pa.string()), "links": pa.array(links[some].tolist() + [0] * len(forest), pa.int64())})

    found = cut(bucketed.groupBy(*bucket, "i", "j").applyInArrow(compare, "a string, b string, links long"))
    counts = found.where("b is null").groupBy(F.col("a").alias("key")).agg(F.sum("links").alias("links"))
    joined = components(found.where("b is not null").select("a", "b"))
    # a component's name is the least id of its classes
    named = classes.select("key", "rep", "w").join(joined.withColumnRenamed("node", "key"), "key", "left").join(counts, "key", "left")
    named = cut(named.select("key", "rep", "w", F.coalesce("component", "key").alias("component"), F.coalesce("links", F.lit(0)).alias("links")))
    least = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    result = named.join(least, "component").select("key", (F.col("links") + F.col("w") - 1).alias("n_links"), "component_id")
    linked = rows.where("v is not null").select("vec_id", "key").join(result, "key").select("vec_id", "n_links", "component_id")
    alone = rows.where("v is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
