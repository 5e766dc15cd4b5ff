"""Conflict-constrained best-fit packing of documents into training sequences.

Documents are measured in words. One longer than a sequence is cut into full sequences and a rest, so
nothing is lost. Pieces are dealt at random (by a hash) to shards of a bounded size; within a shard they
are placed from the longest down, each into the open bin with the least room that still holds it. Bins
are kept in order of their residual room and carry two bitmaps: of the duplicate clusters they hold and
of the sources that have reached their share. Where the tightest bin conflicts, the search goes on to
its successors until the tightest compatible bin is found, or a new one is opened.

Constraints: a bin holds at most one piece of a duplicate cluster, and at most PER_SOURCE documents of
a source. Full sequences that one document fills are bins of their own.

Defined results: null or empty text is a piece of length 0 that is placed like others; a null source is
a source of its own; without a cluster column, equal texts (A-Z lower-cased) are a cluster, with one a null cluster conflicts with nothing; ties go to
the lower doc_id; extra columns play no part; repeated rows are copies of each other; an empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, small_batches, text_slices, tidy, words_of

CAPACITY, PER_SOURCE, SHARD_PIECES = 4096, 4, 4000


def measure(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str | None = "source", cluster: str | None = None) -> DataFrame:
    """doc_id, source, cluster and length in words of each document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_slices(batch, "text"):
                length = [len(words_of(t)) for t in texts]
                given = part.column(3) if cluster else pa.array([xxhash.xxh3_128_hexdigest(t.encode("utf-8", "replace").lower()) for t in texts], pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), given, pa.array(length, pa.int64())], ["doc_id", "source", "cluster", "length"])

    given = F.col(cluster).cast("string") if cluster else F.lit(None).cast("string")
    chosen = docs.select(F.col(doc_id).alias("doc_id"), (F.col(source).cast("string") if source else F.lit(None).cast("string")).alias("source"), F.col(text).alias("text"), given.alias("cluster"))
    return small_batches(chosen).mapInArrow(tidy(run), "doc_id long, source string, cluster string, length long")


def best_fit(lengths: list[int], sources: list, clusters: list, capacity: int = CAPACITY, per_source: int = PER_SOURCE) -> list[int]:
    """The bin of each piece. Pieces come from the longest down; the tightest compatible bin takes each."""
    source_bit = {s: 1 << i for i, s in enumerate(dict.fromkeys(sources))}
    cluster_bit = {c: 1 << i for i, c in enumerate(x for x in dict.fromkeys(clusters) if x is not None)} | {None: 0}
    order: list[tuple[int, int]] = []  # (residual, bin), ascending
    full_sources: list[int] = []  # per bin: sources that have reached their share
    held: list[int] = []  # per bin: clusters
    counts: list[dict] = []
    out = []
    for n, s, c in zip(lengths, sources, clusters, strict=True):
        sb, cb = source_bit[s], cluster_bit[c]
        i = bisect_left(order, (n, -1))
        while i < len(order) and (full_sources[order[i][1]] & sb or held[order[i][1]] & cb):
            i += 1
        if i < len(order):
            room, b = order.pop(i)
        else:
            room, b = capacity, len(held)
            full_sources.append(0)
            held.append(0)
            counts.append({})
        held[b] |= cb
        counts[b][s] = counts[b].get(s, 0) + 1
        if counts[b][s] >= per_source:
            full_sources[b] |= sb
        insort(order, (room - n, b))
        out.append(b)
    return out


def pack(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str | None = "source", cluster: str | None = None, capacity: int = CAPACITY, per_source: int = PER_SOURCE, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """One row per piece: doc_id, piece, start and length (in words), bin_id, bin_offset, bin_used."""
    measured = cut(measure(docs, text, doc_id, source, cluster).withColumn("row", F.monotonically_increasing_id()))
    shards = max(1, -(-measured.count() // shard_pieces))
    whole = F.floor(F.col("length") / capacity).cast("long")
    full = measured.where(whole > 0).select("doc_id", "row", F.explode(F.sequence(F.lit(0).cast("long"), whole - 1)).alias("piece"))
    # a sequence that one document fills needs no search
    full = full.select("doc_id", "piece", (F.col("piece") * capacity).alias("start"), F.lit(capacity).cast("long").alias("length"), F.concat_ws("-", F.lit("f"), "row", "piece").alias("bin_id"), F.lit(0).cast("long").alias("bin_offset"), F.lit(capacity).cast("long").alias("bin_used"))
    rest = measured.where((whole == 0) | (F.col("length") % capacity > 0)).select("doc_id", "row", "source", "cluster", whole.alias("piece"), (whole * capacity).alias("start"), (F.col("length") % capacity).alias("length"), F.pmod(F.xxhash64("doc_id", "row"), F.lit(shards)).alias("shard"))

    def place(table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("row", "ascending")])
        length, shard = table.column("length").to_pylist(), table.column("shard")[0].as_py()
        bins = best_fit(length, table.column("source").to_pylist(), table.column("cluster").to_pylist(), capacity, per_source)
        used: dict[int, int] = {}
        offset = []
        for b, n in zip(bins, length, strict=True):
            offset.append(used.get(b, 0))
            used[b] = offset[-1] + n
        return pa.table({"doc_id": table.column("doc_id"), "piece": table.column("piece"), "start": table.column("start"), "length": table.column("length"), "bin_id": pa.array([f"b-{shard}-{b}" for b in bins]), "bin_offset": pa.array(offset, pa.int64()), "bin_used": pa.array([used[b] for b in bins], pa.int64())})

    packed = rest.groupBy("shard").applyInArrow(place, "doc_id long, piece long, start long, length long, bin_id string, bin_offset long, bin_used long")
    return full.unionByName(packed)
