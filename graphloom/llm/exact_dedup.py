"""Exact duplicate removal by two-pass Bloom filtering.

The first pass sets two bits per text digest and keeps those bits that at least two rows set: a
filter that every repeated digest passes. Bit positions are merged per segment of the filter, so no
task ever holds more than a segment's share of the corpus. The second pass tests every row: only
rows that may be repeated shuffle, all others go straight through as their own group.

Texts are equal when identical after lower-casing A-Z; null counts as empty. Of equal texts the row
with the largest doc_id stays (a null doc_id is the smallest; of rows that repeat a doc_id, one). An
empty table gives an empty result; all rows of other columns' values are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, cut, free_name, small_batches, tidy

#: Bits per row, up to the most bits that are ever broadcast (32 MB). A fuller filter lets more rows shuffle, no more.
BITS_PER_ROW, MOST_BITS, SEGMENT_BITS = 16, 2**28, 2**18
#: Copies that make a text hot, and the most hot texts (below 10 MB broadcast).
HOT_COPIES, HOT_WINNERS = 1000, 50_000


def _positions(batch: pa.RecordBatch, m: int) -> np.ndarray:
    """Two bit positions per row, from the two digest numbers in the batch's last columns."""
    n = batch.num_columns
    return np.stack([batch.column(n - 2 + i).to_numpy(zero_copy_only=False) % m for i in (0, 1)])


def _numbers(digest: str) -> list:
    return [F.conv(F.substring(digest, i, 15), 16, 10).cast("long") for i in (1, 16)]


def repeated_bits(digests: DataFrame, rows: int, digest: str = "text_sha256") -> tuple[int, np.ndarray]:
    """Filter of the digests that at least two rows may share: its size in bits, and the bits packed."""
    m = min(MOST_BITS, max(SEGMENT_BITS, 1 << (BITS_PER_ROW * max(rows, 1) - 1).bit_length()))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = _positions(batch, m)
            p[1][p[0] == p[1]] = -1  # a row sets a bit once
            at, count = np.unique(p[p >= 0], return_counts=True)
            segment = at // SEGMENT_BITS
            names, start = np.unique(segment, return_index=True)
            offset = (at % SEGMENT_BITS).astype(np.uint32)
            parts = [np.concatenate((o, o[c > 1])).tobytes() for o, c in zip(np.split(offset, start[1:]), np.split(count, start[1:]), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(parts, pa.binary())], ["segment", "bits"])

    def merge(table: pa.Table) -> pa.Table:
        seen = np.zeros(SEGMENT_BITS, np.uint8)
        for chunk in table.column("bits").chunks:
            for raw in chunk:
                at, count = np.unique(np.frombuffer(raw.as_buffer(), np.uint32), return_counts=True)
                seen[at] = np.minimum(2, seen[at] + count)
        return pa.table({"segment": table.column("segment").slice(0, 1), "bits": pa.array([np.packbits(seen >= 2).tobytes()], pa.binary())})

    schema = "segment long, bits binary"
    merged = digests.select(*_numbers(digest)).mapInArrow(mark, schema).groupBy("segment").applyInArrow(merge, schema)
    bits = np.zeros(m // 8, np.uint8)
    for row in merged.toLocalIterator():  # at most MOST_BITS in all
        at = row["segment"] * (SEGMENT_BITS // 8)
        bits[at : at + SEGMENT_BITS // 8] = np.frombuffer(row["bits"], np.uint8)
    return m, bits


def may_repeat(df: DataFrame, m: int, bits: np.ndarray, flag: str, digest: str = "text_sha256") -> DataFrame:
    """df with a flag: False only for digests that one row alone has."""
    shared = df.sparkSession.sparkContext.broadcast(bits)
    names = df.columns

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have = shared.value
        for batch in batches:
            p = _positions(batch, m)
            hit = ((have[p >> 3] >> (7 - (p & 7)).astype(np.uint8)) & 1).all(axis=0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(hit)], [*names, flag])

    one, two = free_name(df, "_bit1"), free_name(df, "_bit2")
    numbers = _numbers(digest)
    schema = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in df.schema.fields) + f", {flag} boolean"
    return small_batches(df).withColumns({one: numbers[0], two: numbers[1]}).mapInArrow(tidy(test), schema)


def _winners(digests: DataFrame) -> DataFrame:
    return digests.groupBy("text_sha256").agg(F.max("doc_id").alias("keep_id"), F.coalesce(F.max_by("row_id", "doc_id"), F.max("row_id")).alias("keep_row"), F.count("*").alias("group_size"))


def assign(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256."""
    digests = docs.select(F.col(doc_id).alias("doc_id"), F.sha2(ascii_lower(F.col(text)), 256).alias("text_sha256"))
    digests = cut(digests.withColumn("row_id", F.monotonically_increasing_id()))
    rows = digests.count()
    m, bits = repeated_bits(digests, rows)
    tested = may_repeat(digests, m, bits, "maybe")
    alone = tested.where("not maybe").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    maybe = tested.where("maybe").drop("maybe")
    winners = cut(_winners(maybe))
    # texts with so many copies are few (HOT_WINNERS at most) and meet their rows by broadcast, so no task gathers the copies of one
    often = F.col("group_size") >= max(HOT_COPIES, rows // HOT_WINNERS)
    hot = F.broadcast(winners.where(often))
    both = maybe.join(hot, "text_sha256").unionByName(maybe.join(hot, "text_sha256", "left_anti").join(winners.where(~often), "text_sha256"))
    joined = both.select("doc_id", "keep_id", "group_size", (F.col("row_id") == F.col("keep_row")).alias("kept"), "text_sha256")
    return alone.unionByName(joined)


def keep_rows(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of docs that stay, with all their columns. Rows that cannot be repeated never shuffle."""
    sha, flag, key = free_name(docs, "_sha"), free_name(docs, "_maybe"), free_name(docs, "_key")
    digests = cut(docs.select(F.col(doc_id).alias("doc_id"), F.sha2(ascii_lower(F.col(text)), 256).alias("text_sha256")).withColumn("row_id", F.monotonically_increasing_id()))
    m, bits = repeated_bits(digests, digests.count())
    maybe = may_repeat(digests, m, bits, "maybe").where("maybe").drop("maybe")
    keep = _winners(maybe).select(F.col("text_sha256").alias(sha), F.col("keep_id").alias(key))
    tested = may_repeat(docs.withColumn(sha, F.sha2(ascii_lower(F.col(text)), 256)), m, bits, flag, digest=sha)
    # one more key column than the text's digest: copies of one text spread over all tasks
    again = tested.where(flag).withColumn(key, F.col(doc_id)).join(keep.withColumnRenamed(sha, sha + "2").withColumnRenamed(key, key + "2"), F.col(sha).eqNullSafe(F.col(sha + "2")) & F.col(key).eqNullSafe(F.col(key + "2")), "left_semi").dropDuplicates([sha, key])
    return tested.where(~F.col(flag)).select(*docs.columns).unionByName(again.select(*docs.columns))
