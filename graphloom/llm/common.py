"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lineage import cut, scratch  # noqa: F401

#: Characters of text that one vectorised step inside a task handles at a time (bounds a worker's memory).
CHUNK_CHARS = 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; null becomes the empty text."""
    return F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def words_of(text: str) -> list[bytes]:
    """The contract's words of a text in UTF-8, A-Z lower-cased. (On bytes, lower() and split() know ASCII only.)"""
    return text.encode("utf-8", "replace").lower().split()


#: Rows of a batch that goes to a Python worker, where the session says nothing else: with whole texts, Spark's 10,000 make a worker (and the executor
#: beside it) hold tens of megabytes several times over.
BATCH_ROWS = ("spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "1000")


def small_batches(df: DataFrame) -> DataFrame:
    """df, with batches of whole texts kept small in its session (a setting of the user's own stays). Results don't depend on it."""
    conf, (name, default, ours) = df.sparkSession.conf, BATCH_ROWS
    if conf.get(name) == default:
        conf.set(name, ours)
    return df


def text_slices(batch: pa.RecordBatch, column: str, limit: int = CHUNK_CHARS) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Consecutive slices of a batch with their texts (null: empty), each of about `limit` bytes; one long text may exceed it. Only a slice's texts become Python strings."""
    lengths = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_numpy(zero_copy_only=False)
    reach = (lengths.astype("int64") + 1).cumsum()
    start = 0
    while start < batch.num_rows:
        stop = max(start + 1, int(reach.searchsorted((reach[start - 1] if start else 0) + limit, "right")))
        part = batch.slice(start, stop - start)
        yield part, ["" if t is None else t for t in part.column(part.schema.get_field_index(column)).to_pylist()]
        start = stop


def tidy(run):
    """A task's function over batches that at its end gives what the worker holds in vain back to the system: workers live on, and an executor's memory is shared."""
    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
                ctypes.CDLL("libc.so.6").malloc_trim(0)

    return tidied


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df does not use yet (Spark's names ignore case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def without(df: DataFrame, results: list[str], inputs: list[str]) -> DataFrame:
    """df without columns that results take the place of, as withColumn would (Spark's names ignore case); an input can't be replaced."""
    new = {r.lower() for r in results}
    if clash := [c for c in inputs if c.lower() in new]:
        raise ValueError(f"results {results} would replace the input {clash}")
    return df.select(*[df[f"`{c.replace('`', '``')}`"] for c in df.columns if c.lower() not in new])
