"""Structure of source code: lines with what is code in them, what surrounds a place, names ahead of brackets, and the files that imports mean.

There is no compiler behind this: the scanner in lexer.py tells code from strings and comments and closes brackets and
statements; declarations, calls and bindings are patterns over its tokens. Rows meet by file; nothing wider than one file is gathered.
"""

from __future__ import annotations

import heapq
import itertools
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import dirname, normalize
from .base import matches
from .lexer import masked


def code_lines(files: DataFrame, language: str) -> DataFrame:
    """path, line, text, bare (of the same length, blank where it is no code) of every line, from 1."""
    both = F.arrays_zip(F.split("content", "\n", -1).alias("text"), F.split("bare", "\n", -1).alias("bare"))
    lines = masked(files, language).select("path", F.posexplode(both).alias("i", "l"))
    return lines.select("path", (F.col("i") + 1).alias("line"), *[F.regexp_replace(F.col("l")[c], "\r$", "").alias(c) for c in ("text", "bare")])


def in_context(tokens: DataFrame) -> DataFrame:
    """Code tokens; what stands around them is in the columns that the scanner made."""
    return tokens.where("i is not null")


def swept(places: DataFrame, ranges: DataFrame, at: str, to: str, name: str, field: T.DataType, choose: Callable[[list[tuple[int, int, int]], int], object], strictly: bool = False) -> DataFrame:
    """places (path, at, ...) with what choose makes of the ranges (path, at, to, ...) that have begun at each, strictly before it or there.

    Places and ranges of a file come sorted, and files come one after the other, so a task passes any number of them in one go. choose(open, place) gets the heap of
    (length, start, end, number) of the ranges that have begun, and may take ended ones off it; it gives the number, or a list of numbers, of ranges."""
    fields = [c for c in ranges.columns if c != "path"]
    begun, met = (1, 0) if strictly else (0, 1)
    one = ranges.select("path", F.col(at).alias("_at"), F.lit(begun).alias("_turn"), F.col(to).alias("_to"), F.struct(*fields).alias("_range"), F.lit(None).alias("_place"))
    both = one.unionByName(places.select("path", F.col(at).alias("_at"), F.lit(met).alias("_turn"), F.lit(None).alias("_to"), F.lit(None).alias("_range"), F.struct(*places.columns).alias("_place")))
    schema = T.StructType([*places.schema.fields, T.StructField(name, field)])
    names = places.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, carried = None, None
        open_: list[tuple[int, int, int, int]] = []
        for batch in batches:
            column = lambda c: batch.column(batch.schema.get_field_index(c))  # noqa: E731, B023
            known = column("_range") if carried is None else pa.concat_arrays([carried, column("_range")])
            rows, chosen, first = [], [], len(known) - batch.num_rows
            for row, (path, place, turn, end) in enumerate(zip(*(column(c).to_pylist() for c in ("path", "_at", "_turn", "_to")), strict=True)):
                if path != file:
                    file, open_ = path, []
                if turn == begun:
                    heapq.heappush(open_, (end - place, place, end, first + row))
                else:
                    rows.append(row)
                    chosen.append(None if place is None else choose(open_, place))
            if rows:
                yield pa.RecordBatch.from_arrays([*column("_place").take(pa.array(rows)).flatten(), _taken(known, chosen)], names=[*names, name])
            # the ranges that the next batch may lie in
            open_.sort()
            carried = known.take(pa.array([r[3] for r in open_], pa.int64()))
            open_ = [(*r[:3], k) for k, r in enumerate(open_)]

    def _taken(known: pa.Array, chosen: list) -> pa.Array:
        if not isinstance(field, T.ArrayType):
            return known.take(pa.array(chosen, pa.int64()))
        offsets = [0, *itertools.accumulate(len(x or ()) for x in chosen)]
        flat = known.take(pa.array([k for x in chosen for k in x or ()], pa.int64()))
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat.field(0))

    return both.repartition("path").sortWithinPartitions("path", "_at", "_turn", F.desc("_to")).mapInArrow(run, schema)


def _smallest(open_: list[tuple[int, int, int, int]], place: int) -> int | None:
    while open_ and open_[0][2] < place:
        heapq.heappop(open_)
    return open_[0][3] if open_ else None


def with_owner(places: DataFrame, ranges: DataFrame, name: str = "owner", at: str = "line", to: str = "end") -> DataFrame:
    """places (path, at, ...) with the fields of the smallest range (path, at, to, ...) around each as a struct; null outside all.

    A sweep over sorted starts and places: no row carries more than its own owner."""
    fields = [c for c in ranges.columns if c != "path"]
    struct = T.StructType([T.StructField(c, ranges.schema[c].dataType) for c in fields])
    return swept(places, ranges, at, to, name, struct, _smallest)


def calls_in(lines: DataFrame, pattern: str, keywords: tuple[str, ...]) -> DataFrame:
    """path, line, column, nth, callee: names ahead of an opening bracket, without keywords."""
    found = matches(lines.select("path", "line", "bare"), "bare", pattern, "callee", at="column")
    callee = F.regexp_replace("callee", r"\s+", "")
    return found.withColumn("callee", callee).where(~F.regexp_extract("callee", r"^([^.:]*)", 1).isin(*keywords)).select("path", "line", "column", "nth", "callee")


def import_candidates(folder: Column, specifier: Column) -> Column:
    """Files that a relative import in a folder may mean, the likeliest first."""
    base = normalize(F.concat_ws("/", folder, specifier))
    bare = F.regexp_replace(base, r"\.(?:js|jsx|mjs|cjs)$", "")
    tails = ["", ".ts", ".tsx", ".js", ".jsx", "/index.ts", "/index.tsx"]
    return F.array_distinct(F.concat(F.array(*[F.concat(base, F.lit(t)) for t in tails]), F.array(*[F.concat(bare, F.lit(t)) for t in (".ts", ".tsx")])))


def resolve_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """imports (path, specifier, ...) with target: the first candidate that is a file; null for bare specifiers and misses.

    What a specifier means depends on the folder only, so candidates are made once a folder and not once a file."""
    placed = imports.withColumn("_folder", dirname(F.col("path")))
    wanted = placed.where(F.col("specifier").startswith(".")).select("_folder", "specifier").distinct()
    candidates = wanted.select("_folder", "specifier", F.posexplode(import_candidates(F.col("_folder"), F.col("specifier"))).alias("rank", "target"))
    hit = candidates.join(files.select(F.col("path").alias("target")), "target").groupBy("_folder", "specifier").agg(F.min_by("target", "rank").alias("target"))
    return placed.join(hit, ["_folder", "specifier"], "left").select(*imports.columns, "target")
