"""Jaccard self-join of documents on word n-grams, as a blocked sparse matrix product.

The incidence matrix of documents by n-grams (64-bit columns of five words) is dealt out in blocks of
columns, i.e. ranges of the hash. Documents with the same set are one class from the start, named by a
128-bit hash of the set, so copies never meet. The order of the columns is the hash's order, with
frequent columns moved to the end. Two sets of similarity t must share a column among the first
|x| - ceil(t |x|) + 1 of each, so only this prefix enters the product; a column that one class alone
has produces nothing.

Within a column, round 1 multiplies every class with its local leader only (there are about as many as
the square root of the column's height, chosen alike in all columns). Overlap counts accumulate over
the blocks, and of the leaders that the size-derived bound leaves a class is checked with the one it shares most with, so
there are as many checks as classes. The links found are joined to components. Then each class is
checked with the one class of another component that looks nearest by the parities of both sets (see
parity()), so checks stay as many as classes while groups of near copies grow together; classes that parities
let link with no class of another component in a block leave it. What is left, all pairs of a column that are
still in different components and whose sizes and parities allow a link, is never written out as pairs: each block sends
a spanning forest of them, their components are groups of classes that may link, and every group is cut into tiles. The
task of two tiles has their whole sets, takes their sparse product, compares each overlap count with what both sizes ask
for and sends a spanning forest of the links. Nothing else is left out, since a pair in one component needs no link of its own.

Defined results: words are [^\\x20\\x09-\\x0D]+ of the text with A-Z lower-cased; fewer words than n
make one n-gram of all of them; a null, empty or blank text has an empty set, links with nothing and is
its own component; component ids are the least doc_id of the component (nulls are ignored unless all
are null); repeated rows get one result each; extra columns play no part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, free_name, small_batches, text_slices, tidy, words_of
from ..operators.components import components

WORDS, NUMERATOR, DENOMINATOR = 5, 75, 100
#: A column is frequent from this height on, or more where otherwise over MOST_FREQUENT columns (a broadcast of 16 MB) could be.
FREQUENT, MOST_FREQUENT = 64, 2_000_000
#: Columns are counted over a longer prefix than is multiplied: what moves up when frequent columns leave is then known, too.
COUNTED = 1.3
#: Partners of one class that a task checks.
MEMBERS = 1000
#: Up to so many routes of sets (below 50 MB) are broadcast; more are joined by class.
FEW_ROUTES = 400_000
#: Classes and entries that a tile holds about, and pairs that a task looks at in one step.
TILE, TILE_ENTRIES, STEP = 1000, 1_000_000, 500_000
U64 = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class Shingler:
    """Sets of n-gram columns of texts, with a bounded memory of word columns."""

    def __init__(self, n: int = WORDS, memory: int = 150_000):
        self.n, self.memory, self.known = n, memory, {}

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        """The sorted set of each text."""
        if len(self.known) > self.memory:
            self.known = {}
        known, n = self.known, self.n
        words = [words_of(t) for t in texts]
        for ws in words:
            for w in set(ws).difference(known):
                known[w] = xxhash.xxh3_64_intdigest(w)
        length = np.fromiter(map(len, words), np.int64, len(words))
        flat = np.fromiter((known[w] for ws in words for w in ws), U64, int(length.sum()))
        end = np.cumsum(length)
        out = []
        with np.errstate(over="ignore"):
            if len(flat) >= n:
                rolled = np.zeros(len(flat) - n + 1, U64)
                for k in range(n):
                    rolled = _mix(rolled * U64(0x9E3779B97F4A7C15) + flat[k : len(flat) - n + 1 + k])
            for e, m in zip(end.tolist(), length.tolist(), strict=True):
                if m >= n:
                    s = np.sort(rolled[e - m : e - n + 1])
                    out.append(s[np.concatenate(([True], s[1:] != s[:-1]))])
                elif m:
                    x = np.full(1, m, U64)
                    for w in flat[e - m : e]:
                        x = _mix(x * U64(0x9E3779B97F4A7C15) + w)
                    out.append(x)
                else:
                    out.append(np.zeros(0, U64))
        return out


def _name(s: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(s.tobytes())


def enough(size_a, size_b, shared):
    """Whether a pair with so many shared n-grams links: 100 * intersection >= 75 * union."""
    return DENOMINATOR * shared >= NUMERATOR * (size_a + size_b - shared)


def parity(s: np.ndarray) -> bytes:
    """A bitmap with about a bit per n-gram: each n-gram flips the bit that its hash names.

    Bits in which two sets' bitmaps differ are no more than the n-grams that only one of them has, so pairs
    with too many such bits cannot link. Twice as long a bitmap folds to the shorter by exclusive or of its halves."""
    bits = max(64, 1 << max(3 * len(s) // 4, 1).bit_length())
    return np.packbits(np.bincount((s & U64(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1).tobytes()


class Parities:
    """The bitmaps of a block's classes, by length; classes of twice the length are there too, folded."""

    def __init__(self, sizes: np.ndarray, bitmaps: list[bytes]):
        self.sizes = sizes
        self.length = np.fromiter(map(len, bitmaps), np.int64, len(bitmaps))
        self.row, self.rows = {}, {}
        for n in np.unique(self.length).tolist():
            own, twice = np.flatnonzero(self.length == n), np.flatnonzero(self.length == 2 * n)
            short, long = (np.frombuffer(b"".join([bitmaps[i] for i in of]), U64).reshape(len(of), w) for of, w in ((own, n // 8), (twice, n // 4)))
            self.rows[n] = np.concatenate((short, long[:, : n // 8] ^ long[:, n // 8 :]))
            self.row[n] = np.full(len(bitmaps), -1, np.int64)
            self.row[n][np.concatenate((own, twice))] = np.arange(len(own) + len(twice))

    def differ(self, one: np.ndarray, other: np.ndarray) -> np.ndarray:
        """In how many bits the classes of each pair differ; the other is as large as the one or up to twice as large."""
        out = np.zeros(len(one), np.int64)
        for n in np.unique(self.length[one]).tolist():
            at, row, rows = np.flatnonzero(self.length[one] == n), self.row[n], self.rows[n]
            step = max(1, 16_000_000 // n)
            for i in range(0, len(at), step):
                k = at[i : i + step]
                out[k] = np.bitwise_count(rows[row[one[k]]] ^ rows[row[other[k]]]).sum(1, dtype=np.int64)
        return out

    def allowed(self, one: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The pairs that may link, and the share of both sets that differs at least."""
        differ, both = self.differ(one, other), self.sizes[one] + self.sizes[other]
        may = (DENOMINATOR + NUMERATOR) * differ <= (DENOMINATOR - NUMERATOR) * both
        return one[may], other[may], differ[may] / both[may]


def prefix_length(size: int) -> int:
    return size - (NUMERATOR * size + DENOMINATOR - 1) // DENOMINATOR + 1


def memberships(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """doc_id, a hash of the text, n_shingles, and the name and parity of the set's class (null for empty sets)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = Shingler()
        for batch in batches:
            for part, texts in text_slices(batch, "text"):
                found = sets(texts)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array([len(s) for s in found], pa.int64()), *[pa.array([f(s) if len(s) else None for s in found], pa.binary()) for f in (_name, parity)]], ["doc_id", "key", "n_shingles", "class", "parity"])

    return small_batches(docs).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), _text_key(F.col(text)).alias("key")).mapInArrow(tidy(run), "doc_id long, key long, n_shingles long, class binary, parity binary")


def _text_key(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _sets_of(docs: DataFrame, wanted: DataFrame, text: str, doc_id: str) -> DataFrame:
    """(class, rep, set) of the rows that represent the wanted (class, rep), recomputed, and of few other rows.

    A Bloom filter of the wanted rows (at most 32 MB, broadcast) keeps most other rows from being read further;
    what it lets through besides leaves in the join."""
    bits = min(2**28, max(2**16, 1 << (16 * max(wanted.count(), 1)).bit_length()))
    segment = 2**18
    rep = F.coalesce(F.col("rep"), F.lit(-(2**62)))

    def merge(table: pa.Table) -> pa.Table:
        seen = np.zeros(segment, bool)
        for chunk in table.column("at").chunks:
            seen[chunk.to_numpy()] = True
        return pa.table({"s": table.column("s").slice(0, 1), "bits": pa.array([np.packbits(seen).tobytes()], pa.binary())})

    place = F.pmod(F.xxhash64(rep), F.lit(bits))
    merged = wanted.select((place / segment).cast("int").alias("s"), (place % segment).cast("int").alias("at")).distinct().groupBy("s").applyInArrow(merge, "s int, bits binary")
    have = np.zeros(bits // 8, np.uint8)
    for row in merged.toLocalIterator():
        have[row["s"] * segment // 8 : (row["s"] + 1) * segment // 8] = np.frombuffer(row["bits"], np.uint8)[: bits // 8]
    shared = docs.sparkSession.sparkContext.broadcast(have)
    key = F.coalesce(F.col(doc_id), F.lit(-(2**62)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, have = Shingler(), shared.value
        for batch in batches:
            at = batch.column(2).to_numpy()
            batch = batch.filter(pa.array((have[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1))
            for part, texts in text_slices(batch, "text"):
                found = sets(texts)
                full = [i for i, s in enumerate(found) if len(s)]
                if full:
                    yield pa.RecordBatch.from_arrays([pa.array([_name(found[i]) for i in full], pa.binary()), part.column(0).take(pa.array(full)), pa.array([found[i].tobytes() for i in full], pa.binary())], ["class", "rep", "set"])

    return docs.select(F.col(doc_id).alias("rep"), F.col(text).alias("text"), F.pmod(F.xxhash64(key), F.lit(bits)).alias("at")).mapInArrow(tidy(run), "class binary, rep long, set binary")


def _column_ids(s: np.ndarray, blocks: int) -> np.ndarray:
    """The column of each hash: its leading bits, the block's number and 32 more. (Columns only propose pairs, so two columns may share one.)"""
    return s >> U64(32 - (blocks.bit_length() - 1))


def _slices(docs: DataFrame, text: str, emit, schema: str) -> DataFrame:
    """emit(names, sets) on slices of the documents' distinct non-empty sets (copies that a task remembers are left out)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler()
        seen: set[bytes] = set()
        for batch in batches:
            for _, texts in text_slices(batch, "text"):
                if len(seen) > 100_000:
                    seen = set()
                fresh = {}
                for s in shingles(texts):
                    if len(s) and (name := _name(s)) not in seen:
                        seen.add(name)
                        fresh[name] = s
                if fresh:
                    yield emit(list(fresh), list(fresh.values()))

    return small_batches(docs).select(F.col(text).alias("text")).mapInArrow(tidy(run), schema)


def _counted(docs: DataFrame, text: str, blocks: int) -> DataFrame:
    """(block, columns of lengthened prefixes)."""
    def emit(names: list[bytes], sets: list[np.ndarray]) -> pa.RecordBatch:
        ids = np.sort(_column_ids(np.concatenate([s[: int(COUNTED * prefix_length(len(s))) + 8] for s in sets]), blocks))
        block = (ids >> U64(32)).astype(np.int64)
        found, start = np.unique(block, return_index=True)
        parts = [x.astype(np.uint32).tobytes() for x in np.split(ids & U64(0xFFFFFFFF), start[1:])]
        return pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(parts, pa.binary())], ["block", "columns"])

    return _slices(docs, text, emit, "block int, columns binary")


def _postings(docs: DataFrame, text: str, blocks: int, late: np.ndarray) -> DataFrame:
    """Prefixes of the sets, cut by block: (block, classes, sizes, columns, which class each column entry is of)."""
    shared = docs.sparkSession.sparkContext.broadcast(late)

    def emit(names: list[bytes], sets: list[np.ndarray]) -> pa.RecordBatch:
        late = shared.value
        size = np.array([len(s) for s in sets], np.int64)
        ids = _column_ids(np.concatenate(sets), blocks)
        which = np.repeat(np.arange(len(sets)), size)
        start = np.cumsum(size) - size
        if len(late):
            at = np.minimum(np.searchsorted(late, ids), len(late) - 1)
            common = late[at] == ids
            by = np.argsort(which * 2 + common, kind="stable")  # a set's frequent columns go to its end
            ids = ids[by]
        first = np.fromiter(map(prefix_length, size.tolist()), np.int64, len(size))
        keep = np.arange(len(ids)) - start[which] < first[which]
        ids, which = ids[keep], which[keep]
        by = np.argsort(ids, kind="stable")
        ids, which = ids[by], which[by]
        block = (ids >> U64(32)).astype(np.int64)
        name, rows = np.frombuffer(b"".join(names), U64).reshape(-1, 2), []
        found, at = np.unique(block, return_index=True)
        for b, i, j in zip(found, at, np.append(at[1:], len(block)), strict=True):
            local, back = np.unique(which[i:j], return_inverse=True)
            rows.append((int(b), name[local].tobytes(), size[local].astype(np.uint32).tobytes(), (ids[i:j] & U64(0xFFFFFFFF)).astype(np.uint32).tobytes(), back.astype(np.uint32 if len(local) > 65535 else np.uint16).tobytes()))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), *[pa.binary()] * 4), strict=True)], ["block", "classes", "sizes", "columns", "which"])

    return _slices(docs, text, emit, "block int, classes binary, sizes binary, columns binary, which binary")


def _gather(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A block's distinct classes (two numbers each), their sizes, and the entries (column, class) without repeats, by column."""
    classes, sizes, columns, which, at = [], [], [], [], 0
    for row in zip(*[table.column(c).to_pylist() for c in ("classes", "sizes", "columns", "which")], strict=True):
        c = np.frombuffer(row[0], U64).reshape(-1, 2)
        classes.append(c)
        sizes.append(np.frombuffer(row[1], np.uint32))
        columns.append(np.frombuffer(row[2], np.uint32))
        which.append(np.frombuffer(row[3], np.uint32 if len(c) > 65535 else np.uint16).astype(np.int64) + at)
        at += len(c)
    classes, sizes, columns, which = (np.concatenate(x) for x in (classes, sizes, columns, which))
    by = np.lexsort((classes[:, 1], classes[:, 0]))
    new = np.concatenate(([True], (classes[by][1:] != classes[by][:-1]).any(1)))
    label = np.empty(len(by), np.int64)
    label[by] = np.cumsum(new) - 1
    classes, sizes, which = classes[by][new], sizes[by][new].astype(np.int64), label[which]
    by = np.lexsort((which, columns))
    columns, which = columns[by], which[by]
    keep = np.concatenate(([True], (columns[1:] != columns[:-1]) | (which[1:] != which[:-1])))
    return classes, sizes, columns[keep], which[keep]


def _runs(columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    start = np.flatnonzero(np.concatenate(([True], columns[1:] != columns[:-1])))[: len(columns)]
    return start, np.append(start[1:], len(columns))[: len(start)]


def _leaders(which: np.ndarray, classes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of round 1 for one column: each class with the leader of its group, group leaders with the column's.

    A leader has the least name, so neighbouring columns choose alike; groups are leading bits of a second
    hash of the name, about as many as the square root of the column's height."""
    if len(which) == 2:
        return which[:1], which[1:]
    order = np.lexsort((classes[which, 1], classes[which, 0]))
    which = which[order]
    group = classes[which, 1] >> U64(64 - min(20, len(which).bit_length() // 2)) if len(which) > 8 else np.zeros(len(which), U64)
    names, first, back = np.unique(group, return_index=True, return_inverse=True)
    lead = which[first][back]
    a, b = np.concatenate((lead, np.full(len(first), which[0]))), np.concatenate((which, which[first]))
    keep = a != b
    return a[keep], b[keep]


LED = "class binary, leader binary, n long, size long, size_leader long"


def _bounded(led: DataFrame) -> DataFrame:
    """Each class with the leader it shares most columns with, among those that the bound leaves.

    Beyond the columns that both prefixes hold, two sets can share no more than what one of them has outside its
    prefix; with the count that must reach what both sizes ask for. (Two spare: columns that fell together. Twice the
    count, as a pair is counted only where one leads the other.)"""
    summed = led.groupBy("class", "leader").agg(F.sum("n").alias("n"), F.min("size").alias("size"), F.min("size_leader").alias("size_leader"))
    outside = lambda c: F.ceil(F.col(c) * NUMERATOR / DENOMINATOR) - 1  # noqa: E731  a size less prefix_length
    may = summed.where((F.col("n") * 2 + 2 + F.greatest(outside("size"), outside("size_leader"))) * (DENOMINATOR + NUMERATOR) >= NUMERATOR * (F.col("size") + F.col("size_leader")))
    best = may.groupBy("class").agg(F.max(F.struct("n", "leader"))["leader"].alias("leader"))
    return best.select(F.col("leader").alias("a"), F.col("class").alias("b"))


def _first_round(table: pa.Table) -> pa.Table:
    """Each class with its leaders whose size allows a link, and the number of columns they share here."""
    classes, sizes, columns, which, _ = _unpack(table)
    lead, member = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i, j in zip(*_runs(columns), strict=True):
        if j - i > 1:
            a, b = _leaders(which[i:j], classes, sizes)
            lead.append(a)
            member.append(b)
    lead, member = np.concatenate(lead), np.concatenate(member)
    fits = DENOMINATOR * np.minimum(sizes[lead], sizes[member]) >= NUMERATOR * np.maximum(sizes[lead], sizes[member])
    both, count = np.unique(member[fits] * len(classes) + lead[fits], return_counts=True)
    member, lead = both // max(len(classes), 1), both % max(len(classes), 1)
    return pa.table({"class": _names(classes[member]), "leader": _names(classes[lead]), "n": pa.array(count, pa.int64()), "size": pa.array(sizes[member], pa.int64()), "size_leader": pa.array(sizes[lead], pa.int64())})


def _names(classes: np.ndarray) -> pa.Array:
    return pa.array([x.tobytes() for x in classes], pa.binary())


def _shared_columns(table: pa.Table) -> pa.Table:
    """The block's entries in columns that at least two classes have, one row per class."""
    classes, sizes, columns, which = _gather(table)
    start, stop = _runs(columns)
    keep = np.repeat(stop - start > 1, stop - start)
    columns, which = columns[keep], which[keep]
    by = np.argsort(which, kind="stable")
    columns, which = columns[by], which[by]
    at, end = _runs(which)
    used = which[at]
    return pa.table({"block": pa.array([table.column("block")[0].as_py()] * len(used), pa.int32()), "class": pa.array([classes[k].tobytes() for k in used], pa.binary()), "size": pa.array(sizes[used], pa.int64()), "columns": pa.array([columns[i:j].tobytes() for i, j in zip(at, end, strict=True)], pa.binary())})


def _unpack(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.Table]:
    """A block of _shared_columns: classes sorted by name, sizes, entries by column; and the sorted table."""
    classes = np.frombuffer(b"".join(table.column("class").to_pylist()), U64).reshape(-1, 2)
    order = np.lexsort((classes[:, 1], classes[:, 0]))
    table, classes = table.take(pa.array(order)), classes[order]
    lists = [np.frombuffer(x, np.uint32) for x in table.column("columns").to_pylist()]
    columns, which = np.concatenate(lists), np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    by = np.lexsort((which, columns))
    return classes, table.column("size").to_numpy(), columns[by], which[by], table


def _by_component(table: pa.Table) -> np.ndarray:
    code: dict[bytes, int] = {}
    return np.array([code.setdefault(x, len(code)) for x in table.column("component").to_pylist()], np.int64)


def _column_clusters(columns: np.ndarray, which: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Sets of classes such that the classes of each column with more than one component are in one: pairs (two rows), and larger ones.

    Columns of a group of near copies have mostly the same classes; a column joins a cluster that has half of its classes, as long as
    the cluster stays within twice its highest column, so that a pair is looked at about once and not once per column."""
    start, stop = _runs(columns)
    low = np.minimum.reduceat(part[which], start) if len(start) else start
    high = np.maximum.reduceat(part[which], start) if len(start) else start
    crossing = np.flatnonzero(low != high)
    height = (stop - start)[crossing]
    two = start[crossing[height == 2]]
    pairs = np.unique(np.stack((which[two], which[two + 1])), axis=1) if len(two) else np.zeros((2, 0), np.int64)
    seen, clusters, tops = set(), [], []
    home = np.full(len(part), -1, np.int64)
    for k in crossing[height > 2][np.argsort(-height[height > 2], kind="stable")].tolist():
        w = which[start[k] : stop[k]]
        key = w.astype(np.int32).tobytes()
        if key in seen:
            continue
        seen.add(key)
        at = home[w]
        found, count = np.unique(at[at >= 0], return_counts=True)
        if len(found) and 2 * count.max() >= len(w):
            c = int(found[np.argmax(count)])
            more = np.union1d(clusters[c], w)
            if len(more) <= 2 * tops[c]:
                clusters[c] = more
                home[w] = c
                continue
        home[w] = len(clusters)
        clusters.append(w)
        tops.append(len(w))
    return pairs, clusters


def _crossing_pairs(table: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Some of the block's product at a time: pairs in different components that may link, and how far they are."""
    _, sizes, columns, which, table = _unpack(table)
    part, parities = _by_component(table), Parities(sizes, table.column("parity").to_pylist())

    def kept(one: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        apart = part[one] != part[other]
        return parities.allowed(one[apart], other[apart])

    pairs, clusters = _column_clusters(columns, which, part)
    for at in range(0, pairs.shape[1], STEP):
        x, y = pairs[:, at : at + STEP]
        one, other = np.where(sizes[x] <= sizes[y], x, y), np.where(sizes[x] <= sizes[y], y, x)
        fits = DENOMINATOR * sizes[one] >= NUMERATOR * sizes[other]
        yield kept(one[fits], other[fits])
    for w in clusters:
        w = w[np.argsort(sizes[w], kind="stable")]
        many = np.searchsorted(sizes[w], DENOMINATOR * sizes[w] / NUMERATOR, "right") - np.arange(len(w)) - 1  # partners are a range of sizes
        total = np.cumsum(many)
        at = 0
        while at < len(w):
            to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + STEP, "right")))
            n = many[at:to]
            first = np.repeat(np.arange(at, to) + 1 - (np.cumsum(n) - n), n)
            yield kept(np.repeat(w[at:to], n), w[first + np.arange(len(first))])
            at = to


def _nearest(table: pa.Table) -> pa.Table:
    """The block's classes that may link with one of another component, each with the nearest."""
    classes, *_, table_ = _unpack(table)
    best, least = np.full(len(classes), -1, np.int64), np.full(len(classes), np.inf)
    for one, other, far in _crossing_pairs(table):
        x, y, far = np.concatenate((one, other)), np.concatenate((other, one)), np.concatenate((far, far))
        by = np.lexsort((y, far, x))
        x, y, far = x[by], y[by], far[by]
        new = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1])))[: len(x)]
        x, y, far = x[new], y[new], far[new]
        nearer = far < least[x]
        best[x[nearer]], least[x[nearer]] = y[nearer], far[nearer]
    have = np.flatnonzero(best >= 0)
    kept = table_.take(pa.array(have))
    return pa.table({**{c: kept.column(c) for c in ("block", "class", "size", "columns", "parity")}, "a": _names(classes[best[have]]), "far": pa.array(least[have], pa.float64())})


class Forest:
    """Numbered things that are joined, and the joins that were of use."""

    def __init__(self, n: int):
        self.up, self.joins = list(range(n)), []

    def root(self, x: int) -> int:
        while (p := self.up[x]) != x:
            self.up[x] = x = self.up[p]
        return x

    def join(self, a: np.ndarray, b: np.ndarray, x: np.ndarray | None = None, y: np.ndarray | None = None) -> None:
        """Join things a with b; x and y are what joins() lists for them."""
        x, y = a if x is None else x, b if y is None else y
        _, first = np.unique(a * len(self.up) + b, return_index=True)
        for i in first.tolist():
            p, q = self.root(int(a[i])), self.root(int(b[i]))
            if p != q:
                self.up[max(p, q)] = min(p, q)
                self.joins.append((int(x[i]), int(y[i])))


def _may_link(table: pa.Table) -> pa.Table:
    """A spanning forest of the block's pairs that are in different components and may link."""
    classes = _unpack(table)[0]
    forest = Forest(len(classes))
    for one, other, _ in _crossing_pairs(table):
        forest.join(one, other)
    a, b = np.array(forest.joins, np.int64).reshape(-1, 2).T
    return pa.table({"a": _names(classes[a]), "b": _names(classes[b])})


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """The product of the sets' incidence matrix with itself: how many n-grams each pair shares."""
    n = len(sets)
    out = np.zeros(n * n, np.float64)
    columns, which = np.concatenate(sets), np.repeat(np.arange(n), [len(s) for s in sets])
    by = np.argsort(columns, kind="stable")
    columns, which = columns[by], which[by]
    start, stop = _runs(columns)
    height = stop - start
    start, height = start[height > 1], height[height > 1]
    if len(start):
        # columns of the same sets are multiplied once, by the sum of a random number per set
        with np.errstate(over="ignore"):
            mark = np.add.reduceat(np.concatenate((_mix(which.astype(U64) + U64(n)), [U64(0)])), np.stack((start, start + height), 1).ravel())[::2]
        _, first, weight = np.unique(mark, return_index=True, return_counts=True)
        start, height = start[first], height[first]
        high = max(32, n // 10)
        for h in np.unique(height[height <= high]).tolist():
            at, w = start[height == h], weight[height == h]
            step = max(1, 4_000_000 // (h * h))
            for i in range(0, len(at), step):
                rows = which[at[i : i + step, None] + np.arange(h)]
                out += np.bincount((rows[:, :, None] * n + rows[:, None, :]).ravel(), np.repeat(w[i : i + step], h * h), n * n)
        out = out.reshape(n, n)
        tall = np.flatnonzero(height > high)
        for i in range(0, len(tall), 2048):
            k = tall[i : i + 2048]
            rows, m = np.repeat(np.arange(len(k)), height[k]), np.zeros((len(k), n), np.float32)
            at = np.repeat(start[k] - (np.cumsum(height[k]) - height[k]), height[k]) + np.arange(len(rows))
            m[rows, which[at]] = 1
            out += (m * weight[k, None]).astype(np.float32).T @ m
    return out.reshape(n, n)


def _tile_links(table: pa.Table) -> pa.Table:
    """A spanning forest of the links between components among the whole sets of two tiles."""
    names, parts = table.column("class").to_pylist(), _by_component(table)
    sets = [np.frombuffer(x.as_buffer(), U64) for chunk in table.column("set").chunks for x in chunk]
    size = np.array([len(s) for s in sets], np.int64)
    shared = overlaps(sets).astype(np.int64)
    a, b = np.nonzero(np.triu(enough(size[:, None], size[None, :], shared) & (parts[:, None] != parts[None, :]), 1))
    forest = Forest(len(names))
    forest.join(parts[a], parts[b], a, b)
    return pa.table({"a": pa.array([names[i] for i, _ in forest.joins], pa.binary()), "b": pa.array([names[j] for _, j in forest.joins], pa.binary())})


def _check(table: pa.Table) -> pa.Table:
    """The members of one leader that link with it, by exact counts on both whole sets."""
    key = table.column("key")[0].as_py()
    names = table.column("class").to_pylist()
    sets = [np.frombuffer(x.as_buffer(), U64) for chunk in table.column("set").chunks for x in chunk]
    lead = sets[names.index(key)] if key in names else np.zeros(0, U64)
    linked = set()
    for name, s in zip(names, sets, strict=True):
        if name != key and len(lead):
            x, y = (s, lead) if len(s) < len(lead) else (lead, s)
            at = np.minimum(np.searchsorted(y, x), len(y) - 1)
            if enough(len(x), len(y), int((y[at] == x).sum())):
                linked.add(name)
    return pa.table({"a": pa.array([key] * len(linked), pa.binary()), "b": pa.array(sorted(linked), pa.binary())})


def _linked(docs: DataFrame, pairs: DataFrame, reps: DataFrame, text: str, doc_id: str) -> DataFrame:
    """The pairs (a, b) that link. Sets travel to a's task; an a with many partners has several, each with a share of them."""
    pairs = cut(pairs)
    many = pairs.groupBy("a").agg(F.ceil(F.count("*") / MEMBERS).alias("parts"))
    dealt = cut(pairs.join(many, "a").select("a", "b", F.pmod(F.xxhash64("b"), "parts").alias("part")))
    route = dealt.select(F.col("b").alias("class"), F.col("a").alias("key"), "part").unionByName(dealt.select(F.col("a").alias("class"), F.col("a").alias("key"), "part").distinct())
    route = cut(route.join(reps.select("class", F.col("rep").alias("of")), "class"))
    if route.count() <= FEW_ROUTES:
        route = F.broadcast(route)
    sets = _sets_of(docs, route.select("class", F.col("of").alias("rep")).distinct(), text, doc_id)
    sent = sets.join(route, "class").where(F.col("rep").eqNullSafe(F.col("of"))).select("key", "part", "class", "set")
    return cut(sent.groupBy("key", "part").applyInArrow(_check, "a binary, b binary"))


def _linked_in_tiles(docs: DataFrame, placed: DataFrame, reps: DataFrame, text: str, doc_id: str) -> DataFrame:
    """Links (a, b) that join all components between which placed's blocks have pairs that link."""
    edges = cut(placed.groupBy("block").applyInArrow(_may_link, "a binary, b binary"))
    if edges.isEmpty():
        return edges
    groups = components(edges).select(F.col("node").alias("class"), F.col("component").alias("group"))
    inside = cut(groups.join(placed.groupBy("class").agg(F.min("component").alias("component"), F.min("size").alias("size")), "class").join(reps.select("class", F.col("rep").alias("of")), "class"))
    parts = inside.groupBy("group").agg(F.ceil(F.greatest(F.count("*") / TILE, F.sum("size") / TILE_ENTRIES)).cast("int").alias("parts"))
    tile = F.pmod(F.xxhash64("class"), F.col("parts")).cast("int")
    dealt = inside.join(parts, "group").select("class", "of", "component", "group", tile.alias("tile"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    route = cut(dealt.select("class", "of", "component", "group", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j")))
    if route.count() <= FEW_ROUTES:
        route = F.broadcast(route)
    sets = _sets_of(docs, inside.select("class", F.col("of").alias("rep")), text, doc_id)
    sent = sets.join(route, "class").where(F.col("rep").eqNullSafe(F.col("of"))).select("group", "i", "j", "class", "component", "set")
    # a rep that repeats in docs sends its set once
    return cut(sent.dropDuplicates(["group", "i", "j", "class"]).groupBy("group", "i", "j").applyInArrow(_tile_links, "a binary, b binary"))


def _grouped(docs: DataFrame, text: str, doc_id: str) -> tuple[DataFrame, DataFrame]:
    """The memberships, and (class, component_id, first): first is the least (doc_id is null, doc_id, hash of the text) of the component."""
    spark = docs.sparkSession
    members = cut(memberships(docs, text, doc_id))
    reps = cut(members.where("class is not null").groupBy("class").agg(F.min("doc_id").alias("rep"), F.min("parity").alias("parity"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("first")))
    entries = members.agg(F.coalesce(F.sum("n_shingles"), F.lit(0))).first()[0]
    # about a block per shuffle partition, or more where the columns are many
    blocks = 1 << max(int(spark.conf.get("spark.sql.shuffle.partitions")) - 1, entries // 4_000_000, 1).bit_length()
    frequent = max(FREQUENT, math.ceil(COUNTED * entries / 4 / MOST_FREQUENT))

    def heavy(table: pa.Table) -> pa.Table:
        columns = np.sort(np.concatenate([np.frombuffer(x, np.uint32) for x in table.column("columns").to_pylist()]))
        start, stop = _runs(columns)
        block = table.column("block")[0].as_py()
        return pa.table({"column": pa.array((block << 32) + columns[start[stop - start >= frequent]].astype(np.int64), pa.int64())})

    counted = _counted(docs, text, blocks).groupBy("block").applyInArrow(heavy, "column long")
    late = np.sort(np.fromiter((r[0] for r in counted.toLocalIterator()), np.int64)).astype(U64)
    shared = cut(_postings(docs, text, blocks, late).groupBy("block").applyInArrow(_shared_columns, "block int, class binary, size long, columns binary"))
    # what round 1 misses is left to the later ones
    links = _linked(docs, _bounded(shared.groupBy("block").applyInArrow(_first_round, LED)), reps, text, doc_id)
    joined = components(links)
    part_of = lambda df: df.join(joined.withColumnRenamed("node", "class"), "class", "left").withColumn("component", F.coalesce("component", "class"))
    placed = shared.join(part_of(reps.select("class", "parity")), "class")
    near = cut(placed.groupBy("block").applyInArrow(_nearest, "block int, class binary, size long, columns binary, parity binary, a binary, far double"))
    best = near.groupBy(F.col("class").alias("b")).agg(F.min(F.struct("far", "a"))["a"].alias("a"))
    more = _linked(docs, best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), reps, text, doc_id)
    if not more.isEmpty():
        links = links.unionByName(more)
        joined = components(links)
    more = _linked_in_tiles(docs, cut(part_of(near.drop("a", "far"))), reps, text, doc_id)
    if not more.isEmpty():
        joined = components(links.unionByName(more))
    named = reps.join(joined.withColumnRenamed("node", "class"), "class", "left").select("class", "rep", "first", F.coalesce("component", "class").alias("component"))
    least = named.groupBy("component").agg(F.min("rep").alias("component_id"), F.min("first").alias("first"))
    return members, named.select("class", "component").join(least, "component").select("class", "component_id", "first")


def classes_of(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id."""
    members, result = _grouped(docs, text, doc_id)
    full = members.where("class is not null").join(result, "class").select("doc_id", "n_shingles", "component_id")
    empty = members.where("class is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return full.unionByName(empty)


def keep_rows(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """docs with one row of each component: the one with the least doc_id (null ids last), and of several texts with that id the one
    with the least hash. Rows that repeat both stay as one; documents without words all stay. All columns come back as they were."""
    members, result = _grouped(docs, text, doc_id)
    placed = members.where("class is not null").join(result.select("class", "first"), "class")
    key, gone = free_name(docs, "text_key"), free_name(docs, "gone_id")
    drop = placed.where(~(F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("key") == F.col("first.key")))).select(F.col("doc_id").alias(gone), F.col("key").alias("gone_key")).distinct()
    keyed = docs.withColumn(key, _text_key(F.col(text)))
    same = lambda other: F.col(doc_id).eqNullSafe(other[gone]) & (F.col(key) == other["gone_key"])
    kept = keyed.join(drop, same(drop), "left_anti")
    twice = cut(placed.groupBy(F.col("doc_id").alias(gone), F.col("key").alias("gone_key")).agg(F.count("*").alias("n")).where("n > 1").join(drop, [gone, "gone_key"], "left_anti").select(gone, "gone_key"))
    if not twice.isEmpty():
        kept = kept.join(twice, same(twice), "left_anti").unionByName(keyed.join(twice, same(twice), "left_semi").dropDuplicates([doc_id, key]))
    return kept.drop(key)
