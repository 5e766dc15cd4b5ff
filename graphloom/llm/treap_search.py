"""Ranked lexical search over inverted treaps.

Documents are indexed in shards of about SHARD_DOCS documents. In a shard every term has a treap over its
postings: in search order by document, in heap order by impact, so that a subtree's root has the greatest
impact of its span of documents. All treaps of a shard are built at once, each node's parent being the
lesser of its nearest greater neighbours. A query goes down the treaps of its terms together: for a span of
documents the sum of the terms' subtree roots bounds every score in it. Spans that cannot enter the query's
top k go; otherwise the document of the heaviest root is scored, and the spans on its either side are next.
A task carries each query's k best from shard to shard, so the bound tightens. All of this is done for many
(query, span) pairs at a time in numpy, taken from a stack in pieces of bounded size.

Queries come in blocks of at most BLOCK_TERMS terms (one longer query is a block of its own); of a block the
terms go to the executors, the documents' postings of these terms are written once, and corpus statistics
are counted over all documents. Only k rows per query and task are shuffled.

Scores are the integers of a saturated tf-idf: weight w = floor(1000 ln((2N+2)/(2df+1))), length norm
m = 75 + (25 n N) div L, and the sum over the query's terms, repeats included, of
w * ((10**9 tf) div (1000 tf + 12 m)).

Defined results: null and empty texts have no term, and as documents count for nothing, as queries find
nothing; only scores above 0 are returned; equal scores go by ascending doc_id (null first); repeated document
rows are documents of their own, repeated query rows queries of their own; extra columns play no part; empty
tables give no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut

TOP = 20
#: Documents of a shard, terms of a block of queries, and cells (spans times terms) that a step handles.
SHARD_DOCS, BLOCK_TERMS, CELLS = 2048, 1_000_000, 1_000_000
#: Bytes to terms: digits, lower-case letters and all of non-ASCII stay, A-Z become lower case, the rest separates.
_TERMS = bytes(c if c >= 128 or chr(c) in "0123456789abcdefghijklmnopqrstuvwxyz" else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
#: Cells of a shard's table of impacts (4 bytes each); beyond, impacts are looked up.
DENSE = 8_000_000
#: Text that is tokenised at a time, in bytes.
SLICE = 4_000_000


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_TERMS).split()


def _postings(docs: DataFrame, vocabulary: dict[bytes, int], doc_id: str, text: str) -> DataFrame:
    """Of each document with a term: doc_id, n (its terms with repeats), and ids and tfs of its terms of the vocabulary."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get, size = vocabulary.get, len(vocabulary)
        for batch in batches:
            start = 0
            texts = batch.column(1)
            while start < batch.num_rows:
                row, at, n, code, held = start, [], [], [], 0
                while row < batch.num_rows and held < SLICE:
                    words = terms_of(texts[row].as_py() or b"")
                    held += 8 * len(words) + 8
                    if words:
                        found = np.array([x for x in map(get, words) if x is not None], np.int64)
                        code.append(found + len(at) * size)
                        at.append(row)
                        n.append(len(words))
                    row += 1
                start = row
                if at:
                    pairs, tf = np.unique(np.concatenate(code), return_counts=True)
                    off = np.searchsorted(pairs, np.arange(len(at) + 1) * size).astype(np.int32)
                    lists = [pa.ListArray.from_arrays(pa.array(off), pa.array(x.astype(np.int32))) for x in (pairs % max(size, 1), tf)]
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(n, pa.int64()), *lists], ["doc_id", "n", "ids", "tfs"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text")).mapInArrow(run, "doc_id long, n long, ids array<int>, tfs array<int>")


class Treaps:
    """The treaps of a shard: root per term, and per node its document (by rank of doc_id), impact, left and right child."""

    def __init__(self, term: np.ndarray, doc: np.ndarray, impact: np.ndarray, n_terms: int, n_docs: int):
        """Postings sorted by term, then by document."""
        n = len(term)
        here = np.arange(n)
        first = np.searchsorted(term, np.arange(n_terms))
        # nearest neighbours of greater priority within the term (of equal impacts the earlier counts as greater), by jumping
        # over what is already known to be less; -1 and n: none
        before = np.where(here > first[term], here - 1, -1) if n else here
        after = np.where((here + 1 < n) & (np.append(term[1:], -1) == term), here + 1, n)
        for near, less, none in ((before, np.less, -1), (after, np.less_equal, n)):
            open_ = here[near != none]
            while len(open_):
                open_ = open_[less(impact[near[open_]], impact[open_])]
                near[open_] = near[near[open_]]
                open_ = open_[near[open_] != none]
        up, down = before >= 0, after < n
        low = np.where(up, impact[before], 0) if n else here
        high = np.where(down, impact[np.minimum(after, n - 1)], 0) if n else here
        parent = np.where(up & down, np.where(low < high, before, after), np.where(up, before, np.where(down, after, -1)))
        self.left, self.right = np.full(n + 1, n), np.full(n + 1, n)  # node n stands for none
        child = parent >= 0
        right = child & (parent < here)
        self.right[parent[right]] = here[right]
        self.left[parent[child & ~right]] = here[child & ~right]
        self.root = np.full(n_terms + 1, n)
        self.root[term[~child]] = here[~child]
        self.doc, self.impact = np.append(doc, -1), np.append(impact, 0)
        # to score one document: a small shard's impacts as a table by term and document, else looked up by (term, document)
        self.n_docs, self.keys, self.dense = n_docs, term * n_docs + doc, None
        if (n_terms + 1) * n_docs <= DENSE:
            self.dense = np.zeros((n_terms + 1, n_docs), np.int32)
            self.dense[term, doc] = impact

    def of(self, term: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Impacts of terms in documents, 0 where a term does not occur."""
        if self.dense is not None:
            return self.dense[term, doc]
        key = term * self.n_docs + doc
        at = np.searchsorted(self.keys, key)
        return np.where(np.append(self.keys, -1)[at] == key, self.impact[at], 0)


def _narrow(t: Treaps, node: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Each treap's heaviest node with a document in lo <= doc < hi."""
    node = node.copy()
    none = len(t.doc) - 1
    flat = node.reshape(-1)
    lo, hi = (np.broadcast_to(x[:, None], node.shape).reshape(-1) for x in (lo, hi))
    open_ = np.flatnonzero(flat != none)
    while len(open_):
        doc = t.doc[flat[open_]]
        less, more = doc < lo[open_], doc >= hi[open_]
        out = less | more
        open_ = open_[out]
        flat[open_] = np.where(less[out], t.right[flat[open_]], t.left[flat[open_]])
        open_ = open_[flat[open_] != none]
    return node


class Best:
    """The k best (score, doc_id) of each query so far."""

    def __init__(self, queries: int, k: int):
        self.score, self.doc, self.k = np.zeros((queries, k), np.int64), np.full((queries, k), np.iinfo(np.int64).max), k

    def add(self, query: np.ndarray, score: np.ndarray, doc: np.ndarray) -> None:
        fits = (score > self.score[query, -1]) | ((score == self.score[query, -1]) & (doc < self.doc[query, -1]))
        fits &= score > 0
        query, score, doc = query[fits], score[fits], doc[fits]
        if not len(query):
            return
        some = np.unique(query)
        q = np.concatenate((query, np.repeat(some, self.k)))
        s, d = np.concatenate((score, self.score[some].ravel())), np.concatenate((doc, self.doc[some].ravel()))
        order = np.lexsort((d, -s, q))
        q, s, d = q[order], s[order], d[order]
        keep = np.arange(len(q)) - np.searchsorted(q, q) < self.k
        self.score[some], self.doc[some] = s[keep].reshape(-1, self.k), d[keep].reshape(-1, self.k)


def search(t: Treaps, ids: np.ndarray, terms: np.ndarray, weights: np.ndarray, best: Best, cells: int = CELLS) -> int:
    """Add the shard's documents (rank -> ids) to each query's best; terms and weights: a row per query, padded with weight 0. Returns the documents scored."""
    n_docs, width = len(ids), max(1, terms.shape[1])
    piece, scored = max(1, cells // width), 0
    stack = [(np.arange(i, min(i + piece, len(terms))), None, None, None) for i in range(0, len(terms), piece)]
    while stack:
        query, lo, hi, node = stack.pop()
        if lo is None:
            lo, hi, node = np.zeros(len(query), np.int64), np.full(len(query), n_docs), t.root[terms[query]]
        gain = weights[query] * t.impact[node]
        bound = gain.sum(1)
        worst, last = best.score[query, -1], best.doc[query, -1]
        alive = (lo < hi) & (bound > 0) & ((bound > worst) | ((bound == worst) & (ids[np.minimum(lo, n_docs - 1)] < last)))
        if not alive.any():
            continue
        query, lo, hi, node, gain, bound = query[alive], lo[alive], hi[alive], node[alive], gain[alive], bound[alive]
        pivot = t.doc[node[np.arange(len(node)), gain.argmax(1)]]
        scored += len(pivot)
        best.add(query, (weights[query] * t.of(terms[query], pivot[:, None])).sum(1), ids[pivot])
        # the spans on either side; the greatest bounds come off the stack first
        order = np.argsort(bound, kind="stable")
        query, lo, hi, node, pivot = (np.concatenate((x[order], y[order])) for x, y in ((query, query), (lo, pivot + 1), (pivot, hi), (node, node), (pivot, pivot)))
        fine = lo < hi
        query, lo, hi, node = query[fine], lo[fine], hi[fine], node[fine]
        node = _narrow(t, node, lo, hi)
        stack += [(query[i : i + piece], lo[i : i + piece], hi[i : i + piece], node[i : i + piece]) for i in range(0, len(query), piece)]
    return scored


def _widths(queries: list[Counter]) -> list[tuple[np.ndarray, int]]:
    """Queries of about the same number of terms go together: (their numbers, the greatest number of terms)."""
    by: dict[int, list[int]] = {}
    for i, q in enumerate(queries):
        if q:
            by.setdefault(len(q).bit_length(), []).append(i)
    return [(np.array(v), max(len(queries[i]) for i in v)) for v in by.values()]


def _ranked(postings: DataFrame, queries: list[Counter], weight: np.ndarray, total: int, length: int, k: int) -> DataFrame:
    """Each task's k best documents per query: query, doc_id, score."""
    groups = []
    for numbers, width in _widths(queries):
        terms, weights = np.full((len(numbers), width), len(weight)), np.zeros((len(numbers), width), np.int64)
        for row, q in enumerate(numbers):
            for col, (term, times) in enumerate(queries[q].items()):
                terms[row, col], weights[row, col] = term, times * weight[term]
        groups.append((numbers, terms, weights))
    n_terms = len(weight)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(len(numbers), k) for numbers, _, _ in groups]
        none = np.iinfo(np.int64).min  # a null doc_id comes first

        def shard(parts: list[pa.RecordBatch]) -> None:
            table = pa.Table.from_batches(parts).combine_chunks()
            table = table.take(np.argsort(table.column("doc_id").fill_null(none).to_numpy(), kind="stable"))
            ids, n = table.column("doc_id").fill_null(none).to_numpy(), table.column("n").to_numpy()
            lists = [table.column(c).combine_chunks() for c in ("ids", "tfs")]
            off = lists[0].offsets.to_numpy()
            term, tf = (x.values.to_numpy()[off[0] : off[-1]].astype(np.int64) for x in lists)
            doc = np.repeat(np.arange(len(ids)), np.diff(off))
            m = 75 + (25 * n * total) // length
            impact = (10**9 * tf) // (1000 * tf + 12 * m[doc])
            order = np.argsort(term, kind="stable")
            present, local = np.unique(term[order], return_inverse=True)
            t = Treaps(local, doc[order], impact[order], len(present), len(ids))
            place = np.full(n_terms + 1, len(present))
            place[present] = np.arange(len(present))
            for (_, terms, weights), b in zip(groups, best, strict=True):
                search(t, ids, place[terms], weights, b)

        held: list[pa.RecordBatch] = []
        for batch in batches:
            for part in (batch.slice(i, SHARD_DOCS) for i in range(0, batch.num_rows, SHARD_DOCS)):
                if held and sum(x.num_rows for x in held) + part.num_rows > SHARD_DOCS:
                    shard(held)
                    held = []
                held.append(part)
        if held:
            shard(held)
        for (numbers, _, _), b in zip(groups, best, strict=True):
            found = b.score > 0
            row = np.nonzero(found)[0]
            ids = b.doc[found]
            yield pa.RecordBatch.from_arrays([pa.array(numbers[row]), pa.array(ids, mask=ids == none), pa.array(b.score[found])], ["query", "doc_id", "score"])

    return postings.mapInArrow(run, "query long, doc_id long, score long")


def _blocks(queries: DataFrame, item_id: str, text: str) -> Iterator[list[tuple[object, list[bytes]]]]:
    """Queries in blocks that hold at most BLOCK_TERMS terms, or one query; the driver holds one block."""
    block, held = [], 0
    for r in queries.select(F.col(item_id), F.col(text).cast("binary")).toLocalIterator():
        terms = terms_of(bytes(r[1] or b""))
        if block and held + len(terms) > BLOCK_TERMS:
            yield block
            block, held = [], 0
        block.append((r[0], terms))
        held += len(terms)
    if block:
        yield block


def rank(docs: DataFrame, queries: DataFrame, k: int = TOP, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The k best documents of each query: item_id, rank, doc_id, score."""
    spark: SparkSession = docs.sparkSession
    kind = queries.schema[item_id].dataType.simpleString()
    out = spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    for block in _blocks(queries, item_id, item_text):
        vocabulary: dict[bytes, int] = {}
        counted = [Counter(vocabulary.setdefault(t, len(vocabulary)) for t in terms) for _, terms in block]
        postings = cut(_postings(docs, vocabulary, doc_id, text))
        total, length = postings.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        if not total or not vocabulary:
            continue
        df = np.zeros(len(vocabulary), np.int64)
        for term, n in postings.select(F.explode("ids").alias("term")).groupBy("term").agg(F.count("*").alias("n")).collect():  # a row per term of the block
            df[term] = n
        weight = np.array([math.floor(1000 * math.log((2 * total + 2) / (2 * n + 1))) for n in df.tolist()], np.int64)
        found = _ranked(postings, counted, weight, total, length, k)
        best = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
        top = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        names = spark.createDataFrame([(i, item) for i, (item, _) in enumerate(block)], f"query long, item_id {kind}")
        out = out.unionByName(cut(top.join(F.broadcast(names), "query").select("item_id", "rank", "doc_id", "score")))
    return out
