"""Log-likelihood of documents under a gated recurrent language model.

A gated recurrent unit in numpy, trained by truncated backpropagation, reads words; its output is
factored into a class of words and a word within the class. Documents stream through lanes, and the
hidden state is carried across windows until a document ends, so whole documents are scored.

The VOCABULARY commonest words (by counts over all training documents) have outputs of their own, and so has
any further word that occurs at least N^(2/3) / OWN_OUTPUT times among N training words: the vocabulary grows
with about the cube root of the text. All other words fall into OTHER_CLASSES classes by a hash of their last two characters, so the network tells
endings (and with them languages) apart; within such a class a word's probability is its smoothed share
of the class's training tokens, (c + 1) / (N' + V' + 1), with one more share for all unknown words.
Counts, statistics and the recurrent weights come from every word of every training document. The documents
are dealt into ROUNDS shares by a hash. In a round each task trains on its part of the share, starting from the
same weights, and the next round starts from the tasks' weights averaged by the words they read; only averages
reach the driver. State and gradient start anew after SPAN words of a document. Every text is read EPOCHS times, however
many words there are in all.

Counts of the COMMON commonest words are broadcast (a bounded table); the rest of each document's words
meet their counts in a join by word.

Defined results: null or empty text is the end token alone; without training documents the model is
uniform over the unknown word and the end; repeated rows score alike; extra columns play no part.
"""

from __future__ import annotations

import copy
import heapq
import math
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, cut, text_slices, words_of

VOCABULARY, CLASSES, COMMON, OTHER_CLASSES = 4000, 64, 60_000, 64
#: WINDOW: words after which the outputs of carried states are computed together.
HIDDEN, WINDOW, LANES = 32, 12_288, 256
#: A word outside the VOCABULARY commonest gets its own output from N^(2/3) / OWN_OUTPUT occurrences in N words on.
OWN_OUTPUT = 600
SPAN, EPOCHS, TRAIN_LANES, TRAIN_WINDOW, RATE = 400, 1, 128, 24, 0.01
#: Averagings over the text, words that a training task has at least, words that lanes hold at a time, weights in a row.
ROUNDS, TASK_WORDS, TRAIN_WORDS, PIECE = 4, 1_000_000, 200_000, 1 << 14
#: Rows whose classes are computed at a time (they stay in a core's cache).
BLOCK = 1024
END = b""


def other_class(word: bytes) -> int:
    """The class of a word outside the vocabulary; ending_class() is the same for a column."""
    return zlib.crc32(word.decode()[-2:].encode()) % OTHER_CLASSES


def ending_class(word: Column) -> Column:
    return (F.crc32(F.right(word, F.lit(2)).cast("binary")) % OTHER_CLASSES).cast("int")


class Model:
    """ids: 0.. the classes of other words, then the vocabulary by falling count (the end token among them)."""

    def __init__(self, vocabulary: list[tuple[bytes, int]], others: list[int], hidden: int = HIDDEN, seed: int = 5):
        k = len(others)
        self.ids = {w: i + k for i, (w, _) in enumerate(vocabulary)}
        count = np.array([*(max(o, 1) for o in others), *(c for _, c in vocabulary)], float)
        n = len(count)
        # each class of other words is a class by itself; the vocabulary is cut by rank into classes of like total root count
        mass = np.cumsum(np.sqrt(count[k:]))
        self.cls = np.arange(n)
        if n > k:
            classes = max(CLASSES, math.isqrt(n - k))
            self.cls[k:] = k + np.minimum((mass / mass[-1] * (classes - 1)).astype(np.int64), classes - 2)
            used = np.unique(self.cls)
            self.cls = np.searchsorted(used, self.cls)
        self.cls = self.cls.astype(np.min_scalar_type(-n))  # short numbers are sorted faster
        self.start = np.searchsorted(self.cls, np.arange(self.cls.max() + 2))
        k = len(self.start) - 1
        r = np.random.default_rng(seed)
        draw = lambda *s, by: (r.standard_normal(s) * by).astype(np.float32)
        share = np.array([count[a:b].sum() for a, b in zip(self.start, self.start[1:], strict=False)])
        within = count / share[self.cls]
        self.p = {"X": draw(n, 3 * hidden, by=0.3), "U": draw(hidden, 3 * hidden, by=1 / math.sqrt(hidden)), "b": np.zeros(3 * hidden, np.float32), "C": np.zeros((hidden, k), np.float32), "c": np.log(share / share.sum()).astype(np.float32), "W": np.zeros((n, hidden), np.float32), "w": np.log(within).astype(np.float32)}
        self.hidden = hidden

    def id_of(self, word: bytes) -> int:
        i = self.ids.get(word)
        return other_class(word) if i is None else i

    def joined(self) -> tuple[np.ndarray, np.ndarray]:
        """Weights of the outputs with their constants as one more input: (hidden + 1, classes) and (words, hidden + 1)."""
        return np.vstack((self.p["C"], self.p["c"])), np.column_stack((self.p["W"], self.p["w"]))

    def halves(self) -> np.ndarray:
        """What the gates' sums are multiplied by: a sigmoid is a tanh of half its input."""
        return np.repeat(np.float32([0.5, 1]), (2 * self.hidden, self.hidden))

    def gate(self, a: np.ndarray, u: np.ndarray, h: np.ndarray, zr: np.ndarray, n: np.ndarray, out: np.ndarray) -> np.ndarray:
        """The new state, in out, from the words' (a) and the old state's (u) parts of the gates' sums times halves(); zr and n get the gates."""
        k = self.hidden
        np.add(a[:, : 2 * k], u[:, : 2 * k], out=zr)
        np.tanh(zr, out=zr)
        zr *= 0.5
        zr += 0.5
        np.multiply(zr[:, k:], u[:, 2 * k :], out=n)
        n += a[:, 2 * k :]
        np.tanh(n, out=n)
        np.subtract(h, n, out=out)
        out *= zr[:, :k]
        out += n
        return out

    @np.errstate(over="ignore", invalid="ignore")
    def output(self, h: np.ndarray, y: np.ndarray, joined: tuple[np.ndarray, np.ndarray], grad: tuple[np.ndarray, np.ndarray] | None = None, careful: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """Natural log-probabilities of the words y after states h (of other words, their class's alone); the mean loss's gradient by h, and in grad those by joined().

        Exponentials are summed as they are; where a sum leaves the range of numbers, all is done again from each row's maximum (careful)."""
        (top, words), size, k, asked = joined, len(y), self.hidden, y
        # rows in order of their class, so that each class's rows are one slice
        by = np.argsort(self.cls[y], kind="stable")
        y = y[by]
        c = self.cls[y]
        hs = np.ones((size, k + 1), np.float32)
        hs[:, :k] = h[by]
        values, total, gh = np.empty(size, np.float32), np.empty(size, np.float32), np.empty((size, k), np.float32)
        ones = np.ones(top.shape[1], np.float32)
        if grad is not None:
            grad[0][:], grad[1][:] = 0, 0
        for at in range(0, size, BLOCK):
            i = slice(at, at + BLOCK)
            s = hs[i] @ top
            if careful:
                s -= s.max(1, keepdims=True)
            flat, pick = s.reshape(-1), np.arange(0, s.size, s.shape[1]) + c[i]
            values[i] = flat[pick]
            np.exp(s, out=s)
            total[i] = t = s @ ones
            if grad is not None:
                flat[pick] -= t
                t = (1 / (size * t))[:, None]
                grad[0][:] += (hs[i] * t).T @ s
                np.multiply(s @ top[:k].T, t, out=gh[i])
        # all words of each row's class, end to end; a word alone in its class is certain
        width = np.diff(self.start)[c]
        stop = np.cumsum(width)
        begin = stop - width
        flat = np.zeros(stop[-1], np.float32)
        edge = np.searchsorted(c, np.arange(len(self.start)))
        parts = [(a, b, lo, hi, flat[begin[a] : stop[b - 1]].reshape(b - a, hi - lo)) for a, b, lo, hi in zip(*(x.tolist() for x in (edge[:-1], edge[1:], self.start[:-1], self.start[1:])), strict=True) if a < b and hi - lo > 1]
        for a, b, lo, hi, s in parts:
            np.matmul(hs[a:b], words[lo:hi].T, out=s)
        if careful:
            flat -= np.repeat(np.maximum.reduceat(flat, begin), width)
        pick = begin + y - self.start[c]
        values += flat[pick]
        np.exp(flat, out=flat)
        t = np.add.reduceat(flat, begin)
        if not careful and not (1e-30 < min(total.min(), t.min()) and max(total.max(), t.max()) < 1e30):
            return self.output(h, asked, joined, grad, careful=True)
        values -= np.log(total)
        values -= np.log(t)
        out = np.empty(size, np.float32)
        out[by] = values
        if grad is None:
            return out, None
        flat[pick] -= t
        t = (1 / (size * t))[:, None]
        hs *= t
        more = np.zeros((size, k + 1), np.float32)
        for a, b, lo, hi, s in parts:
            np.matmul(s.T, hs[a:b], out=grad[1][lo:hi])
            np.matmul(s, words[lo:hi], out=more[a:b])
        more *= t
        gh += more[:, :k]
        back = np.empty_like(gh)
        back[by] = gh
        return out, back

    def vector(self) -> np.ndarray:
        return np.concatenate([self.p[n].ravel() for n in sorted(self.p)])

    def take(self, vector: np.ndarray) -> None:
        """Weights as vector() gives them."""
        at = 0
        for n in sorted(self.p):
            size = self.p[n].size
            self.p[n] = vector[at : at + size].reshape(self.p[n].shape).astype(np.float32)
            at += size

    def score(self, docs: list[np.ndarray]) -> np.ndarray:
        """Natural log-probability of each document's words (ending with the end token); of other words, their class's."""
        out, k, joined = np.zeros(len(docs)), self.hidden, self.joined()
        flow = Lanes(docs, LANES, self.ids.get(END, 0))
        inputs, recurrent = (self.p["X"] + self.p["b"]) * self.halves(), self.p["U"] * self.halves()
        full = flow.width[0]
        state, zr, n = np.zeros((full, k), np.float32), np.empty((full, 2 * k), np.float32), np.empty((full, k), np.float32)
        done = 0
        while done < len(flow.width):
            # steps whose outputs are computed together
            last = min(max(int(np.searchsorted(flow.start, flow.start[done] + WINDOW)), done + 1), len(flow.width))
            part = slice(flow.start[done], flow.start[last])
            states = np.empty((part.stop - part.start, k), np.float32)
            for j in range(done, last):
                xs, fs = flow.inputs(j)
                w = len(xs)
                state = state[:w]
                if fs.any():
                    state = np.where(fs[:, None], np.float32(0), state)
                at = flow.start[j] - part.start
                state = self.gate(inputs.take(xs, 0), state @ recurrent, state, zr[:w], n[:w], states[at : at + w])
            values, _ = self.output(states, flow.y[part], joined)
            out += np.bincount(flow.owner[part], values, len(docs))
            done = last
        return out


class Trainer:
    """Truncated backpropagation over lanes of documents, state carried between windows; Adam, for inputs only where a window has them.

    The given model stays as it is (tasks of one worker share it); the one trained is model."""

    def __init__(self, model: Model):
        self.model, self.t = copy.copy(model), 0
        top, words = model.joined()
        dense = (model.p["U"], model.p["b"], top, words)
        # all weights but the inputs' lie in one row, as do their gradients and moments
        cuts = np.cumsum([0, *(x.size for x in dense)])
        views = lambda row: [row[a:b].reshape(x.shape) for a, b, x in zip(cuts, cuts[1:], dense, strict=False)]
        self.row = np.concatenate([x.ravel() for x in dense])
        self.grad, self.m, self.v = (np.zeros_like(self.row) for _ in range(3))
        u, b, *self.joined = views(self.row)
        self.by_u, self.by_b, *self.by_joined = views(self.grad)
        top, words = self.joined
        self.model.p = {"X": model.p["X"].copy(), "U": u, "b": b, "C": top[:-1], "c": top[-1], "W": words[:, :-1], "w": words[:, -1]}
        self.mx, self.vx = np.zeros_like(model.p["X"]), np.zeros_like(model.p["X"])

    def learn(self, docs: list[np.ndarray], before: np.ndarray, rate: float) -> None:
        """before: the word ahead of each document's first."""
        p, k, halves = self.model.p, self.model.hidden, self.model.halves()
        flow = Lanes(docs, TRAIN_LANES, before)
        state = np.zeros((flow.width[0], k), np.float32)
        for at in range(0, len(flow.width), TRAIN_WINDOW):
            steps = range(at, min(at + TRAIN_WINDOW, len(flow.width)))
            lo, hi = flow.start[at], flow.start[steps[-1] + 1]
            here = [slice(flow.start[j] - lo, flow.start[j + 1] - lo) for j in steps]
            x, size = flow.x[lo:hi], hi - lo
            a = p["X"].take(x, 0)
            a += p["b"]
            a *= halves
            recurrent = p["U"] * halves
            keep = (~flow.first[lo:hi, None]).astype(np.float32)
            old, new, n = (np.empty((size, k), np.float32) for _ in range(3))
            zr, u = np.empty((size, 2 * k), np.float32), np.empty((size, 3 * k), np.float32)
            for i in here:
                np.multiply(state[: i.stop - i.start], keep[i], out=old[i])
                np.matmul(old[i], recurrent, out=u[i])
                state = self.model.gate(a[i], u[i], old[i], zr[i], n[i], new[i])
            _, own = self.model.output(new, flow.y[lo:hi], self.joined, self.by_joined)
            # what a state's gradient is multiplied by: for z, r, and n's recurrent part; and for n's input part
            z, r, un = zr[:, :k], zr[:, k:], u[:, 2 * k :]
            by_n = (1 - z) * (1 - n * n)
            by = np.empty((size, 3, k), np.float32)
            np.multiply(by_n, r, out=by[:, 2])
            by[:, 0], by[:, 1] = (old - n) * (z * (1 - z)), by[:, 2] * un * (1 - r)
            gu = np.empty((size, 3 * k), np.float32)
            split = gu.reshape(size, 3, k)
            gh = np.zeros((0, k), np.float32)
            back = np.ascontiguousarray(p["U"].T)
            for i in reversed(here):
                g = own[i]
                g[: len(gh)] += gh
                np.multiply(g[:, None], by[i], out=split[i])
                gh = gu[i] @ back
                gh += g * z[i]
                gh *= keep[i]
            np.matmul(old.T, gu, out=self.by_u)
            gx = gu
            np.multiply(own, by_n, out=split[:, 2])
            gx.sum(0, out=self.by_b)
            order = np.argsort(x.astype(np.uint16) if len(p["X"]) <= 1 << 16 else x, kind="stable")
            words = x[order]
            first = np.flatnonzero(np.append(True, words[1:] != words[:-1]))
            words = words[first]
            gx = np.add.reduceat(gx.take(order, 0), first, axis=0)
            self.t += 1
            # the moments are kept as plain sums: 10 and 500 times the means
            root = math.sqrt(0.002 / (1 - 0.998**self.t))
            by, least = 0.1 * rate * min(1, self.t / 20) / (1 - 0.9**self.t) / root, 1e-8 / root  # each round's moments start anew
            for i in range(0, len(self.row), PIECE):
                i = slice(i, i + PIECE)
                self.adam(self.row[i], self.m[i], self.v[i], self.grad[i], by, least)
            m, v, w = self.mx.take(words, 0), self.vx.take(words, 0), p["X"].take(words, 0)
            self.adam(w, m, v, gx, by, least)
            self.mx[words], self.vx[words], p["X"][words] = m, v, w

    @staticmethod
    def adam(w: np.ndarray, m: np.ndarray, v: np.ndarray, g: np.ndarray, rate: float, least: float) -> None:
        """A step of the weights w in place; g is used up."""
        m *= 0.9
        m += g
        g *= g
        v *= 0.998
        v += g
        np.sqrt(v, out=g)
        g += least
        np.divide(m, g, out=g)
        g *= rate
        w -= g


class Lanes:
    """Documents end to end in lanes, step by step: the lanes that are still running come first, so a step has no gaps.

    x: inputs (opened by the end token, or by an own word of each document), y: targets, first: whether a document begins, owner: its number."""

    def __init__(self, docs: list[np.ndarray], lanes: int, end: int | np.ndarray):
        end = np.broadcast_to(end, len(docs))
        load = [(0, k) for k in range(min(lanes, len(docs)))]
        placed: list[list[int]] = [[] for _ in load]
        for i in sorted(range(len(docs)), key=lambda i: -len(docs[i])):
            n, k = heapq.heappop(load)
            placed[k].append(i)
            heapq.heappush(load, (n + len(docs[i]), k))
        order = [k for _, k in sorted(load, reverse=True)]
        length = np.array([n for n, _ in sorted(load, reverse=True)])
        self.width = np.searchsorted(-length, -np.arange(length[0]), "left")
        self.start = np.concatenate(([0], np.cumsum(self.width)))
        self.x, self.y, self.owner = (np.empty(self.start[-1], np.int32) for _ in range(3))
        self.first = np.zeros(self.start[-1], bool)
        for row, k in enumerate(order):
            words = np.concatenate([docs[i] for i in placed[k]])
            sizes = np.array([len(docs[i]) for i in placed[k]])
            begins = np.cumsum(sizes) - sizes
            before = np.roll(words, 1)
            before[begins] = end[placed[k]]
            at = self.start[: len(words)] + row
            self.x[at], self.y[at], self.owner[at] = before, words, np.repeat(placed[k], sizes)
            self.first[at[begins]] = True

    def inputs(self, step: int) -> tuple[np.ndarray, np.ndarray]:
        part = slice(self.start[step], self.start[step + 1])
        return self.x[part], self.first[part]


class Seen(dict):
    """A bounded memory of words: their numbers, ids in the model and counts (-1: not among the common words)."""

    def __init__(self, model: Model, common: dict[bytes, int], most: int = 400_000):
        self.model, self.common, self.most = model, common, most
        self.words: list[bytes] = []
        self.ids, self.counts = np.zeros(0, np.int32), np.zeros(0, np.int64)

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self.words)
        self.words.append(word)
        return n

    def numbers(self, lists: list[list[bytes]], n: int) -> np.ndarray:
        if len(self.words) > self.most:
            self.clear()
            self.words, self.ids, self.counts = [], self.ids[:0], self.counts[:0]
        out = np.fromiter(map(self.__getitem__, chain.from_iterable(lists)), np.int64, n)
        new = self.words[len(self.ids) :]
        self.ids = np.append(self.ids, np.fromiter(map(self.model.id_of, new), np.int32, len(new)))
        self.counts = np.append(self.counts, np.fromiter((self.common.get(w, -1) for w in new), np.int64, len(new)))
        return out


def count_words(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word, c) over all rows of docs, the end token as the empty word; counted per task before the shuffle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(counts.keys()), pa.binary()).cast(pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "c"])

        for batch in batches:
            for _, texts in text_slices(batch, "text"):
                for t in texts:
                    counts.update(words_of(t))
                counts[END] += len(texts)
                if len(counts) > 300_000:
                    yield out()
                    counts.clear()
        if counts:
            yield out()

    return docs.select(F.col(text).alias("text")).mapInArrow(run, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


def train_all(train: DataFrame, model: Model, words: int, text: str = "text") -> int:
    """Fit the model's weights on every word of train (about `words` in all), in tasks; the words read."""
    spark = train.sparkSession
    tasks = max(1, min(words // TASK_WORDS, spark.sparkContext.defaultParallelism))
    share = F.pmod(F.xxhash64(*train.columns, F.lit(21)), F.lit(ROUNDS))
    read = 0

    def average(table: pa.Table) -> pa.Table:
        many = np.array(table.column("words").to_pylist(), float)
        total = sum(n / many.sum() * np.frombuffer(x.as_buffer(), np.float32) for n, x in zip(many, (x for c in table.column("weights").chunks for x in c), strict=True))
        return pa.table({"piece": table.column("piece").slice(0, 1), "words": pa.array([int(many.sum())], pa.int64()), "weights": pa.array([total.astype(np.float32).tobytes()], pa.binary())})

    for k in range(EPOCHS * ROUNDS):
        shared = spark.sparkContext.broadcast(model)
        rate = RATE * (1 if k + 1 < EPOCHS * ROUNDS else 0.3)

        def run(batches: Iterator[pa.RecordBatch], shared=shared, rate=rate) -> Iterator[pa.RecordBatch]:
            trainer, seen, end = Trainer(shared.value), Seen(shared.value, {}), shared.value.ids.get(END, 0)
            docs, before, size, done = [], [], 0, 0
            for batch in batches:
                for _, texts in text_slices(batch, "text"):
                    lists = [[*words_of(t), END] for t in texts]
                    length = [len(x) for x in lists]
                    numbers = seen.numbers(lists, sum(length))
                    for ids in np.split(seen.ids[numbers], np.cumsum(length)[:-1]):
                        for at in range(0, len(ids), SPAN):
                            docs.append(ids[at : at + SPAN])
                            before.append(ids[at - 1] if at else end)
                        size += len(ids)
                        if size >= TRAIN_WORDS:
                            trainer.learn(docs, np.array(before), rate)
                            docs, before, size, done = [], [], 0, done + size
            if docs:
                trainer.learn(docs, np.array(before), rate)
            if done + size:
                vector = trainer.model.vector()
                pieces = [vector[i : i + PIECE].tobytes() for i in range(0, len(vector), PIECE)]
                yield pa.RecordBatch.from_arrays([pa.array(range(len(pieces)), pa.int32()), pa.array([done + size] * len(pieces), pa.int64()), pa.array(pieces, pa.binary())], ["piece", "words", "weights"])

        schema = "piece int, words long, weights binary"
        fitted = train.where(share == k % ROUNDS).select(F.col(text).alias("text")).coalesce(tasks).mapInArrow(run, schema)
        rows = sorted(fitted.groupBy("piece").applyInArrow(average, schema).collect(), key=lambda r: r["piece"])  # the size of the weights
        shared.destroy()
        if rows:
            model.take(np.frombuffer(b"".join(r["weights"] for r in rows), np.float32))
            read += rows[0]["words"]
    return read


def score_documents(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", folds: int = 7, fold: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, learning from rows whose fold is another."""
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), (crc_mod(F.col(doc_id), folds) == fold).alias("held_out"))
    train = rows.where("not held_out")
    counts = cut(count_words(train))
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    # the words with the highest counts, COMMON at most: a histogram of some hundred rows gives the least count to take
    bucket = F.floor(F.log2(F.col("c")) * 8).cast("int")
    least, many = None, 0
    for r in counts.groupBy(bucket.alias("b")).agg(F.count("*").alias("v"), F.min("c").alias("c")).orderBy(F.desc("b")).collect():
        many += r["v"]
        if many > COMMON:
            break
        least = r["c"]
    own = max(2, math.ceil(total ** (2 / 3) / OWN_OUTPUT))
    if many > COMMON:
        least = own if least is None else min(least, own)
    taken = counts.where(F.col("c") >= least).collect() if least is not None else []  # at most COMMON or OWN_OUTPUT * N^(1/3) words
    common = sorted(((r["word"].encode(), r["c"]) for r in taken), key=lambda x: (-x[1], x[0]))
    vocabulary = [x for i, x in enumerate(common) if i < VOCABULARY or x[1] >= own]
    if all(w != END for w, _ in vocabulary) and vocabulary:
        vocabulary[-1] = next(((w, c) for w, c in common if w == END), (END, 1))
    # tokens and distinct words of each class of other words: all of them, less the vocabulary's
    tokens, distinct_words = np.zeros(OTHER_CLASSES, np.int64), np.zeros(OTHER_CLASSES, np.int64)
    for r in counts.groupBy(ending_class(F.col("word")).alias("k")).agg(F.sum("c").alias("c"), F.count("*").alias("v")).collect():
        tokens[r["k"]], distinct_words[r["k"]] = r["c"], r["v"]
    for w, c in vocabulary:
        tokens[other_class(w)] -= c
        distinct_words[other_class(w)] -= 1
    model = Model(vocabulary, tokens.tolist())
    train_all(train.select("doc_id", "text"), model, total)
    shared = spark.sparkContext.broadcast((model, dict(common)))
    log_n = math.log10(total + distinct + 1)
    other_log = np.log10(np.maximum(tokens, 0) + np.maximum(distinct_words, 0) + 1.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, common = shared.value
        seen = Seen(model, common)
        for batch in batches:
            for part, texts in text_slices(batch, "text"):
                lists = [[*words_of(t), END] for t in texts]
                length = np.fromiter(map(len, lists), np.int64, len(lists))
                at = seen.numbers(lists, int(length.sum()))
                doc = np.repeat(np.arange(len(lists)), length)
                ids, c = seen.ids[at], seen.counts[at]
                log_c = np.log10(np.maximum(c, 0) + 1.0)
                outside = ids < OTHER_CLASSES
                per_doc = lambda weight: np.bincount(doc, weight, len(lists))  # noqa: E731, B023
                neural = model.score(np.split(ids, np.cumsum(length)[:-1])) / math.log(10)
                # words that are not common, once per document with their number
                rare = np.flatnonzero(c < 0)
                pair, m = np.unique(doc[rare] * len(seen.words) + at[rare], return_counts=True)
                rare_doc, rare_word = pair // len(seen.words), pair % len(seen.words)
                offsets = pa.array(np.searchsorted(rare_doc, np.arange(len(lists) + 1)), pa.int32())
                words = pa.ListArray.from_arrays(offsets, pa.array([seen.words[i] for i in rare_word.tolist()], pa.binary()).cast(pa.string()))
                columns = [part.column(0), part.column(2), pa.array(length), pa.array(per_doc(c >= 0).astype(np.int64)), pa.array(per_doc(log_c)), pa.array(per_doc(log_c * outside)), pa.array(per_doc(np.where(outside, other_log[np.where(outside, ids, 0)], 0.0))), pa.array(neural), words, pa.ListArray.from_arrays(offsets, pa.array(m.astype(np.int64)))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "n_tokens", "known", "plus", "other", "shares", "neural", "rare", "many"])

    scored = cut(rows.select("doc_id", "text", "held_out").mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, known long, plus double, other double, shares double, neural double, rare array<string>, many array<long>").withColumn("row", F.monotonically_increasing_id()))
    rare = scored.select("row", F.explode(F.arrays_zip("rare", "many")).alias("x")).select("row", F.col("x.rare").alias("word"), F.col("x.many").alias("m"))
    met = rare.join(counts, "word").groupBy("row").agg(F.sum("m").alias("more"), F.sum(F.col("m") * F.log10(F.col("c") + 1)).alias("rare_plus"))
    full = scored.drop("rare", "many").join(met, "row", "left").na.fill(0, ["more"]).na.fill(0.0, ["rare_plus"])
    return full.select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.col("more")).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("plus") + F.col("rare_plus") - F.col("n_tokens") * F.lit(log_n)).alias("base_score"),
        (F.col("neural") + F.col("other") + F.col("rare_plus") - F.col("shares")).alias("score"),
    )
