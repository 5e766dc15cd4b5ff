"""Quality classifier: a byte-level convolutional network in numpy.

Whole documents are cut into overlapping chunks of bytes. Learned filters slide over a chunk, their
strongest responses (max-pooling) go through a small dense layer to the chunk's logit, and the logits
of all chunks, weighted by the bytes they hold, are averaged into the document's probability.

Learning takes at most SAMPLE_DOCS labelled documents per class, chosen by a hash of the id over all
labels, and CHUNKS_PER_DOC chunks of each. Scoring covers every byte.

Defined results: null counts as empty; an empty text is one chunk of padding and gets the model's score
for it; without labels of both classes every score is 0.5; repeated rows score alike; other columns
pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches, text_slices, tidy, without

SAMPLE_DOCS, CHUNKS_PER_DOC = 1500, 3
CHUNK, OVERLAP, PAD = 1024, 64, 256
WIDTH, STRIDE, EMBED, FILTERS, HIDDEN = 8, 2, 8, 32, 16
STEPS, BATCH, RATE = 1000, 64, 0.003


def chunked(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Overlapping chunks of all texts as padded byte codes; the text each belongs to, and the bytes it holds."""
    rows, owner, size = [], [], []
    for i, b in enumerate(raw):
        for at in range(0, max(len(b) - OVERLAP, 1), CHUNK - OVERLAP):
            piece = b[at : at + CHUNK]
            rows.append(piece)
            owner.append(i)
            size.append(len(piece))
    out = np.full((len(rows), CHUNK), PAD, np.int16)
    size = np.array(size)
    out[np.arange(CHUNK) < size[:, None]] = np.frombuffer(b"".join(rows), np.uint8)
    return out, np.array(owner), size


class Network:
    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        draw = lambda *s, by: (r.standard_normal(s) * by).astype(np.float32)
        self.p = {"E": draw(PAD + 1, EMBED, by=0.5), "W": draw(WIDTH * EMBED, FILTERS, by=0.15), "b": np.zeros(FILTERS, np.float32), "V": draw(FILTERS, HIDDEN, by=0.2), "c": np.zeros(HIDDEN, np.float32), "u": draw(HIDDEN, by=0.2), "d": np.zeros(1, np.float32)}
        self.p["E"][PAD] = 0

    def _windows(self, x: np.ndarray) -> np.ndarray:
        return sliding_window_view(self.p["E"][x], WIDTH, axis=1)[:, ::STRIDE].transpose(0, 1, 3, 2).reshape(len(x), -1, WIDTH * EMBED)

    def pooled(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        w = self._windows(x)
        z = w @ self.p["W"]
        at = z.argmax(1)
        return np.take_along_axis(z, at[:, None], 1)[:, 0] + self.p["b"], at, w

    def logits(self, x: np.ndarray) -> np.ndarray:
        out = np.empty(len(x), np.float32)
        for i in range(0, len(x), 32):  # the windows of 32 chunks stay in the cache
            z = (self._windows(x[i : i + 32]) @ self.p["W"]).max(1) + self.p["b"]
            out[i : i + 32] = np.tanh(np.maximum(z, 0) @ self.p["V"] + self.p["c"]) @ self.p["u"] + self.p["d"]
        return out

    def fit(self, x: np.ndarray, y: np.ndarray, steps: int = STEPS, seed: int = 11) -> Network:
        """Adam on the cross-entropy of chunks, both classes drawn equally often."""
        r, p = np.random.default_rng(seed), self.p
        m = {k: np.zeros_like(v) for k, v in p.items()}
        s = {k: np.zeros_like(v) for k, v in p.items()}
        classes = [np.flatnonzero(y == k) for k in (0, 1)]
        for step in range(1, steps + 1):
            i = np.concatenate([r.choice(c, BATCH // 2) for c in classes])
            # half of the chunks are shortened, so short texts are judged on what they have
            keep = np.where(r.random(len(i)) < 0.5, CHUNK, np.exp(r.uniform(np.log(24), np.log(CHUNK), len(i))).astype(int))
            xb = np.where(np.arange(CHUNK) < keep[:, None], x[i], PAD)
            z, at, w = self.pooled(xb)
            a = np.maximum(z, 0)
            h = np.tanh(a @ p["V"] + p["c"])
            o = h @ p["u"] + p["d"]
            g = ((1 / (1 + np.exp(-o))) - y[i]).astype(np.float32) / len(i)
            gh = np.outer(g, p["u"]) * (1 - h * h)
            gz = (gh @ p["V"].T) * (z > 0)
            best = np.take_along_axis(w, at[:, :, None], 1)  # each filter's strongest window
            grad = {"u": h.T @ g, "d": g.sum(keepdims=True), "V": a.T @ gh, "c": gh.sum(0), "b": gz.sum(0), "W": np.einsum("nf,nfk->kf", gz, best)}
            ge = (gz[:, :, None] * p["W"].T).reshape(len(i), FILTERS, WIDTH, EMBED)
            codes = xb[np.arange(len(i))[:, None, None], (at * STRIDE)[:, :, None] + np.arange(WIDTH)]
            grad["E"] = np.zeros_like(p["E"])
            np.add.at(grad["E"], codes, ge)
            grad["E"][PAD] = 0
            for k, v in grad.items():
                m[k] += 0.1 * (v - m[k])
                s[k] += 0.001 * (v * v - s[k])
                p[k] -= RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8)
        return self


def learn(docs: DataFrame, labels: DataFrame, target: str = "quality", text: str = "text", doc_id: str = "doc_id", per_class: int = SAMPLE_DOCS, steps: int = STEPS) -> Network | None:
    """A network for labels.target (0 or 1) from a bounded sample of labelled rows of docs; None without both classes."""
    known = labels.where(F.col(target).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(target).alias("y"))
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if set(counts) != {0, 1}:
        return None
    million = 1_000_000
    share = F.when(F.col("y") == 0, min(million, -(-2 * per_class * million // counts[0]))).otherwise(min(million, -(-2 * per_class * million // counts[1])))
    few = known.where(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(million)) < share).orderBy(F.xxhash64("doc_id", F.lit(5))).limit(8 * per_class)  # a bounded sample: safe to broadcast
    span = CHUNK
    size = F.greatest(F.length("text") - span, F.lit(1))
    # hashed places in the text; a chunk starts anywhere
    excerpts = F.array(*[F.substring("text", (F.pmod(F.xxhash64("doc_id", F.lit(k)), size) + 1).cast("int"), F.lit(span)) for k in range(CHUNKS_PER_DOC)])
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(text, F.lit("")).alias("text")).join(F.broadcast(few), "doc_id").select("doc_id", "y", excerpts.alias("t")).groupBy("doc_id").agg(F.min("y").alias("y"), F.min("t").alias("t")).orderBy(F.xxhash64("doc_id", F.lit(5))).collect()
    taken, x, y = {0: 0, 1: 0}, [], []
    for r in rows:
        if taken[r["y"]] < per_class:
            taken[r["y"]] += 1
            for t in dict.fromkeys(r["t"]):
                x.append(t.encode()[:CHUNK])
                y.append(r["y"])
    if len(set(y)) < 2:
        return None
    codes = np.full((len(x), CHUNK), PAD, np.int16)
    for i, b in enumerate(x):
        codes[i, : len(b)] = np.frombuffer(b, np.uint8)
    return Network().fit(codes, np.array(y, np.float32), steps)


def score(df: DataFrame, network: Network | None, text: str = "text", name: str = "score") -> DataFrame:
    """df with the probability of label 1 for each whole text; a column with the result's name is replaced."""
    df = without(df, [name], [text])
    schema = T.StructType([*df.schema.fields, T.StructField(name, T.DoubleType(), False)])
    shared = df.sparkSession.sparkContext.broadcast(network)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for batch in batches:
            for part, texts in text_slices(batch, text):
                out = np.full(len(texts), 0.5)
                if net is not None:
                    x, owner, size = chunked([t.encode("utf-8", "replace") for t in texts])
                    weight = np.maximum(size, 1)
                    mean = np.bincount(owner, weight * net.logits(x), minlength=len(texts)) / np.bincount(owner, weight, minlength=len(texts))
                    out = 1 / (1 + np.exp(-mean))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out)], [*part.schema.names, name])

    return small_batches(df).mapInArrow(tidy(run), schema)
