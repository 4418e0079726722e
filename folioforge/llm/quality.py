"""Quality classifier: a byte-level convolutional network in numpy.

A text's UTF-8 bytes are embedded and convolved with learned filters of
``WIDTH`` bytes at stride ``STRIDE``, so windows overlap and cover the whole
text.  Windows are pooled by their maximum within overlapping chunks (``CHUNK``
windows, a new one every half chunk), so any length is handled in bounded
memory; a text's vector is the mean and the maximum of its chunks, and a
logistic unit makes one probability of it.

It is trained with Adam on a sample of about ``PER_CLASS`` labelled documents a
class whose crc32 fold isn't held out.  The sample documents are trained on
whole; so that short texts aren't taken for poor ones, each also gives a short
excerpt (at word bounds, drawn anew in each epoch) with its label.  lang, source and doc_id are never inputs of a score.

Defined cases: a null text is empty; an empty text is one window of padding and
so has a score too; with no labels, or labels of one class, every score is the
share of label 1 (0 without labels); a very long text is convolved whole; a chunk
with several equal maxima counts the first in training, all texts alike in
scoring; a score equal to the threshold predicts 1; null ``doc_id`` is held out
and never learned from; repeated rows are scored alike; other columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.llm.arrow_text import slices, utf8
from folioforge.llm.sampling import fold_of, per_class

PER_CLASS, FOLDS, HELD_OUT, THRESHOLD = 700, 5, 0, 0.3
WIDTH, STRIDE, EMBED, FILTERS, CHUNK = 8, 4, 6, 24, 64
EPOCHS, BATCH, RATE, SEED = 14, 32, 0.01, 5
#: Bytes convolved at once.
SLICE = 1 << 19


def padded(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts laid out at multiples of STRIDE with zero bytes after each, and each text's first window (one more at the end)."""
    n = np.diff(off)
    windows = np.maximum(1, -(-np.maximum(n - (WIDTH - STRIDE), 1) // STRIDE))
    first = np.concatenate(([0], np.cumsum(windows + WIDTH // STRIDE - 1)))
    out = np.zeros(int(first[-1]) * STRIDE + WIDTH, np.uint8)
    place = np.arange(len(raw)) + np.repeat(first[:-1] * STRIDE - off[:-1], n)
    out[place] = raw
    return out, first


class Net:
    """Embedding, filters and output unit; ``forward`` returns texts' vectors, ``score`` their probabilities."""

    def __init__(self, seed: int = SEED, prior: float | None = None):
        rng = np.random.Generator(np.random.PCG64(seed))
        self.prior = prior
        self.e = rng.normal(0, 0.5, (256, EMBED)).astype(np.float32)
        self.k = rng.normal(0, (WIDTH * EMBED) ** -0.5, (WIDTH * EMBED, FILTERS)).astype(np.float32)
        self.kb = np.zeros(FILTERS, np.float32)
        self.w = rng.normal(0, 0.1, 2 * FILTERS).astype(np.float32)
        self.b = np.zeros(1, np.float32)

    def windows(self, data: np.ndarray, start: int, stop: int) -> np.ndarray:
        """Embedded bytes of windows start .. stop - 1, a row each."""
        e = self.e[data[start * STRIDE : (stop - 1) * STRIDE + WIDTH]].reshape(-1)
        step = e.strides[0]
        return np.lib.stride_tricks.as_strided(e, (stop - start, WIDTH * EMBED), (STRIDE * EMBED * step, step))

    def chunks(self, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first window, end, text) of each chunk: CHUNK windows, one every CHUNK / 2, the last one whole."""
        n = np.diff(first) - (WIDTH // STRIDE - 1)
        half = CHUNK // 2
        many = np.maximum(1, -(-(n - half) // half))
        text = np.repeat(np.arange(len(n)), many)
        k = np.arange(len(text)) - np.repeat(np.concatenate(([0], np.cumsum(many)[:-1])), many)
        start = first[:-1][text] + k * half
        return start, np.minimum(start + CHUNK, first[:-1][text] + n[text]), text

    def forward(self, data: np.ndarray, first: np.ndarray, trace: bool = False):
        """Vectors of the texts: mean and maximum over chunks of the filters' maxima."""
        act = self.windows(data, 0, int(first[-1])) @ self.k + self.kb
        half = CHUNK // 2
        start, end, text = self.chunks(first)
        # maxima of half chunks first; a chunk is two of them
        mid = np.minimum(start + half, end)
        cuts = np.empty(3 * len(start), np.int64)
        cuts[0::3], cuts[1::3], cuts[2::3] = start, mid, end
        order = np.unique(np.concatenate((start, mid, end, first[:-1])))
        order = order[order < len(act)]
        halves = np.maximum.reduceat(act, order)
        a = np.searchsorted(order, start)
        c = np.searchsorted(order, mid)
        top = halves[a]
        two = mid < end
        top[two] = np.maximum(top[two], halves[c[two]])
        pooled = np.maximum(top, 0)
        lead = np.concatenate(([0], np.flatnonzero(np.diff(text)) + 1))
        count = np.diff(np.append(lead, len(text)))
        vector = np.concatenate((np.add.reduceat(pooled, lead) / count[:, None], np.maximum.reduceat(pooled, lead)), axis=1)
        if trace:
            return vector, (act, start, end, text, pooled, lead, count)
        return vector

    def score(self, raw: np.ndarray, off: np.ndarray) -> np.ndarray:
        n = len(off) - 1
        if self.prior is not None:
            return np.full(n, self.prior)
        out = np.zeros(n)
        for i, j in slices(off, SLICE):
            z = self.forward(*padded(raw[off[i] : off[j]], off[i : j + 1] - off[i])).astype(np.float64) @ self.w.astype(np.float64) + float(self.b[0])
            out[i:j] = 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))
        return out

    def gradients(self, data: np.ndarray, first: np.ndarray, y: np.ndarray, share: np.ndarray) -> list[np.ndarray]:
        vector, (act, start, end, text, pooled, lead, count) = self.forward(data, first, True)
        z = vector @ self.w + self.b[0]
        dz = ((1.0 / (1.0 + np.exp(-z)) - y) * share / len(y)).astype(np.float32)
        dw, db = vector.T @ dz, np.array([dz.sum()], np.float32)
        dv = dz[:, None] * self.w[None, :]
        d_pool = (dv[:, :FILTERS] / count[:, None])[text]
        best = np.maximum.reduceat(pooled, lead)[text]
        winner = pooled >= best
        ties = np.add.reduceat(winner, lead, dtype=np.float32)[text]
        d_pool += winner * dv[:, FILTERS:][text] / ties
        d_pool *= pooled > 0
        # each chunk's maximum has one window for each filter
        where = np.empty(pooled.shape, np.int64)
        for r, (s, e) in enumerate(zip(start.tolist(), end.tolist(), strict=True)):
            where[r] = s + act[s:e].argmax(axis=0)
        dk, dkb, de = np.zeros_like(self.k), d_pool.sum(axis=0), np.zeros_like(self.e)
        rows = self.windows(data, 0, int(first[-1]))
        k3 = self.k.reshape(WIDTH, EMBED, FILTERS)
        for f in range(FILTERS):
            g = d_pool[:, f]
            on = np.flatnonzero(g)
            if not len(on):
                continue
            at, g = where[on, f], g[on]
            dk[:, f] = rows[at].T @ g
            for p in range(WIDTH):
                np.add.at(de, data[at * STRIDE + p], g[:, None] * k3[p, :, f][None, :])
        return [de, dk, dkb, dw, db]

    def train(self, texts: list[bytes], y: np.ndarray, epochs: int = EPOCHS) -> None:
        rng = np.random.Generator(np.random.PCG64(SEED))
        share = np.where(y > 0, 0.5 / max(1e-9, y.mean()), 0.5 / max(1e-9, 1 - y.mean()))
        params = [self.e, self.k, self.kb, self.w, self.b]
        m, v, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        for epoch in range(epochs):
            order = rng.permutation(len(texts))
            for i in range(0, len(order), BATCH):
                own = order[i : i + BATCH]
                batch = [texts[k] for k in own] + [excerpt(texts[k], rng) for k in own]
                own = np.concatenate((own, own))
                off = np.concatenate(([0], np.cumsum([len(x) for x in batch])))
                data, first = padded(np.frombuffer(b"".join(batch), np.uint8), off)
                t += 1
                rate = RATE * (1 - epoch / epochs) * (1 - 0.999**t) ** 0.5 / (1 - 0.9**t)
                for p, g, a, c in zip(params, self.gradients(data, first, y[own], share[own]), m, v, strict=True):
                    a += 0.1 * (g - a)
                    c += 0.001 * (g * g - c)
                    p -= (rate * a / (np.sqrt(c) + 1e-8)).astype(np.float32)


def excerpt(text: bytes, rng: np.random.Generator) -> bytes:
    """A few words of a text."""
    size = int(rng.integers(12, 160))
    at = int(rng.integers(0, max(1, len(text) - size)))
    begin = text.find(b" ", at) + 1 if at else 0
    end = text.find(b" ", begin + size)
    return text[begin : end if end > 0 else len(text)][: 2 * size]


def fit(docs: DataFrame, labels: DataFrame, per_class_rows: int = PER_CLASS, epochs: int = EPOCHS) -> Net:
    """Train on a bounded sample of labelled documents that aren't held out."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y")).filter("doc_id is not null and y in (0, 1)")
    known = known.filter(fold_of(F.col("doc_id"), FOLDS) != HELD_OUT).dropDuplicates(["doc_id"])
    drawn = per_class(known, "y", "doc_id", per_class_rows)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("text is not null")
    got = rows.join(F.broadcast(drawn), "doc_id").toArrow().sort_by([("doc_id", "ascending"), ("text", "ascending")])
    y = np.array(got.column("y").to_pylist(), np.float32)
    if len(set(y.tolist())) < 2:
        return Net(prior=float(y.mean()) if len(y) else 0.0)
    net = Net()
    net.train([t.encode() for t in got.column("text").to_pylist()], y, epochs)
    return net


def score_documents(docs: DataFrame, net: Net) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` of every document."""
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(net.score(*utf8(batch.column(1))), pa.float64())], names=["doc_id", "score"])

    out = src.mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", (fold_of(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Fit on the labelled documents that aren't held out and score every document."""
    return score_documents(docs, fit(docs, labels))
