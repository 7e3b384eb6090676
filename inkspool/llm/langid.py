"""Language identification with a byte convolutional network (operator 2).

Text is cut into windows of ``WINDOW`` bytes (the last one padded). Filters of
widths 2, 3 and 4 run over byte classes, each is max-pooled over the window,
and a softmax over the languages follows. A document's language is the one with
the highest mean log-probability over all its windows, weighted by their bytes.

The network is trained in numpy on a bounded sample of labelled documents: the
``TRAIN_DOCS`` smallest hashes of ids, and the ``LANG_DOCS`` smallest of every
language, so that each is a class; ``TRAIN_WINDOWS`` windows of each. For
inference the filters are folded into tables over pairs of byte classes, so a
filter of width 4 costs two lookups a byte.

Defined cases: null and empty texts get a null language and probability; a null
label is not trained on; without any label every language is null; rows with
one id get one result each, and train as one document; very long texts are read
whole; an empty table gives an empty result; ids may have any type, other
columns any name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import hash60, named, read, text_bytes, with_id

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
#: Bounds of the training sample.
TRAIN_DOCS = 1200
#: Documents that a language has in the sample at least, if there are so many.
LANG_DOCS = 50
TRAIN_WINDOWS = 8
EPOCHS = 6
SEED = 7
#: Windows that are evaluated at once.
BATCH = 128


def _classes() -> np.ndarray:
    """Byte classes 0..63: case is folded, in ASCII and in two-byte Latin letters; 0 is padding."""
    c = np.zeros(256, np.uint8)
    for b in range(1, 256):
        if 65 <= b <= 90 or 97 <= b <= 122:
            c[b] = 1 + (b | 32) - 97
        elif 48 <= b <= 57:
            c[b] = 27
        elif b in (9, 10, 13, 32):
            c[b] = 28
        elif b < 128:
            c[b] = 29
        elif b < 192:
            c[b] = 32 + (b & 31)
        else:
            c[b] = 30 if b < 0xE0 else 31
    return c


CLASSES = _classes()
N_CLASSES = 64


class ByteCnn:
    def __init__(self, langs: list[str], seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.langs = langs
        self.conv = [rng.normal(0, 0.3, (w, N_CLASSES, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.bias = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
        self.out = rng.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(langs))).astype(np.float32)
        self.out_bias = np.zeros(len(langs), np.float32)

    def params(self) -> list[np.ndarray]:
        return [*self.conv, *self.bias, self.out, self.out_bias]

    def fold(self) -> list[list[np.ndarray]]:
        """For each width its lookup tables, over pairs of classes or over one."""
        tables = []
        for k in self.conv:
            parts = [(k[i][:, None, :] + k[i + 1][None, :, :]).reshape(-1, FILTERS) for i in range(0, len(k) - 1, 2)]
            if len(k) % 2:
                parts.append(k[-1])
            tables.append(parts)
        return tables

    def pooled(self, x: np.ndarray, tables) -> tuple[np.ndarray, list[np.ndarray]]:
        """(windows x features, maps) for classes x of shape windows x (WINDOW + padding)."""
        pair = x[:, :-1].astype(np.intp) * N_CLASSES + x[:, 1:]
        maps, feats = [], []
        for w, parts, b in zip(WIDTHS, tables, self.bias, strict=True):
            n = WINDOW - w + 1
            m = None
            for i, table in enumerate(parts):
                at = pair[:, 2 * i : 2 * i + n] if table.shape[0] > N_CLASSES else x[:, 2 * i : 2 * i + n]
                got = table.take(at, axis=0)
                m = got if m is None else np.add(m, got, out=m)
            maps.append(m)
            feats.append(m.max(axis=1) + b)
        return np.maximum(np.concatenate(feats, axis=1), 0), maps

    def log_probs(self, x: np.ndarray, tables=None) -> np.ndarray:
        h, _ = self.pooled(x, tables or self.fold())
        z = h @ self.out + self.out_bias
        z -= z.max(axis=1, keepdims=True)
        return z - np.log(np.exp(z).sum(axis=1, keepdims=True))

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, batch: int = 64, rate: float = 0.01, seed: int = SEED) -> None:
        """Adam on the cross entropy; through a max only its first place gets a gradient."""
        rng = np.random.default_rng(seed)
        ps = self.params()
        m1, m2, step = [np.zeros_like(p) for p in ps], [np.zeros_like(p) for p in ps], 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for at in range(0, len(x), batch):
                rows = order[at : at + batch]
                xb = x[rows]
                h, maps = self.pooled(xb, self.fold())
                z = h @ self.out + self.out_bias
                p = np.exp(z - z.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                p[np.arange(len(rows)), y[rows]] -= 1
                dz = p / len(rows)
                dh = (dz @ self.out.T) * (h > 0)
                grads_conv, grads_bias = [], []
                for k, (w, m) in enumerate(zip(WIDTHS, maps, strict=True)):
                    d = dh[:, k * FILTERS : (k + 1) * FILTERS]
                    place = m.argmax(axis=1)
                    g = np.zeros_like(self.conv[k])
                    f = np.broadcast_to(np.arange(FILTERS), place.shape)
                    for j in range(w):
                        np.add.at(g[j], (xb[np.arange(len(rows))[:, None], place + j], f), d)
                    grads_conv.append(g)
                    grads_bias.append(d.sum(axis=0))
                step += 1
                for p_, g, a, b in zip(ps, [*grads_conv, *grads_bias, h.T @ dz, dz.sum(axis=0)], m1, m2, strict=True):
                    a += 0.1 * (g - a)
                    b += 0.001 * (g * g - b)
                    p_ -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)


def windows(data: np.ndarray, offsets: np.ndarray):
    """Yields (classes, row, bytes): windows of whole texts in order, BATCH at a time."""
    size = np.diff(offsets)
    count = -(-size // WINDOW)
    row = np.repeat(np.arange(len(size)), count)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    start = offsets[row] + nth * WINDOW
    length = np.minimum(WINDOW, offsets[row + 1] - start)
    column = np.arange(WINDOW)
    for i in range(0, len(row), BATCH):
        s, n = start[i : i + BATCH], length[i : i + BATCH]
        at = np.minimum(s[:, None] + column, len(data) - 1)
        x = CLASSES[data[at]]
        x[column >= n[:, None]] = 0
        yield x, row[i : i + BATCH], n


def train(docs: DataFrame, id_col="doc_id", text_col="text", label_col="lang", train_docs: int = TRAIN_DOCS) -> ByteCnn | None:
    """Network trained on ``train_docs`` labelled documents and LANG_DOCS of each language; None without labels."""
    labelled = docs.select(named(id_col).alias("id"), named(label_col).alias("l"), named(text_col).alias("t")).where("id is not null and l is not null and t is not null")
    keys = labelled.where(F.length("t") > 0).select("id", "l", hash60(F.col("id")).alias("h"))
    rank = F.row_number().over(W.partitionBy("l").orderBy("h", "id"))
    few = {r[0] for r in keys.withColumn("nth", rank).where(F.col("nth") <= LANG_DOCS).select("id").collect()}
    chosen = sorted(few | {r[0] for r in labelled.select("id").orderBy(hash60(F.col("id")), "id").limit(train_docs).collect()})
    if not chosen:
        return None
    rows = labelled.where(F.col("id").isin(chosen)).groupBy("id").agg(F.min(F.struct("l", "t")).alias("r")).select("r.*")
    sample = sorted((r.l, r.t) for r in rows.collect() if r.t)
    langs = sorted({x for x, _ in sample})
    xs, ys = [], []
    for label, text in sample:
        raw = np.frombuffer(text.encode(), np.uint8)
        got = np.concatenate([x for x, _, _ in windows(raw, np.array([0, len(raw)]))])
        pick = np.unique(np.linspace(0, len(got) - 1, TRAIN_WINDOWS).round().astype(int))
        xs.append(got[pick])
        ys.append(np.full(len(pick), langs.index(label)))
    if not langs:
        return None
    net = ByteCnn(langs)
    net.fit(np.concatenate(xs), np.concatenate(ys))
    return net


def identify(net: ByteCnn, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Mean log-probabilities, documents x languages; NaN for empty texts."""
    n = len(offsets) - 1
    total, weight, tables = np.zeros((n, len(net.langs))), np.zeros(n), net.fold()
    for x, row, size in windows(data, offsets):
        lp = net.log_probs(x, tables) * size[:, None]
        for k in range(len(net.langs)):
            total[:, k] += np.bincount(row, lp[:, k], minlength=n)
        weight += np.bincount(row, size, minlength=n)
    with np.errstate(invalid="ignore"):
        return total / weight[:, None]


def predict(docs: DataFrame, net: ByteCnn | None, id_col="doc_id", text_col="text") -> DataFrame:
    """(doc_id, lang_pred, prob): one row a document."""
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches):
        model = shared.value
        for b in batches:
            n = b.num_rows
            lang, prob = [None] * n, [None] * n
            if model is not None and n:
                lp = identify(model, *text_bytes(b.column(1)))
                e = np.exp(lp - lp.max(axis=1, keepdims=True))
                p = e / e.sum(axis=1, keepdims=True)
                best = lp.argmax(axis=1)
                for i in np.flatnonzero(~np.isnan(lp[:, 0])).tolist():
                    lang[i], prob[i] = model.langs[best[i]], round(float(p[i, best[i]]), 6)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang, pa.string()), pa.array(prob, pa.float64())], ["doc_id", "lang_pred", "prob"])

    base = docs.select(named(id_col).alias("doc_id"), named(text_col).alias("t"))
    return base.mapInArrow(run, with_id(base, "lang_pred string, prob double"))


def op2(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    return predict(docs, train(docs))
