"""Toxicity by a subsequence string-kernel SVM with Nyström landmarks (operator 7).

The kernel compares two short windows of text by the subsequences of three and
four letters that they share. Letters may be apart, by up to two others each in
three letters and by one in four, and each letter in between multiplies a match
by ``DECAY``. So an insult keeps most of its value when characters are inserted
or its letters are spread with dots; with three or more characters between all
its letters it shares nothing with its plain form.

Training (on the driver, over a bounded sample of labelled documents): letters
frequent in toxic and rare in clean documents show where the toxic sentences of
a toxic document lie (labels are of documents, so sentences have to be found);
windows from there, some with characters inserted, are positive, windows from
clean documents negative. A squared-hinge SVM is solved
on Nyström features K(x, landmarks) · K(landmarks)^(-1/2); the clean windows
that score highest are added and it is solved again. The threshold is set on
sampled documents that training did not see.

Scoring: K(x, l) is a sum over subsequences, so the SVM over landmarks is one
weight for each subsequence. A window's score is the sum of those weights over
its letters, a document's the highest of any of its windows, over whole texts.
All windows have one length, which stands in for normalising the kernel.

Defined cases: null and empty texts score null and are not toxic; without
labels of both kinds nothing is toxic; ids with several labels are toxic if any
says so, null labels are ignored; rows with one id get one result each, and
train as one document; very long texts are scored whole; an empty table gives
an empty result; ids may have any type, other columns any name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import doc_chunks, hash60, map_rows, named, read, slices, text_bytes, with_id

#: Bounds of the labelled sample, by label.
TRAIN_TOXIC, TRAIN_CLEAN = 800, 1600
DECAY = 0.5
#: Start positions that make one window.
SPAN = 16
#: Separators put between documents, more than any subsequence and window spans.
PAD = 32
LANDMARKS = 240
GAPS3 = [(a, b) for a in range(3) for b in range(3)]
GAPS4 = [(a, b, c) for a in range(2) for b in range(2) for c in range(2)]
CODES3, CODES4 = 1 << 15, 1 << 20
SEED = 11


def _classes() -> np.ndarray:
    """32 byte classes: 0 separators, 1-26 letters without case, 27 digits, 28-31 other letters; 255 is skipped."""
    c = np.zeros(256, np.uint8)
    for b in range(256):
        if 65 <= b <= 90 or 97 <= b <= 122:
            c[b] = (b | 32) - 96
        elif 48 <= b <= 57:
            c[b] = 27
        elif 128 <= b < 192:
            c[b] = 28 + ((b & 31) * 7 % 4)
        elif b >= 192:
            c[b] = 255
    return c


CLASSES = _classes()


def letters(data: np.ndarray) -> np.ndarray:
    c = CLASSES[data]
    return c[c != 255]


def padded(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Classes of all documents with PAD separators after each, and where each starts."""
    c = CLASSES[data]
    keep = c != 255
    upto = np.zeros(len(data) + 1, np.int64)
    np.cumsum(keep, out=upto[1:])
    size = np.diff(upto[offsets])
    start = np.r_[0, np.cumsum(size + PAD)]
    out = np.zeros(int(start[-1]) + PAD, np.int32)
    c = c[keep]
    shift = np.repeat(start[:-1] - (np.cumsum(size) - size), size)
    out[np.arange(len(c)) + shift] = c
    return out, start[:-1]


def codes(x: np.ndarray):
    """Yields (order, codes by start position, weight) for each pattern of gaps; the tail lacks room and is left out."""
    n = x.shape[-1] - 8
    pair = [(x[..., :n] << 5) | x[..., 1 + g : 1 + g + n] for g in range(3)]
    for a, b in GAPS3:
        at = 2 + a + b
        triple = (pair[a] << 5) | x[..., at : at + n]
        yield 3, triple, DECAY ** (a + b)
        if a < 2 and b < 2:
            for c in range(2):
                at4 = at + 1 + c
                yield 4, (triple << 5) | x[..., at4 : at4 + n], DECAY ** (a + b + c)


def position_scores(x: np.ndarray, w3: np.ndarray, w4: np.ndarray) -> np.ndarray:
    total = np.zeros(x.shape[-1] - 8, np.float64)
    for order, code, weight in codes(x):
        total += (w3 if order == 3 else w4).take(code) * np.float32(weight)
    return total


class ToxicModel:
    def __init__(self, w3: np.ndarray, w4: np.ndarray, bias: float, threshold: float = 0.0):
        self.w3, self.w4, self.bias, self.threshold = w3, w4, bias, threshold

    def window_scores(self, x: np.ndarray) -> np.ndarray:
        s = np.zeros(len(x) - 7, np.float64)
        np.cumsum(position_scores(x, self.w3, self.w4), out=s[1:])
        return s[SPAN:] - s[:-SPAN]

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Highest window score of every document; NaN for empty ones."""
        out = np.full(len(offsets) - 1, np.nan)
        limit = 1 << 18
        for i, j in doc_chunks(offsets, limit):
            lo, hi = int(offsets[i]), int(offsets[j])
            if hi == lo:
                continue
            if j - i == 1 and hi - lo > 2 * limit:  # pieces overlap by more than a window
                best = -np.inf
                for p in range(lo, hi, limit):
                    piece = data[p : min(hi, p + limit + 4 * PAD)]
                    x, _ = padded(piece, np.array([0, len(piece)]))
                    best = max(best, float(self.window_scores(np.r_[np.zeros(SPAN, np.int32), x]).max()))
                out[i] = best + self.bias
                continue
            x, start = padded(data[lo:hi], offsets[i : j + 1] - lo)
            w = self.window_scores(np.r_[np.zeros(SPAN, np.int32), x])
            full = np.diff(offsets[i : j + 1]) > 0
            out[i:j] = np.where(full, np.maximum.reduceat(w, start) + self.bias, np.nan)
        return out


def _window(x: np.ndarray, at: int) -> np.ndarray:
    """Classes of one training window that starts at ``at``, with separators beyond the text's ends."""
    out = np.zeros(SPAN + 8, np.int32)
    lo, hi = max(at, 0), min(at + SPAN + 8, len(x))
    if hi > lo:
        out[lo - at : hi - at] = x[lo:hi]
    return out


def _spread(x: np.ndarray, rng) -> np.ndarray:
    """A window with characters inserted between its letters: one kind everywhere, or odd ones here and there."""
    filler, everywhere = rng.choice([0, 0, 27, int(rng.integers(1, 27))]), rng.random() < 0.5
    out = []
    for v in x.tolist():
        out.append(v)
        if everywhere or rng.random() < 0.3:
            out.append(filler if everywhere else int(rng.integers(0, 28)))
    return np.array(out[: SPAN + 8], np.int32)


class _Kernel:
    """Kernel values between windows and a fixed set of landmarks."""

    def __init__(self, marks: np.ndarray):
        code, value = self.features(marks)
        self.vocabulary = np.unique(code)
        self.matrix = np.zeros((len(self.vocabulary) + 1, len(marks)), np.float32)
        at = np.searchsorted(self.vocabulary, code)
        np.add.at(self.matrix, (at, np.broadcast_to(np.arange(len(marks))[:, None], at.shape)), value)
        self.norm = np.sqrt((self.matrix**2).sum(axis=0))
        self.matrix /= self.norm

    @staticmethod
    def features(windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        code, value = [], []
        for order, c, w in codes(windows):
            code.append(c + (CODES3 if order == 4 else 0))
            value.append(np.full(c.shape, w, np.float32))
        return np.concatenate(code, axis=1), np.concatenate(value, axis=1)

    def __call__(self, windows: np.ndarray) -> np.ndarray:
        out = np.empty((len(windows), self.matrix.shape[1]), np.float32)
        for i in range(0, len(windows), 64):
            code, value = self.features(windows[i : i + 64])
            at = np.searchsorted(self.vocabulary, code)
            at[self.vocabulary[np.minimum(at, len(self.vocabulary) - 1)] != code] = len(self.vocabulary)
            for k in range(len(code)):
                known = at[k] < len(self.vocabulary)
                out[i + k] = value[k][known] @ self.matrix[at[k][known]]
        return out

    def weights(self, beta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Weight of every subsequence under sum of beta times kernel with the landmarks."""
        w = np.zeros(CODES3 + CODES4, np.float32)
        w[self.vocabulary] = self.matrix[:-1] @ beta
        return w[:CODES3].copy(), w[CODES3:].copy()


def _svm(z: np.ndarray, y: np.ndarray, weight: np.ndarray, c: float = 1.0) -> tuple[np.ndarray, float]:
    """Squared-hinge SVM by Newton steps on the rows within the margin."""
    a = np.c_[z, np.ones(len(z))].astype(np.float64)
    w = np.zeros(a.shape[1])
    ridge = np.eye(a.shape[1])
    ridge[-1, -1] = 1e-6
    for _ in range(30):
        inside = y * (a @ w) < 1
        ai, ci = a[inside], (c * weight)[inside]
        new = np.linalg.solve(ridge + (ai * ci[:, None]).T @ ai, (ai * ci[:, None]).T @ y[inside])
        if np.allclose(new, w, atol=1e-7):
            break
        w = new
    return w[:-1], float(w[-1])


def fit(toxic: list[str], clean: list[str], seed: int = SEED) -> ToxicModel | None:
    """Model from texts of both kinds; every third text is kept for the threshold."""
    rng = np.random.default_rng(seed)
    enc = lambda ts: [letters(np.frombuffer(t.encode(), np.uint8)).astype(np.int32) for t in ts]
    pos, neg = enc([t for i, t in enumerate(toxic) if i % 3 or len(toxic) < 6]), enc([t for i, t in enumerate(clean) if i % 3 or len(clean) < 6])
    if not pos or not neg:
        return None
    odds = np.zeros(CODES4)
    counts = []
    for group in (pos, neg):
        n = np.zeros(CODES4, np.int32)
        for x in group:
            x = np.r_[0, x, 0, 0, 0]
            n[np.unique((x[:-3] << 15) | (x[1:-2] << 10) | (x[2:-1] << 5) | x[3:])] += 1
        counts.append(n)
    a, b = counts
    often = a >= max(2, 0.004 * len(pos))
    odds[often] = np.log((a[often] + 0.5) / (len(pos) + 1)) - np.log((b[often] + 0.5) / (len(neg) + 1))
    odds = np.where(odds > 1, odds, 0)

    def best(x: np.ndarray, how_many: int, share: float) -> list[int]:
        """Starts of the windows that show the most toxic letters, none overlapping another."""
        p = np.r_[np.zeros(SPAN, np.int32), x, np.zeros(SPAN + 4, np.int32)]
        v = np.r_[0, np.cumsum(odds[(p[:-3] << 15) | (p[1:-2] << 10) | (p[2:-1] << 5) | p[3:]])]
        s = v[SPAN - 4 :] - v[: -(SPAN - 4)]
        out, top = [], s.max()
        for i in np.argsort(-s, kind="stable")[: 8 * how_many].tolist():
            if len(out) < how_many and s[i] > 0 and s[i] >= share * top and all(abs(i - j) >= SPAN for j in out):
                out.append(i)
        return [i - SPAN for i in out]

    plus = [_window(x, i) for x in pos for i in best(x, 3, 0.6)]
    minus = [_window(x, i) for x in neg for i in [*best(x, 2, 0.3), *rng.integers(-4, max(1, len(x) - 8), 4).tolist()]]
    if not plus or not minus:
        return None
    plus, minus = np.array(plus), np.array(minus)
    plus = np.concatenate([plus, np.array([_spread(x, rng) for x in plus])])
    k = LANDMARKS
    marks = np.concatenate([plus[rng.permutation(len(plus))[: 2 * k // 3]], minus[rng.permutation(len(minus))[: k // 3]]])
    kernel = _Kernel(np.unique(marks, axis=0))
    gram = kernel(np.unique(marks, axis=0)) / kernel.norm[:, None]
    e, v = np.linalg.eigh((gram + gram.T).astype(np.float64) / 2)
    root = v @ np.diag(1 / np.sqrt(np.maximum(e, 1e-4))) @ v.T
    kp, kn = kernel(plus), kernel(minus)
    model = None
    for _ in range(3):
        z = np.concatenate([kp, kn]) @ root
        y = np.r_[np.ones(len(kp)), -np.ones(len(kn))]
        weight = np.r_[np.full(len(kp), 1.0), np.full(len(kn), 1.0)]
        w, bias = _svm(z, y, weight)
        model = ToxicModel(*kernel.weights(root @ w), bias)
        hard = []
        for x in neg:
            p = np.r_[np.zeros(SPAN, np.int32), x, np.zeros(PAD + SPAN, np.int32)]
            s = model.window_scores(p) + bias
            i = int(s.argmax())
            if s[i] > -0.8:
                hard.append(_window(p, i))
        if not hard:
            break
        kn = np.concatenate([kn, kernel(np.array(hard))])
    held = [[t for i, t in enumerate(ts) if not i % 3 and t] for ts in (toxic, clean)]
    if len(toxic) < 6 or len(clean) < 6 or not all(held):
        held = [toxic, clean]
    sp, sn = (np.nan_to_num(_scores(model, ts), nan=-9.0) for ts in held)
    cand = np.unique(np.r_[sp, sn])
    cuts = (np.r_[cand[0] - 1, cand] + np.r_[cand, cand[-1] + 1]) / 2
    gain = [(sp >= t).mean() - 4 * (sn >= t).mean() for t in cuts]
    good = np.flatnonzero(np.isclose(gain, max(gain)))
    model.threshold = float(cuts[good[len(good) // 2]])
    return model


def _scores(model: ToxicModel, texts: list[str]) -> np.ndarray:
    return model.scores(*text_bytes(pa.array(texts, pa.string())))


def train(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", label_col="toxic") -> ToxicModel | None:
    """Fit on the documents with the smallest id hashes, at most TRAIN_TOXIC and TRAIN_CLEAN of each label."""
    said = labels.select(named(id_col).alias("id"), named(label_col).alias("y")).where("id is not null and y is not null").groupBy("id").agg(F.max("y").alias("y"))
    chosen: dict = {}
    for y, n in ((1, TRAIN_TOXIC), (0, TRAIN_CLEAN)):
        chosen |= {r.id: y for r in said.where(F.col("y") == y).orderBy(hash60(F.col("id")), "id").limit(n).collect()}
    if len(set(chosen.values())) < 2:
        return None
    rows = docs.select(named(id_col).alias("id"), named(text_col).alias("t")).where(F.col("id").isin(list(chosen))).groupBy("id").agg(F.min("t").alias("t")).collect()
    rows = sorted((r.id, r.t) for r in rows if r.t)
    return fit([t for i, t in rows if chosen[i]], [t for i, t in rows if not chosen[i]])


def score(docs: DataFrame, model: ToxicModel | None, id_col="doc_id", text_col="text") -> DataFrame:
    """(doc_id, score, toxic) of all documents."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for b in slices(batches):
            s = np.full(b.num_rows, np.nan) if m is None else m.scores(*text_bytes(b.column(1)))
            t = np.zeros(b.num_rows, bool) if m is None else s >= m.threshold
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, mask=np.isnan(s)), pa.array(t)], ["doc_id", "score", "toxic"])

    base = docs.select(named(id_col).alias("doc_id"), named(text_col).alias("t"))
    return base.mapInArrow(run, with_id(base, "score double, toxic boolean"))


def drop_toxic(docs: DataFrame, model: ToxicModel | None, text_col="text") -> DataFrame:
    """Rows of ``docs``, unchanged, that are not toxic. No shuffle."""
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def run(batches):
        m = shared.value
        for b in batches:
            if m is not None and b.num_rows:
                b = b.filter(pa.array(~(m.scores(*text_bytes(b.column(at))) >= m.threshold)))
            yield b

    return map_rows(docs, run, docs.schema.fields)


def op7(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    return score(docs, train(docs, read(spark, sf_dir, "labels")))
