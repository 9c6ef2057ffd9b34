"""Quality classifier: attention-based multiple-instance learning.

A text is a bag of passages of ``PASSAGE`` characters. Every passage is
encoded by the shares of its character classes and of their 2-grams (word
shapes, punctuation habits, symbol noise, casing) and by how well it
compresses (repetition). A small network embeds each passage; gated attention
weighs the passages of a text, softmax(w . (tanh(V h) * sigmoid(U h))); the
weighted sum is the text's representation, which a logistic unit scores.
Labels exist for texts only: the attention weights are learned from them.

Fitting uses a bounded sample, about ``SAMPLE`` labelled texts of each class;
classes are weighted back to their true shares, so scores are probabilities.
A few hundred full-batch Adam steps on at most 2 * SAMPLE * MAX_FIT_PASSAGES
passages run in numpy on the driver. Scoring encodes every passage of every
text, in Arrow batches; the model (a few kB) travels with the closure.

Edge cases: a null or empty text is one empty passage (all shares 0); very
long texts are read whole; without labels of both classes the score is the
share of the class that is there (0.5 without any); repeated rows are scored
alike; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import labelled_sample, store

SAMPLE = 2500
MAX_FIT_PASSAGES = 24      # passages of a long text used in fitting, evenly spaced (scoring uses all)
PASSAGE = 512              # characters
HIDDEN, ATTENTION = 16, 8
STEPS, RATE, DECAY = 300, 0.02, 1e-4
THRESHOLD = 0.7

_KINDS = 12
FEATURES = _KINDS + _KINDS * _KINDS + 3


def _class_table() -> np.ndarray:
    """Class of every code point below 0x10000; others count as class 11."""
    import unicodedata

    t = np.full(0x10001, 11, np.uint8)
    for c in range(0x10000):
        k = unicodedata.category(chr(c))
        t[c] = {"Ll": 0, "Lu": 1, "Nd": 2, "Zs": 3, "Lo": 10, "Lm": 10, "Mn": 10}.get(k, 9 if k[0] in "PS" else 11)
    for chars, k in (("\n", 4), (".", 5), (",;:", 6), ("!?", 7), ("#*$%&|<>", 8), ("\t\r", 3)):
        for ch in chars:
            t[ord(ch)] = k
    return t


_TABLE: list[np.ndarray] = []


def encode(text: str | None) -> np.ndarray:
    """passages x FEATURES of a text."""
    import zstandard

    if not _TABLE:
        _TABLE.append(_class_table())
    text = text or ""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    n = len(codes)
    passages = max(1, -(-n // PASSAGE))
    if passages > 1 and n % PASSAGE and n % PASSAGE < PASSAGE // 4:
        passages -= 1                      # a short rest belongs to the last passage
    kind = _TABLE[0][np.minimum(codes, 0x10000)].astype(np.int64)
    where = np.minimum(np.arange(n) // PASSAGE, passages - 1)
    size = np.maximum(np.bincount(where, minlength=passages), 1)[:, None]
    one = np.bincount(where * _KINDS + kind, minlength=passages * _KINDS).reshape(passages, -1)
    two = np.bincount(where[:-1] * _KINDS ** 2 + kind[:-1] * _KINDS + kind[1:],
                      minlength=passages * _KINDS ** 2).reshape(passages, -1) if n > 1 else np.zeros((1, _KINDS ** 2))
    pack = zstandard.ZstdCompressor(level=1, write_content_size=False, write_checksum=False).compress
    ends = [PASSAGE * (i + 1) for i in range(passages - 1)] + [n]
    ratio = np.empty((passages, 1))
    begin = 0
    for i, end in enumerate(ends):
        raw = text[begin:end].encode("utf-8", "surrogatepass")
        ratio[i] = len(pack(raw)) / (len(raw) + 24) if raw else 0.0
        begin = end
    doc = np.full((passages, 1), np.log1p(n) / 10)
    return np.hstack([one / size, two / size, ratio, np.log1p(size) / 10, doc]).astype(np.float32)


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    p: dict[str, np.ndarray] = field(default_factory=dict)
    constant: float | None = None

    def passages(self, x: np.ndarray) -> tuple[np.ndarray, ...]:
        x = (x - self.mean) * self.scale
        h = np.tanh(x @ self.p["W"] + self.p["b"])
        t, g = np.tanh(h @ self.p["V"]), 1 / (1 + np.exp(-(h @ self.p["U"])))
        return x, h, t, g, (t * g) @ self.p["w"]

    def score(self, x: np.ndarray) -> float:
        if self.constant is not None:
            return self.constant
        _, h, _, _, e = self.passages(x)
        a = np.exp(e - e.max())
        z = (a / a.sum()) @ h
        return float(1 / (1 + np.exp(-np.clip(z @ self.p["o"] + self.p["c"][0], -30, 30))))


def train(bags: list[np.ndarray], y: np.ndarray, importance: np.ndarray, steps: int = STEPS) -> Model:
    """Fit the network to bags (passages x FEATURES) and their labels."""
    x = np.vstack(bags).astype(np.float64)
    start = np.cumsum([0] + [len(b) for b in bags[:-1]])
    bag = np.repeat(np.arange(len(bags)), [len(b) for b in bags])
    m = Model(x.mean(0), 1 / (x.std(0) + 0.01))
    r = np.random.default_rng(7)
    m.p = {"W": r.normal(0, FEATURES ** -0.5, (FEATURES, HIDDEN)), "b": np.zeros(HIDDEN),
           "V": r.normal(0, HIDDEN ** -0.5, (HIDDEN, ATTENTION)), "U": r.normal(0, HIDDEN ** -0.5, (HIDDEN, ATTENTION)),
           "w": np.zeros(ATTENTION), "o": r.normal(0, 0.1, HIDDEN), "c": np.zeros(1)}
    first = {k: np.zeros_like(v) for k, v in m.p.items()}
    second = {k: np.zeros_like(v) for k, v in m.p.items()}
    for step in range(1, steps + 1):
        xs, h, t, g, e = m.passages(x)
        a = np.exp(e - np.maximum.reduceat(e, start)[bag])
        a /= np.add.reduceat(a, start)[bag]
        z = np.add.reduceat(a[:, None] * h, start, axis=0)
        q = 1 / (1 + np.exp(-np.clip(z @ m.p["o"] + m.p["c"][0], -30, 30)))
        d = importance * (q - y) / len(y)                         # d loss / d logit
        dz = d[bag, None] * m.p["o"][None, :]
        along = (dz * h).sum(1)
        de = a * (along - np.add.reduceat(a * along, start)[bag])   # through the softmax of each bag
        dtg = de[:, None] * m.p["w"][None, :]
        dt, dg = dtg * g * (1 - t ** 2), dtg * t * g * (1 - g)
        dh = (a[:, None] * dz + dt @ m.p["V"].T + dg @ m.p["U"].T) * (1 - h ** 2)
        grad = {"W": xs.T @ dh, "b": dh.sum(0), "V": h.T @ dt, "U": h.T @ dg, "w": (t * g).T @ de,
                "o": z.T @ d, "c": np.array([d.sum()])}
        for k, gr in grad.items():
            gr = gr + DECAY * m.p[k]
            first[k] = 0.9 * first[k] + 0.1 * gr
            second[k] = 0.999 * second[k] + 0.001 * gr ** 2
            m.p[k] = m.p[k] - RATE * (first[k] / (1 - 0.9 ** step)) / (np.sqrt(second[k] / (1 - 0.999 ** step)) + 1e-8)
    return m


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit to labels (doc_id, quality) on a bounded sample of ``docs``."""
    sample, totals = labelled_sample(docs, labels, "quality", {0: SAMPLE, 1: SAMPLE})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for t in batch.column(0).to_pylist():
                x = encode(t)
                if len(x) > MAX_FIT_PASSAGES:
                    x = x[np.linspace(0, len(x) - 1, MAX_FIT_PASSAGES).round().astype(int)]
                out.append(x.astype(np.float16).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(out, pa.binary())], names=["y", "x"])

    kind = dict(sample.dtypes)["y"]
    rows = store(sample.mapInArrow(run, f"y {kind}, x binary"), "quality-sample").orderBy("y", F.xxhash64("x")).collect()
    y = np.array([r["y"] for r in rows], float)
    if len(set(y)) < 2:
        return Model(np.zeros(FEATURES), np.ones(FEATURES), constant=float(y[0]) if len(y) else 0.5)
    seen = Counter(y.tolist())
    weight = np.array([totals[int(v)] / seen[v] for v in y]) * len(y) / sum(totals.values())
    bags = [np.frombuffer(r["x"], np.float16).reshape(-1, FEATURES) for r in rows]
    return train(bags, y, weight)


def score(docs: DataFrame, model: Model, extra: Column) -> DataFrame:
    """doc_id, extra, score, predicted, n_passages of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p, n = [], []
            for t in batch.column(0).to_pylist():
                x = encode(t)
                p.append(model.score(x))
                n.append(len(x))
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), batch.column(2), pa.array(p, pa.float64()),
                 pa.array([int(v >= THRESHOLD) for v in p], pa.int32()), pa.array(n, pa.int64())],
                names=["doc_id", "extra", "score", "predicted", "n_passages"])

    return docs.select("text", "doc_id", extra.alias("extra")).mapInArrow(
        run, "doc_id bigint, extra boolean, score double, predicted int, n_passages bigint")
