"""Quality by attention-based multiple-instance learning (operator 6).

A document is a bag of passages (all of its text, in pieces of
``PASSAGE_BYTES``). Every passage is encoded: how often each class of character
follows each other one, and how its words repeat. A gated attention network
learns from document labels alone which passages count:

    h = tanh(E x),  a = softmax(w . (tanh(V h) * sigmoid(U h))),  p = sigmoid(c . sum(a h) + b)

and a document's score is that of its attention-weighted passage.

The network is fitted on the driver on a bounded sample of labelled documents
(``train_docs``, drawn by a hash of the id); scoring reads every whole text on
the executors, passage by passage. Only the text is an input of a score.

Defined cases: a null or empty text is one empty passage; repeated documents
get equal scores; a labelled document with several labels counts as the greatest;
null labels are left out; without labels of both kinds all scores are the share
of label 1 (0.5 if there is none); columns named score or predicted are
replaced, others stay.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradewind.llm.common import read

PASSAGE_BYTES = 512
TRAIN_DOCS = 4000
HIDDEN, GATE, STEPS, BATCH, RATE, DECAY = 24, 12, 300, 256, 0.01, 1e-4
CUT = 0.3

# Character classes over bytes: common marks by themselves, the rest by kind.
_MARKS = b" \n.,!|%$*#&"
_KINDS = len(_MARKS) + 5


def _byte_classes() -> bytes:
    def of(b: int) -> int:
        if b in _MARKS:
            return _MARKS.index(b)
        c = chr(b)
        kinds = (c.islower() and b < 128, c.isupper() and b < 128, c.isdigit() and b < 128, b >= 128)
        return len(_MARKS) + (kinds.index(True) if any(kinds) else 4)
    return bytes(map(of, range(256)))


_CLASSES = _byte_classes()
_ODD = 0x9E3779B97F4A7C15
FEATURES = _KINDS * _KINDS + 5


def passages(text: bytes | None) -> np.ndarray:
    """One row of features for each passage of the text."""
    data = text or b""
    n, size = len(data), PASSAGE_BYTES
    count = max(1, -(-n // size))
    x = np.zeros((count, FEATURES), np.float32)
    if not n:
        return x
    c = np.frombuffer(data.translate(_CLASSES), np.uint8).astype(np.int64)
    at = np.arange(n) // size
    pairs = np.bincount(at[1:] * _KINDS**2 + c[:-1] * _KINDS + c[1:], minlength=count * _KINDS**2)
    length = np.bincount(at, minlength=count)[:, None]
    x[:, :_KINDS**2] = np.sqrt(pairs.reshape(count, -1) / length)
    # Words by a hash: the sum of their bytes, weighted by powers of the place.
    inside = c > 1
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if len(start):
        span = end - start
        firsts = np.cumsum(span) - span
        place = np.arange(span.sum()) - np.repeat(firsts, span)
        low = np.frombuffer(data.lower(), np.uint8)[inside].astype(np.uint64) + np.uint64(1)
        power = np.cumprod(np.full(span.max(), _ODD, np.uint64), dtype=np.uint64)
        word = np.add.reduceat(low * power[place], firsts)
        p = at[start]
        words = np.maximum(1, np.bincount(p, minlength=count))
        order = np.lexsort((p, word))
        w, q = word[order], p[order]
        new = np.concatenate([[True], w[1:] != w[:-1]])
        distinct = new | np.concatenate([[True], q[1:] != q[:-1]])
        runs = np.diff(np.append(np.flatnonzero(new), len(w)))
        x[:, -5] = np.bincount(p, weights=span, minlength=count) / words / 8
        x[:, -4] = np.sqrt(np.bincount(p, weights=span.astype(float) ** 2, minlength=count) / words) / 8
        x[:, -3] = np.bincount(q[distinct], minlength=count) / words  # distinct in the passage
        x[:, -2] = np.bincount(q[new], minlength=count) / words  # not in an earlier passage
        x[:, -1] = np.log(runs.max()) / np.log(len(word) + 1)
    return x


def _sigmoid(x):
    return 0.5 * (1 + np.tanh(0.5 * x))


@dataclass
class Attention:
    """The fitted network; without weights, a constant."""
    mean: np.ndarray | None
    scale: np.ndarray | None
    weights: dict[str, np.ndarray] | None
    prior: float

    def forward(self, x: np.ndarray, starts: np.ndarray, w: dict[str, np.ndarray]):
        """x: passages of several documents; starts: each document's first."""
        bag = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(x))))
        h = np.tanh(x @ w["E"] + w["e"])
        t, s = np.tanh(h @ w["V"]), _sigmoid(h @ w["U"])
        z = (t * s) @ w["w"]
        z = np.exp(z - np.maximum.reduceat(z, starts)[bag])
        a = z / np.add.reduceat(z, starts)[bag]
        m = np.add.reduceat(a[:, None] * h, starts, axis=0)
        return _sigmoid(m @ w["c"] + w["b"][0]), (bag, h, t, s, a, m)

    def score(self, bags: list[np.ndarray]) -> np.ndarray:
        if self.weights is None:
            return np.full(len(bags), self.prior)
        starts = np.concatenate([[0], np.cumsum([len(b) for b in bags])[:-1]]).astype(np.int64)
        x = (np.concatenate(bags) - self.mean) / self.scale
        return self.forward(x, starts, self.weights)[0]


def fit(bags: list[np.ndarray], labels: np.ndarray, seed: int = 6) -> Attention:
    """Adam on the cross entropy of document labels."""
    labels = np.asarray(labels, dtype=np.float64)
    prior = float(labels.mean()) if len(labels) else 0.5
    if not len(labels) or prior in (0.0, 1.0):
        return Attention(None, None, None, prior)
    rng = np.random.default_rng(seed)
    every = np.concatenate(bags).astype(np.float64)
    mean, scale = every.mean(axis=0), every.std(axis=0) + 0.02
    model = Attention(mean, scale, None, prior)
    of = lambda *shape: rng.normal(0, shape[0] ** -0.5, shape)
    w = {"E": of(FEATURES, HIDDEN), "e": np.zeros(HIDDEN), "V": of(HIDDEN, GATE), "U": of(HIDDEN, GATE),
         "w": of(GATE), "c": of(HIDDEN), "b": np.array([np.log(prior / (1 - prior))])}
    m1, m2 = ({k: np.zeros_like(v) for k, v in w.items()} for _ in range(2))
    norm = [((b - mean) / scale).astype(np.float32) for b in bags]
    for step in range(1, STEPS + 1):
        pick = rng.choice(len(bags), min(BATCH, len(bags)), replace=False)
        own = [norm[i] for i in pick]
        starts = np.concatenate([[0], np.cumsum([len(b) for b in own])[:-1]]).astype(np.int64)
        x = np.concatenate(own)
        p, (bag, h, t, s, a, m) = model.forward(x, starts, w)
        d = (p - labels[pick]) / len(pick)
        dm = d[:, None] * w["c"]
        dh = a[:, None] * dm[bag]
        da = (h * dm[bag]).sum(axis=1)
        dz = a * (da - np.add.reduceat(a * da, starts)[bag])
        dt, ds = dz[:, None] * w["w"] * s * (1 - t * t), dz[:, None] * w["w"] * t * s * (1 - s)
        dh = (dh + dt @ w["V"].T + ds @ w["U"].T) * (1 - h * h)
        g = {"E": x.T @ dh, "e": dh.sum(axis=0), "V": h.T @ dt, "U": h.T @ ds, "w": (t * s).T @ dz,
             "c": m.T @ d, "b": np.array([d.sum()])}
        for k in w:
            g[k] = g[k] + DECAY * w[k]
            m1[k] = 0.9 * m1[k] + 0.1 * g[k]
            m2[k] = 0.999 * m2[k] + 0.001 * g[k] ** 2
            rate = RATE * min(1.0, 2 * (1 - step / (STEPS + 1)))
            w[k] = w[k] - rate * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)
    model.weights = w
    return model


def held_out(id_col) -> F.Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_sample(docs: DataFrame, labels: DataFrame, label_col: str, n: int, id_col: str = "doc_id") -> DataFrame:
    """(id, label, text) of at most ``n`` labelled documents that are not held out, the
    smallest by a hash of the id."""
    known = (labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
             .groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max(label_col).cast("int").alias("label"))
             .orderBy(F.xxhash64("id"), "id").limit(n))
    d = docs.select(docs[id_col].cast("long").alias("id"), docs["text"].cast("binary").alias("text"))
    return d.join(F.broadcast(known), "id")  # at most n ids


def train(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS) -> Attention:
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([passages(t).tobytes() for t in texts])

    sample = training_sample(docs, labels, "quality", train_docs)
    rows = sample.select("id", "label", F.pandas_udf(encode, "binary")("text").alias("x")).collect()
    rows.sort(key=lambda r: (r["id"], r["label"], r["x"]))
    return fit([np.frombuffer(r["x"], np.float32).reshape(-1, FEATURES) for r in rows],
               np.array([r["label"] for r in rows]))


def score_quality(docs: DataFrame, model: Attention, text_col: str = "text") -> DataFrame:
    """``docs`` with score (0 to 1, higher: better) and predicted (1 if score >= 0.3)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few thousand weights

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        net = shared.value
        for texts in batches:
            out = []
            for at in range(0, len(texts), 64):
                out.append(net.score([passages(t) for t in texts.iloc[at:at + 64]]))
            yield pd.Series(np.concatenate(out) if out else np.zeros(0))

    scored = docs.withColumn("score", F.pandas_udf(run, "double")(docs[text_col].cast("binary")))
    return scored.withColumn("predicted", (F.col("score") >= CUT).cast("int"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: every document scored by the network fitted on the labels not held out."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, read(spark, sf_dir, "labels").select("doc_id", "quality"))
    scored = score_quality(docs, model)
    return scored.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"),
                         "score", "predicted")
