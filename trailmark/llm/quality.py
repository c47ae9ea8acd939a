"""Quality: attention-based multiple-instance learning, trained in numpy.

A text is a bag of passages of ``PASSAGE`` words.  Each passage is encoded (its make-up of characters and words, then a learned
layer); gated attention weighs the passages, and the weighted sum is scored.  Only documents have labels:
attention learns by itself which passages tell.  Training takes a bounded sample (``SAMPLE`` rows and ``SAMPLE_BYTES``
of text of each label) on the driver; scoring is a map over all texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import doc_rows, public_id
from .labelled import remainder, sample

PASSAGE, EPOCHS, BATCH, RATE = 64, 60, 64, 0.01
SAMPLE, SAMPLE_BYTES = 2500, 24_000_000
HIDDEN, GATE = 24, 16
_classes = [b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".", b",", b"!?", b"#*$%&", b"|<>", b"@/:-_", b"\n"]
_class = np.full(256, len(_classes), np.uint8)  # other ASCII
_class[128:] = len(_classes) + 1
for _k, _chars in enumerate(_classes):
    _class[list(_chars)] = _k
_white = np.zeros(256, bool)
_white[[9, 10, 11, 12, 13, 32]] = True
_class[32] = len(_classes) + 2
KINDS = len(_classes) + 3
FEATURES = KINDS + 5


def passages(text: str) -> np.ndarray:
    """A row of features for each passage; an empty text is one passage of zeros."""
    data = text.encode("utf-8")
    words = data.split()
    if not words:
        return np.zeros((1, FEATURES), np.float32)
    buf = np.frombuffer(data, np.uint8)
    inside = ~_white[buf]
    first = np.flatnonzero(inside & ~np.concatenate([[False], inside[:-1]]))[::PASSAGE]
    n = len(first)
    size = np.diff(np.append(first, len(buf)))
    of = np.repeat(np.arange(n), size)
    kinds = np.bincount(of * KINDS + _class[buf[first[0] :]], minlength=n * KINDS).reshape(n, KINDS)
    out = np.zeros((n, FEATURES), np.float32)
    out[:, :KINDS] = kinds / size[:, None]
    for k in range(n):
        own = words[k * PASSAGE : (k + 1) * PASSAGE]
        m = len(own)
        out[k, KINDS] = len(set(own)) / m
        out[k, KINDS + 1] = sum(map(bytes.__eq__, own, own[1:])) / m
        out[k, KINDS + 2] = sum(map(len, own)) / m / 10
        out[k, KINDS + 3] = m / PASSAGE
    out[:, KINDS + 4] = np.log1p(len(words)) / 10
    return out


class Attention:
    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)
        draw = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape)
        self.mean, self.scale = np.zeros(FEATURES), np.ones(FEATURES)
        self.p = {"e": draw(FEATURES, HIDDEN), "b": np.zeros(HIDDEN), "v": draw(HIDDEN, GATE), "u": draw(HIDDEN, GATE)}
        self.p |= {"w": draw(GATE), "c": draw(HIDDEN), "o": np.zeros(1)}

    def _forward(self, x: np.ndarray, starts: np.ndarray) -> dict:
        p = self.p
        sizes = np.diff(np.append(starts, len(x)))
        x = np.clip((x - self.mean) / self.scale, -8, 8)
        h = np.tanh(x @ p["e"] + p["b"])
        t, s = np.tanh(h @ p["v"]), 1 / (1 + np.exp(-(h @ p["u"])))
        a = (t * s) @ p["w"]
        a = np.exp(a - np.repeat(np.maximum.reduceat(a, starts), sizes))
        a /= np.repeat(np.add.reduceat(a, starts), sizes)
        z = np.add.reduceat(a[:, None] * h, starts, axis=0)
        return {"x": x, "h": h, "t": t, "s": s, "a": a, "z": z, "sizes": sizes, "logit": z @ p["c"] + p["o"][0]}

    def scores(self, bags: list[np.ndarray]) -> np.ndarray:
        starts = np.cumsum([len(b) for b in bags]) - [len(b) for b in bags]
        z = self._forward(np.concatenate(bags), starts)["logit"]
        return 1 / (1 + np.exp(-np.clip(z, -50, 50)))

    def fit(self, bags: list[np.ndarray], y: np.ndarray, seed: int = 1) -> None:
        every = np.concatenate(bags)
        self.mean, self.scale = every.mean(0), every.std(0) + 1e-3
        rng, p = np.random.default_rng(seed), self.p
        m1 = {k: np.zeros_like(v) for k, v in p.items()}
        m2 = {k: np.zeros_like(v) for k, v in p.items()}
        step = 0
        for _ in range(EPOCHS):
            order = rng.permutation(len(bags))
            for k in range(0, len(order), BATCH):
                batch = order[k : k + BATCH]
                sizes = np.array([len(bags[i]) for i in batch])
                starts = np.cumsum(sizes) - sizes
                f = self._forward(np.concatenate([bags[i] for i in batch]), starts)
                d = (1 / (1 + np.exp(-np.clip(f["logit"], -30, 30))) - y[batch]) / len(batch)
                dz = np.repeat(d, sizes)[:, None] * p["c"]
                da = (dz * f["h"]).sum(1)
                da = f["a"] * (da - np.repeat(np.add.reduceat(f["a"] * da, starts), sizes))
                dg = da[:, None] * p["w"]
                dt, ds = dg * f["s"] * (1 - f["t"] ** 2), dg * f["t"] * f["s"] * (1 - f["s"])
                dh = (f["a"][:, None] * dz + dt @ p["v"].T + ds @ p["u"].T) * (1 - f["h"] ** 2)
                grad = {"e": f["x"].T @ dh, "b": dh.sum(0), "v": f["h"].T @ dt, "u": f["h"].T @ ds}
                grad |= {"w": (f["t"] * f["s"]).T @ da, "c": f["z"].T @ d, "o": d.sum(keepdims=True)}
                step += 1
                for name, g in grad.items():
                    g = g + 1e-4 * p[name]
                    m1[name] = 0.9 * m1[name] + 0.1 * g
                    m2[name] = 0.999 * m2[name] + 0.001 * g * g
                    p[name] -= RATE * (m1[name] / (1 - 0.9**step)) / (np.sqrt(m2[name] / (1 - 0.999**step)) + 1e-8)


def train(docs: DataFrame, labels: DataFrame, modulus: int, held: int, size: int = SAMPLE) -> Attention:
    rows = sample(docs, labels, "quality", remainder("doc_id", modulus) != held, size, SAMPLE_BYTES)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [passages(t).tobytes() for t in b.column("text").to_pylist()]
            cols = [b.column("doc_id"), b.column("label"), pa.array(found, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "label", "bag"])

    got = rows.mapInArrow(encode, "doc_id long, label int, bag binary").toPandas().sort_values("doc_id")
    net = Attention()
    y = got["label"].to_numpy(np.float64)
    if len(set(y.tolist())) < 2:
        net.p["c"][:] = 0
        net.p["o"][0] = -4.0 if len(y) and not y[0] else 4.0
    else:
        net.fit([np.frombuffer(x, np.float32).reshape(-1, FEATURES) for x in got["bag"]], y)
    return net


def quality(docs: DataFrame, labels: DataFrame, modulus: int = 3, held: int = 1, size: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted of every row of ``docs``, from its whole text.

    Null and empty texts are scored as one empty passage.  A null id is not held out.  Without labels of both kinds
    every score is the same.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, modulus, held, size))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = model.value
        for b in batches:
            texts = b.column("text").to_pylist()
            out = [net.scores([passages(t) for t in texts[k : k + 500]]) for k in range(0, len(texts), 500)]
            scores = np.concatenate(out) if out else np.empty(0)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(scores)], names=["doc_id", "score"])

    scored = doc_rows(docs).mapInArrow(score, "doc_id long, score double").withColumn("doc_id", public_id())
    return scored.select(
        "doc_id",
        F.coalesce(remainder("doc_id", modulus) == held, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
