"""Toxicity: a convolutional text classifier trained in numpy.

Words are hashed to embeddings: a word's is the sum of those of its whole, its first six and its first four
characters, where rows enough of the sample have them.  Filters of widths 1, 2 and 3 run over the whole text, their greatest values
are pooled and weighed.  The logit at which a text counts as toxic is calibrated by language on labelled rows that
the filters weren't trained on; the language is told from the text's words, never from a column.  Training
takes a bounded sample (``SAMPLE`` rows and ``SAMPLE_BYTES`` of text of each label) on the driver; scoring is a map over
all texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import doc_rows, public_id
from .labelled import remainder, sample

SAMPLE, SAMPLE_BYTES = 4000, 24_000_000
EPOCHS, BATCH, RATE = 10, 64, 0.02
#: Rows of the sample that must have a word or beginning for it to count, and the share of words left out while learning.
LEAST, DROP = 5, 0.3
#: What the share of clean texts counted as toxic costs, against the share of toxic ones missed.
WRONG = 4
SLOT_BITS, DIM, FILTERS, WIDTHS = 16, 16, 16, (1, 2, 3)
SLOTS, PARTS = 1 << SLOT_BITS, 3
REMEMBERED = 500_000
#: A-Z to lower case; ASCII characters that are neither letters nor digits to spaces; other bytes stay.
_plain = bytes((c + 32 if 65 <= c < 91 else c) if c > 127 or chr(c).isalnum() else 32 for c in range(256))


class _Slots(dict):
    """word -> three slots in one integer."""

    def __missing__(self, word: bytes) -> int:
        text = word.decode("utf-8", "replace")
        parts = [b"w" + word, *(b"p" + text[:k].encode() if len(text) >= k else b"" for k in (6, 4))]
        slots = [1 + xxhash.xxh64_intdigest(x, 3) % (SLOTS - 1) if x else 0 for x in parts]
        packed = slots[0] | slots[1] << SLOT_BITS | slots[2] << 2 * SLOT_BITS
        if len(self) < REMEMBERED:
            self[word] = packed
        return packed


_slots = _Slots()


def word_slots(text: str) -> np.ndarray:
    words = text.encode("utf-8").translate(_plain).split()
    return np.fromiter(map(_slots.__getitem__, words), np.int64, len(words))


def _padded(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All ids with slot 0 (a zero embedding) after each text, and where the texts start.  No text is empty then."""
    gap = np.zeros(max(WIDTHS), np.int64)
    out = [x for d in docs for x in (d, gap)]
    sizes = np.array([len(d) + len(gap) for d in docs])
    packed = np.concatenate([*out, gap])
    slots = np.stack([packed >> k * SLOT_BITS & SLOTS - 1 for k in range(PARTS)], 1)
    return slots, np.cumsum(sizes) - sizes


def _greatest(v: np.ndarray, starts: np.ndarray, w: int) -> np.ndarray:
    """Of each text the greatest values of windows of width w that end within its own zeros."""
    stops = np.append(starts[1:], len(v)) - w + 1
    bounds = np.column_stack([starts, stops]).ravel()
    return np.maximum.reduceat(v, bounds[:-1] if bounds[-1] == len(v) else bounds, axis=0)[::2]


class Network:
    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.embed = rng.normal(0, 1e-4, (SLOTS, DIM)).astype(np.float32)
        self.embed[0] = 0
        self.filters = {w: rng.normal(0, 0.3, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS}
        self.weights = rng.normal(0, 0.1, FILTERS * len(WIDTHS)).astype(np.float32)
        self.bias = np.zeros(1, np.float32)
        self.languages = np.zeros((SLOTS, 1), np.float32)
        self.cuts = np.zeros(1)

    def _values(self, w: int, x: np.ndarray, n: int) -> np.ndarray:
        return sum(x[k : k + n] @ self.filters[w][k] for k in range(w))

    def logits(self, docs: list[np.ndarray]) -> np.ndarray:
        ids, starts = _padded(docs)
        n = len(ids) - max(WIDTHS)
        x = sum(self.embed[ids[:, k]] for k in range(PARTS))
        pooled = [_greatest(self._values(w, x, n), starts, w) for w in WIDTHS]
        return np.maximum(np.concatenate(pooled, 1), 0) @ self.weights + self.bias[0]

    def language(self, docs: list[np.ndarray]) -> np.ndarray:
        ids, starts = _padded(docs)
        return np.add.reduceat(self.languages[ids[:, 0]], starts, axis=0).argmax(1)

    def scores(self, docs: list[np.ndarray]) -> np.ndarray:
        z = self.logits(docs) - self.cuts[self.language(docs)]
        return 1 / (1 + np.exp(-np.clip(z, -50, 50)))

    def fit(self, docs: list[np.ndarray], y: np.ndarray, seed: int = 1) -> None:
        rng = np.random.default_rng(seed)
        has = np.zeros(SLOTS, np.int64)
        for d in docs:
            has[np.unique(_padded([d])[0])] += 1
        rare = has < LEAST
        rare[0] = True
        self.embed[rare] = 0
        seen = {id(p): np.full(p.shape, 1e-6, np.float32) for p in (self.embed, self.weights, self.bias, *self.filters.values())}

        def move(p: np.ndarray, grad: np.ndarray, rows: np.ndarray | slice = slice(None)) -> None:
            g2 = seen[id(p)]
            g2[rows] += grad * grad
            p[rows] -= RATE * grad / np.sqrt(g2[rows])

        for _ in range(EPOCHS):
            order = rng.permutation(len(docs))
            for k in range(0, len(order), BATCH):
                batch = order[k : k + BATCH]
                ids, starts = _padded([docs[i] for i in batch])
                n = len(ids) - max(WIDTHS)
                ids[rng.random(len(ids)) < DROP] = 0
                xs = sum(self.embed[ids[:, k]] for k in range(PARTS))
                stops = np.append(starts[1:], n)
                pooled, places = [], []
                for w in WIDTHS:
                    v = self._values(w, xs, n)
                    place = np.stack([s + v[s : e - w + 1].argmax(0) for s, e in zip(starts, stops, strict=True)])
                    places.append(place)
                    pooled.append(np.take_along_axis(v, place, 0))
                x = np.maximum(np.concatenate(pooled, 1), 0)
                p = 1 / (1 + np.exp(-np.clip(x @ self.weights + self.bias[0], -30, 30)))
                d = ((p - y[batch]) / len(batch)).astype(np.float32)
                back = d[:, None] * self.weights * (x > 0)
                slots, grads = [], []
                for j, w in enumerate(WIDTHS):
                    own = back[:, j * FILTERS : (j + 1) * FILTERS]
                    change = np.empty_like(self.filters[w])
                    for i in range(w):
                        at = places[j] + i
                        change[i] = np.einsum("bf,bfd->df", own, xs[at])
                        change_x = (own[:, :, None] * self.filters[w][i].T[None]).reshape(-1, DIM)
                        for part in range(PARTS):
                            slots.append(ids[at.ravel(), part])
                            grads.append(change_x)
                    move(self.filters[w], change)
                rows, back_to = np.unique(np.concatenate(slots), return_inverse=True)
                total = np.zeros((len(rows), DIM), np.float32)
                np.add.at(total, back_to, np.concatenate(grads))
                total[rare[rows]] = 0
                move(self.embed, total, rows)
                move(self.weights, x.T @ d)
                move(self.bias, d.sum(keepdims=True))

    def fit_languages(self, docs: list[np.ndarray], names: list[str]) -> None:
        """Log frequencies of words by language, of the labelled rows that name one."""
        kinds = sorted(set(names))
        count = np.full((SLOTS, max(1, len(kinds))), 0.1)
        for d, name in zip(docs, names, strict=True):
            np.add.at(count[:, kinds.index(name)], d & SLOTS - 1, 1)
        self.languages = np.log(count / count.sum(0)).astype(np.float32)
        self.languages[0] = 0
        self.cuts = np.zeros(count.shape[1])

    def calibrate(self, docs: list[np.ndarray], y: np.ndarray, least: int = 20) -> None:
        """For each language the logit that parts the labels best; the one of all where it has few toxic rows."""
        if not len(docs):
            return
        z, kind = self.logits(docs), self.language(docs)

        def cut(z: np.ndarray, y: np.ndarray) -> float:
            order = np.argsort(z)
            z, y = z[order], y[order]
            # rows below the cut count as clean; shares of each label, the middle of the best stretch
            missed = np.concatenate([[0], np.cumsum(y == 1)]) / max(1, (y == 1).sum())
            wrong = 1 - np.concatenate([[0], np.cumsum(y == 0)]) / max(1, (y == 0).sum())
            loss = missed + WRONG * wrong
            best = np.flatnonzero(loss <= loss.min() + 1e-12)
            edges = np.concatenate([[z[0] - 1], (z[1:] + z[:-1]) / 2, [z[-1] + 1]])
            return float(edges[best].mean())

        whole = cut(z, y) if 0 < y.sum() < len(y) else 0.0
        for k in range(len(self.cuts)):
            own = kind == k
            few = min((y[own] == 1).sum(), (y[own] == 0).sum()) < least
            self.cuts[k] = whole if few else cut(z[own], y[own])


def train(docs: DataFrame, labels: DataFrame, modulus: int, held: int, size: int = SAMPLE) -> Network:
    """Fits on labelled rows whose crc32 remainder isn't ``held``; a quarter of them calibrates."""
    lang = F.col("lang").cast("string").alias("lang")
    rows = sample(docs, labels, "toxic", remainder("doc_id", modulus) != held, size, SAMPLE_BYTES, lang)

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [word_slots(t).tobytes() for t in b.column("text").to_pylist()]
            cols = [b.column("doc_id"), b.column("label"), b.column("lang"), pa.array(found, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "label", "lang", "slots"])

    got = rows.mapInArrow(slots, "doc_id long, label int, lang string, slots binary").toPandas()  # bounded: see sample
    got = got.sort_values("doc_id")
    net = Network()
    texts = [np.frombuffer(x, np.int64) for x in got["slots"]]
    y = got["label"].to_numpy(np.int64)
    if len(set(y.tolist())) < 2:
        net.bias[0] = 4.0 if len(y) and y[0] else -4.0
        net.weights[:] = 0
    else:
        apart = np.arange(len(y)) % 4 == 3
        named = [(t, n) for t, n in zip(texts, got["lang"], strict=True) if n is not None]
        net.fit_languages([t for t, _ in named], [n for _, n in named])
        net.fit([t for t, a in zip(texts, apart, strict=True) if not a], y[~apart])
        net.calibrate([t for t, a in zip(texts, apart, strict=True) if a], y[apart])
    return net


def toxicity(docs: DataFrame, labels: DataFrame, modulus: int = 5, held: int = 0, size: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted of every row of ``docs``, from its whole text.

    Null and empty texts are scored like any text, on no words.  A null id is not held out.  Without labels of both
    kinds every score is the same.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, modulus, held, size))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = model.value
        for b in batches:
            texts, out = b.column("text").to_pylist(), []
            total, slots = 0, []
            for k, t in enumerate(texts):
                slots.append(word_slots(t))
                total += len(slots[-1])
                if total > 100_000 or k == len(texts) - 1:
                    out.append(net.scores(slots))
                    total, slots = 0, []
            scores = np.concatenate(out) if out else np.empty(0)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(scores)], names=["doc_id", "score"])

    scored = doc_rows(docs).mapInArrow(score, "doc_id long, score double").withColumn("doc_id", public_id())
    return scored.select(
        "doc_id",
        F.coalesce(remainder("doc_id", modulus) == held, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
