"""Suffix-array deduplication: bytes of strings of ``window`` bytes that start more than once.

The fragments that an anchor brings together (see anchors) are refined as bucket-pointer refinement sorts suffixes, to depth
``window``: positions begin in buckets of their 8-gram; a bucket is refined by sorting on the bucket identifiers
of the positions 8, then 16, 32, ... further on, and each round starts from the identifiers that the last one
updated.  A position whose bucket holds it alone is settled, and so is every window over it; those leave at once.
A fragment that stands several times is refined once and counts as often in its buckets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .anchors import MOST, Spans, Units, covered, eights, repeated_starts, text_bytes
from .common import doc_rows, public_id

WINDOW, GRAM = 400, 64


def _named(order: np.ndarray, new: np.ndarray, alone: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Identifiers in sorted order, and whether a bucket holds more than one position.  alone: positions that count once."""
    name = np.cumsum(new) - 1
    out = np.empty(len(order), np.int64)
    out[order] = name
    return out, (np.bincount(name)[out] > 1) | ~alone


def _buckets(key: np.ndarray, alone: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    return _named(order, np.concatenate([[True], ordered[1:] != ordered[:-1]]), alone)


def refine(rows: list[tuple], window: int = WINDOW) -> tuple[list[Spans], list[Spans]]:
    """rows: anchors.KIND, whole anchors together.  See anchors.repeated_starts; all that have a fragment lose the same."""
    keys, _, _, _, copies, rel, counts, parts = (list(c) for c in zip(*rows, strict=True))
    data = b"".join(parts)
    lengths, counts, keys = np.array([len(p) for p in parts]), np.array(counts), np.array(keys)
    starts = np.cumsum(lengths) - lengths
    group = np.cumsum(np.concatenate([[True], keys[1:] != keys[:-1]])) - 1
    alone = np.array(copies) == 1
    alone = np.repeat(alone, lengths)
    offset = np.arange(len(data)) - np.repeat(starts, lengths)
    aligned = np.repeat(group << 32, lengths) + offset - np.repeat(rel, lengths)
    gram = eights(data)
    tail = np.repeat(lengths, lengths) - offset < 8  # the gram would leave the fragment
    gram[tail] = 0
    order = np.lexsort((gram, aligned))
    new = np.concatenate([[True], (gram[order][1:] != gram[order][:-1]) | (aligned[order][1:] != aligned[order][:-1])])
    name, shared = _named(order, new, alone)
    shared &= ~tail
    wants = np.repeat(counts, lengths) > offset  # windows start here
    depth = 8
    wants &= _all_over(shared, window - depth + 1)
    while depth < window and wants.any():
        step = min(depth, window - depth)
        at = np.flatnonzero(_reach(wants, window - depth - step + 1))
        sub, more = _buckets(name[at] << 32 | name[at + step], alone[at])
        name[at] = sub
        shared = np.zeros(len(name), bool)
        shared[at] = more
        depth += step
        wants &= _all_over(shared, window - depth + 1)
    out = []
    for s, n in zip(starts.tolist(), counts.tolist(), strict=True):
        edge = np.flatnonzero(np.diff(np.concatenate([[0], wants[s : s + n].view(np.int8), [0]])))
        out.append([(int(a), int(b - a)) for a, b in zip(edge[::2], edge[1::2], strict=True)])
    return out, out


def _all_over(flag: np.ndarray, n: int) -> np.ndarray:
    """Whether the n flags from each position on are all set."""
    total = np.concatenate([[0], np.cumsum(flag), np.full(n, -1)])
    return total[n : n + len(flag)] - total[: len(flag)] == n


def _reach(flag: np.ndarray, n: int) -> np.ndarray:
    """Positions less than n after a set one."""
    total = np.concatenate([np.zeros(n, np.int64), np.cumsum(flag)])
    return total[n:] - total[: len(flag)] > 0


def dedup_substrings(
    docs: DataFrame,
    window: int = WINDOW,
    gram: int = GRAM,
    most: int = MOST,
    carry: Column | None = None,
    least_words: int = 0,
) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (bytes) and carry (a column of ``docs`` to take along) of every row.

    Texts are UTF-8 bytes; null and empty ones have none.  A byte goes if a string of ``window`` bytes over it starts
    anywhere else too: in another row (repeated rows are rows), or in the same text, overlaps included.
    least_words: a run that would go stays if it has fewer words, pieces of words at its ends included.
    """
    units = Units(window, gram, 1, text_bytes)
    carry = F.lit(True) if carry is None else carry
    rows = doc_rows(docs, carry.alias("carry")).withColumn("rk", F.xxhash64("text"))
    spans = repeated_starts(rows.drop("carry"), units, lambda r: refine(r, window), earlier_only=False, most=most)

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, gone, runs, kept = [], [], [], []
            for text, own in zip(b.column("text").to_pylist(), b.column("spans").to_pylist(), strict=True):
                data = text.encode("utf-8")
                out = covered(own, window, len(data))
                if least_words:
                    out = [(i, e) for i, e in out if len(data[i:e].split()) >= least_words]
                cuts = [0, *(x for r in out for x in r), len(data)]
                rest = b"".join([data[i:e] for i, e in zip(cuts[::2], cuts[1::2], strict=True)])
                size.append(len(data))
                gone.append(len(data) - len(rest))
                runs.append(len(out))
                kept.append(rest)
            cols = [b.column("doc_id"), *(pa.array(c, pa.int64()) for c in (size, gone, runs)), pa.array(kept, pa.binary())]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "carry"]
            yield pa.RecordBatch.from_arrays([*cols, b.column("carry")], names=names)

    joined = rows.join(spans, ["doc_id", "rk"], "left").select("doc_id", "text", "spans", "carry")
    schema = T.StructType.fromDDL("doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
    out = joined.mapInArrow(remove, schema.add(rows.schema["carry"]))
    return out.withColumn("doc_id", public_id())
