"""Substring deduplication by relative Lempel-Ziv parsing.

The fragments that an anchor brings together (see anchors) are reference blocks, indexed by their windows in order of document
id.  Each is parsed greedily against all blocks of smaller ids: a factor starts where a window of it is
indexed and runs on as far as that block agrees; a factor of ``window`` words or more is a duplicate span.  After
a factor the parse goes on at the first window that the factor doesn't hold, across its boundary.  A fragment that
stands in several documents is parsed twice: as the first of them has it, and as the later ones do, for which the first
is a block too.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import MOST, Spans, Units, covered, repeated_starts, word_hashes
from .common import doc_rows, public_id

WINDOW, GRAM = 50, 8


def _agree(a: bytes, i: int, b: bytes, j: int) -> int:
    """How many words of a from i on equal those of b from j on."""
    n = min(len(a) // 8 - i, len(b) // 8 - j)
    x, y = np.frombuffer(a, np.uint64, n, 8 * i), np.frombuffer(b, np.uint64, n, 8 * j)
    other = np.flatnonzero(x != y)
    return int(other[0]) if len(other) else n


def parse(rows: list[tuple], window: int = WINDOW) -> tuple[list[Spans], list[Spans]]:
    """rows: anchors.KIND, whole anchors together.  See anchors.repeated_starts."""
    own: list[Spans] = [[] for _ in rows]
    later: list[Spans] = [[] for _ in rows]
    for _, anchor in groupby(range(len(rows)), key=lambda r: rows[r][0]):
        index: dict[bytes, tuple[int, int]] = {}

        def factors(r: int, spans: Spans) -> list[tuple[int, int]]:
            """Adds the factors of a block to ``spans``; gives the windows that no block has."""
            n, data = rows[r][6:]
            p, missed = 0, []
            while p < n:
                ref = index.get(data[8 * p : 8 * (p + window)])
                if ref is None:
                    missed.append((r, p))
                    p += 1
                    continue
                factor = _agree(data, p, rows[ref[0]][7], ref[1])
                windows = min(factor - window + 1, n - p)
                spans.append((p, windows))
                p += windows
            return missed

        for _, blocks in groupby(sorted(anchor, key=lambda r: rows[r][3]), key=lambda r: rows[r][3]):
            blocks = list(blocks)  # those of one document come in together
            for q, p in [x for r in blocks for x in factors(r, own[r])]:
                index.setdefault(rows[q][7][8 * p : 8 * (p + window)], (q, p))
            for r in blocks:
                if rows[r][4] > 1:
                    factors(r, later[r])
    return own, later


def dedup_passages(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, most: int = MOST) -> DataFrame:
    """doc_id, n_words, n_removed and kept (the words left, joined by a space) of every row of ``docs``.

    Words are runs without ASCII white space; null and empty texts have none.  A word goes if ``window`` words over it also
    stand in a document of smaller id (a null id is larger than any; rows of one id don't count against each other).
    """
    units = Units(window, gram, 8, word_hashes)
    rows = doc_rows(docs).withColumn("rk", F.xxhash64("text"))
    spans = repeated_starts(rows, units, lambda r: parse(r, window), earlier_only=True, most=most)

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, gone, kept = [], [], []
            for text, own in zip(b.column("text").to_pylist(), b.column("spans").to_pylist(), strict=True):
                words = text.encode("utf-8").split()
                out = covered(own, window, len(words))
                cuts = [0, *(x for r in out for x in r), len(words)]
                rest = [w for i, e in zip(cuts[::2], cuts[1::2], strict=True) for w in words[i:e]]
                size.append(len(words))
                gone.append(len(words) - len(rest))
                kept.append(b" ".join(rest).decode("utf-8"))
            cols = [b.column("doc_id"), *(pa.array(c, pa.int64()) for c in (size, gone)), pa.array(kept, pa.string())]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_words", "n_removed", "kept"])

    joined = rows.join(spans, ["doc_id", "rk"], "left").select("doc_id", "text", "spans")
    out = joined.mapInArrow(remove, "doc_id long, n_words long, n_removed long, kept string")
    return out.withColumn("doc_id", public_id())
