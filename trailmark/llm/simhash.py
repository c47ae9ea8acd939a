"""SimHash near-duplicates found by covering locality-sensitive hashing.

Each bit of a fingerprint gets a non-zero vector of radius + 1 bits; for every non-zero vector v a mask keeps the bits
whose vector has an odd product with v.  The vectors of at most ``radius`` differing bits leave some v orthogonal
to them all, and under its mask the two fingerprints are equal: no pair within the radius is missed.

Fingerprints are made distinct first.  Within a bucket only links that span its linked sets are given, never all
pairs.  Buckets of more than ``most`` fingerprints are dealt out again, without loss: the free bits are cut into
radius + 3 parts, of which three at least don't differ, so the pair meets again under three equal parts.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import doc_rows, public_id, written
from .components import components

BITS, RADIUS, SHINGLE = 64, 3, 3
MOST = 4096


def masks(radius: int = RADIUS, bits: int = BITS) -> list[int]:
    vectors = [1 + i % (2 ** (radius + 1) - 1) for i in range(bits)]
    vectors = [vectors[i] for i in np.random.Generator(np.random.PCG64(7)).permutation(bits)]
    return [
        sum(1 << i for i, m in enumerate(vectors) if (m & v).bit_count() % 2) for v in range(1, 2 ** (radius + 1))
    ]


def submasks(mask: int, radius: int = RADIUS) -> list[int]:
    """Masks of ``mask`` and three of the radius + 3 parts of the bits that it leaves free."""
    free = [i for i in range(BITS) if not mask >> i & 1]
    parts = [sum(1 << i for i in free[k :: radius + 3]) for k in range(radius + 3)]
    return [mask | a | b | c for a, b, c in combinations(parts, 3)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def shingle_hashes(text: str, shingle: int) -> np.ndarray:
    words = text.encode("utf-8").lower().split()  # bytes: A-Z only, ASCII white space only
    if not words:
        return np.empty(0, np.uint64)
    n = max(1, len(words) - shingle + 1)
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    starts = np.cumsum(lengths) - lengths
    ends = (starts + lengths - 1)[min(shingle, len(words)) - 1 :]
    h64 = xxhash.xxh64_intdigest
    return np.fromiter(
        [h64(joined[s:e], 42) for s, e in zip(starts[:n].tolist(), ends.tolist(), strict=True)], np.uint64, n
    )


def majority(h: np.ndarray) -> int:
    """The bits that over half of the hashes have."""
    ones = np.zeros(BITS, np.int64)
    for k in range(0, len(h), 65536):
        part = np.ascontiguousarray(h[k : k + 65536])
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    return majority(shingle_hashes(text, shingle))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, rk (a hash of the text) and fp0."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = np.array([fingerprint(t, shingle) for t in b.column("text").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("rk"), pa.array(own)], names=["doc_id", "rk", "fp0"])

    rows = doc_rows(docs).withColumn("rk", F.xxhash64("text"))
    return rows.mapInArrow(each, "doc_id long, rk long, fp0 long")


def spanning(fps: np.ndarray, bar: int) -> np.ndarray:
    """fps: a row for each fingerprint.  For each one the index of the first one of its linked set."""
    root = np.full(len(fps), -1)
    open_ = np.arange(len(fps))
    while len(open_):
        first, queue = open_[0], [open_[0]]
        root[first], open_ = first, open_[1:]
        while queue and len(open_):
            near = np.bitwise_count(fps[open_] ^ fps[queue.pop()]).sum(1, np.int64) <= bar
            if near.any():
                found = open_[near]
                root[found] = first
                queue.extend(found.tolist())
                open_ = open_[~near]
    return root


def _spanned(rows: DataFrame, keys: list[str], prints: list[str], bar: int) -> DataFrame:
    """Links (u, v) of rep within the groups of ``keys``."""
    names = [*keys, "rep", *prints]
    n = len(keys)

    def span(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def give(rows: np.ndarray) -> pa.RecordBatch:
            new = np.flatnonzero((rows[1:, :n] != rows[:-1, :n]).any(1)) + 1
            u, v = [], []
            begins, ends = np.append(0, new), np.append(new, len(rows))
            more = ends - begins > 1
            for b, e in zip(begins[more].tolist(), ends[more].tolist(), strict=True):
                root = spanning(rows[b:e, n + 1 :].view(np.uint64), bar)
                other = np.flatnonzero(root != np.arange(e - b))
                u.append(rows[b:e, n][other])
                v.append(rows[b:e, n][root[other]])
            u, v = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (u, v))
            return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

        for b in batches:
            if not b.num_rows:
                continue
            rows = np.stack([b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in names], 1)
            held.append(rows)
            last = np.flatnonzero((rows[:, :n] != rows[-1, :n]).any(1))
            if len(last):  # the last bucket may go on
                cut = last[-1] + 1
                yield give(np.concatenate([*held[:-1], rows[:cut]]))
                held = [np.ascontiguousarray(rows[cut:])]
        if held:
            yield give(np.concatenate(held))

    return rows.select(*names).repartition(*keys).sortWithinPartitions(*keys).mapInArrow(span, "u long, v long")


def _dealt(rows: DataFrame, prints: list[str], given: list[tuple[int, str, int]]) -> DataFrame:
    """A row (t, m, ...) for each table (t, fingerprint, mask)."""
    keys = [F.struct(F.lit(t).alias("t"), F.col(p).bitwiseAND(F.lit(signed(m))).alias("m")) for t, p, m in given]
    return rows.select("rep", *prints, F.explode(F.array(*keys)).alias("key")).select("key.*", "rep", *prints)


def links(classes: DataFrame, prints: list[str], given: list[tuple[int, str, int]], bar: int, radius: int, most: int) -> DataFrame:
    """classes (rep, fp0, ...), fingerprints distinct -> (u, v) of rep that span all that links connect in a table."""
    rows = _dealt(classes, prints, given)
    large = rows.groupBy("t", "m").count().where(F.col("count") > most)
    large = written(large.select("t", "m", (F.col("count") / most + 1).cast("int").alias("blocks")), "large")
    if not large.take(1):
        return _spanned(rows, ["t", "m"], prints, bar)
    out = _spanned(rows.join(large, ["t", "m"], "left_anti"), ["t", "m"], prints, bar)
    again = written(rows.join(large, ["t", "m"]), "again")
    for t, p, m in given:
        sub = submasks(m, radius)
        part = _dealt(again.where(F.col("t") == t), prints, [(t * len(sub) + k, p, x) for k, x in enumerate(sub)])
        out = out.unionByName(_spanned(part, ["t", "m"], prints, bar))
    return out


def named_by(classes: DataFrame, whole: DataFrame) -> DataFrame:
    """classes (..., rep, least) and components (u, component) of rep -> classes with component (the least rep) and
    component_id, the least id of the component.  rep names a class and nothing else; ids may be null or repeated."""
    own = classes.join(whole, classes["rep"] == whole["u"], "left").drop("u")
    own = own.withColumn("component", F.coalesce("component", "rep"))
    least = own.groupBy("component").agg(F.min("least").alias("component_id"))
    return own.drop("least").join(least, "component")


def _grouped(found: DataFrame, given: list[tuple[int, str, int]], bar: int, radius: int, most: int) -> DataFrame:
    prints = [c for c in found.columns if c.startswith("fp")]
    found = written(found, "fingerprints")
    classes = found.groupBy(*prints).agg(F.min("doc_id").alias("least"))
    classes = written(classes.withColumn("rep", F.monotonically_increasing_id()), "classes")
    named = named_by(classes, components(links(classes, prints, given, bar, radius, most)))
    return found.join(named, prints).select(
        public_id().alias("doc_id"), "rk", *prints, "component", public_id("component_id").alias("component_id")
    )


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, most: int = MOST) -> DataFrame:
    """doc_id, rk, fp0, component and component_id of every row of ``docs``.  component names what links within ``radius``
    bits connect; component_id is the least doc_id in it, which others may have too where ids are null or repeated.

    Null, empty and blank texts have fingerprint 0 and are linked like others.  A text of fewer words than a shingle is one
    shingle.  Repeated rows come back as often as they stand; a null id is larger than any.
    """
    given = [(t, "fp0", m) for t, m in enumerate(masks(radius))]
    return _grouped(fingerprints(docs, shingle), given, radius, radius, most)


def hex_print(c: str | Column) -> Column:
    return F.lower(F.lpad(F.hex(c), 16, "0"))
