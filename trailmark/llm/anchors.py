"""Which windows of W units (bytes or words) occur again: the part that substring and suffix deduplication share.

Every window is filed under its anchor, the leftmost q-gram of least hash inside it, so equal windows have equal
anchors at equal offsets, wherever they stand.  Neighbouring windows with one anchor form a fragment; only small rows (a hash of
the anchor, a 128-bit digest of the fragment) are exchanged for all fragments, about one for W / 2 units.  Anchors that
occur once end there: no window of theirs can stand twice.  Of all other fragments one of each kind is fetched, with
the number of its copies, brought together by anchor, and resolved by the operator; every unit that goes, goes by that.

An anchor with more than ``most`` different fragments isn't gathered in a task.  Its fragments are cut into blocks of neighbouring
windows, at equal distances from the anchor, and equal blocks are one.  The windows of each get the bucket identifiers that
refinement by doubling leads to (the identifier of a longer string is made of those of its halves), and the buckets,
which are the operator's index dealt over all tasks, meet in a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import spread_join, written

#: Different fragments of an anchor that one task may gather.
MOST = 2048
#: Windows of a fragment that are looked up as one where an anchor has more.
BLOCK = 16
#: Units in a buffer, and the bits of its positions.
BUFFER, POSITION_BITS = 1 << 20, 22
_odd = np.random.Generator(np.random.PCG64(2024)).integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


@dataclass(frozen=True)
class Units:
    """window and gram in units; split gives a text's units as bytes, ``size`` bytes each."""

    window: int
    gram: int
    size: int
    split: Callable[[str], bytes]


def text_bytes(text: str) -> bytes:
    return text.encode("utf-8")


def word_hashes(text: str) -> bytes:
    words = text.encode("utf-8").split()
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words)).tobytes()


def eights(data: bytes) -> np.ndarray:
    """The eight bytes from each position on as an integer; zeros follow the end."""
    n = len(data)
    padded = data + bytes(16)
    out = np.empty(n, np.uint64)
    for s in range(min(8, n)):
        k = len(range(s, n, 8))
        out[s::8] = np.frombuffer(padded, "<u8", k, s)
    return out


def gram_hashes(units: Units, data: bytes) -> np.ndarray:
    if units.size == 1:
        w, step, terms = eights(data), 8, units.gram // 8
    else:
        w, step, terms = np.frombuffer(data, "<u8"), 1, units.gram
    m = len(data) // units.size - units.gram + 1
    h = np.zeros(max(m, 0), np.uint64)
    for k in range(terms if m > 0 else 0):
        h += w[k * step : k * step + m] * _odd[k]
    h ^= h >> np.uint64(32)
    h *= _odd[63]
    h ^= h >> np.uint64(29)
    return h


def leftmost_least(h: np.ndarray, w: int) -> np.ndarray:
    """For each window of w values the position of its least value, the leftmost of equals."""
    mask = np.uint64((1 << POSITION_BITS) - 1)
    n = len(h)
    key = np.full(-(-n // w) * w, np.iinfo(np.uint64).max)
    key[:n] = (h & ~mask) | np.arange(n, dtype=np.uint64)
    rows = key.reshape(-1, w)
    before = np.minimum.accumulate(rows, axis=1).ravel()
    after = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return (np.minimum(after[: n - w + 1], before[w - 1 : n]) & mask).astype(np.int64)


def runs_of(units: Units, parts: list[bytes]) -> Iterator[tuple[np.ndarray, ...]]:
    """(part, first window, windows, anchor's offset in the first window, anchor's hash, two halves of the digest) of all fragments."""
    size, window = units.size, units.window
    lengths = np.array([len(p) // size for p in parts], np.int64)
    pieces: list[tuple[int, int, int]] = []  # part, from, to; a long part is cut with an overlap
    total = 0
    for k, n in enumerate(lengths.tolist()):
        for lo in range(0, max(n - window + 1, 0), BUFFER // 2):
            hi = min(n, lo + BUFFER // 2 + window - 1)
            if total + hi - lo > BUFFER:
                yield _runs(units, parts, pieces)
                pieces, total = [], 0
            pieces.append((k, lo, hi))
            total += hi - lo
    if pieces:
        yield _runs(units, parts, pieces)


def _runs(units: Units, parts: list[bytes], pieces: list[tuple[int, int, int]]) -> tuple[np.ndarray, ...]:
    size, window = units.size, units.window
    data = b"".join([parts[k][lo * size : hi * size] for k, lo, hi in pieces])
    h = gram_hashes(units, data)
    least = leftmost_least(h, window - units.gram + 1)
    lengths = np.array([hi - lo for _, lo, hi in pieces])
    starts = np.cumsum(lengths) - lengths
    valid = np.zeros(len(data) // size + 1, np.int32)
    valid[starts] += 1
    np.subtract.at(valid, starts + lengths - window + 1, 1)
    at = np.flatnonzero(np.cumsum(valid[:-1]))
    anchor = least[at]
    first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
    begin, anchor = at[first], anchor[first]
    count = np.diff(np.append(first, len(at)))
    digest = xxhash.xxh3_128_digest
    ends = (begin + count + window - 1) * size
    digests = [digest(data[b:e]) for b, e in zip((begin * size).tolist(), ends.tolist(), strict=True)]
    halves = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
    piece = np.searchsorted(starts, begin, "right") - 1
    part = np.array([k for k, _, _ in pieces])[piece]
    offset = np.array([lo for _, lo, _ in pieces])[piece] - starts[piece]
    return (
        part,
        begin + offset,
        count,
        anchor - begin,
        h[anchor].view(np.int64),
        halves[:, 0],
        halves[:, 1],
    )


FRAGMENT = "doc_id long, rk long, i long, n int, rel int, k long, d long, e long"


def fragments(docs: DataFrame, units: Units) -> DataFrame:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, keys, texts = (b.column(c).to_pylist() for c in ("doc_id", "rk", "text"))
            begin = size = 0
            for end in range(1, len(texts) + 1):
                size += len(texts[end - 1])
                if size < BUFFER and end < len(texts):
                    continue
                parts = [units.split(t) for t in texts[begin:end]]
                own = np.array(ids[begin:end], np.int64), np.array(keys[begin:end], np.int64)
                for part, i, n, rel, *hashes in runs_of(units, parts):
                    cols = [own[0][part], own[1][part], i, n.astype(np.int32), rel.astype(np.int32), *hashes]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c) for c in cols], names=["doc_id", "rk", "i", "n", "rel", "k", "d", "e"]
                    )
                begin, size = end, 0

    return docs.mapInArrow(cut, FRAGMENT)


#: What ``resolve`` gets of each different fragment, whole anchors in order of k.  first_id: the least document that has it;
#: copies: how often it stands in all; rel: its anchor's offset; n: its windows.
KIND = ("k", "d", "e", "first_id", "copies", "rel", "n", "data")
_kind_types = (*[pa.int64()] * 5, *[pa.int32()] * 2, pa.binary())
_spans = pa.list_(pa.struct([("i", pa.int64()), ("n", pa.int64())]))
SETTLED = (
    "k long, d long, e long, first_id long, copies long, own array<struct<i:long,n:long>>, later array<struct<i:long,n:long>>"
)
Spans = list[tuple[int, int]]


def repeated_starts(
    docs: DataFrame,
    units: Units,
    resolve: Callable[[list[tuple]], tuple[list[Spans], list[Spans]]],
    earlier_only: bool,
    most: int = MOST,
) -> DataFrame:
    """doc_id, rk, spans: the runs (first window, windows) of repeated windows, of documents that have any.

    docs: doc_id, rk (a hash of the text; tells rows of one id apart) and text.  earlier_only: a window counts
    where it also starts in a document of smaller id; else where it starts anywhere else.
    resolve: gets rows of KIND and gives, for each, the repeated windows [(first, number)] of the fragment in document
    ``first_id``, and in the others that have it.
    """
    frags = written(fragments(docs, units), "fragments")
    ends = (F.min("doc_id").alias("id0"), F.max("doc_id").alias("id1"))
    by_anchor = frags.groupBy("k").agg(F.count(F.lit(1)).alias("all"), *ends)
    by_anchor = by_anchor.where(F.col("id0") < F.col("id1") if earlier_only else F.col("all") > 1)
    by_anchor = written(by_anchor.select("k", "all"), "anchors")
    again = written(spread_join(frags, by_anchor, ["k"], "all").drop("all"), "repeated")

    kinds = again.groupBy("k", "d", "e").agg(
        F.count(F.lit(1)).alias("copies"),
        F.min("doc_id").alias("first_id"),
        F.min(F.struct("doc_id", "rk", "i", "n", "rel")).alias("one"),
    )
    kinds = written(kinds, "kinds")
    many = written(kinds.groupBy("k").agg(F.count(F.lit(1)).alias("different")).where(F.col("different") > most), "many")
    own = spread_join(kinds, many, ["k"], "different", "left").select(
        F.col("one.doc_id").alias("doc_id"),
        F.col("one.rk").alias("rk"),
        F.struct("k", "d", "e", "first_id", "copies", "one.rel", "one.i", "one.n", F.col("different").isNotNull().alias("many")).alias("f"),
    )
    wanted_of = own.groupBy("doc_id", "rk").agg(F.collect_list("f").alias("fs"))  # a document's own fragments

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for text, fs in zip(b.column("text").to_pylist(), b.column("fs").to_pylist(), strict=True):
                data = units.split(text)
                for f in fs:
                    lo, hi = f["i"] * units.size, (f["i"] + f["n"] + units.window - 1) * units.size
                    rows.append((f["many"], *(f[c] for c in KIND[:-1]), data[lo:hi]))
            cols = list(zip(*rows, strict=True)) or [()] * 9
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, (pa.bool_(), *_kind_types), strict=True)], names=["many", *KIND]
            )

    # The wanted fragments are one row a document; of repeated rows of one text each gives them, and one counts.
    texts = docs.join(wanted_of, ["doc_id", "rk"]).select("doc_id", "rk", "text", "fs")
    schema = "many boolean, k long, d long, e long, first_id long, copies long, rel int, n int, data binary"
    fetched = written(texts.mapInArrow(fetch, schema), "fetched")

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def give(rows: list[tuple]) -> pa.RecordBatch:
            as_dicts = [[[{"i": i, "n": n} for i, n in s] for s in spans] for spans in resolve(rows)]
            found = [(*r[:5], s, t) for r, s, t in zip(rows, *as_dicts, strict=True) if s or t]
            cols = list(zip(*found, strict=True)) or [()] * 7
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, (*[pa.int64()] * 5, _spans, _spans), strict=True)],
                names=[*KIND[:5], "own", "later"],
            )

        held: list[tuple] = []
        size = 0
        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in KIND), strict=True):
                if held and row[:3] == held[-1][:3]:
                    continue
                if size > 1_000_000 and row[0] != held[-1][0]:
                    yield give(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[-1])
        if held:
            yield give(held)

    few = fetched.where("not many").repartition("k").sortWithinPartitions("k", "d", "e")
    settled = few.mapInArrow(settle, SETTLED).unionByName(_dealt_index(fetched.where("many"), units, earlier_only))
    settled = written(settled, "settled")

    part = F.when(F.col("doc_id") == F.col("first_id"), F.col("own")).otherwise(F.col("later"))
    found = spread_join(again, settled, ["k", "d", "e"], "copies").select("doc_id", "rk", "i", part.alias("part"))
    starts = F.transform("part", lambda p: F.struct((F.col("i") + p["i"]).alias("i"), p["n"].alias("n")))
    return (
        found.where(F.size("part") > 0)
        .select("doc_id", "rk", starts.alias("spans"))
        .groupBy("doc_id", "rk")
        .agg(F.flatten(F.collect_list("spans")).alias("spans"))
    )


def bucket_names(units: Units, data: bytes) -> np.ndarray:
    """A 128-bit bucket identifier for each window: that of twice as long a string is made of those of its two halves."""
    first, depth = (eights(data), 8) if units.size == 1 else (np.frombuffer(data, "<u8"), 1)
    n = len(data) // units.size - units.window + 1
    lanes = []
    for lane in range(2):
        x, at = first, depth
        while True:
            x = (x ^ x >> np.uint64(32)) * _odd[40 + lane]
            x ^= x >> np.uint64(29)
            if at == units.window:
                break
            step = min(at, units.window - at)
            x = x[: len(x) - step] * _odd[42 + lane] + x[step:] * _odd[44 + lane]
            at += step
        lanes.append(x[:n].view(np.int64))
    return np.stack(lanes)


def _blocks(fetched: DataFrame, units: Units) -> DataFrame:
    """Fragments cut into runs of at most BLOCK windows, where their distance from the anchor is a multiple of it: p, the first window,
    m windows, their bytes, and a 128-bit digest of these."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for *key, rel, n, data in zip(*(b.column(c).to_pylist() for c in KIND), strict=True):
                at = (rel - np.arange(n)) // BLOCK
                first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
                count = np.diff(np.append(first, n))
                lo, hi = first * units.size, (first + count + units.window - 1) * units.size
                pieces = [data[i:j] for i, j in zip(lo.tolist(), hi.tolist(), strict=True)]
                halves = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, pieces)), np.int64).reshape(-1, 2)
                cols = [np.full(len(first), x, np.int64) for x in key] + [first, count, halves[:, 0], halves[:, 1]]
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(c) for c in cols), pa.array(pieces, pa.binary())], names=[*KIND[:5], "p", "m", "u0", "u1", "piece"]
                )

    schema = "k long, d long, e long, first_id long, copies long, p long, m long, u0 long, u1 long, piece binary"
    return fetched.mapInArrow(cut, schema)


def _dealt_index(fetched: DataFrame, units: Units, earlier_only: bool) -> DataFrame:
    """SETTLED rows of anchors with very many fragments: windows look their buckets up in an index that all tasks share.

    Fragments are cut into blocks of windows.  All windows of a block that stands elsewhere, too, do so; of each different
    block the windows go to the index once, and only those are looked up of which its block doesn't tell.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for *key, m, data in zip(*(b.column(c).to_pylist() for c in ("u0", "u1", "all", "id0", "m", "piece")), strict=True):
                cols = [np.full(m, x, np.int64) for x in key] + [np.arange(m, dtype=np.int64), *bucket_names(units, data)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["u0", "u1", "copies", "first_id", "i", "w0", "w1"])

    kinds = fetched.dropDuplicates(["k", "d", "e"])
    blocks = written(_blocks(kinds, units), "blocks")
    different = blocks.groupBy("u0", "u1").agg(
        F.count(F.lit(1)).alias("size"),
        F.sum("copies").alias("all"),
        F.min("first_id").alias("id0"),
        F.first("m").alias("m"),
        F.first("piece").alias("piece"),
    )
    different = written(different, "different")
    schema = "u0 long, u1 long, copies long, first_id long, i long, w0 long, w1 long"
    rows = written(different.mapInArrow(each, schema), "windows")
    asks = F.lit(True) if earlier_only else F.col("copies") == 1
    buckets = rows.groupBy("w0", "w1").agg(
        F.count_if(asks).alias("size"), F.sum("copies").alias("all"), F.min("first_id").alias("id0")
    )
    buckets = written(buckets.where("all > 1 and size > 0"), "buckets")
    hits = spread_join(rows.where(asks), buckets, ["w0", "w1"], "size")
    if earlier_only:
        hits = hits.where("id0 < first_id")
    one = F.struct("i", F.lit(1).cast("long").alias("n"))
    found = hits.groupBy("u0", "u1").agg(F.collect_list(one).alias("part"))  # a block's own windows, BLOCK at most
    none = F.array().cast("array<struct<i:long,n:long>>")
    whole = lambda n: F.array(F.struct(F.lit(0).cast("long").alias("i"), F.col(n).cast("long").alias("n")))
    told = different.drop("piece").join(found, ["u0", "u1"], "left").withColumn("part", F.coalesce("part", none))
    if earlier_only:  # the first document that has the block gets what it found, and the others all of it
        told = told.where("size(part) > 0 or size > 1")
    else:
        told = told.withColumn("part", F.when(F.col("all") > 1, whole("m")).otherwise(F.col("part"))).where("size(part) > 0")
    told = written(told.select("u0", "u1", "size", "id0", "part"), "told")
    own = spread_join(blocks.drop("piece"), told, ["u0", "u1"], "size")
    if earlier_only:
        own = own.withColumn("part", F.when(F.col("first_id") > F.col("id0"), whole("m")).otherwise(F.col("part")))
    starts = F.transform("part", lambda x: F.struct((F.col("p") + x["i"]).alias("i"), x["n"].alias("n")))
    own = own.select("k", "d", "e", starts.alias("own")).groupBy("k", "d", "e").agg(F.flatten(F.collect_list("own")).alias("own"))
    out = kinds.join(own, ["k", "d", "e"], "left").withColumn("own", F.coalesce("own", none))
    # Another document's copy finds all its windows in the index, as the first one's are there.
    later = F.when(F.col("copies") > 1, whole("n")).otherwise(none) if earlier_only else F.col("own")
    return out.select(*KIND[:5], "own", later.alias("later")).where("size(own) + size(later) > 0")


def covered(spans: list[dict] | None, window: int, length: int) -> list[tuple[int, int]]:
    """The maximal runs [from, to) of units that the windows of ``spans`` cover."""
    out: list[list[int]] = []
    for i, e in sorted((s["i"], s["i"] + s["n"] - 1 + window) for s in spans or ()):
        if out and i <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([i, e])
    return [(i, min(e, length)) for i, e in out]
