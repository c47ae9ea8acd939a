"""Benchmark decontamination as a prefix-filtered set join.

Items are cut into windows, and windows into shingles.  A document holds a window only if it holds all shingles of it, so the
rarest one over the whole corpus is enough to join by: the prefix of a set join at full containment.  Documents are read
once: a shingle that no item has is dropped by a bitmap of fixed size where it is read (what passes by chance falls in the
join), the others become rows with the few words around them.  Their counts give the order by rarity; windows with a shingle that
no document has are out.  A joined shingle must stand as far from the ends of its document as from those of its window (the positional
and length bounds), and the words of the whole window must be equal.

Words are runs of ASCII letters and digits and of all other than ASCII characters, letters A-Z in lower case.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import doc_rows, public_id, spread_join, written

WINDOW, SHINGLE = 10, 4
#: Bits of the bitmap that shingles are sought in: 8 MB, however many items there are.
BITS = 26
CHUNK_BITS = 15
#: Words that are held against the bitmap at a time.
BUFFER = 1 << 18
_word = set((string.ascii_lowercase + string.digits).encode()) | set(range(128, 256))
#: Each byte as it is in a word, in lower case; a space where it is in none.
BYTES = bytes(c if c in _word else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
_odd = np.random.Generator(np.random.PCG64(77)).integers(1, 2**63, WINDOW + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8").translate(BYTES).split()


def shingle_hashes(words: list[bytes], q: int) -> np.ndarray:
    """Of each q words in a row."""
    w = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    m = max(0, len(w) - q + 1)
    h = np.full(m, q, np.uint64)
    for k in range(q if m else 0):
        h += w[k : k + m] * _odd[k]
    h ^= h >> np.uint64(32)
    h *= _odd[-1]
    return h ^ h >> np.uint64(29)


def _batch(rows: list[tuple], **types: pa.DataType) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [()] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types.values(), strict=True)], names=list(types))


def item_windows(items: DataFrame, window: int) -> tuple[DataFrame, DataFrame]:
    """(the different windows: wid, words, size; wid, item_id: who has them).  An item of fewer words is one window."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for item, text in zip(b.column("item_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                words = words_of(text)
                size = min(window, len(words))
                own = {b" ".join(words[i : i + size]) for i in range(len(words) - size + 1)} if words else ()
                rows += [(item, w.decode(), size) for w in own]
            yield _batch(rows, item_id=pa.string(), words=pa.string(), size=pa.int32())

    texts = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.col("text").cast("string").alias("text"))
    rows = written(texts.mapInArrow(cut, "item_id string, words string, size int"), "items")
    different = rows.groupBy("words", "size").agg(F.lit(1).alias("one")).select(F.monotonically_increasing_id().alias("wid"), "words", "size")
    different = written(different, "windows")
    return different, rows.join(different.select("wid", "words"), "words").select("wid", "item_id").distinct()


def window_shingles(windows: DataFrame, shingle: int) -> DataFrame:
    """wid, size, q (words of a shingle: fewer in a window that has fewer), h, o (the shingle's place in the window)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for wid, text, size in zip(*(b.column(c).to_pylist() for c in ("wid", "words", "size")), strict=True):
                q = min(size, shingle)
                rows += [(wid, size, q, h, o) for o, h in enumerate(shingle_hashes(text.encode().split(b" "), q).view(np.int64).tolist())]
            yield _batch(rows, wid=pa.int64(), size=pa.int32(), q=pa.int32(), h=pa.int64(), o=pa.int32())

    return windows.select("wid", "words", "size").mapInArrow(cut, "wid long, size int, q int, h long, o int")


def bitmap(shingles: DataFrame, bits: int = BITS) -> bytes:
    """One bit for each ``bits`` leading bits of a hash, set where a shingle has them; at most 2 ** (bits - 15) rows are fetched."""
    slot = F.shiftrightunsigned("h", 64 - bits)
    rows = shingles.select(slot.alias("slot")).groupBy(F.shiftright("slot", CHUNK_BITS).alias("chunk"))
    out = bytearray(1 << bits - 3)
    for chunk, own in rows.agg(F.bitmap_construct_agg(F.col("slot") % (1 << CHUNK_BITS))).collect():
        at = chunk << CHUNK_BITS - 3
        part = bytes(own)[: len(out) - at]
        out[at : at + len(part)] = part
    return bytes(out)


SCAN = "row_id long, doc_id long, n long, p long, q int, h long, lead int, around string"


def scanned(docs: DataFrame, sizes: list[int], bits: bytes, window: int, shingle: int) -> DataFrame:
    """SCAN: a row for each document, without p, and one for each shingle that the bitmap lets pass: its place p, and the words
    around it as far as a window reaches, ``lead`` of them before it."""
    shared = docs.sparkSession.sparkContext.broadcast(bits)
    shift = np.uint64(64 - (len(bits) * 8).bit_length() + 1)

    def hits(group: list[tuple[int, list[bytes]]]) -> Iterator[pa.RecordBatch]:
        mask = np.frombuffer(shared.value, np.uint8)
        words = [w for _, own in group for w in own]
        lengths = np.array([len(own) for _, own in group])
        ends = np.cumsum(lengths)
        hashed = {q: shingle_hashes(words, q) for q in sizes}
        for q, h in hashed.items():
            slot = h >> shift
            at = np.flatnonzero(mask[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8) & 1)
            doc = np.searchsorted(ends, at, "right")
            inside = at + q <= ends[doc] if len(at) else at
            at, doc = (at[inside], doc[inside]) if len(at) else (at, doc)
            if not len(at):
                continue
            first = ends[doc] - lengths[doc]
            reach = window - q if q == shingle else 0  # a shorter shingle is a window itself
            lo, hi = np.maximum(first, at - reach), np.minimum(ends[doc], at + q + reach)
            around = [b" ".join(words[a:e]).decode() for a, e in zip(lo.tolist(), hi.tolist(), strict=True)]
            ids = np.array([i for i, _ in group])[doc]
            none = pa.nulls(len(at), pa.int64())
            cols = [pa.array(ids), none, none, pa.array(at - first), pa.array(np.full(len(at), q, np.int32))]
            cols += [pa.array(h[at].view(np.int64)), pa.array((at - lo).astype(np.int32)), pa.array(around, pa.string())]
            yield pa.RecordBatch.from_arrays(cols, names=["row_id", "doc_id", "n", "p", "q", "h", "lead", "around"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            group, size, base = [], 0, []
            for row, doc, text in zip(*(b.column(c).to_pylist() for c in ("row_id", "doc_id", "text")), strict=True):
                words = words_of(text)
                base.append((row, doc, len(words), None, None, None, None, None))
                group.append((row, words))
                size += len(words)
                if size > BUFFER:
                    yield from hits(group)
                    group, size = [], 0
            if group:
                yield from hits(group)
            long, int_ = pa.int64(), pa.int32()
            yield _batch(base, row_id=long, doc_id=long, n=long, p=long, q=int_, h=long, lead=int_, around=pa.string())

    return docs.select("row_id", "doc_id", "text").mapInArrow(scan, SCAN)


def occurrences(hits: DataFrame, windows: DataFrame, shingles: DataFrame) -> DataFrame:
    """row_id, start, size, wid: each place of a document where a window stands."""
    counts = written(hits.groupBy("q", "h").agg(F.count(F.lit(1)).alias("all")), "counts")
    total = counts.agg(F.coalesce(F.sum("all"), F.lit(0))).first()[0]
    order = F.min(F.struct("all", "q", "h", "o", "size")).alias("rarest")
    rarest = shingles.join(counts, ["q", "h"]).groupBy("wid").agg(order, F.count(F.lit(1)).alias("there"))
    rarest = rarest.where("there = rarest.size - rarest.q + 1").select("wid", "rarest.*")
    rarest = written(windows.select("wid", "words").join(rarest, "wid"), "rarest")
    # One row a shingle: at most WINDOW places and WINDOW sizes.
    index = rarest.groupBy("q", "h").agg(F.first("all").alias("all"), F.collect_set(F.struct("o", "size")).alias("spots"))
    joined = spread_join(hits, written(index, "prefixes"), ["q", "h"], "all", total=total)
    spots = joined.select("row_id", "p", "h", "lead", F.split("around", " ").alias("around"), F.explode("spots").alias("spot"))
    first = F.col("lead") - F.col("spot.o")
    spots = spots.where((first >= 0) & (first + F.col("spot.size") <= F.size("around")))
    found = spots.select(
        "row_id",
        (F.col("p") - F.col("spot.o")).alias("start"),
        "h",
        F.col("spot.o").alias("o"),
        F.array_join(F.slice("around", first + 1, F.col("spot.size")), " ").alias("words"),
    )
    # A window is found by its own rarest shingle only, so each place once.
    return found.join(rarest.select("words", "h", "o", "size", "wid"), ["words", "h", "o"]).select("row_id", "start", "size", "wid")


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, bits: int = BITS) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items (ids as strings, sorted) and contaminated of every row of ``docs``.

    docs: doc_id, text; items: item_id, text.  A word is hit within any occurrence of ``window`` words in a row of an item, or
    of all the words of an item that has fewer.  Null, empty and wordless texts have no words, and such items no window.  A null item_id is
    an empty string; items of one id are one item.  Repeated rows come back as often as they stand; no rows: none.
    """
    windows, owners = item_windows(items, window)
    shingles = written(window_shingles(windows, shingle), "shingles")
    sizes = sorted(r[0] for r in shingles.select("q").distinct().collect())  # ``shingle`` values at most
    rows = doc_rows(docs).withColumn("row_id", F.monotonically_increasing_id())
    scan = written(scanned(rows, sizes, bitmap(shingles, bits), window, shingle), "scan")
    base = scan.where("p is null").select("row_id", "doc_id", "n")
    hits = scan.where("p is not null").select("row_id", "p", "q", "h", "lead", "around")
    found = written(occurrences(hits, windows, shingles), "occurrences")

    longest = found.groupBy("row_id", "start").agg(F.max("size").alias("size")).withColumn("end", F.col("start") + F.col("size"))
    before = F.expr("max(end) OVER (PARTITION BY row_id ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
    new = F.greatest(F.col("end") - F.greatest("start", F.coalesce(before, F.lit(0))), F.lit(0))
    hit = longest.withColumn("new", new).groupBy("row_id").agg(F.sum("new").alias("n_hit"))

    of = found.groupBy("wid").agg(F.count(F.lit(1)).alias("all")).join(owners, "wid").groupBy("wid")
    of = written(of.agg(F.first("all").alias("all"), F.collect_set("item_id").alias("ids")), "owners")
    own = spread_join(found.select("row_id", "wid").distinct(), of, ["wid"], "all", total=found.count())
    own = own.select("row_id", F.explode("ids").alias("id")).distinct()
    own = own.groupBy("row_id").agg(F.array_sort(F.collect_list("id")).alias("items"))
    out = base.join(hit, "row_id", "left").join(own, "row_id", "left")
    return out.select(
        public_id().alias("doc_id"),
        F.col("n").alias("n_words"),
        F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"),
    )
