"""Best-fit packing of token sequences by a configuration linear program.

The histogram of piece lengths (as many rows as the capacity at most) defines the configuration LP: cover all pieces with as
few sequences as possible, each filled by a configuration of lengths.  The LP is solved by multiplicative weights: prices begin
at the lengths themselves, a length's price falls as it gets covered, and a knapsack dynamic program finds the
configuration of most worth.  Each round covers a length at least, so all are covered after as many rounds as there are
lengths.  The solution is rounded to whole sequences; what is left goes by best fit, longest first, into the
smallest gap that takes it.  All of this works on (length, count) pairs, so its cost does not grow with the input.

Pieces then find their slots by their rank among the pieces of equal length, counted over salted groups.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import doc_rows, public_id, written
from .tokens import REMEMBERED, encoder, text_batches

CAPACITY = 4096
#: The LP's lengths are rounded up to multiples of capacity / UNITS; rounding back uses the true lengths.
UNITS = 1024
#: How fast prices fall, and how much longer lengths are preferred among configurations of equal worth.
RATE, LONGER = 0.5, 1e-4
SALTS = 4096


def price(units: np.ndarray, value: np.ndarray, capacity: int) -> dict[int, int]:
    """The most valuable configuration: an unbounded knapsack.  units ascends; gives index -> copies."""
    best, pick = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    fits = np.searchsorted(units, np.arange(capacity + 1), "right")
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        if k := fits[c]:
            got = best[c - units[:k]] + value[:k]
            j = int(got.argmax())
            if got[j] > best[c]:
                best[c], pick[c] = got[j], j
    out: dict[int, int] = {}
    c = capacity
    while c > 0:
        if pick[c] < 0:
            c -= 1
        else:
            out[int(pick[c])] = out.get(int(pick[c]), 0) + 1
            c -= int(units[pick[c]])
    return out


def fractional(units: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[dict, float]]:
    """Configurations and how often the LP's solution uses each, by multiplicative weights."""
    cover = np.zeros(len(units))
    share = units / capacity
    used: dict[tuple, float] = {}
    while (open_ := cover < 1 - 1e-9).any():
        config = price(units, share * (1 + LONGER * share) * np.exp(-RATE * cover) * open_, capacity)
        at, copies = np.array(list(config)), np.array(list(config.values()))
        # As often as its scarcest length allows, but no more than some length still needs.
        times = min(float((demand[at] / copies).min()), float(((1 - cover[at]) * demand[at] / copies).min()))
        cover[at] += times * copies / demand[at]
        key = tuple(sorted(config.items()))
        used[key] = used.get(key, 0) + times
    return [(dict(k), x) for k, x in sorted(used.items(), key=lambda kx: (-kx[1], kx[0]))]


def configurations(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[tuple[int, int]]]]:
    """(sequences, [(length, copies), ...]) that hold exactly ``counts`` (length -> pieces)."""
    grain = max(1, capacity // UNITS)
    left = {n: c for n, c in sorted(counts.items()) if c}
    pools: dict[int, list[int]] = {}
    for n in left:
        pools.setdefault(-(-n // grain), []).append(n)
    units = np.array(sorted(pools))
    demand = np.array([float(sum(left[n] for n in pools[u])) for u in units.tolist()])
    bins: list[list] = []  # [sequences, {length: copies}, free]
    for config, times in fractional(units, demand, capacity // grain):
        want = round(times)
        while want > 0:
            filled: dict[int, int] = {}
            for j, copies in config.items():
                for n in reversed(pools[int(units[j])]):
                    take = min(copies, left[n])
                    if take:
                        filled[n] = take
                        copies -= take
                    if not copies:
                        break
                if copies:
                    filled = {}
                    break
            if not filled:
                break
            times_now = min(want, *(left[n] // k for n, k in filled.items()))
            for n, k in filled.items():
                left[n] -= k * times_now
            bins.append([times_now, filled, capacity - sum(n * k for n, k in filled.items())])
            want -= times_now
    # Best fit, longest first; gaps ascend, and sequences that are filled alike are treated at once.
    gaps: list[tuple[int, int]] = sorted((b[2], i) for i, b in enumerate(bins))
    for n in sorted(left, reverse=True):
        rest = left[n]
        while rest:
            at = bisect.bisect_left(gaps, (n, -1))
            if at == len(gaps):
                each = capacity // n
                full, some = divmod(rest, each)
                for times_now, k in ((full, each), (1, some)):
                    if times_now and k:
                        bins.append([times_now, {n: k}, capacity - n * k])
                        bisect.insort(gaps, (capacity - n * k, len(bins) - 1))
                rest = 0
                break
            free, i = gaps.pop(at)
            times_now, filled, _ = bins[i]
            each = min(free // n, rest)
            use = min(times_now, rest // each)
            if use < times_now:
                bins.append([times_now - use, dict(filled), free])
                bisect.insort(gaps, (free, len(bins) - 1))
            filled = dict(filled)
            filled[n] = filled.get(n, 0) + each
            bins[i] = [use, filled, free - n * each]
            bisect.insort(gaps, (free - n * each, i))
            rest -= use * each
    return [(times, sorted(filled.items(), reverse=True)) for times, filled, _ in bins]


def _slots(configs: list[tuple[int, list[tuple[int, int]]]]) -> tuple[np.ndarray, ...]:
    """By (length, first rank): the first sequence, copies in a sequence and the first copy's offset."""
    rows, ranks, first = [], {}, 0
    for times, filled in configs:
        at = 0
        for n, k in filled:
            rows.append((n, ranks.get(n, 0), first, k, at))
            ranks[n] = ranks.get(n, 0) + times * k
            at += n * k
        first += times
    a = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return tuple(a.T)


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (doc_id, piece, start, length, ...) with sequence_id and offset; lengths are 1 to ``capacity``.

    Every piece gets one slot; slots of a sequence join without gaps from 0.  No pieces: no rows.
    """
    spark, columns = pieces.sparkSession, pieces.columns
    counts = {int(r[0]): int(r[1]) for r in pieces.groupBy("length").count().collect()}  # capacity rows at most
    n, ranks, first, copies, offset = _slots(configurations(counts, capacity))
    table = spark.sparkContext.broadcast((n, ranks, first, copies, offset))

    salts = min(SALTS, max(1, sum(counts.values()) // 2000))
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    base = (
        salted.groupBy("length", "salt")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    )
    own = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start")
    ranked = (
        salted.join(base, ["length", "salt"])
        .withColumn("rank", F.col("base") + F.row_number().over(own) - 1)
        .select(*columns, "rank")
    )

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, ranks, first, copies, offset = table.value
        starts = np.searchsorted(n, np.arange(capacity + 2))
        for b in batches:
            length, rank = (b.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            row = np.empty(len(length), np.int64)
            for x in np.unique(length):  # few ranges each
                mine = length == x
                lo, hi = starts[x], starts[x + 1]
                row[mine] = lo + np.searchsorted(ranks[lo:hi], rank[mine], "right") - 1
            i = rank - ranks[row]
            cols = [b.column(c) for c in columns]
            cols += [pa.array(first[row] + i // copies[row]), pa.array(offset[row] + i % copies[row] * length)]
            yield pa.RecordBatch.from_arrays(cols, names=[*columns, "sequence_id", "offset"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema)
    return ranked.mapInArrow(place, f"{schema}, sequence_id long, offset long")


def token_pieces(
    docs: DataFrame, vocabulary: str, end_id: int, capacity: int = CAPACITY, remembered: int = REMEMBERED
) -> DataFrame:
    """doc_id, piece, start, length and ids (little-endian unsigned 32-bit) of every document, its end id included."""
    end = np.array([end_id], "<u4").tobytes()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = encoder(vocabulary, False, remembered)
        for batch in batches:
            for ids, texts in text_batches(batch):
                rows = []
                for doc, got in zip(ids, tokens.encode(texts), strict=True):
                    got += end
                    for k in range(0, len(got), 4 * capacity):
                        part = got[k : k + 4 * capacity]
                        rows.append((doc, k // (4 * capacity), k // 4, len(part) // 4, part))
                cols = list(zip(*rows, strict=True))
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)],
                    names=["doc_id", "piece", "start", "length", "ids"],
                )

    return doc_rows(docs).mapInArrow(encode, "doc_id long, piece int, start long, length long, ids binary")


def pack_documents(
    docs: DataFrame, vocabulary: str, end_id: int = 1, capacity: int = CAPACITY, remembered: int = REMEMBERED
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece of every document.

    Null and empty texts are one id (the end id).  Repeated rows are packed as often as they stand.  Only documents
    of more than ``capacity`` ids are cut.  remembered: pieces that a worker keeps in memory.  The ids themselves come from ``token_pieces``.
    """
    pieces = token_pieces(docs, vocabulary, end_id, capacity, remembered).select(
        "doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")
    )
    return pack(written(pieces, "pieces"), capacity).withColumn("doc_id", public_id())
