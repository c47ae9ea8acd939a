"""Token files: a wavelet matrix for each shard of the corpus.

A shard holds the ids of consecutive documents as bit-planes, most significant bit first; each plane is stably parted by its
bit before the next (zeros first), with a count of ones every 512 bits.  ``WaveletMatrix`` gives access to any
token, counts an id up to a place (rank) and finds its k-th occurrence (select) from the file's bytes alone.
Shards are rows of a Parquet table (part, seq, n_tokens, n_docs, payload), so Spark writes and reads them on any
store; (part, seq) ascends with doc_id.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import doc_rows, public_id
from .tokens import encoder, text_batches

MAGIC, STEP = b"TWM1", 512
HEAD = struct.Struct("<4sBQQ")
#: Tokens of a shard; a longer document has a shard to itself.
SHARD = 1 << 18


def shard_bytes(ids: np.ndarray, doc_ids: np.ndarray, ends: np.ndarray, bits: int) -> bytes:
    """Head (magic, bits, tokens, documents), doc ids, ends, then for each plane: zeros, packed bits, counts of ones."""
    cur = ids.astype(np.uint16 if bits <= 16 else np.uint32)
    out = [HEAD.pack(MAGIC, bits, len(ids), len(doc_ids)), doc_ids.astype("<i8").tobytes(), ends.astype("<u8").tobytes()]
    for level in range(bits - 1, -1, -1):
        bit = (cur & cur.dtype.type(1 << level)).astype(bool)
        packed = np.packbits(bit, bitorder="little")
        counts = np.bitwise_count(np.pad(packed, (0, -len(packed) % (STEP // 8)))).reshape(-1, STEP // 8).sum(1, np.uint64)
        total = int(counts.sum())
        out += [
            struct.pack("<Q", len(cur) - total),
            packed.tobytes(),
            (np.cumsum(counts) - counts).astype("<u8").tobytes(),
        ]
        if total:
            cur = np.concatenate([cur.take(np.flatnonzero(~bit)), cur.take(np.flatnonzero(bit))])
    return b"".join(out)


class WaveletMatrix:
    def __init__(self, data: bytes):
        magic, self.bits, self.n, n_docs = HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a token shard")
        at = HEAD.size
        self.doc_ids = np.frombuffer(data, "<i8", n_docs, at)
        self.ends = np.frombuffer(data, "<u8", n_docs, at + 8 * n_docs).astype(np.int64)
        at += 16 * n_docs
        self.planes: list[tuple[int, np.ndarray, np.ndarray]] = []
        size = -(-self.n // 8)
        for _ in range(self.bits):
            (zeros,) = struct.unpack_from("<Q", data, at)
            packed = np.frombuffer(data, np.uint8, size, at + 8)
            blocks = -(-size // (STEP // 8))
            self.planes.append((zeros, packed, np.frombuffer(data, "<u8", blocks, at + 8 + size)))
            at += 8 + size + 8 * blocks

    def _bit(self, level: int, i: int) -> int:
        return int(self.planes[level][1][i >> 3]) >> (i & 7) & 1

    def _ones(self, level: int, i: int) -> int:
        """Ones before position i of a plane."""
        _, packed, counts = self.planes[level]
        block = min(i // STEP, len(counts) - 1)
        if block < 0:
            return 0
        from_, to = block * (STEP // 8), i >> 3
        ones = int(counts[block]) + int(np.bitwise_count(packed[from_:to]).sum())
        return ones + ((int(packed[to]) & ((1 << (i & 7)) - 1)).bit_count() if i & 7 else 0)

    def _down(self, level: int, i: int, bit: int) -> int:
        ones = self._ones(level, i)
        return self.planes[level][0] + ones if bit else i - ones

    def access(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for level in range(self.bits):
            bit = self._bit(level, i)
            value = value << 1 | bit
            i = self._down(level, i, bit)
        return value

    def rank(self, token: int, i: int) -> int:
        """How often ``token`` stands before position i."""
        lo, hi = 0, i
        for level in range(self.bits):
            bit = token >> (self.bits - 1 - level) & 1
            lo, hi = self._down(level, lo, bit), self._down(level, hi, bit)
        return hi - lo

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def select(self, token: int, k: int) -> int:
        """The position of the k-th occurrence, from 0."""
        if not 0 <= k < self.count(token):
            raise IndexError(k)
        lo = 0
        for level in range(self.bits):
            lo = self._down(level, lo, token >> (self.bits - 1 - level) & 1)
        i = lo + k
        for level in range(self.bits - 1, -1, -1):
            bit = token >> (self.bits - 1 - level) & 1
            i = self._nth(level, i - self.planes[level][0] if bit else i, bit)
        return i

    def _nth(self, level: int, k: int, bit: int) -> int:
        """The position of the k-th bit of this kind in a plane."""
        lo, hi = 0, self.n - 1
        while lo < hi:
            mid = (lo + hi) // 2
            ones = self._ones(level, mid + 1)
            if (ones if bit else mid + 1 - ones) > k:
                hi = mid
            else:
                lo = mid + 1
        return lo

    def tokens(self) -> np.ndarray:
        """All ids, by undoing the partings from the last plane up."""
        cur = np.zeros(self.n, np.uint16 if self.bits <= 16 else np.uint32)
        for level in range(self.bits - 1, -1, -1):
            zeros, packed, _ = self.planes[level]
            if zeros == self.n:
                continue
            bit = np.unpackbits(packed, count=self.n, bitorder="little").view(bool)
            up = np.empty_like(cur)
            up[np.flatnonzero(~bit)] = cur[:zeros]
            up[np.flatnonzero(bit)] = cur[zeros:] | cur.dtype.type(1 << (self.bits - 1 - level))
            cur = up
        return cur


def write_shards(docs: DataFrame, path: str, vocabulary: str, bits: int, end_id: int = 0, shard: int = SHARD) -> None:
    """Encodes every text, appends ``end_id`` and writes shards in ascending doc_id order (null ids last).

    Null and empty texts are the end id alone.  Rows of one id follow one another, by text.  No rows: an empty table.
    """
    end = np.array([end_id], "<u4").tobytes()

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, part, seq = encoder(vocabulary, True), TaskContext.get().partitionId(), 0
        own: list[tuple[int, bytes]] = []
        size = 0

        def give() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join([x for _, x in own]), "<u4")
            ends = np.cumsum([len(x) // 4 for _, x in own])
            data = shard_bytes(ids, np.array([d for d, _ in own]), ends, bits)
            cols = ([part], [seq], [len(ids)], [len(own)], [data])
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)],
                names=["part", "seq", "n_tokens", "n_docs", "payload"],
            )

        for batch in batches:
            for ids, texts in text_batches(batch):
                for doc, got in zip(ids, tokens.encode(texts), strict=True):
                    if own and size + len(got) // 4 + 1 > shard:
                        yield give()
                        own, size, seq = [], 0, seq + 1
                    own.append((doc, got + end))
                    size += len(got) // 4 + 1
        if own:
            yield give()

    # Rows of one id, null ids among them, may be many: ranges go on by the beginning of the text, which sorts alike.
    begin = F.substring("text", 1, 64)
    rows = doc_rows(docs).repartitionByRange("doc_id", begin).sortWithinPartitions("doc_id", "text")
    shards = rows.mapInArrow(build, "part int, seq int, n_tokens long, n_docs long, payload binary")
    shards.write.option("compression", "zstd").parquet(path)


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32, from the shards."""
    shards = spark.read.parquet(path)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, seq, data in zip(*(b.column(c).to_pylist() for c in ("part", "seq", "payload")), strict=True):
                w = WaveletMatrix(data)
                buf = w.tokens().astype("<u4").tobytes()
                begins = np.append(0, w.ends[:-1])
                crc = [zlib.crc32(buf[4 * s : 4 * e]) for s, e in zip(begins.tolist(), w.ends.tolist(), strict=True)]
                own = [np.full(len(crc), x, np.int32) for x in (part, seq)]
                cols = [*own, w.doc_ids, begins, w.ends - begins, np.array(crc, np.int64)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c) for c in cols], names=["part", "seq", "doc_id", "within", "n_tokens", "ids_crc32"]
                )

    parts = shards.groupBy("part").agg(F.sum("n_tokens").alias("n"))  # a row a partition of the writer
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("part", before.alias("base"))
    own = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    base = shards.select("part", "seq", F.coalesce(F.sum("n_tokens").over(own), F.lit(0)).alias("inner")).join(parts, "part")
    docs = shards.select("part", "seq", "payload").mapInArrow(
        decode, "part int, seq int, doc_id long, within long, n_tokens long, ids_crc32 long"
    )
    return docs.join(base, ["part", "seq"]).select(
        public_id().alias("doc_id"), (F.col("base") + F.col("inner") + F.col("within")).alias("start"), "n_tokens", "ids_crc32"
    )
