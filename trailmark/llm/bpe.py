"""Byte-level BPE through a sentencepiece model that is serialised from the rank file.

Every byte is mapped to one printable character; a vocabulary entry becomes a piece of these characters whose score is its
negative rank, and the normaliser is the identity, so sentencepiece merges exactly in the order of the ranks.
Pre-tokens (matches of the public pattern) are encoded one by one; ids decode by the inverse mapping.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import NULL_ID, doc_rows, public_id
from .tokens import MARKS, text_batches

#: Pieces that a Python worker keeps in memory while it encodes.
REMEMBERED = 500_000
#: Ids decoded or written out at a time.
STRETCH = 1 << 16


def byte_characters() -> list[str]:
    """A printable character for each byte: itself where it is one, else the next free one from 256 on."""
    own = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    others = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(others)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: bytes | int | float) -> bytes:
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def model_bytes(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece ModelProto: piece 0 is the unknown piece, piece r + 1 the entry of rank r."""
    chars = byte_characters()
    unknown = _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2)
    pieces = [_field(1, unknown)]
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        text = "".join(chars[b] for b in token).encode()
        pieces.append(_field(1, _field(1, text) + _field(2, float(-rank)) + _field(3, 1)))
    trainer = _field(3, 2) + _field(4, len(ranks) + 1) + _field(40, 0)
    trainer += b"".join(_field(n, 2**64 - 1) for n in (41, 42, 43))  # no begin, end or padding piece
    normalizer = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(pieces) + _field(2, trainer) + _field(3, normalizer)


class BytePairs:
    def __init__(self, path: str, pattern: str):
        import regex
        import sentencepiece

        self.ranks = ranks = read_ranks(path)
        if sorted(ranks.values()) != list(range(len(ranks))):
            raise ValueError("ranks must run from 0 without gaps")
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model_bytes(ranks))
        self.match = regex.compile(pattern).findall
        self.table = {b: c for b, c in enumerate(byte_characters())}
        self.known: dict[str, bytes] = {}
        self.marks: dict[str, bytes] = {}
        # As in the rank file's own library, a whole entry is its own id, also where merges don't lead to it.
        entries = sorted(ranks, key=ranks.__getitem__)
        mapped = [self._mapped(b) for b in entries]
        ids = self.model.encode(mapped, out_type=int, num_threads=1)
        self.whole_entries = {m: [k + 1] for k, (m, got) in enumerate(zip(mapped, ids, strict=True)) if got != [k + 1]}
        sizes = np.array([len(b) for b in entries])
        self.blob, self.sizes, self.begins = np.frombuffer(b"".join(entries), np.uint8), sizes, np.cumsum(sizes) - sizes
        digits = np.array([f" {k}" for k in range(len(entries))], "S")
        self.digits = digits.view(np.uint8).reshape(len(entries), digits.itemsize)
        # Letters that the pattern keeps together after a space, and that it parts from the marks after them.
        alone = [c for c in map(chr, range(0x250)) if c.isalpha() and self.match(f" {c}{c}") == [f" {c}{c}"]]
        self.letters = frozenset(c for c in alone if self.match(f" {c}{MARKS}") == [f" {c}", MARKS])

    def _mapped(self, raw: bytes) -> str:
        return raw.decode("latin-1").translate(self.table)

    def _packed(self, tokens: list[str]) -> dict[str, bytes]:
        """The ids of each pre-token."""
        mapped = [self._mapped(t.encode("utf-8")) for t in tokens]
        out = self.model.encode(mapped, out_type=int, num_threads=1)
        if self.whole_entries:
            entry = self.whole_entries.get
            out = [entry(m, ids) for m, ids in zip(mapped, out, strict=True)]
        buf = (np.fromiter(chain.from_iterable(out), "<u4") - np.uint32(1)).tobytes()
        ends = list(accumulate([4 * len(ids) for ids in out]))
        return {t: buf[begin:end] for t, begin, end in zip(tokens, [0, *ends], ends, strict=False)}

    def wholes(self, texts: set[str]) -> dict[str, bytes]:
        """Texts encoded without cuts, all their pre-tokens together."""
        cut = {t: self.match(t) for t in texts}
        own = self._packed(list(set().union(*cut.values())))
        return {t: b"".join([own[x] for x in tokens]) for t, tokens in cut.items()}

    def _cut(self, piece: str) -> list[str]:
        """The pre-tokens of a piece with the space before it."""
        stem = piece.rstrip(MARKS)
        if stem.isalpha() and (stem.isascii() or self.letters.issuperset(stem)):
            return [f" {stem}", piece[len(stem) :]] if len(stem) < len(piece) else [f" {stem}"]
        return self.match(f" {piece}")

    def _learn(self, pieces: list[str], table: dict[str, bytes]) -> None:
        """Puts the ids of pieces (a space goes before each) into ``table``, each distinct pre-token encoded once."""
        known, marks = self.known, self.marks
        cut = {p: self._cut(p) for p in pieces}
        distinct = set(chain.from_iterable(cut.values()))
        ids = {t: x for t in distinct if (x := marks.get(t) or (known.get(t[1:]) if t[0] == " " else None)) is not None}
        own = self._packed([t for t in distinct if t not in ids])
        if len(marks) > REMEMBERED // 8:
            marks.clear()
        for t, x in own.items():
            if t[0] == " " and not t[-1].isspace():
                table[t[1:]] = x
            else:
                marks[t] = x
        ids |= own
        for p, ts in cut.items():
            table[p] = ids[ts[0]] if len(ts) == 1 else b"".join([ids[t] for t in ts])

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids.  A match never goes on over a space after a word, so texts are cut there."""
        known = self.known
        heads, rests, found, need = [], [], [], set()
        for text in texts:
            rest = text.split(" ")
            heads.append(rest.pop(0))
            got = list(map(known.get, rest))
            lacking = None in got
            if lacking:
                need.update([p for p, ids in zip(rest, got, strict=True) if ids is None])
            rests.append(rest if lacking else [])
            found.append(got)
        odd = {p for p in need if not p or p[-1].isspace()}  # white space before a space: the text whole
        uncut = [bool(h and h[-1].isspace()) or not odd.isdisjoint(r) for h, r in zip(heads, rests, strict=True)]
        first = self.wholes({t if u else h for t, h, u in zip(texts, heads, uncut, strict=True)})
        table = known if len(known) + 2 * len(need) <= REMEMBERED else {}
        self._learn([p for p in need if p not in odd], table)
        out = []
        for text, head, rest, got, u in zip(texts, heads, rests, found, uncut, strict=True):
            if u:
                out.append(first[text])
                continue
            if rest:
                got = [table[p] if ids is None else ids for p, ids in zip(rest, got, strict=True)]
            out.append(first[head] + b"".join(got))
        return out

    def decode(self, ids: bytes) -> bytes:
        """The bytes of the entries, by inverse mapping."""
        every, out = np.frombuffer(ids, "<u4"), []
        for k in range(0, len(every), STRETCH):
            part = every[k : k + STRETCH]
            sizes = self.sizes[part]
            ends = np.cumsum(sizes)
            at = np.repeat(self.begins[part] - ends + sizes, sizes)
            at += np.arange(len(at))
            out.append(self.blob[at].tobytes())
        return b"".join(out)

    def decimals(self, ids: bytes) -> bytes:
        """Decimal ids joined by one space."""
        every, out = np.frombuffer(ids, "<u4"), []
        for k in range(0, len(every), STRETCH):
            rows = self.digits[every[k : k + STRETCH]]
            out.append(rows[rows != 0].tobytes())
        return b"".join(out)[1:]


@lru_cache(1)
def byte_pairs(path: str, pattern: str) -> BytePairs:
    return BytePairs(path, pattern)


def encode_documents(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and ids (little-endian unsigned 32-bit) of every text.  Null and empty texts have no ids."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = byte_pairs(path, pattern)
        for batch in batches:
            for ids, texts in text_batches(batch):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(own.encode(texts), pa.binary())], names=["doc_id", "ids"]
                )

    return doc_rows(docs).mapInArrow(encode, "doc_id long, ids binary").withColumn("doc_id", public_id())


def decode_documents(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids and decoded (bytes) of what encode_documents gave."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = byte_pairs(path, pattern)
        for b in batches:
            for k in range(0, b.num_rows, 500):
                part = b.slice(k, 500)
                decoded = pa.array([own.decode(x.as_py()) for x in part.column("ids")], pa.binary())
                cols = [part.column("doc_id"), part.column("ids"), decoded]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "ids", "decoded"])

    return encoded.mapInArrow(decode, "doc_id long, ids binary, decoded binary")


def round_trip(
    docs: DataFrame, path: str, pattern: str, derive: Callable[[BytePairs, pa.RecordBatch], pa.RecordBatch], schema: str
) -> DataFrame:
    """What ``derive`` makes (by ``schema``) of batches of doc_id, ids and decoded.

    Encoding, decoding of the ids and ``derive`` share a Python worker, so ids and bytes needn't leave it.
    """

    def steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = byte_pairs(path, pattern)
        for batch in batches:
            for doc_ids, texts in text_batches(batch):
                ids = own.encode(texts)
                doc_ids = [None if k == NULL_ID else k for k in doc_ids]
                cols = [pa.array(doc_ids, pa.int64()), pa.array(ids, pa.binary()), pa.array(map(own.decode, ids), pa.binary())]
                yield derive(own, pa.RecordBatch.from_arrays(cols, names=["doc_id", "ids", "decoded"]))

    return doc_rows(docs).mapInArrow(steps, schema)
