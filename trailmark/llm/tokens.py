"""Token ids of whole texts through a public ``tokenizers`` file, as little-endian unsigned 32-bit buffers.

Both vocabularies cut a text before an ASCII space that follows a word, so the piece between two such spaces has the
same ids wherever it stands.  Pieces are looked up in a bounded table per Python worker; words not seen yet are
encoded many in one text.  Texts where the cut isn't certain (runs of white space, the string of an added token, which the
library takes for that token wherever it stands) are encoded whole.
"""

from __future__ import annotations

import os
import string
from collections.abc import Iterator

import numpy as np

#: ASCII marks but the apostrophe, which begins contractions.
MARKS = string.punctuation.replace("'", "")
#: Pieces that a worker remembers; further ones are encoded for each batch anew.
REMEMBERED = 1_400_000
_workers: dict[tuple, PieceEncoder] = {}


def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class PieceEncoder:
    """spaced: the vocabulary keeps white space (a piece's leading space belongs to it); else white space is dropped."""

    def __init__(self, path: str, spaced: bool, remembered: int = REMEMBERED):
        self.tokenizer, self.spaced, self.remembered = tokenizer(path), spaced, remembered
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known: dict[str, bytes] = {}
        self.tails: dict[str, bytes] = {}
        # ids that begin a word after a space, or that end a word
        tokens = self.tokenizer.get_vocab(with_added_tokens=False)
        self.edge = np.zeros(self.tokenizer.get_vocab_size() + 1, bool)
        self.edge[[i for t, i in tokens.items() if (t[0] == "\u0120" if spaced else t.endswith("</w>"))]] = True

    def ids(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _stem(self, piece: str) -> str:
        """The letters before a run of ASCII marks, which are apart in any case; in lower case where case is dropped.

        Empty where dropping the case gives the last letter a mark of its own, which joins the marks that follow.
        """
        stem = piece.rstrip(MARKS)
        if self.spaced:
            return stem
        if stem.isascii():
            return stem.lower()
        return stem if stem.lower()[-1].isalpha() else ""

    def _tail(self, tail: str) -> bytes:
        if tail not in self.tails:
            if len(self.tails) > self.remembered // 8:
                self.tails.clear()
            self.tails[tail] = self.ids(tail)
        return self.tails[tail]

    def _words(self, words: list[str], table: dict[str, bytes]) -> None:
        """Of words of letters only, many in one text; ids part where a word begins or ends."""
        for k in range(0, len(words), 256):
            part = words[k : k + 256]
            (e,) = self.tokenizer.encode_batch_fast([" " + " ".join(part)], add_special_tokens=False)
            ids = np.array(e.ids, "<u4")
            edges = np.flatnonzero(self.edge[ids])
            if len(edges) != len(part):
                for w in part:
                    table[w] = self.ids(f" {w}")
                continue
            ends = [*edges[1:].tolist(), len(ids)] if self.spaced else (edges + 1).tolist()
            buf, at = ids.tobytes(), 0
            for w, end in zip(part, ends, strict=True):
                table[w] = buf[4 * at : 4 * end]
                at = end

    def _learn(self, pieces: list[str], table: dict[str, bytes]) -> None:
        known = self.known
        lines = {p: p.split("\n") for p in pieces if "\n" in p}
        lines = {p: own for p, own in lines.items() if all(x.split() == [x] for x in own)}
        if lines:  # a single line feed between words is apart from both
            first = {x for own in lines.values() for x in (own[:1] if self.spaced else own)}
            self._learn([x for x in first if x not in known and x not in table], table)
            for p, own in lines.items():
                if self.spaced:
                    parts = [self._tail("\n") + self._tail(x) for x in own[1:]]
                    own = own[:1]
                else:
                    parts = []
                table[p] = b"".join([known[x] if x in known else table[x] for x in own] + parts)
            pieces = [p for p in pieces if p not in lines]
        stems = {p: s for p in pieces if (s := self._stem(p)).isalpha()}
        self._words([s for s in dict.fromkeys(stems.values()) if s not in known and s not in table], table)
        for p in pieces:
            if p not in stems:
                table[p] = self.ids(f" {p}")
            elif p not in table:
                s = stems[p]
                tail = p[len(s) :]
                own = known[s] if s in known else table[s]
                table[p] = own + self._tail(tail) if tail else own

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text, in order."""
        known = self.known
        heads, rests = [], []
        whole = [any(t in text for t in self.added) for text in texts]
        for text, uncut in zip(texts, whole, strict=True):
            pieces = [] if uncut else text.split(" ")
            heads.append(pieces.pop(0) if self.spaced and pieces else "")
            rests.append(pieces)
        need = set().union(*rests).difference(known)
        # A space after white space isn't a cut in a vocabulary that keeps it: such texts are encoded whole.
        odd = {p for p in need if not p or p[-1].isspace()} if self.spaced else set()
        over: dict[str, bytes] = {}
        if need:
            room = len(known) + 2 * len(need) <= self.remembered
            self._learn([p for p in need if p not in odd], known if room else over)
        for text, head, rest, uncut in zip(texts, heads, rests, whole, strict=True):
            if uncut or self.spaced and ((head and head[-1].isspace()) or (odd and not odd.isdisjoint(rest))):
                yield self.ids(text)
                continue
            first = self.ids(head) if head else b""
            try:
                yield first + b"".join(map(known.__getitem__, rest))
            except KeyError:
                yield first + b"".join([known[p] if p in known else over[p] for p in rest])


def encoder(path: str, spaced: bool, remembered: int = REMEMBERED) -> PieceEncoder:
    """The worker's own; it stays for later tasks."""
    key = path, spaced, remembered
    if key not in _workers:
        _workers.clear()
        _workers[key] = PieceEncoder(*key)
    return _workers[key]


def text_batches(batch, most: int = 2_000_000) -> Iterator[tuple[list, list[str]]]:
    """(ids, texts) of a record batch in runs of about ``most`` characters."""
    ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
    begin = size = 0
    for k, t in enumerate(texts):
        size += len(t)
        if size >= most:
            yield ids[begin : k + 1], texts[begin : k + 1]
            begin, size = k + 1, 0
    if begin < len(texts):
        yield ids[begin:], texts[begin:]
