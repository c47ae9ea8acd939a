"""Plain versions of the contracts, one document or pair at a time."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import xxhash

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def crc(ids) -> int:
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def exact(docs):
    groups = defaultdict(list)
    for i, t in docs:
        groups[(t or "").translate(LOWER)].append(i)
    out = set()
    for t, ids in groups.items():
        out |= {(i, max(ids), len(ids), i == max(ids), sha(t.encode())) for i in ids}
    return out


def suffix(docs, window=400):
    count = Counter()
    data = {i: (t or "").encode() for i, t in docs}
    for b in data.values():
        for k in range(len(b) - window + 1):
            count[hashlib.md5(b[k : k + window]).digest()] += 1
    out = set()
    for i, b in data.items():
        gone = bytearray(len(b))
        for k in range(len(b) - window + 1):
            if count[hashlib.md5(b[k : k + window]).digest()] > 1:
                gone[k : k + window] = b"\x01" * window
        kept = bytes(c for c, g in zip(b, gone) if not g)
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.add((i, len(b), sum(gone), spans, sha(kept)))
    return out


def fingerprint(text, shingle=3):
    words = WORDS.findall((text or "").translate(LOWER))
    if not words:
        return 0
    grams = [" ".join(words[k : k + shingle]) for k in range(len(words) - shingle + 1)] or [" ".join(words)]
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def simhash(docs, radius=3):
    fps = {i: fingerprint(t) for i, t in docs}
    root = {i: i for i in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(fps)
    for a in range(len(ids)):
        for b in range(a):
            if (fps[ids[a]] ^ fps[ids[b]]).bit_count() <= radius:
                x, y = find(ids[a]), find(ids[b])
                root[max(x, y)] = min(x, y)
    return {(i, f"{fps[i]:016x}", find(i)) for i in ids}


def passages(docs, window=50):
    first = {}
    words = {i: WORDS.findall(t or "") for i, t in docs}
    for i in sorted(words):
        for k in range(len(words[i]) - window + 1):
            first.setdefault(tuple(words[i][k : k + window]), i)
    out = set()
    for i, w in words.items():
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < i:
                gone[k : k + window] = [True] * window
        out.add((i, len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone) if not g).encode())))
    return out


def measures(docs):
    out = set()
    for i, t in docs:
        t = t or ""
        w = WORDS.findall(t)
        seen, dup = set(), 0
        for line in t.split("\n"):
            if WORDS.search(line):
                dup += line in seen
                seen.add(line)
        grams = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        count = Counter(grams)
        over = {k + j for k, g in enumerate(grams) if count[g] > 1 for j in range(3)}
        failed = len(w) < 50 or 100 * len(over) > 50 * len(w)
        out.add((i, len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), dup, len(over), failed))
    return out


def packing_faults(rows, docs, tokenizer, capacity=4096):
    """rows: doc_id, piece, start, length, ids_crc32, sequence_id, offset.  None if they are a packing of the documents."""
    own = defaultdict(list)
    for r in rows:
        own[r[0]].append(r)
    for i, t in docs:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        want = {(i, k // capacity, k, len(ids[k : k + capacity]), crc(ids[k : k + capacity])) for k in range(0, len(ids), capacity)}
        if {tuple(r[:5]) for r in own[i]} != want or len(own[i]) != len(want):
            return f"pieces of {i}"
    slots = defaultdict(list)
    for r in rows:
        slots[r[5]].append((r[6], r[3]))
    for s, parts in slots.items():
        at = 0
        for offset, length in sorted(parts):
            if offset != at:
                return f"sequence {s}"
            at += length
        if at > capacity:
            return f"sequence {s} is too long"
    return None


def middle(i, t):
    t = t or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", t)
    n, digest = len(units), sha(f"1:{'' if i is None else i}".encode())
    h1, h2, h3, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    if not t or any(x in t for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return i, n, "plain", None, None, t
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    out = f"<S>{s}<P>{p}<M>{m}" if h4 % 100 < 20 else f"<P>{p}<S>{s}<M>{m}"
    return i, n, "spm" if h4 % 100 < 20 else "psm", len(p), len(m), out


def lloyd(rows, k=16, rounds=3, dim=64):
    kept = [(i, v) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    kept = [(i, [math.floor(64 * x) for x in v]) for i, v in kept]
    order = sorted(kept, key=lambda r: (sha(f"1:{'' if r[0] is None else r[0]}".encode()), r[1]))
    centroids = [v for _, v in order[:k]]

    def assigned():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids)) for _, v in kept]

    for _ in range(rounds):
        at = assigned()
        for j in range(len(centroids)):
            own = [v for (_, v), (_, other) in zip(kept, at) if other == j]
            if own:
                centroids[j] = [sum(x) // len(own) for x in zip(*own)]
    at, inertia = assigned(), Counter()
    for d, j in at:
        inertia[j] += d
    shas = [sha(",".join(map(str, c)).encode()) for c in centroids]
    return sorted(((i, j, d, inertia[j], inertia.total(), shas[j]) for (i, _), (d, j) in zip(kept, at)), key=str)


ITEM_WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def contamination(docs, items, window=10):
    words = lambda t: ITEM_WORDS.findall((t or "").translate(LOWER))
    windows = defaultdict(set)
    for i, t in items:
        w = words(t)
        n = min(window, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            windows[tuple(w[k : k + n])].add("" if i is None else str(i))
    out = set()
    for i, t in docs:
        w, hit, ids = words(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                own = windows.get(tuple(w[k : k + n]))
                if own:
                    ids |= own
                    hit |= set(range(k, k + n))
        out.add((i, len(w), len(hit), len(ids), ",".join(sorted(ids)), bool(hit)))
    return out
