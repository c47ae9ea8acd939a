"""Near duplicates by shingle similarity: covering tables of SimHash bits find pairs, the exact sets decide.

The distinct shingles of a text give SimHash bits, which differ between two texts of similarity s with a known
probability.  The bits are cut into words, and each word is covered as in simhash: of its structured masks one at least leaves
out all differing bits, if these are RADIUS or fewer.  There are as many words as it takes for a pair at the bar to differ in
RADIUS bits or fewer in one word with probability FOUND at least; masks meet many other pairs too, so more are found.
Words grow with the logarithm of the number of texts and so does their number by FOUND, so buckets stay small and the share
found is the same at any size.

Pairs that meet are held against the bits of two other words' prints, then against their sizes and parities (each element flips
one of a set's PARITIES bits, so sets differ in as many elements as bits at least), then their whole sets are compared.

Pairs aren't all compared: in a bucket where many texts are near each other every one is compared with the first at
first; then the pairs of the bucket whose texts aren't connected yet.  What remains is connected already, so the
components are those of all similar pairs that meet.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction
from math import acos, ceil, comb, log2, pi, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import doc_rows, public_id, spread_join, written
from .components import components
from .simhash import RADIUS, majority, masks, named_by, shingle_hashes, signed

SIMILARITY, SHINGLE = 0.8, 5
#: The least probability that the masks are certain to find a pair at the bar, and the least bits of a word.
FOUND, WORD = 0.93, 28
#: Rows of a bucket that one task takes at once, and pairs with one text that one task compares.
BLOCK, PAIRS = 20_000, 4096
#: A bucket is crowded if it has more near pairs than this for each of its rows.  Buckets up to SMALL rows are compared at once.
CROWDED, SMALL = 4, 256
PARITIES = 1024
#: Keys that OFTEN or more of about SAMPLED texts have are dealt to several tasks; this changes no result.
SAMPLED, OFTEN = 20_000, 10


def flip(similarity: float) -> float:
    """How probably a SimHash bit differs between two sets of equal size."""
    return acos(2 * similarity / (1 + similarity)) / pi


def words(n: int, similarity: float = SIMILARITY) -> tuple[int, int]:
    """Bits of a word, and words, for n texts."""
    bits = min(64, max(WORD, 2 * ceil(log2(max(2, n))) - 14))
    p = flip(similarity)
    within = sum(comb(bits, i) * p**i * (1 - p) ** (bits - i) for i in range(RADIUS + 1))
    count = 1
    while 1 - (1 - within) ** count < FOUND:
        count += 1
    return bits, count


def most_differing(bits: int, similarity: float = SIMILARITY) -> int:
    """Bits in which a pair at the bar differs at most, but for one pair in thirty thousand (four deviations)."""
    p = flip(similarity)
    return ceil(bits * p + 4 * sqrt(bits * p * (1 - p)))


def shingle_set(text: str, shingle: int = SHINGLE) -> np.ndarray:
    """Distinct hashes in ascending order; texts without words have one and the same."""
    h = np.unique(shingle_hashes(text, shingle))
    return h if len(h) else np.zeros(1, np.uint64)


def prints(own: np.ndarray, count: int) -> list[int]:
    """``count`` SimHash prints of 64 bits; each rehashes the elements."""
    out = []
    for k in range(count):
        h = own + np.uint64(k * 0x9E3779B97F4A7C15 % 2**64)
        for _ in range(2):
            h = (h ^ h >> np.uint64(31)) * np.uint64(0xD6E8FEB86659FD93)
        out.append(signed(majority(h ^ h >> np.uint64(32))))
    return out


def similar(a: np.ndarray, b: np.ndarray, bar: Fraction) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both * bar.denominator >= bar.numerator * (len(a) + len(b) - both)


def parities(own: np.ndarray) -> bytes:
    return np.packbits(np.bincount((own % np.uint64(PARITIES)).astype(np.int64), minlength=PARITIES) & 1).tobytes()


def _sketched(rows: DataFrame, shingle: int, count: int) -> DataFrame:
    """doc_id, rk, rk2, n (the size of the set), bits (its parities) and its prints fp0, fp1, ..."""
    names = [f"fp{k}" for k in range(count)]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingle_set(t, shingle) for t in b.column("text").to_pylist()]
            own = np.array([prints(x, count) for x in sets], np.int64).reshape(-1, count)
            sizes = pa.array(np.array([len(x) for x in sets], np.int64))
            bits = pa.array([parities(x) for x in sets], pa.binary())
            cols = [*(b.column(c) for c in ("doc_id", "rk", "rk2")), sizes, bits, *map(pa.array, np.ascontiguousarray(own.T))]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "rk", "rk2", "n", "bits", *names])

    return rows.mapInArrow(each, "doc_id long, rk long, rk2 long, n long, bits binary, " + ", ".join(f"{c} long" for c in names))


def _tables(classes: DataFrame, bits: int, count: int, *more: str) -> DataFrame:
    """key, rep, x, y (two prints that the key isn't of) of each covering table, and the columns named in ``more``."""
    own = 64 // bits  # words of a print
    names = [c for c in classes.columns if c.startswith("fp")]
    covering, rows = masks(RADIUS, bits), []
    for w in range(count):
        at, shift = w // own, w % own * bits
        places = [F.lit((at + k) % len(names) + 1).alias(c) for k, c in enumerate(("of", "x", "y"))]
        rows += [F.struct(F.lit(len(rows) + t).alias("t"), F.lit(signed(m << shift)).alias("m"), *places) for t, m in enumerate(covering)]
    # The masks are one constant, so the code doesn't grow with their number.
    each = classes.select("rep", *more, F.array(*names).alias("prints"), F.explode(F.array(*rows)).alias("one"))
    pick = lambda c: F.element_at("prints", F.col(f"one.{c}"))
    key = F.xxhash64("one.t", pick("of").bitwiseAND(F.col("one.m")))
    return each.select(key.alias("key"), pick("x").alias("x"), pick("y").alias("y"), "rep", *more)


def _columns(b: pa.RecordBatch) -> list[np.ndarray]:
    return [c.to_numpy(zero_copy_only=False) for c in b.columns]


def _differ(x: np.ndarray, y: np.ndarray, a: np.ndarray | int, b: np.ndarray) -> np.ndarray:
    """In how many bits of two prints rows a and b differ."""
    return np.bitwise_count((x[a] ^ x[b]).view(np.uint64)) + np.bitwise_count((y[a] ^ y[b]).view(np.uint64))


def _buckets(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[list[np.ndarray], np.ndarray, np.ndarray]]:
    """Columns of sorted rows with the begins and ends of whole buckets of the first ``keys`` columns."""

    def give(cols: list[np.ndarray]):
        new = np.zeros(len(cols[0]), bool)
        new[:1] = True
        for c in cols[:keys]:
            new[1:] |= c[1:] != c[:-1]
        begins = np.flatnonzero(new)
        return cols, begins, np.append(begins[1:], len(new))

    held: list[list[np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        own = _columns(batch)
        held.append(own)
        other = np.zeros(batch.num_rows, bool)
        for c in own[:keys]:
            other |= c != c[-1]
        if other.any():  # the last bucket may go on
            cut = np.flatnonzero(other)[-1] + 1
            yield give([np.concatenate([*before, x[:cut]]) for *before, x in zip(*held, strict=True)])
            held = [[x[cut:] for x in own]]
    if held:
        yield give([np.concatenate(x) for x in zip(*held, strict=True)])


MET = "u long, v long, key long, x long, y long"


def _met(rows: DataFrame, most: int) -> DataFrame:
    """Rows (key, salt, rep, x, y) -> near pairs (u, v); of a crowded bucket only those of rows with its leaders.

    A leader is the first row that no earlier leader is near.  Crowded keys come as rows with a key alone, leaders of a
    salted bucket as (u, key, x, y).
    """

    def leaders(x, y, b: int, e: int) -> Iterator[tuple[int, np.ndarray]]:
        open_ = np.arange(b, e)
        while len(open_):
            first, rest = int(open_[0]), open_[1:]
            near = _differ(x, y, first, rest) <= most
            yield first, rest[near]
            open_ = rest[~near]

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (key, salt, rep, x, y), begins, ends in _buckets(batches, 2):
            sizes, salted = ends - begins, salt[begins] >= 0
            bucket = np.repeat(np.arange(len(begins)), sizes)
            last, small = ends[bucket], (sizes <= SMALL) & ~salted
            at, step, us, vs = np.flatnonzero(small[bucket]), 0, [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            while len(at):  # every row with the next, then the one after that, ...
                step += 1
                at = at[at + step < last[at]]
                near = at[_differ(x, y, at, at + step) <= most]
                us.append(near)
                vs.append(near + step)
            u, v = np.concatenate(us), np.concatenate(vs)
            crowded = salted | (np.bincount(bucket[u], minlength=len(begins)) > CROWDED * sizes)
            plain = ~crowded[bucket[u]]
            us, vs = [u[plain]], [v[plain]]
            for k in np.flatnonzero(~small & ~salted).tolist():
                own_u, own_v, found = [], [], 0
                for i in range(begins[k], ends[k] - 1):
                    near = np.arange(i + 1, ends[k])
                    near = near[_differ(x, y, i, near) <= most]
                    own_u.append(np.full(len(near), i))
                    own_v.append(near)
                    found += len(near)
                    if found > CROWDED * sizes[k]:
                        crowded[k] = True
                        break
                else:
                    us += own_u
                    vs += own_v
            heads = []
            for k in np.flatnonzero(crowded).tolist():
                for first, near in leaders(x, y, begins[k], ends[k]):
                    us.append(np.full(len(near), first))
                    vs.append(near)
                    if salted[k]:
                        heads.append(first)
            u, v = rep[np.concatenate(us)], rep[np.concatenate(vs)]
            full, heads = key[begins[crowded]], np.array(heads, np.int64)
            pairs = [np.minimum(u, v), np.maximum(u, v), None, None, None]
            for cols in (pairs, [None, None, full, None, None], [rep[heads], None, key[heads], x[heads], y[heads]]):
                n = max(len(c) for c in cols if c is not None)
                arrays = [pa.nulls(n, pa.int64()) if c is None else pa.array(c) for c in cols]
                yield pa.RecordBatch.from_arrays(arrays, names=["u", "v", "key", "x", "y"])

    dealt = rows.select("key", "salt", "rep", "x", "y").repartition("key", "salt").sortWithinPartitions("key", "salt", "rep")
    return dealt.mapInArrow(meet, MET)


def _hot(classes: DataFrame, bits: int, count: int, n: int, block: int) -> DataFrame:
    """key, parts: keys that hold many rows of a sample of SAMPLED texts, so at most SAMPLED / OFTEN of each table."""
    share = max(1, n // SAMPLED)
    some = classes.where(F.pmod(F.xxhash64("rep"), F.lit(share)) == 0)
    often = _tables(some, bits, count).groupBy("key").agg(F.count(F.lit(1)).alias("count")).where(F.col("count") >= OFTEN)
    parts = (F.col("count") * share / block + 1).cast("long")
    return written(often.select("key", parts.alias("parts")).where("parts > 1"), "hot")


def _headed(met: DataFrame, most: int, block: int) -> Iterator[DataFrame]:
    """What the leaders of salted buckets give among themselves, as MET.

    Leaders of one key are dealt to buckets of about ``block`` again, which leaves one for each group of near ones and bucket, until
    the key fits one bucket.  Where that no longer halves them, they are far from each other, and meet in blocks two by two.
    """

    def heads_of(found: DataFrame) -> DataFrame:
        return found.where("u is not null and v is null").select("key", F.col("u").alias("rep"), "x", "y")

    heads = written(heads_of(met), "heads")
    n, turn = heads.count(), 0
    while n:
        sizes = heads.groupBy("key").agg(F.count(F.lit(1)).alias("count"))
        dealt = heads.join(written(sizes.withColumn("parts", (F.col("count") / block + 1).cast("long")), "parts"), "key")
        salt = F.when(F.col("parts") > 1, F.pmod(F.xxhash64(F.lit(turn), "rep"), "parts")).otherwise(F.lit(-1))
        found = written(_met(dealt.withColumn("salt", salt.cast("long")), most), "met")
        yield found
        heads = written(heads_of(found), "heads")
        before, n, turn = n, heads.count(), turn + 1
        if n and 2 * n > before:
            yield written(_far(heads, most, block), "far")
            break


def _far(heads: DataFrame, most: int, block: int) -> DataFrame:
    """MET of rows (key, rep, x, y), those of a key dealt in blocks two by two: a bucket holds two blocks at most."""
    sizes = heads.groupBy("key").agg((F.count(F.lit(1)) / block + 1).cast("long").alias("blocks"))
    rows = heads.join(written(sizes, "blocks"), "key").withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    salt = F.least("own", "other") * F.col("blocks") + F.greatest("own", "other")
    return _met(rows.withColumn("salt", salt), most).where("v is not null")


def _candidates(classes: DataFrame, bits: int, count: int, most: int, n: int, block: int) -> tuple[DataFrame, DataFrame]:
    """(pairs u, v that are near in a bucket, crowded keys)."""
    rows = _tables(classes, bits, count)
    hot = _hot(classes, bits, count, n, block)
    salt = F.coalesce(F.pmod(F.xxhash64("rep"), F.col("parts")), F.lit(-1).cast("long"))
    met = written(_met(rows.join(F.broadcast(hot), "key", "left").withColumn("salt", salt), most), "met")
    if hot.take(1):
        for more in _headed(met, most, block):
            met = met.unionByName(more)
    pairs = met.where("v is not null").select("u", "v").distinct()
    return pairs, met.where("u is null").select("key").distinct()


def _open(rows: DataFrame, crowded: DataFrame, linked: DataFrame, bar: Fraction, most: int, block: int, total: int) -> DataFrame:
    """Pairs (u, v) that meet under a crowded key, are near and may be similar, and aren't in one component.

    rows: key, rep, x, y, comp; linked: rep, n, bits.  Keys of more than ``block`` rows are dealt in blocks two by two.  Only
    rows of keys with several components take their parities along.
    """

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, _, _, rep, x, y, comp, n, bits), begins, ends in _buckets(batches, 3):
            own = np.frombuffer(b"".join(bits.tolist()), np.uint64).reshape(len(rep), -1)
            mixed = np.minimum.reduceat(comp, begins) < np.maximum.reduceat(comp, begins)
            us, vs = [], []
            for b, e in zip(begins[mixed].tolist(), ends[mixed].tolist(), strict=True):
                for i in range(b, e - 1):
                    rest = i + 1 + np.flatnonzero(comp[i + 1 : e] != comp[i])
                    rest = rest[_differ(x, y, i, rest) <= most]
                    if len(rest):
                        rest = rest[_may_reach(own[rest] ^ own[i], n[rest] + n[i], bar)]
                        us.append(np.full(len(rest), rep[i]))
                        vs.append(rep[rest])
            if us:
                u, v = np.concatenate(us), np.concatenate(vs)
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v))], names=["u", "v"])

    counts = rows.select("key", "comp").join(crowded, "key", "left_semi").groupBy("key")
    counts = counts.agg(F.count(F.lit(1)).alias("count"), (F.min("comp") < F.max("comp")).alias("mixed"))
    mixed = written(counts.where("mixed").select("key", "count", (F.col("count") / block + 1).cast("long").alias("blocks")), "mixed")
    two = spread_join(rows, mixed, ["key"], "count", total=total).join(linked.select("rep", "n", "bits"), "rep")
    two = two.withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")))
    two = two.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    two = two.withColumn("a", F.least("own", "other")).withColumn("b", F.greatest("own", "other"))
    two = two.select("key", "a", "b", "rep", "x", "y", "comp", "n", "bits")
    return two.repartition("key", "a", "b").sortWithinPartitions("key", "a", "b").mapInArrow(across, "u long, v long").distinct()


def _may_reach(bits: np.ndarray, both: np.ndarray, bar: Fraction) -> np.ndarray:
    """Whether sets that differ in these parities and have so many elements together can be similar enough."""
    num, den = bar.numerator, bar.denominator
    return np.bitwise_count(bits).sum(1, np.int64) * (num + den) <= both * (den - num)


def _likely(pairs: DataFrame, classes: DataFrame, bar: Fraction) -> DataFrame:
    """The pairs (u, v) whose parities differ in no more bits than similar sets can differ in elements."""

    def bits(c: pa.Array) -> np.ndarray:
        return np.frombuffer(b"".join(c.to_pylist()), np.uint64).reshape(len(c), -1)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                both = b.column("nu").to_numpy() + b.column("nv").to_numpy()
                good = _may_reach(bits(b.column("bu")) ^ bits(b.column("bv")), both, bar)
                yield b.select(["u", "v"]).filter(pa.array(good))

    rows = pairs
    for c in ("v", "u"):
        rows = rows.join(classes.select(F.col("rep").alias(c), F.col("n").alias(f"n{c}"), F.col("bits").alias(f"b{c}")), c)
    return rows.select("u", "v", "nu", "nv", "bu", "bv").mapInArrow(near, "u long, v long")


def _linked(pairs: DataFrame, sets: Callable[[DataFrame], DataFrame], bar: Fraction) -> DataFrame:
    """The pairs (u, v) whose sets are similar.  The sets of a text that many are compared with are dealt out."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            both = zip(b.column("a").to_pylist(), b.column("b").to_pylist(), strict=True)
            good = pa.array([similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), bar) for x, y in both], pa.bool_())
            yield b.select(["u", "v"]).filter(good)

    pairs = written(pairs, "pairs")
    own = sets(pairs.select(F.explode(F.array("u", "v")).alias("rep")).distinct())
    hubs = pairs.groupBy("u").count().where(F.col("count") > PAIRS)
    hubs = written(hubs.select("u", (F.col("count") / PAIRS + 1).cast("int").alias("parts")), "hubs")
    dealt = pairs.join(hubs, "u", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    dealt = dealt.select("u", "v", F.pmod(F.xxhash64("v"), F.col("parts")).cast("int").alias("part"))
    first = own.select(F.col("rep").alias("u"), F.col("own").alias("a")).join(hubs, "u", "left")
    first = first.withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    second = own.select(F.col("rep").alias("v"), F.col("own").alias("b"))
    rows = dealt.join(second, "v").join(first, ["u", "part"])
    return written(rows.select("u", "v", "a", "b").mapInArrow(compare, "u long, v long"), "links")


def similar_documents(docs: DataFrame, similarity: float = SIMILARITY, shingle: int = SHINGLE, block: int = BLOCK) -> DataFrame:
    """doc_id, rk (a hash of the text), component and component_id of every row: groups linked by a shingle similarity of
    ``similarity`` or more.

    A text of fewer words than a shingle is one shingle; null, empty and blank texts are equal.  Repeated rows come back as
    often as they stand.  component names a group; component_id is the least doc_id in it, a null id being larger than any.
    """
    bar = Fraction(str(similarity))
    # Equal texts are one class: 128 bits, as 64 may be shared by two among thousands of millions.
    texts = doc_rows(docs).withColumns({"rk": F.xxhash64("text"), "rk2": F.xxhash64(F.lit(2), "text")})
    same = ["rk", "rk2"]
    n = texts.count()
    bits, count = words(n, similarity)
    own = 64 // bits
    sketches = max(3, -(-count // own))
    most = most_differing(2 * 64, similarity)
    found = written(_sketched(texts, shingle, sketches), "sketches")
    names = [f"fp{k}" for k in range(sketches)]
    classes = found.groupBy(*same).agg(F.min("doc_id").alias("least"), F.first(F.struct("n", "bits", *names)).alias("own"))
    classes = written(classes.select(*same, "least", "own.*", F.monotonically_increasing_id().alias("rep")), "classes")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = pa.array([shingle_set(t, shingle).tobytes() for t in b.column("text").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("rep"), own], names=["rep", "own"])

    def sets(reps: DataFrame) -> DataFrame:
        wanted = texts.join(written(classes.select(*same, "rep").join(reps, "rep", "left_semi"), "wanted"), same)
        return written(wanted.select("rep", "text").mapInArrow(hashed, "rep long, own binary").dropDuplicates(["rep"]), "sets")

    pairs, crowded = _candidates(classes, bits, count, most, n, block)
    links = _linked(_likely(pairs, classes, bar), sets, bar)
    whole = components(links)
    crowded = written(crowded, "crowded")
    if crowded.take(1):
        linked = classes.join(whole, classes["rep"] == whole["u"], "left").withColumn("comp", F.coalesce("component", "rep"))
        linked = written(linked.select("rep", "n", "bits", *names, "comp"), "linked")
        rows, total = _tables(linked, bits, count, "comp"), n * count * len(masks(RADIUS, bits))
        more = _linked(_open(rows, crowded, linked, bar, most, block, total), sets, bar)
        if more.take(1):
            whole = components(whole.select("u", F.col("component").alias("v")).unionByName(more))
    named = named_by(classes.select(*same, "rep", "least"), whole)
    return found.select("doc_id", *same).join(named, same).select(
        public_id().alias("doc_id"), "rk", "component", public_id("component_id").alias("component_id")
    )
