"""Centroid clustering by weighted deduplication.

Vectors are quantised to integers and equal ones become one row with a multiplicity.  Lloyd's rounds read these distinct rows
only: each task gives the exact integer sums of its rows, weighted by multiplicity, one row a centroid and component, and
the driver gets one number of each.  At the end the assignments of the distinct vectors are joined back to all ids.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import spread_join, written

#: Quantised components beyond this are held here, so that a long has room for them.
MOST = 2**62
#: Within this, squared distances of a few thousand components are exact in doubles and longs.
SMALL = 2**20
LONGEST = 2**63 - 1


def quantised(vectors: DataFrame, dim: int, scale: int) -> DataFrame:
    """vec_id, q: floor(scale * x) of each component, of vectors of ``dim`` components that are all finite."""
    c = F.col("embedding")
    finite = F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    # in two steps: the first drops what the second can't turn into an integer
    whole = vectors.where(F.coalesce((F.size(c) == dim) & finite, F.lit(False)))
    held = F.transform(c, lambda x: F.greatest(F.least(F.floor(x.cast("double") * scale), F.lit(MOST)), F.lit(-MOST)).cast("long"))
    return whole.select(F.col("vec_id").cast("long").alias("vec_id"), held.alias("q"))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def nearest(q: np.ndarray, centroids: list[list[int]]) -> tuple[np.ndarray, list[int]]:
    """The nearest centroid of each row, the first of equals, and the squared distance."""
    small = max(np.abs(q).max(initial=0), max(abs(x) for c in centroids for x in c)) < SMALL
    kind = np.int64 if small else object
    c, q = np.array(centroids, kind), q.astype(kind)
    if small:  # whole numbers below 2 ** 53 all along
        dots = (q.astype(float) @ c.T.astype(float)).astype(np.int64)
    else:
        dots = q @ c.T
    d = (q * q).sum(1)[:, None] - 2 * dots + (c * c).sum(1)[None, :]
    at = np.argmin(d, axis=1)
    return at.astype(np.int32), d[np.arange(len(d)), at].tolist()


def _sums(distinct: DataFrame, centroids: list[list[int]]) -> dict[int, tuple[int, list[int]]]:
    """Of each centroid that has vectors: how many, and their sums."""
    dim, k = len(centroids[0]), len(centroids)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, dim + 1), object)
        for b in batches:
            q, weight = _matrix(b.column("q"), dim), b.column("weight").to_numpy()
            at, _ = nearest(q, centroids)
            rows = np.concatenate([np.ones((len(q), 1), np.int64), q], axis=1)
            if int(weight.max(initial=0)) * int(np.abs(rows).max(initial=0)) * len(q) >= 2**62:
                rows, weight = rows.astype(object), weight.astype(object)
            rows = rows * weight[:, None]
            for j in np.unique(at):
                total[j] += rows[at == j].sum(0)
        some = [(j, p, total[j, p]) for j in range(k) if total[j, 0] for p in range(dim + 1)]
        cols = list(zip(*some, strict=True)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), pa.array([Decimal(int(x)) for x in cols[2]], pa.decimal128(38, 0))],
            names=["cluster", "place", "part"],
        )

    parts = distinct.mapInArrow(each, "cluster int, place int, part decimal(38,0)")
    got: dict[int, dict[int, int]] = {}
    for j, p, x in parts.groupBy("cluster", "place").agg(F.sum("part")).collect():  # k * (dim + 1) rows at most
        got.setdefault(j, {})[p] = int(x)
    return {j: (own[0], [own[p] for p in range(1, dim + 1)]) for j, own in got.items()}


def first_centroids(rows: DataFrame, k: int, seed: int) -> list[list[int]]:
    """The k vectors of least digest of seed and id; a null id is an empty string there, equal ids go by vector."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256)
    return [list(r["q"]) for r in rows.orderBy(digest, "q").limit(k).select("q").collect()]


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3, dim: int = 64, scale: int = 64, seed: int = 1) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 and weight (how many vectors are equal) of each kept vector.

    vectors: vec_id, embedding.  Vectors of another length, null ones, and those with a null or non-finite component aren't
    kept; components are floor(scale * x), held within 2 ** 62.  Fewer than k vectors are as many centroids.  A distance or inertia
    beyond a long is 2 ** 63 - 1.  Repeated rows are vectors of their own and come back as often as they stand; no rows: none.
    """
    rows = quantised(vectors, dim, scale)
    distinct = written(rows.groupBy("q").agg(F.count(F.lit(1)).alias("weight")), "distinct")
    centroids = first_centroids(rows, k, seed)
    for _ in range(rounds if centroids else 0):
        for j, (n, sums) in _sums(distinct, centroids).items():
            centroids[j] = [s // n for s in sums]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                at, d = nearest(_matrix(b.column("q"), dim), centroids)
                d = pa.array([min(x, LONGEST) for x in d], pa.int64())
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at), d], names=["q", "weight", "cluster", "distance"])

    schema = "q array<long>, weight long, cluster int, distance long"
    found = written(distinct.mapInArrow(assign, schema), "assigned")
    own = F.sum(F.col("weight") * F.col("distance").cast("decimal(19,0)"))
    sums = found.groupBy("cluster").agg(own, F.sum("weight")).collect()  # k rows at most
    inertia, total = {r[0]: int(r[1]) for r in sums}, sum(r[2] for r in sums)
    whole = min(sum(inertia.values()), LONGEST)
    shas = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    about = [(j, min(x, LONGEST), whole, shas[j]) for j, x in inertia.items()]
    about = vectors.sparkSession.createDataFrame(about, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    joined = spread_join(rows, found, ["q"], "weight", total=total).join(F.broadcast(about), "cluster")
    return joined.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "weight")
