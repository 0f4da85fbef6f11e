"""Exact rounds of centroid clustering (Lloyd) on integer vectors, with Ptolemaic lower bounds from cached pivot distances.

For points x, c and a pair of pivots p, s, Ptolemy's inequality gives
|d(x,p) d(c,s) - d(x,s) d(c,p)| <= d(x,c) d(p,s). The pivots are some of the first centroids, chosen far from each other,
and stay for all rounds; each vector's distances to them are computed once and kept beside it. In a round the centroid
of the least bound is measured first; bounds, rounded down by more than floating point can err, tell which other
centroids can be as near, and only those are measured, in whole numbers.

A round is one pass over the vectors: tasks add up their vectors by cluster, and what reaches the driver is ``k`` sums.

Defined cases: vectors that are null, have another number of components, or hold null or non-finite ones take no part
and no row comes out for them; rows with a null id take part, but start a cluster only if others don't suffice; repeated
rows count each; fewer vectors than ``k`` give as many clusters, and no vectors none; ties go to the smaller number;
other columns are left out. Squared distances and sums must fit 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from binfields.llm.common import checkpoint

#: Rounding of a bound, relative to the numbers it comes from: over forty units in the last place.
_SLACK = 1e-14
_ROWS = 4096


def finite_vector(vector: Column) -> Column:
    """Not null, without null, infinite or undefined components; vector is an array of doubles."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & fine


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def _exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of rows (or of rows to one row), exact: by floating point where all sums stay below 2**53."""
    most = float(np.abs(a).max(initial=0)) + float(np.abs(b).max(initial=0))
    kind = np.float64 if most * most * a.shape[-1] < 2**53 else np.int64
    gap = a.astype(kind) - b.astype(kind)
    return (gap * gap).sum(-1).astype(np.int64)


class Pivots:
    """Pivot points, their pairs with the distance between them."""

    def __init__(self, points: np.ndarray):
        self.points = points
        between = np.sqrt(np.stack([_exact(points, p) for p in points]).astype(float))
        self.pairs = [(a, b, between[a, b]) for a, b in combinations(range(len(points)), 2)]

    @classmethod
    def far_apart(cls, points: np.ndarray, n: int) -> Pivots:
        """``n`` of the points, each the farthest from those before it."""
        chosen, gap = [0], _exact(points, points[0])
        while len(chosen) < n and gap.max() > 0:
            chosen.append(int(gap.argmax()))
            gap = np.minimum(gap, _exact(points, points[chosen[-1]]))
        return cls(points[chosen])

    def distances(self, rows: np.ndarray) -> np.ndarray:
        return np.sqrt(np.stack([_exact(rows, p) for p in self.points], 1).astype(float))

    def bounds(self, rows: np.ndarray, others: np.ndarray) -> np.ndarray:
        """Lower bounds of the squared distances between points with these pivot distances; never above the true ones."""
        low = np.zeros((len(rows), len(others)))
        for a, b, between in self.pairs:
            one, two = rows[:, a, None] * others[:, b], rows[:, b, None] * others[:, a]
            np.maximum(low, (np.abs(one - two) - _SLACK * (one + two)) / between, out=low)
        return low * low * (1 - _SLACK)


def _nearest(vectors: np.ndarray, cached: np.ndarray, pivots: Pivots, centroids: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid of each vector, and the squared distance; ``own`` are the centroids' pivot distances."""
    low = pivots.bounds(cached, own)
    label = low.argmin(1)
    best = _exact(vectors, centroids[label])
    open_ = low <= best[:, None]
    open_[np.arange(len(vectors)), label] = False
    for c in range(len(centroids)):
        rows = np.flatnonzero(open_[:, c] & (low[:, c] <= best))
        if len(rows):
            gap = _exact(vectors[rows], centroids[c])
            nearer = (gap < best[rows]) | ((gap == best[rows]) & (c < label[rows]))
            best[rows[nearer]], label[rows[nearer]] = gap[nearer], c
    return label, best


def _assigned(points: DataFrame, pivots: Pivots, centroids: np.ndarray) -> DataFrame:
    """id, cluster, distance."""
    own, width = pivots.distances(centroids), centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                some = batch.slice(at, _ROWS)
                label, gap = _nearest(_matrix(some.column(1), width), _matrix(some.column(2), len(pivots.points)), pivots, centroids, own)
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(label.astype(np.int32)), pa.array(gap)], names=["id", "cluster", "distance"])

    return points.mapInArrow(run, T.StructType([points.schema["id"], T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())]))


def _sums(points: DataFrame, pivots: Pivots, centroids: np.ndarray) -> dict[int, tuple[int, list[int]]]:
    """Number of vectors and sum of each component, by cluster."""
    own, (k, width) = pivots.distances(centroids), centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, width + 1), np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                some = batch.slice(at, _ROWS)
                vectors = _matrix(some.column(1), width)
                label, _ = _nearest(vectors, _matrix(some.column(2), len(pivots.points)), pivots, centroids, own)
                for c in np.unique(label):
                    total[c, :width] += vectors[label == c].sum(0)
                total[:, width] += np.bincount(label, minlength=k)
        held = np.flatnonzero(total[:, width])
        places = np.tile(np.arange(width + 1, dtype=np.int32), len(held))
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(held.astype(np.int32), width + 1)), pa.array(places), pa.array(total[held].ravel())], names=["cluster", "place", "total"])

    out: dict[int, list[int]] = {}
    # k * (width + 1) numbers
    for row in points.mapInArrow(run, "cluster int, place int, total long").groupBy("cluster", "place").agg(F.sum("total").alias("total")).collect():
        out.setdefault(row["cluster"], [0] * (width + 1))[row["place"]] = row["total"]
    return {c: (sums[width], sums[:width]) for c, sums in out.items()}


def cluster_vectors(
    rows: DataFrame,
    k: int = 40,
    *,
    dimensions: int = 64,
    scale: int = 256,
    rounds: int = 5,
    salt: str = "2:",
    pivots: int = 6,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
) -> DataFrame:
    """id, cluster, distance (squared), cluster_inertia, inertia, centroid (components) of every vector that takes part.

    Components count as floor(scale * x). The first centroids are the vectors with the smallest sha256 of salt and id.
    """
    doubles = F.transform(vector_column, lambda x: x.cast("double"))
    whole = F.transform(doubles, lambda x: F.floor(F.lit(float(scale)) * x).cast("long"))
    kept = rows.select(F.col(id_column).alias("id"), whole.alias("v"), (finite_vector(doubles) & (F.size(vector_column) == dimensions)).alias("fine")).filter("fine").drop("fine")
    begin = F.sha2(F.concat(F.lit(salt), F.col("id").cast("string")), 256)
    first = np.array([r["v"] for r in kept.orderBy(begin.asc_nulls_last(), "v").limit(k).collect()], np.int64)
    if not len(first):
        kind = "cluster int, distance long, cluster_inertia long, inertia long, centroid array<long>"
        return kept.sparkSession.createDataFrame([], T.StructType([rows.schema[id_column], *T._parse_datatype_string(kind).fields]))
    fixed = Pivots.far_apart(first, pivots)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gaps = fixed.distances(_matrix(batch.column(1), dimensions))
            starts = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * len(fixed.points))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(starts, pa.array(gaps.ravel()))], names=["id", "v", "p"])

    points = checkpoint(kept.mapInArrow(measure, T.StructType([*kept.schema.fields, T.StructField("p", T.ArrayType(T.DoubleType()))])))
    centroids = first
    for _ in range(rounds):
        centroids = centroids.copy()
        for c, (n, sums) in _sums(points, fixed, centroids).items():
            centroids[c] = [s // n for s in sums]
    found = checkpoint(_assigned(points, fixed, centroids))
    held = {r["cluster"]: r["d"] for r in found.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}
    total = sum(held.values())
    by_cluster = [(c, d, total, centroids[c].tolist()) for c, d in sorted(held.items())]
    told = kept.sparkSession.createDataFrame(by_cluster, "cluster int, cluster_inertia long, inertia long, centroid array<long>")
    return found.withColumnRenamed("id", id_column).join(F.broadcast(told), "cluster").select(id_column, "cluster", "distance", "cluster_inertia", "inertia", "centroid")  # k rows
