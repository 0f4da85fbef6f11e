"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from binfields.llm.common import checkpoint, narrowed


def local_forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (a, b) to a spanning forest of each batch with the same components: (larger, root) with root the smallest."""
    for batch in batches:
        a, b = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        nodes, places = np.unique(np.concatenate([a, b]), return_inverse=True)
        parent = np.arange(len(nodes))
        x, y = places[: len(a)], places[len(a) :]
        while len(x):  # hook the larger root under the smaller, then halve the paths
            low, high = np.minimum(x, y), np.maximum(x, y)
            np.minimum.at(parent, high, low)
            while (parent != (up := parent[parent])).any():
                parent = up
            x, y = parent[x], parent[y]
            keep = x != y
            x, y = x[keep], y[keep]
        child = np.flatnonzero(parent != np.arange(len(nodes)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[child]), pa.array(nodes[parent[child]])], names=["a", "b"])


def components(edges: DataFrame, *, max_rounds: int = 60) -> DataFrame:
    """node, component (its smallest node) of every node with an edge; edges has columns a and b of type long."""
    now = checkpoint(edges.filter("a <> b").select("a", "b").mapInArrow(local_forest, "a long, b long").distinct())
    rows = now.count()
    now = narrowed(now, rows)
    for _ in range(max_rounds):
        large = _large_star(now, rows)
        small = checkpoint(narrowed(_small_star(large, rows), rows))
        found = small.count()
        same = found == rows and small.exceptAll(now).isEmpty()
        now, rows = small, found
        if same:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
    raise RuntimeError(f"components not settled after {max_rounds} rounds")


def _large_star(edges: DataFrame, rows: int) -> DataFrame:
    """Each node sends its larger neighbours to the smallest of its neighbours and itself: a row for each edge, repeats stay."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
    return narrowed(both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")), rows)


def _small_star(edges: DataFrame, rows: int) -> DataFrame:
    """Each node sends itself and its smaller neighbours to the smallest of them: no more rows than edges."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b")
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return narrowed(moved.unionByName(least.select("a", F.col("m").alias("b"))), rows).distinct()
