"""Nearest neighbours by multi-index hashing: rotated binary codes, each substring indexed, floats decide.

1. A rotation is learned on a bounded sample (``sample`` vectors, at most): principal directions, then turns that make
   the signs lose least. A code is the signs of the turned vector.
2. The index is a table of blocks of at most ``block`` vectors; every vector is in it. A block has the ids, the codes,
   the vectors, and for each substring of the code the order of its codes by that substring.
3. A code within ``radius`` bits of a query agrees with it up to r_j bits in some substring j, where the r_j + 1 add up to
   radius + 1 (pigeonhole). So all codes in the radius are in the buckets probed; their number of differing bits is
   checked, and the vectors of those in the radius are compared in double precision. Queries meet blocks by an
   equi-join in groups of ``group``; each answers with its k nearest of the block, and those are merged.

The radius is learned on the sample too: as many bits as ``recall`` of the true neighbours of sampled queries need.
Neighbours in a sample are farther than in the whole table, so the whole table's recall is higher. Queries with fewer
than k in the radius are run again with all codes in it.

Defined cases: vectors that are null, zero or hold null or non-finite components take no part, nor do rows with a null id;
missing components of shorter vectors count as 0; rows with the query's id are its own; an id with several vectors has
the smallest of its distances; fewer than k candidates give all; empty tables give an empty result; other columns are
left out. Ids are whole numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from binfields.llm.clustering import finite_vector
from binfields.llm.common import checkpoint

BITS = 64


class Codes:
    """Codes of 64 signs, learned on the rows of ``sample``."""

    def __init__(self, sample: np.ndarray, turns: int = 40, seed: int = 42):
        self.mean = sample.mean(0)
        centred = sample - self.mean
        _, _, axes = np.linalg.svd(centred.T @ centred)
        axes = axes[:BITS].T
        flat, rng, made = centred @ axes, np.random.default_rng(seed), []
        # vectors of fewer components than bits take several rotations
        while sum(m.shape[1] for m in made) < BITS:
            turn, _ = np.linalg.qr(rng.standard_normal((axes.shape[1],) * 2))
            for _ in range(turns):
                left, _, right = np.linalg.svd(np.where(flat @ turn > 0, 1.0, -1.0).T @ flat)
                turn = (left @ right).T
            made.append(axes @ turn)
        self.axes = np.concatenate(made, 1)[:, :BITS]

    def of(self, rows: np.ndarray) -> np.ndarray:
        signs = (rows - self.mean) @ self.axes > 0
        return np.packbits(signs, axis=1, bitorder="little").view(np.uint64)[:, 0]


def substrings(codes: np.ndarray, parts: int) -> np.ndarray:
    """One row of keys for each substring; 64 bits in ``parts`` equal pieces."""
    width = BITS // parts
    return np.stack([(codes >> np.uint64(width * j)) & np.uint64(2**width - 1) for j in range(parts)])


def part_radii(radius: int, parts: int) -> list[int]:
    """Bits allowed in each substring (-1: none is probed): each plus one, they add up to radius + 1."""
    return [(radius + 1) // parts - 1 + (j < (radius + 1) % parts) for j in range(parts)]


def _learned_radius(vectors: np.ndarray, codes: np.ndarray, k: int, recall: float, queries: int = 256) -> int:
    apart = []
    for q in range(min(queries, len(vectors))):
        gap = ((vectors - vectors[q]) ** 2).sum(1)
        gap[q] = np.inf
        near = np.argsort(gap, kind="stable")[: min(k, len(vectors) - 1)]
        apart.append(np.bitwise_count(codes[near] ^ codes[q]))
    every = np.concatenate(apart) if apart else np.zeros(0)
    return int(np.quantile(every, recall, method="higher")) if len(every) else BITS


def _rows(column: pa.Array, width: int) -> np.ndarray:
    """Vectors as rows of a matrix; missing components are 0."""
    lengths = pa.compute.list_value_length(column).to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), width))
    out[np.arange(width) < lengths[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def build_index(vectors: DataFrame, codes: Codes, width: int, *, parts: int, block: int) -> DataFrame:
    """Blocks of vectors (id, v): block, n, ids, codes, orders, floats."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, ids, rows, held = TaskContext.get().partitionId() << 32, [], [], 0

        def full() -> pa.RecordBatch:
            own, floats = np.concatenate(ids)[:block], np.concatenate(rows)[:block]
            made = codes.of(floats)
            orders = np.argsort(substrings(made, parts), axis=1, kind="stable").astype(np.int32)
            packed = [a.tobytes() for a in (own, made, orders, floats)]
            return pa.RecordBatch.from_arrays([pa.array([number]), pa.array([len(own)]), *(pa.array([p], pa.binary()) for p in packed)], names=["block", "n", "ids", "codes", "orders", "floats"])

        for batch in batches:
            ids.append(batch.column(0).to_numpy().astype(np.int64))
            rows.append(_rows(batch.column(1), width))
            held += batch.num_rows
            while held >= block:
                yield full()
                ids, rows = [np.concatenate(ids)[block:]], [np.concatenate(rows)[block:]]
                held, number = held - block, number + 1
        if held:
            yield full()

    return vectors.select("id", "v").mapInArrow(pack, "block long, n long, ids binary, codes binary, orders binary, floats binary")


class _Block:
    def __init__(self, ids: bytes, codes: bytes, orders: bytes, floats: bytes, width: int, parts: int):
        self.ids, self.codes = np.frombuffer(ids, np.int64), np.frombuffer(codes, np.uint64)
        self.floats = np.frombuffer(floats, np.float64).reshape(-1, width)
        self.orders = np.frombuffer(orders, np.int32).reshape(parts, -1)
        self.buckets = [np.unique(keys[order], return_index=True) for keys, order in zip(substrings(self.codes, parts), self.orders, strict=True)]

    def within(self, code: np.uint64, keys: np.ndarray, radius: int, allowed: list[int]) -> np.ndarray:
        """Places of all codes that differ in ``radius`` bits at most, by the buckets near the query's substrings."""
        seen = np.zeros(len(self.codes), bool)
        for order, (bucket, begin), key, most in zip(self.orders, self.buckets, keys, allowed, strict=True):
            if most >= 0:
                near = np.bitwise_count(bucket ^ key) <= most
                seen[order[np.repeat(near, np.diff(begin, append=len(order)))]] = True
        found = np.flatnonzero(seen)
        return found[np.bitwise_count(self.codes[found] ^ code) <= radius]


def _answer(codes: Codes, width: int, parts: int, radius: int, k: int):
    allowed = part_radii(radius, parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                q_ids, q_floats, *packed = (batch.column(c)[row].as_py() for c in range(batch.num_columns))
                own, asked, vectors = _Block(*packed, width, parts), np.frombuffer(q_ids, np.int64), np.frombuffer(q_floats, np.float64).reshape(-1, width)
                made = codes.of(vectors)
                keys, out = substrings(made, parts), []
                for n, q in enumerate(asked):
                    found = own.within(made[n], keys[:, n], radius, allowed)
                    found = found[own.ids[found] != q]
                    gap = own.floats[found] - vectors[n]
                    gap = (gap * gap).sum(1)
                    ids = own.ids[found]
                    if len(ids) > 8 * k:  # all that are as near as the 8k-th: an id may have several vectors
                        near = np.flatnonzero(gap <= np.partition(gap, 8 * k)[8 * k])
                        if len(np.unique(ids[near])) >= k:
                            ids, gap = ids[near], gap[near]
                    order = np.lexsort((ids, gap))
                    ids, gap = ids[order], gap[order]
                    first = np.sort(np.unique(ids, return_index=True)[1])[:k]
                    out.append((np.full(len(first), q), ids[first], gap[first]))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["query_id", "id", "d2"])

    return run


def _groups(asked: DataFrame, width: int, size: int) -> DataFrame:
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                some = batch.slice(at, size)
                yield pa.RecordBatch.from_arrays([pa.array([some.column(0).to_numpy().astype(np.int64).tobytes()], pa.binary()), pa.array([_rows(some.column(1), width).tobytes()], pa.binary())], names=["q_ids", "q_floats"])

    return asked.select("id", "v").mapInArrow(pack, "q_ids binary, q_floats binary")


def nearest_neighbours(
    rows: DataFrame,
    is_query: Column,
    *,
    k: int = 10,
    parts: int = 4,
    radius: int | None = None,
    recall: float = 0.97,
    sample: int = 8192,
    block: int = 8192,
    group: int = 256,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
) -> DataFrame:
    """query_id, rank (from 1), id, score (Euclidean distance) of each query's k nearest found; ties go to the smaller id.

    ``is_query`` is a condition on the id column that states the query set.
    """
    doubles = F.transform(vector_column, lambda x: x.cast("double"))
    plain = rows.select(F.col(id_column).alias("id"), doubles.alias("v"))
    vectors = checkpoint(plain.filter(F.col("id").isNotNull() & finite_vector(F.col("v"))).filter(F.exists("v", lambda x: x != 0)))
    size = vectors.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("v")), F.lit(0)).alias("width")).first()
    out = "query_id long, rank int, id long, score double"
    if not size["n"]:
        return vectors.sparkSession.createDataFrame([], out).withColumnRenamed("id", id_column)
    width = size["width"]
    sample = max(256, min(sample, (4 << 20) // width))  # 32 MB at most for any width up to 16,384
    # rows as they lie in the written table, so that copies of one row do not go together
    place = F.xxhash64("id", F.monotonically_increasing_id())
    share = int(2**40 * min(1.0, sample / size["n"]))
    chosen = vectors.filter(F.pmod(place, F.lit(2**40)) < share).collect()  # about ``sample`` rows
    drawn = np.zeros((len(chosen), width))
    for n, r in enumerate(sorted(chosen, key=lambda r: (r["id"], r["v"]))):
        drawn[n, : len(r["v"])] = r["v"]
    drawn = drawn[np.random.default_rng(7).permutation(len(drawn))]
    codes = Codes(drawn if len(drawn) else np.zeros((1, width)))
    if radius is None:
        radius = _learned_radius(drawn, codes.of(drawn), k, recall)
    index = checkpoint(build_index(vectors.coalesce(max(1, -(-size["n"] // block))), codes, width, parts=parts, block=block))
    asked = vectors.withColumnRenamed("id", id_column).filter(is_query).withColumnRenamed(id_column, "id").distinct()
    asked = checkpoint(asked)
    tasks = index.count()
    routed = index.withColumn("route", F.pmod(F.xxhash64("block"), F.lit(tasks)).cast("int")).repartition(tasks, "route")

    def found(queries: DataFrame, reach: int) -> DataFrame:
        # every group goes to every route, and so to every block; blocks are larger and stay
        grouped = _groups(queries.coalesce(max(1, -(-queries.count() // group))), width, group)
        sent = grouped.select(F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))).alias("route"), "q_ids", "q_floats")
        cells = sent.repartition(tasks, "route").join(routed, "route").select("q_ids", "q_floats", "ids", "codes", "orders", "floats")
        local = cells.mapInArrow(_answer(codes, width, parts, reach, k), "query_id long, id long, d2 double")
        nearest = local.groupBy("query_id", "id").agg(F.min("d2").alias("d2"))
        ranked = nearest.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("d2", "id")))
        return checkpoint(ranked.filter(F.col("rank") <= k))

    first = found(asked, radius)
    few = asked.join(first.groupBy("query_id").count().filter(F.col("count") >= k).select(F.col("query_id").alias("id")), "id", "left_anti")
    if radius < BITS and not few.isEmpty():
        more = found(few, BITS)
        first = first.join(more.select("query_id").distinct(), "query_id", "left_anti").unionByName(more)
    return first.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_column), F.sqrt("d2").alias("score"))
