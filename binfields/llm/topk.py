"""Exact top-k inner products by a three-phase uniform threshold over dimension lists.

The dimensions are divided into ``lists``; each keeps, for every vector, the part of the score that its dimensions give.
A vector whose parts are all below cutoff / lists cannot reach the cutoff.

1. Each list gives, for each query, its ``depth`` highest parts in every block of vectors; the highest of those over all blocks are scored in full. The
   k-th best full score is a safe cutoff: the answer's k-th score is no less.
2. The cutoff goes to all lists. Each sends every entry whose part reaches cutoff / lists.
3. Parts of one vector are added. Where all parts came, the score is exact; else it is at most the sum plus, for each
   part missing, the largest number below the list's threshold. Vectors whose bound can't reach the k-th best score now
   known are dropped; the rest are scored in full.

Components are turned into integers first, so scores are exact and ties are real. Equal integer vectors are one vector
with its smallest ids, so a vector that is repeated very often costs no more than any other. Queries and vectors meet
in blocks of bounded size; the grid of blocks is dealt over all tasks.

Defined cases: vectors that are null or hold null or non-finite components take no part, as queries or as candidates; nor do rows with a null id;
missing components of shorter vectors count as 0; rows with the same id as the query are its own; an id with several
vectors has the highest of its scores; fewer than k candidates give all; empty tables give an empty result; other
columns are left out. Scores must fit 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  as pa.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from binfields.llm.common import checkpoint, join_counted

_SALTS = 32


def integer_vectors(rows: DataFrame, scale: int, id_column: str, vector_column: str) -> DataFrame:
    """id and vector of floor(scale * x) without trailing zeros, for rows that take part."""
    doubles = F.transform(vector_column, lambda x: x.cast("double"))
    fine = F.forall(doubles, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform(doubles, lambda x: F.floor(F.lit(float(scale)) * x).cast("long"))
    return rows.filter(F.col(id_column).isNotNull() & F.col(vector_column).isNotNull()).filter(fine).select(F.col(id_column).alias("id"), whole.alias("v"))


def _first_ids(vectors: DataFrame, k: int) -> DataFrame:
    """v with its k smallest different ids and a key; in two steps, so that a hot vector is never in one task whole."""
    keyed = vectors.select("id", "v", F.xxhash64("v").alias("h"), F.pmod(F.xxhash64("id"), F.lit(_SALTS)).alias("salt")).dropDuplicates(["id", "v"])
    some = Window.partitionBy("h", "v", "salt").orderBy("id")
    fewer = keyed.withColumn("r", F.row_number().over(some)).filter(F.col("r") <= k)
    return fewer.groupBy("h", "v").agg(F.slice(F.array_sort(F.collect_list("id")), 1, k).alias("ids")).select(F.element_at("ids", 1).alias("n"), "v", "ids")


def _blocks(vectors: DataFrame, lists: int, width: int, size: int) -> DataFrame:
    """Vectors (n, v[, cutoff]) as rows of up to ``size`` of them: part (of dimensions), block, ns, parts (packed int64), cutoffs."""
    edges = np.linspace(0, width, lists + 1).astype(int).tolist()
    has_cutoff = "cutoff" in vectors.columns

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, block = TaskContext.get().partitionId(), 0
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                own = batch.slice(at, size)
                lengths = pa.compute.list_value_length(own.column(1)).to_numpy()
                whole = np.zeros((own.num_rows, width), np.int64)
                whole[np.arange(width) < lengths[:, None]] = own.column(1).flatten().to_numpy()
                ns = own.column(0).to_numpy().astype(np.int64).tobytes()
                cutoffs = own.column(2).to_numpy().astype(np.int64).tobytes() if has_cutoff else b""
                for k in range(lists):
                    yield pa.RecordBatch.from_pydict({"part": pa.array([k], pa.int32()), "block": pa.array([(task << 32) + block], pa.int64()), "ns": pa.array([ns], pa.binary()), "parts": pa.array([np.ascontiguousarray(whole[:, edges[k] : edges[k + 1]]).tobytes()], pa.binary()), "cutoffs": pa.array([cutoffs], pa.binary())})
                block += 1

    columns = ["n", "v", *(["cutoff"] if has_cutoff else [])]
    return vectors.select(*columns).mapInArrow(cut, "part int, block long, ns binary, parts binary, cutoffs binary")


def _grid(queries: DataFrame, vectors: DataFrame) -> DataFrame:
    """Every block of queries with every block of vectors of the same dimensions: the stated query set against all rows.

    Both sides are copied along the other's blocks (their numbers are small: rows over block size) and meet by an equi-join on the cell.
    """
    q_blocks = queries.groupBy("part").agg(F.collect_list("block").alias("qs"))
    v_blocks = vectors.groupBy("part").agg(F.collect_list("block").alias("bs"))
    left = queries.join(v_blocks, "part").select("part", F.col("block").alias("q"), F.explode("bs").alias("b"), F.col("ns").alias("q_ns"), F.col("parts").alias("q_parts"), "cutoffs")
    right = vectors.join(q_blocks, "part").select("part", F.explode("qs").alias("q"), F.col("block").alias("b"), "ns", "parts")
    return left.join(right, ["part", "q", "b"])


def _products(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Exact integer products; by floating point where all sums stay below 2**53."""
    if not q.size or not v.size:
        return np.zeros((len(q), len(v)), np.int64)
    if float(np.abs(q).max()) * float(np.abs(v).max()) * q.shape[1] < 2**53:
        return (q.astype(np.float64) @ v.astype(np.float64).T).astype(np.int64)
    return q @ v.T


def _cells(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """part, numbers of queries and of vectors, scores, cutoffs of each cell, some queries at a time."""
    names = batch.schema.names
    for row in range(batch.num_rows):
        get = {n: batch.column(k)[row].as_py() for k, n in enumerate(names)}
        q_ns, ns = np.frombuffer(get["q_ns"], np.int64), np.frombuffer(get["ns"], np.int64)
        q, v = np.frombuffer(get["q_parts"], np.int64).reshape(len(q_ns), -1), np.frombuffer(get["parts"], np.int64).reshape(len(ns), -1)
        cutoffs = np.frombuffer(get["cutoffs"], np.int64)
        for at in range(0, len(q_ns), 256):
            yield get["part"], q_ns[at : at + 256], ns, _products(q[at : at + 256], v), cutoffs[at : at + 256]


def _entries(part: int, qs: np.ndarray, ns: np.ndarray, scores: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"part": pa.array(np.full(len(qs), part, np.int32)), "q": pa.array(qs), "n": pa.array(ns), "score": pa.array(scores)})


def _highest(depth: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, q_ns, ns, scores, _ in _cells(batch):
                k = min(depth, len(ns))
                top = np.argpartition(-scores, k - 1, axis=1)[:, :k] if k < len(ns) else np.tile(np.arange(len(ns)), (len(q_ns), 1))
                yield _entries(part, np.repeat(q_ns, k), ns[top].ravel(), np.take_along_axis(scores, top, 1).ravel())

    return run


def _above(lists: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, q_ns, ns, scores, cutoffs in _cells(batch):
                at, to = np.nonzero(scores >= -(-cutoffs // lists)[:, None])
                yield _entries(part, q_ns[at], ns[to], scores[at, to])

    return run


def _full_scores(pairs: DataFrame, queries: DataFrame, vectors: DataFrame) -> DataFrame:
    """q, n and their inner product."""
    right = vectors.select("n", F.col("v").alias("b"))
    left = queries.select(F.col("n").alias("q"), F.col("v").alias("a"))
    products = F.aggregate(F.zip_with("a", "b", lambda x, y: F.coalesce(x, F.lit(0)) * F.coalesce(y, F.lit(0))), F.lit(0).cast("long"), lambda s, x: s + x)
    return pairs.select("q", "n").join(right, "n").join(left, "q").select("q", "n", products.alias("score"))


def _best(scores: DataFrame, k: int) -> DataFrame:
    return scores.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "n"))).filter(F.col("r") <= k)


def top_k(
    rows: DataFrame,
    is_query: Column,
    *,
    k: int = 5,
    scale: int = 256,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    lists: int = 2,
    depth: int = 16,
    block: int = 4096,
) -> DataFrame:
    """query_id, rank (from 1), id, score of each query's k highest scores; ties go to the smaller id.

    ``is_query`` is a condition on the id column that states the query set.
    """
    parts = checkpoint(integer_vectors(rows, scale, id_column, vector_column))
    asked = parts.withColumnRenamed("id", id_column).filter(is_query).withColumnRenamed(id_column, "id")
    # one more than k, as a query's own row may be among the best
    vectors = checkpoint(_first_ids(parts, k + 1))
    width = vectors.agg(F.coalesce(F.max(F.size("v")), F.lit(0)).alias("w")).first()["w"]
    own = asked.select("id", "v").distinct().join(vectors.select("v", F.col("n").alias("q")), "v").select("id", "q")
    own = checkpoint(own)
    queries = checkpoint(own.select("q").distinct().join(vectors.select(F.col("n").alias("q"), "v"), "q").select(F.col("q").alias("n"), "v"))
    # few full blocks instead of one small block for each task
    listed = checkpoint(_blocks(vectors.coalesce(max(1, -(-vectors.count() // block))), lists, width, block))
    entries = "part int, q long, n long, score long"

    first = _grid(_blocks(queries, lists, width, block), listed).mapInArrow(_highest(depth), entries)
    merged = first.withColumn("r", F.row_number().over(Window.partitionBy("q", "part").orderBy(F.desc("score"), "n"))).filter(F.col("r") <= 8 * depth)
    named = checkpoint(_full_scores(merged.select("q", "n").distinct(), queries, vectors))
    cutoffs = _best(named, k + 1).groupBy("q").agg(F.when(F.count("*") > k, F.min("score")).alias("cutoff"))
    floor = -(2**62)
    with_cutoff = queries.join(cutoffs.withColumnRenamed("q", "n"), "n", "left").na.fill({"cutoff": floor}).select("n", "v", "cutoff")
    with_cutoff = checkpoint(with_cutoff)
    sent = _grid(_blocks(with_cutoff, lists, width, block), listed).mapInArrow(_above(lists), entries)

    limit = -F.expr(f"(-cutoff - pmod(-cutoff, {lists})) div {lists}")  # cutoff / lists rounded up, in whole numbers
    joined = sent.groupBy("q", "n").agg(F.sum("score").alias("sum"), F.count("*").alias("parts"))
    bounded = joined.join(with_cutoff.select(F.col("n").alias("q"), "cutoff"), "q")
    bounded = checkpoint(bounded.select("q", "n", "parts", "sum", "cutoff", (F.col("sum") + (lists - F.col("parts")) * (limit - 1)).alias("most")))
    whole = bounded.filter(F.col("parts") == lists).select("q", "n", F.col("sum").alias("score"))
    known = whole.unionByName(named).distinct()
    better = _best(known, k + 1).groupBy("q").agg(F.when(F.count("*") > k, F.min("score")).alias("reached"))
    open_ = bounded.filter(F.col("parts") < lists).join(better, "q", "left").filter(F.col("most") >= F.coalesce("reached", F.lit(floor))).select("q", "n")
    rest = _full_scores(open_.join(named.select("q", "n"), ["q", "n"], "left_anti"), queries, vectors)
    scores = checkpoint(known.unionByName(rest).distinct())
    # the k + 1 best different vectors, and what ties with the last of them
    reach = _best(scores, k + 1).groupBy("q").agg(F.min("score").alias("least"))
    near = scores.join(reach, "q").filter("score >= least").select("q", "n", "score")
    listed_ids = near.join(vectors.select("n", F.explode("ids").alias("id")), "n").groupBy("q", "id").agg(F.max("score").alias("score"))
    ranked = Window.partitionBy("q").orderBy(F.desc("score"), "id")
    found = listed_ids.withColumn("r", F.row_number().over(ranked)).filter(F.col("r") <= k + 1)
    best = found.groupBy("q").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "id"))).alias("best"))
    sizes = own.groupBy("q").agg(F.count("*").alias("n"))
    expanded = join_counted(own, checkpoint(best.join(sizes, "q")), ["q"], "n")
    others = F.slice(F.filter("best", lambda x: x["id"] != F.col("query_id")), 1, k)
    out = expanded.select(F.col("id").alias("query_id"), "best").select("query_id", F.posexplode(others).alias("at", "x"))
    return out.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.id").alias(id_column), (-F.col("x.s")).alias("score"))
