"""SimHash near-duplicates by the general pigeonhole principle.

1. A 64-bit fingerprint of each whole text, from XXH64 (seed 42) of its word shingles.
2. Equal fingerprints are one node (counted map-side first, so a hot text is one row for each task).
3. Bits that go together are grouped into partitions: correlations come from bit-pair counts over all nodes.
4. Two fingerprints that differ in at most ``tau`` bits differ, for any thresholds with sum ``tau - parts + 1``, in at
   most the threshold's number of bits in some partition. Each node picks its own thresholds (-1: skip that partition)
   by dynamic programming over candidate counts, which come from histograms of the partition values of all nodes.
5. A node probes every value within its threshold; every node is indexed once in each partition. A verified pair is
   given at the first partition that finds it only.
6. Before that, nodes that share a value are linked to that value's smallest node where that is near enough; pairs
   already in one component are then no longer given. So a large group of near copies gives links in proportion to its size, not pairs.

Defined cases: null, empty and wordless texts have fingerprint zero and are linked like any other; rows with a null id
belong to their component but never name it; repeated rows keep their rows; an empty table gives an empty result;
other columns are left out unless kept on purpose.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from binfields.llm.common import checkpoint, join_counted, narrowed, text_bytes
from binfields.llm.components import components

BITS = 64


def shingle_hashes(text: bytes, shingle: int, seed: int = 42) -> np.ndarray:
    """The hash of every shingle, repeats included, in order; a text of fewer words is one shingle, no words give none."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, "<u8")
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum([len(w) + 1 for w in words])
    first = min(shingle, len(words)) - 1
    begins = [0, *ends[: len(words) - first - 1].tolist()]
    return np.array([digest(joined[a : b - 1], seed) for a, b in zip(begins, ends[first:].tolist(), strict=True)], "<u8")


def fingerprint_of(hashes: np.ndarray) -> int:
    """A bit is 1 if it is set in over half the hashes; none: zero."""
    ones = np.zeros(BITS, np.int64)
    for k in range(0, len(hashes), 1 << 16):  # very long texts in steps
        some = hashes[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(some, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: bytes, shingle: int = 4, seed: int = 42) -> int:
    return fingerprint_of(shingle_hashes(text, shingle, seed))


def fingerprints(docs: DataFrame, *, shingle: int = 4, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id and its fingerprint as a signed long."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[bytes, int] = {}
            values = []
            for text in text_bytes(batch.column(1)):
                if text not in seen:
                    seen[text] = fingerprint(text, shingle)
                values.append(seen[text])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(values, np.uint64).view(np.int64))], names=[id_column, "fingerprint"])

    schema = T.StructType([docs.schema[id_column], T.StructField("fingerprint", T.LongType())])
    return docs.select(id_column, text_column).mapInArrow(hashed, schema)


def _bits(values: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(values).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def bit_pair_counts(nodes: DataFrame) -> tuple[int, np.ndarray]:
    """Number of nodes, and for each pair of bits in how many nodes both are 1 (64 rows for each task)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((BITS, BITS)), 0
        for batch in batches:
            ones = _bits(batch.column(0).to_numpy()).astype(np.float32)
            total += ones.T @ ones
            n += len(ones)
        rows = [pa.array(np.arange(BITS + 1, dtype=np.int32)), pa.array([*total.astype(np.int64).tolist(), [n]], pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(rows, names=["bit", "n"])

    parts = nodes.select("fingerprint").mapInArrow(count, "bit int, n array<long>").select("bit", F.posexplode("n").alias("other", "n"))
    out = np.zeros((BITS + 1, BITS), np.int64)
    for row in parts.groupBy("bit", "other").agg(F.sum("n").alias("n")).collect():  # 64 x 64 + 1 numbers
        out[row["bit"], row["other"]] = row["n"]
    return int(out[BITS, 0]), out[:BITS]


def group_bits(n: int, pairs: np.ndarray, parts: int) -> list[list[int]]:
    """Partitions of (nearly) equal width; each grows by the free bit that is most correlated with it."""
    share = np.diag(pairs) / max(n, 1)
    spread = np.sqrt(np.maximum(share * (1 - share), 1e-12))
    near = np.abs((pairs / max(n, 1) - np.outer(share, share)) / np.outer(spread, spread))
    np.fill_diagonal(near, 0)
    free, groups = set(range(BITS)), []
    for k in range(parts):
        width = BITS // parts + (k < BITS % parts)
        own = [max(sorted(free), key=lambda b: near[b, sorted(free)].sum())]
        free.discard(own[0])
        while len(own) < width:
            best = max(sorted(free), key=lambda b: near[b, own].sum())
            own.append(best)
            free.discard(best)
        groups.append(sorted(own))
    return groups


def signatures(width: int, threshold: int) -> int:
    return sum(comb(width, t) for t in range(threshold + 1)) if threshold >= 0 else 0


def choose_parts(n: int, tau: int, most: int) -> int:
    """The number of partitions with the least probes plus a third of the candidates, were all bits even."""
    costs = {}
    for parts in range(2, most + 1):
        width, spare = BITS // parts, tau - parts + 1
        if spare < 0:
            break
        sizes = [spare // parts + (k < spare % parts) for k in range(parts)]
        probes = n * sum(signatures(width, t) for t in sizes)
        costs[parts] = probes + probes * n / 2.0**width / 3
    return min(costs, key=lambda p: costs[p])


class Partitions:
    """Bit groups, hashed histograms of their values, and thresholds by dynamic programming."""

    #: Values are counted in 2**BUCKET_BITS buckets, exact for partitions of no more bits; a wider one's counts are upper bounds.
    BUCKET_BITS = 16

    def __init__(self, groups: list[list[int]], tau: int, histograms: np.ndarray | None = None, deepest: int = 2) -> None:
        self.groups, self.tau, self.deepest, self.histograms = groups, tau, deepest, histograms
        self.flips = [[np.array([sum(1 << b for b in chosen) for chosen in combinations(range(len(g)), t)], np.uint64) for t in range(deepest + 1)] for g in groups]

    def values(self, fingerprints: np.ndarray, k: int) -> np.ndarray:
        out = np.zeros(len(fingerprints), np.uint64)
        for place, bit in enumerate(self.groups[k]):
            out |= ((fingerprints >> np.uint64(bit)) & np.uint64(1)) << np.uint64(place)
        return out

    def bucket(self, values: np.ndarray, k: int) -> np.ndarray:
        if len(self.groups[k]) <= self.BUCKET_BITS:
            return values.astype(np.int64)
        return ((values * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.BUCKET_BITS)).astype(np.int64)

    def thresholds(self, values: list[np.ndarray]) -> np.ndarray:
        """For each node, thresholds from -1 to ``deepest`` with sum tau - parts + 1 and the least estimated work."""
        parts, n, levels = len(self.groups), len(values[0]), self.deepest + 2
        work = np.zeros((parts, levels, n))
        for k in range(parts):
            for t in range(self.deepest + 1):
                near = np.zeros(n)
                for flip in self.flips[k][t]:
                    near += self.histograms[k][self.bucket(values[k] ^ flip, k)]
                work[k, t + 1] = work[k, t] + len(self.flips[k][t]) + near / 3
        target = self.tau + 1  # the sum of (threshold + 1) over partitions
        best = np.full((parts + 1, target + 1, n), np.inf)
        best[0, 0] = 0
        pick = np.zeros((parts, target + 1, n), np.int8)
        for k in range(parts):
            for total in range(target + 1):
                for level in range(min(levels, total + 1)):
                    cost = best[k, total - level] + work[k, level]
                    better = cost < best[k + 1, total]
                    best[k + 1, total][better] = cost[better]
                    pick[k, total][better] = level
        out, total = np.zeros((parts, n), np.int64), np.full(n, target)
        for k in reversed(range(parts)):
            level = pick[k, total, np.arange(n)]
            out[k] = level - 1
            total = total - level
        return out


def _histograms(nodes: DataFrame, partitions: Partitions) -> np.ndarray:
    size = 1 << Partitions.BUCKET_BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(partitions.groups), size), np.int64)
        for batch in batches:
            values = batch.column(0).to_numpy().view(np.uint64)
            for k in range(len(partitions.groups)):
                total[k] += np.bincount(partitions.bucket(partitions.values(values, k), k), minlength=size)
        places = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(places), pa.array(total.ravel()[places])], names=["place", "n"])

    out = np.zeros(len(partitions.groups) * size, np.float32)
    rows = nodes.select("fingerprint").mapInArrow(count, "place long, n long").groupBy("place").agg(F.sum("n").alias("n"))
    for row in rows.toLocalIterator(prefetchPartitions=True):  # 2**16 rows for each partition at most
        out[row["place"]] = row["n"]
    return out.reshape(-1, size)


def _mask(bits: list[int]) -> int:
    return int(np.array(sum(1 << b for b in bits), np.uint64).view(np.int64))


def near_pairs(nodes: DataFrame, *, tau: int = 4, parts: int | None = None, most_parts: int = 4) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Links to the hub of each value (a, b); the groups that they make; links between groups (a, b and their groups).

    ``nodes`` holds distinct fingerprints. Together the links connect all that are within ``tau`` bits.
    """
    spark = nodes.sparkSession
    nodes = narrowed(nodes, nodes.count())
    n, pairs = bit_pair_counts(nodes)
    groups = group_bits(n, pairs, parts or choose_parts(n, tau, min(most_parts, tau + 1)))
    partitions = Partitions(groups, tau)
    partitions.histograms = _histograms(nodes, partitions)
    shared = spark.sparkContext.broadcast(partitions)  # bounded: 2**16 counts for each partition
    masks = [_mask(g) for g in groups]

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            values = batch.column(0).to_numpy().view(np.uint64)
            for k in range(len(own.groups)):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(values), k, np.int32)), pa.array(own.values(values, k).view(np.int64)), batch.column(0)], names=["part", "value", "x"])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            values = batch.column(0).to_numpy().view(np.uint64)
            for at in range(0, len(values), 20_000):
                some = values[at : at + 20_000]
                by_part = [own.values(some, k) for k in range(len(own.groups))]
                limits = own.thresholds(by_part)
                packed = sum((limits[k] + 1) << (4 * k) for k in range(len(own.groups)))
                for k in range(len(own.groups)):
                    for t in range(own.deepest + 1):
                        chosen = np.flatnonzero(limits[k] >= t)
                        for flip in own.flips[k][t] if len(chosen) else ():
                            arrays = [np.full(len(chosen), k, np.int32), (by_part[k][chosen] ^ flip).view(np.int64), some[chosen].view(np.int64), packed[chosen]]
                            yield pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], names=["part", "value", "q", "limits"])

    places = nodes.select("fingerprint").mapInArrow(index, "part int, value long, x long")
    hubs = checkpoint(narrowed(places.groupBy("part", "value").agg(F.min("x").alias("hub"), F.count("*").alias("n")).filter("n > 1"), n * len(groups)))
    starred = join_counted(places, hubs, ["part", "value"], "n").filter((F.col("x") != F.col("hub")) & (F.bit_count(F.col("x").bitwiseXOR(F.col("hub"))) <= tau))
    starred = starred.select(F.col("x").alias("a"), F.col("hub").alias("b"))
    first = components(starred)
    known = nodes.select("fingerprint").join(first.withColumnRenamed("node", "fingerprint"), "fingerprint", "left")
    grouped = checkpoint(narrowed(known.select("fingerprint", F.coalesce("component", "fingerprint").alias("group")), n))

    wide = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("value", T.LongType()), T.StructField("q", T.LongType()), T.StructField("limits", T.LongType())])

    def with_group(run, name):
        """Runs on fingerprint and group: the group goes along."""

        def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                values, owners = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                order = np.argsort(values)
                for made in run(iter([batch])):
                    place = order[np.searchsorted(values[order], made.column(2).to_numpy())]
                    yield pa.RecordBatch.from_arrays([*made.columns, pa.array(owners[place])], names=[*made.schema.names, name])

        return out

    probes = grouped.mapInArrow(with_group(probe, "q_group"), T.StructType([*wide.fields, T.StructField("q_group", T.LongType())]))
    indexed = grouped.mapInArrow(with_group(index, "x_group"), "part int, value long, x long, x_group long")
    differ = F.col("q").bitwiseXOR(F.col("x"))
    earlier = F.lit(False)  # a partition before this one finds the pair as well
    for k, mask in enumerate(masks):
        limit = F.shiftright("limits", 4 * k).bitwiseAND(F.lit(15)) - 1
        earlier = earlier | ((F.lit(k) < F.col("p.part")) & (F.bit_count(differ.bitwiseAND(F.lit(mask))) <= limit))
    near = (
        (F.col("p.part") == F.col("i.part"))
        & (F.col("p.value") == F.col("i.value"))
        & (F.col("q_group") != F.col("x_group"))
        & (F.col("q") < F.col("x"))
        & (F.bit_count(differ) <= tau)
        & ~earlier
    )
    links = probes.alias("p").join(indexed.alias("i"), near).select(F.col("q").alias("a"), F.col("x").alias("b"), F.col("q_group").alias("a_group"), F.col("x_group").alias("b_group"))
    return starred, grouped, links


def find_components(nodes: DataFrame, **options) -> DataFrame:
    """fingerprint, component (its smallest fingerprint, as signed numbers) of every node."""
    _, grouped, links = near_pairs(nodes, **options)
    second = components(links.select(F.col("a_group").alias("a"), F.col("b_group").alias("b")))
    merged = grouped.join(second.withColumnRenamed("node", "group").withColumnRenamed("component", "top"), "group", "left")
    return merged.select("fingerprint", F.coalesce("top", "group").alias("component"))


def near_duplicates(docs: DataFrame, *, tau: int = 4, shingle: int = 4, parts: int | None = None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id, fingerprint (signed long), component (its smallest fingerprint) and component_id (its smallest id)."""
    marked = checkpoint(fingerprints(docs, shingle=shingle, id_column=id_column, text_column=text_column))
    rows = marked.count()
    marked = narrowed(marked, rows)
    nodes = checkpoint(narrowed(marked.groupBy("fingerprint").agg(F.min(id_column).alias("least"), F.count("*").alias("rows")), rows))
    found = find_components(nodes, tau=tau, parts=parts)
    named = checkpoint(narrowed(nodes.join(found, "fingerprint"), rows))
    names = checkpoint(narrowed(named.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("n")), rows))
    by_node = checkpoint(narrowed(join_counted(named, names, ["component"], "n").select("fingerprint", "component", "component_id", "rows"), rows))
    return join_counted(marked, by_node, ["fingerprint"], "rows").select(id_column, "fingerprint", "component", "component_id")


def one_of_each(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", shingle: int = 4, **options) -> DataFrame:
    """The rows of ``docs``, all columns, that stand for their component: the one with the smallest id.

    Of several rows with that id in one component, one with the smallest fingerprint stays. Texts are shuffled once, by id.
    """
    marked = near_duplicates(docs, id_column=id_column, text_column=text_column, shingle=shingle, **options)
    return keep_leaders(docs, marked, lambda text: int(np.uint64(fingerprint(text, shingle)).astype(np.int64)), id_column=id_column, text_column=text_column)


def keep_leaders(docs: DataFrame, marked: DataFrame, name_of: Callable[[bytes], int], *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` that stand for their component in ``marked``; ``name_of`` gives a text's (signed) fingerprint there.

    Rows travel as one struct, so columns of any name are kept as they are.
    """
    marked = checkpoint(marked.select(F.col(id_column).alias("id"), "component", "component_id", "fingerprint"))
    n = marked.count()
    marked = narrowed(marked, n)
    leaders = marked.filter(F.col("id").eqNullSafe(F.col("component_id")))
    kept = leaders.groupBy("component").agg(F.min(F.struct("id", "fingerprint")).alias("kept")).select("kept.*")
    rows_of_id = marked.groupBy(F.col("id").alias("own_id")).agg(F.count("*").alias("rows"))
    kept = checkpoint(narrowed(kept.join(rows_of_id, F.col("id").eqNullSafe(F.col("own_id"))).select("id", "fingerprint", "rows"), n))
    whole = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_column).alias("key"))
    single = whole.join(kept.filter("rows = 1 and id is not null").select("id"), F.col("key") == F.col("id"), "left_semi").select("row.*")
    # ids with several rows are told apart by their fingerprints
    several = kept.filter("rows > 1 or id is null").select("id", "fingerprint")
    if several.isEmpty():
        return single

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array([name_of(t) for t in text_bytes(batch.column(2))], np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(values)], names=["row", "key", "own"])

    few = whole.join(several.select("id").distinct(), F.col("key").eqNullSafe(F.col("id")), "left_semi").withColumn("text", F.col("row")[text_column])
    own = few.mapInArrow(hashed, T.StructType([*whole.schema.fields, T.StructField("own", T.LongType())]))
    chosen = own.join(several, F.col("key").eqNullSafe(F.col("id")) & (F.col("own") == F.col("fingerprint")), "left_semi")
    return single.unionByName(chosen.dropDuplicates(["key", "own"]).select("row.*"))
