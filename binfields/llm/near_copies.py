"""Near-copies by Jaccard similarity of word shingles: SimHash links, completed by a prefix-filtered set join.

SimHash tells texts that differ in a few bits; at a similarity of 0.8 fingerprints differ in 10 of 64 bits on average,
where its buckets hold most of the corpus. So SimHash links the closest copies, which make the large groups, and a set
join finds the links that it can't see. Every link is decided by the whole sets; no link is lost.

1. Each text is the set of 64-bit hashes of its shingles, and equal sets are one node, named by a digest. A node has its
   SimHash fingerprint, its size and a parity map: bit h mod w is flipped by each hash h, w a power of two, two bits for a
   hash at least. Two maps, folded to equal width, differ in no more bits than the sets do in tokens, so most pairs that
   are not similar enough are told by a twentieth of the bytes of the sets.
2. Pairs within ``tau`` bits of SimHash are candidates (``simhash.near_pairs``).
3. Two sets of similarity ``p/q`` at least share a token among the first ``n - ceil(p n / q) + 1`` of each, in any order
   of all tokens. The order puts tokens that many texts of a batch share last, over the batches of all texts, so
   boilerplate seldom stands in a prefix; it bears on the time only. Nodes that share a prefix token are candidates with
   the token's smallest node.
4. Candidates that sizes, places and parity maps leave are decided by the whole sets, and make groups. Tokens whose nodes
   are then not yet in one group have the pairs of different groups compared in the same way,
   but a pair leaves the join on the token only if parity maps of FOLD_BITS bits allow it.

Defined cases: null, empty and wordless texts have the empty set and are copies of each other; a text of fewer words
than a shingle is one shingle; rows with a null id belong to their component but never name it; repeated rows keep
their rows; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from binfields.llm.common import checkpoint, join_counted, narrowed, text_bytes
from binfields.llm.components import components
from binfields.llm.simhash import fingerprint_of, keep_leaders, near_pairs, shingle_hashes

#: What the hot-token count keeps of a batch and in all.
MOST_OF_BATCH, MOST_HOT = 50_000, 500_000
#: Bits of the sketch that tells which texts' sets a comparison needs; fuller sketches let more through, nothing is lost.
SKETCH_BITS = 1 << 24
#: Bits of the parity map that the join on tokens itself compares.
FOLD_BITS = 512
#: Nodes whose prefix tokens a task takes, and pairs whose whole sets it compares.
NODES_A_TASK, SETS_A_TASK = 10_000, 5_000


def shingle_set(text: bytes, shingle: int = 5) -> np.ndarray:
    """Sorted different hashes of the text's shingles."""
    return np.unique(shingle_hashes(text, shingle))


def set_name(tokens: np.ndarray) -> int:
    """The signed 64-bit name of a set."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(tokens.tobytes())).astype(np.int64))


def parity_map(tokens: np.ndarray) -> bytes:
    width = 64
    while width < 2 * len(tokens):
        width *= 2
    odd = np.bincount((tokens & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(odd.astype(bool), bitorder="little").tobytes()


def fold_of(tokens: np.ndarray) -> list[int]:
    """The parity map of FOLD_BITS bits, as signed 64-bit numbers."""
    odd = np.bincount((tokens & np.uint64(FOLD_BITS - 1)).astype(np.int64), minlength=FOLD_BITS) & 1
    return np.packbits(odd.astype(bool), bitorder="little").view("<i8").tolist()


def parity_distance(a: bytes, b: bytes) -> int:
    """Bits that differ after the longer map is folded to the shorter one's width: at most the tokens that differ."""
    x, y = sorted((np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)), key=len)
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def prefix(tokens: np.ndarray, often: tuple[np.ndarray, np.ndarray], near: tuple[int, int]) -> np.ndarray:
    """The tokens of the set, seldom ones first, of which similar sets share one."""
    known, counts = often
    seen = np.zeros(len(tokens), np.int64)
    if len(known):
        place = np.minimum(np.searchsorted(known, tokens), len(known) - 1)
        seen = np.where(known[place] == tokens, counts[place], 0)
    return tokens[np.lexsort((tokens, seen))[: len(tokens) + near[0] * -len(tokens) // near[1] + 1]] if len(tokens) else tokens


def _described(docs: DataFrame, id_column: str, text_column: str, shingle: int) -> DataFrame:
    """id, text_key, node, size, fingerprint, and at a node's first row in a task its parity map and fold; at a batch's first row its hot tokens."""
    pairs = np.dtype([("token", "<u8"), ("n", "<i8")])

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            names, sizes, prints, maps, folds, sets = [], [], [], [], [], {}
            for text in text_bytes(batch.column(2)):
                hashes = shingle_hashes(text, shingle)
                tokens = np.unique(hashes)
                name = set_name(tokens)
                names.append(name)
                sizes.append(len(tokens))
                prints.append(int(np.uint64(fingerprint_of(hashes)).astype(np.int64)))
                maps.append(None if name in seen else parity_map(tokens))
                folds.append(None if name in seen else fold_of(tokens))
                seen.add(name)
                sets[name] = tokens
            tokens, counts = np.unique(np.concatenate([*sets.values(), np.zeros(0, "<u8")]), return_counts=True)
            top = np.flatnonzero(counts > 1)
            top = top[np.argsort(-counts[top], kind="stable")[:MOST_OF_BATCH]]
            hot = np.zeros(len(top), pairs)
            hot["token"], hot["n"] = tokens[top], counts[top]
            blobs = [hot.tobytes() if k == 0 and len(hot) else None for k in range(len(names))]
            arrays = [batch.column(0), batch.column(1), pa.array(names, pa.int64()), pa.array(sizes, pa.int32()), pa.array(prints, pa.int64()), pa.array(maps, pa.binary()), pa.array(folds, pa.list_(pa.int64())), pa.array(blobs, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=[f.name for f in fields])

    kinds = (("text_key", T.LongType()), ("node", T.LongType()), ("size", T.IntegerType()), ("fingerprint", T.LongType()), ("parity", T.BinaryType()), ("fold", T.ArrayType(T.LongType())), ("hot", T.BinaryType()))
    fields = [docs.schema[id_column], *(T.StructField(n, k) for n, k in kinds)]
    return docs.select(id_column, F.xxhash64(text_column).alias("text_key"), text_column).mapInArrow(describe, T.StructType(fields))


def _hot_tokens(described: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The tokens that most texts share, as counted batch by batch over all texts: at most MOST_HOT, sorted, with counts."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.frombuffer(b"".join(batch.column(0).to_pylist()), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(rows[:, k])) for k in (0, 1)], names=["token", "n"])

    counted = checkpoint(described.filter("hot is not null").select("hot").mapInArrow(explode, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")))
    least, total = 2, 0
    for row in sorted(counted.groupBy("n").agg(F.count("*").alias("tokens")).collect(), key=lambda r: -r["n"]):  # a row for each count
        total += row["tokens"]
        if total > MOST_HOT:
            least = row["n"] + 1
            break
    found = counted.filter(F.col("n") >= least).toArrow()
    tokens, counts = found.column("token").to_numpy().view(np.uint64), found.column("n").to_numpy()
    order = np.argsort(tokens)
    return tokens[order], counts[order]


def _places(docs: DataFrame, text_column: str, shingle: int, near: tuple[int, int], hot, n: int) -> DataFrame:
    """token, node, size, place of each prefix token of each of the ``n`` nodes."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            names, sizes, blobs = [], [], []
            for text in text_bytes(batch.column(0)):
                tokens = shingle_set(text, shingle)
                name = set_name(tokens)
                if name not in seen:
                    seen.add(name)
                    names.append(name)
                    sizes.append(len(tokens))
                    blobs.append(prefix(tokens, hot.value, near).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(sizes, pa.int32()), pa.array(blobs, pa.binary())], names=["node", "size", "prefix"])

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blobs = batch.column(2).to_pylist()
            lengths = np.array([len(b) // 8 for b in blobs], np.int64)
            starts = np.repeat(np.cumsum(lengths) - lengths, lengths)
            owner = pa.array(np.repeat(np.arange(len(blobs)), lengths))
            place = np.arange(len(starts)) - starts
            tokens = np.frombuffer(b"".join(blobs), "<i8")
            arrays = [pa.array(tokens), batch.column(0).take(owner), batch.column(1).take(owner), pa.array(place.astype(np.int32))]
            yield pa.RecordBatch.from_arrays(arrays, names=["token", "node", "size", "place"])

    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    single = docs.select(text_column).mapInArrow(cut, "node long, size int, prefix binary").repartition(tasks, "node").dropDuplicates(["node"])
    return checkpoint(narrowed(single, n, NODES_A_TASK)).mapInArrow(explode, "token long, node long, size int, place int")


def _sketch(nodes: DataFrame) -> np.ndarray:
    """One bit for each node's text_key, at most SKETCH_BITS / 64 rows for the driver."""
    word = F.pmod(F.shiftright("text_key", 6), F.lit(SKETCH_BITS // 64))
    found = nodes.select(word.alias("w"), F.expr("shiftleft(1L, cast(pmod(text_key, 64) as int))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    out = np.zeros(SKETCH_BITS // 64, np.uint64)
    out[found.column("w").to_numpy()] = found.column("b").to_numpy().view(np.uint64)
    return out


def _sketched(sketch: np.ndarray, key: int) -> bool:
    return bool(int(sketch[(key >> 6) % len(sketch)]) >> (key % 64) & 1)


def _with_both(pairs: DataFrame, table: DataFrame, column: str, decide, each: int) -> DataFrame:
    """Rows of ``pairs`` (a, b, more) for which ``decide`` holds of their nodes' values in ``table`` (node, column), ``each`` in a task."""
    columns, n = pairs.columns, pairs.count()
    pairs = narrowed(pairs, n, each)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [decide(x, y) for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(batch.columns[2:], names=columns).filter(pa.array(keep, pa.bool_()))

    # a node may be the hub of many: those are broadcast
    own = pairs.groupBy("b").agg(F.count("*").alias("_n"))
    right = checkpoint(narrowed(own.join(table.select(F.col("node").alias("b"), F.col(column).alias("_right")), "b"), n, each))
    wide = narrowed(join_counted(pairs, right, ["b"], "_n"), n, each).join(table.select(F.col("node").alias("a"), F.col(column).alias("_left")), "a")
    return narrowed(wide.select("_left", "_right", *columns), n, each).mapInArrow(compare, pairs.schema)


def _confirmed(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, text_column: str, shingle: int, near: tuple[int, int]) -> DataFrame:
    """The pairs of nodes (a, b, and further columns) whose sets have the similarity.

    A set is made from one text of its node, the one with the smallest text_key; texts that no pair needs are not cut into words.
    """
    p, q = near

    def may_be(x, y) -> bool:
        return parity_distance(x["parity"], y["parity"]) * (p + q) <= (q - p) * (x["size"] + y["size"])

    def is_near(x: bytes, y: bytes) -> bool:
        x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
        return (p + q) * len(np.intersect1d(x, y, assume_unique=True)) >= p * (len(x) + len(y))

    described = nodes.select("node", F.struct("size", "parity").alias("own"))
    left = checkpoint(_with_both(checkpoint(pairs), described, "own", may_be, NODES_A_TASK))
    n = left.count()
    if not n:
        return left
    ends = left.select(F.col("a").alias("node")).unionByName(left.select(F.col("b").alias("node"))).distinct()
    wanted = checkpoint(narrowed(nodes.select("node", "text_key").join(ends, "node", "left_semi"), 2 * n))
    sketch = docs.sparkSession.sparkContext.broadcast(_sketch(wanted))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            names, blobs = [], []
            for key, text in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1)), strict=True):
                if key not in seen and _sketched(sketch.value, key):
                    seen.add(key)
                    tokens = shingle_set(text, shingle)
                    names.append(set_name(tokens))
                    blobs.append(tokens.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(blobs, pa.binary())], names=["node", "tokens"])

    sets = docs.select(F.xxhash64(text_column).alias("text_key"), text_column).mapInArrow(whole, "node long, tokens binary").join(wanted, "node", "left_semi").dropDuplicates(["node"])
    return _with_both(left, checkpoint(narrowed(sets, 2 * n, SETS_A_TASK)), "tokens", is_near, SETS_A_TASK)


def near_copies(docs: DataFrame, *, shingle: int = 5, near: tuple[int, int] = (4, 5), tau: int = 4, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id, fingerprint (name of the set), component (its smallest name) and component_id (its smallest id)."""
    c = F.col
    marked = checkpoint(_described(docs, id_column, text_column, shingle))
    rows = marked.count()
    marked = narrowed(marked, rows, NODES_A_TASK)
    hot = docs.sparkSession.sparkContext.broadcast(_hot_tokens(marked))
    nodes = marked.groupBy("node").agg(F.min(id_column).alias("least"), F.count("*").alias("rows"), F.max("size").alias("size"), F.min("fingerprint").alias("fingerprint"), F.max("parity").alias("parity"), F.max("fold").alias("fold"), F.min("text_key").alias("text_key"))
    nodes = checkpoint(narrowed(nodes, rows, NODES_A_TASK))
    n = nodes.count()

    by_print = checkpoint(narrowed(nodes.groupBy("fingerprint").agg(F.min("node").alias("node")), n))
    starred, _, links = near_pairs(by_print.select("fingerprint"), tau=tau)
    prints = starred.unionByName(links.select("a", "b"))
    own = by_print.select(c("fingerprint").alias("a"), c("node").alias("x"))
    other = by_print.select(c("fingerprint").alias("b"), c("node").alias("y"))
    simhash = prints.join(own, "a").join(other, "b").select(c("x").alias("a"), c("y").alias("b"))

    def by_nodes(df: DataFrame) -> DataFrame:
        return checkpoint(narrowed(df, n, NODES_A_TASK))

    places = _places(docs, text_column, shingle, near, hot, n)
    often = by_nodes(places.groupBy("token").agg(F.count("*").alias("n")).filter("n > 1"))
    shared = by_nodes(join_counted(places, often, ["token"], "n"))
    hubs = by_nodes(shared.groupBy("token").agg(F.min(F.struct("node", "size", "place")).alias("hub"), F.count("*").alias("n")))

    def may_be(n, i, m, j):
        """What is left from a place on bounds the overlap, as a pair that is near passes at the first token that it shares."""
        return F.least(n - i, m - j) * (near[0] + near[1]) >= (n + m) * near[0]

    at_hub = join_counted(shared, hubs, ["token"], "n").filter((c("node") != c("hub.node")) & may_be(c("size"), c("place"), c("hub.size"), c("hub.place")))
    candidates = at_hub.select(c("node").alias("a"), c("hub.node").alias("b")).unionByName(simhash).distinct()
    first = components(_confirmed(candidates, docs, nodes, text_column, shingle, near))
    grouped = by_nodes(nodes.select("node").join(first, "node", "left").select("node", F.coalesce("component", "node").alias("group")))

    left = by_nodes(shared.join(grouped, "node"))
    mixed = left.groupBy("token").agg(F.min("group").alias("low"), F.max("group").alias("high"), F.count("*").alias("n")).filter("low < high").select("token", "n")
    left = by_nodes(join_counted(left, by_nodes(mixed), ["token"], "n").join(nodes.select("node", "fold"), "node"))
    differ = sum((F.bit_count(c("x.fold")[k].bitwiseXOR(c("y.fold")[k])) for k in range(FOLD_BITS // 64)), F.lit(0))
    maps_allow = differ * (near[0] + near[1]) <= (c("x.size") + c("y.size")) * (near[1] - near[0])
    near_enough = (c("x.group") != c("y.group")) & (c("x.node") < c("y.node")) & may_be(c("x.size"), c("x.place"), c("y.size"), c("y.place")) & maps_allow
    pairs = left.alias("x").join(left.alias("y"), (c("x.token") == c("y.token")) & near_enough)
    pairs = pairs.select(c("x.node").alias("a"), c("y.node").alias("b"), c("x.group").alias("a_group"), c("y.group").alias("b_group")).distinct()
    second = components(_confirmed(pairs, docs, nodes, text_column, shingle, near).select(c("a_group").alias("a"), c("b_group").alias("b")))
    merged = grouped.join(second.select(c("node").alias("group"), c("component").alias("top")), "group", "left")
    named = by_nodes(nodes.select("node", "least", "rows").join(merged.select("node", F.coalesce("top", "group").alias("component")), "node"))
    names = by_nodes(named.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("n")))
    by_node = by_nodes(join_counted(named, names, ["component"], "n").select("node", "component", "component_id", "rows"))
    return join_counted(marked.select(id_column, "node"), by_node, ["node"], "rows").select(id_column, c("node").alias("fingerprint"), "component", "component_id")


def one_of_each_copy(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", shingle: int = 5, near: tuple[int, int] = (4, 5)) -> DataFrame:
    """The rows of ``docs``, all columns, that stand for their component: the one with the smallest id."""
    marked = near_copies(docs, shingle=shingle, near=near, id_column=id_column, text_column=text_column)
    return keep_leaders(docs, marked, lambda text: set_name(shingle_set(text, shingle)), id_column=id_column, text_column=text_column)
