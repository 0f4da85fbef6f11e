"""Ranked lexical search by Block-Max MaxScore over a sharded inverted index.

The index is a table of shards. A shard has up to ``shard_docs`` consecutive documents of a task with all their terms:
for each term a list of places and counts in blocks of ``BLOCK`` postings, packed in as many bytes as the block needs. A
block also tells, unpacked, its first and last place and its impacts: those pairs of count and document length that no
other posting of the block beats in both. So bounds of a block can be computed for any corpus statistics, and an index may
be kept or extended.

A search takes document counts and lengths over the whole index first, then reads every shard once:

* the bound of a list is the highest bound of its blocks. Lists whose bounds together stay below the score to beat
  are non-essential: documents with only their terms can't enter;
* documents of the essential lists are candidates. Their scores plus the bounds of the blocks that may hold them in
  the non-essential lists reject most of them before any such block is unpacked;
* the others are scored list after list, rejected as soon as they can't reach the score to beat any more.

The score to beat goes on from shard to shard of a task; each task gives its k best for each query, and these are merged.
Queries are taken in groups of about ``group_terms`` terms, each group one pass over the index, so that what is sent to
the tasks stays bounded. All numbers are 64-bit integers, but for the logarithm in a term's weight.

Defined cases: null and empty texts have no term and are never found; items without a term that occurs find nothing;
rows with a null id are found with a null id, before others of the same score; repeated rows of documents or items
count each; empty tables give an empty result; other columns are left out. Document ids are whole numbers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from binfields.llm.common import WORD_BYTES, checkpoint, text_bytes

BLOCK = 128
_NO_ID = -(2**63)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A term: digits, letters without case, all beyond ASCII.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

SHARD = "doc_ids binary, lengths binary, terms binary, uses binary, blocks binary, counts binary, firsts binary, lasts binary, widths binary, places binary, packed binary, impact_at binary, impact_tf binary, impact_n binary, n_docs long, n_terms long"


def _ragged(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ..., begin[1], ...: size[k] numbers from each begin."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin - (ends - size), size)


def _shard(ids: list[int], words: np.ndarray, lengths: np.ndarray, vocabulary: dict[bytes, int]) -> dict:
    """One row of the index; ``words`` are the numbers of all words, document after document."""
    order = sorted(vocabulary)
    rank = np.empty(len(order), np.int64)
    rank[[vocabulary[t] for t in order]] = np.arange(len(order))
    docs = np.repeat(np.arange(len(lengths)), lengths)
    keys, tf = np.unique(rank[words] * len(lengths) + docs, return_counts=True)
    term, place = keys // max(len(lengths), 1), keys % max(len(lengths), 1)
    uses = np.bincount(term, minlength=len(order))
    n_blocks = -(-uses // BLOCK)
    in_list = _ragged(np.zeros(len(uses), np.int64), uses)
    starts = np.flatnonzero(in_list % BLOCK == 0)
    counts = np.diff(starts, append=len(term))
    lasts = place[starts + counts - 1]
    gaps = np.diff(place, prepend=0)
    gaps[starts] = 0
    # bytes of a block's gaps and of its counts
    need = lambda x: np.select([np.maximum.reduceat(x, starts) < 2**8, np.maximum.reduceat(x, starts) < 2**16], [1, 2], 4) if len(starts) else np.zeros(0, np.int64)
    widths = np.stack([need(gaps), need(tf)])
    at = np.concatenate([[0], np.cumsum(counts * widths.sum(0))])
    packed = np.zeros(at[-1], np.uint8)
    for values, own, begin in ((gaps, widths[0], at[:-1]), (tf, widths[1], at[:-1] + counts * widths[0])):
        each = np.repeat(own, counts)
        where = np.repeat(begin, counts) + (in_list % BLOCK) * each
        for byte in range(4):
            held = each > byte
            packed[where[held] + byte] = (values[held] >> (8 * byte)) & 255
    # impacts: by length within a block, those with a higher count than all shorter documents
    block = np.repeat(np.arange(len(starts)), counts)
    length = lengths[place]
    by_length = np.lexsort((-tf, length, block))
    lifted = tf[by_length] + block[by_length] * (int(tf.max(initial=0)) + 1)
    best = np.concatenate([[-1], np.maximum.accumulate(lifted)[:-1]]) if len(lifted) else lifted
    kept = by_length[lifted > best]
    return {
        "doc_ids": np.array(ids, np.int64), "lengths": lengths, "terms": b" ".join(order), "uses": uses, "blocks": np.concatenate([[0], np.cumsum(n_blocks)]), "counts": counts,
        "firsts": place[starts], "lasts": lasts, "widths": widths, "places": at, "packed": packed, "impact_at": np.concatenate([[0], np.cumsum(np.bincount(block[kept], minlength=len(starts)))]),
        "impact_tf": tf[kept], "impact_n": length[kept], "n_docs": int((lengths > 0).sum()), "n_terms": int(lengths.sum()),
    }


_STORED = {"uses": np.int32, "blocks": np.int32, "counts": np.int32, "firsts": np.int32, "lasts": np.int32, "widths": np.uint8, "impact_at": np.int32, "impact_tf": np.int64, "impact_n": np.int64, "doc_ids": np.int64, "lengths": np.int64, "places": np.int64, "packed": np.uint8}


def build_index(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", shard_docs: int = 8192, shard_bytes: int = 16 << 20) -> DataFrame:
    """One row for each shard, columns as in SHARD; a document longer than ``shard_bytes`` may end one alone."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, lengths, words, vocabulary, held = [], [], [], {}, 0

        def row() -> pa.RecordBatch:
            made = _shard(ids, np.concatenate(words) if words else np.zeros(0, np.int64), np.array(lengths, np.int64), vocabulary)
            made = {n: v.astype(_STORED[n]).tobytes() if n in _STORED else v for n, v in made.items()}
            return pa.RecordBatch.from_pydict({n: pa.array([v], pa.binary() if isinstance(v, bytes) else pa.int64()) for n, v in made.items()})

        for batch in batches:
            own = batch.column(0).fill_null(_NO_ID).to_pylist()
            for i, text in zip(own, text_bytes(batch.column(1)), strict=True):
                found = text.translate(WORD_BYTES).split()
                words.append(np.fromiter((vocabulary.setdefault(w, len(vocabulary)) for w in found), np.int64, len(found)))
                ids.append(i)
                lengths.append(len(found))
                held += len(text)
                if len(ids) >= shard_docs or held >= shard_bytes:
                    yield row()
                    ids, lengths, words, vocabulary, held = [], [], [], {}, 0
        if ids:
            yield row()

    texts = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text"))
    return texts.mapInArrow(build, SHARD)


class _Shard:
    """A row of the index, and what a search needs of it."""

    def __init__(self, row: dict, total: int, n_docs: int):
        for name, kind in _STORED.items():
            setattr(self, name, np.frombuffer(row[name], kind).astype(np.int64) if kind is np.int32 else np.frombuffer(row[name], kind))
        self.widths = self.widths.reshape(2, -1).astype(np.int64)
        self.number = {t: k for k, t in enumerate(row["terms"].split())}
        self.total, self.n_docs = total, n_docs
        self.norms = self.norm(self.lengths)
        self.known: dict[int, np.ndarray] = {}

    def norm(self, n: np.ndarray) -> np.ndarray:
        return 8 * (100 - 90 + (90 * n * self.n_docs) // self.total)

    def bounds(self, term: int) -> np.ndarray:
        """Highest part of a score, before the weight, in each block of a list."""
        if term not in self.known:
            begin, end = self.blocks[term], self.blocks[term + 1]
            a, b = self.impact_at[begin], self.impact_at[end]
            tf = self.impact_tf[a:b]
            self.known[term] = np.maximum.reduceat((1_000_000_000 * tf) // (1000 * tf + self.norm(self.impact_n[a:b])), self.impact_at[begin:end] - a)
        return self.known[term]

    def unpack(self, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and parts of a score, before the weight, of all postings of these blocks."""
        counts, widths, at = self.counts[blocks], self.widths[:, blocks], self.places[blocks]
        values = []
        for own, begin in ((widths[0], at), (widths[1], at + counts * widths[0])):
            each = np.repeat(own, counts)
            where = np.repeat(begin, counts) + _ragged(np.zeros(len(counts), np.int64), counts) * each
            out = self.packed[where].astype(np.int64)
            for byte in range(1, int(own.max(initial=1))):
                held = each > byte
                out[held] |= self.packed[where[held] + byte].astype(np.int64) << (8 * byte)
            values.append(out)
        gaps, tf = values
        ends = np.cumsum(gaps)
        first = np.cumsum(counts) - counts
        place = ends - np.repeat(ends[first], counts) + np.repeat(self.firsts[blocks], counts)
        return place, (1_000_000_000 * tf) // (1000 * tf + self.norms[place])

    def search(self, lists: list[tuple[int, int]], beat: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of all documents with a score of ``beat`` (above 0) at least; lists are (term, weight)."""
        own = sorted(((w * int(self.bounds(t).max()), t, w) for t, w in lists), key=lambda x: x[:2])
        below = np.cumsum([0, *(b for b, _, _ in own)])
        essential = int(np.searchsorted(below[1:], beat))  # lists before it reach less than ``beat`` together
        scores = np.zeros(len(self.lengths), np.int64)
        for _, t, w in own[essential:]:
            place, part = self.unpack(np.arange(self.blocks[t], self.blocks[t + 1]))
            scores[place] += w * part
        found = np.flatnonzero((scores > 0) & (scores + below[essential] >= beat))
        rest = own[:essential][::-1]
        if not len(found) or not rest:
            return found, scores[found]
        score, where = scores[found], []
        for _, t, _ in rest:
            begin, end = self.blocks[t], self.blocks[t + 1]
            at = np.minimum(np.searchsorted(self.lasts[begin:end], found), end - begin - 1) + begin
            where.append(np.where((self.firsts[at] <= found) & (found <= self.lasts[at]), at, -1))
        most = np.stack([np.where(at >= 0, w * self.bounds(t)[np.maximum(at - self.blocks[t], 0)], 0) for at, (_, t, w) in zip(where, rest, strict=True)])
        bound = score + most.sum(0)
        alive = bound >= beat
        for k, (_, t, w) in enumerate(rest):
            open_ = np.flatnonzero(alive & (where[k] >= 0))
            if len(open_):
                place, part = self.unpack(np.unique(where[k][open_]))
                at = np.minimum(np.searchsorted(place, found[open_]), len(place) - 1)
                gain = np.where(place[at] == found[open_], w * part[at], 0)
                score[open_] += gain
                bound[open_] += gain - most[k][open_]
                alive &= bound >= beat
        return found[alive], score[alive]


def _k_best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]


def search(index: DataFrame, items: DataFrame, *, k: int = 10, id_column: str = "item_id", text_column: str = "text", found_column: str = "doc_id", group_terms: int = 100_000) -> DataFrame:
    """id of the item, rank (from 1), doc_id, score of the k documents with the highest score above 0; ties go to the smaller doc_id."""
    spark = index.sparkSession
    terms = F.array_distinct(F.regexp_extract_all(F.translate(F.coalesce(F.col(text_column).cast("string"), F.lit("")), _UPPER, _LOWER), F.lit(TERM), 0))
    asked = checkpoint(items.select(F.col(id_column).alias("item"), terms.alias("terms")).withColumn("q", F.monotonically_increasing_id()))
    size = asked.agg(F.coalesce(F.sum(F.size("terms")), F.lit(0)).alias("n")).first()["n"]
    sums = index.agg(F.coalesce(F.sum("n_docs"), F.lit(0)).alias("docs"), F.coalesce(F.sum("n_terms"), F.lit(0)).alias("terms")).first()
    n_docs, total, groups, found = sums["docs"], max(sums["terms"], 1), max(1, -(-size // group_terms)), None
    for g in range(groups):
        rows = asked.filter((F.pmod(F.xxhash64("q"), F.lit(groups)) == g) & (F.size("terms") > 0)).select("q", "terms").collect()  # about ``group_terms`` terms
        queries = [(r["q"], [t.encode() for t in r["terms"]]) for r in rows]
        shared = spark.sparkContext.broadcast(queries)

        def uses(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            own: dict[bytes, int] = {t: 0 for _, terms in shared.value for t in terms}
            for batch in batches:
                for terms, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    for t, n in zip(terms.split(), np.frombuffer(counts, np.int32).tolist(), strict=True):
                        if t in own:
                            own[t] += n
            held = [(t, n) for t, n in own.items() if n]
            yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in held], pa.binary()), pa.array([n for _, n in held], pa.int64())], names=["term", "n"])

        counted = index.select("terms", "uses").mapInArrow(uses, "term binary, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
        weights = spark.sparkContext.broadcast({bytes(r["term"]): math.floor(1000 * math.log((2 * n_docs + 2) / (2 * r["n"] + 1))) for r in counted})

        def best(batches: Iterator[pa.RecordBatch], shared=shared, weights=weights) -> Iterator[pa.RecordBatch]:
            weight, top = weights.value, {}
            for batch in batches:
                for row in range(batch.num_rows):
                    own = _Shard({n: batch.column(n)[row].as_py() for n in batch.schema.names}, total, n_docs)
                    for q, terms in shared.value:
                        lists = [(own.number[t], weight[t]) for t in terms if t in own.number and weight[t] > 0]
                        if lists:
                            ids, scores = top.get(q, (np.zeros(0, np.int64),) * 2)
                            beat = int(scores[k - 1]) if len(scores) >= k else 1
                            place, more = own.search(lists, beat)
                            if len(place):
                                top[q] = _k_best(np.concatenate([ids, own.doc_ids[place]]), np.concatenate([scores, more]), k)
            if top:
                columns = [np.concatenate([np.full(len(ids), q) for q, (ids, _) in top.items()]), *(np.concatenate([x[n] for x in top.values()]) for n in (0, 1))]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["q", "doc", "score"])

        part = checkpoint(index.mapInArrow(best, "q long, doc long, score long"))
        found = part if found is None else found.unionByName(part)
    # two steps, so that the tasks' results for one item are never in one task whole
    order = [F.desc("score"), "doc"]
    salted = found.withColumn("salt", F.spark_partition_id() % 64).withColumn("r", F.row_number().over(Window.partitionBy("q", "salt").orderBy(*order))).filter(F.col("r") <= k)
    ranked = salted.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(*order))).filter(F.col("r") <= k)
    own_id = F.when(F.col("doc") != _NO_ID, F.col("doc"))
    return ranked.join(asked.select("q", "item"), "q").select(F.col("item").alias(id_column), F.col("r").cast("int").alias("rank"), own_id.alias(found_column), "score")
