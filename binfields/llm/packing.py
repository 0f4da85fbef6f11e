"""Best-two-fit packing of tokenized documents into sequences of a fixed length.

1. Tasks tokenize whole texts and cut only documents of more than ``capacity`` tokens. What leaves a task is one small
   row for each piece (its length and a checksum, and the ids only if asked for).
2. The number of pieces of each length, 1 to ``capacity``, is all that packing depends on. Those ``capacity`` counts are
   the only thing the driver sees, at any size of input. Over them it runs best-two-fit: a bin is filled greedily from
   the longest length down; then its smallest document gives way to two unpacked ones if they fill the gap more tightly.
   A bin's pattern is used as often as the counts allow, so the plan has a few thousand entries whatever the input.
3. Each piece gets its rank among the pieces of its length (counts by task and length, running sums over tasks), and the
   rank tells its pattern, copy and place. No group of pieces meets in one task.

Defined cases: a null text is an empty one and still has its end token; rows with a null or repeated id are packed like
any other; an empty table gives an empty result; other columns are left out.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from binfields.llm.common import checkpoint

#: Outside of these characters, or with a special token in them, texts go to the tokenizers library itself; tiktoken,
#: several times as fast and with the same vocabulary, handles the others. Both are equal there (tests/llm/test_packing.py).
_PLAIN = re.compile("[^\x00-ɏ -⁯]")


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(path)
    special = [t.content for t in slow.get_added_tokens_decoder().values()]
    ranks_file = path.removesuffix(".json") + ".tiktoken"
    fast, other = None, re.compile("|".join([_PLAIN.pattern, *map(re.escape, special)]))
    if os.path.exists(ranks_file):
        import base64

        import public_tokenizers
        import tiktoken

        with open(ranks_file, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return slow, fast, other


def encode(text: str, path: str) -> np.ndarray:
    """The ids of a whole text as unsigned 32-bit numbers."""
    slow, fast, other = _tokenizer(path)
    if fast is not None and not other.search(text):
        return np.asarray(fast.encode_to_numpy(text, disallowed_special=()), np.uint32)
    return np.array(slow.encode(text, add_special_tokens=False).ids, np.uint32)


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """Start and length of each piece of a document of n tokens: all but the first have ``capacity`` tokens."""
    first = n % capacity or capacity
    return [(0, min(n, first)), *((start, capacity) for start in range(first, n, capacity))]


def pieces(
    docs: DataFrame,
    tokenizer_path: str,
    *,
    capacity: int = 1024,
    end_id: int = 2,
    id_column: str = "doc_id",
    text_column: str = "text",
    keep_ids: bool = False,
) -> DataFrame:
    """One row for each piece: id, piece, start, length, ids_crc32 and, if wanted, ids."""

    def tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list] = [[] for _ in range(6)]
            seen: dict[str, np.ndarray] = {}
            for k, text in enumerate(batch.column(1)):
                text = text.as_py() or ""
                if (ids := seen.get(text)) is None:
                    ids = seen[text] = np.append(encode(text, tokenizer_path), np.uint32(end_id)).astype("<u4")
                for piece, (start, length) in enumerate(cut(len(ids), capacity)):
                    own = ids[start : start + length]
                    row = (k, piece, start, length, zlib.crc32(own.tobytes()), own.tolist() if keep_ids else None)
                    for column, value in zip(columns, row, strict=True):
                        column.append(value)
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()))
            arrays = [pa.array(c, kind) for c, kind in zip(columns[1:], kinds, strict=True)][: 4 + keep_ids]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(columns[0], pa.int64())), *arrays], names=schema.names)

    extra = [T.StructField("ids", T.ArrayType(T.IntegerType()))] if keep_ids else []
    number = T.LongType()
    schema = T.StructType([docs.schema[id_column], T.StructField("piece", T.IntegerType()), T.StructField("start", number), T.StructField("length", number), T.StructField("ids_crc32", number), *extra])
    return docs.select(id_column, text_column).mapInArrow(tokenize, schema)


def best_two_fit(counts: np.ndarray, capacity: int) -> list[tuple[list[int], int]]:
    """Patterns (lengths of one bin, longest first) and how often each is used. counts[n]: pieces of length n."""
    left = np.array(counts, np.int64)
    plan = []
    while left.any():
        free, gap, bin_ = left.copy(), capacity, []
        while True:
            fits = np.flatnonzero(free[: gap + 1])
            if not len(fits):
                break
            n = int(fits[-1])
            bin_.append(n)
            free[n] -= 1
            gap -= n
        if gap and (pair := _tighter_pair(free, bin_[-1], gap + bin_[-1])):
            free[bin_.pop()] += 1
            bin_ += pair
        used = np.bincount(bin_, minlength=len(left))
        times = int((left[used > 0] // used[used > 0]).min())
        left -= used * times
        plan.append((sorted(bin_, reverse=True), times))
    return plan


def _tighter_pair(free: np.ndarray, smallest: int, gap: int) -> list[int] | None:
    """Two unpacked lengths whose sum fits the gap and is the largest over ``smallest``."""
    there = np.flatnonzero(free[: gap + 1])
    if not len(there):
        return None
    partner = np.searchsorted(there, gap - there, side="right") - 1
    valid = (partner >= 0) & (partner <= np.arange(len(there)))
    second = there[np.maximum(partner, 0)]
    # a length that is there once can't be both; its next shorter one then is the best partner
    once = valid & (second == there) & (free[there] < 2)
    partner[once] -= 1
    valid &= partner >= 0
    second = there[np.maximum(partner, 0)]
    total = np.where(valid, there + second, -1)
    # the longer of two equal totals first, so that short ones stay for later gaps
    k = len(total) - 1 - int(np.argmax(total[::-1]))
    return [int(there[k]), int(second[k])] if total[k] > smallest else None


class Places:
    """For each length, which ranks go to which sequence and offset."""

    def __init__(self, plan: list[tuple[list[int], int]]) -> None:
        rows: dict[int, list[tuple[int, int, int, int, int]]] = {}
        taken: dict[int, int] = {}
        sequence = 0
        for pattern, times in plan:
            offset, slots = 0, {}
            for n in pattern:
                slots.setdefault(n, []).append(offset)
                offset += n
            for n, offsets in slots.items():
                for at in offsets:
                    rows.setdefault(n, []).append((taken.get(n, 0), sequence, at))
                    taken[n] = taken.get(n, 0) + times
            sequence += times
        self.sequences = sequence
        self.by_length = {n: tuple(np.array(x, np.int64) for x in zip(*r, strict=True)) for n, r in rows.items()}

    def find(self, lengths: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
        for n in np.unique(lengths):
            own = lengths == n
            begins, firsts, offsets = self.by_length[int(n)]
            k = np.searchsorted(begins, ranks[own], side="right") - 1
            sequence[own] = firsts[k] + ranks[own] - begins[k]
            offset[own] = offsets[k]
        return sequence, offset


def _local_ranks(schema: T.StructType):
    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, so_far = TaskContext.get().partitionId(), {}
        for batch in batches:
            lengths = batch.column(batch.schema.get_field_index("length")).to_numpy()
            ranks = np.empty(len(lengths), np.int64)
            for n in np.unique(lengths).tolist():
                own = lengths == n
                ranks[own] = np.arange(own.sum()) + so_far.get(n, 0)
                so_far[n] = so_far.get(n, 0) + int(own.sum())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(lengths), task, np.int32)), pa.array(ranks)], names=schema.names)

    return rank


def pack(parts: DataFrame, *, capacity: int = 1024) -> DataFrame:
    """Adds sequence_id and offset to rows that have a ``length`` of 1 to ``capacity``."""
    marked = T.StructType([*parts.schema.fields, T.StructField("_task", T.IntegerType()), T.StructField("_rank", T.LongType())])
    ranked = checkpoint(parts.mapInArrow(_local_ranks(marked), marked))
    by_task = ranked.groupBy("_task", "length").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy("length").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    begins = by_task.select("_task", "length", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_begin"))
    counts = np.zeros(capacity + 1, np.int64)
    for row in by_task.groupBy("length").agg(F.sum("_n").alias("n")).collect():  # a row for each length at most
        counts[row["length"]] = row["n"]
    places = parts.sparkSession.sparkContext.broadcast(Places(best_two_fit(counts, capacity)))  # bounded by the number of lengths
    names = parts.columns
    schema = T.StructType([*parts.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = dict(zip(batch.schema.names, batch.columns, strict=True))
            ranks = columns["_rank"].to_numpy() + columns["_begin"].to_numpy()
            sequence, offset = places.value.find(columns["length"].to_numpy(), ranks)
            yield pa.RecordBatch.from_arrays([*(columns[c] for c in names), pa.array(sequence), pa.array(offset)], names=schema.names)

    return ranked.join(begins, ["_task", "length"]).select(*names, "_rank", "_begin").mapInArrow(place, schema)


def pack_documents(docs: DataFrame, tokenizer_path: str, *, capacity: int = 1024, end_id: int = 2, id_column: str = "doc_id", text_column: str = "text", keep_ids: bool = False) -> DataFrame:
    """Tokenizes, cuts and packs: id, piece, start, length, ids_crc32, [ids,] sequence_id, offset."""
    return pack(pieces(docs, tokenizer_path, capacity=capacity, end_id=end_id, id_column=id_column, text_column=text_column, keep_ids=keep_ids), capacity=capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """The token sequences themselves, from pieces packed with ``keep_ids``: sequence_id, ids."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(parts.alias("parts")).select("sequence_id", F.flatten(F.col("parts.ids")).alias("ids"))
