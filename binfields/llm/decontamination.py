"""Benchmark decontamination by a prefix-filtered set join with exact verification.

Every benchmark item gives windows of ``window`` consecutive words (an item of fewer words is one window). For full
containment the prefix filter needs only one token of each window: its rarest, by counts over all documents. A document
word that equals such a token proposes an alignment; the positional bound says which windows of the item can start
where, the length bound drops those that don't fit into the document, and comparing words in both directions from the
aligned token verifies them exactly. Neighbouring windows with the same rarest token are verified together.

The item index is broadcast only if the benchmark has ``max_local_words`` words and ``max_local_bytes`` bytes at most,
which take a few hundred MB. A larger benchmark is joined with the documents on prefix tokens by a shuffle, hot tokens
salted, and each document is verified against its own candidates, some at a time.

Defined cases: null or wordless texts have no words and are never contaminated; items with a null id, null text or no
words take no part; repeated rows keep their own results; an empty table gives an empty result; clashing columns of the
input are left out.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from binfields.llm.common import HOT_ONE_IN, WORD_BYTES, checkpoint, text_bytes


def words_of(text: bytes) -> list[bytes]:
    """Lower-cased (A-Z) words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of UTF-8 text."""
    return text.translate(WORD_BYTES).split()


class ItemIndex:
    """For each prefix token, the places in items where it stands and the windows that it answers for."""

    def __init__(self, items: Iterable[tuple[int, bytes]], window: int, counts: dict[bytes, int]) -> None:
        self.texts = [(item, own) for item, text in items if (own := words_of(text))]
        self.at: dict[bytes, list[tuple[int, int, int, int]]] = {}
        self.window = window
        for k, (_, own) in enumerate(self.texts):
            size = min(window, len(own))
            order = [(counts.get(w, 0), w) for w in own]
            anchor, first = -1, 0
            for start in range(len(own) - size + 1):
                rarest = min(range(start, start + size), key=lambda i: (order[i], i)) if not start <= anchor < start + size or order[start + size - 1] < order[anchor] else anchor
                if rarest != anchor:
                    if start:
                        self.at.setdefault(own[anchor], []).append((k, anchor, first, start - 1))
                    anchor, first = rarest, start
            self.at.setdefault(own[anchor], []).append((k, anchor, first, len(own) - size))
        self.prefix = frozenset(self.at)

    def match(self, words: list[bytes]) -> tuple[list[tuple[int, int]], list[int]]:
        """Merged spans of hit words (begin, end), and the places in ``texts`` of items with occurring windows."""
        n, spans, found = len(words), [], set()
        for p, w in [(p, w) for p, w in enumerate(words) if w in self.prefix]:
            for k, anchor, first, last in self.at[w]:
                own = self.texts[k][1]
                size = min(self.window, len(own))
                low = max(anchor - p, first)  # the window must begin in the document
                high = min(last, n - p + anchor - size)  # and end there
                if low > high:
                    continue
                # words that every window in question holds are compared first
                a, b, shift = min(high, anchor), max(low + size, anchor + 1), p - anchor
                if words[a + shift : b + shift] != own[a:b]:
                    continue
                while a > low and words[a - 1 + shift] == own[a - 1]:
                    a -= 1
                while b < high + size and words[b + shift] == own[b]:
                    b += 1
                if b - a >= size:
                    spans.append((a + shift, b + shift))
                    found.add(k)
        return _merged(spans), sorted(found)


def _merged(spans: Iterable[Sequence[int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for begin, end in sorted(map(tuple, spans)):
        if out and begin <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((begin, end))
    return out


def word_counts(docs: DataFrame, wanted: frozenset[bytes] | None, text_column: str = "text") -> DataFrame:
    """Occurrences of each wanted word (all words if None) in all documents: word, n."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[bytes] = Counter()
        for batch in batches:
            for text in text_bytes(batch.column(0)):
                own = words_of(text)
                total.update(own if wanted is None else filter(wanted.__contains__, own))
            if wanted is None:  # keeps the task's memory bounded
                yield pa.RecordBatch.from_pydict({"word": list(total), "n": list(total.values())}, schema=arrow)
                total.clear()
        yield pa.RecordBatch.from_pydict({"word": list(total), "n": list(total.values())}, schema=arrow)

    arrow = pa.schema([("word", pa.binary()), ("n", pa.int64())])
    return docs.select(text_column).mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


#: Between words of a lower-cased text.
_NO_WORD = "[^0-9a-z\u0080-\U0010ffff]+"
_ADDED = [("n_words", T.LongType()), ("n_hit", T.LongType()), ("item_ids", T.ArrayType(T.StringType())), ("spans", T.ArrayType(T.ArrayType(T.LongType())))]


def _rows(columns: list[pa.Array], matched: Iterable[tuple[int, list[tuple[int, int]], list[str]]], names: list[str]) -> pa.RecordBatch:
    n_words, n_hit, item_ids, spans = [], [], [], []
    for n, own, items in matched:
        n_words.append(n)
        n_hit.append(sum(e - b for b, e in own))
        item_ids.append(sorted(set(items)))
        spans.append([list(x) for x in own])
    arrays = [pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(item_ids, pa.list_(pa.string())), pa.array(spans, pa.list_(pa.list_(pa.int64())))]
    return pa.RecordBatch.from_arrays([*columns, *arrays], names=names)


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    window: int = 13,
    id_column: str = "doc_id",
    text_column: str = "text",
    item_column: str = "item_id",
    item_text_column: str = "text",
    keep_columns: tuple[str, ...] = (),
    max_local_words: int = 500_000,
    max_local_bytes: int = 8_000_000,
) -> DataFrame:
    """id, kept columns, n_words, n_hit, item_ids (sorted strings), spans (begin and end word of each hit run)."""
    items = benchmark.filter(F.col(item_column).isNotNull() & F.col(item_text_column).isNotNull()).select(F.col(item_column).cast("string").alias("item"), F.col(item_text_column).alias("item_text"))
    columns = list(dict.fromkeys([id_column, *keep_columns]))
    own = docs.select(*columns, F.col(text_column).alias("_text"))
    fields = [docs.schema[c] for c in columns]
    names = [*columns, *(n for n, _ in _ADDED)]
    schema = T.StructType([*fields, *(T.StructField(n, kind) for n, kind in _ADDED)])
    words = F.size(F.array_remove(F.split(_lowered(F.col("item_text")), _NO_WORD), ""))
    size = items.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(n) for n, c in (("words", words), ("bytes", F.octet_length("item_text") + F.octet_length("item"))))).first()
    if size["words"] > max_local_words or size["bytes"] > max_local_bytes:
        return _by_join(own, items, window, columns, names, schema)
    texts = [(r["item"], r["item_text"].encode()) for r in items.collect()]  # max_local_words and max_local_bytes at most
    vocabulary = frozenset(w for _, text in texts for w in words_of(text))
    context = docs.sparkSession.sparkContext
    counts = {bytes(r["word"]): r["n"] for r in word_counts(own, vocabulary, "_text").collect()}  # a row for each benchmark word
    index = context.broadcast(ItemIndex(texts, window, counts))

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = index.value
        for batch in batches:
            yield _rows(batch.columns[:-1], _matches(found, text_bytes(batch.columns[-1])), names)

    return own.mapInArrow(match, schema)


def _matches(index: ItemIndex, texts: Iterable[bytes]) -> Iterator[tuple[int, list[tuple[int, int]], list[str]]]:
    for text in texts:
        words = words_of(text)
        spans, found = index.match(words)
        yield len(words), spans, [index.texts[k][0] for k in found]


#: Salts of a hot token, and candidates of a document that are verified in one row.
_SALTS, _CANDIDATES = 32, 64


def _by_join(own: DataFrame, items: DataFrame, window: int, columns: list[str], names: list[str], schema: T.StructType) -> DataFrame:
    """For a benchmark of any size: the prefix tokens meet the words of documents in a join."""
    counts = checkpoint(word_counts(own, None, "_text").select(F.col("word").cast("string").alias("token"), F.col("n").alias("seen")))
    items = items.distinct().withColumn("row", F.sha2(F.concat(F.length("item").cast("string"), F.lit(":"), "item", "item_text"), 256))  # an id may have several texts
    placed = items.withColumn("item_words", F.array_remove(F.split(_lowered(F.col("item_text")), _NO_WORD), ""))
    tokens = placed.select("row", F.posexplode("item_words").alias("place", "token"), F.size("item_words").alias("n"))
    counted = tokens.join(counts, "token", "left").na.fill({"seen": 0})
    starts = counted.select("*", F.explode(F.sequence(F.greatest(F.lit(0), F.col("place") - window + 1), F.greatest(F.lit(0), F.least("place", F.col("n") - window)))).alias("start"))
    prefix = starts.groupBy("row", "start").agg(F.min_by("token", F.struct("seen", "token", "place")).alias("token")).select("row", "token").distinct()
    keyed = own.withColumn("_key", F.md5(F.coalesce("_text", F.lit(""))))
    distinct = keyed.groupBy("_key").agg(F.first("_text").alias("_text"))
    said = distinct.select("_key", F.explode(F.array_distinct(F.split(_lowered(F.col("_text")), _NO_WORD))).alias("token"))
    # tokens with over one in HOT_ONE_IN of all words: so many of them at most, by arithmetic
    total = counts.agg(F.coalesce(F.sum("seen"), F.lit(0)).alias("n")).first()["n"]
    hot = F.broadcast(counts.filter(F.col("seen") > max(total // HOT_ONE_IN, HOT_ONE_IN)).select("token", F.lit(True).alias("hot")))
    salted = said.join(hot, "token", "left").select("_key", "token", F.when(F.col("hot"), F.pmod(F.xxhash64("_key"), F.lit(_SALTS)).cast("int")).otherwise(0).alias("salt"))
    copied = prefix.join(hot, "token", "left").select("row", "token", F.explode(F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(_SALTS - 1))).otherwise(F.array(F.lit(0)))).alias("salt"))
    pairs = checkpoint(salted.join(copied, ["token", "salt"]).select("_key", "row").distinct())
    parts = pairs.groupBy("_key").agg(F.ceil(F.count("*") / _CANDIDATES).cast("int").alias("parts"))
    dealt = pairs.join(parts, "_key").select("_key", "row", F.pmod(F.xxhash64("row"), F.col("parts")).alias("part"))
    lists = dealt.join(items, "row").groupBy("_key", "part").agg(F.collect_list(F.struct("item", "item_text")).alias("_items"))

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, text, own_items in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                index = ItemIndex([(x["item"], x["item_text"].encode()) for x in own_items], window, {})
                _, spans, found = next(_matches(index, [text]))
                rows.append((key, [list(s) for s in spans], sorted(set(found))))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(arrow)], names=["_key", "_spans", "_found"])

    arrow = (pa.string(), pa.list_(pa.list_(pa.int64())), pa.list_(pa.string()))
    hits = distinct.join(lists, "_key").select("_key", "_text", "_items").mapInArrow(match, "_key string, _spans array<array<long>>, _found array<string>")
    by_text = hits.groupBy("_key").agg(F.flatten(F.collect_list("_spans")).alias("_spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("_found")))).alias("_found"))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, spans, found = text_bytes(batch.columns[-3]), batch.columns[-2].to_pylist(), batch.columns[-1].to_pylist()
            matched = [(len(words_of(t)), _merged(s or ()), f or []) for t, s, f in zip(texts, spans, found, strict=True)]
            yield _rows(batch.columns[:-3], matched, names)

    return keyed.join(by_text, "_key", "left").select(*columns, "_text", "_spans", "_found").mapInArrow(merge, schema)


def _lowered(text):
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def is_contaminated(n_words: str = "n_words", n_hit: str = "n_hit", one_in: int = 20):
    """At least one word in ``one_in`` is hit."""
    return (F.col(n_hit) > 0) & (F.col(n_hit) * one_in >= F.col(n_words))


def items_digest(item_ids: Iterable[str]) -> str:
    return hashlib.sha256(",".join(item_ids).encode()).hexdigest()
