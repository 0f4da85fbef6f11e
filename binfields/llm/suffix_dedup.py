"""Removal of long repeated strings by a distributed merge sort of suffixes that keeps track of common prefixes.

A byte goes if some string of ``length`` bytes that covers it also starts anywhere else. Sorting every suffix of every
text would decide that, but most suffixes can't have a copy, so they are left out first, exactly:

* Anchors. Each window of ``length`` bytes picks the gram of ``gram`` bytes with the smallest hash inside it. Equal windows
  pick the same place, so only places whose gram stands at two places or more matter. (Gram hashes are counted by Spark.)
* Blocks of windows. Windows around one anchor are told apart by the distance from window start to anchor. A block of
  distances has a hull (the string that all its windows cover together) and a core (what they have in common). If the
  hull, aligned to the anchor, stands elsewhere too, all windows of the block do; if the core does not, none does; else
  the block is divided. The last level has single windows, so the answer is exact. Of texts with equal hulls one goes on
  as a witness for others that share less, as long as a block with the same gram is undecided.

Whether such strings stand elsewhere is found by sorting them, which are suffixes cut at the length in question. A task
sorts its own suffixes into runs, collapses equal ones, and front-codes the run (length of the prefix shared with the
suffix before, and the rest). Runs are exchanged by ranges with sampled splitters (on two levels, if there are many
ranges, so that the driver's share does not grow). Each range is merged by a loser tree
that knows how much each head shares with the last winner: a longer shared prefix wins without a look at the bytes,
and only at equal lengths are bytes compared, from there on. Equal neighbours are the copies.

A string that a third of all rows hold is one entry for each run, and its copies within a run are known on the spot, so
no range is hot. Texts that occur twice or more as a whole are counted by digest and enter once.

Defined cases: null is the empty text; texts shorter than ``length`` stay; matches never cross texts; repeated rows are
copies of each other, so all bytes of a repeated text of ``length`` bytes or more go; an empty table gives an empty
result; other columns are left out. Texts are told apart by a 128-bit digest, grams by 64 bits (a collision
only costs time).
"""

from __future__ import annotations

import hashlib
import struct
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from binfields.llm.common import checkpoint, join_counted, slices, text_view

_POSITION = 26
_LOW = np.uint64((1 << _POSITION) - 1)
_ANCHOR = np.dtype([("hash", "<i8"), ("x", "<i4"), ("first", "<i4"), ("last", "<i4")])
#: done: known to be repeated, kept as a witness; open: undecided.
_NODE = np.dtype([("hash", "<i8"), ("x", "<i4"), ("first", "<i4"), ("last", "<i4"), ("low", "<i4"), ("high", "<i4"), ("done", "<i4"), ("open", "<i4")])
_NODE_COLUMNS = "digest binary, hash long, x int, first int, last int, low int, high int, done int, open int"
#: What a code says of a string: the hull is repeated, the core is, this owner is the witness of its hull.
_HULL, _CORE, _WITNESS = range(3)
_SPREAD = (np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (np.arange(1, 257, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) >> np.uint64(23))
_FACTORS = [np.uint64(0x9E3779B97F4A7C15 + 2 * 0x1000003D * (k + 1) ** 3) for k in range(16)]


def gram_length(length: int) -> int:
    """The largest power of two up to a third of the length (at least 1)."""
    return 1 << max(0, (max(length, 3) // 3).bit_length() - 1)


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of the ``gram`` bytes from each place on, by doubling."""
    out, size, k = _SPREAD[data], 1, 0
    while size < gram:
        out = out[:-size] * _FACTORS[k] + out[size:]
        size, k = 2 * size, k + 1
    out ^= out >> np.uint64(32)
    out *= _FACTORS[k]
    out ^= out >> np.uint64(29)
    return out


def sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while 2 * size <= width:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    return np.minimum(values[: len(values) - (width - size)], values[width - size :])


def find_anchors(data: np.ndarray, offsets: np.ndarray, length: int, most: int = 1 << 19) -> list[np.ndarray]:
    """For each text, its anchors: hash of the gram, its place, first and last window start that pick it."""
    gram = gram_length(length)
    out: list[np.ndarray] = [np.zeros(0, _ANCHOR)] * (len(offsets) - 1)
    for begin, end in slices(len(offsets) - 1, offsets, most):
        low, high = int(offsets[begin]), int(offsets[end])
        for at in range(low, max(high - length + 1, low), most):  # more than one step for very long texts only
            own = data[at : min(high, at + most + length - 1)] if end - begin == 1 else data[low:high]
            if len(own) < length:
                continue
            hashes = gram_hashes(own, gram)
            packed = (hashes & ~_LOW) | np.arange(len(hashes), dtype=np.uint64)
            picked = (sliding_minimum(packed, length - gram + 1) & _LOW).astype(np.int64)
            edges = offsets[begin : end + 1] - at if end - begin > 1 else np.array([0, len(own)])
            starts = np.arange(len(picked))
            owner = np.searchsorted(edges, starts, side="right") - 1
            valid = starts + length <= edges[np.minimum(owner + 1, len(edges) - 1)]
            starts, owner = starts[valid], owner[valid]
            chosen = picked[valid]
            if not len(starts):
                continue
            new = np.flatnonzero(np.r_[True, (np.diff(chosen) != 0) | (np.diff(owner) != 0)])
            last = np.r_[new[1:] - 1, len(starts) - 1]
            rows = np.zeros(len(new), _ANCHOR)
            rows["hash"] = hashes[chosen[new]].view(np.int64)
            shift = edges[owner[new]] if end - begin > 1 else np.full(len(new), low - at)
            rows["x"], rows["first"], rows["last"] = chosen[new] - shift, starts[new] - shift, starts[last] - shift
            bounds = np.searchsorted(owner[new], np.arange(end - begin + 1))
            for k in range(end - begin):
                if bounds[k + 1] > bounds[k]:
                    some = rows[bounds[k] : bounds[k + 1]]
                    before = out[begin + k]
                    if len(before) and before["x"][-1] == some["x"][0]:  # windows on both sides of a step's end picked one place
                        some["first"][0] = before["first"][-1]
                        before = before[:-1]
                    out[begin + k] = np.concatenate([before, some]) if len(before) else some
            if end - begin > 1:
                break
    return out


def _digests(offsets: np.ndarray, whole: bytes) -> list[bytes]:
    at = offsets.tolist()
    return [xxhash.xxh3_128_digest(whole[a:b]) for a, b in zip(at, at[1:], strict=False)]


def _describe(schema: pa.Schema, length: int):
    """Rows of id, digest, n_bytes, sha256, anchors; anchors only at the first copy of a text in the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            offsets, data = text_view(batch.column(1))
            whole = data.tobytes()
            names = _digests(offsets, whole)
            anchors = find_anchors(data, offsets, length)
            at = offsets.tolist()
            sums = [hashlib.sha256(whole[a:b]).hexdigest() for a, b in zip(at, at[1:], strict=False)]
            blobs = []
            for name, rows in zip(names, anchors, strict=True):
                blobs.append(rows.tobytes() if name not in seen and len(rows) else None)
                seen.add(name)
            arrays = [batch.column(0), pa.array(names, pa.binary()), pa.array(np.diff(offsets)), pa.array(sums), pa.array(blobs, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return run


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digest and compressed text, once for each text of the task."""
    seen: set[bytes] = set()
    packer = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        offsets, data = text_view(batch.column(0))
        whole, at = data.tobytes(), offsets.tolist()
        names, kept, blobs = _digests(offsets, whole), [], []
        for k, name in enumerate(names):
            if name not in seen:
                seen.add(name)
                kept.append(name)
                blobs.append(packer.compress(whole[at[k] : at[k + 1]]))
        yield pa.RecordBatch.from_pydict({"digest": pa.array(kept, pa.binary()), "packed": pa.array(blobs, pa.binary())})


def _exploded(kind: np.dtype):
    """A row for each record of a packed column: digest and the record's fields."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, blobs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            rows = np.frombuffer(b"".join(blobs), kind)
            sizes = [len(b) // kind.itemsize for b in blobs]
            owners = pa.array(names, pa.binary()).take(pa.array(np.repeat(np.arange(len(sizes)), sizes)))
            yield pa.RecordBatch.from_arrays([owners, *(pa.array(np.ascontiguousarray(rows[f])) for f in kind.names)], names=["digest", *kind.names])

    return run


def common_prefix(a: bytes, b: bytes, known: int) -> int:
    """Length of the prefix that a and b share, of which ``known`` bytes are known."""
    end = min(len(a), len(b))
    if known < end and a[known] != b[known]:
        return known
    x = int.from_bytes(a[known:end], "big") ^ int.from_bytes(b[known:end], "big")
    return end - (x.bit_length() + 7) // 8


def front_code(entries: list[tuple[bytes, bytes, bool]]) -> bytes:
    """A sorted run of different (suffix, owner, more) as shared prefix length, rest, owner; more: it has other owners too."""
    out, before = [], b""
    for key, owner, more in entries:
        shared = common_prefix(before, key, 0) if before else 0
        out.append(struct.pack("<IIBB", shared, len(key) - shared, len(owner), more) + key[shared:] + owner)
        before = key
    return b"".join(out)


def _decode(run: bytes) -> Iterator[tuple[bytes, int, bytes, int]]:
    """suffix, prefix shared with the one before, owner, more."""
    at, before = 0, b""
    while at < len(run):
        shared, rest, named, more = struct.unpack_from("<IIBB", run, at)
        at += 10
        before = before[:shared] + run[at : at + rest]
        at += rest
        yield before, shared, run[at : at + named], more
        at += named


def merge_runs(runs: list[bytes]) -> Iterator[tuple[bytes, int, bytes, int]]:
    """Merges front-coded runs with a loser tree: suffix, prefix shared with the last one given, owner, more.

    ``shared[r]`` is what the head of run r shares with the last winner it was compared with; on its way up, a new head
    meets losers that were compared with that same winner.
    """
    sources = [_decode(r) for r in runs]
    n = len(sources)
    heads: list[tuple[bytes, int, bytes, int] | None] = [next(s, None) for s in sources]
    shared = [0] * n
    losers = [-1] * n

    def play(a: int, b: int) -> tuple[int, int]:
        """Winner and loser; the loser then knows what it shares with the winner."""
        if heads[a] is None or heads[b] is None:
            return (b, a) if heads[a] is None else (a, b)
        if shared[a] != shared[b]:
            return (a, b) if shared[a] > shared[b] else (b, a)
        x, y = heads[a][0], heads[b][0]
        m = common_prefix(x, y, shared[a])
        if m < len(x) and m < len(y):
            smaller = x[m] < y[m]
        else:
            smaller = len(x) < len(y) or (len(x) == len(y) and a < b)
        winner, loser = (a, b) if smaller else (b, a)
        shared[loser] = m
        return winner, loser

    def build(node: int) -> int:
        if node >= n:
            return node - n
        winner, losers[node] = play(build(2 * node), build(2 * node + 1))
        return winner

    top = build(1) if n > 1 else 0
    while n and heads[top] is not None:
        yield heads[top][0], shared[top], *heads[top][2:]
        heads[top] = next(sources[top], None)
        shared[top] = heads[top][1] if heads[top] else 0
        node = (top + n) // 2
        while node:
            top, losers[node] = play(losers[node], top)
            node //= 2


def _owner(digest: bytes, x: int, low: int, kind: int) -> bytes:
    return digest + struct.pack("<Q", _code(x, low, kind))


def _code(x: int, low: int, kind: int) -> int:
    return (x << 18) | (low << 2) | kind


def _strings(text: bytes, nodes: np.ndarray, length: int, first_level: bool) -> Iterator[tuple[bytes, int, int, int]]:
    """Suffixes to sort for each node: cut suffix with its alignment, x, low, kind."""
    for _, x, _, _, low, high, _, _ in nodes.tolist():
        begin, end = x - high, x - low + length
        if begin >= 0 and end <= len(text):
            yield text[begin:end] + struct.pack(">HB", low, _HULL), x, low, _HULL
        if high > low and not first_level:
            yield text[x - low : x - high + length] + struct.pack(">HB", low, _CORE), x, low, _CORE


def _make_runs(length: int, first_level: bool, splitters: list[bytes], most: int = 48 << 20):
    """Sorted front-coded runs by range: range, run (null: owners known to be copies), body."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpacker = zstandard.ZstdDecompressor()
        turn = 0

        def flush(entries: list[tuple[bytes, bytes]]) -> Iterator[pa.RecordBatch]:
            nonlocal turn
            entries.sort()
            single: list[tuple[bytes, bytes, bool]] = []
            copies: list[bytes] = []
            k = 0
            while k < len(entries):
                j = k + 1
                while j < len(entries) and entries[j][0] == entries[k][0]:
                    j += 1
                if j - k > 1:
                    copies += [e[1] for e in entries[k:j]]
                single.append((*entries[k], j - k > 1))
                k = j
            keys = [e[0] for e in single]
            bounds = [0, *(bisect_right(keys, s) for s in splitters), len(keys)]
            ranges, bodies, known = [], [], []
            for r, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)):
                if b > a:
                    ranges.append(r)
                    bodies.append(front_code(single[a:b]))
                    known.append(False)
            for at in range(0, len(copies), 5000):
                turn += 1
                ranges.append((turn * 7 + len(entries)) % (len(splitters) + 1))
                bodies.append(b"".join(copies[at : at + 5000]))
                known.append(True)
            for at in range(0, len(ranges), 64):
                yield pa.RecordBatch.from_pydict({"range": pa.array(ranges[at : at + 64], pa.int32()), "known": pa.array(known[at : at + 64]), "body": pa.array(bodies[at : at + 64], pa.binary())})

        entries: list[tuple[bytes, bytes]] = []
        size = 0
        for batch in batches:
            for digest, packed, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for key, x, low, kind in _strings(unpacker.decompress(packed), np.frombuffer(blob, _NODE), length, first_level):
                    entries.append((key, _owner(digest, x, low, kind)))
                    size += len(key) + 120
                if size > most:
                    yield from flush(entries)
                    entries, size = [], 0
        yield from flush(entries)

    return run


def _merge_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Owners (digest, code) of suffixes that stand elsewhere too; rows come sorted by range."""

    def told(copies: list[tuple[bytes, int]]) -> Iterator[bytes]:
        """Of one suffix, owners by run: those not known by the task to be copies, and a witness for hulls."""
        if len(copies) > 1 or copies and copies[0][1]:
            yield from (owner for owner, more in copies if not more)
            if copies[0][0][16] & 3 == _HULL:
                code = int.from_bytes(copies[0][0][16:], "little")
                yield copies[0][0][:16] + struct.pack("<Q", code - _HULL + _WITNESS)

    def merged(runs: list[bytes]) -> Iterator[bytes]:
        before, copies = -1, []
        for key, shared, owner, more in merge_runs(runs):
            if not shared == len(key) == before:
                yield from told(copies)
                before, copies = len(key), []
            copies.append((owner, more))
        yield from told(copies)

    def out(owners: list[bytes]) -> pa.RecordBatch:
        codes = np.frombuffer(b"".join(o[16:] for o in owners), "<i8")
        return pa.RecordBatch.from_pydict({"digest": pa.array([o[:16] for o in owners], pa.binary()), "code": pa.array(codes)})

    def pieces(runs: list[bytes], most: int = 20_000) -> Iterator[pa.RecordBatch]:
        owners: list[bytes] = []
        for owner in merged(runs):
            owners.append(owner)
            if len(owners) == most:
                yield out(owners)
                owners = []
        if owners:
            yield out(owners)

    now, runs = None, []
    for batch in batches:
        for r, known, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if r != now:
                yield from pieces(runs)
                now, runs = r, []
            if known:
                yield out([body[k : k + 24] for k in range(0, len(body), 24)])
            else:
                runs.append(body)
    yield from pieces(runs)


def _decide(first_level: bool):
    """From nodes and the codes of their strings: nodes to divide, and repeated window starts (first, last)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, blobs, codes = (c.to_pylist() for c in batch.columns)
            pending_out, found_out = [], []
            for blob, own in zip(blobs, codes, strict=True):
                told = set(own or ())
                pending, found = [], []
                for node in np.frombuffer(blob, _NODE).tolist():
                    name, x, first, last, low, high, done, _ = node
                    if _code(x, low, _HULL) in told:
                        if not done:
                            found.append((x - high, x - low))
                        if high > low and _code(x, low, _WITNESS) in told:
                            pending.append((name, x, first, last, low, high, 1, 0))
                    elif high > low and (first_level or _code(x, low, _CORE) in told):
                        pending.append((name, x, first, last, low, high, done, 1 - done))
                pending_out.append(np.array(pending, _NODE).tobytes() if pending else None)
                found_out.append(np.array(found, "<i4").tobytes() if found else None)
            yield pa.RecordBatch.from_pydict({"digest": pa.array(digests, pa.binary()), "nodes": pa.array(pending_out, pa.binary()), "found": pa.array(found_out, pa.binary())})

    return run


def _divide(parts: int):
    """Packs the children of each text's nodes: blocks of distances with windows that picked the anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pack_nodes(batches):
            blobs = []
            for blob in batch.column(1).to_pylist():
                children = []
                for name, x, first, last, low, high, done, _ in np.frombuffer(blob, _NODE).tolist():
                    step = -(-(high - low + 1) // parts)
                    for a in range(low, high + 1, step):
                        b = min(a + step - 1, high)
                        if max(x - b, first) <= min(x - a, last):
                            children.append((name, x, first, last, a, b, done, 0))
                blobs.append(np.array(children, _NODE).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(blobs, pa.binary())], names=["digest", "nodes"])

    return run


def spans_of(found: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Merged byte ranges (begin, end) covered by windows that start in any of the ranges (first, last)."""
    out: list[tuple[int, int]] = []
    for first, last in sorted(map(tuple, found.reshape(-1, 2).tolist())):
        if out and first <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], last + length))
        else:
            out.append((first, last + length))
    return out


def _results(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpacker = zstandard.ZstdDecompressor()
        for batch in batches:
            digests, packed, found = (c.to_pylist() for c in batch.columns)
            spans, sums = [], []
            for body, own in zip(packed, found, strict=True):
                text = unpacker.decompress(body)
                merged = spans_of(np.frombuffer(b"".join(own), "<i4"), length)
                kept, at = hashlib.sha256(), 0
                for begin, end in merged:
                    kept.update(text[at:begin])
                    at = end
                kept.update(text[at:])
                spans.append([list(s) for s in merged])
                sums.append(kept.hexdigest())
            yield pa.RecordBatch.from_pydict({"digest": pa.array(digests, pa.binary()), "spans": pa.array(spans, pa.list_(pa.list_(pa.int64()))), "kept_sha256": pa.array(sums)})

    return run


def repeated_spans(docs: DataFrame, *, length: int = 400, id_column: str = "doc_id", text_column: str = "text", parts: int = 4) -> DataFrame:
    """id, n_bytes, spans (begin and end byte of each maximal removed run), kept_sha256 of the other bytes, for every row."""
    spark = docs.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kinds = [docs.schema[id_column], T.StructField("digest", T.BinaryType()), T.StructField("n_bytes", T.LongType()), T.StructField("sha", T.StringType()), T.StructField("anchors", T.BinaryType())]
    described = T.StructType(kinds)
    names = pa.schema([(f.name, pa.null()) for f in kinds])
    rows = checkpoint(docs.select(id_column, text_column).mapInArrow(_describe(names, length), described))

    anchors = rows.filter("anchors is not null").select("digest", "anchors").mapInArrow(_exploded(_ANCHOR), "digest binary, hash long, x int, first int, last int")
    place = F.struct("digest", "x")
    grams = anchors.groupBy("hash").agg(F.min(place).alias("a"), F.max(place).alias("b"), F.count("*").alias("n")).filter("a <> b")
    often = join_counted(anchors, checkpoint(grams.select("hash", "n")), ["hash"], "n")
    zero = F.lit(0)
    node = F.struct("hash", "x", "first", "last", zero.alias("low"), F.lit(length - gram_length(length)).alias("high"), zero.alias("done"), zero.alias("open"))
    nodes = often.groupBy("digest").agg(F.collect_set(node).alias("nodes"))
    nodes = checkpoint(nodes.mapInArrow(_pack_nodes, "digest binary, nodes binary"))

    # texts that have such anchors, dealt by digest; later joins on the digest find them in place
    texts = docs.select(text_column).mapInArrow(_texts, "digest binary, packed binary").repartition(tasks, "digest").dropDuplicates(["digest"])
    texts = checkpoint(texts.join(nodes.select("digest").repartition(tasks, "digest"), "digest", "left_semi"))

    found, level, width = [], 0, length - gram_length(length) + 1
    while True:
        splitters, parts_inside, inner = _splitters(texts, nodes, length, width, tasks)
        own = texts.join(nodes.repartition(tasks, "digest"), "digest").select("digest", "packed", "nodes")
        runs = own.mapInArrow(_make_runs(length, level == 0, splitters), _RUNS)
        ranges = len(splitters) + 1
        if inner is not None:
            runs, ranges = _divided(runs, inner, parts_inside), ranges * parts_inside
        places = min(ranges, max(tasks, MOST_PARTITIONS))
        repeated = runs.repartitionById(places, F.pmod("range", F.lit(places))).sortWithinPartitions("range").mapInArrow(_merge_ranges, "digest binary, code long")
        codes = repeated.groupBy("digest").agg(F.collect_list("code").alias("codes"))
        decided = checkpoint(nodes.join(codes, "digest", "left").select("digest", "nodes", "codes").mapInArrow(_decide(level == 0), "digest binary, nodes binary, found binary"))
        found.append(decided.filter("found is not null").select("digest", "found"))
        if width == 1:
            break
        width, level = -(-width // parts), level + 1
        pending = decided.filter("nodes is not null").select("digest", "nodes").mapInArrow(_exploded(_NODE), _NODE_COLUMNS)
        undecided = checkpoint(pending.groupBy("hash", "low").agg(F.count("*").alias("n"), F.max("open").alias("any")).filter("any = 1 and n > 1").drop("any"))
        kept = join_counted(pending, undecided, ["hash", "low"], "n").groupBy("digest").agg(F.collect_list(F.struct(*_NODE.names)).alias("nodes"))
        nodes = checkpoint(kept.mapInArrow(_divide(parts), "digest binary, nodes binary").filter("length(nodes) > 0"))
        if nodes.isEmpty():
            break
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    ranges = every.groupBy("digest").agg(F.collect_list("found").alias("found"))
    removed = texts.join(ranges.repartition(tasks, "digest"), "digest").select("digest", "packed", "found").mapInArrow(_results(length), "digest binary, spans array<array<long>>, kept_sha256 string")

    copies = rows.groupBy("digest").agg(F.count("*").alias("n"), F.max("n_bytes").alias("n_bytes"))
    whole = F.array(F.array(F.lit(0).cast("long"), F.col("n_bytes")))
    repeated_whole = (F.col("n") > 1) & (F.col("n_bytes") >= length)
    by_text = copies.join(removed, "digest", "left").select(
        "digest",
        "n",
        F.when(repeated_whole, whole).otherwise(F.col("spans")).alias("spans"),
        F.when(repeated_whole, F.sha2(F.lit(""), 256)).otherwise(F.col("kept_sha256")).alias("kept_sha256"),
    )
    joined = join_counted(rows.select(id_column, "digest", "n_bytes", "sha"), checkpoint(by_text), ["digest"], "n")
    return joined.select(id_column, "n_bytes", F.coalesce("spans", F.array().cast("array<array<long>>")).alias("spans"), F.coalesce("kept_sha256", "sha").alias("kept_sha256"))


def _pack_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column(1)
        flat, sizes = lists.flatten(), lists.value_lengths().to_pylist()
        rows = np.zeros(len(flat), _NODE)
        for name in _NODE.names:
            rows[name] = flat.field(name).to_numpy()
        body, at, blobs = rows.tobytes(), 0, []
        for n in sizes:
            blobs.append(body[at : at + n * _NODE.itemsize])
            at += n * _NODE.itemsize
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(blobs, pa.binary())], names=["digest", "nodes"])


#: Bytes of suffixes that a range should have before front-coding, keys sampled for each range, bytes of a splitter.
RANGE_BYTES, KEYS_A_RANGE, SPLITTER_BYTES = 16 << 20, 20, 128
#: Ranges that the driver divides all suffixes into, at most, so that what it draws and sends does not grow with the input;
#: if they don't suffice, each is divided again by tasks. Partitions that ranges are dealt to, at most (or one for each task).
OUTER_RANGES, INNER_RANGES, MOST_PARTITIONS = 1024, 4096, 10_000
_RUNS = "range int, known boolean, body binary"


def _drawn_keys(texts: DataFrame, nodes: DataFrame, share: float, tasks: int) -> DataFrame:
    """Beginnings of the suffixes of a hashed share of the nodes, so long texts count by their nodes."""

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, blobs = [], []
            for digest, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = np.frombuffer(blob, _NODE)
                chosen = own[np.random.default_rng(int.from_bytes(digest[:8], "big")).random(len(own)) < share]
                if len(chosen):
                    digests.append(digest)
                    blobs.append(chosen.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(blobs, pa.binary())], names=["digest", "nodes"])

    def keys_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpacker = zstandard.ZstdDecompressor()
        for batch in batches:
            keys = []
            for packed, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                text = unpacker.decompress(packed)
                for _, x, _, _, _, high, _, _ in np.frombuffer(blob, _NODE).tolist():
                    begin = max(0, x - high)
                    keys.append(text[begin : begin + SPLITTER_BYTES])
            yield pa.RecordBatch.from_pydict({"key": pa.array(keys, pa.binary())})

    drawn = nodes.select("digest", "nodes").mapInArrow(draw, "digest binary, nodes binary")
    return texts.join(drawn.repartition(tasks, "digest"), "digest").select("packed", "nodes").mapInArrow(keys_of, "key binary")


def _cuts(keys: list[bytes], parts: int) -> list[bytes]:
    return sorted({keys[k * len(keys) // parts] for k in range(1, parts)}) if keys else []


def _splitters(texts: DataFrame, nodes: DataFrame, length: int, width: int, tasks: int) -> tuple[list[bytes], int, DataFrame | None]:
    """Keys between OUTER_RANGES ranges at most, parts that each of these is divided into, and the keys inside it (range, body) if it is.

    Drawn anew for each level. The driver sees KEYS_A_RANGE keys for each outer range, however large the input is.
    """
    total = nodes.agg(F.coalesce(F.sum(F.length("nodes")), F.lit(0)).alias("n")).first()["n"] // _NODE.itemsize
    ranges = max(tasks, -(-total * (length + width) // RANGE_BYTES))
    outer = min(ranges, max(tasks, OUTER_RANGES))
    picked = _drawn_keys(texts, nodes, min(1.0, KEYS_A_RANGE * outer / max(total, 1)), tasks)
    splitters = _cuts(sorted(bytes(r["key"]) for r in picked.collect()), outer)  # KEYS_A_RANGE short keys for each outer range
    parts = min(-(-ranges // outer), INNER_RANGES)
    if parts == 1:
        return splitters, 1, None

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array([bisect_right(splitters, k) for k in keys], pa.int32()), batch.column(0)], names=["range", "key"])

    def cut(key: tuple, keys: pa.Table) -> pa.Table:
        own = _cuts(sorted(keys.column("key").to_pylist()), parts)
        return pa.table({"range": pa.array([key[0].as_py()], pa.int32()), "body": pa.array([b"".join(struct.pack("<H", len(k)) + k for k in own)], pa.binary())})

    more = _drawn_keys(texts, nodes, min(1.0, KEYS_A_RANGE * outer * parts / max(total, 1)), tasks)
    # a range has KEYS_A_RANGE * parts short keys
    return splitters, parts, more.mapInArrow(placed, "range int, key binary").groupBy("range").applyInArrow(cut, "range int, body binary")


def _divided(runs: DataFrame, inner: DataFrame, parts: int, salts: int = 16) -> DataFrame:
    """Runs cut again by the keys inside their range, which stand first among the rows of a range and salt."""
    cuts = inner.select("range", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), F.lit(0).alias("kind"), F.lit(False).alias("known"), "body")
    rows = runs.select("range", F.pmod(F.xxhash64("body"), F.lit(salts)).cast("int").alias("salt"), F.lit(1).alias("kind"), "known", "body")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own = None, []
        for batch in batches:
            ranges, bodies, known = [], [], []
            for r, kind, is_known, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if r != now:
                    now, own = r, []
                if kind == 0:
                    own, at = [], 0
                    while at < len(body):
                        n = struct.unpack_from("<H", body, at)[0]
                        own.append(body[at + 2 : at + 2 + n])
                        at += 2 + n
                    continue
                if is_known:
                    pieces = [(0, body)]
                else:
                    entries = [(key, owner, more) for key, _, owner, more in _decode(body)]
                    bounds = [0, *(bisect_right([e[0] for e in entries], k) for k in own), len(entries)]
                    pieces = [(k, front_code(entries[a:b])) for k, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)) if b > a]
                for k, piece in pieces:
                    ranges.append(r * parts + k)
                    bodies.append(piece)
                    known.append(is_known)
            for at in range(0, len(ranges), 64):
                yield pa.RecordBatch.from_pydict({"range": pa.array(ranges[at : at + 64], pa.int32()), "known": pa.array(known[at : at + 64]), "body": pa.array(bodies[at : at + 64], pa.binary())})

    dealt = cuts.unionByName(rows).repartition("range", "salt").sortWithinPartitions("range", "salt", "kind")
    return dealt.select("range", "kind", "known", "body").mapInArrow(split, _RUNS)
