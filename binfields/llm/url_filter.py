"""URL filters by a sorted digest array.

A rule is a host and the beginning of a path. The rules of one list are kept as a file with a sorted array of
64-bit xxhash keys, followed by the full strings. Spark ships that file to every executor; a task maps it into
memory, derives the few keys that can match a url (each suffix of its host at a label border, with each rule path
length that occurs for that many labels), finds them all by one vectorised binary search, and compares the stored string before it
believes a hit. The longest matching rule decides; a url without a rule gets the default verdict.

The file holds ``max_local_rules`` rules at most (a proven bound on what an executor maps). A longer list is not
shipped: the same keys are joined with the rules by a shuffle, so no list is too long.

Defined cases: a null url or one without ``://`` has an empty host and path and matches no rule; repeated rules
count once, and if they disagree ``block`` wins; rules with a null or empty host are ignored; an empty table gives an
empty result; other columns of the input are left out.
"""

from __future__ import annotations

import atexit
import os
import shutil
import struct
import tempfile
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RULES_SCHEMA = "host string, path string, verdict string"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z lower-cased; else empty."""
    rest = F.substring_index(_after_scheme(url), "#", 1)
    return F.coalesce(F.translate(F.substring_index(F.substring_index(rest, "?", 1), "/", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    rest = F.substring_index(F.substring_index(_after_scheme(url), "#", 1), "?", 1)
    at = F.instr(rest, "/")
    return F.coalesce(F.when(at > 0, F.substring(rest, at, F.length(rest))).otherwise(F.lit("")), F.lit(""))


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def rules_frame(spark: SparkSession, rules: Iterable[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(list(rules), RULES_SCHEMA)


def _clean(rules: DataFrame) -> DataFrame:
    host, path = F.lower("host"), F.coalesce("path", F.lit(""))
    return (
        rules.filter("host is not null and host <> '' and verdict in ('allow', 'block')")
        .groupBy(host.alias("host"), path.alias("path"))
        .agg(F.max("verdict").alias("verdict"))  # block, if both are there
    )


def write_digests(rows: Iterable[tuple[str, str, str]], file: str) -> None:
    """Counts, the pairs of label count and path length that occur, sorted keys, string ends, verdicts, strings."""
    kept = sorted((xxhash.xxh64_intdigest(f"{h}\n{p}"), f"{h}\n{p}".encode(), h.count(".") + 1, len(p), v) for h, p, v in rows)
    shapes = sorted({(labels, length) for _, _, labels, length, _ in kept})
    with open(file, "wb") as out:
        out.write(struct.pack("<qq", len(kept), len(shapes)))
        out.write(np.array(shapes, "<i8").reshape(-1, 2).tobytes())
        out.write(np.array([k[0] for k in kept], "<u8").tobytes())
        out.write(np.cumsum([len(k[1]) for k in kept], dtype="<i8").tobytes())
        out.write(np.array([k[4] == "block" for k in kept], "u1").tobytes())
        out.write(b"".join(k[1] for k in kept))


class DigestArray:
    """A file of ``write_digests``, mapped into memory."""

    def __init__(self, file: str) -> None:
        self.n, shapes = struct.unpack("<qq", open(file, "rb").read(16))
        whole = np.memmap(file, np.uint8, "r")
        at = 16
        self.shapes = [tuple(x) for x in whole[at : at + 16 * shapes].view("<i8").reshape(-1, 2).tolist()]
        at += 16 * shapes
        self.keys = whole[at : at + 8 * self.n].view("<u8")
        at += 8 * self.n
        self.ends = whole[at : at + 8 * self.n].view("<i8")
        at += 8 * self.n
        self.block = whole[at : at + self.n]
        self.strings = whole[at + self.n :]

    def string(self, k: int) -> str:
        begin = int(self.ends[k - 1]) if k else 0
        return self.strings[begin : int(self.ends[k])].tobytes().decode()

    def find(self, wanted: list[str]) -> np.ndarray:
        """The place of each string, -1 if it isn't there."""
        if not wanted or not self.n:
            return np.full(len(wanted), -1)
        digests = np.array([xxhash.xxh64_intdigest(x) for x in wanted], np.uint64)
        places = np.searchsorted(self.keys, digests)
        found = np.full(len(wanted), -1)
        hits = (places < self.n) & (self.keys[np.minimum(places, self.n - 1)] == digests)
        for i in np.flatnonzero(hits):
            k = int(places[i])
            while k < self.n and self.keys[k] == digests[i]:  # equal keys of different strings lie side by side
                if self.string(k) == wanted[i]:
                    found[i] = k
                    break
                k += 1
        return found


@lru_cache(maxsize=4)
def _opened(name: str) -> DigestArray:
    return DigestArray(SparkFiles.get(name))


def _probes(host: str, path: str, lengths: dict[int, list[int]]) -> Iterator[tuple[int, str]]:
    """Size and string of each rule that could fit, longest first for each suffix."""
    labels = host.split(".") if host else []
    for k in range(1, len(labels) + 1):
        suffix = ".".join(labels[-k:])
        for n in lengths.get(k, ()):
            if n <= len(path):
                yield len(suffix) + n, f"{suffix}\n{path[:n]}"


def _lengths(shapes: Iterable[tuple[int, int]]) -> dict[int, list[int]]:
    out: dict[int, list[int]] = {}
    for labels, length in shapes:
        out.setdefault(labels, []).append(length)
    return out


def judge_urls(
    pages: DataFrame,
    rules: DataFrame,
    *,
    id_column: str = "page_id",
    url_column: str = "url",
    default: str = "allow",
    max_local_rules: int = 1_000_000,
    max_local_bytes: int = 64_000_000,
) -> DataFrame:
    """id, host, path, rule (host and path of the longest rule that fits, else null), verdict."""
    spark = pages.sparkSession
    cleaned = _clean(rules)
    urls = pages.select(F.col(id_column), host_of(F.col(url_column)).alias("host"), path_of(F.col(url_column)).alias("path"))
    size = cleaned.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("host") + F.octet_length("path")), F.lit(0)).alias("bytes")).first()
    if size["n"] > max_local_rules or size["bytes"] > max_local_bytes:
        return _judge_by_join(urls, cleaned, id_column, default)
    # the driver serves the file to executors until it ends
    folder = tempfile.mkdtemp(prefix="url-rules-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    file = os.path.join(folder, f"{os.path.basename(folder)}.digests")
    write_digests(((r.host, r.path, r.verdict) for r in cleaned.toLocalIterator()), file)
    spark.sparkContext.addFile(file)
    name = os.path.basename(file)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rule_list = _opened(name)
        lengths = _lengths(rule_list.shapes)
        for batch in batches:
            owners, sizes, wanted = [], [], []
            for i, (host, path) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                for size, probe in _probes(host, path, lengths):
                    owners.append(i)
                    sizes.append(size)
                    wanted.append(probe)
            best: dict[int, tuple[int, int]] = {}
            for i, size, place in zip(owners, sizes, rule_list.find(wanted).tolist(), strict=True):
                if place >= 0:
                    best[i] = max(best.get(i, (-1, -1)), (size, place))
            rule = [rule_list.string(best[i][1]).replace("\n", "") if i in best else None for i in range(batch.num_rows)]
            verdict = [("block" if rule_list.block[best[i][1]] else "allow") if i in best else default for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rule, pa.string()), pa.array(verdict, pa.string())], names=[*batch.schema.names, "rule", "verdict"])

    schema = T.StructType([*urls.schema.fields, T.StructField("rule", T.StringType()), T.StructField("verdict", T.StringType())])
    return urls.mapInArrow(judge, schema)


def _judge_by_join(urls: DataFrame, rules: DataFrame, id_column: str, default: str) -> DataFrame:
    """For lists of any length: each distinct host and path meets its rules by a join on digest and string."""
    shapes = rules.select(F.size(F.split("host", r"\.")).alias("k"), F.length("path").alias("n")).distinct()
    lengths = shapes.groupBy("k").agg(F.collect_set("n").alias("lengths"))
    distinct = urls.select("host", "path").distinct().filter("host <> ''")
    suffixes = distinct.select("host", "path", F.explode(F.sequence(F.lit(1), F.size(F.split("host", r"\.")))).alias("k"))
    probes = (
        suffixes.join(lengths, "k")
        .select("host", "path", F.expr("substring_index(host, '.', -k)").alias("rule_host"), F.explode("lengths").alias("n"))
        .filter("n <= length(path)")
        .withColumn("rule_path", F.expr("left(path, n)"))
    )
    keyed = rules.select(F.col("host").alias("rule_host"), F.col("path").alias("rule_path"), "verdict")
    digest = F.xxhash64("rule_host", "rule_path")
    hits = probes.withColumn("digest", digest).join(keyed.withColumn("digest", digest), ["digest", "rule_host", "rule_path"])
    best = hits.groupBy("host", "path").agg(F.max_by(F.struct(F.concat("rule_host", "rule_path").alias("rule"), "verdict"), F.length("rule_host") + F.length("rule_path")).alias("best"))
    joined = urls.join(best, ["host", "path"], "left")
    return joined.select(id_column, "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
