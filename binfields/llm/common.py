"""Helpers shared by the training-data operators: byte views of Arrow text columns, tables, lineage cuts.

Rules that every operator of this subpackage follows:

* a null text counts as the empty text unless the operator says otherwise;
* extra input columns never clash with what an operator adds: it selects the columns it needs first;
* repeated rows keep their own output rows, and rows with equal text get equal results.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Maps a byte to itself if it belongs to a word (digits, letters lower-cased, all of non-ASCII), else to a space.
WORD_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
    for b in range(256)
)


def small_batches(spark: SparkSession, most: str = "4m") -> None:
    """Bounds the Arrow batches that Python workers hold, as texts may be long."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", most)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``; only where none is named, as in plain local tests, one is made."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        named = context.getConf().get("spark.checkpoint.dir", "")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return context.getConf().get("spark.checkpoint.dir", "") or context.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


#: Rows of a few numbers each that a task takes at ease.
ROWS_A_TASK = 50_000


def narrowed(df: DataFrame, rows: int, each: int = ROWS_A_TASK) -> DataFrame:
    """``df`` in no more partitions than ``rows`` (its number of rows, or a bound of it) call for, but enough for all cores.

    The number of shuffle partitions fits texts; a table of graph nodes or links would be many small files there, for each
    task of each shuffle and checkpoint.
    """
    return df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // each)))


def text_bytes(column: pa.Array) -> Iterator[bytes]:
    """The UTF-8 bytes of each text; null gives the empty text."""
    offsets, data = text_view(column)
    view = data.tobytes()
    at = offsets.tolist()
    for k in range(len(at) - 1):
        yield view[at[k] : at[k + 1]]


def text_view(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (one more than there are texts, from 0) and the UTF-8 bytes of all texts, as numpy arrays."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8)
    blob = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return at - at[0], blob[at[0] : at[-1]]


def slices(n: int, offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of at most ``most`` bytes each; a longer text stands alone."""
    begin = 0
    while begin < n:
        end = max(begin + 1, int(np.searchsorted(offsets, offsets[begin] + most, side="right")) - 1)
        yield begin, min(end, n)
        begin = end


#: A key is hot if it has over one in so many of the rows; no more keys than that can be.
HOT_ONE_IN = 1000


def join_counted(left: DataFrame, right: DataFrame, keys: list[str], n: str) -> DataFrame:
    """Inner join on ``keys`` with ``right``, which has each key once and in ``n`` how many rows of ``left`` have it.

    Hot keys (at most HOT_ONE_IN of them, by arithmetic) are broadcast, so their rows stay where they are; the others
    meet in a shuffle. Both sides should be cheap to read again. Keys are not null; ``n`` is dropped.
    """
    total = right.agg(F.coalesce(F.sum(n), F.lit(0)).alias("n")).first()["n"]
    rows = right.filter(F.col(n) > max(total // HOT_ONE_IN, HOT_ONE_IN)).collect()
    if not rows:
        return left.join(right.drop(n), keys)
    hot = left.sparkSession.createDataFrame(rows, right.schema).drop(n)
    hot_keys = hot.select(*keys)
    often = left.join(F.broadcast(hot), keys)
    seldom = left.join(F.broadcast(hot_keys), keys, "left_anti").join(right.join(F.broadcast(hot_keys), keys, "left_anti").drop(n), keys)
    return often.unionByName(seldom)
