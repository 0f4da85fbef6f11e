"""Line dedup by winnowing over line hashes. DataFrame operations only.

The units are lines with at least one word; their digests ignore blanks at both ends. A run of whole lines that holds
``min_words`` words or more and also stands earlier (smaller id, or earlier in the text) is repeated.

1. A window is the fewest consecutive lines, from a line onwards or back from a line, that hold ``min_words`` words. As
   a window depends on nothing outside it, equal runs have equal windows.
2. Each window selects its smallest line digest. Every repeated run of enough words holds a window, so it has a
   selected digest in common with its earlier copy: that is the guarantee of winnowing.
3. Selected digests that stand at one position only are dropped; so are the windows that selected them, which is most of the data.
4. The windows left are joined with the earliest position of the same lines. Forward and backward windows together
   extend a match in both directions to its whole length, line by line.
5. A window with an earlier copy is deleted from its text. A line that stands in no such window stays.

Positions of a frequent line are never paired with each other: equal windows meet in a minimum that Spark builds up
map-side first, so a line that stands in a third of all documents is one row for each task.

Defined cases: null, empty and blank texts have no lines and stay as they are; rows are told apart by id and text, so
of repeated rows with one id the copies count as one text and keep the same result; a null id comes before all others; texts that lose all
lines become empty; an empty table gives an empty result; other columns are kept as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from binfields.llm.common import checkpoint, join_counted

_BLANKS = " \t\r\x0b\x0c"


def windows_of(docs: DataFrame, *, min_words: int = 50, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row for each line with a word of each different (id, text).

    id, _key (of the text), _line, _digest, and for its forward and backward window: _f_least, _f_at (the smallest hash
    and its line), _f_last, _b_least, _b_at, _b_first; null if the text has too few words on that side.
    """
    keyed = docs.select(F.col(id_column), F.xxhash64(text_column).alias("_key"), F.col(text_column).alias("_text")).filter("_text is not null")
    lines = keyed.select(id_column, "_key", F.posexplode(F.split("_text", "\n")).alias("_line", "_own"))
    trimmed = lines.withColumn("_own", F.btrim("_own", F.lit(_BLANKS))).filter("_own <> ''")
    digest = F.unhex(F.md5("_own"))
    blanks = F.translate("_own", _BLANKS, " " * len(_BLANKS))
    counted = trimmed.select(id_column, "_key", "_line", digest.alias("_digest"), F.size(F.filter(F.split(blanks, " "), lambda w: w != "")).alias("_words"))
    own = Window.partitionBy(id_column, "_key")
    in_order = own.orderBy("_line")
    # rows with the same id and text give each line again
    single = counted.withColumn("_last", F.lag("_line").over(in_order)).filter("_last is null or _last <> _line").drop("_last")
    placed = single.withColumn("_after", F.sum("_words").over(in_order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_before", F.col("_after") - F.col("_words"))
    # a line belongs to a window if fewer than min_words words stand between it and the window's other end
    forward = own.orderBy("_before").rangeBetween(0, min_words - 1)
    backward = own.orderBy("_after").rangeBetween(-(min_words - 1), 0)
    least = F.struct(F.xxhash64("_digest").alias("least"), F.col("_line").alias("at"))
    framed = placed.select(
        id_column,
        "_key",
        "_line",
        "_digest",
        F.when(F.sum("_words").over(forward) >= min_words, F.struct(F.min(least).over(forward).alias("m"), F.max("_line").over(forward).alias("end"))).alias("_f"),
        F.when(F.sum("_words").over(backward) >= min_words, F.struct(F.min(least).over(backward).alias("m"), F.min("_line").over(backward).alias("end"))).alias("_b"),
    )
    return framed.select(
        id_column, "_key", "_line", "_digest",
        F.col("_f.m.least").alias("_f_least"), F.col("_f.m.at").alias("_f_at"), F.col("_f.end").alias("_f_last"),
        F.col("_b.m.least").alias("_b_least"), F.col("_b.m.at").alias("_b_at"), F.col("_b.end").alias("_b_first"),
    )


def repeated_runs(docs: DataFrame, *, min_words: int = 50, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id, _key, runs: (begin, end) line places, both included, of lines of a repeated run that is not its first copy."""
    lines = checkpoint(windows_of(docs, min_words=min_words, id_column=id_column, text_column=text_column))
    both = F.array(
        F.struct(F.col("_f_least").alias("least"), F.col("_f_at").alias("at"), F.col("_line").alias("first"), F.col("_f_last").alias("last")),
        F.struct(F.col("_b_least").alias("least"), F.col("_b_at").alias("at"), F.col("_b_first").alias("first"), F.col("_line").alias("last")),
    )
    windows = lines.select(id_column, "_key", F.inline(both)).filter("least is not null")
    # the fingerprints: each selected position once
    selected = windows.select(id_column, "_key", "at", "least").distinct()
    often = selected.groupBy("least").agg(F.count("*").alias("n")).filter("n > 1")
    uses = windows.groupBy("least").agg(F.count("*").alias("n")).join(often.select("least"), "least", "left_semi")
    matched = join_counted(windows.select(id_column, "_key", "least", "first", "last"), checkpoint(uses), ["least"], "n")
    spans = matched.select(id_column, "_key", "first", "last").distinct()
    inside = (
        spans.select(id_column, "_key", "first", "last", F.explode(F.sequence("first", "last")).alias("_line"))
        .withColumn("_id", F.to_json(F.struct(id_column)))
        .join(lines.select(F.to_json(F.struct(id_column)).alias("_id"), "_key", "_line", "_digest"), ["_id", "_key", "_line"])
        .groupBy(id_column, "_key", "first", "last")
        .agg(F.array_sort(F.collect_list(F.struct("_line", "_digest"))).alias("_own"))
    )
    content = F.md5(F.concat_ws(",", F.transform("_own", lambda x: F.hex(x["_digest"]))).cast("binary"))
    position = F.struct(F.col(id_column).alias("id"), F.col("_key").alias("key"), F.col("first").alias("line"))
    named = checkpoint(inside.select(id_column, "_key", "first", "last", F.unhex(content).alias("_content")))
    earliest = checkpoint(named.groupBy("_content").agg(F.min(position).alias("_earliest"), F.count("*").alias("n")).filter("n > 1"))
    later = join_counted(named, earliest, ["_content"], "n").filter(position > F.col("_earliest"))
    deleted = later.select(id_column, "_key", F.explode(F.sequence("first", "last")).alias("_line")).distinct()
    island = F.col("_line") - F.row_number().over(Window.partitionBy(id_column, "_key").orderBy("_line"))
    runs = deleted.withColumn("_island", island).groupBy(id_column, "_key", "_island").agg(F.min("_line").alias("begin"), F.max("_line").alias("end"))
    return runs.groupBy(id_column, "_key").agg(F.array_sort(F.collect_list(F.struct("begin", "end"))).alias("runs"))


def dedup_lines(docs: DataFrame, *, min_words: int = 50, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """All columns of ``docs`` with the text without its repeated runs, then n_lines (of the input) and removed_runs.

    Columns of the input with those two names are left out.
    """
    found = repeated_runs(docs, min_words=min_words, id_column=id_column, text_column=text_column)
    found = found.select(F.col(id_column).alias("_id"), F.col("_key").alias("_k"), F.col("runs").alias("_runs"))
    kept_columns = [c for c in docs.columns if c not in ("n_lines", "removed_runs")]
    rows = docs.select(F.struct(*kept_columns).alias("_row"), F.col(id_column).alias("_own"), F.col(text_column).alias("_text"))
    joined = rows.join(found, F.col("_own").eqNullSafe(F.col("_id")) & (F.xxhash64("_text") == F.col("_k")), "left")
    lines = F.split("_text", "\n")
    kept = F.filter(lines, lambda line, k: ~F.exists("_runs", lambda run: k.between(run["begin"], run["end"])))
    text = F.when(F.col("_runs").isNotNull(), F.array_join(kept, "\n")).otherwise(F.col("_text"))
    return joined.select(
        *(text.alias(c) if c == text_column else F.col(f"_row.`{c}`").alias(c) for c in kept_columns),
        F.coalesce(F.size(lines), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce("_runs", F.array().cast("array<struct<begin:int,end:int>>")).alias("removed_runs"),
    )
