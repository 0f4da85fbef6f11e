"""The corpus pipeline: quality, repeated lines, near-duplicates, benchmark passages, packing.

Every stage works on all rows that the one before it kept, and returns the columns of ``documents`` (the last one:
packed pieces). ``run`` writes each stage's rows as Parquet to the shared folder and rereads them as the next one's
documents, so a lost executor costs no more than a task of the running stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from binfields.llm.common import shared_folder, small_batches, table
from binfields.llm.decontamination import find_contamination, is_contaminated
from binfields.llm.line_dedup import dedup_lines
from binfields.llm.near_copies import one_of_each_copy
from binfields.llm.packing import pack_documents
from binfields.llm.quality import keep_good
from binfields.llm.queries import tokenizer_path


#: Arrow batches of the stages that need no more at a time. All stages have the same Python workers, which keep what they
#: once took, beside an executor whose heap is full by then.
SMALLEST_BATCHES = "1m"


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    labels = table(spark, sf_dir, "labels")
    small_batches(spark, SMALLEST_BATCHES)
    return keep_good(docs, labels)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated runs of lines go from the texts; n_chars follows the text."""
    small_batches(spark)
    found = dedup_lines(docs)
    length = F.when(F.size("removed_runs") > 0, F.length("text"))
    return found.select(*(F.coalesce(length, F.col(c)).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns))


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, Jaccard 0.8 at least) stays, the one with the smallest id.

    SimHash links the closest copies, and a set join those that fingerprints can't tell (see ``near_copies``).
    """
    small_batches(spark)
    return one_of_each_copy(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go."""
    rows = docs.select("doc_id", "text", F.struct(*docs.columns).alias("_row"))
    benchmark = table(spark, sf_dir, "benchmark")
    small_batches(spark, SMALLEST_BATCHES)
    found = find_contamination(rows, benchmark, keep_columns=("_row",))
    return found.filter(~is_contaminated()).select("_row.*")


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents left, packed."""
    small_batches(spark, SMALLEST_BATCHES)
    return pack_documents(docs, tokenizer_path())


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup),
    ("simhash_dedup", simhash_dedup),
    ("decontamination", decontamination),
    ("best_fit_packing", best_fit_packing),
]

#: The tokenizer and the classifier are beyond SQL; tests/llm/test_pipeline.py holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/corpus-pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
