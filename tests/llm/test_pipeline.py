import zlib

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from binfields.llm.packing import cut
from binfields.llm.quality import score_quality
from binfields.llm.queries import tokenizer_path
from tests.llm.test_decontamination import brute as hits
from tests.llm.test_line_dedup import brute as removed_lines
from tests.llm.test_near_copies import brute as components_by_jaccard

FOLDER = "/root/testdata/sf0.001"


def test_run_equals_brute_force(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    good = {r.doc_id for r in score_quality(docs, spark.read.parquet(f"{FOLDER}/labels.parquet")).filter("predicted = 1").collect()}
    rows = [(r.doc_id, r.text) for r in docs.orderBy("doc_id").collect() if r.doc_id in good]
    gone = removed_lines(rows, 50)
    rows = [(i, "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone[k]) if gone[k] else t) for k, (i, t) in enumerate(rows)]
    rows = [rows[k] for k in sorted(set(components_by_jaccard([t for _, t in rows])))]  # five words, 0.8 or more: not the rule of op5's query
    items = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]

    def dirty(text):
        n_words, n_hit, _ = hits(text, items)
        return n_hit > 0 and 20 * n_hit >= n_words

    rows = [(i, t) for i, t in rows if not dirty(t)]
    tokenizer = Tokenizer.from_file(tokenizer_path())
    want = set()
    for i, t in rows:
        ids = np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 2], "<u4")
        want |= {(i, k, a, n, zlib.crc32(ids[a : a + n].tobytes())) for k, (a, n) in enumerate(cut(len(ids), 1024))}
    packed = corpus_pipeline.run(spark, FOLDER).collect()
    assert {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed} == want and len(packed) == len(want)
    bins = {}
    for r in packed:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in bins.values():
        own.sort()
        assert own[0][0] == 0 and sum(own[-1]) <= 1024 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:], strict=False))
    assert len(bins) <= 1.05 * sum(r.length for r in packed) / 1024 + 1


def test_stages_keep_columns_and_odd_rows(spark, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        now = docs
        for name, stage in corpus_pipeline.STAGES[:-1]:
            now = stage(spark, now, FOLDER)
            assert now.columns == docs.columns, name
            assert now.count() <= docs.count()


def test_python_stages_take_small_batches(spark, odd_docs):
    for name, stage in corpus_pipeline.STAGES:
        if name in ("quality_classifier", "decontamination", "best_fit_packing"):
            stage(spark, odd_docs, FOLDER)
            assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "1m", name
