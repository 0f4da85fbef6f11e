"""Quality scores by regularised quadratic discriminant analysis over document statistics.

1. Tasks turn each whole text into a short vector of transformed statistics.
2. Class counts, sums and cross products of the labelled training rows are summed by Spark, over all of them: what
   reaches the driver is a fixed number of sums, whatever the input.
3. Class covariances are shrunk, and their Cholesky factors are computed once and sent with the scoring tasks.
4. The score is the posterior from the difference of the two Mahalanobis log densities.

Defined cases: null and empty texts have the vector of an empty text and get a score like any other; labels that are
null or not 0 or 1 are left out, labels that disagree on an id count as the lower one; with fewer than two training rows in a class the score
is the share of label 1 (0.5 without labels); repeated rows keep their rows; an empty table gives an empty result;
other columns are left out. The score never sees labels, lang, source or the id.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from binfields.llm.common import checkpoint, slices, text_view

#: Kinds of bytes: blank, line end, digit, upper case, lower case or beyond ASCII, sentence mark, exclamation, other sign.
_BLANK, _LINE, _DIGIT, _UPPER, _LOWER, _MARK, _LOUD, _SIGN = range(8)
_KIND = np.full(256, _SIGN, np.int64)
_KIND[:33] = _BLANK
_KIND[10] = _LINE
_KIND[48:58] = _DIGIT
_KIND[65:91] = _UPPER
_KIND[97:123] = _LOWER
_KIND[128:] = _LOWER
_KIND[[ord(c) for c in ".,;:'\"-()?"]] = _MARK
_KIND[ord("!")] = _LOUD

FEATURES = ("words", "word_length", "upper", "digits", "marks", "loud", "signs", "lines", "variety", "top_word", "stutter", "sentence")


def _word_statistics(text: bytes) -> tuple[int, int, int, int, int]:
    """Words, different words, uses of the most frequent one, words that repeat the one before, full stops at a word's end."""
    words = text.split()
    n = len(words)
    if not n:
        return 0, 0, 0, 0, 0
    counts = Counter(words)
    stutter = sum(map(bytes.__eq__, words[1:], words)) if len(counts) < 0.9 * n else 0
    return n, len(counts), max(counts.values()), stutter, text.count(b". ") + text.count(b".\n") + text.endswith(b".")


#: Bytes of texts whose kinds are counted at once; numpy takes some thirty times as much meanwhile, and workers don't give it back.
SLICE_BYTES = 1 << 18


def features(offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
    """One row of transformed statistics for each text."""
    n = len(offsets) - 1
    out = np.empty((n, len(FEATURES)))
    for begin, end in slices(n, offsets, SLICE_BYTES):
        at = offsets[begin : end + 1]
        own = data[at[0] : at[-1]]
        sizes = np.diff(at)
        kinds = np.bincount(np.repeat(np.arange(end - begin) * 8, sizes) + _KIND[own], minlength=8 * (end - begin)).reshape(-1, 8).astype(float)
        whole, edges = own.tobytes(), (at - at[0]).tolist()
        words = np.array([_word_statistics(whole[a:b]) for a, b in zip(edges, edges[1:], strict=False)], float).reshape(-1, 5)
        count, different, top, stutter, stops = words.T
        # shares of a short text say little: each is taken as if some plain text stood beside it
        some, size = count + 20, sizes + 120
        visible = sizes - kinds[:, _BLANK] - kinds[:, _LINE]
        letters = kinds[:, _UPPER] + kinds[:, _LOWER] + 100
        out[begin:end] = np.stack(
            [
                np.log1p(count),
                np.log1p((np.maximum(visible, 0) + 100) / some),
                np.sqrt(kinds[:, _UPPER] / letters),
                np.sqrt(kinds[:, _DIGIT] / size),
                np.sqrt(kinds[:, _MARK] / size),
                np.sqrt(kinds[:, _LOUD] / size),
                np.sqrt(kinds[:, _SIGN] / size),
                np.sqrt(kinds[:, _LINE] / some),
                np.log(different + 20) / np.log(some),
                np.sqrt(np.maximum(top - 1, 0) / some),
                np.sqrt(stutter / some),
                np.sqrt(stops / some),
            ],
            axis=1,
        )
    return out


def document_features(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", keep_text: bool = False) -> DataFrame:
    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = features(*text_view(batch.column(1)))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * len(FEATURES)), pa.array(rows.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=[id_column, "features"])

    schema = T.StructType([docs.schema[id_column], T.StructField("features", T.ArrayType(T.DoubleType()))])
    return docs.select(id_column, text_column).mapInArrow(compute, schema)


def held_out(id_column: Column, folds: int, fold: int) -> Column:
    """crc32 of the id as text, modulo ``folds``, is ``fold``; rows without an id are not held out."""
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % folds == fold, F.lit(False))


@dataclass
class QuadraticDiscriminant:
    """Means, Cholesky factors of the shrunk class covariances and the log prior odds; None factors: only a share."""

    share: float
    center: np.ndarray | None = None
    scale: np.ndarray | None = None
    means: tuple[np.ndarray, np.ndarray] | None = None
    factors: tuple[np.ndarray, np.ndarray] | None = None
    #: Log densities of many statistics overstate the evidence, as statistics depend on each other; the odds are damped.
    damping: float = 0.5

    @classmethod
    def from_sums(cls, n: np.ndarray, sums: np.ndarray, products: np.ndarray, shrinkage: float) -> QuadraticDiscriminant:
        share = float(n[1] / n.sum()) if n.sum() else 0.5
        if n.min() < 2:
            return cls(share)
        d = sums.shape[1]
        center = sums.sum(0) / n.sum()
        scale = np.sqrt(np.maximum(np.diag(products.sum(0)) / n.sum() - center**2, 1e-8))
        means, factors = [], []
        for k in (0, 1):
            mean = sums[k] / n[k]
            covariance = (products[k] / n[k] - np.outer(mean, mean)) / np.outer(scale, scale)
            covariance = (covariance + covariance.T) / 2
            target = np.eye(d) * max(np.trace(covariance) / d, 1e-3)
            means.append((mean - center) / scale)
            factors.append(np.linalg.cholesky((1 - shrinkage) * covariance + shrinkage * target + 1e-6 * np.eye(d)))
        return cls(share, center, scale, tuple(means), tuple(factors))

    def score(self, rows: np.ndarray) -> np.ndarray:
        if self.factors is None:
            return np.full(len(rows), self.share)
        x = (rows - self.center) / self.scale
        density = []
        for mean, factor in zip(self.means, self.factors, strict=True):
            inside = np.linalg.solve(factor, (x - mean).T)
            density.append(-0.5 * (inside**2).sum(0) - np.log(np.diag(factor)).sum())
        odds = np.log(self.share / (1 - self.share)) + self.damping * (density[1] - density[0])
        return 1 / (1 + np.exp(-np.clip(odds, -50, 50)))


def _class_sums(rows: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Count, sums and cross products for labels 0 and 1 of rows (label, features)."""
    d = len(FEATURES)
    width = 1 + d + d * d

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, width))
        for batch in batches:
            labels = batch.column(0).to_numpy()
            x = batch.column(1).flatten().to_numpy().reshape(-1, d)
            for k in (0, 1):
                own = x[labels == k]
                total[k] += np.concatenate([[len(own)], own.sum(0), (own.T @ own).ravel()])
        yield pa.RecordBatch.from_pydict({"place": np.arange(2 * width), "x": total.ravel()})

    out = np.zeros(2 * width)
    for row in rows.mapInArrow(add, "place long, x double").groupBy("place").agg(F.sum("x").alias("x")).collect():
        out[row["place"]] = row["x"]
    out = out.reshape(2, width)
    return out[:, 0], out[:, 1 : 1 + d], out[:, 1 + d :].reshape(2, d, d)


def fit_quality(
    docs: DataFrame,
    labels: DataFrame,
    *,
    label_column: str = "quality",
    id_column: str = "doc_id",
    text_column: str = "text",
    folds: int = 5,
    held_out_fold: int = 0,
    shrinkage: float = 0.05,
) -> tuple[DataFrame, QuadraticDiscriminant]:
    """The statistics of all documents (id, features) and the model of the labelled ones that are not held out."""
    described = checkpoint(document_features(docs, id_column=id_column, text_column=text_column))
    known = labels.filter(F.col(label_column).isin(0, 1) & F.col(id_column).isNotNull()).groupBy(id_column).agg(F.min(label_column).cast("int").alias("label"))
    training = described.filter(~held_out(F.col(id_column), folds, held_out_fold)).join(known, id_column).select("label", "features")
    return described, QuadraticDiscriminant.from_sums(*_class_sums(training), shrinkage)


def score_quality(
    docs: DataFrame, labels: DataFrame, *, threshold: float = 0.3, id_column: str = "doc_id", folds: int = 5, held_out_fold: int = 0, **options
) -> DataFrame:
    """id, held_out, score (0 to 1, higher: label 1 likelier), predicted (score >= threshold), features; options as in ``fit_quality``."""
    described, model = fit_quality(docs, labels, id_column=id_column, folds=folds, held_out_fold=held_out_fold, **options)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(1).flatten().to_numpy().reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.score(rows))], names=[*batch.schema.names, "score"])

    schema = T.StructType([*described.schema.fields, T.StructField("score", T.DoubleType())])
    scored = described.mapInArrow(score, schema)
    out = held_out(F.col(id_column), folds, held_out_fold)
    return scored.select(id_column, out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "features")


def keep_good(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.3, text_column: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, all columns, that score ``threshold`` or more. Texts are not shuffled."""
    _, model = fit_quality(docs, labels, text_column=text_column, **options)
    place = docs.columns.index(text_column)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(model.score(features(*text_view(batch.column(place)))) >= threshold))

    return docs.mapInArrow(keep, docs.schema)
