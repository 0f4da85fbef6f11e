"""Toxicity scores from the nearest labelled examples by TF-IDF cosine, found exactly with a block-max inverted index.

1. At most ``max_examples`` training rows of each label are the examples (smallest hashes of their ids, so the choice
   does not depend on partitions). Their class weights restore the shares that the labels have.
2. Terms are words and word beginnings of four to eight bytes, and each of them again as "at least twice" and "at least
   three times", as a cosine alone can't tell one use from many. The vectors are over all terms that go with label 1
   beyond chance in the examples, however many: a cosine over every word would find texts of the same subject, as a few
   insults weigh nothing beside a thousand other words. Document frequencies come from all documents.
3. The index lists each term's examples with weights, in blocks that know their largest weight. A query adds up the
   block maxima of its terms, reads the postings of the blocks with the highest bounds, and then of those blocks only
   that could still beat the k-th best cosine: the neighbours are exact. Terms of over one in ``often`` examples have no
   postings, since no block could be left out for them: a matrix product adds their part for many queries at once.
4. A vote is the share of label 1 among the neighbours, each counting as a power of its cosine, with the share of label 1
   among examples that have no term as the prior. The score is its calibration: a logistic curve fitted to the votes that
   each example gets from the others. The neighbours are the evidence.
5. Texts without a term look for their nearest examples by the cosine of all words, in a second index of the same kind
   over ``max_word_examples`` examples of each label. Their votes have a curve of their own, fitted on examples without a
   term; if these votes don't tell the label there, the prior stays the score.

Defined cases: null, empty and wordless texts get the prior; null labels and labels other than 0 and 1 are left out,
disagreeing ones count as the lower; of texts with one id the smallest is the example; without labels the score is 0.5;
repeated rows keep their rows; an empty table gives an empty result; other columns are left out. The score never sees labels, lang, source or the id.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from binfields.llm.common import WORD_BYTES, checkpoint, slices, text_bytes
from binfields.llm.quality import held_out


BEGINNINGS = range(4, 9)
REPEATS = (2, 3)

#: Bytes of text that are split into words at once.
SLICE_BYTES = 1 << 18

#: Keeps the first n of eight bytes.
MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def bases_of(word: bytes) -> tuple[bytes, ...]:
    """A word and its beginnings; those are marked, so that they differ from whole words."""
    return (word, *(b"^" + word[:n] for n in BEGINNINGS if len(word) >= n))


def repeated(base: bytes, n: int) -> bytes:
    """The term for n uses or more."""
    return b"%s#%d" % (base, n)


def terms_in(text: bytes) -> set[bytes]:
    counts = Counter(b for w in text.translate(WORD_BYTES).split() for b in bases_of(w))
    return {b if n == 1 else repeated(b, n) for b, c in counts.items() for n in (1, *REPEATS) if c >= n}


def uses_of(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different keys in ascending order, and how often each occurs."""
    keys = np.sort(keys)
    begins = np.flatnonzero(np.diff(keys, prepend=-1))
    return keys[begins], np.diff(begins, append=len(keys))


class Reader:
    """Uses of known terms and words in many texts at once, as rows (text, number, uses) by text and number."""

    def __init__(self, terms: list[bytes], words: list[bytes]) -> None:
        bases = sorted({t.split(b"#")[0] for t in terms})
        numbers = {t: k for k, t in enumerate(terms)}
        #: For each base the number of its term, and of those for repeats; -1 where there is none.
        self.term_of = np.array([[numbers.get(t, -1) for t in (b, *(repeated(b, n) for n in REPEATS))] for b in bases], np.int64).reshape(-1, 1 + len(REPEATS))
        base_of = {b: k for k, b in enumerate(bases)}
        word_of = {w: k for k, w in enumerate(words)}
        known = [*word_of, *(b for b in bases if not b.startswith(b"^") and b not in word_of)]
        #: A whole word's code is its place among the known ones, short ones first, by their keys; the last code is for words that are not known.
        short = [w for w in known if len(w) <= 16]
        blob = b" " * 8 + b" ".join([*short, b" " * 8])
        lengths = np.array([len(w) for w in short], np.int64)
        parts = self._ends(np.frombuffer(blob, np.uint8), 8 + np.cumsum(lengths + 1) - lengths - 1, lengths)
        keys = self._key(*parts, lengths)
        order = np.argsort(keys, kind="stable")
        self.keys, self.parts = keys[order], (*(x[order] for x in parts), lengths[order])
        # a key that two known words share (hardly ever) tells nothing: these are looked up as long words are
        shared = np.isin(self.keys, self.keys[1:][self.keys[1:] == self.keys[:-1]])
        known = [*(short[k] for k in order.tolist()), *(w for w in known if len(w) > 16)]
        self.long = {w: k for k, w in enumerate(known) if len(w) > 16 or shared[k]}
        self.shared_keys = self.keys[shared]
        self.word_of_code = np.array([*(word_of.get(w, -1) for w in known), -1], np.int64)
        self.base_of_code = np.array([*(base_of.get(w, -1) for w in known), -1], np.int64)
        self.n_words, self.n_bases, self.n_terms = max(len(words), 1), max(len(bases), 1), max(len(terms), 1)
        #: Beginnings of each length as numbers, which eight bytes fit into, and their bases.
        self.beginnings = []
        for n in BEGINNINGS:
            pairs = sorted((int.from_bytes(b[1:], "little"), k) for b, k in base_of.items() if b.startswith(b"^") and len(b) == n + 1)
            self.beginnings.append((n, np.array([x for x, _ in pairs], np.uint64), np.array([k for _, k in pairs], np.int64)))
        #: Which hashes of four bytes a beginning has; most words end here.
        self.heads = np.zeros(1 << 16, bool)
        for _, keys, _ in self.beginnings:
            self.heads[self._hash(keys)] = True

    @staticmethod
    def _hash(keys: np.ndarray) -> np.ndarray:
        return (((keys & np.uint64(0xFFFFFFFF)) * np.uint64(2654435761)) >> np.uint64(16)) & np.uint64(0xFFFF)

    @staticmethod
    def _ends(letters: np.ndarray, begins: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first eight bytes of words (fewer, if they have fewer) and the last eight (0, if they have no more than eight) as numbers; eight bytes stand before and behind all words."""
        eight = np.lib.stride_tricks.sliding_window_view(letters, 8)
        first = eight[begins].view("<u8").ravel() & MASKS[np.minimum(lengths, 8)]
        last = np.zeros(len(begins), np.uint64)
        more = np.flatnonzero(lengths > 8)
        last[more] = eight[begins[more] + lengths[more] - 8].view("<u8").ravel()
        return first, last

    @staticmethod
    def _key(first: np.ndarray, last: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        return first * np.uint64(0x9E3779B97F4A7C15) + last * np.uint64(0xC2B2AE3D27D4EB4F) + lengths.astype(np.uint64)

    def _codes(self, blob: bytes, begins: np.ndarray, lengths: np.ndarray, ends: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """Codes of whole words. Both ends and the length tell a word of up to 16 bytes; longer ones are looked up one by one."""
        out = np.full(len(begins), len(self.word_of_code) - 1)
        long = lengths > 16
        if len(self.keys):
            keys = self._key(*ends, lengths)
            place = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            same = np.flatnonzero((self.keys[place] == keys) & ~long)
            at = place[same]
            for mine, theirs in zip((*ends, lengths), self.parts, strict=True):
                kept = mine[same] == theirs[at]
                same, at = same[kept], at[kept]
            out[same] = at
            if len(self.shared_keys):
                long |= np.isin(keys, self.shared_keys)
        if self.long:
            at = np.flatnonzero(long)
            for k, begin, size in zip(at.tolist(), begins[at].tolist(), lengths[at].tolist(), strict=True):
                out[k] = self.long.get(blob[begin : begin + size], len(self.word_of_code) - 1)
        return out

    def read(self, texts: list[bytes]) -> tuple[tuple[np.ndarray, ...], tuple[np.ndarray, ...]]:
        """Rows of terms and rows of words; the terms for repeats count once."""
        blob = b" ".join([b" " * 7, *texts, b" " * 8]).translate(WORD_BYTES)
        text_at = 8 + np.cumsum([0, *(len(t) + 1 for t in texts)])
        letters = np.frombuffer(blob, np.uint8)
        edges = np.flatnonzero(np.diff(letters != 0x20, prepend=False))
        begins, lengths = edges[::2], edges[1::2] - edges[::2]
        of = np.repeat(np.arange(len(texts)), np.diff(np.searchsorted(begins, text_at)))
        ends = self._ends(letters, begins, lengths)
        codes = self._codes(blob, begins, lengths, ends)
        return self._terms(of, codes, ends[0], lengths), self._words(of, codes)

    def _words(self, of: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, ...]:
        numbers = self.word_of_code[codes]
        known = numbers >= 0
        keys, uses = uses_of(of[known] * self.n_words + numbers[known])
        return keys // self.n_words, keys % self.n_words, uses

    def _terms(self, of: np.ndarray, codes: np.ndarray, first: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, ...]:
        whole = np.flatnonzero(self.base_of_code[codes] >= 0)
        found = [of[whole] * self.n_bases + self.base_of_code[codes[whole]]]
        near = np.flatnonzero(self.heads[self._hash(first)])
        first, of, lengths = first[near], of[near], lengths[near]
        for n, keys, bases in self.beginnings:
            if len(keys):
                own = first & MASKS[n]
                place = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
                mine = (keys[place] == own) & (lengths >= n)
                found.append(of[mine] * self.n_bases + bases[place[mine]])
        keys, uses = uses_of(np.concatenate(found))
        of, numbers = keys // self.n_bases, self.term_of[keys % self.n_bases]
        rows = [(of, numbers[:, 0], uses)]
        for k, least in enumerate(REPEATS, 1):
            often = uses >= least
            rows.append((of[often], numbers[often, k], np.ones(int(often.sum()), np.int64)))
        of, numbers, uses = (np.concatenate(c) for c in zip(*rows, strict=True))
        known = numbers >= 0
        of, numbers, uses = of[known], numbers[known], uses[known]
        order = np.argsort(of * self.n_terms + numbers)
        return of[order], numbers[order], uses[order]


def sliced(column: pa.Array) -> Iterator[list[bytes]]:
    """The texts of a column in lists of ``SLICE_BYTES`` at most; a longer text stands alone."""
    texts = list(text_bytes(column))
    for begin, end in slices(len(texts), np.cumsum([0, *map(len, texts)]), SLICE_BYTES):
        yield texts[begin:end]


class BlockMaxIndex:
    """Unit TF-IDF vectors of examples as inverted lists in blocks, with the largest weight of each term and block."""

    #: Blocks that a query visits before it knows a threshold.
    first_blocks = 8
    #: Terms of over one in so many examples are kept as columns of a matrix.
    often = 16
    #: Queries that are answered at once have so many cosines together.
    cells = 1 << 18

    def __init__(self, vectors: list[tuple[int, int, dict[int, int]]], idf: np.ndarray, block: int = 64) -> None:
        weighted = [(ident, label, self.weights(counts, idf)) for ident, label, counts in vectors if counts]
        # examples with the same heaviest term stand together, which makes block maxima tell more
        weighted.sort(key=lambda v: (v[2][0][int(np.argmax(v[2][1]))], v[0]))
        self.idf, self.block = idf, block
        self.ids = np.array([v[0] for v in weighted])
        self.labels = np.array([v[1] for v in weighted], np.int64)
        self.n = len(weighted)
        blocks = max(1, -(-self.n // block))
        terms = np.concatenate([v[2][0] for v in weighted]) if weighted else np.zeros(0, np.int64)
        owners = np.repeat(np.arange(self.n), [len(v[2][0]) for v in weighted])
        weights = np.concatenate([v[2][1] for v in weighted]) if weighted else np.zeros(0)
        frequent = np.flatnonzero(np.bincount(terms, minlength=len(idf)) * self.often > self.n)
        self.column = np.full(len(idf), -1)
        self.column[frequent] = np.arange(len(frequent))
        self.panel = np.zeros((self.n, len(frequent)))
        listed = self.column[terms] < 0
        self.panel[owners[~listed], self.column[terms[~listed]]] = weights[~listed]
        terms, owners, weights = terms[listed], owners[listed], weights[listed]
        order = np.lexsort((owners, terms))
        self.owners, self.postings, self.blocks = owners[order], weights[order], blocks
        # only blocks that a term occurs in are kept: where their postings begin, and their largest weight
        keys = terms[order] * blocks + self.owners // block
        begins = np.flatnonzero(np.diff(keys, prepend=-1))
        self.begins, self.sizes = begins, np.diff(begins, append=len(keys))
        self.maxima = np.maximum.reduceat(self.postings, begins) if len(begins) else np.zeros(0)
        self.block_of = keys[begins] % blocks
        self.starts = np.searchsorted(keys[begins] // blocks, np.arange(len(idf) + 1))

    @staticmethod
    def weights(counts: dict[int, int], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        terms = np.array(sorted(counts), np.int64)
        raw = (1 + np.log([counts[t] for t in terms.tolist()])) * idf[terms]
        return terms, raw / np.sqrt((raw**2).sum())

    def nearest(self, counts: dict[int, int], k: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and cosines of the k nearest examples with a positive cosine; ties go to the smaller place."""
        terms = np.array(sorted(counts), np.int64)
        return self.search(np.zeros(len(terms), np.int64), terms, np.array([counts[t] for t in terms.tolist()], np.int64), 1, k)[1:]

    def search(self, of: np.ndarray, terms: np.ndarray, uses: np.ndarray, queries: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``nearest`` for many queries, given as rows (query, term, uses) by query and term: numbers of queries, places and cosines.

        A query's result does not depend on those beside it, to the last bit.
        """
        raw = (1 + np.log(uses)) * self.idf[terms]
        weights = raw / np.sqrt(np.bincount(of, weights=raw**2, minlength=queries))[of]
        step = max(1, self.cells // max(self.n, 1))
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        for begin in range(0, queries if self.n else 0, step):
            a, b = np.searchsorted(of, (begin, begin + step))
            if a < b:
                own, places, cosines = self._search(of[a:b] - begin, terms[a:b], weights[a:b], min(step, queries - begin), k)
                found.append((own + begin, places, cosines))
        return tuple(np.concatenate(c) for c in zip(*found, strict=True))

    def _search(self, of: np.ndarray, terms: np.ndarray, weights: np.ndarray, queries: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        column = self.column[terms]
        frequent = column >= 0
        f_of, f_column, f_weights = of[frequent], column[frequent], weights[frequent]
        table = np.zeros((queries, self.panel.shape[1]))
        table[f_of, f_column] = f_weights
        part = table @ self.panel.T
        of, terms, weights = of[~frequent], terms[~frequent], weights[~frequent]
        n = self.starts[terms + 1] - self.starts[terms]
        parts = np.repeat(self.starts[terms] - np.cumsum(n) + n, n) + np.arange(n.sum())
        rows = np.repeat(of, n), parts, np.repeat(weights, n)
        listed = np.bincount(rows[0] * self.blocks + self.block_of[parts], weights=self.maxima[parts] * rows[2], minlength=queries * self.blocks).reshape(queries, self.blocks)
        bounds = np.maximum.reduceat(part, np.arange(0, self.n, self.block), axis=1) + listed
        # the blocks with the highest bounds first; then all that could still beat the k-th best of those
        best = np.argsort(-bounds, axis=1, kind="stable")[:, : self.first_blocks]
        first = np.zeros(bounds.shape, bool)
        np.put_along_axis(first, best, True, axis=1)
        first &= listed > 0
        sums = np.zeros(queries * self.n)
        self._read(rows, queries, np.flatnonzero(first), sums)
        scores = part + sums.reshape(part.shape)
        least = self._least(scores, k)
        # a matrix product may round in any order: by far less than 1e-12
        rest = np.flatnonzero((listed > 0) & ~first & (bounds >= least - 2e-12))
        if len(rest):
            self._read(rows, queries, rest, sums)
            scores = part + sums.reshape(part.shape)
            least = self._least(scores, k)
        own, places = np.nonzero((scores > 0) & (scores >= least - 2e-12))
        # what these have of the frequent terms is added up again, term by term
        cosines = sums[own * self.n + places]
        begins = np.searchsorted(f_of, np.arange(queries + 1))
        sizes = np.diff(begins)[own]
        step = max(1, self.cells // max(1, int(sizes.max(initial=0))))
        for a in range(0, len(own), step):
            size = sizes[a : a + step]
            at = np.repeat(begins[own[a : a + step]] - np.cumsum(size) + size, size) + np.arange(size.sum())
            pair = np.repeat(np.arange(len(size)), size)
            cosines[a : a + step] += np.bincount(pair, weights=f_weights[at] * self.panel[places[a + pair], f_column[at]], minlength=len(size))
        order = np.lexsort((places, -np.round(cosines, 12), own))
        own, places, cosines = own[order], places[order], cosines[order]
        kept = np.arange(len(own)) - np.searchsorted(own, own) < k
        return own[kept], places[kept], cosines[kept]

    @staticmethod
    def _least(scores: np.ndarray, k: int) -> np.ndarray:
        """The k-th best score of each query, as a column; 0 if there are fewer."""
        n = scores.shape[1]
        if n < k:
            return np.zeros((len(scores), 1))
        # many equal zeros would slow the partition down
        spread = np.where(scores > 0, scores, -np.arange(n, dtype=np.float64))
        return np.maximum(np.partition(spread, n - k, axis=1)[:, n - k, None], 0)

    def _read(self, rows: tuple[np.ndarray, ...], queries: int, cells: np.ndarray, sums: np.ndarray) -> None:
        """Adds the postings of some cells (a query's block each) to ``sums``; only those are read."""
        of, parts, shares = rows
        wanted = np.zeros(queries * self.blocks, bool)
        wanted[cells] = True
        mine = wanted[of * self.blocks + self.block_of[parts]]
        of, parts, shares = of[mine], parts[mine], shares[mine]
        sizes = self.sizes[parts]
        at = np.repeat(self.begins[parts] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        sums += np.bincount(np.repeat(of * self.n, sizes) + self.owners[at], weights=self.postings[at] * np.repeat(shares, sizes), minlength=len(sums))

class Voter:
    """Votes of the nearest examples, and their calibration."""

    def __init__(self, terms: list[bytes], index: BlockMaxIndex, weight: list[float], prior: float, neighbours: int, prior_weight: float, sharpness: float) -> None:
        self.terms, self.index, self.weight, self.prior = terms, index, weight, prior
        self.neighbours, self.prior_weight, self.sharpness = neighbours, prior_weight, sharpness
        self.curve = (0.0, 1.0)

    def votes(self, of: np.ndarray, terms: np.ndarray, uses: np.ndarray, texts: int, but: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
        """Share of label 1 for each text, and rows (text, place, cosine) of the neighbours; ``but`` has an example's id for each text, to leave out."""
        own, places, cosines = self.index.search(of, terms, uses, texts, self.neighbours + (but is not None))
        if but is not None and len(own):
            other = self.index.ids[places] != but[own]
            own, places, cosines = own[other], places[other], cosines[other]
            kept = np.arange(len(own)) - np.searchsorted(own, own) < self.neighbours
            own, places, cosines = own[kept], places[kept], cosines[kept]
        ones = self.index.labels[places] == 1
        votes = cosines**self.sharpness * np.where(ones, self.weight[1], self.weight[0])
        for_one, all_, near = (np.bincount(own, weights=x, minlength=texts) for x in (votes * ones, votes, cosines))
        scale = self.prior_weight * (all_ / np.maximum(near, 1e-12))
        shares = (for_one + scale * self.prior) / np.maximum(all_ + scale, 1e-12)
        return np.where(near > 0, shares, self.prior), own, places, cosines

    @staticmethod
    def _odds(shares: np.ndarray) -> np.ndarray:
        return np.log((shares + 0.01) / (1.01 - shares))

    def calibrate(self, shares: np.ndarray, labels: np.ndarray) -> bool:
        """Fits the logistic curve by Newton steps and tells whether it did; a falling curve or a single label keeps the shares as they are."""
        if len(set(labels.tolist())) < 2:
            return False
        x = np.stack([np.ones(len(shares)), self._odds(shares)], 1)
        w, out = np.where(labels == 1, self.weight[1], self.weight[0]), np.array([0.0, 1.0])
        ridge = np.diag([1e-3, 1e-3])
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ out, -30, 30)))
            step = np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + ridge, x.T @ (w * (labels - p)) - ridge @ (out - [0.0, 1.0]))
            out = out + np.clip(step, -2, 2)
        if np.isfinite(out).all() and out[1] > 0:
            self.curve = (float(out[0]), float(out[1]))
        return self.curve != (0.0, 1.0)

    def score(self, shares: np.ndarray) -> np.ndarray:
        if self.curve == (0.0, 1.0):
            return shares
        return 1 / (1 + np.exp(-np.clip(self.curve[0] + self.curve[1] * self._odds(shares), -30, 30)))


def _select_terms(examples: DataFrame, least: int, evidence: float, lift: float) -> list[bytes]:
    """Terms of examples (text, label) that go with label 1: ``lift`` times as often, by a log-likelihood ratio over ``evidence``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = (Counter(), Counter())
            for text, label in zip(text_bytes(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                both[label].update(terms_in(text))
            names = list(both[0] | both[1])
            yield pa.RecordBatch.from_pydict({"term": names, "n0": [both[0][t] for t in names], "n1": [both[1][t] for t in names]}, schema=arrow)

    arrow = pa.schema([("term", pa.binary()), ("n0", pa.int64()), ("n1", pa.int64())])
    size = {r["label"]: r["n"] for r in examples.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if not size.get(0) or not size.get(1):
        return []
    n0, n1 = float(size[0]), float(size[1])
    a, b = F.col("n1").cast("double"), F.col("n0").cast("double")

    def part(x, of, share):
        return F.when(x > 0, x * F.log(x / (of * share))).otherwise(F.lit(0.0))

    seen = (a + b) / (n0 + n1)
    ratio = 2 * (part(a, F.lit(n1), seen) + part(b, F.lit(n0), seen) + part(n1 - a, F.lit(n1), 1 - seen) + part(n0 - b, F.lit(n0), 1 - seen))
    counted = examples.select("text", "label").mapInArrow(count, "term binary, n0 long, n1 long").groupBy("term").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    chosen = counted.filter(F.col("n1") >= least).withColumn("ratio", ratio).filter((a / n1 >= lift * b / n0) & (F.col("ratio") > evidence))
    return sorted(bytes(r["term"]) for r in chosen.select("term").collect())  # terms of 2 * max_examples texts


def _shared_words(examples: DataFrame) -> list[bytes]:
    """Words of two examples (text) at least; one example's own words can't bring another text nearer."""

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            uses = Counter(w for text in text_bytes(batch.column(0)) for w in set(text.translate(WORD_BYTES).split()))
            yield pa.RecordBatch.from_pydict({"word": pa.array(list(uses), pa.binary()), "n": pa.array(list(uses.values()), pa.int64())})

    counted = examples.select("text").mapInArrow(words, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return sorted(bytes(r["word"]) for r in counted.filter("n > 1").collect())  # words of 2 * max_word_examples texts


def _document_frequencies(docs: DataFrame, terms: list[bytes], words: list[bytes]) -> tuple[int, np.ndarray, np.ndarray]:
    """Number of documents, and of those with each term and each word, over all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, total = Reader(terms, words), np.zeros(len(terms) + len(words) + 1, np.int64)
        for batch in batches:
            for texts in sliced(batch.column(0)):
                total[-1] += len(texts)
                (_, own, _), (_, plain, _) = reader.read(texts)
                total[: len(terms)] += np.bincount(own, minlength=len(terms))
                total[len(terms) : -1] += np.bincount(plain, minlength=len(words))
        yield pa.RecordBatch.from_pydict({"place": np.arange(len(total)), "n": total})

    out = np.zeros(len(terms) + len(words) + 1, np.int64)
    for row in docs.select("text").mapInArrow(count, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).collect():
        out[row["place"]] = row["n"]
    return int(out[-1]), out[: len(terms)], out[len(terms) : -1]


def score_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    *,
    label_column: str = "toxic",
    id_column: str = "doc_id",
    text_column: str = "text",
    folds: int = 3,
    held_out_fold: int = 1,
    threshold: float = 0.7,
    neighbours: int = 15,
    max_examples: int = 4000,
    max_word_examples: int = 1000,
    prior_weight: float = 0.3,
    sharpness: float = 4.0,
) -> DataFrame:
    """id, held_out, score (0 to 1, higher: label 1 likelier), predicted (score >= threshold), evidence and similar (example ids and cosines): the neighbours by terms, and by all words where there is no term."""
    context = docs.sparkSession.sparkContext
    texts = docs.select(F.col(id_column), F.col(text_column).alias("text"))
    out = held_out(F.col(id_column), folds, held_out_fold)
    known = labels.filter(F.col(label_column).isin(0, 1) & F.col(id_column).isNotNull()).groupBy(id_column).agg(F.min(label_column).cast("int").alias("label")).filter(~out)
    sizes = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    picked = [known.filter(F.col("label") == k).orderBy(F.xxhash64(id_column), id_column).limit(max_examples) for k in (0, 1)]
    chosen = F.broadcast(picked[0].unionByName(picked[1]))  # 2 * max_examples rows of two numbers
    examples = checkpoint(texts.join(chosen, id_column).groupBy(id_column, "label").agg(F.min("text").alias("text")))
    terms = _select_terms(examples, least=3, evidence=20.0, lift=3.0)
    fewer = [known.filter(F.col("label") == k).orderBy(F.xxhash64(id_column), id_column).limit(max_word_examples) for k in (0, 1)]
    in_words = F.broadcast(fewer[0].unionByName(fewer[1]).select(id_column, F.lit(True).alias("plain")))
    examples = checkpoint(examples.join(in_words, id_column, "left").withColumn("plain", F.coalesce("plain", F.lit(False))))
    words = _shared_words(examples.filter("plain"))
    total, frequency, word_frequency = _document_frequencies(texts, terms, words)
    idf, word_idf = (np.log((total + 1) / (n + 1)) + 1 if len(n) else np.zeros(0) for n in (frequency, word_frequency))

    def vectors_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(terms, words)
        for batch in batches:
            plain, begin = np.array(batch.column(3).to_pylist(), bool), 0
            for texts in sliced(batch.column(2)):
                lists = []
                for of, numbers, uses in reader.read(texts):
                    if lists:  # words of these examples only
                        mine = plain[begin + of]
                        of, numbers, uses = of[mine], numbers[mine], uses[mine]
                    cuts = np.searchsorted(of, np.arange(len(texts) + 1)).astype(np.int32)
                    lists += [pa.ListArray.from_arrays(cuts, values.astype(np.int32)) for values in (numbers, uses)]
                some = batch.slice(begin, len(texts))
                begin += len(texts)
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), *lists, some.column(3)], names=["id", "label", "terms", "uses", "words", "word_uses", "plain"])

    arrays = (T.StructField(n, T.ArrayType(T.IntegerType())) for n in ("terms", "uses", "words", "word_uses"))
    made = T.StructType([T.StructField("id", docs.schema[id_column].dataType), T.StructField("label", T.IntegerType()), *arrays, T.StructField("plain", T.BooleanType())])
    vectors = checkpoint(examples.select(id_column, "label", "text", "plain").mapInArrow(vectors_of, made))
    drawn = vectors.collect()  # 2 * max_examples vectors
    rows = [(r["id"], r["label"], dict(zip(r["terms"], r["uses"], strict=True))) for r in drawn]
    by_words = [(r["id"], r["label"], dict(zip(r["words"], r["word_uses"], strict=True))) for r in drawn if r["plain"]]
    # an example stands for this many labelled rows
    count, bare = ([sum(y == k and (every or not c) for _, y, c in rows) for k in (0, 1)] for every in (True, False))
    weight = [sizes.get(k, 0) / max(count[k], 1) for k in (0, 1)]
    without = [bare[k] * weight[k] for k in (0, 1)]
    prior = (without[1] + 0.5) / (sum(without) + 1)
    voter = Voter(terms, BlockMaxIndex([r for r in rows if r[2]], idf), weight, prior, neighbours, prior_weight, sharpness)
    # where a text has no term, the nearest by all words tell what they can
    of_label = [sum(y == k for _, y, _ in by_words) for k in (0, 1)]
    word_voter = Voter(words, BlockMaxIndex([r for r in by_words if r[2]], word_idf), [sizes.get(k, 0) / max(of_label[k], 1) for k in (0, 1)], prior, neighbours, prior_weight, sharpness)
    uncalibrated = context.broadcast((voter, word_voter))  # max_examples bounds it

    def left_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by_term, by_word = uncalibrated.value
            n, but = batch.num_rows, np.array(batch.column(0).to_pylist())

            def rows(numbers: pa.Array, uses: pa.Array) -> tuple[np.ndarray, ...]:
                return np.repeat(np.arange(n), numbers.value_lengths()), *(c.flatten().to_numpy().astype(np.int64) for c in (numbers, uses))

            shares = by_term.votes(*rows(batch.column(2), batch.column(3)), n, but)[0]
            bare = np.array(batch.column(6).to_pylist(), bool) & (batch.column(2).value_lengths().to_numpy() == 0)
            of, numbers, uses = rows(batch.column(4), batch.column(5))
            mine = bare[of]
            word_shares = pa.array(by_word.votes(of[mine], numbers[mine], uses[mine], n, but)[0], pa.float64(), mask=~bare)
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(shares, pa.float64()), word_shares], names=["label", "share", "word_share"])

    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    told_by_others = vectors.repartition(tasks, "id").mapInArrow(left_out, "label int, share double, word_share double").collect()  # 2 * max_examples
    voter.calibrate(np.array([r["share"] for r in told_by_others]), np.array([r["label"] for r in told_by_others]))
    without_term = [r for r in told_by_others if r["word_share"] is not None]
    # by all words a vote counts only as far as votes among examples without a term have told their label
    informed = word_voter.calibrate(np.array([r["word_share"] for r in without_term]), np.array([r["label"] for r in without_term]))
    shared = context.broadcast((voter, word_voter, informed))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, other, informed = shared.value
        reader = Reader(own.terms, other.terms)
        names = [pa.array([str(i) for i in v.index.ids], pa.string()) for v in (own, other)]

        def told(which: int, n: int, of: np.ndarray, places: np.ndarray, cosines: np.ndarray) -> pa.Array:
            labels = (own, other)[which].index.labels[places].astype(np.int32)
            columns = [names[which].take(pa.array(places)), pa.array(labels), pa.array(cosines)]
            return pa.ListArray.from_arrays(np.searchsorted(of, np.arange(n + 1)).astype(np.int32), pa.StructArray.from_arrays(columns, fields=list(kind.value_type)))

        for batch in batches:
            begin = 0
            for texts in sliced(batch.column(1)):
                n = len(texts)
                terms, words = reader.read(texts)
                shares, *near = own.votes(*terms, n)
                scores = own.score(shares)
                bare = np.bincount(terms[0], minlength=n) == 0
                mine = bare[words[0]]
                word_shares, *by_word = other.votes(*(c[mine] for c in words), n)
                if informed:
                    scores = np.where(bare & (np.bincount(by_word[0], minlength=n) > 0), other.score(word_shares), scores)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, n), pa.array(scores, pa.float64()), told(0, n, *near), told(1, n, *by_word)], names=[id_column, "score", "evidence", "similar"])
                begin += n

    kind = pa.list_(pa.struct([("id", pa.string()), ("label", pa.int32()), ("cosine", pa.float64())]))
    neighbours_told = T.ArrayType(T.StructType([T.StructField("id", T.StringType()), T.StructField("label", T.IntegerType()), T.StructField("cosine", T.DoubleType())]))
    schema = T.StructType([docs.schema[id_column], T.StructField("score", T.DoubleType()), T.StructField("evidence", neighbours_told), T.StructField("similar", neighbours_told)])
    scored = texts.mapInArrow(score, schema)
    return scored.select(id_column, out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "evidence", "similar")
