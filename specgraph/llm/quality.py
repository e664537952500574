"""Quality scores by regularised quadratic discriminant analysis over document statistics."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, SPACE, Rolling, bytes_of, in_small_batches, lean, slices, written

NAMES = ("log_bytes", "log_words", "word_bytes", "upper", "symbols", "bars", "shouts", "digits", "new_lines", "stops", "distinct", "repeats", "top_word", "symbol_words")
#: Weight of the diagonal in each class covariance, and of what both classes share.
TO_DIAGONAL, TO_POOLED = 0.1, 0.05
_IS = lambda chars: np.isin(np.arange(256), np.frombuffer(chars, np.uint8))
_UPPER, _SYMBOL, _BAR, _SHOUT, _DIGIT, _STOP = _IS(bytes(range(65, 91))), _IS(b"#$%&*@^~<>{}[]\\=_+"), _IS(b"|"), _IS(b"!?"), _IS(b"0123456789"), _IS(b".,;:")
#: Shares of short texts are drawn towards a middling one, as if so many characters or words more had it; so little weighs what they have by chance.
_CHARS, _WORDS, _SMALL = 150, 40, 0.02


def statistics(data: np.ndarray, offsets: np.ndarray, rolling: Rolling) -> np.ndarray:
    """A row of NAMES for each document; shares are smoothed, and taken as log(share + 0.02)."""
    n, rows = len(data), len(offsets) - 1
    out = np.zeros((rows, len(NAMES)))
    size = np.diff(offsets)

    def per_row(flags: np.ndarray) -> np.ndarray:
        sums = np.zeros(n + 1, np.int64)
        np.cumsum(flags, out=sums[1:])
        return sums[offsets[1:]] - sums[offsets[:-1]]

    inside = ~SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    first, last = inside.copy(), inside.copy()
    if n:
        first[1:] &= ~inside[:-1] | edge[1:-1]
        last[:-1] &= ~inside[1:] | edge[1:-1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    rolling.load(data, Rolling.TABLE[LOWER])
    word = rolling.of(start, end) if len(start) else np.zeros(0, np.uint64)
    near = np.searchsorted(start, offsets)
    count = np.diff(near)
    odd = (_SYMBOL | _BAR | _SHOUT)[data[end - 1]] if len(end) else np.zeros(0, bool)
    same = np.zeros(len(word), bool)
    same[1:] = word[1:] == word[:-1]
    same[near[:-1][near[:-1] < len(word)]] = False

    def of_words(flags: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(word) + 1, np.int64)
        np.cumsum(flags, out=sums[1:])
        return sums[near[1:]] - sums[near[:-1]]

    distinct, top = np.zeros(rows), np.zeros(rows)
    for i, (a, b) in enumerate(zip(near[:-1], near[1:], strict=True)):
        if b > a:
            got = np.sort(word[a:b])
            cut = np.flatnonzero(got[1:] != got[:-1])
            distinct[i] = len(cut) + 1
            top[i] = np.diff(np.concatenate(([-1], cut, [b - a - 1]))).max()
    chars, terms = np.maximum(size, 1), np.maximum(count, 1)
    share = lambda x, of, more=_CHARS: np.log((x + _SMALL * more) / (of + more) + _SMALL)
    out[:, 0], out[:, 1] = np.log1p(size), np.log1p(count)
    out[:, 2] = np.log1p(per_row(inside) / terms)
    for k, kind in enumerate((_UPPER, _SYMBOL, _BAR, _SHOUT, _DIGIT)):
        out[:, 3 + k] = share(per_row(kind[data]), chars)
    out[:, 8], out[:, 9] = share(per_row(data == 10), chars), share(per_row(_STOP[data]), chars)
    # Long documents repeat words more than short ones: what counts is the distance from a power of the length.
    out[:, 10] = np.log(distinct + _WORDS) - np.log(terms + _WORDS) + 0.3 * np.log(terms + _WORDS)
    out[:, 11], out[:, 12], out[:, 13] = share(of_words(same), terms, _WORDS), share(top, terms, _WORDS), share(of_words(odd), terms, _WORDS)
    return out


def with_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and its statistics x; a null text is an empty one."""

    def run(batches):
        rolling = Rolling()
        for batch in batches:
            data, offsets = bytes_of(batch.column("text"))
            parts = [statistics(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], rolling) for lo, hi in slices(offsets)]
            x = np.concatenate(parts) if parts else np.zeros((0, len(NAMES)))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * len(NAMES), pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), lists], ["doc_id", "x"])

    return in_small_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).mapInArrow(lean(run), "doc_id long, x array<double>")


class Discriminant:
    """Two Gaussian classes with shrunk covariances; keeps the inverse Cholesky factors."""

    def __init__(self, moments: dict[int, tuple[float, np.ndarray, np.ndarray]]) -> None:
        """moments: for class 0 and 1 the number of rows, their sum and the sum of their outer products."""
        self.ready = all(moments.get(c, (0,))[0] >= 2 for c in (0, 1))
        if not self.ready:
            return
        total = sum(m[0] for m in moments.values())
        mean = {c: s / n for c, (n, s, _) in moments.items()}
        cov = {c: p / n - np.outer(mean[c], mean[c]) for c, (n, _, p) in moments.items()}
        pooled = sum(moments[c][0] * cov[c] for c in cov) / total
        self.mean, self.factor, self.constant = [], [], []
        for c in (0, 1):
            s = (1 - TO_DIAGONAL - TO_POOLED) * cov[c] + TO_DIAGONAL * np.diag(np.diag(cov[c])) + TO_POOLED * pooled
            low = np.linalg.cholesky(s + 1e-4 * np.eye(len(s)))
            self.mean.append(mean[c])
            self.factor.append(np.linalg.inv(low))
            self.constant.append(math.log(moments[c][0] / total) - np.log(np.diag(low)).sum())

    def score(self, x: np.ndarray) -> np.ndarray:
        """The probability of class 1; 0.5 where a class had no two rows to learn from."""
        if not self.ready:
            return np.full(len(x), 0.5)
        density = [self.constant[c] - 0.5 * (((x - self.mean[c]) @ self.factor[c].T) ** 2).sum(1) for c in (0, 1)]
        return 1 / (1 + np.exp(np.clip(density[0] - density[1], -700, 700)))


def fit(stats: DataFrame, labels: DataFrame) -> Discriminant:
    """From rows with x and a label in labels (doc_id, y in 0 and 1): all of them, as sums that Spark adds up."""
    width = len(NAMES)

    def run(batches):
        sums = {}
        for b in batches:
            y = np.asarray(b.column("y"))
            x = np.asarray(b.column("x").flatten()).reshape(-1, width)
            for c in (0, 1):
                z = x[y == c]
                got = np.concatenate(([len(z)], z.sum(0), (z.T @ z).ravel()))
                sums[c] = sums.get(c, 0) + got
        for c, v in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), c), pa.int32()), pa.array(np.arange(len(v)), pa.int32()), pa.array(v)], ["y", "k", "v"])

    joined = stats.join(labels.select("doc_id", F.col("y").cast("int").alias("y")), "doc_id").select("x", "y")
    rows = joined.mapInArrow(lean(run), "y int, k int, v double").groupBy("y", "k").agg(F.sum("v").alias("v")).orderBy("y", "k").collect()
    moments = {}
    for c in (0, 1):
        v = np.array([r["v"] for r in rows if r["y"] == c])
        if len(v):
            moments[c] = (v[0], v[1 : width + 1], v[width + 1 :].reshape(width, width))
    return Discriminant(moments)


def held_out(doc_id) -> F.Column:
    """Every fourth document by the CRC-32 of its id's digits; a null id isn't held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs.

    Learns from labels (doc_id, quality) of documents that aren't held out; several labels of one document count once, and not at all if they differ.
    A null or empty text is scored as one without words. Without two labelled documents of either class every score is 0.5. Repeated rows are
    scored each; an empty table gives no rows.
    """
    stats = written(with_statistics(docs), "statistics")
    y = labels.where("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("y"), F.max("quality").alias("z")).where("y = z")
    model = fit(stats.where(~held_out("doc_id")), y)
    width = len(NAMES)

    def run(batches):
        for b in batches:
            x = np.asarray(b.column("x").flatten()).reshape(-1, width)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(model.score(x))], ["doc_id", "score"])

    scored = stats.mapInArrow(lean(run), "doc_id long, score double")
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The rows of docs with a score of threshold or more, all their columns; learns as quality() does, but from every labelled document.

    There is nothing to hold out from: the filter serves the corpus, not a measurement. Null, empty, repeated rows and empty tables as in quality().
    """
    y = labels.where("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("y"), F.max("quality").alias("z")).where("y = z")
    model = fit(with_statistics(docs), y)

    def run(batches):
        rolling = Rolling()
        for batch in batches:
            data, offsets = bytes_of(batch.column("text"))
            parts = [statistics(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], rolling) for lo, hi in slices(offsets)]
            if parts:
                yield batch.filter(pa.array(model.score(np.concatenate(parts)) >= threshold))

    return in_small_batches(docs).mapInArrow(lean(run), docs.schema)
