"""Quality classifier: ordinal cumulative-link regression on graded ratings over hashed text.

P(grade >= k) = sigmoid(w . x - threshold_k) with one weight vector and ordered thresholds. x holds, for a whole text, the
presence of hashed words, beginnings of words and symbol runs, and a few binned statistics (repetition, share of symbols). Fitting takes a bounded
sample of rated texts, SAMPLE by default, chosen by a hash of the id, and runs proximal accelerated gradient steps with
an L1 penalty on the driver; the model is a vector of fixed size. Scoring is one pass over the texts, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .kernels import LOWER, U64, WHITE, chunks, runs, segment_hash, splitmix

BITS = 18
BINS = 10
STEM = 4
SAMPLE = 6000

_WORD = np.zeros(256, bool)
_WORD[[*range(ord("0"), ord("9") + 1), *range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1), *range(0x80, 0x100)]] = True


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct feature numbers of each text, text by text, and how many each has. The last 4 * BINS numbers are the statistics."""
    n = len(offsets) - 1
    kind = np.where(_WORD[data], 1, np.where(WHITE[data], 0, 2))
    w_starts, w_lens = runs(kind == 1, offsets)
    s_starts, s_lens = runs(kind == 2, offsets)
    lower = LOWER[data]
    w_hash, s_hash = segment_hash(lower, w_starts, w_lens), segment_hash(lower, s_starts, s_lens)
    w_owner, s_owner = (np.searchsorted(offsets, s, side="right") - 1 for s in (w_starts, s_starts))
    room = (1 << BITS) - 4 * BINS
    number = lambda h: (h % U64(room)).astype(np.int64)
    longer = w_lens > STEM
    stem = splitmix(segment_hash(lower, w_starts[longer], np.full(int(longer.sum()), STEM)))
    flat = np.unique(np.concatenate([(w_owner << BITS) | number(w_hash), (w_owner[longer] << BITS) | number(stem), (s_owner << BITS) | number(s_hash)]))

    n_words = np.maximum(np.bincount(w_owner, minlength=n), 1)
    n_symbols = np.bincount(s_owner, minlength=n)
    words_seen = np.unique((w_owner << BITS) | number(w_hash)) >> BITS
    distinct = np.bincount(words_seen, minlength=n) / n_words
    same = np.zeros(len(w_hash))
    same[1:] = (w_hash[1:] == w_hash[:-1]) & (w_owner[1:] == w_owner[:-1])
    repeats = np.bincount(w_owner, weights=same, minlength=n) / n_words
    long_symbols = np.bincount(s_owner, weights=s_lens >= 2, minlength=n) / n_words
    stats = []
    for k, share in enumerate((distinct, repeats, n_symbols / (n_words + n_symbols), long_symbols)):
        stats.append(room + k * BINS + np.minimum((share * BINS).astype(np.int64), BINS - 1))
    extra = np.concatenate([(np.arange(n) << BITS) | s for s in stats])
    flat = np.union1d(flat, extra)
    return flat & ((1 << BITS) - 1), np.bincount(flat >> BITS, minlength=n)


@dataclass
class Ordinal:
    """weights: one per feature; thresholds: ascending, one fewer than grades."""

    weights: np.ndarray
    thresholds: np.ndarray
    grades: tuple[int, ...]

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= k) for each text and each grade but the least."""
        return 1 / (1 + np.exp(-np.clip(score[:, None] - self.thresholds[None, :], -40, 40)))

    def tail_of(self, tails: np.ndarray, grade: int) -> np.ndarray:
        """P(grade or more) for each text; certain either way for grades not above the least seen, or above all seen."""
        k = next((k for k, g in enumerate(self.grades[1:]) if g >= grade), None)
        if grade <= self.grades[0] or k is None:
            return np.full(len(tails), float(self.grades[0] >= grade))
        return tails[:, k]

    def expected(self, tails: np.ndarray) -> np.ndarray:
        return self.grades[0] + tails @ np.diff(np.array(self.grades, float))


def _score(weights: np.ndarray, number: np.ndarray, count: np.ndarray) -> np.ndarray:
    return np.bincount(np.repeat(np.arange(len(count)), count), weights=weights[number], minlength=len(count))


def fit(number: np.ndarray, count: np.ndarray, grade: np.ndarray, l1: float = 5e-4, l2: float = 1e-4, rounds: int = 400, least: int = 4) -> Ordinal:
    """Maximum likelihood by accelerated proximal gradient. Features of fewer than least texts are left out.

    One grade only, or no texts: a model without information, whose tails are 1 for the grades up to the one seen.
    """
    grades = tuple(sorted(set(grade.tolist())))
    weights = np.zeros(1 << BITS)
    if len(grades) < 2:
        return Ordinal(weights, np.empty(0), grades or (0,))
    df = np.bincount(number, minlength=1 << BITS)
    keep = df[number] >= least
    row = np.repeat(np.arange(len(count)), count)[keep]
    used, column = np.unique(number[keep], return_inverse=True)
    level = np.searchsorted(grades, grade)
    n, k = len(count), len(grades) - 1
    share = np.array([(level > j).mean() for j in range(k)])
    theta = np.log((1 - share) / share)
    w = np.zeros(len(used))
    # rare features move as fast as common ones, and those that tell nothing about any threshold hardly at all
    has = np.bincount(column, minlength=len(used))
    z = np.zeros(len(used))
    for j in range(1, k + 1):
        above = (level >= j).astype(float)
        z = np.maximum(z, np.abs(np.bincount(column, weights=above[row], minlength=len(used)) / has - above.mean()) / max(above.std(), 1e-9) * np.sqrt(has))
    scale = z**2 / (z**2 + 16) / np.sqrt(np.maximum(has / n, 1e-4))
    mean_nnz = max(1.0, len(column) / n)
    step = 2.0 / mean_nnz
    pw, pt, t = w.copy(), theta.copy(), 1.0
    at = np.arange(n)
    for _ in range(rounds):
        s = np.bincount(row, weights=(pw * scale)[column], minlength=n)
        upper = np.concatenate([np.ones((n, 1)), 1 / (1 + np.exp(-np.clip(s[:, None] - pt, -40, 40))), np.zeros((n, 1))], axis=1)
        p = np.maximum(upper[at, level] - upper[at, level + 1], 1e-12)
        slope = upper * (1 - upper)
        g = -(slope[at, level] - slope[at, level + 1]) / p / n
        gw = np.bincount(column, weights=g[row], minlength=len(used)) * scale + l2 * pw
        gt = np.zeros(k)
        np.add.at(gt, np.maximum(level - 1, 0), np.where(level > 0, slope[at, level] / p / n, 0))
        np.add.at(gt, np.minimum(level, k - 1), np.where(level < k, -slope[at, level + 1] / p / n, 0))
        new = pw - step * gw
        new = np.sign(new) * np.maximum(np.abs(new) - step * l1, 0)
        new_t = np.maximum.accumulate(pt - 0.5 * gt)
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        if float(((pw - new) * (new - w)).sum()) > 0:
            nt = 1.0
        pw = new + (t - 1) / nt * (new - w) if nt > 1 else new
        pt = np.sort(new_t + (t - 1) / nt * (new_t - theta)) if nt > 1 else new_t
        w, theta, t = new, new_t, nt
    weights[used] = w * scale
    return Ordinal(weights, theta, grades)


def rated(documents: DataFrame, ratings: DataFrame, grade: Column, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features and grades of at most sample rated texts, those with the least hashes of their ids.

    A null id or grade is no rating; of several ratings of one id the least counts. Rows with one id are all rated texts; a null text is
    empty. Without ratings or documents there are no rows.
    """
    picked = ratings.select(F.col(id_col).cast("long").alias("id"), grade.cast("int").alias("grade")).filter("id is not null and grade is not null").groupBy("id").agg(F.min("grade").alias("grade"))
    picked = picked.orderBy(F.xxhash64("id"), "id").limit(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in chunks(batch.column(2)):
                number, count = features(data, offsets)
                ends = np.cumsum(count)
                packed = pa.array([number[e - c : e].astype("<i4").tobytes() for e, c in zip(ends, count, strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), packed], names=["id", "grade", "number"])

    texts = documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rows = texts.join(F.broadcast(picked), "id").select("id", "grade", "text").mapInArrow(run, "id long, grade int, number binary")
    found = sorted((r["id"], r["grade"], bytes(r["number"])) for r in rows.toLocalIterator())  # at most sample texts
    parts = [np.frombuffer(n, "<i4").astype(np.int64) for _, _, n in found]
    return np.concatenate([*parts, np.empty(0, np.int64)]), np.array([len(p) for p in parts], np.int64), np.array([g for _, g, _ in found], np.int64)


def train(documents: DataFrame, ratings: DataFrame, grade: Column, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Ordinal:
    """A model of grade, an expression over ratings, fitted on at most sample rated texts; without any it knows grade 0 only."""
    return fit(*rated(documents, ratings, grade, id_col, text_col, sample))


def expected_grade(model: Ordinal, documents: DataFrame, text: Column) -> Column:
    """The expected grade as a column, for use beside other columns of documents."""
    shipped = documents.sparkSession.sparkContext.broadcast(model)  # 2 ** BITS numbers, whatever the data

    @F.arrow_udf("double")
    def grade(texts: pa.Array) -> pa.Array:
        m = shipped.value
        out = np.zeros(len(texts))
        for i, j, data, offsets in chunks(texts):
            out[i:j] = m.expected(m.tails(_score(m.weights, *features(data, offsets))))
        return pa.array(np.round(out, 9))

    return grade(text)


def classify(documents: DataFrame, model: Ordinal, select_grade: int, select_at: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of documents: the id, expected_grade, tail (probability of select_grade or more), kept (tail >= select_at).

    Null texts are empty: they have no words, only statistics. The id may be null or repeated; equal texts score alike; other
    columns don't matter. A model of one grade keeps all if that is high enough.
    """
    shipped = documents.sparkSession.sparkContext.broadcast(model)  # 2 ** BITS numbers, whatever the data

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shipped.value
        for batch in batches:
            for i, j, data, offsets in chunks(batch.column(1)):
                tails = m.tails(_score(m.weights, *features(data, offsets)))
                tail = m.tail_of(tails, select_grade)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array(np.round(m.expected(tails), 9)), pa.array(np.round(tail, 9)), pa.array(tail >= select_at)], names=["id", "expected_grade", "tail", "kept"]
                )

    slim = documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return slim.mapInArrow(run, "id long, expected_grade double, tail double, kept boolean").withColumnRenamed("id", id_col)


def select(documents: DataFrame, model: Ordinal, select_grade: int, select_at: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of documents, all columns as they are, that classify would keep. Texts stay where they are: only the text column
    passes through Python, next to its row."""
    shipped = documents.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("boolean")
    def keeps(texts: pa.Array) -> pa.Array:
        m = shipped.value
        kept = np.zeros(len(texts), bool)
        for i, j, data, offsets in chunks(texts):
            kept[i:j] = m.tail_of(m.tails(_score(m.weights, *features(data, offsets))), select_grade) >= select_at
        return pa.array(kept)

    return documents.filter(keeps(F.col(text_col)))
