"""Quality classifier: ordinal regression with cumulative links on graded ratings.

A document's score is a weighted sum over hashed features of its text; ordered thresholds cut the scores into grades:
P(grade <= j) = sigmoid(threshold_j - score), with the same weights for all j.  The expected grade and the probability
of the tail (grade >= ``tail``) follow; documents with a tail probability of at least ``least`` are kept.

Features are words (1 if the word occurs) and the shares of a document's words that have a given shape (capitals,
shouting marks, symbols, lone separators, a repetition of the word before), both hashed into one table of weights.
The fit is proximal gradient descent with an L1 penalty, so that words without a say weigh exactly nothing and long
texts don't drift.  It uses a bounded sample: ``per_grade`` rated documents a grade, by a hash of doc_id.

Edge cases.  A null or blank text has no feature: its grade follows from the thresholds alone, and it isn't kept.
Ratings that are null or of unknown documents are ignored; without two grades, everything has the one grade (or 0).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store
from .bytescan import U64, Texts, mix, prefix
from .langid import bounded_sample

BUCKETS = 1 << 18
SHAPES = ("capitals", "shouting", "symbols", "separators", "repeats", "marks")
PER_GRADE = 1500
_UPPER = np.array([65 <= i <= 90 for i in range(256)])
_LOWER = np.array([97 <= i <= 122 for i in range(256)])
_SHOUT = np.array([chr(i) == "!" for i in range(256)])
_SYMBOLS = np.array([chr(i) in "#*$%&|<>" for i in range(256)])
_MARKS = np.array([33 <= i <= 47 or 58 <= i <= 64 or 91 <= i <= 96 or 123 <= i <= 126 for i in range(256)])


def features(scan: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, bucket) of every word, the shares of shapes (text x shape) and the number of words of each text."""
    n = len(scan)
    low = scan.lowered()
    starts, ends, docs = scan.words()
    hashes = low.hashes(starts, ends)
    # ending marks don't belong to the word
    words = np.bincount(docs, minlength=n)
    count = {k: prefix(v[scan.data]) for k, v in (("u", _UPPER), ("l", _LOWER), ("!", _SHOUT), ("s", _SYMBOLS), ("m", _MARKS))}
    count = {k: v[ends] - v[starts] for k, v in count.items()}
    size = ends - starts
    again = np.zeros(len(starts), bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (docs[1:] == docs[:-1])
    shapes = [count["u"] > count["l"] + 1, count["!"] > 1, (count["s"] > 0) & (count["s"] < size), (count["s"] == size) & (size > 0), again, 2 * count["m"] > size]
    share = np.stack([np.bincount(docs, weights=s, minlength=n) for s in shapes], 1) / np.maximum(words, 1)[:, None]
    bucket = (mix(hashes ^ U64(0xABCDEF)) & U64(BUCKETS - 1)).astype(np.int64)
    return np.stack([docs, bucket]), share, words, size


def pairs(owner_bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, bucket)."""
    key = np.unique(owner_bucket[0] * BUCKETS + owner_bucket[1])
    return key // BUCKETS, key % BUCKETS


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Model:
    def __init__(self, grades: list[int]):
        self.grades = grades
        self.words = np.zeros(BUCKETS, np.float32)
        self.shapes = np.zeros(len(SHAPES))
        self.cuts = np.zeros(max(len(grades) - 1, 0))

    def fit(self, texts: list[str], grade: list[int], rounds: int = 400, penalty: float = 2e-3, least: int = 3) -> Model:
        y = np.searchsorted(self.grades, grade)
        n, k = len(texts), len(self.grades)
        if k < 2:
            return self
        owners, buckets, shares = [], [], []
        for i in range(0, n, 256):
            found, share, _, _ = features(Texts.of(pa.array(texts[i : i + 256], pa.large_string())))
            o, b = pairs(found)
            owners.append(o + i), buckets.append(b), shares.append(share)
        owner, bucket, share = np.concatenate(owners), np.concatenate(buckets), np.concatenate(shares)
        share = share * 4
        seen = np.bincount(bucket, minlength=BUCKETS)
        use = np.flatnonzero(seen >= least)  # rarer words can't earn a weight under the penalty
        place = np.full(BUCKETS, -1)
        place[use] = np.arange(len(use))
        good = place[bucket] >= 0
        owner, column = owner[good], place[bucket[good]]
        w, v = np.zeros(len(use)), np.zeros(len(SHAPES))
        cuts = np.array([np.log(p / (1 - p)) for p in np.clip([np.mean(y <= j) for j in range(k - 1)], 0.01, 0.99)])
        step_w = 4.0 / np.maximum(1.0, np.sqrt(seen[use] / n * 50))
        rows = np.arange(n)
        for _ in range(rounds):
            score = np.bincount(owner, weights=w[column], minlength=n) + share @ v
            below = _sigmoid(np.concatenate([np.full((n, 1), -np.inf), cuts - score[:, None], np.full((n, 1), np.inf)], 1))
            slope = below * (1 - below)
            p = np.maximum(below[rows, y + 1] - below[rows, y], 1e-9)
            pull = (slope[rows, y + 1] - slope[rows, y]) / p / n  # derivative of the loss by the score
            grad_cuts = np.array([-np.sum((y == j) * slope[:, j + 1] / p - (y == j + 1) * slope[:, j + 1] / p) / n for j in range(k - 1)])
            w -= step_w * np.bincount(column, weights=pull[owner], minlength=len(use))
            w = np.sign(w) * np.maximum(np.abs(w) - step_w * penalty, 0)
            v -= 0.5 * (share.T @ pull)
            cuts -= 0.5 * grad_cuts
            cuts = np.maximum.accumulate(cuts)
        self.words[use] = w
        self.shapes, self.cuts = v, cuts
        return self

    def score(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Probabilities of all grades (text x grade), and the number of words."""
        n = len(texts)
        found, share, words, _ = features(Texts.of(texts))
        owner, bucket = pairs(found[:, self.words[found[1]] != 0])
        score = np.bincount(owner, weights=self.words[bucket], minlength=n) + 4 * share @ self.shapes
        below = np.concatenate([np.zeros((n, 1)), _sigmoid(self.cuts - score[:, None]), np.ones((n, 1))], 1)
        return np.diff(below, axis=1), words


#: Grade of a document by its ratings; the worst first.
TOXIC, POOR, GOOD = 0, 1, 2


def graded(labels: DataFrame) -> DataFrame:
    """(doc_id, grade): 0 toxic, 1 poor, 2 good."""
    rated = labels.where("quality is not null and toxic is not null and doc_id is not null")
    grade = F.when(F.col("toxic") > 0, TOXIC).when(F.col("quality") > 0, GOOD).otherwise(POOR)
    return rated.select(F.col("doc_id").cast("long").alias("doc_id"), grade.alias("grade"))


def train(docs: DataFrame, ratings: DataFrame, per_grade: int = PER_GRADE, text: str = "text", doc_id: str = "doc_id") -> Model:
    """``ratings``: doc_id, grade.  The sample has a bounded number of rows and is looked up by a broadcast join."""
    named = ratings.select("doc_id", F.col("grade").cast("string").alias("grade"))
    sample = bounded_sample(named, "grade", "doc_id", per_grade).dropDuplicates(["doc_id"])
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).where("text is not null")
    rows = texts.join(F.broadcast(sample), "doc_id").orderBy("doc_id").toPandas()
    grade = rows["grade"].astype(int).tolist()
    return Model(sorted(set(grade))).fit(rows["text"].tolist(), grade)


SCHEMA = "doc_id long, expected_grade double, p_tail double, kept boolean"


def grade_documents(docs: DataFrame, model: Model, tail: int = GOOD, least: float = 0.5, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Expected grade, tail probability and decision, one row a document; map-only."""
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    held = docs.sparkSession.sparkContext.broadcast(model)

    def work(batch, texts):
        m = held.value
        grades = np.array(m.grades or [0], float)
        if len(m.grades) < 2:
            p, words = np.ones((len(texts), 1)), features(Texts.of(texts))[2]
        else:
            p, words = m.score(texts)
        above = p[:, grades >= tail].sum(1)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(p @ grades), pa.array(above), pa.array((above >= least) & (words > 0))], ["doc_id", "expected_grade", "p_tail", "kept"])

    return store.map_slices(docs, "text", work, SCHEMA)
