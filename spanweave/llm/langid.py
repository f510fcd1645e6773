"""Language identification in two steps: the family first, then one-versus-one linear SVMs inside it.

Features are frequencies of hashed byte trigrams of the whole text, with letters folded to lower case and everything
else taken as space.  A linear function of frequencies is a mean of one weight a trigram, so that scoring gathers and
sums weights over the bytes of a whole slice of texts.  The family is the best of one-versus-rest SVMs; inside the
family each pair of languages votes, ties go to the larger sum of margins, then to the first name.

The models are fitted on the driver to a bounded sample: at most ``per_language`` texts a language, chosen by a hash of
doc_id among the rows that may be learnt from.

Edge cases.  A null text, or one without a letter, is ``und`` with score 0.  Without any row to learn from, everything
is ``und``.  A single language is predicted with score 1.  Rows with a null language or doc_id are not learnt from.
"""

from __future__ import annotations

import re
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import store
from .bytescan import Texts

BUCKETS = 1 << 13
UNDETERMINED = "und"
#: Families of common languages by ISO 639-1 code; any other language is a family of its own.
FAMILIES = {
    "germanic": "af da de en is lb nl no sv yi",
    "romance": "ca es fr gl it la oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "indic": "bn gu hi mr ne pa si ur",
    "uralic": "et fi hu",
    "turkic": "az kk ky tr uz",
    "semitic": "ar he mt",
}
_FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes.split()}
_ASCII_LETTER = re.compile("[A-Za-z]")
_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def has_letter(text: str) -> bool:
    """Whether a character of a Unicode category of letters is there; digits and numerals of any kind are none."""
    return _ASCII_LETTER.search(text) is not None or not text.isascii() and any(map(str.isalpha, text))


def trigrams(scan: Texts) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of the trigram that begins at each byte, -1 where there is none; and the text of each byte."""
    data = _FOLD[scan.data]
    capital = (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[:-1] == 0xC3)  # Latin-1 capitals in UTF-8
    data[1:][capital] += 0x20
    n = len(data)
    owner = np.repeat(np.arange(len(scan)), np.diff(scan.offsets))
    out = np.full(n, -1, np.int32)
    if n < 3:
        return out, owner
    wide = data.astype(np.uint32)
    key = (wide[:-2] << 16) | (wide[1:-1] << 8) | wide[2:]
    good = (owner[:-2] == owner[2:]) & (key != 0x202020)
    out[:-2] = np.where(good, (key * np.uint32(2654435761)) >> np.uint32(19), -1)
    return out, owner


def frequencies(texts: pa.Array) -> np.ndarray:
    """A row of trigram frequencies a text."""
    scan = Texts.of(texts)
    bucket, owner = trigrams(scan)
    good = bucket >= 0
    counts = np.bincount(owner[good] * BUCKETS + bucket[good], minlength=len(scan) * BUCKETS).reshape(len(scan), BUCKETS)
    return (counts / np.maximum(counts.sum(1, keepdims=True), 1)).astype(np.float32)


def blank(n: int) -> np.ndarray:
    """Room for the features of ``n`` texts, with the constant feature behind them."""
    return np.ones((n, BUCKETS + 1), np.float32)


def linear_svm(x: np.ndarray, y: np.ndarray, c: float = 10.0, rounds: int = 40) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for the squared hinge loss; ``y`` is +1 or -1; the bias is the constant last feature.

    ``x`` is the driver's largest array, so nothing of its size is made here.
    """
    norm = np.array([(row * row).sum() for row in x], x.dtype) + 0.5 / c
    alpha, w = np.zeros(len(x)), np.zeros(x.shape[1])
    rng = np.random.default_rng(7)
    for _ in range(rounds):
        most = 0.0
        for i in rng.permutation(len(x)):
            slope = y[i] * (x[i] @ w) - 1 + alpha[i] * 0.5 / c
            new = max(alpha[i] - slope / norm[i], 0.0)
            if new != alpha[i]:
                most = max(most, abs(new - alpha[i]))
                w += (new - alpha[i]) * y[i] * x[i]
                alpha[i] = new
        if most < 1e-3:
            break
    return w[:-1], float(w[-1])


class Model:
    """Fitted weights: ``rest`` for families against the rest, ``pairs`` by family for pairs of its languages."""

    def __init__(self, x: np.ndarray, langs: list[str]):
        """``x`` as of ``blank``; it is scaled in its place."""
        own = x[:, :-1]
        self.scale = 1 / np.sqrt(own.mean(0) + 1e-5) if len(x) else np.ones(BUCKETS)
        own *= self.scale
        langs_ = np.array(langs)
        families = np.array([_FAMILY.get(v, v) for v in langs])
        self.families = sorted(set(families))
        self.languages = {f: sorted(set(langs_[families == f])) for f in self.families}
        self.rest = [self._fit(x, families == f) for f in self.families] if len(self.families) > 1 else []
        self.pairs = {}
        for f, names in self.languages.items():
            self.pairs[f] = [(a, b, *self._fit(x[(langs_ == names[a]) | (langs_ == names[b])], langs_[(langs_ == names[a]) | (langs_ == names[b])] == names[a])) for a, b in combinations(range(len(names)), 2)]

    def _fit(self, x: np.ndarray, positive: np.ndarray) -> tuple[np.ndarray, float]:
        w, bias = linear_svm(x, np.where(positive, 1.0, -1.0))
        return (w * self.scale).astype(np.float32), bias

    def predict(self, texts: pa.Array) -> list[pa.Array]:
        n = len(texts)
        spoken = np.array([has_letter(t) for t in texts.to_pylist()], bool)
        lang, score = np.full(n, UNDETERMINED, object), np.zeros(n)
        if not self.families:
            return [pa.array(lang, pa.string()), pa.array(score)]
        bucket, owner = trigrams(Texts.of(texts))
        good = bucket >= 0
        bucket, owner = bucket[good], owner[good]
        total = np.maximum(np.bincount(owner, minlength=n), 1)

        def mean(w, bias, bucket=bucket, owner=owner):
            return np.bincount(owner, weights=w[bucket], minlength=n) / total + bias

        margins = np.stack([mean(*w) for w in self.rest], 1) if self.rest else np.zeros((n, 1))
        best = margins.argmax(1)
        odds = np.exp(3 * (margins - margins.max(1, keepdims=True)))
        sure = odds.max(1) / odds.sum(1)
        for f, family in enumerate(self.families):
            mine = best == f
            if not mine.any():
                continue
            names, part = self.languages[family], mine[owner]
            votes, sums = np.zeros((n, len(names))), np.zeros((n, len(names)))
            for a, b, w, bias in self.pairs[family]:
                m = mean(w, bias, bucket[part], owner[part])
                votes[:, a] += m > 0
                votes[:, b] += m <= 0
                sums[:, a] += m
                sums[:, b] -= m
            ranked = votes + 0.5 * np.tanh(sums / max(len(names), 1)) / 2
            top = ranked.argmax(1)
            odds = np.exp(3 * np.clip(sums - sums.max(1, keepdims=True), -50, 0))
            inner = odds[np.arange(n), top] / odds.sum(1)
            lang[mine] = np.array(names, object)[top[mine]]
            score[mine] = (sure * inner)[mine]
        lang[~spoken], score[~spoken] = UNDETERMINED, 0.0
        return [pa.array(lang, pa.string()), pa.array(np.clip(score, 0.0, 1.0))]


def bounded_sample(rows: DataFrame, label: str, key: str, most: int) -> DataFrame:
    """At most ``most`` rows of each value of ``label``: those with the smallest hashes of ``key``.

    One pass counts the labels, one takes a little more than is needed by a threshold on the hash; only that is ranked.
    """
    spark = rows.sparkSession
    counts = rows.groupBy(label).count().collect()  # one row a label
    if not counts:
        return rows.limit(0)
    share = spark.createDataFrame([(r[0], min(1.0, 2.0 * most / r[1] + 20.0 / r[1])) for r in counts], f"`{label}` string, _share double")
    draw = (F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit(5)), F.lit(1 << 30)) / (1 << 30)).alias("_draw")
    few = rows.select("*", draw).join(F.broadcast(share), label).where("_draw < _share")
    order = Window.partitionBy(label).orderBy("_draw", key)
    return few.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= most).drop("_draw", "_share", "_rank")


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows never learnt from: crc32 of the doc_id's text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, per_language: int = 300, text: str = "text", lang: str = "lang", doc_id: str = "doc_id") -> Model:
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull() & (F.col("text") != ""))
    sample = bounded_sample(rows, "lang", "doc_id", per_language).orderBy("lang", "doc_id").toPandas()
    x = blank(len(sample))
    for i in range(0, len(sample), 64):
        x[i : i + 64, :-1] = frequencies(pa.array(sample["text"][i : i + 64], pa.large_string()))
    langs = sample["lang"].tolist()
    del sample
    out = Model(x, langs)
    del x
    store.release()
    return out


def identify(docs: DataFrame, model: Model, text: str = "text", lang_as: str = "lang_pred", score_as: str = "score") -> DataFrame:
    """``docs`` with the predicted language and its score; nothing but the text is looked at."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # its size depends on the languages alone
    return store.with_columns(docs, text, lambda texts: held.value.predict(texts), f"`{lang_as}` string, `{score_as}` double")
