"""Mixing sources to target weights by soft membership; DataFrame operations alone.

1. A naive Bayes classifier over hashed words and word endings is fitted to a bounded sample of a labelled table
   (``per_domain`` rows a domain, smallest hashes).  Log ratios are smoothed towards the corpus and small ones are
   dropped, so that words seen by chance weigh nothing.
2. Each document's domain posteriors are the softmax of the prior and the sum of its words' ratios, tempered by the
   square root of how many words spoke.
3. Document rates r >= 0 (and <= ``max_rate``) are fitted so that the expected tokens of domain j, the sum over
   documents of r * tokens * posterior_j, match target_j: projected gradient descent on the relative squared error
   from r = 1.  An iteration is one aggregate of one number a domain; the step is the reciprocal of the largest
   eigenvalue of the Gram matrix of the domains.  The gradient is taken in the metric weighted by tokens, in which a
   document's step depends on its posteriors alone.

Nothing but one row a domain or pair of domains reaches the driver.  Weights have BUCKETS rows at most and are
broadcast.  Words are aggregated within their own task before anything is shuffled.

Edge cases.  A null text, or one without words, has 0 tokens and the prior as posterior.  Labels that are null or of
unknown documents are ignored; without any label there is one domain, ``all``.  Targets of domains that are not
learnt are ignored; learnt domains without a target get 0.  Rows that repeat a doc_id (or have none) share one rate,
fitted to all their words together.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import store
from .langid import bounded_sample

BUCKETS = 1 << 16
PER_DOMAIN = 3000
ITERATIONS = 60
#: White space between words, as in the other operators.
_SPLIT = "[ \\x09-\\x0D]+"


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), _SPLIT), lambda w: w != "")


def _features(word: Column) -> tuple[Column, Column]:
    """Buckets of the word and of its ending."""
    return F.pmod(F.xxhash64(word), F.lit(BUCKETS)), F.pmod(F.xxhash64(F.right(word, F.lit(2)), F.lit(17)), F.lit(BUCKETS)) + BUCKETS


def _sum(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, parts, F.lit(0.0))


class Classifier:
    """``domains`` with their ``priors``, and ``weights`` (feature, w: a ratio for each domain), one row a bucket."""

    def __init__(self, domains: list[str], priors: list[float], weights: DataFrame | None):
        self.domains, self.priors, self.weights = domains, priors, weights


def fit(docs: DataFrame, labelled: DataFrame, doc_id: str = "doc_id", text: str = "text", domain: str = "domain", per_domain: int = PER_DOMAIN, least: float = 0.7, strength: float = 4.0) -> Classifier:
    """Naive Bayes from ``labelled`` (doc_id, domain), at most ``per_domain`` rows a domain."""
    spark = docs.sparkSession
    labelled = labelled.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(domain).cast("string").alias("domain")).where("doc_id is not null and domain is not null")
    totals = dict(sorted(labelled.groupBy("domain").count().collect()))
    if not totals:
        return Classifier(["all"], [1.0], None)
    names = list(totals)
    whole = sum(totals.values())
    # At most per_domain rows a domain: a bounded table, found in the documents by one scan.
    sample = F.broadcast(bounded_sample(labelled, "domain", "doc_id", per_domain).dropDuplicates(["doc_id"]))
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).join(sample, "doc_id")
    words = texts.select("domain", F.explode(F.array_distinct(_words(F.col("text")))).alias("word"))
    both = words.select("domain", F.explode(F.array_distinct(F.array(*_features(F.col("word"))))).alias("feature"))
    size = texts.groupBy("domain").count().collect()
    seen = {r[0]: r[1] for r in size}
    names = [n for n in names if n in seen]
    if not names:
        return Classifier(["all"], [1.0], None)
    counts = both.groupBy("feature").agg(*[F.sum((F.col("domain") == n).cast("double")).alias(f"d{j}") for j, n in enumerate(names)])
    every = _sum([F.col(f"d{j}") for j in range(len(names))])
    base = every / sum(seen[n] for n in names)
    ratio = [F.log((F.col(f"d{j}") + strength * base) / ((seen[n] + strength) * base)) for j, n in enumerate(names)]
    kept = F.greatest(F.lit(0.0), *[F.abs(r) for r in ratio]) >= least
    weights = counts.where(every >= 3).select(F.col("feature").alias("feature"), kept.alias("kept"), *[r.alias(f"w{j}") for j, r in enumerate(ratio)])
    weights = store.saved(weights.where("kept").drop("kept").coalesce(1), "weights")
    return Classifier(names, [totals[n] / whole for n in names], weights)


def posteriors(docs: DataFrame, model: Classifier, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, ``_n`` tokens, ``_p0`` ... in the order of the model's domains), one row a doc_id.

    Words meet their weights in a broadcast join and are summed by document within the task that read them.
    """
    k = len(model.domains)
    if model.weights is None:
        return docs.groupBy(F.col(doc_id).alias("doc_id")).agg(F.sum(F.size(_words(F.col(text)))).cast("long").alias("_n"), F.lit(1.0).alias("_p0"))
    word = docs.select(F.col(doc_id).alias("doc_id"), F.explode_outer(_words(F.col(text))).alias("word"))
    one, two = _features(F.col("word"))
    first = F.broadcast(model.weights.where(F.col("feature") < BUCKETS).select(F.col("feature").alias("f1"), *[F.col(f"w{j}").alias(f"a{j}") for j in range(k)]))
    last = F.broadcast(model.weights.where(F.col("feature") >= BUCKETS).select(F.col("feature").alias("f2"), *[F.col(f"w{j}").alias(f"b{j}") for j in range(k)]))
    met = word.select("doc_id", "word", one.alias("f1"), two.alias("f2")).join(first, "f1", "left").join(last, "f2", "left")
    spoke = F.sum(F.col("a0").isNotNull().cast("double") + F.col("b0").isNotNull().cast("double"))
    totals = met.groupBy("doc_id").agg(F.count("word").alias("_n"), spoke.alias("_m"), *[F.sum(F.coalesce(F.col(f"a{j}"), F.lit(0.0)) + F.coalesce(F.col(f"b{j}"), F.lit(0.0))).alias(f"_s{j}") for j in range(k)])
    score = [F.log(F.lit(p)) + F.col(f"_s{j}") / F.sqrt(F.greatest(F.col("_m"), F.lit(1.0))) for j, p in enumerate(model.priors)]
    top = F.greatest(*score) if k > 1 else score[0]
    odds = [F.exp(s - top) for s in score]
    return totals.select("doc_id", "_n", *[(o / _sum(odds)).alias(f"_p{j}") for j, o in enumerate(odds)])


def _largest_eigenvalue(m: list[list[float]]) -> float:
    v, value = [1.0] * len(m), 0.0
    for _ in range(200):
        w = [sum(a * b for a, b in zip(row, v, strict=True)) for row in m]
        value = max(map(abs, w)) or 1.0
        v = [x / value for x in w]
    return value


def fit_rates(table: DataFrame, targets: list[float] | None, weights: list[float], max_rate: float | None = None, iterations: int = ITERATIONS, tolerance: float = 1e-6) -> DataFrame:
    """``table`` (``_n``, ``_p*``) with ``rate``.

    ``targets`` are token totals by domain.  Without them they are ``weights`` times the largest total that needs no
    rate above 1 on average in any domain.  ``table`` is read once an iteration: give one that is written.
    """
    k = len(weights)
    p = [F.col(f"_p{j}") for j in range(k)]
    gram = table.agg(*[F.sum(F.col("_n") * p[i] * p[j]).alias(f"g{i}_{j}") for i in range(k) for j in range(i + 1)], *[F.sum(F.col("_n") * p[j]).alias(f"t{j}") for j in range(k)]).first()
    natural = [float(gram[f"t{j}"] or 0.0) for j in range(k)]
    if targets is None:
        whole = min((natural[j] / w for j, w in enumerate(weights) if w > 0), default=0.0)
        targets = [w * whole for w in weights]
    scale = [1 / max(n, 1.0) for n in natural]
    m = [[float(gram[f"g{max(i, j)}_{min(i, j)}"] or 0.0) * (scale[i] * scale[j]) ** 0.5 for j in range(k)] for i in range(k)]
    step = 1 / max(_largest_eigenvalue(m), 1e-12)
    rate: Column = F.lit(1.0)
    last = None
    for at in range(iterations):
        if at and at % 10 == 0:  # a longer chain of steps would be a deep expression
            table = store.saved(table.withColumn("rate", rate), "rates")
            rate = F.col("rate")
        got = table.agg(*[F.sum(F.col("_n") * rate * x) for x in p]).first()
        error = [(float(g or 0.0) - t) * s for g, t, s in zip(got, targets, scale, strict=True)]
        if last is not None and sum((a - b) ** 2 for a, b in zip(error, last, strict=True)) < tolerance**2 or sum(e * e for e in error) < tolerance**2:
            break
        last = error
        rate = F.greatest(F.lit(0.0), rate - _sum([F.lit(step * e) * x for e, x in zip(error, p, strict=True)]))
        if max_rate is not None:
            rate = F.least(F.lit(float(max_rate)), rate)
    return table.withColumn("rate", rate)


def label_domains(labels: DataFrame) -> DataFrame:
    """(doc_id, domain): a domain for each pair of quality and toxic, as ``q1t0``."""
    return labels.where("quality is not null and toxic is not null").select("doc_id", F.concat(F.lit("q"), F.col("quality").cast("string"), F.lit("t"), F.col("toxic").cast("string")).alias("domain"))


#: Shares of tokens by domain that the registered query and the pipeline aim at.
TARGETS = {"q1t0": 0.92, "q0t0": 0.06, "q1t1": 0.02}


def rates(docs: DataFrame, labelled: DataFrame, targets: dict[str, float] = TARGETS, max_rate: float | None = None, keep_total: bool = True, text: str = "text", doc_id: str = "doc_id") -> tuple[DataFrame, list[str]]:
    """((doc_id, _n, _p*, rate), domains), one row a doc_id.

    ``keep_total``: the targets add up to the corpus' tokens; otherwise to the largest total that needs no repetition.
    """
    model = fit(docs, labelled, doc_id=doc_id, text=text)
    table = store.saved(posteriors(docs, model, text, doc_id), "posteriors")
    share = [max(0.0, targets.get(d, 0.0)) for d in model.domains]
    share = [s / sum(share) for s in share] if sum(share) else [1 / len(share)] * len(share)
    totals = None
    if keep_total:
        whole = table.agg(F.sum("_n")).first()[0] or 0
        totals = [s * whole for s in share]
    return fit_rates(table, totals, share, max_rate), model.domains


def document_rates(docs: DataFrame, labelled: DataFrame, targets: dict[str, float] = TARGETS, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_tokens, p_<domain> ..., rate) for every doc_id."""
    found, domains = rates(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")), labelled, targets)
    return found.select("doc_id", F.col("_n").alias("n_tokens"), *[F.col(f"_p{j}").alias(f"p_{d}") for j, d in enumerate(domains)], "rate")


def sample(docs: DataFrame, labelled: DataFrame, targets: dict[str, float] = TARGETS, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of ``docs``, with their columns, drawn at their rates (at most 1) by a hash of doc_id."""
    found, _ = rates(docs, labelled, targets, max_rate=1.0, keep_total=False, text=text, doc_id=doc_id)
    draw = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit(41)), F.lit(1 << 30)) / (1 << 30)
    name = store.free_name("_kept", docs)
    kept = found.where(draw < F.col("rate")).select(F.col("doc_id").alias(name))
    return docs.join(kept, F.col(doc_id).eqNullSafe(F.col(name)), "left_semi")
