"""Operators that look at the whole corpus, against brute force."""

import random
import re

import pytest

import corpus_pipeline
from spanweave.llm import decontam, langid, mixing, near_copies
from spanweave.llm.graph import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def corpus(n=160, seed=1):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6))) for _ in range(300)]
    out = [None, "", " \n", "one", "One", "a b c", "A b  c", "a b c d", "a b c d"]
    while len(out) < n:
        if rng.random() < 0.6 and len(out) > 12:
            words = (out[rng.randrange(9, len(out))] or "").split()
            for _ in range(rng.choice([0, 1, 1, 2, 5])):
                if words:
                    words[rng.randrange(len(words))] = rng.choice(vocabulary)
            out.append(" ".join(w.title() if rng.random() < 0.05 else w for w in words))
        else:
            out.append(" ".join(rng.choice(vocabulary) for _ in range(rng.choice([3, 8, 20, 60, 200]))))
    return out


@pytest.mark.parametrize(("n", "num"), [(4, 85), (5, 80), (2, 60)])
def test_near_copies_against_all_pairs(spark, n, num):
    texts = corpus()
    rows = [(i, t, "x") for i, t in enumerate(texts)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_copies.near_copies(spark.createDataFrame(rows, "doc_id long, text string, key string"), n=n, num=num).collect()}
    sets = []
    for t in texts:
        words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if len(words) >= n else {tuple(words)} - {()})
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= num * len(a | sets[j]):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    assert got == {i: (len(s), find(i)) for i, s in enumerate(sets)}


def test_near_copies_of_odd_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert near_copies.near_copies(empty).count() == 0
    rows = [(None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (5, "A b c d e f")]
    got = sorted((str(r.doc_id), r.component_id) for r in near_copies.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [("3", 3), ("3", 3), ("5", 3), ("None", None)]


def test_sketch_distance_bounds_the_difference():
    import numpy as np

    rng = np.random.default_rng(2)
    for _ in range(50):
        a = np.unique(rng.integers(0, 2**63, rng.integers(1, 400)).astype(np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < 0.9], rng.integers(0, 2**63, rng.integers(0, 40)).astype(np.uint64)]))
        apart = sum(bin(int(x) & (2**64 - 1)).count("1") for x in near_copies.folded(a) ^ near_copies.folded(b))
        assert apart <= len(np.setxor1d(a, b))


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (None, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def distance(a, text):
    """Least edit distance of ``a`` to a part of ``text``, by the plain recurrence."""
    row = list(range(len(a) + 1))
    best = row[-1]
    for c in text:
        new = [0]
        for i, p in enumerate(a, 1):
            new.append(min(row[i] + 1, new[-1] + 1, row[i - 1] + (p != c)))
        row = new
        best = min(best, row[-1])
    return best


def test_myers_against_the_recurrence():
    rng = random.Random(4)
    for _ in range(200):
        a = "".join(rng.choice("abc") for _ in range(rng.randint(1, 80)))
        t = "".join(rng.choice("abc") for _ in range(rng.randint(0, 60)))
        d, s, e = decontam.place(a, t)
        assert d == distance(a, t)
        assert s <= e <= len(t)


def test_leaks_against_brute_force(spark):
    rng = random.Random(6)
    sentence = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n))
    items = [(i, sentence(rng.randint(3, 25))) for i in range(12)] + [(50, None), (51, " ")]
    docs = [(0, None), (1, ""), (2, "x")]
    for i in range(3, 60):
        text = sentence(40)
        if i % 2:
            item = list(rng.choice(items[:12])[1])
            for _ in range(rng.randint(0, 12)):
                item[rng.randrange(len(item))] = rng.choice("xyz")
            text = f"{text}\n  {''.join(item).upper() if i % 4 == 1 else ''.join(item)}  {sentence(5)}"
        docs.append((i, text))
    frame, benchmark = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontam.leaks(frame, benchmark).collect()}
    want = {}
    for d, t in docs:
        for i, item in items[:12]:
            apart = distance(decontam.normal(item), decontam.normal(t or ""))
            if apart <= decontam.budget(len(decontam.normal(item))):
                want[d, i] = apart
    assert {k: r.distance for k, r in got.items()} == want and want
    for (d, i), r in got.items():
        if r.distance == 0:
            assert decontam.normal(docs[d][1][r.start : r.end]) == decontam.normal(items[i][1])
    kept = {r.doc_id for r in decontam.clean(frame, benchmark).collect()}
    assert kept == {d for d, _ in docs} - {d for d, _ in want}
    assert decontam.clean(frame, benchmark.limit(0)).count() == len(docs)
    blocks = decontam.item_blocks(benchmark, block_chars=300)
    assert len(blocks) > 2 and sorted(k for b in blocks for k, _ in b.value) == list(range(12))


def languages(n=400):
    rng = random.Random(8)
    parts = {"en": "th on er ing and the of".split(), "de": "ung sch keit der ein äu die".split(), "fr": "eau oi é ment les qui tion".split(), "es": "ción ar os que la ñ ado".split()}
    return [(i, " ".join("".join(rng.choice(parts[lang]) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(5, 60))), lang) for i in range(n) for lang in [rng.choice(list(parts))]]


def test_language_of_held_out_documents(spark):
    rows = languages() + [(1000, None, "en"), (1001, "12 34 !", "de"), (1002, "", None), (None, "the thing and", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(docs.where(~langid.held_out()), per_language=60)
    got = {r.doc_id: r for r in langid.identify(docs, model).withColumn("held", langid.held_out()).collect()}
    held = [i for i, *_ in rows[:400] if got[i].held]
    assert len(held) > 80 and sum(got[i].lang_pred == rows[i][2] for i in held) >= 0.95 * len(held)
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (1000, 1001, 1002))
    assert all(0 <= r.score <= 1 for r in got.values())
    nothing = langid.train(docs.limit(0))
    assert {r.lang_pred for r in langid.identify(docs, nothing).collect()} == {"und"}


def test_rates_meet_targets_like_a_plain_solver(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    p = rng.dirichlet([0.3, 0.3, 0.3], 200)
    n = rng.integers(1, 500, 200)
    table = spark.createDataFrame([(int(i), int(n[i]), *map(float, p[i])) for i in range(200)], "doc_id long, _n long, _p0 double, _p1 double, _p2 double")
    weights = [0.7, 0.2, 0.1]
    targets = [w * float(n.sum()) for w in weights]
    got = np.array([r.rate for r in mixing.fit_rates(table, targets, weights).orderBy("doc_id").collect()])
    r, a = np.ones(200), p * n[:, None]
    scale = 1 / a.sum(0)
    step = 1 / np.linalg.eigvalsh((a.T @ p) * np.sqrt(np.outer(scale, scale))).max()
    for _ in range(20000):
        r = np.maximum(0, r - step * p @ ((a.T @ r - targets) * scale))
    assert (got >= 0).all()
    assert np.allclose(a.T @ got, targets, rtol=0.01)
    assert np.allclose(a.T @ r, targets, rtol=0.01)
    boxed = np.array([r.rate for r in mixing.fit_rates(table, None, weights, max_rate=1.0).collect()])
    assert (boxed >= 0).all() and (boxed <= 1).all()


def test_mixing_of_odd_tables(spark):
    docs = spark.createDataFrame([(1, "good fine words"), (2, None), (3, "bad bad scum"), (3, "again"), (None, "x y")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, domain string")
    rows = mixing.document_rates(docs, none).collect()
    assert sorted((str(r.doc_id), r.n_tokens) for r in rows) == [("1", 3), ("2", 0), ("3", 4), ("None", 2)]
    some = spark.createDataFrame([(1, "q1t0"), (3, "q0t0"), (9, None)], "doc_id long, domain string")
    assert mixing.document_rates(docs, some).count() == 4
    assert set(mixing.sample(docs, some).columns) == {"doc_id", "text"}
    assert mixing.document_rates(docs.limit(0), some).count() == 0


def test_mixing_plan_has_no_python(spark):
    docs = spark.createDataFrame([(1, "good fine words"), (3, "bad scum")], "doc_id long, text string")
    some = spark.createDataFrame([(1, "q1t0"), (3, "q0t0")], "doc_id long, domain string")
    plan = mixing.sample(docs, some)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|InArrow", plan)


def test_pipeline_stages_keep_columns_and_clean_documents(spark, tmp_path):
    import shutil

    source = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{source}/documents.parquet")
    first, last = docs, len(corpus_pipeline.STAGES) - 1
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, source)
        if k < last:
            assert out.columns == first.columns, name
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.count() >= 0.5 * first.count(), name
    assert docs.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    shutil.rmtree(tmp_path)
