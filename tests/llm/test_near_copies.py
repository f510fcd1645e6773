"""The parity-sketch join against brute force over all pairs."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from spanweave.llm import near_copies as nc


def texts(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(4000)]
    common = rng.sample(words, 60)
    out = []
    for size in (3, 5, 8, 12, 20, 40, 60, 90, 150, 300, 700, 1500, 3200):
        base = [rng.choice(words) for _ in range(size)]
        out += [base, base[:]]
        for share in (0.005, 0.01, 0.02, 0.03, 0.04, 0.05):
            copy = base[:]
            for _ in range(max(1, int(size * share))):
                copy[rng.randrange(size)] = rng.choice(words)
            out.append(copy)
        out += [base[: int(size * x)] for x in (0.95, 0.9, 0.86, 0.84, 0.82, 0.78)]
        out.append(common + [rng.choice(words) for _ in range(size)])
    return [" ".join(x) for x in out]


def brute(sets, num):
    parent = list(range(len(sets)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if len(a) and len(b):
                same = len(np.intersect1d(a, b, assume_unique=True))
                if 100 * same >= num * (len(a) + len(b) - same):
                    x, y = sorted((root(i), root(j)))
                    parent[y] = x
    return [root(i) for i in range(len(sets))]


@pytest.mark.parametrize(("n", "num"), [(4, 85), (5, 80), (4, 40)])
def test_linked_sets_share_a_piece_among_their_first(n, num):
    """The pigeonhole argument, for the order that all documents share: rarest first, empty pieces last."""
    for seed in range(3):
        sets = nc.shingle_sets(pa.array(texts(seed), pa.large_string()), n)
        bands = nc.Bands(num)
        given = [nc.piece_keys(x, bands) for x in sets]
        times = Counter(k for x in given for _, _, keys in x for k in keys.tolist())
        shown = []
        for x in given:
            shown.append(set())
            for _, room, keys in x:
                full = int((keys & np.uint64(1) == 0).sum())
                shown[-1].update(sorted(keys.tolist(), key=lambda k: (k & 1, times[k], k))[: room + full + 1])
        for i, a in enumerate(sets):
            for j in range(i):
                b = sets[j]
                same = len(np.intersect1d(a, b, assume_unique=True))
                if same < max(len(a), len(b)) and 100 * same >= num * (len(a) + len(b) - same):
                    assert shown[i] & shown[j], (len(a), len(b), same)
    assert len({len(nc.folded(x)) for x in sets}) > 1


@pytest.mark.parametrize(("n", "num"), [(4, 85), (5, 80), (3, 40)])
def test_components(spark, n, num):
    rows = [(i + 1, t) for i, t in enumerate(texts(7) + [None, "", " \n", "Two Words", "two words"])]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in nc.near_copies(spark.createDataFrame(rows, "doc_id long, text string"), n=n, num=num).collect()}
    sets = nc.shingle_sets(pa.array([t or "" for _, t in rows], pa.large_string()), n)
    want = brute(sets, num)
    assert got == {i: (len(sets[i - 1]), want[i - 1] + 1) for i, _ in rows}


def test_a_cluster_whose_members_drift_apart(spark):
    """Copies of one text with more and more edits, most of which aren't linked with each other, and a common passage."""
    rng = random.Random(3)
    base = [f"w{rng.randrange(3000)}" for _ in range(150)]
    out = []
    for _ in range(220):
        copy = base[:]
        for _ in range(rng.randrange(9)):
            copy[rng.randrange(150)] = f"x{rng.randrange(10**6)}"
        out.append(copy)
    out += [base[:40] + [f"y{rng.randrange(10**6)}" for _ in range(60)] for _ in range(120)]
    rows = [(1000 - i, " ".join(x)) for i, x in enumerate(out)]
    got = {r.doc_id: r.component_id for r in nc.near_copies(spark.createDataFrame(rows, "doc_id long, text string"), n=4, num=85).collect()}
    rows.sort()
    want = brute(nc.shingle_sets(pa.array([t for _, t in rows], pa.large_string()), 4), 85)
    assert got == {i: rows[want[k]][0] for k, (i, _) in enumerate(rows)}


def test_texts_of_regular_structure_have_sets_of_their_own(spark):
    one = "a"
    for _ in range(10):
        one += one.translate(str.maketrans("ab", "ba"))
    rows = [(1, one), (2, one.translate(str.maketrans("ab", "ba"))), (3, "ab" * 512), (4, "ba" * 512), (5, one)]
    got = {r.doc_id: r.component_id for r in nc.near_copies(spark.createDataFrame(rows, "doc_id long, text string"), n=4, num=85).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 4, 5: 1}
