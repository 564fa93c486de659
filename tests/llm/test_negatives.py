"""Hard negatives against brute force, and that the trees skip what they may."""

import math
import random

import numpy as np
from treeward.llm import negatives

ROWS = "vec_id long, embedding array<float>, label int, rid string, cell int"


def floored(v):
    return [math.floor(256 * float(np.float32(x))) for x in v]


def brute(rows, positives=5, negatives_=3):
    """Plain loops over every pair."""
    rows = [(i, v, floored(e), y) for i, (v, e, y) in enumerate(rows) if v is not None and y is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)]
    out = []
    for i, a, va, ya in rows:
        if a % 50:
            continue
        other = [(-sum(x * y for x, y in zip(va, vb, strict=False)), b, j, yb) for j, b, vb, yb in rows if j != i]
        for ps, p, _, _ in sorted(x for x in other if x[3] == ya)[:positives]:
            fit = sorted(x for x in other if x[3] != ya and 50 * -ps <= 100 * -x[0] <= 95 * -ps)
            out += [(a, p, r, n[1], -ps, -n[0]) for r, n in enumerate(fit[:negatives_], 1)]
    return sorted(out)


def clusters(rng, n, dim=16):
    centres = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(12)]
    return [(i, [c + rng.gauss(0, 0.15) for c in rng.choice(centres)], rng.randrange(5)) for i in range(n)]


def found(spark, rows, **how):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], ROWS)
    return sorted(tuple(r) for r in negatives.hard_negatives(df, **how).collect())


def test_hard_negatives_equal_brute_force(spark, monkeypatch):
    rng = random.Random(3)
    monkeypatch.setattr(negatives, "CHUNK", 150)  # some cells of several trees, some trees of several levels
    rows = clusters(rng, 1200)
    rows += [(2000, None, 1), (2050, [1.0] * 16, None), (2100, [float("nan")] + [0.0] * 15, 1), (2150, [None] + [0.0] * 15, 1), (None, [1.0] * 16, 1), (2200, [float("inf")] + [0.0] * 15, 2)]
    rows += [(2250, [0.0] * 16, 1), (2251, [0.0] * 16, 1), (2252, [0.0] * 16, 2)]  # zero scores
    rows += [(3000 + i, rows[50][1], i % 2) for i in range(400)]  # a group of copies, ties by id
    rows += [rows[100]] * 3 + [rows[0]]  # repeated rows, anchors too
    rows += [(5000, [2.0] * 3, 1), (5001, [], 1)]  # shorter vectors
    assert found(spark, rows) == brute(rows)


def test_few_rows_and_none(spark):
    assert found(spark, []) == []
    assert found(spark, [(0, [1.0, 0.0], 1)]) == []
    rows = [(0, [1.0, 0.0], 1), (1, [0.5, 0.0], 1), (2, [0.25, 0.0], 2), (3, [0.4, 0.0], 3), (4, [-9.0, 0.0], 4), (5, [1e30, 0.0], 5)]
    assert found(spark, rows) == brute(rows) != []


def test_trees_skip_leaves_and_stay_exact():
    rng = np.random.default_rng(1)
    centres = rng.normal(0, 300, (40, 16))
    v = np.floor(np.repeat(centres, 50, 0) + rng.normal(0, 10, (2000, 16))).astype(np.int64)
    label, ids = np.arange(2000) % 7, np.arange(2000)
    norm2 = float((v * v).sum(1).max())
    tree = negatives.CoverTree(v, label, ids, ids, norm2)
    x = negatives.augmented(v, norm2)
    assert np.allclose((x * x).sum(1), norm2)
    assert sorted(np.concatenate(tree.leaves)) == list(range(2000))
    q, rid = v[::50], ids[::50]
    every = np.full(len(q), negatives.HIGH)
    i, j, score, compared = tree.search(q, label[rid], rid, True, 5, -every, every, -every)
    assert compared < 0.25 * len(q) * len(tree.leaves)
    full = q @ v.T
    for a in range(len(q)):
        ok = (label == label[rid[a]]) & (ids != rid[a])
        want = sorted(full[a][ok])[::-1][:5]
        assert sorted(score[i == a])[::-1][:5] == want
        assert (full[a, j[i == a]] == score[i == a]).all()
    # A window that no row reaches compares nothing.
    assert tree.search(q, label[rid], rid, True, 5, every, every, -every)[3] == 0


def test_radii_cover_their_nodes():
    rng = np.random.default_rng(2)
    v = np.floor(rng.normal(0, 100, (900, 8))).astype(np.int64)
    norm2 = float((v * v).sum(1).max())
    tree = negatives.CoverTree(v, np.zeros(900, int), np.arange(900), np.arange(900), norm2)
    x = negatives.augmented(v, norm2)
    for centres, radii, _, leaf in tree.levels:
        lifted = negatives.augmented(centres, norm2)
        for at in np.flatnonzero(leaf >= 0):
            points = x[tree.leaves[leaf[at]]]
            assert np.sqrt(((points - lifted[at]) ** 2).sum(1)).max() <= radii[at] + 1e-6
