"""Hard-negative mining against all inner products, the tree's invariants, and odd rows."""

import math
import random

import numpy as np
import pytest
from conftest import plain, same

from brackwater.llm import negatives

SCHEMA = "vec_id long, embedding array<float>, label int, BLOCK string, row long"


def brute(rows):
    kept = []
    for i, (vec_id, x, label, *_) in enumerate(rows):
        if label is None or x is None or any(c is None or not math.isfinite(c) for c in x):
            continue
        if vec_id is not None and vec_id % 7 == 0:
            label = (label + 1) % 10
        kept.append((i, vec_id, label, [math.floor(256 * float(np.float32(c))) for c in x]))
    order = lambda s: (-s[0], s[1] is None, s[1] or 0, s[2])
    out = []
    for i, vec_id, label, x in kept:
        if vec_id is None or vec_id % 100:
            continue
        scored = [(sum(a * b for a, b in zip(x, y)), v, j, lab) for j, v, lab, y in kept if j != i]
        for score, v, *_ in sorted((s for s in scored if s[3] == label), key=order)[:5]:
            window = sorted((s for s in scored if s[3] != label and 80 * score <= 100 * s[0] <= 100 * score), key=order)[:5]
            out += [(vec_id, v, k, s[1], score, s[0]) for k, s in enumerate(window, 1)]
    return out


COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def check(spark, rows, **sizes):
    df = spark.createDataFrame(rows, SCHEMA).coalesce(1)
    assert plain(negatives.mine(df, **sizes).select(*COLUMNS).collect()) == plain(brute(rows))


@pytest.mark.parametrize("seed", range(3))
def test_clusters_ties_and_odd_rows(spark, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, 8))
    rows = []
    for i in range(700):
        x = centres[rng.integers(6)] + 0.3 * rng.normal(size=8)
        rows.append((i * 5, [float(np.float32(c)) for c in x], int(rng.integers(4)) if i % 3 else 1, "b", 0))
    rows += [(v, x, lab, "again", 1) for v, x, lab, *_ in rows[:40]] + [(10_000 + i, rows[3][1], i % 2, "copy", 2) for i in range(150)]
    rows += [(None, rows[0][1], 1, "", 0), (100, None, 1, "", 0), (200, rows[1][1], None, "", 0), (300, [1.0, None], 2, "", 0), (400, [float("nan")] * 8, 2, "", 0), (500, [float("inf")] * 8, 1, "", 0), (600, [0.5, 0.25], 2, "", 0), (700, [], 3, "", 0), (800, [0.0] * 8, 2, "", 0)]
    check(spark, rows, block=90, chunk=7)


def test_large_components_are_exact(spark):
    rng = random.Random(3)
    rows = [(i * 20, [float(np.float32(rng.choice([1e3, 2e5, -1e6]) * rng.random())) for _ in range(5)], i % 2, "", 0) for i in range(80)]
    check(spark, rows, block=30)


def test_tree_covers_and_bounds():
    rng = np.random.default_rng(4)
    x = np.floor(256 * np.concatenate([rng.normal(size=(900, 6)), np.repeat(rng.normal(size=(1, 6)), 300, axis=0)]))
    tree = negatives.Tree.load(negatives.Tree(np.arange(1200), np.arange(1200), np.zeros(1200, np.int64), x).dump())
    assert sorted(tree.row.tolist()) == list(range(1200)) and np.array_equal(tree.x, x[tree.row])
    below, queries = tree.children(), np.floor(256 * rng.normal(size=(20, 6)))
    search = negatives.Search(tree, queries)

    def rows_of(node):
        a, z = tree.run[node]
        return [*range(a, z), *(r for c in below[node] for r in rows_of(c))]

    assert sorted(rows_of(0)) == list(range(1200))
    for node in range(len(tree.parent)):
        scores = queries @ tree.x[rows_of(node)].T
        assert (scores <= search.high[:, [node]]).all() and (scores >= search.low[:, [node]]).all()


def test_descent_skips_nodes():
    rng = np.random.default_rng(5)
    centres = 20 * rng.normal(size=(40, 4))
    x = np.floor(256 * (centres[rng.integers(40, size=4000)] + 0.05 * rng.normal(size=(4000, 4))))
    search = negatives.Search(negatives.Tree(np.arange(4000), np.arange(4000), np.zeros(4000, np.int64), x), x[:10])
    for i in range(10):
        best = search.descend(i, lambda a, z: np.ones(z - a, bool), [(-np.inf, np.inf)])[0]
        assert sorted((int(b[0]) for b in best), reverse=True) == sorted((x @ x[i]).astype(int).tolist(), reverse=True)[:5]
        assert search.verified < 0.5 * (np.diff(search.tree.run) > 0).sum()


def test_empty_and_given(spark, sf_dir, duck):
    assert negatives.mine(spark.createDataFrame([], SCHEMA)).count() == 0
    assert negatives.mine(spark.createDataFrame([(1, [1.0], 1, "", 0)], SCHEMA)).count() == 0
    got = negatives.op13_negatives(spark, sf_dir).select(*COLUMNS)
    assert got.count() > 0
    same(got, duck, negatives.OP13_SQL)
