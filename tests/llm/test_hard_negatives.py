import math

import numpy as np
import pytest

from velum.llm import hard_negatives as module
from velum.llm.hard_negatives import alive, fit_tree, hard_negatives, place

SCHEMA = "vec_id long, embedding array<float>, label int, leaf string, v int, score double, a int"


def brute(rows, every=10, positives=5, negatives=10):
    sound = []
    for i, x, label, *_ in rows:
        if label is None or x is None or any(c is None or not math.isfinite(c) for c in x):
            continue
        sound.append((i, [math.floor(256 * float(np.float32(c))) for c in x], label))
    out = []
    last = 1 << 63
    for i, a, label in sound:
        if i is None or i % every:
            continue
        scores = [(-sum(p * q for p, q in zip(a, b)), last if j is None else j, m) for j, b, m in sound if j is None or j != i]
        near = sorted(s[:2] for s in scores if s[2] == label)[:positives]
        for p, j in near:
            window = sorted(s[:2] for s in scores if s[2] != label and 30 * -p <= 100 * -s[0] <= 90 * -p)
            for rank, (n, k) in enumerate(window[:negatives], 1):
                out.append((i, None if j == last else j, rank, None if k == last else k, -p, -n))
    return sorted(out, key=repr)


def wide(rows):
    return [(*r, "leaf", 3, 0.5, 1) for r in rows]


def vectors():
    rnd = np.random.default_rng(4)
    centres = rnd.normal(size=(6, 8))
    rows = []
    for i in range(400):
        x = centres[i % 6] + 0.3 * rnd.normal(size=8)
        rows.append((i, (x / np.linalg.norm(x)).tolist(), int(rnd.integers(0, 4))))
    rows += [(500 + i, rows[3][1], i % 2) for i in range(40)]  # ties
    rows += [(10, rows[10][1], 2), (10, rows[10][1], 2)]  # a repeated identifier
    rows += [(None, rows[5][1], 1), (None, rows[6][1], 2)]
    rows += [(600, None, 1), (601, rows[0][1], None), (602, [1.0, None], 1), (603, [math.nan] * 8, 1)]
    rows += [(604, [math.inf] * 8, 2), (605, [], 1), (610, [0.5, 0.5], 3), (620, [0.0] * 8, 2)]
    return rows


@pytest.mark.parametrize("sample,leaf,block", [(8192, 48, 4096), (100, 8, 7), (3, 48, 4096)])
def test_equal_to_brute_force(spark, monkeypatch, sample, leaf, block):
    monkeypatch.setattr(module, "BLOCK", block)
    rows = vectors()
    df = spark.createDataFrame(wide(rows), SCHEMA).repartition(5)
    found = hard_negatives(df, anchors="vec_id % 10 = 0", sample=sample, leaf=leaf)
    assert sorted(map(tuple, found.collect()), key=repr) == brute(rows)


def test_nothing(spark):
    assert hard_negatives(spark.createDataFrame([], SCHEMA)).count() == 0
    one = spark.createDataFrame(wide([(0, [1.0], 1)]), SCHEMA)
    assert hard_negatives(one).count() == 0
    assert hard_negatives(one, anchors="vec_id = 5").count() == 0


def test_scores_that_are_not_exact_raise(spark):
    df = spark.createDataFrame(wide([(0, [1e20], 1)]), SCHEMA)
    with pytest.raises(ValueError, match="2\\^53"):
        hard_negatives(df)


def test_leaves_left_out_hold_nothing():
    """On clustered vectors most leaves are left out, and none that holds a row inside."""
    rnd = np.random.default_rng(8)
    centres = rnd.normal(size=(40, 16))
    v = np.floor(64 * (centres[rnd.integers(0, 40, 4000)] + 0.1 * rnd.normal(size=(4000, 16))))
    length = float(np.sqrt((v * v).sum(1).max()))
    tree = fit_tree(v[:1000], length)
    leaf = place(tree, v)
    for node, _, d, side in module._descend(tree, module._lifted(v, length)):
        m = len(node.points)
        node.low, node.high = np.full((m, m), np.inf), np.full((m, m), -np.inf)
        for j in np.unique(side):
            node.low[:, j], node.high[:, j] = d[side == j].min(0), d[side == j].max(0)
    anchors = v[::50]
    scores = anchors @ v.T
    high = np.sort(scores, axis=1)[:, -1:]
    low = np.sort(scores, axis=1)[:, -30:-29]
    kept = alive(tree, anchors, low, high)
    for a in range(len(anchors)):
        inside = (scores[a] >= low[a]) & (scores[a] <= high[a])
        assert kept[a, leaf[inside]].all()
    assert kept.mean() < 0.4
