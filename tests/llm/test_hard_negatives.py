import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quartermark.llm import hard_negatives


def plain(rows, every, positives=5, negatives=10, low=30, high=90):
    sound = [(i, label, np.floor(256 * np.array(v, float)).astype(np.int64).astype(object)) for i, label, v in rows if label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    first = lambda found, k: sorted(found, key=lambda x: (-x[1], x[0] is None, x[0] or 0))[:k]
    dot = lambda a, b: int(sum(x * y for x, y in zip(a, b)))
    out = Counter()
    for n, (i, label, v) in enumerate(sound):
        if i is None or i % every:
            continue
        scored = [(j, dot(v, w), other) for m, (j, other, w) in enumerate(sound) if m != n]
        for p, s, _ in first([x for x in scored if x[2] == label], positives):
            inside = [x for x in scored if x[2] != label and low * s <= 100 * x[1] <= high * s]
            out.update((i, p, rank + 1, j, s, t) for rank, (j, t, _) in enumerate(first(inside, negatives)))
    return out


def mined(df, every, **more):
    got = hard_negatives.mine(df, F.col("id") % every == 0, **more)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return Counter(tuple(r) for r in got.collect())


SCHEMA = "vec_id long, embedding array<float>, label int, id string, score int"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [x if x is None else float(x) for x in v], label, "x", 1) for i, label, v in rows], SCHEMA).repartition(4)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((6, 8)) / 3
    out = []
    for i in range(600):
        v = centres[i % 6] + rng.standard_normal(8) * (0.001 if i % 3 else 0.2)
        out.append((i, int(rng.integers(3)), np.float32(v).tolist()))
    out += [(5, 1, out[10][2]), (10, 1, out[10][2]), (10, 1, out[10][2]), (20, 0, out[20][2]), (30, 2, [0.0] * 8), (None, 1, out[7][2]), (None, 0, out[8][2])]
    out += [(40, None, out[3][2]), (50, 1, None), (60, 1, [None] * 8), (70, 1, [float("nan")] + [0.0] * 7), (80, 0, [float("inf")] + [0.0] * 7)]
    return out + [(90, 7, out[3][2]), (100, 0, [0.5, 0.25]), (101, 0, []), (102, 1, [-0.5] * 8)]


def test_equals_all_pairs(spark, rows):
    df = frame(spark, rows)
    want = plain(rows, 10)
    assert sum(want.values()) > 1000
    assert mined(df, 10) == want
    assert mined(df, 10, block=7, hold=1000) == want
    assert mined(df, 10, block=60, hold=200, positives=2, negatives=3, low=-20, high=100) == plain(rows, 10, 2, 3, -20, 100)


def test_large_components(spark):
    rng = random.Random(2)
    for scale in (20.0, 4e5):  # exact in doubles, in 64-bit integers
        rows = [(i, i % 2, [rng.uniform(-scale, scale) for _ in range(5)]) for i in range(60)]
        rows = [(i, label, np.float32(v).tolist()) for i, label, v in rows]
        assert mined(frame(spark, rows), 5) == plain(rows, 5)


def test_copies_and_edges(spark):
    assert mined(frame(spark, []), 10) == Counter()
    assert mined(frame(spark, [(0, 1, [0.5, 0.5])]), 10) == Counter()
    copies = [(0, 1, [0.5, 0.5])] * 40 + [(i, 2, [0.25, 0.25 + i / 1000]) for i in range(1, 30)] + [(200, 1, [0.5, 0.5])] * 3
    assert mined(frame(spark, copies), 100) == plain(copies, 100)


def test_bounds_rule_rows_out():
    """Near anchors reuse their parent's scores: a far row is not scored again."""
    rng = np.random.default_rng(3)
    vectors = np.concatenate([rng.integers(-9, 9, (500, 16)), rng.integers(200, 220, (20, 16))])
    import pyarrow as pa

    held = hard_negatives.Held(pa.array(np.arange(520)), np.zeros(520), vectors, 1e4)
    anchors = np.full((30, 16), 100) + rng.integers(0, 2, (30, 16))
    order, parent, edge = hard_negatives.spanning_tree(anchors)
    place = np.argsort(order)
    scored = []
    plain_scores = hard_negatives.Held.scores

    class Counting(hard_negatives.Held):
        def scores(self, anchors, rows=None):
            scored.append(len(anchors) * (len(self.vectors) if rows is None else len(rows)))
            return plain_scores(self, anchors, rows)

    held.__class__ = Counting
    found = {i: set(rows.tolist()) for i, rows, _ in held.search(anchors[order], place[parent[order]], edge[order], lambda i: (200_000, 10**9))}
    exact = vectors @ anchors[order].T
    assert found == {i: set(np.flatnonzero(exact[:, i] >= 200_000).tolist()) for i in range(30)}
    assert sum(scored) < 520 + 30 * 40
