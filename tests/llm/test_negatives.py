"""Hard negatives against brute force."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from cartlight.llm import hard_negatives as module
from cartlight.llm.hard_negatives import hard_negatives

SCHEMA = "vec_id bigint, label int, embedding array<float>, score bigint, place bigint, row string, anchor string, grp int, part int"


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "x", "y", 3, 4) for r in rows], SCHEMA)


def brute(rows, anchor, scale=256, positives=5, negatives=3, low=50, high=95):
    taking = []
    for i, (vec_id, label, vector) in enumerate(rows):
        if None in (vec_id, label, vector) or any(x is None or not math.isfinite(x) for x in vector):
            continue
        ints = [math.floor(scale * x) for x in vector]
        if sum(x * x for x in ints) < 1 << 62:
            taking.append((vec_id, label, ints, i))
    out = []
    for a in taking:
        if not anchor(a[0]):
            continue
        scored = sorted((-sum(x * y for x, y in zip(a[2], r[2])), r[0], r[1] == a[1]) for r in taking if r[3] != a[3])
        own = [(p, -s) for s, p, same in scored if same][:positives]
        for p, score in own:
            fit = [(n, -s) for s, n, same in scored if not same and low * score <= -100 * s <= high * score][:negatives]
            out += [(a[0], p, k + 1, n, score, s) for k, (n, s) in enumerate(fit)]
    return sorted(out)


def mined(frame, anchor, **more):
    return sorted(tuple(r) for r in hard_negatives(frame, anchor, **more).collect())


def vectors(seed, n, dims=6):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        label = rng.randrange(3)
        rows.append((k, label, [rng.choice([-0.5, 0.0, 0.25, 1.0, rng.gauss(label / 3, 0.6)]) for _ in range(dims)]))
    return rows


@pytest.mark.parametrize("block,anchors,parts", [(4096, 1024, 16), (7, 5, 3)])
def test_same_as_brute_force(spark, monkeypatch, block, anchors, parts):
    monkeypatch.setattr(module, "_BLOCK", block)
    monkeypatch.setattr(module, "_ANCHORS", anchors)
    monkeypatch.setattr(module, "_PARTS", parts)
    monkeypatch.setattr(module, "_AT_ONCE", 20)
    rows = vectors(1, 230)
    same = [0.5, 0.25, 0.5, 0.0, 1.0, 0.25]
    rows += [(300 + k, k % 3, same) for k in range(60)]  # one very common vector: ties
    rows += [(400, None, same), (401, 1, None), (402, 1, [0.1, None] + same[2:]), (403, 2, [float("nan")] + same[1:])]
    rows += [(404, 0, [float("inf")] + same[1:]), (None, 1, same), (405, 1, []), (406, 1, same[:3]), (407, 2, same + [1.0])]
    rows += [rows[10], rows[240], (20, 1, same), (500, 0, [1e30] * 6)]  # repeated rows and ids, beyond a long
    frame = table(spark, rows).repartition(5)
    got = mined(frame, F.col("vec_id") % 10 == 0)
    assert got == brute([(a, b, c and [x if x is None else _float(x) for x in c]) for a, b, c in rows], lambda i: i % 10 == 0)
    assert len(got) > 100


def _float(x):
    import numpy as np

    return float(np.float32(x))


def test_scores_of_zero_and_below(spark):
    rows = [(0, 1, [1.0, 0.0]), (1, 1, [0.0, 1.0]), (2, 0, [0.0, 3.0]), (3, 0, [0.0, 1.0]), (4, 1, [-1.0, 0.0]), (5, 0, [-0.5, 0.0])]
    got = mined(table(spark, rows), F.col("vec_id") == 0)
    assert got == [(0, 1, 1, 2, 0, 0), (0, 1, 2, 3, 0, 0)] == brute(rows, lambda i: i == 0)


def test_large_components_stay_exact(spark):
    rng = random.Random(4)
    rows = [(k, k % 2, [rng.uniform(0, 3e8) for _ in range(4)]) for k in range(40)]
    rows = [(a, b, [_float(x) for x in c]) for a, b, c in rows]
    got = mined(table(spark, rows), F.col("vec_id") < 9, scale=1)
    assert got == brute(rows, lambda i: i < 9, scale=1) and max(r[4] for r in got) > 1 << 54


def test_nothing_to_mine(spark):
    none = table(spark, [])
    assert mined(none, F.col("vec_id") % 50 == 0) == []
    rows = vectors(2, 20)
    assert mined(table(spark, rows), F.lit(None).cast("boolean")) == []
    assert mined(table(spark, [(k, 1, v) for k, _, v in rows]), F.lit(True)) == []
    assert mined(table(spark, [(k, k, v) for k, _, v in rows]), F.lit(True)) == []


def test_other_bounds(spark):
    rows = vectors(3, 90)
    got = mined(table(spark, rows), F.col("vec_id") < 30, scale=100, positives=2, negatives=7, low=10, high=100)
    assert got == brute([(a, b, [_float(x) for x in c]) for a, b, c in rows], lambda i: i < 30, 100, 2, 7, 10, 100)
