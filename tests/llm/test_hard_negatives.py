"""Mining of hard negatives against scores in plain Python integers."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from terraweave.llm import hard_negatives

SCHEMA = "vec_id long, embedding array<double>, label int, uid string, score string, groups int"


def plain(data, positives=5, negatives=10):
    kept = [(i, [math.floor(256 * x) for x in v], lab) for i, v, lab, *_ in data
            if lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    first = lambda rows, n: sorted(rows, key=lambda r: (-r[0], r[1] is None, r[1] or 0))[:n]
    out = []
    for i, v, lab in kept:
        if i is None or i % 100:
            continue
        scored = [(dot(v, w), j, own) for j, w, own in kept if j != i]
        for p, pid, _ in first([s for s in scored if s[2] == lab], positives):
            fits = [s for s in scored if s[2] != lab and 30 * p <= 100 * s[0] <= 90 * p]
            out += [(i, pid, r, nid, p, n) for r, (n, nid, _) in enumerate(first(fits, negatives), 1)]
    return sorted(out, key=str)


def mined(spark, data):
    df = spark.createDataFrame([(*r[:3], "c", "c", 1) for r in data], SCHEMA).repartition(4)
    return sorted((tuple(r) for r in hard_negatives.mine(df, F.col("vec_id") % 100 == 0).collect()), key=str)


def vectors(rng, n, dims, labels, spread=0.2):
    return [(i, [rng.gauss(0.05, spread) for _ in range(dims)], rng.randrange(labels)) for i in range(n)]


def test_all_anchors(spark, monkeypatch):
    """Several blocks and cells, a label with a third of the rows, ties, odd rows."""
    monkeypatch.setattr(hard_negatives, "BLOCK", 64)
    monkeypatch.setattr(hard_negatives, "ANCHORS", 2)
    monkeypatch.setattr(hard_negatives, "CELL", 200)
    rng = random.Random(4)
    data = vectors(rng, 700, 20, 4)
    data = [(i, v, 0 if i % 3 == 0 else lab) for i, v, lab in data]
    data += [(1000 + i, data[5][1], i % 2) for i in range(30)]  # ties
    data += [data[7], data[8], (100, data[100][1], data[100][2])]  # repeated rows, a repeated anchor
    data += [(None, data[3][1], 1), (2000, None, 1), (2100, data[2][1], None), (2200, [0.1, None], 1), (2300, [float("nan")] * 20, 1),
             (2400, [float("inf")] * 20, 1), (2500, [], 1), (2600, [0.5, 0.25], 2), (2700, [0.3] * 33, 0), (2800, [3.0e4] * 20, 1)]
    assert mined(spark, data) == plain(data)


def test_few_rows(spark):
    rng = random.Random(5)
    assert mined(spark, []) == []
    assert mined(spark, [(1, [0.5] * 4, 1)]) == []  # no anchor
    assert mined(spark, [(0, [0.5] * 4, 1)]) == []
    data = [(0, [0.5, 0.5], 1), (1, [0.5, 0.5], 1), (2, [0.25, 0.25], 2), (3, [-0.5, 0.1], 2)] + vectors(rng, 3, 2, 2)[2:]
    assert mined(spark, data) == plain(data)


@pytest.mark.parametrize("spread,dims", [(0.2, 64), (30.0, 24), (1e6, 9), (0.0, 1)])
def test_scores_are_exact(spread, dims):
    rng = np.random.default_rng(1)
    a, c = (hard_negatives.integers(rng.normal(0, spread, (n, -(-dims // 8) * 8)), 256.0) for n in (7, 50))
    got = hard_negatives.scores(hard_negatives.subset_sums(a), hard_negatives.bit_planes(c))
    assert (got == (c.astype(object) @ a.T.astype(object))).all()
