"""Centroid clustering beside a plain version in whole numbers."""

from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest

from parcelflow.llm import kmeans


def plain_clusters(rows, width=64, clusters=8, rounds=10, units=1024, seed=3):
    """The same clustering of a list of ``(id, vector)`` without filtering, for comparison on small tables."""
    fine = lambda v: v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)
    kept = [(i, [math.floor(units * x) for x in v]) for i, v in rows if fine(v)]
    name = lambda i: hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    centers = [v for _, v in sorted(kept, key=lambda r: (name(r[0]), r[1]))[:clusters]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centers)) for _, v in kept]

    for _ in range(rounds):
        numbers = [n for _, n in assign()]
        for n in set(numbers):
            mine = [v for (_, v), m in zip(kept, numbers) if m == n]
            centers[n] = [sum(x) // len(mine) for x in zip(*mine)]
    return [(i, n, d) for (i, _), (d, n) in zip(kept, assign())], centers


SCHEMA = "vec_id long, embedding array<double>, cluster string, center string, id string"


def vectors(width, count, seed):
    noise = random.Random(seed)
    at = [[noise.gauss(0, 1) for _ in range(width)] for _ in range(5)]
    rows = [(i, [x + noise.gauss(0, 0.2) for x in noise.choice(at)]) for i in range(count)]
    rows += [(i, rows[0][1]) for i in (0, 0, 1, None, None)]  # repeated and null ids, equal vectors
    rows += [(9, None), (10, []), (11, [1.0]), (12, [math.nan] * width), (13, [None] * width), (14, [1e300] * width)]
    rows += [(15, [math.inf] + [0.0] * (width - 1)), (None, [0.0] * width), (17, [-0.0] * width), (18, [-1e4] * width)]
    return rows


@pytest.mark.parametrize("width,count", [(6, 300), (64, 200), (1, 60), (6, 0)])
def test_equals_plain_clustering(spark, width, count):
    rows = vectors(width, count, width) if count else [(i, [float(i % 2)] * width) for i in range(3)]
    docs = spark.createDataFrame([(i, v, "x", None, "y") for i, v in rows], SCHEMA)
    got = kmeans.cluster(docs, width=width).collect()
    want, centers = plain_clusters([(i, v) for i, v in rows if v != [1e300] * width], width)
    assert sorted(((r.vec_id, r.cluster, r.distance) for r in got), key=repr) == sorted(want, key=repr)
    for r in got:
        mine = [d for _, n, d in want if n == r.cluster]
        assert (r.cluster_inertia, r.inertia, r.center) == (sum(mine), sum(d for *_, d in want), centers[r.cluster])
    assert kmeans.cluster(docs.limit(0), width=width).count() == 0


def test_bounds_keep_the_nearest_center():
    """Ties and every share of leading axes give the nearest center with the smallest number."""
    draw = np.random.default_rng(2)
    points = draw.integers(-3, 4, (500, 5))
    centers = np.vstack([points[:6], points[2:4]])
    far = ((points[:, None] - centers[None]) ** 2).sum(2)
    values, axes = np.linalg.eigh(np.cov(points.T))
    for lead in range(1, 6):
        turn = kmeans.Rotation(points.mean(0), axes[:, ::-1], lead)
        args = *turn.turned(points.astype(float)), centers, *turn.turned(centers.astype(float))
        number, best = kmeans.nearest(points, *args)
        assert (best == far.min(1)).all() and (number == far.argmin(1)).all()


def test_filter_spares_most_centers(monkeypatch, spark):
    """With clusters apart, bounds leave one center for most points, and every center is read from its own bound."""
    rows = vectors(16, 400, 3)
    docs = spark.createDataFrame([(i, v, "x", None, "y") for i, v in rows[:400]], SCHEMA)
    whole = docs.select("vec_id", kmeans.in_units(docs.embedding, 16, 1024).alias("vec"))
    turn = kmeans.Rotation.fit(whole, 16, 0.9)
    assert 1 <= turn.lead < 16
    x = np.array([r.vec for r in whole.collect()])
    lead, rest = turn.turned(x.astype(float))
    for i, j in zip(range(0, 399), range(1, 400)):
        low = ((lead[i] - lead[j]) ** 2).sum() + (rest[i] - rest[j]) ** 2
        assert low <= ((x[i] - x[j]) ** 2).sum() * (1 + 1e-9) + 1e-6


def test_digest(spark):
    found = spark.createDataFrame([(1, [3, -4])], "vec_id long, center array<long>")
    row = kmeans.center_digest(found).first()
    assert row.centroid_sha256 == hashlib.sha256(b"3,-4").hexdigest() and "center" not in row.asDict()
