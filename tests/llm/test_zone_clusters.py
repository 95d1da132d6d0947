"""Clusters over zone maps: brute force, bounds of boxes, the curve, edge cases."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinweave.llm import zone_clusters as Z

SCHEMA = "vec_id long, embedding array<float>, cluster string, distance int, vector string"


def order():
    return F.sha2(F.concat(F.lit("3:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)


def brute(rows, k, rounds, dim):
    kept = []
    for vec_id, e in rows:
        if e is not None and len(e) == dim and all(x is not None and math.isfinite(x) for x in e):
            kept.append((vec_id, [math.floor(1024 * float(np.float32(x))) for x in e]))
    name = lambda v: hashlib.sha256(f"3:{'' if v[0] is None else v[0]}".encode()).hexdigest()
    centroids = [v for _, v in sorted(kept, key=lambda v: (name(v), np.array(v[1], "<i4").tobytes()))[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), i) for i, c in enumerate(centroids))

    for _ in range(rounds):
        mine = [nearest(v)[1] for _, v in kept]
        for c in range(len(centroids)):
            own = [v for (_, v), m in zip(kept, mine) if m == c]
            if own:
                centroids[c] = [sum(x) // len(own) for x in zip(*own)]
    last = [(i, *nearest(v)) for i, v in kept]
    each = {c: sum(d for _, d, x in last if x == c) for c in range(k)}
    return sorted(((-1 if i is None else i), c, d, each[c], sum(each.values()), tuple(centroids[c])) for i, d, c in last)


def run(spark, rows, k, rounds, dim):
    df = spark.createDataFrame([(i, e, "x", 1, "y") for i, e in rows], SCHEMA)
    out = Z.cluster(df, order(), k=k, rounds=rounds, dim=dim)
    return sorted((-1 if r.vec_id is None else r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, tuple(r.centroid)) for r in out.collect())


def blobs(seed, n, dim, spread=0.05):
    rng = random.Random(seed)
    centres = [[rng.uniform(-1, 1) for _ in range(dim)] for _ in range(5)]
    return [(i, [x + rng.gauss(0, spread) for x in rng.choice(centres)]) for i in range(n)]


@pytest.mark.parametrize("seed, n, dim, spread", [(1, 200, 8, 0.05), (2, 150, 3, 1.0), (3, 60, 64, 0.3)])
def test_brute_force_with_ties_nulls_and_odd_vectors(spark, monkeypatch, seed, n, dim, spread):
    monkeypatch.setattr(Z, "BLOCK", 7)
    rows = blobs(seed, n, dim, spread)
    rows += rows[:9] + [(n + i, [0.25] * dim) for i in range(40)] + [(None, [-0.5] * dim), (None, [0.5] * dim)]
    rows += [(900, None), (901, []), (902, [0.1] * (dim - 1)), (903, [None] + [0.1] * (dim - 1)), (904, [float("nan")] * dim), (905, [float("inf")] + [0.0] * (dim - 1))]
    rows += [(906, [3000.0] + [0.0] * (dim - 1)), (907, [-40000.5] * dim)]
    assert run(spark, rows, 6, 4, dim) == brute(rows, 6, 4, dim)


def test_a_round_that_moves_nothing_ends_the_loop(spark, monkeypatch):
    rows = blobs(4, 80, 4, 0.01)
    want = brute(rows, 3, 50, 4)
    calls = []
    totals = Z.totals
    monkeypatch.setattr(Z, "totals", lambda *a, **k: calls.append(1) or totals(*a, **k))
    assert run(spark, rows, 3, 50, 4) == want
    assert len(calls) < 20


def test_few_vectors_none_and_too_long_ones(spark):
    assert run(spark, [], 8, 3, 4) == []
    rows = [(1, [1e30, 0.0, 0.0, 0.0]), (2, None)]
    assert run(spark, rows, 8, 3, 4) == []
    rows = [(1, [0.5] * 4), (1, [0.5] * 4), (7, [-0.5] * 4)]
    assert run(spark, rows, 8, 3, 4) == brute(rows, 8, 3, 4)


def test_no_centroid_that_is_nearest_to_a_point_of_the_box_is_dropped():
    rng = np.random.default_rng(5)
    dropped = 0
    for _ in range(300):
        centroids = rng.integers(-50, 50, (6, 3))
        a, b = rng.integers(-50, 50, (2, 3))
        low, high = np.minimum(a, b), np.maximum(a, b)
        x = np.concatenate([rng.integers(low, high + 1, (200, 3)), [low, high]])
        distance = ((x[:, None, :] - centroids) ** 2).sum(axis=2)
        found = Z.candidates(low, high, centroids)
        assert set(np.argmin(distance, axis=1)) <= set(found)
        assert (distance.min(axis=1)[:, None] == distance)[:, [c for c in range(6) if c not in found]].sum() == 0
        dropped += 6 - len(found)
    assert dropped > 300


def test_blocks_along_the_curve_have_few_candidates(spark):
    rows = blobs(6, 4000, 16, 0.05)
    fixed = Z.fixed_point(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), "vec_id", "embedding", 16, 1024)
    blocks = Z.zone_blocks(fixed, 16).collect()
    assert sorted(i for b in blocks for i in b.ids) == list(range(4000))
    centroids = np.array([[int(1024 * x) for x in rows[i][1]] for i in range(0, 4000, 500)], np.int64)
    found = []
    for b in blocks:
        x = np.frombuffer(bytes(b.vectors), "<i4").reshape(-1, 16)
        low, high, total = (np.frombuffer(bytes(v), "<i8") for v in (b.low, b.high, b.total))
        assert (x.min(axis=0) == low).all() and (x.max(axis=0) == high).all() and (x.sum(axis=0) == total).all()
        found.append(len(Z.candidates(low, high, centroids)))
    assert np.mean(found) < 0.75 * len(centroids)


@pytest.mark.parametrize("dim, bits", [(2, 4), (3, 3), (5, 2)])
def test_the_curve_visits_every_cell_in_single_steps(dim, bits):
    cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dim), axis=-1).reshape(-1, dim)
    keys = [bytes(k) for k in Z.hilbert_keys(cells, bits)]
    assert len(set(keys)) == len(keys)
    walk = cells[sorted(range(len(keys)), key=lambda i: keys[i])]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_one_vector_shared_by_most_rows_is_dealt_to_several_tasks(spark):
    rows = spark.range(4000).selectExpr("id AS vec_id", "array_repeat(cast(0.5 AS float), 4) AS embedding")
    fixed = Z.fixed_point(rows, "vec_id", "embedding", 4, 1024)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # which joins small tasks again
    try:
        sizes = Z.zone_blocks(fixed, 4).groupBy(F.spark_partition_id()).agg(F.sum(F.size("ids")).alias("n")).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert max(r.n for r in sizes) < 1500
