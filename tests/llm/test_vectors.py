"""Operators 11 and 13 against plain versions in whole numbers."""

import hashlib
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import elkan, whitening
from corpusloom.llm.common import Scratch

NAN, INF = float("nan"), float("inf")


def embeddings(spark, rows):
    """rows of (vec_id, embedding), with columns named like those within."""
    return spark.createDataFrame([(*r, "x", "x", 1) for r in rows], "vec_id long, embedding array<double>, cluster string, x string, was int").repartition(3)


def lloyd(vectors, k, rounds, salt="3:"):
    """(id, vector) rows -> centroids and [(id, vector, cluster, squared distance)], by all distances."""
    digest = lambda i: (i is None, hashlib.sha256(f"{salt}{i}".encode()).hexdigest() if i is not None else "")
    centres = [v for _, v in sorted(vectors, key=lambda r: (digest(r[0]), r[1]))[:k]]
    for r in range(rounds + 1):
        own = [min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centres)) for _, v in vectors]
        if r == rounds:
            return centres, sorted((str(i), v, j, d) for (i, v), (d, j) in zip(vectors, own, strict=True))
        for j in range(len(centres)):
            mine = [v for (_, v), (_, o) in zip(vectors, own, strict=True) if o == j]
            if mine:
                centres[j] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]


@pytest.mark.parametrize(("dims", "reach", "n", "k", "rounds"), [(2, 3, 300, 8, 10), (1, 2, 60, 5, 4), (6, 1000, 400, 7, 10), (3, 1, 200, 12, 3)])
def test_elkan_equals_all_distances(spark, dims, reach, n, k, rounds):
    """Small ranges give many ties, equal first centroids and empty clusters."""
    draw = random.Random(dims)
    rows = [(draw.choice([None, i, i, i // 2]), [draw.randint(-reach, reach) for _ in range(dims)]) for i in range(n)]
    got, centres = elkan.clustered(spark.createDataFrame(rows, "vec_id long, x array<int>").repartition(4), Scratch(spark), k, rounds)
    want, told = lloyd(rows, k, rounds)
    assert centres == want
    assert sorted((str(r.vec_id), list(r.x), r.cluster, r.distance) for r in got.collect()) == told


def test_elkan_skips_distances(spark):
    draw = np.random.default_rng(3)
    rows = [(i, [int(v) for v in 1000 * (i % 4) + draw.integers(-20, 20, 5)]) for i in range(800)]
    got, _ = elkan.clustered(spark.createDataFrame(rows, "vec_id long, x array<int>"), Scratch(spark), 4, 6)
    assert got.agg(F.sum("computed")).first()[0] < 800


def test_bounds_hold():
    for squared in (0, 1, 2, 3, 2**53 + 1, 2**61 + 12345, 2**62 - 1):
        low, high = (Fraction(float(f(np.array([squared]))[0])) for f in (elkan.below, elkan.above))
        assert low * low <= squared <= high * high


def test_vectors_kept(spark):
    good = [0.5] * 64
    rows = [(1, good), (None, good), (2, None), (3, good[:-1]), (4, [None, *good[1:]]), (5, [NAN, *good[1:]]), (6, [-INF, *good[1:]]), (7, []), (1, [-0.0003, *good[1:]])]
    out = elkan.integer_vectors(embeddings(spark, rows)).collect()
    assert sorted((str(r.vec_id), r.x[0], len(r.x)) for r in out) == [("1", -1, 64), ("1", 512, 64), ("None", 512, 64)]


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [0.25] * 64), (None, [0.25] * 64), (2, [1.0, *[0.0] * 63])]])
def test_op11_small_tables(spark, tmp_path, rows):
    embeddings(spark, rows).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = elkan.op11_clusters(spark, str(tmp_path)).collect()
    assert len(got) == sum(v is not None for _, v in rows)
    if got:
        # equal first centroids: the smaller number has all, the other stays empty
        assert {(r.cluster, r.distance) for r in got} in ({(0, 0), (1, 0)}, {(0, 0), (2, 0)}) and all(r.inertia == 0 and len(r.centroid_sha256) == 64 for r in got)


def exact(vectors):
    n, dims = len(vectors), len(vectors[0])
    mean = [Fraction(sum(c), n) for c in zip(*vectors, strict=True)]
    return mean, [[sum((v[a] - mean[a]) * (v[b] - mean[b]) for v in vectors) / n for b in range(dims)] for a in range(dims)]


@pytest.mark.parametrize("offset", [0, 10**9, 2**50])
def test_covariance_is_compensated(spark, monkeypatch, offset):
    """Far from zero, where squares in doubles have no digit left; merged in many rounds."""
    monkeypatch.setattr(whitening, "FAN", 2)
    draw = random.Random(offset)
    rows = [[offset + draw.randint(-50, 50) for _ in range(4)] for _ in range(300)]
    df = spark.createDataFrame([(r,) for r in rows], "x array<long>").repartition(7)
    mean, want = exact(rows)
    got = whitening.covariance(df, "x", 4, len(rows), mean)
    assert max(abs(g - w) for a, b in zip(got, want, strict=True) for g, w in zip(a, b, strict=True)) <= Fraction(1, 10**22)


def test_pairs_lose_nothing():
    draw = np.random.default_rng(1)
    a, b = (draw.standard_normal(200) * 10.0 ** draw.integers(-8, 8, 200) for _ in range(2))
    for f, want in ((whitening.two_sum, lambda x, y: x + y), (whitening.two_product, lambda x, y: x * y)):
        high, low = f(a, b)
        assert all(Fraction(h) + Fraction(o) == want(Fraction(x), Fraction(y)) for h, o, x, y in zip(high, low, a, b, strict=True))


def test_whitening(spark):
    draw = np.random.default_rng(4)
    base = draw.standard_normal((400, 6)) @ np.diag([9.0, 5, 3, 2, 1, 0.5]) @ np.linalg.qr(draw.standard_normal((6, 6)))[0]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(base)]
    rows += [(1000 + i, rows[7][1]) for i in range(200)] + [(None, rows[3][1]), (5, None), (6, [0.0] * 5), (7, [NAN] * 6), (8, [None] * 6)]
    vectors = whitening.integer_vectors(embeddings(spark, rows))
    w = whitening.fit(vectors, Scratch(spark))
    x = {r[0]: [int(np.floor(256 * v)) for v in r[1]] for r in rows[:400]}
    distinct = [list(v) for v in {tuple(v) for v in x.values()}]
    mean, cov = exact(distinct)
    matrix = np.array([[float(v) for v in r] for r in cov])
    assert w.n == len(distinct) == 400 and w.identity_error < 1e-12
    assert np.abs(matrix @ w.components.T - w.components.T * w.values).max() < 1e-9 * w.values[0] and (np.diff(w.values) < 0).all()
    assert np.allclose(w.explained, w.values / np.trace(matrix), rtol=1e-12)
    got = whitening.whitened(vectors, w).collect()
    assert len(got) == 4 * 601
    for r in got:
        v = x[r.vec_id] if r.vec_id in x else x[3] if r.vec_id is None else x[7]
        assert r.deviation == sum((w.n * e - s) ** 2 for e, s in zip(v, w.sums, strict=True))
        assert r.whitened == pytest.approx(sum(float(e - m) * c for e, m, c in zip(v, mean, w.components[r.component - 1], strict=True)) / np.sqrt(w.values[r.component - 1]), abs=1e-12)


@pytest.mark.parametrize("vectors", [[[0.5, 0.5]], [[0.5, 0.5], [1.5, 0.5]], [[0.25]] * 3])
def test_components_without_variance(spark, vectors):
    df = whitening.integer_vectors(embeddings(spark, list(enumerate(vectors))))
    w = whitening.fit(df, Scratch(spark))
    got = whitening.whitened(df, w).collect()
    live = 1 if len({tuple(v) for v in vectors}) > 1 else 0
    assert len(got) == len(vectors) * min(4, len(vectors[0])) and w.identity_error < 1e-12
    assert sum(r.whitened is not None for r in got) == live * len(vectors) and w.explained[0] == float(live)


def test_deviations_beyond_a_long():
    rows = np.array([[2**40, 0], [3, 4]])
    assert whitening.deviations(rows, 10**6, [0, 0]) == [None, 25 * 10**12]
    assert whitening.deviations(np.array([[1, 2]]), 3, [1, 1]) == [29] and whitening.deviations(np.empty((0, 2), np.int64), 3, [1, 1]) == []


def test_op13_empty(spark, tmp_path):
    embeddings(spark, [(1, None)]).write.parquet(f"{tmp_path}/embeddings.parquet")
    assert whitening.op13_whitening(spark, str(tmp_path)).collect() == []
