"""Centroid clustering against a brute force with whole numbers of any size."""

import hashlib
import math
import random

import numpy as np
import pytest

from terseframe.llm import hadamard_kmeans

SCHEMA = "vec_id long, embedding array<double>, label int, cluster int, distance string"


def brute(rows, k=16, rounds=3):
    kept = [(i, [math.floor(64 * x) if abs(x) < 2**50 else max(-(2**63), min(2**63 - 1, int(x) * 64)) for x in v]) for i, v in rows
            if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    key = lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1])
    centroids = [v for _, v in sorted(kept, key=key)[:k]]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c))
    assign = lambda: [min((far(v, c), j) for j, c in enumerate(centroids)) for _, v in kept]
    for _ in range(rounds):
        at = assign()
        for j in range(len(centroids)):
            own = [v for (_, v), (_, n) in zip(kept, at) if n == j]
            if own:
                centroids[j] = [sum(c) // len(own) for c in zip(*own)]
    at, most = [(min(d, 2**63 - 1), n) for d, n in assign()], 2**63 - 1
    sums = {j: min(most, sum(d for d, n in at if n == j)) for j in range(len(centroids))}
    whole = min(most, sum(d for d, _ in at))
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted((str(i), n, d, sums[n], whole, sha[n]) for (i, _), (d, n) in zip(kept, at))


def got(df):
    return sorted((str(r[0]), *tuple(r)[1:]) for r in df.collect())


def made(spark, rows):
    return spark.createDataFrame([(i, v, 1, 3, "x") for i, v in rows], SCHEMA)


@pytest.mark.parametrize("size", [0.5, 300.0, 4e6, 1e30])
def test_against_brute_force(spark, size):
    rnd = random.Random(int(size))
    centers = [[rnd.gauss(0, size) for _ in range(64)] for _ in range(9)]
    rows = [(i, [c + rnd.gauss(0, size / 3) for c in rnd.choice(centers)]) for i in range(150)]
    rows += rows[:20] + [(9, rows[3][1]), (None, rows[5][1]), (None, rows[6][1])]
    rows += [(200, None), (201, []), (202, [1.0] * 63), (203, [1.0] * 65), (204, [None] + [1.0] * 63), (205, [math.nan] + [0.0] * 63), (206, [math.inf] * 64)]
    assert got(hadamard_kmeans.clusters_with_inertia(made(spark, rows))) == brute(rows)


def test_few_equal_and_no_vectors(spark):
    rows = [(i, [float(i // 3)] * 64) for i in range(6)]
    assert got(hadamard_kmeans.clusters_with_inertia(made(spark, rows))) == brute(rows)
    rows = [(i, [1.0] * 64) for i in range(40)]
    out = hadamard_kmeans.clusters_with_inertia(made(spark, rows))
    assert got(out) == brute(rows) and {r.cluster for r in out.collect()} == {0}
    assert hadamard_kmeans.clusters_with_inertia(made(spark, [])).count() == 0


def test_transform_is_walsh_ordered_and_exact():
    rows = hadamard_kmeans.transform(np.eye(64, dtype=np.int64)).T  # a Walsh function per row
    assert [(np.diff(r) != 0).sum() for r in rows] == list(range(64))
    x = np.random.default_rng(1).integers(-99, 99, (50, 64))
    assert (hadamard_kmeans.transform(x) ** 2).sum(axis=1).tolist() == (64 * (x**2).sum(axis=1)).tolist()
