"""Centroid clustering (Lloyd's rounds) whose nearest-centroid search goes through Walsh-Hadamard coefficients.

The transform of 64 whole numbers is exact, keeps squared distances up to the factor 64, and
gathers what vectors have in common in few coefficients. Vectors and centroids are
transformed once per round; the squared differences of their coefficients are added up from
coarse to fine (by the sign changes of the Walsh functions), 8 at a time. After the first 8, the
best centroid so far is finished for each vector; from then on every centroid whose sum is
already strictly larger than that distance is out. Those left after all 64 are compared exactly, ties to the smaller number.

A round is one pass over the vectors: tasks send, for each centroid, the count and the sums of
their vectors, at most one row per centroid and task, and Spark adds them up. Only the
centroids, a fixed number of them, come to the driver. Sums are decimals, so the
order of tasks changes nothing.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize

DIM = 64
STEP = 8
PAIRS = 1 << 17  # of vectors and centroids at once
EXACT = 1 << 24  # parts below it keep every sum in 64 bits
MOST = (1 << 63) - 1


def _walsh_order() -> np.ndarray:
    """Natural places of the Walsh functions, by sign changes: the bit-reversed Gray code."""
    return np.array([int(f"{i ^ i >> 1:06b}"[::-1], 2) for i in range(DIM)])


ORDER = _walsh_order()


def transform(x: np.ndarray) -> np.ndarray:
    """Coefficients of rows of 64 whole numbers, coarse to fine."""
    h = 1
    while h < DIM:
        x = x.reshape(len(x), -1, 2, h)
        x = np.concatenate((x[:, :, :1] + x[:, :, 1:], x[:, :, :1] - x[:, :, 1:]), axis=2).reshape(len(x), DIM)
        h *= 2
    return x[:, ORDER]


def scaled(x: np.ndarray, scale: int = 64) -> np.ndarray:
    """floor(scale * x) of finite doubles as whole numbers; beyond 64 bits the ends of that range."""
    big = np.abs(x).max(initial=0) * scale >= 2.0**62
    if not big:
        return np.floor(x * scale).astype(np.int64)
    whole = [max(-MOST - 1, min(MOST, int(v) * scale if abs(v) >= 2.0**53 else int(np.floor(v * scale)))) for v in x.ravel().tolist()]
    return np.array(whole, object).reshape(x.shape)


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the nearest centroid, squared distance) of each row; whole numbers of any size, exactly."""
    step = max(1, PAIRS // len(centroids))
    parts = [_nearest(x[i : i + step], centroids) for i in range(0, max(1, len(x)), step)]
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def _nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    most = max(int(abs(x).max(initial=0)), int(abs(centroids).max(initial=0)))
    kind = np.int64 if most < EXACT else object
    a, c = transform(x.astype(kind)), transform(centroids.astype(kind))
    rows = np.arange(len(x))
    sums = ((a[:, None, :STEP] - c[None, :, :STEP]) ** 2).sum(axis=2)
    first = sums.argmin(axis=1)
    bound = sums[rows, first] + ((a[:, STEP:] - c[first, STEP:]) ** 2).sum(axis=1)
    row, number = np.nonzero(sums <= bound[:, None])
    left = sums[row, number]
    for at in range(STEP, DIM, STEP):
        left = left + ((a[row, at : at + STEP] - c[number, at : at + STEP]) ** 2).sum(axis=1)
        stay = left <= bound[row]
        row, number, left = row[stay], number[stay], left[stay]
    least = np.minimum.reduceat(left, np.searchsorted(row, rows)) if len(x) else left  # the best of the first 8 is always left
    ties = np.flatnonzero(left == least[row])
    ties = ties[np.searchsorted(row[ties], rows)]  # in the order of the numbers
    return number[ties], left[ties] // DIM


def kept_vectors(df: DataFrame) -> DataFrame:
    """vec_id and v (doubles) of the vectors with exactly 64 parts, none null or non-finite."""
    parts = F.col("embedding").cast("array<double>")
    odd = F.exists(parts, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = df.select(F.col("vec_id").cast("long").alias("vec_id"), parts.alias("v"), odd.alias("odd"))
    return rows.filter((F.size("v") == DIM) & ~F.col("odd")).select("vec_id", "v")


def _matrix(col: pa.Array, scale: int) -> np.ndarray:
    return scaled(col.flatten().to_numpy(zero_copy_only=False).reshape(-1, DIM), scale)


def first_centroids(vectors: DataFrame, k: int, scale: int, seed: str) -> np.ndarray:
    """The k vectors with the smallest sha256 of `seed:vec_id` (null ids last, equal ids by their parts), in that order."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = vectors.select(key.alias("key"), "v").orderBy(F.asc_nulls_last("key"), "v").limit(k).collect()
    return scaled(np.array([r["v"] for r in rows], np.float64).reshape(-1, DIM), scale)


def _partial_sums(centroids: np.ndarray, scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(centroids)
        n, sums = np.zeros(k, np.int64), np.zeros((k, DIM), object)
        for batch in batches:
            x = _matrix(batch.column(0), scale)
            cluster, _ = nearest(x, centroids)
            n += np.bincount(cluster, minlength=k)
            for j in np.unique(cluster):
                part = x[cluster == j]
                fits = abs(part).max() < (1 << 62) // len(part)
                sums[j] += np.array((part if fits else part.astype(object)).sum(axis=0).tolist(), object)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_pydict({
            "cluster": pa.array(some, pa.int32()), "n": pa.array(n[some], pa.int64()),
            "sums": pa.array([[str(v) for v in sums[j]] for j in some], pa.list_(pa.string())),
        })

    return run


def _moved(vectors: DataFrame, centroids: np.ndarray, scale: int) -> np.ndarray:
    """Each centroid at the floor of the mean of its vectors; empty ones stay."""
    parts = vectors.select("v").mapInArrow(_partial_sums(centroids, scale), "cluster int, n long, sums array<string>")
    whole = [F.sum(F.col("sums")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(DIM)]
    out = centroids.astype(object)
    for r in parts.groupBy("cluster").agg(F.sum("n").alias("n"), *whole).collect():  # a row per centroid
        out[r["cluster"]] = [int(r[f"s{i}"]) // r["n"] for i in range(DIM)]
    return out


def _assigned(centroids: np.ndarray, scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cluster, far = nearest(_matrix(batch.column(1), scale), centroids)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(cluster, pa.int32()), pa.array(np.minimum(far, MOST).astype(np.int64))], ["vec_id", "cluster", "distance"]
            )

    return run


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3, scale: int = 64, seed: str = "1") -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance of every row of `vectors` (vec_id, v), written once; the final centroids).

    v holds 64 finite doubles and counts as floor(scale * x). With fewer than k vectors each
    is a centroid of its own. Repeated rows count as often as they appear and stay rows. Numbers and distances beyond 64 bits are
    set to the end of that range; nearness is decided on the exact distances.
    """
    centroids = first_centroids(vectors, k, scale, seed)
    if not len(centroids):
        return vectors.sparkSession.createDataFrame([], "vec_id long, cluster int, distance long"), centroids
    for _ in range(rounds):
        centroids = _moved(vectors, centroids, scale)
    return materialize(vectors.mapInArrow(_assigned(centroids, scale), "vec_id long, cluster int, distance long")), centroids


def clusters_with_inertia(embeddings: DataFrame, k: int = 16, rounds: int = 3) -> DataFrame:
    """The query's contract: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every kept vector.

    Vectors that are null, of another length, or hold null or non-finite parts are left out; other columns are ignored.
    Inertias beyond 64 bits are set to the end of that range.
    """
    rows, centroids = cluster(kept_vectors(embeddings), k, rounds)
    spark = embeddings.sparkSession
    far = F.sum(F.col("distance").cast("decimal(38,0)")).alias("far")
    sums = {r["cluster"]: int(r["far"]) for r in rows.groupBy("cluster").agg(far).collect()}  # a row per centroid
    whole = min(MOST, sum(sums.values()))
    marks = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    totals = spark.createDataFrame(
        [(i, min(MOST, n), whole, marks[i]) for i, n in sums.items()],
        "cluster int, cluster_inertia long, inertia long, centroid_sha256 string",
    )
    return rows.join(F.broadcast(totals), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
