"""Rotated scalar quantization of embedding tables, with size and distortion reports."""

import json
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MIN_NORM = 1e-10
FLOAT_BITS, NORM_BITS = 16, 32
UNIT = NormalDist()


# --- parameters: at most 256 levels and one d x d matrix, made on the driver ------------
@lru_cache
def codebook(bits: int, dim: int, rounds: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """Centroids and interior boundaries of the Lloyd-Max quantizer for N(0, 1/dim).

    Starts at the level quantiles. A cell's mean is a difference of densities over a
    difference of probabilities; the densities are clipped at six sigma.
    """
    k, sigma = 2**bits, dim**-0.5
    pdf, cdf = np.vectorize(UNIT.pdf), np.vectorize(UNIT.cdf)
    c = np.array([UNIT.inv_cdf((2 * i + 1) / (2 * k)) for i in range(k)]) * sigma
    for _ in range(rounds):
        edges = np.concatenate([[-np.inf], (c[:-1] + c[1:]) / 2, [np.inf]]) / sigma
        lo, hi = np.clip(edges[:-1], -6, 6), np.clip(edges[1:], -6, 6)
        mass = np.concatenate([[0.0], cdf(edges[1:-1]), [1.0]])
        mass = np.diff(mass)
        mean = sigma * (pdf(lo) - pdf(hi))
        new = np.where(mass > 1e-15, mean / np.maximum(mass, 1e-300), sigma * (lo + hi) / 2)
        if np.allclose(c, new, atol=1e-12):
            break
        c = new
    return c, (c[:-1] + c[1:]) / 2


@lru_cache
def rotation(dim: int, seed: int = 42) -> np.ndarray:
    """Random orthogonal matrix: QR of a seeded Gaussian with the diagonal of R made positive."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    sign = np.sign(np.diag(r))
    return q * np.where(sign == 0, 1.0, sign)


# --- Arrow functions -----------------------------------------------------------------------
def rotate(vector: Column, dim: int, seed: int = 42) -> Column:
    m = rotation(dim, seed)

    @F.pandas_udf("array<double>")
    def apply(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            x = np.stack(s.to_numpy()).astype(np.float64) if len(s) else np.empty((0, dim))
            x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), MIN_NORM)
            yield pd.Series(list(x @ m.T))

    return apply(vector)


def quantize(vector: Column, dim: int, bits: int, seed: int = 42) -> Column:
    """STRUCT<code, norm>: level index per rotated coordinate and the vector length."""
    m, (_, edges) = rotation(dim, seed), codebook(bits, dim)

    @F.pandas_udf("code array<smallint>, norm double")
    def apply(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            x = np.stack(s.to_numpy()).astype(np.float64) if len(s) else np.empty((0, dim))
            n = np.maximum(np.linalg.norm(x, axis=1), MIN_NORM)
            codes = np.searchsorted(edges, (x / n[:, None]) @ m.T, side="left").astype(np.int16)
            yield pd.DataFrame({"code": list(codes), "norm": n})

    return apply(vector)


def dequantize(code: Column, norm: Column, dim: int, bits: int, seed: int = 42) -> Column:
    m, (centroids, _) = rotation(dim, seed), codebook(bits, dim)

    @F.pandas_udf("array<double>")
    def apply(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for c, n in batches:
            idx = np.stack(c.to_numpy()).astype(np.int64) if len(c) else np.empty((0, dim), np.int64)
            yield pd.Series(list((centroids[idx] @ m) * n.to_numpy()[:, None]))

    return apply(code, norm)


def round_trip(df: DataFrame, dim: int, bits: int, seed: int = 42, vector: str = "embedding") -> DataFrame:
    held = df.withColumn("q", quantize(F.col(vector), dim, bits, seed))
    return held.withColumn("restored", dequantize(F.col("q.code"), F.col("q.norm"), dim, bits, seed)).drop("q")


def distortion(df: DataFrame, by: list[str], vector: str = "embedding", restored: str = "restored") -> DataFrame:
    """Mean squared error per vector, relative to its squared length, and mean cosine."""
    pair = F.arrays_zip(F.col(vector).alias("a"), F.col(restored).alias("b"))
    total = lambda f: F.aggregate(pair, F.lit(0.0), lambda acc, p: acc + f(p["a"].cast("double"), p["b"]))
    held = df.select(
        *by, total(lambda a, b: (a - b) * (a - b)).alias("err"), total(lambda a, b: a * a).alias("aa"),
        total(lambda a, b: b * b).alias("bb"), total(lambda a, b: a * b).alias("ab"),
    )
    return held.groupBy(*by).agg(
        F.count("*").alias("n"), F.round(F.avg("err"), 6).alias("mse"),
        F.round(F.avg(F.try_divide("err", "aa")), 6).alias("relative_mse"),
        F.round(F.avg(F.try_divide(F.col("ab"), F.sqrt(F.col("aa") * F.col("bb")))), 6).alias("cosine"),
    )


# --- channels -----------------------------------------------------------------------------------
def channel_rms(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """Root mean square of every dimension over all vectors; sums combine before the shuffle."""
    rows = df.select(F.posexplode(vector).alias("dim", "x")).withColumn("x", F.col("x").cast("double"))
    return rows.groupBy("dim").agg(F.round(F.sqrt(F.avg(F.col("x") * F.col("x"))), 9).alias("rms"))


def outlier_channels(rms: DataFrame, n: int) -> DataFrame:
    """The `n` dimensions of largest RMS, ties by dimension."""
    return rms.orderBy(F.desc("rms"), "dim").limit(n)


def split_channels(vector: Column, outliers: list[int], dim: int) -> tuple[Column, Column]:
    """Regular and outlier sub-vectors; the index lists have at most `dim` entries."""
    pick = lambda idx: F.transform(F.array(*[F.lit(i) for i in idx]), lambda i: F.get(vector, i))
    return pick([i for i in range(dim) if i not in set(outliers)]), pick(sorted(outliers))


def mixed_round_trip(
    df: DataFrame, dim: int, bits: int, outlier_bits: int, outliers: list[int], vector: str = "embedding"
) -> DataFrame:
    """Round trip with the outlier channels coded apart, at more bits, by their own rotation."""
    if not outliers or outlier_bits <= bits:
        return round_trip(df, dim, bits, vector=vector)
    n = len(outliers)
    regular, special = split_channels(F.col(vector), outliers, dim)
    held = df.withColumn("_r", regular).withColumn("_o", special)
    held = round_trip(held, dim - n, bits, 42, "_r").withColumnRenamed("restored", "_rr")
    held = round_trip(held, n, outlier_bits, 43, "_o").withColumnRenamed("restored", "_oo")
    rest = [i for i in range(dim) if i not in set(outliers)]
    place = {d: F.get("_rr", F.lit(i)) for i, d in enumerate(rest)} | {
        d: F.get("_oo", F.lit(i)) for i, d in enumerate(sorted(outliers))
    }
    return held.withColumn("restored", F.array(*[place[d] for d in range(dim)])).drop("_r", "_o", "_rr", "_oo")


# --- packed codes with a stored state -----------------------------------------------------------
@dataclass(frozen=True)
class QuantizerState:
    """What a table's codes were made with: kept once, so that codes appended later can be read beside the first.

    rotations and centroids hold two entries, for the regular and for the outlier channels.
    """

    dim: int
    bits: tuple[int, int]
    outliers: tuple[int, ...]
    rotations: tuple[np.ndarray, np.ndarray]
    centroids: tuple[np.ndarray, np.ndarray]

    @staticmethod
    def of_first(batch: DataFrame, dim: int, bits: int, outlier_bits: int, n_outliers: int, vector: str = "embedding") -> "QuantizerState":
        """The outlier channels are those of largest RMS in the first batch, and stay."""
        n = n_outliers if outlier_bits > bits else 0
        found = sorted(r["dim"] for r in outlier_channels(channel_rms(batch, vector), n).collect())  # at most dim numbers
        sizes = (dim - len(found), len(found))
        return QuantizerState(
            dim, (bits, outlier_bits), tuple(found), tuple(rotation(d, seed) if d else np.empty((0, 0)) for d, seed in zip(sizes, (42, 43))),
            tuple(codebook(b, d)[0] if d else np.empty(0) for b, d in zip((bits, outlier_bits), sizes)),
        )

    def save(self, spark: SparkSession, path: str) -> None:
        plain = {
            "dim": self.dim, "bits": self.bits, "outliers": self.outliers, "rotations": [m.tolist() for m in self.rotations],
            "centroids": [c.tolist() for c in self.centroids],
        }
        spark.createDataFrame([(json.dumps(plain),)], "value string").coalesce(1).write.mode("overwrite").text(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> "QuantizerState":
        x = json.loads(spark.read.text(path).first()[0])
        n = len(x["outliers"])
        square = lambda m, d: np.array(m, np.float64).reshape(d, d)
        return QuantizerState(
            x["dim"], tuple(x["bits"]), tuple(x["outliers"]), (square(x["rotations"][0], x["dim"] - n), square(x["rotations"][1], n)),
            tuple(np.array(c, np.float64) for c in x["centroids"]),
        )

    @property
    def parts(self) -> list[tuple[list[int], int, np.ndarray, np.ndarray]]:
        """(channels, bits, rotation, centroids) of the regular and, where there are any, of the outlier channels."""
        regular = [i for i in range(self.dim) if i not in set(self.outliers)]
        every = zip((regular, list(self.outliers)), self.bits, self.rotations, self.centroids)
        return [p for p in every if p[0]]


def pack(vector: Column, state: QuantizerState) -> Column:
    """STRUCT<codes, norms>: the level numbers of both kinds of channels in a string of bits, and a 32-bit norm for each kind."""

    @F.pandas_udf("codes binary, norms array<float>")
    def apply(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            x = np.stack(s.to_numpy()).astype(np.float64) if len(s) else np.empty((0, state.dim))
            bits, norms = [], []
            for channels, width, turn, centroids in state.parts:
                v = x[:, channels]
                n = np.maximum(np.linalg.norm(v, axis=1), MIN_NORM)
                code = np.searchsorted((centroids[:-1] + centroids[1:]) / 2, (v / n[:, None]) @ turn.T, side="left")
                bits.append((code[:, :, None] >> np.arange(width)[::-1] & 1).reshape(len(x), -1).astype(np.uint8))
                norms.append(n)
            rows = np.packbits(np.concatenate(bits, axis=1), axis=1)
            yield pd.DataFrame({"codes": [r.tobytes() for r in rows], "norms": list(np.stack(norms, axis=1).astype(np.float32))})

    return apply(vector)


def unpack(codes: Column, state: QuantizerState) -> Column:
    """STRUCT<regular, outlier>: the level numbers of a packed vector."""

    @F.pandas_udf("regular array<smallint>, outlier array<smallint>")
    def apply(s: pd.Series) -> pd.DataFrame:
        rows = np.frombuffer(b"".join(s), np.uint8).reshape(len(s), -1) if len(s) else np.empty((0, 0), np.uint8)
        bits, at, out = np.unpackbits(rows, axis=1), 0, []
        for channels, width, _, _ in state.parts:
            part = bits[:, at : at + width * len(channels)].reshape(len(s), len(channels), width)
            out.append((part @ (1 << np.arange(width)[::-1])).astype(np.int16))
            at += width * len(channels)
        out += [np.empty((len(s), 0), np.int16)] * (2 - len(out))
        return pd.DataFrame({"regular": list(out[0]), "outlier": list(out[1])})

    return apply(codes)


def unpacked_vector(packed: Column, state: QuantizerState) -> Column:
    """The vector that a packed one stands for, from its codes and norms."""

    @F.pandas_udf("array<double>")
    def apply(regular: pd.Series, outlier: pd.Series, norms: pd.Series) -> pd.Series:
        out = np.empty((len(norms), state.dim))
        scale = np.stack(norms.tolist()).astype(np.float64) if len(norms) else np.empty((0, 2))
        for k, (part, (channels, _, turn, centroids)) in enumerate(zip((regular, outlier), state.parts)):
            code = np.stack(part.tolist()).astype(np.int64) if len(part) else np.empty((0, len(channels)), np.int64)
            out[:, channels] = (centroids[code] @ turn) * scale[:, k : k + 1]
        return pd.Series(list(out))

    codes = unpack(packed["codes"], state)
    return apply(codes["regular"], codes["outlier"], packed["norms"])


def append_packed(
    batch: DataFrame, number: int, sink: str, dim: int, bits: int, outlier_bits: int, n_outliers: int, vector: str = "embedding"
) -> None:
    """One micro-batch of newly arrived vectors: coded with the state beside the sink, which the first batch makes.

    Earlier codes are left alone; a batch that runs again overwrites its own.
    """
    spark, path = batch.sparkSession, f"{sink}-state"
    if number == 0:
        QuantizerState.of_first(batch, dim, bits, outlier_bits, n_outliers, vector).save(spark, path)
    state = QuantizerState.load(spark, path)
    batch.withColumn("packed", pack(F.col(vector), state)).drop(vector).write.mode("overwrite").parquet(f"{sink}/batch={number}")


# --- sizes ----------------------------------------------------------------------------------------
def coded_bits(size: Column, bits: int, outliers: int = 0, outlier_bits: int = 0) -> Column:
    mixed = outliers > 0 and outlier_bits > bits
    if not mixed:
        return size * bits + NORM_BITS
    return (size - outliers) * bits + outliers * outlier_bits + 2 * NORM_BITS


def effective_bits(dim: int, bits: int, outliers: int = 0, outlier_bits: int = 0) -> float:
    mixed = outliers > 0 and outlier_bits > bits
    return ((dim - outliers) * bits + outliers * outlier_bits) / dim if mixed else float(bits)


def size_report(df: DataFrame, dim: int, plans: list[tuple[int, int, int]], vector: str = "embedding") -> DataFrame:
    """Stored bits, effective bits and the factor against 16-bit floats, one row per plan."""
    cells = [
        F.struct(
            F.lit(b).alias("bits"), F.lit(n).alias("outliers"), F.lit(ob).alias("outlier_bits"),
            F.lit(effective_bits(dim, b, n, ob)).alias("eff_bits"),
            coded_bits(F.size(vector), b, n, ob).cast("bigint").alias("coded"),
        )
        for b, n, ob in plans
    ]
    rows = df.select(F.size(vector).alias("d"), F.explode(F.array(*cells)).alias("p")).select("d", "p.*")
    return rows.groupBy("bits", "outliers", "outlier_bits", "eff_bits").agg(
        F.sum("coded").alias("stored_bits"), F.sum(F.col("d").cast("bigint") * FLOAT_BITS).alias("float_bits"),
    ).withColumn("factor", F.round(F.col("float_bits") / F.col("stored_bits"), 6))


def fit_codebook(values: DataFrame, column: str, levels: int, rounds: int = 10) -> list[float]:
    """Data-fitted levels: each round averages the values nearest to each level on Spark.

    Starts at equal steps between the least and the greatest value; a level that no value
    is nearest to stays. Only the level means (at most 256 rows) come back to the driver.
    """
    low, high = values.agg(F.min(column), F.max(column)).first()
    if low is None:
        return [0.0] * levels
    c = [low + (high - low) * (2 * i + 1) / (2 * levels) for i in range(levels)]
    for _ in range(rounds):
        edges = F.array(*[F.lit((a + b) / 2) for a, b in zip(c, c[1:])])
        level = F.size(F.filter(edges, lambda e: F.col(column) > e))
        means = {r["lv"]: r["m"] for r in values.groupBy(level.alias("lv")).agg(F.avg(column).alias("m")).collect()}
        new = [means.get(i, x) for i, x in enumerate(c)]
        if np.allclose(c, new, atol=1e-12):
            break
        c = new
    return c
