"""Exact top-k inner-product search by distributed histogram selection.

Vectors are scored in blocks of rows against blocks of queries. All integer scores lie in
[-m, m], m the largest squared norm. Each round counts, per query, the scores of every block in 1024
equal bins, adds the counts up over all blocks, finds the bin of the k-th largest score and
narrows the range to it, until bins are one score wide. A block reports only scores no
smaller than its own k-th largest, since the overall one cannot be lower. A last round
emits what lies above the k-th score and, of those equal to it, the k least ids of each
block; one ranking of those few settles ties.

Scores are whole numbers of 64 bits; a score beyond them counts as the end of that range (and so
do parts of vectors), which leaves it above or below all others. Blocks whose scores may
leave 64 bits, or 53 for the fast product, are found by their largest parts and computed in whole numbers of any size.

Scores are computed again in every round and never stored. Blocks bound the memory of a
task; the grid of row and query blocks spreads over the cluster and holds no hot key.
"""

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

BINS = 1024
ROWS = 4096
QUERIES = 512
EXACT = 2**53
MOST = 2**63 - 1


def whole_vectors(df: DataFrame, scale: int = 1024) -> DataFrame:
    """vec_id and v = floor(scale * x); vectors that are null, or hold null or non-finite parts, are left out."""
    parts = F.transform("embedding", lambda x: x.cast("double"))
    odd = F.exists(parts, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    kept = df.select(F.col("vec_id").cast("long").alias("vec_id"), parts.alias("x"), odd.alias("odd"))
    kept = kept.filter("vec_id is not null and x is not null and not odd")
    return kept.select("vec_id", F.transform("x", lambda x: F.floor(x * scale)).alias("v"))


def _scores(rows: pd.DataFrame, queries: pd.DataFrame) -> np.ndarray:
    """Scores (queries, rows); the own row of a query gets the least number."""
    x, q = np.stack(rows["v"].tolist()), np.stack(queries["v"].tolist())
    size = lambda a: max(1, -int(a.min(initial=0)), int(a.max(initial=0)))
    most = size(x) * size(q) * max(1, x.shape[1])
    if most < EXACT:
        s = (q.astype(np.float64) @ x.T.astype(np.float64)).astype(np.int64)
    elif most <= MOST:
        s = q.astype(np.int64) @ x.T.astype(np.int64)
    else:
        s = np.clip(q.astype(object) @ x.T.astype(object), -MOST, MOST).astype(np.int64)
    own = queries["vec_id"].to_numpy()[:, None] == rows["vec_id"].to_numpy()[None, :]
    s[own] = np.iinfo(np.int64).min
    return s


def _count(k: int, width: int, span: int) -> Callable[..., pd.DataFrame]:
    def run(rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"query_id": [], "bin": [], "n": []}).astype("int64")
        if not len(rows) or not len(queries):
            return none
        s = _scores(rows, queries)
        floor = np.partition(s, -k, axis=1)[:, -k] if s.shape[1] >= k else np.full(len(s), np.iinfo(np.int64).min + 1)
        lo = queries["lo"].to_numpy()
        r, c = np.nonzero((s >= np.maximum(np.maximum(floor, lo), np.iinfo(np.int64).min + 1)[:, None]))
        up = s[r, c].astype(np.uint64) - lo[r].astype(np.uint64)  # from the lower end, up to 64 bits
        bins = (up // np.uint64(width)).astype(np.int64)
        inside = up < np.uint64(span)
        both, n = np.unique(np.stack([r[inside], bins[inside]]), axis=1, return_counts=True)
        if not len(n):
            return none
        return pd.DataFrame({"query_id": queries["vec_id"].to_numpy()[both[0]], "bin": both[1], "n": n})

    return run


def _emit(k: int) -> Callable[..., pd.DataFrame]:
    def run(rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(rows) and len(queries):
            rows = rows.sort_values("vec_id", kind="stable")
            s, ids = _scores(rows, queries), rows["vec_id"].to_numpy()
            least = np.iinfo(np.int64).min
            for i, (query, kth) in enumerate(zip(queries["vec_id"].tolist(), queries["kth"].tolist())):
                above = np.flatnonzero(s[i] > max(kth, least))
                ties = np.flatnonzero((s[i] == kth) & (s[i] > least))[:k]
                at = np.concatenate([above, ties])
                out.append(pd.DataFrame({"query_id": query, "vec_id": ids[at], "score": s[i][at]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, row_block: int = ROWS, query_block: int = QUERIES) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k highest scores of each query, ties to the smaller vec_id.

    Both tables hold vec_id and v, an array of whole numbers. Rows with the query's own
    vec_id are no candidates; queries that repeat an id count once (the least vector). Only vectors of
    equally many parts are compared. A query with fewer than k candidates gets all of them.
    """
    vectors = materialize(vectors.select("vec_id", "v", F.size("v").alias("dim")))
    queries = queries.groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("dim", F.size("v"))
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    size, most = vectors.agg(F.count("*"), F.max(norm)).first()
    n_queries, far = queries.agg(F.count("*"), F.max(norm)).first()
    if not size or not n_queries:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    most = min(MOST, int(max(most, far) * (1 + 1e-6)) + 1)  # a bound of all scores, with a margin for rounding
    g, h = -(-size // row_block), -(-n_queries // query_block)
    rows = vectors.withColumn("g", F.pmod(F.xxhash64("vec_id"), F.lit(g))).withColumn(
        "h", F.explode(F.sequence(F.lit(0), F.lit(h - 1)))
    )
    span = 2 * most + 1
    width = -(-span // BINS)
    state = queries.withColumn("h", F.pmod(F.xxhash64("vec_id"), F.lit(h)).cast("int")).withColumn(
        "lo", F.lit(-most).cast("long")
    ).withColumn("need", F.lit(k).cast("long"))
    state = materialize(state)
    keys = ["dim", "g", "h"]
    spread = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(g - 1).cast("long")))
    while True:
        asked = state.withColumn("g", spread)
        counts = rows.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInPandas(
            _count(k, width, span), "query_id long, bin long, n long"
        ).groupBy("query_id", "bin").agg(F.sum("n").alias("n"))
        down = Window.partitionBy("query_id").orderBy(F.desc("bin"))
        counts = counts.withColumn("upto", F.sum("n").over(down))
        found = counts.join(state.select(F.col("vec_id").alias("query_id"), "need"), "query_id").filter("upto >= need")
        found = found.groupBy("query_id").agg(F.max(F.struct("bin", (F.col("n") - F.col("upto")).alias("minus_above"))).alias("b"))
        found = found.select(F.col("query_id").alias("vec_id"), "b.bin", "b.minus_above")
        # without enough candidates in range the lower end stays, and so takes all of them
        state = state.join(found, "vec_id", "left").select(
            "vec_id", "v", "dim", "h",
            F.coalesce((F.col("lo").cast("decimal(38,0)") + F.col("bin") * F.lit(width).cast("decimal(20,0)")).cast("long"), F.col("lo")).alias("lo"),
            F.coalesce(F.col("need") + F.col("minus_above"), F.col("need")).alias("need"),
        )
        state = materialize(state)
        if width == 1:
            break
        span, width = width, -(-width // BINS)
    asked = state.withColumnRenamed("lo", "kth").withColumn("g", spread)
    kept = rows.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInPandas(_emit(k), "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = kept.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
