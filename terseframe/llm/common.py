"""Shared parts: whitespace words, line cuts, connected components, fresh column names."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize

#: Upper to lower case for A-Z only, as a byte table.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def short_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Hands whole texts to Python in Arrow batches of `rows`, so that a worker holds few of them at once."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def ascii_words(text: str | None) -> list[bytes]:
    """Words `[^\\x20\\x09-\\x0D]+` of a text as UTF-8 bytes, A-Z lower-cased; null and empty give none."""
    return text.encode("utf-8", "surrogatepass").translate(LOWER).split() if text else []


def fresh(df: DataFrame, name: str) -> str:
    """`name`, lengthened until no column of `df` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of an undirected link table (a, b): (node, root), root = least node.

    Alternating large-star and small-star rounds; each round is a group-by with map-side
    minima and a join, written to the shared folder, so the lineage stays short and hubs
    can be split by adaptive execution. Nodes without a link do not appear.
    """
    edges = materialize(
        links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    mark = _mark(edges)
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(
            F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v"))
        )).alias("e")).select("e.u", "e.v").filter("u <> v").distinct()
        edges = materialize(small)
        now = _mark(edges)
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    stars = edges.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
    return stars.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _mark(edges: DataFrame) -> tuple:
    """Row count and an order-free checksum of an edge table."""
    return tuple(edges.agg(F.count("*"), F.sum(F.shiftright(F.xxhash64("u", "v"), 8))).first())
