"""Window functions for groups of any size.

A window over one key runs in one task. These forms first cut each group into blocks,
work inside the blocks, and carry block summaries forward. The window over the summaries
sees one row per block.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

BLOCK = 4096


def running_sum(
    df: DataFrame, keys: list[str], order: str, value: Column, out: str, block: int = BLOCK
) -> DataFrame:
    """Sum of `value` over all rows of the group up to and including this one.

    `order` is an integer column, unique in its group.
    """
    cut = df.withColumn("_v", value).withColumn("_b", F.floor(F.col(order) / block))
    totals = cut.groupBy(*keys, "_b").agg(F.sum("_v").alias("_t"))
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    # written once, so that one call after another does not double the reading of `df`
    carried = materialize(totals.select(*keys, "_b", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_carry")))
    inside = Window.partitionBy(*keys, "_b").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        cut.join(carried, [*keys, "_b"])
        .withColumn(out, F.col("_carry") + F.sum("_v").over(inside))
        .drop("_v", "_b", "_carry")
    )


def previous(
    df: DataFrame, keys: list[str], order: str, value: str, out: str, block: int = BLOCK
) -> DataFrame:
    """Value of the row before this one in its group (NULL on the first row)."""
    cut = df.withColumn("_b", F.floor(F.col(order) / block))
    last = cut.groupBy(*keys, "_b").agg(F.max_by(value, order).alias("_last"))
    carried = materialize(last.select(
        *keys, "_b", F.lag("_last").over(Window.partitionBy(*keys).orderBy("_b")).alias("_carry")
    ))
    inside = Window.partitionBy(*keys, "_b").orderBy(order)
    first = F.row_number().over(inside) == 1
    return (
        cut.join(carried, [*keys, "_b"])
        .withColumn(out, F.when(first, F.col("_carry")).otherwise(F.lag(value).over(inside)))
        .drop("_b", "_carry")
    )


def rank_rows(
    df: DataFrame, keys: list[str], order: list[Column], out: str = "rank", bounded: bool = False
) -> DataFrame:
    """1-based position of every row in its group under a total order.

    `bounded` states that the groups have a fixed upper size. Otherwise rows are range
    partitioned by (key, order) and written once, so that partition numbers stay the same
    when a task is run again; the rank is the place inside the partition plus the row
    counts of the group's earlier partitions.
    """
    if bounded:
        return df.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = materialize(
        df.repartitionByRange(parts, *keys, *order).withColumn("_p", F.spark_partition_id())
    )
    counts = placed.groupBy(*keys, "_p").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    carried = counts.select(*keys, "_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_carry"))
    inside = Window.partitionBy(*keys, "_p").orderBy(*order)
    return (
        placed.join(carried, [*keys, "_p"])
        .withColumn(out, F.col("_carry") + F.row_number().over(inside))
        .drop("_p", "_carry")
    )


def top_rows(df: DataFrame, keys: list[str], order: list[Column], k: int, out: str = "rank") -> DataFrame:
    """First `k` rows per group. Spark trims each map partition to `k` rows before the shuffle."""
    ranked = df.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.filter(F.col(out) <= k)
