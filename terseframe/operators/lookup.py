"""Joins against tables whose size is not known when the plan is written."""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SMALL_BYTES = 64 << 20  # a table up to this measured size is broadcast
ROW_BYTES = 48  # of a row beside its strings
SMALL_CHARS = 256


def measured_bytes(table: DataFrame) -> int:
    """Bytes of a written table's strings and rows, from one pass over it."""
    strings = [F.coalesce(F.octet_length(F.col(f.name)), F.lit(0)) for f in table.schema if f.dataType.simpleString() == "string"]
    others = [F.coalesce(F.octet_length(F.to_json(F.struct(f.name))), F.lit(0)) for f in table.schema if f.dataType.simpleString() not in ("string", "bigint", "int", "double")]
    each = F.lit(ROW_BYTES).cast("bigint")
    for part in strings + others:
        each = each + part
    return table.agg(F.sum(each)).first()[0] or 0


def frequent(table: DataFrame, count: str, table_bytes: int, limit: int = SMALL_BYTES) -> DataFrame:
    """The most counted short terms (column term) of a written table, as many as fit in `limit` bytes, from a power of two of `count` on."""
    if table_bytes <= limit:
        return table
    short = table.filter(F.length("term") <= SMALL_CHARS)
    power = F.floor(F.log2(count)).cast("int").alias("power")
    sizes = short.groupBy(power).agg(F.sum(F.octet_length("term") + ROW_BYTES).alias("bytes")).orderBy(F.desc("power")).collect()
    held, least = 0, 62  # above any count
    for row in sizes:
        held += row["bytes"]
        if held > limit:
            break
        least = row["power"]
    return short.filter(F.col(count) >= 2**least)


def counts_of(names: pa.Array, terms: pa.Array, counts: pa.Array) -> pa.Array:
    """The counts of `names` in a table of terms, null without one; both are distinct. Only the names, the few of a batch, are hashed."""
    at = pc.index_in(terms, value_set=names)
    place = np.full(len(names), -1)
    place[at.drop_null().to_numpy()] = np.flatnonzero(at.is_valid().to_numpy(zero_copy_only=False))
    return counts.take(pa.array(place, mask=place < 0))


def lookup(
    rows: DataFrame, table: DataFrame, key: str, table_bytes: int, hot: DataFrame | None = None, limit: int = SMALL_BYTES
) -> DataFrame:
    """Inner join of many `rows` to a keyed table of `table_bytes` measured bytes.

    Up to `limit` bytes the table is broadcast. Beyond that, `hot` names the keys that
    are frequent in `rows`: a set whose size is bounded by construction. Those rows
    join against the broadcast hot set; the rest shuffles, and no key left in it is frequent.
    """
    if table_bytes <= limit:
        return rows.join(F.broadcast(table), key)
    if hot is None:
        return rows.join(table, key)
    tagged = rows.join(F.broadcast(hot.withColumn("hot_key", F.lit(True))), key, "left")
    often = tagged.filter("hot_key").drop("hot_key")
    rare = tagged.filter("hot_key is null").drop("hot_key", *[c for c in hot.columns if c != key])
    return often.unionByName(rare.join(table, key).select(*often.columns))
