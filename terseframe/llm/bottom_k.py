"""Bottom-k sketches of shingle hashes, in DataFrame expressions only.

The sketch of a text holds the k least distinct hashes (48 bits) of its word shingles in
ascending order. Sketches of parts merge to the sketch of the whole; two sketches give
resemblance, containment and, each alone, the number of distinct shingles. A sketch of
fewer than k hashes is the whole set and its estimates are exact.
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh

K = 256
SHINGLE = 5
BITS = 48


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)` with the value computed once per row."""
    return F.element_at(F.transform(F.array(value), use), 1)


def sketch(text: Column, k: int = K, shingle: int = SHINGLE) -> Column:
    """Sketch of a text; fewer words than a shingle make one shingle, none (or null) the empty sketch."""
    words = F.filter(F.split(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    hashed = F.transform(words, lambda w: F.xxhash64(w))

    def shingles(h: Column) -> Column:
        n = F.size(h)
        whole = F.array(F.xxhash64(F.array_join(h.cast("array<string>"), " ")))
        many = F.transform(
            F.sequence(F.lit(0), F.greatest(n - shingle, F.lit(0))),
            lambda i: F.xxhash64(*[F.get(h, i + d) for d in range(shingle)]),
        )
        few = F.when(n == 0, F.array().cast("array<bigint>")).otherwise(whole)
        return F.transform(F.when(n < shingle, few).otherwise(many), lambda x: F.shiftrightunsigned(x, 64 - BITS))

    return F.slice(F.sort_array(F.array_distinct(_let(hashed, shingles))), 1, k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """Sketch of the union of two parts."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def merge_groups(df: DataFrame, keys: list[str], sketch_column: str, k: int = K) -> DataFrame:
    """Sketch of each group's union: keys and the sketch. A group of empty sketches gets an empty one.

    Distinct hashes are combined before the shuffle and every task keeps k of them per
    group, so that a group may hold any share of the rows.
    """
    low, at = fresh(df, "low_hash"), fresh(df, "low_at")
    hashes = df.select(*keys, F.explode(sketch_column).alias(low)).distinct()
    first = Window.partitionBy(*keys).orderBy(low)
    least = hashes.withColumn(at, F.row_number().over(first)).filter(F.col(at) <= k)
    merged = least.groupBy(*keys).agg(F.sort_array(F.collect_list(low)).alias(sketch_column))
    named = df.select(*keys).distinct()
    same = [named[c].eqNullSafe(merged[c]) for c in keys]
    joined = named.join(merged, same, "left")
    return joined.select(*[named[c] for c in keys], F.coalesce(merged[sketch_column], F.array().cast("array<bigint>")).alias(sketch_column))


def distinct_count(s: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles."""
    full = (F.lit(k) - 1) * F.lit(float(1 << BITS)) / F.element_at(s, -1)
    return F.when(F.size(s) < k, F.size(s).cast("double")).otherwise(full)


def _common(a: Column, b: Column, u: Column) -> Column:
    """Hashes of the merged sketch that both sides hold."""
    return F.size(F.filter(F.array_intersect(a, b), lambda x: x <= F.element_at(u, -1)))


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard likeness, 0 to 1; of two empty sketches 1."""
    share = lambda u: F.when(F.size(u) == 0, 1.0).otherwise(_common(a, b, u) / F.size(u))
    return _let(merge(a, b, k), share)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b holds; of an empty a 1."""
    both = resemblance(a, b, k) * distinct_count(merge(a, b, k), k)
    return F.when(F.size(a) == 0, 1.0).otherwise(F.least(F.lit(1.0), both / distinct_count(a, k)))


def encoded(s: Column) -> Column:
    """A sketch as text: 8 base64 signs per hash."""
    return F.base64(F.unhex(F.array_join(F.transform(s, lambda x: F.lpad(F.hex(x), BITS // 4, "0")), "")))


def with_next(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """Each row with the text of the next document in descending doc_id, after the last the first.

    Rows are dealt into doc_id ranges cut at quantiles. Every range also gets the first row
    of the range after it, so the next row is always in the same window.
    """
    spark = docs.sparkSession
    parts = parts or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    cuts = rows.stat.approxQuantile("doc_id", [i / parts for i in range(1, parts)], 0.25 / parts)
    cuts = sorted({int(c) for c in cuts})
    bounds = F.array(*[F.lit(c).cast("long") for c in cuts]) if cuts else F.array().cast("array<bigint>")
    # the number of cuts below the id, by halving; null ids come last
    def halve(step: int) -> Callable[[Column], Column]:
        return lambda p: F.when(F.get(bounds, p + (step - 1)) < F.col("doc_id"), p + step).otherwise(p)

    place = F.lit(0)
    for power in reversed(range(len(cuts).bit_length())):
        place = _let(place, halve(1 << power))
    rows = rows.withColumn("part", F.when(F.col("doc_id").isNull(), -1).otherwise(place))
    tops = rows.groupBy("part").agg(F.max("doc_id").alias("top"))  # at most `parts` rows
    ring = Window.orderBy(F.desc("part"))
    after = F.coalesce(F.lead("top").over(ring), F.first("top").over(ring))
    goes = tops.select(
        F.col("part").alias("to_part"), F.coalesce(F.lead("part").over(ring), F.first("part").over(ring)).alias("from_part"), after.alias("from_id")
    )
    heads = rows.join(F.broadcast(goes), (F.col("part") == F.col("from_part")) & F.col("doc_id").eqNullSafe(F.col("from_id")))
    heads = heads.groupBy(F.col("to_part").alias("part")).agg(F.min("text").alias("text"))
    every = rows.withColumn("head", F.lit(False)).unionByName(
        heads.select(F.lit(None).cast("long").alias("doc_id"), "text", "part", F.lit(True).alias("head"))
    )
    down = Window.partitionBy("part").orderBy("head", F.desc_nulls_last("doc_id"), "text")
    every = every.withColumn("next_text", F.lead("text").over(down))
    return every.filter("not head").drop("head", "part")


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, as the query's contract states.

    doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next,
    contained_edited, distinct_shingles. Null texts count as empty; rows that share a doc_id
    follow each other by text, a null doc_id comes last. The only document is its own next.
    """
    rows = with_next(docs)
    n = F.length("text")
    cut = F.floor(n / 3).cast("int")
    rows = rows.withColumn("n_chars", n.cast("long")).withColumn(
        "edited", F.concat(F.substring(F.col("text"), F.lit(1), n - cut), F.substring(F.col("next_text"), F.lit(1), cut))
    )
    # the next text is sketched again, so that only texts move
    rows = rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), *[
        sketch(F.col(c)).alias(f"{c}_sketch") for c in ("text", "edited", "next_text")
    ])
    a, e, x = F.col("text_sketch"), F.col("edited_sketch"), F.col("next_text_sketch")
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", encoded(a).alias("fingerprint"),
        encoded(e).alias("edited_fingerprint"), resemblance(a, e).alias("near_edited"), resemblance(a, x).alias("near_next"),
        containment(a, e).alias("contained_edited"), distinct_count(a).alias("distinct_shingles"),
    )
