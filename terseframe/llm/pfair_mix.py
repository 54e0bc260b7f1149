"""Interleaving sources to target weights by Pfair scheduling.

Targets are whole numbers; their sum is the quantum. Each source is cut into blocks of
`block_docs` documents in the order of md5(doc_id). A period takes from every source as
many blocks as its target says, or what is left of it. Inside a period of S slots a source
with a blocks releases block j at slot floor(j * S / a) and must place it before
ceil((j + 1) * S / a); the earliest deadline among released blocks goes first. The shares
add up to one block per slot, so all deadlines are met, and at every slot each source has
placed less than one block more or less than its share. At the end of a period the
difference is zero, so periods can be planned apart: all documents are ranked in parallel,
and only the distinct kinds of period are scheduled. A kind ends when a source gets to its
last, partial period or runs out, so there are at most two kinds per source and one more. After that the
shares are those of the sources still left; no document is dropped or repeated.

Everything is DataFrame expressions. A source's rank is taken inside 4096 hash buckets plus
the buckets' running counts, so no source is sorted in one task.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh

BLOCK_DOCS = 64
OTHER = "(other)"


def _ranked(docs: DataFrame, targets: dict[str, int]) -> DataFrame:
    """`docs` with mix_class and mix_rank (from 0 in its class)."""
    known = F.col("source").isin(*[k for k in targets if k != OTHER])
    rows = docs.withColumn("mix_class", F.when(known, F.col("source")).otherwise(F.lit(OTHER)))
    rows = rows.withColumn("mix_key", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")))
    rows = rows.withColumn("mix_bucket", F.substring("mix_key", 1, 3))
    counts = rows.groupBy("mix_class", "mix_bucket").agg(F.count("*").alias("mix_n"))
    before = Window.partitionBy("mix_class").orderBy("mix_bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("mix_class", "mix_bucket", F.coalesce(F.sum("mix_n").over(before), F.lit(0)).alias("mix_base"))
    inside = Window.partitionBy("mix_class", "mix_bucket").orderBy("mix_key", "doc_id")
    ranked = rows.join(counts, ["mix_class", "mix_bucket"])
    return ranked.withColumn("mix_rank", F.col("mix_base") + F.row_number().over(inside) - 1).drop(
        "mix_key", "mix_bucket", "mix_base"
    )


def _kinds(docs: DataFrame, targets: dict[str, int], block_docs: int) -> DataFrame:
    """Kinds of period: lo, hi (periods lo..hi-1), takes (blocks per class), slots, base (first slot of lo)."""
    known = F.col("source").isin(*[k for k in targets if k != OTHER])
    sizes = docs.groupBy(F.when(known, F.col("source")).otherwise(F.lit(OTHER)).alias("c")).agg(F.count("*").alias("n"))
    names = F.array(*[F.lit(k) for k in targets])
    quota = F.array(*[F.lit(v) for v in targets.values()])
    blocks = sizes.agg(F.map_from_entries(F.collect_list(F.struct("c", F.ceil(F.col("n") / block_docs)))).alias("m"))
    blocks = blocks.select(
        F.transform(names, lambda k: F.coalesce(F.element_at("m", k), F.lit(0).cast("long"))).alias("have")
    ).withColumn("quota", quota)
    full = F.zip_with("have", "quota", lambda b, q: F.floor(b / q))
    ends = F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0).cast("long")), full, F.transform(full, lambda p: p + 1))))
    spans = blocks.select("have", "quota", ends.alias("ends")).select(
        "have", "quota",
        F.explode(F.arrays_zip(F.slice("ends", 1, F.size("ends") - 1).alias("lo"), F.slice("ends", 2, F.size("ends")).alias("hi"))).alias("s"),
    ).select("have", "quota", "s.lo", "s.hi")
    left = F.zip_with("have", "quota", lambda b, q: F.least(q.cast("long"), F.greatest(F.lit(0).cast("long"), b - F.col("lo") * q)))
    spans = spans.select("lo", "hi", left.alias("takes"))
    spans = spans.withColumn("slots", F.aggregate("takes", F.lit(0).cast("long"), lambda a, x: a + x)).filter("slots > 0")
    before = Window.orderBy("lo").rowsBetween(Window.unboundedPreceding, -1)  # two rows per class and one more
    return spans.withColumn("base", F.coalesce(F.sum(F.expr("(hi - lo) * slots")).over(before), F.lit(0)))


def _earliest(t: Column, state: Column) -> Column:
    """Class index with the earliest deadline among released blocks at slot t."""

    def ready(a: Column, i: Column) -> Column:
        j = F.get(state["done"], i)
        release, due = F.floor(j * F.col("slots") / a), F.ceil((j + 1) * F.col("slots") / a)
        return F.when((a > j) & (release <= t), F.struct(due.alias("due"), i.alias("i")))

    return F.array_min(F.filter(F.transform("takes", ready), lambda x: x.isNotNull()))["i"]


def period_plan(kinds: DataFrame) -> DataFrame:
    """One row per kind and slot: lo, class index, j (block of the class in the period), slot."""
    zero = F.transform("takes", lambda a: F.lit(0).cast("long"))
    start = F.struct(zero.alias("done"), F.array().cast("array<int>").alias("picks"))

    def step(state: Column, t: Column) -> Column:
        return F.element_at(F.transform(F.array(_earliest(t, state)), lambda p: F.struct(
            F.transform(state["done"], lambda d, i: F.when(i == p, d + 1).otherwise(d)).alias("done"),
            F.concat(state["picks"], F.array(p)).alias("picks"),
        )), 1)

    picks = F.aggregate(F.sequence(F.lit(0).cast("long"), F.col("slots") - 1), start, step, lambda s: s["picks"])
    rows = kinds.select("lo", "hi", "takes", "slots", "base", F.posexplode(picks).alias("slot", "i"))
    nth = Window.partitionBy("lo", "i").orderBy("slot")  # at most a quantum of rows
    return rows.withColumn("j", F.row_number().over(nth) - 1)


def mix(docs: DataFrame, targets: dict[str, int], block_docs: int = BLOCK_DOCS) -> DataFrame:
    """`docs` with mix_class, mix_rank, mix_block, mix_slot, mix_release and mix_deadline.

    `targets` maps sources to positive whole weights; OTHER takes sources not named and
    null ones (weight 1 unless given). Slots count blocks from 0 over the whole mixture;
    release and deadline are slots as well (release <= slot < deadline). Ties and repeated
    rows stay rows, in the order of md5(doc_id), doc_id. An empty table gives no rows.
    Columns of `docs` stay, but for those named as above.
    """
    if not targets or any(v < 1 for v in targets.values()):
        raise ValueError("targets need positive whole weights")
    targets = {OTHER: 1} | targets
    made = ("mix_class", "mix_rank", "mix_block", "mix_slot", "mix_release", "mix_deadline", "mix_key", "mix_bucket", "mix_n", "mix_base")
    docs = docs.drop(*[c for c in docs.columns if c.lower() in made])
    names = F.array(*[F.lit(k) for k in targets])
    quota = F.array(*[F.lit(v) for v in targets.values()])
    kinds = _kinds(docs.select("source"), targets, block_docs)
    plan = period_plan(kinds).select(
        F.col("lo").alias("p_lo"), F.col("hi").alias("p_hi"), F.element_at(names, F.col("i") + 1).alias("p_class"),
        F.col("j").alias("p_j"), "slot", "slots", "base", F.get("takes", F.col("i")).alias("a"),
    )
    at = F.array_position(names, F.col("mix_class")).cast("int")
    rows = _ranked(docs, targets).withColumn("mix_block", F.floor(F.col("mix_rank") / block_docs))
    period, nth = fresh(docs, "mix_period"), fresh(docs, "mix_j")
    rows = rows.withColumn(period, F.floor(F.col("mix_block") / F.element_at(quota, at)))
    rows = rows.withColumn(nth, F.col("mix_block") % F.element_at(quota, at))
    # at most 2 * len(targets) + 1 kinds of sum(targets) slots each
    meets = (F.col("mix_class") == F.col("p_class")) & (F.col(nth) == F.col("p_j")) & (F.col(period) >= F.col("p_lo")) & (F.col(period) < F.col("p_hi"))
    start = F.col("base") + (F.col(period) - F.col("p_lo")) * F.col("slots")
    out = rows.join(F.broadcast(plan), meets)
    return out.select(
        *docs.columns, "mix_class", "mix_rank", "mix_block", (start + F.col("slot")).alias("mix_slot"),
        (start + F.floor(F.col("p_j") * F.col("slots") / F.col("a"))).alias("mix_release"),
        (start + F.ceil((F.col("p_j") + 1) * F.col("slots") / F.col("a"))).alias("mix_deadline"),
    )


def in_order(docs: DataFrame, targets: dict[str, int], block_docs: int = BLOCK_DOCS) -> DataFrame:
    """`docs`, its columns only, as partitions and rows in the order of the mixture."""
    keys = {"mix_slot": fresh(docs, "order_slot"), "mix_rank": fresh(docs, "order_rank")}
    clash = [c for c in docs.columns if c.lower().startswith("mix_")]
    bare = docs.select(*[F.col(c).alias(f"kept_{i}_{c}") if c in clash else F.col(c) for i, c in enumerate(docs.columns)])
    rows = mix(bare, targets, block_docs).withColumnsRenamed(keys)
    order = list(keys.values())
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return rows.select(*[F.col(f"kept_{i}_{c}").alias(c) if c in clash else F.col(c) for i, c in enumerate(docs.columns)])
