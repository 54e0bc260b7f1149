"""Token, cost and size accounting; session totals for transcripts."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..session import materialize
from .windows import previous, running_sum

# fixed values: $ per million tokens
PRICES = [
    ("sonnet-4-6", 3.0, 15.0),
    ("opus-4-7", 15.0, 75.0),
    ("haiku-4-5", 1.0, 5.0),
    ("gpt-4o", 2.5, 10.0),
]
ALIASES = {
    "claude": "claude", "anthropic": "claude",
    "chatgpt": "openai", "openai": "openai", "gpt": "openai",
}
COMPRESSION_CHOICES = {
    "none": ([], "intersection"),
    "llmlingua": (["llmlingua"], "intersection"),
    "attentionrag": (["attentionrag"], "intersection"),
    "both-intersection": (["llmlingua", "attentionrag"], "intersection"),
    "both-union": (["llmlingua", "attentionrag"], "union"),
}
ANSWER_CHOICES = {
    "claude": ("claude", False), "chatgpt": ("chatgpt", False),
    "qwen": ("qwen", False), "qwen-quant": ("qwen", True),
    "lclm": ("lclm", False), "lclm-quant": ("lclm", True),
}


# --- dimension tables (fixed number of rows) ----------------------------------------------
def price_list(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PRICES, "model string, input_per_mtok double, output_per_mtok double")


def alias_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(ALIASES.items()), "alias string, provider string")


def option_tables(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    a = [(k, m, c) for k, (m, c) in COMPRESSION_CHOICES.items()]
    b = [(k, n, q) for k, (n, q) in ANSWER_CHOICES.items()]
    return (
        spark.createDataFrame(a, "compression string, methods array<string>, combine string"),
        spark.createDataFrame(b, "answerer string, backend string, quantized boolean"),
    )


def canonical_provider(df: DataFrame, column: str) -> DataFrame:
    """Provider of a trimmed, lower-cased alias; unknown names carry an error."""
    held = df.withColumn("alias", F.lower(tx.strip(F.coalesce(column, F.lit("")))))
    joined = held.join(F.broadcast(alias_table(df.sparkSession)), "alias", "left")
    return joined.withColumn("error", F.when(F.col("provider").isNull(), F.concat(F.lit("Unknown provider: "), "alias")))


# --- columns -----------------------------------------------------------------------------------
def token_stats(
    origin_tokens: Column, n_words: Column, text: Column, kept_tokens: Column, n_kept: Column, compressed: Column
) -> dict[str, Column]:
    """Uniform origin / kept / ratio with the two roundings of the two readers."""
    origin = F.coalesce(origin_tokens, n_words, tx.word_count(text))
    kept = F.coalesce(kept_tokens, n_kept, tx.word_count(compressed))
    raw = F.when(kept > 0, origin / kept)
    return {"origin": origin, "kept": kept, "ratio_2dp": F.bround(raw, 2), "ratio_1dp": tx.half_up(raw, 1)}


def hard_ratio(origin: Column, kept: Column) -> Column:
    return F.bround(origin / F.greatest(kept, F.lit(1)), 2)


def percent_saved(origin: Column, kept: Column) -> Column:
    return (1 - kept / F.greatest(origin, F.lit(1))) * 100


def input_cost(tokens: Column, per_mtok: Column) -> Column:
    return tokens / 1_000_000 * per_mtok


def kv_bytes(layers: int, heads: int, seq: Column, dim: int) -> Column:
    """Bytes of keys and values at two bytes per element."""
    return F.lit(2 * layers * heads * dim * 2).cast("bigint") * seq


def coded_kv_bytes(layers: int, heads: int, seq: Column, dim: int, bits: int, outliers: int = 0, outlier_bits: int = 0) -> Column:
    norms = 64 if outliers and outlier_bits > bits else 32
    payload = bits * (dim - outliers) + outlier_bits * outliers if norms == 64 else bits * dim
    return F.floor(F.lit(2 * layers * heads * (payload + norms)).cast("bigint") * seq / 8)


# --- sessions --------------------------------------------------------------------------------------
def session_totals(rows: DataFrame, keys: list[str]) -> DataFrame:
    """origin, compressed, saved, share saved, rows counted, mean latency without zeros."""
    origin, kept = F.sum("origin_tokens"), F.sum("compressed_tokens")
    ready = rows.filter(F.col("compressed_tokens").isNotNull())
    return ready.groupBy(*keys).agg(
        origin.alias("origin"), kept.alias("compressed"), (origin - kept).alias("saved"),
        F.round(F.when(origin > 0, (origin - kept) / origin).otherwise(0.0), 6).alias("pct_saved"),
        F.count("*").alias("utterances"),
        F.round(F.coalesce(F.avg(F.nullif("latency_ms", F.lit(0))), F.lit(0.0)), 6).alias("avg_latency"),
    )


def ratio_series(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Kept share per row, in arrival order, rows without tokens left out."""
    held = rows.filter((F.col("compressed_tokens").isNotNull()) & (F.col("origin_tokens") > 0))
    return held.select(*keys, order, (F.col("compressed_tokens") / F.col("origin_tokens")).alias("ratio"))


def hourly_projection(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Saved tokens scaled to an hour between the first start and the last end."""
    saved = F.coalesce(F.sum(F.col("origin_tokens") - F.col("compressed_tokens")), F.lit(0))
    agg = rows.groupBy(*keys).agg(
        F.count("*").alias("n"), saved.alias("saved"),
        F.min_by("start_ms", order).alias("first"), F.max_by("end_ms", order).alias("last"),
    )
    hours = F.greatest(F.lit(0.0001), (F.col("last") - F.col("first")) / 3_600_000)
    return agg.select(
        *keys, "saved",
        F.round(F.when((F.col("n") >= 2) & (F.col("saved") > 0), F.col("saved") / hours).otherwise(0.0), 4).alias("per_hour"),
    )


def sparkline(series: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Saved shares scaled to [0, 1] per session of at least two points.

    The bounds come from an aggregate joined back, so no session sits in one window; the
    series is written once for both.
    """
    series = materialize(series)
    v = 1 - F.col("ratio")
    bounds = series.groupBy(*keys).agg(F.min(v).alias("lo"), F.max(v).alias("hi"), F.count("*").alias("n"))
    held = series.join(bounds.filter("n >= 2"), keys)
    span = F.when(F.col("hi") == F.col("lo"), 1.0).otherwise(F.col("hi") - F.col("lo"))
    return held.select(*keys, order, F.round((v - F.col("lo")) / span, 6).alias("y"))


def running_totals(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Totals after each row in arrival order, for sessions of any length. `rows` is read once and written."""
    zero, rows = F.lit(0), materialize(rows)
    out = running_sum(rows, keys, order, F.coalesce("origin_tokens", zero), "origin_so_far")
    return running_sum(out, keys, order, F.coalesce("compressed_tokens", zero), "compressed_so_far")


# --- transcript timing -------------------------------------------------------------------------
def pause_gaps(rows: DataFrame, keys: list[str], order: str, cap_ms: int | None = 1500) -> DataFrame:
    """Pause before each utterance, never negative, 0 on the first, optionally capped."""
    held = previous(rows, keys, order, "end_ms", "prev_end")
    gap = F.greatest(F.col("start_ms") - F.coalesce("prev_end", "start_ms"), F.lit(0))
    return held.withColumn("gap_ms", gap if cap_ms is None else F.least(gap, F.lit(cap_ms))).drop("prev_end")


def replay_timeline(rows: DataFrame, keys: list[str], order: str, text: str = "text") -> DataFrame:
    """Emission times of a replay: per_word_ms, first_ms (first partial) and final_ms."""
    # a text is cut at blanks without dropping empty pieces, so a blank text counts one word
    n = F.size(F.split(text, rf"{tx.U}{tx.WS}+"))
    per_word = F.greatest(
        F.lit(60), F.least(F.lit(180), F.floor((F.col("end_ms") - F.col("start_ms")) / F.greatest(n, F.lit(1))))
    )
    held = pause_gaps(rows, keys, order).withColumn("n_pieces", n).withColumn("per_word_ms", per_word)
    span = F.col("gap_ms") + F.col("n_pieces") * F.col("per_word_ms")
    held = running_sum(held, keys, order, span, "final_ms")
    return held.withColumn("first_ms", F.col("final_ms") - F.col("n_pieces") * F.col("per_word_ms"))


def partials(rows: DataFrame, keys: list[str], order: str, text: str = "text") -> DataFrame:
    """Growing word prefixes of each utterance: keys.., order, i, at_ms, partial."""
    held = rows.withColumn("_w", F.split(text, rf"{tx.U}{tx.WS}+"))
    each = held.select(*keys, order, "first_ms", "per_word_ms", "_w", F.explode(F.sequence(F.lit(0), F.size("_w") - 1)).alias("i"))
    return each.select(
        *keys, order, "i",
        (F.col("first_ms") + F.col("i") * F.col("per_word_ms")).alias("at_ms"),
        F.array_join(F.slice("_w", F.lit(1), F.col("i") + 1), " ").alias("partial"),
    )
