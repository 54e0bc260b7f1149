"""Answer scoring, fact survival, fault attribution and per-arm reports."""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as tx
from ..functions.bind import let

# fixed values
F1_CORRECT = 0.5
FACT_SURVIVED = 0.6
TOKEN_ARMS = ["lingua", "union", "intersection"]
MODEL_ARMS = ["vanilla_llm", "llm_tq", "vanilla_lclm", "lclm_tq"]
ALL_ARMS = TOKEN_ARMS + MODEL_ARMS
LATENT_ARMS = ["vanilla_lclm", "lclm_tq"]


# --- single answers ------------------------------------------------------------------
def answer_tokens(c: Column) -> Column:
    return tx.split_words(tx.normalize_answer(c))


def token_runs(tokens: Column, side: int) -> Column:
    """(term, side, n) of the distinct tokens, sorted: one sort, no comparison of all with all."""
    def cut(words: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: (i == 0) | (F.get(words, i) != F.get(words, i - 1)))
        end = lambda at, k: F.coalesce(F.get(at, k + 1), F.size(words))
        run = lambda at, a, k: F.struct(F.get(words, a).alias("term"), F.lit(side).alias("side"), (end(at, k) - a).alias("n"))
        return let(starts, lambda at: F.transform(at, lambda a, k: run(at, a, k)))

    none = F.array().cast("array<struct<term:string,side:int,n:int>>")
    return F.when(F.size(tokens) > 0, let(F.sort_array(tokens), cut)).otherwise(none)


def shared_counts(p: Column, g: Column) -> Column:
    """(p, g): how often each token of both stands in either."""
    def meet(both: Column) -> Column:
        after = lambda i: F.get(both, i + 1)
        pair = lambda x, i: F.when(after(i)["term"] == x["term"], F.struct(x["n"].alias("p"), after(i)["n"].alias("g")))
        return F.filter(F.transform(both, pair), lambda x: x.isNotNull())

    return let(F.sort_array(F.concat(token_runs(p, 0), token_runs(g, 1))), meet)


def count_held(tokens: Column, held: Column) -> Column:
    """How many of the tokens, repeats included, are among `held` (null: none)."""
    hits = F.array_intersect(tokens, F.coalesce(held, F.array().cast("array<string>")))
    return F.aggregate(shared_counts(tokens, hits), F.lit(0), lambda n, x: n + x["p"])


@F.arrow_udf(T.ArrayType(T.StringType()))
def words_held(words: pa.Array, held: pa.Array) -> pa.Array:
    """The words, repeats included and in order, that are among `held` (null: none)."""
    parts = [pa.array([], words.type.value_type)]
    for row in range(len(words)):
        mine, known = words[row].values, held[row].values
        parts.append(parts[0] if mine is None or known is None else mine.filter(pc.is_in(mine, value_set=known)))
    offsets = np.cumsum([len(x) for x in parts], dtype=np.int32)
    return pa.ListArray.from_arrays(offsets, pa.concat_arrays(parts))


def bag_overlap(p: Column, g: Column) -> Column:
    """Sum over distinct tokens of the smaller count. It stays in the row; an answer may be as long as its text."""
    return F.aggregate(shared_counts(p, g), F.lit(0), lambda a, x: a + F.least(x["p"], x["g"]))


def token_f1(p: Column, g: Column) -> Column:
    def ratio(same: Column) -> Column:
        precision, recall = same / F.size(p), same / F.size(g)
        return F.when(same == 0, 0.0).otherwise(2 * precision * recall / (precision + recall))

    one_empty = (F.size(p) == 0) | (F.size(g) == 0)
    return F.when(one_empty, (F.size(p) == F.size(g)).cast("double")).otherwise(let(bag_overlap(p, g), ratio))


def best_f1(answer: Column, golds: Column) -> Column:
    return let(
        answer_tokens(answer),
        lambda p: F.array_max(F.transform(golds, lambda g: let(answer_tokens(g), lambda t: token_f1(p, t)))),
    )


def exact_match(answer: Column, golds: Column) -> Column:
    return let(tx.normalize_answer(answer), lambda a: F.exists(golds, lambda g: a == tx.normalize_answer(g)))


def gold_recall(golds: Column, text: Column) -> Column:
    """Best share of an alias' tokens found in the text; 0 without a usable alias."""
    def share(g: Column, held: Column) -> Column:
        found = lambda toks: count_held(toks, held) / F.size(toks)
        return let(answer_tokens(g), lambda toks: F.when(F.size(toks) > 0, found(toks)))

    best = let(answer_tokens(text), lambda held: F.array_max(F.transform(golds, lambda g: share(g, held))))
    return F.coalesce(best, F.lit(0.0))


def score_answers(answers: DataFrame, golds: DataFrame, on: str = "id") -> DataFrame:
    """Answers with known golds: adds f1, em, correct. Unknown ids are left out."""
    return score_rows(answers.join(golds, on))


def score_rows(rows: DataFrame) -> DataFrame:
    """Adds f1, em, correct to rows that hold both the answer and its golds."""
    answer, known = F.col("answer"), F.col("golds")
    return (
        rows.withColumn("f1", best_f1(answer, known))
        .withColumn("em", exact_match(answer, known))
        .withColumn("correct", F.col("f1") >= F1_CORRECT)
    )


def fault(correct: Column, golds: Column, context: Column, dropped: Column) -> Column:
    """Why a wrong answer is wrong; empty for a right one. `dropped` is NULL where the arm ran no dedup."""
    return (
        F.when(correct, "")
        .when(gold_recall(golds, context) >= FACT_SURVIVED, "READER_ERROR")
        .when(dropped.isNotNull() & (gold_recall(golds, dropped) >= FACT_SURVIVED), "MMR_OVERPRUNED")
        .otherwise("INFO_LOST_IN_COMPRESSION")
    )


# --- per arm -----------------------------------------------------------------------------
def summarize(scored: DataFrame, by: list[str] = ["arm"], single: str | None = None) -> DataFrame:
    """Mean F1, exact and correct counts per arm, optionally for single-mention questions too."""
    cols = [
        F.round(F.avg("f1"), 6).alias("mean_f1"),
        F.count_if("em").alias("em"),
        F.count_if("correct").alias("correct"),
        F.count("*").alias("total"),
    ]
    if single:
        cols += [
            F.count_if(F.col(single) & F.col("correct")).alias("single_correct"),
            F.count_if(single).alias("single_total"),
        ]
    return scored.groupBy(*by).agg(*cols)


def mean_retention(arms: DataFrame) -> DataFrame:
    """Mean retention of the known token arms and the displayed factor, one over that mean."""
    known = arms.filter(F.col("arm").isin(TOKEN_ARMS) & F.col("retention").isNotNull())
    mean = F.avg("retention")
    return known.groupBy("arm").agg(
        F.round(mean, 6).alias("retention"), F.round(F.try_divide(F.lit(1.0), mean), 6).alias("factor")
    )


def compression_cells(answers: DataFrame, retention: DataFrame) -> DataFrame:
    """Display text and notes of the compression column per arm.

    answers: arm, kv_compression_x, eff_bits, input_tokens, latent_tokens (nullable)
    """
    ratio = F.when(
        (F.col("input_tokens") != 0) & (F.col("latent_tokens") != 0), F.col("input_tokens") / F.col("latent_tokens")
    )
    means = answers.groupBy("arm").agg(
        F.avg("kv_compression_x").alias("kvx"), F.avg("eff_bits").alias("bits"), F.avg(ratio).alias("seqx")
    )
    held = means.join(retention.select("arm", F.col("retention").alias("kept")), "arm", "left")
    kv = F.when(F.col("kvx").isNotNull(), F.format_string("%.2fx KV", "kvx"))
    seq = F.when(F.col("arm").isin(LATENT_ARMS) & F.col("seqx").isNotNull(), F.format_string("%.2fx seq", "seqx"))
    model = F.concat_ws(" / ", kv, seq)
    token = F.col("arm").isin(TOKEN_ARMS)
    cell = (
        F.when(token & F.col("kept").isNull(), "—")
        .when(token, F.concat(tx.format_pct(F.col("kept")), F.format_string(" kept (%.2fx)", 1.0 / F.col("kept"))))
        .when(F.col("arm") == "vanilla_llm", "1.00x (baseline)")
        .when(model == "", "—")
        .otherwise(model)
    )
    note = (
        F.when(token & F.col("kept").isNull(), "no compressed.json")
        .when(token, "")
        .when(F.col("arm") == "vanilla_llm", "full fp16 KV")
        .otherwise(F.coalesce(F.format_string("%.2f eff_bits", "bits"), F.lit("")))
    )
    note = F.when(~token & (F.col("arm") != "vanilla_llm") & F.col("bits").isNull(), "").otherwise(note)
    return held.select("arm", cell.alias("compression"), note.alias("notes"))


def declared_arms(spark: SparkSession) -> DataFrame:
    """The seven arms in report order."""
    return spark.createDataFrame(list(enumerate(ALL_ARMS)), "ord int, arm string")


def report(summary: DataFrame, cells: DataFrame) -> DataFrame:
    """One line per arm with answers, in declared order."""
    arms = declared_arms(summary.sparkSession)
    line = F.format_string(
        "| %s | %.3f | %d/%d | %d/%d | %s | %s |",
        "arm", "mean_f1", "em", "total", "correct", "total", "compression", "notes",
    )
    return arms.join(summary, "arm").join(cells, "arm").select("ord", "arm", line.alias("line")).orderBy("ord")


def missing_arms(answers: DataFrame) -> DataFrame:
    arms = declared_arms(answers.sparkSession)
    return arms.join(answers.select("arm").distinct(), "arm", "left_anti")


def latest(records: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Last record per key in file order, combined before the shuffle."""
    rest = [c for c in records.columns if c not in keys]
    last = records.groupBy(*keys).agg(
        F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")
    )
    return last.select(*keys, "_r.*")


def work_list(examples: DataFrame, arms: list[str]) -> DataFrame:
    """Every example with every arm; the arms are a literal inside the row, not a join."""
    return examples.withColumn("arm", F.explode(F.array(*[F.lit(a) for a in arms])))


def grid(tasks: DataFrame, rates: list[float], dedup: list[bool] = [False, True]) -> DataFrame:
    """Task x rate x dedup as rows."""
    cells = [F.struct(F.lit(r).alias("rate"), F.lit(d).alias("use_dedup")) for r in rates for d in dedup]
    return tasks.withColumn("_c", F.explode(F.array(*cells))).select(*tasks.columns, "_c.*")
