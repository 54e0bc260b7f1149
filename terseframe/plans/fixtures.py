"""Inputs the registered queries derive from the given tables."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import compress as cp
from ..operators import scores
from ..operators.windows import running_sum
from ..sources.files import spread

MIN_TERM = 1


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def texts(spark: SparkSession, sf: str) -> DataFrame:
    return spread(table(spark, sf, "documents"))


def docs(spark: SparkSession, sf: str) -> DataFrame:
    return texts(spark, sf).select("doc_id", "text")


def questions(spark: SparkSession, sf: str, min_term: int = MIN_TERM) -> DataFrame:
    """One question per benchmark item: qid and its distinct words of at least `min_term` letters."""
    forms = F.transform(tx.split_words(F.col("text")), tx.term_form)
    terms = F.array_sort(F.array_distinct(F.filter(forms, lambda t: F.length(t) >= min_term)))
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), terms.alias("terms"))


def asked(spark: SparkSession, sf: str) -> DataFrame:
    """Every document with a question: doc_id, text, qid, terms, question."""
    qs = questions(spark, sf)
    n = table(spark, sf, "benchmark").agg(F.count("*").alias("n")).scalar()
    rows = docs(spark, sf).withColumn("qid", F.col("doc_id") % n).join(qs, "qid", "left")
    rows = rows.withColumn("terms", F.coalesce("terms", F.array().cast("array<string>")))
    lead = F.when(F.col("doc_id") % 7 == 0, "Is it ").otherwise("Where is ")
    return rows.withColumn("question", F.concat(lead, F.array_join("terms", " "), F.lit("?")))


def shown_questions(spark: SparkSession, sf: str) -> DataFrame:
    """qid and question, as text."""
    return questions(spark, sf).select("qid", F.concat(F.lit("Where is "), F.array_join("terms", " "), F.lit("?")).alias("question"))


def requests(spark: SparkSession, sf: str) -> DataFrame:
    """Retrieval requests: req_id, unit_idx, doc_id, text, qid; one per source, with all its documents."""
    rows = texts(spark, sf)
    n = table(spark, sf, "benchmark").agg(F.count("*").alias("n")).scalar()
    number = F.coalesce(F.expr("try_cast(regexp_extract(source, '[0-9]+', 0) AS BIGINT)"), F.lit(0))
    return rows.select(
        F.col("source").alias("req_id"), F.col("doc_id").alias("unit_idx"), "doc_id", "text", (number % n).alias("qid"),
    )


def ranked_requests(spark: SparkSession, sf: str) -> DataFrame:
    return scores.bm25(requests(spark, sf), questions(spark, sf), docs(spark, sf))


def utterances(spark: SparkSession, sf: str) -> DataFrame:
    """Conversation turns with a clock: 300 ms per word and a pause of 250 ms x (turn % 9)."""
    rows = table(spark, sf, "conversations").withColumn("n", tx.word_count(F.col("text")))
    rows = rows.withColumn("dur", F.col("n") * 300).withColumn("pause", (F.col("turn") % 9) * 250)
    rows = running_sum(rows, ["conv_id"], "turn", F.col("dur") + F.col("pause"), "end_ms")
    return rows.select(
        "conv_id", "turn", "role", "text", "n",
        (F.col("end_ms") - F.col("dur")).alias("start_ms"), "end_ms",
        F.when(F.col("role") == "user", 0).otherwise(1).alias("speaker"),
    )


def compressed_utterances(spark: SparkSession, sf: str, rate: float = 0.7) -> DataFrame:
    """Utterances with the result of keep-rate compression and a made-up latency."""
    said = utterances(spark, sf)
    turns = table(spark, sf, "conversations")
    vocab = scores.vocabulary(turns)
    out = cp.compress(turns, vocab, rate, ["conv_id", "turn"])
    out = out.select(
        "conv_id", "turn", "compressed", F.col("origin_words").alias("origin_tokens"),
        F.col("kept_words").alias("compressed_tokens"),
    )
    latency = F.when(F.col("turn") % 10 == 0, 0).otherwise(10 + F.col("n") % 50)
    return said.join(out, ["conv_id", "turn"], "left").withColumn("latency_ms", latency)


def decisions(spark: SparkSession, sf: str, rate: float = 0.5, carry: list[str] = []) -> DataFrame:
    """Both keep-decisions of every document; `carry` names what comes along of its text and question."""
    return cp.two_decisions(asked(spark, sf), scores.vocabulary(docs(spark, sf)), rate, carry=carry)
