"""Score providers: corpus statistics, question hits, vectors, or a user's own model.

Selection operators only read a score column, so any of these, or a joined table of
scores, can feed them.
"""

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as tx
from ..functions.bind import let
from ..session import materialize
from .lookup import ROW_BYTES, SMALL_BYTES, SMALL_CHARS, frequent, lookup, measured_bytes
from .segment import by_key, plain_words

HOT_SHARE = 100_000  # a term is hot from 1/HOT_SHARE of all words on, so at most that many are
BM25_K1, BM25_B = 1.2, 0.75


@dataclass(frozen=True)
class Vocabulary:
    """Corpus word counts, written once and shared by every plan that scores words."""

    table: DataFrame  # term, count
    bytes: int  # measured
    total: int
    limit: int = SMALL_BYTES  # up to which joins broadcast it

    @property
    def hot(self) -> DataFrame:
        if self.limit < SMALL_BYTES:
            return self.table.filter(
                (F.col("count") * HOT_SHARE >= self.total) & (F.length("term") <= SMALL_CHARS)
            )
        return frequent(self.table, "count", self.bytes, self.limit)


def word_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """Occurrences per lower-cased word. Counts are combined before the shuffle."""
    return (
        df.select(F.explode(tx.split_words(F.lower(text))).alias("term"))
        .groupBy("term").agg(F.count("*").alias("count"))
    )


def vocabulary(df: DataFrame, text: str = "text") -> Vocabulary:
    counts = materialize(word_counts(df, text))
    size, total = counts.agg(F.sum(F.octet_length("term") + ROW_BYTES), F.sum("count")).first()
    return Vocabulary(counts, size or 0, total or 0)


def counted_words(
    df: DataFrame, vocab: Vocabulary, text: str = "text", keep: list[str] = ["doc_id"], placed: bool = False
) -> DataFrame:
    """Words with their corpus count: keep.., pos, word, count. `placed`: df is partitioned by keep."""
    rows = plain_words(df if placed else by_key(df, keep, text), text, keep).withColumn("term", F.lower("word"))
    return lookup(rows, vocab.table, "term", vocab.bytes, vocab.hot, vocab.limit).select(*keep, "pos", "word", "count")


def self_information(counts: DataFrame, total: int) -> DataFrame:
    """-log2 of the relative frequency of each term."""
    return counts.withColumn("info", -F.log2(F.col("count") / F.lit(float(total))))


def join_scores(units: DataFrame, scores: DataFrame, on: list[str]) -> DataFrame:
    """Attach a user's score table; units without a score keep NULL."""
    return units.join(scores, on, "left")


# --- question hits -----------------------------------------------------------
def term_hits(body: Column, terms: Column) -> Column:
    """For each word of a stripped text: is it a question term?"""
    forms = F.split(F.lower(body), f"{tx.U}{tx.WS}+")
    return F.transform(forms, lambda w: F.array_contains(terms, F.btrim(w, F.lit(tx.TERM_EDGE))))


def hit_attention(hits: Column) -> Column:
    """10 on a question word, else a weight falling with the index inside the chunk."""
    return F.transform(hits, lambda h, i: F.when(h, 10.0).otherwise(1.0 / (i + 2)))


# --- words given a question ----------------------------------------------------
def question_successors(corpus: DataFrame, questions: DataFrame, text: str = "text") -> DataFrame:
    """qid, term, follows: how often a lower-cased word comes right after a term of the question in the corpus.

    Pairs whose first word no question names drop out before anything is shuffled; the rest is added up per task.
    """
    wanted = questions.select("qid", F.explode("terms").alias("form"))
    words = F.split(F.lower(text), f"{tx.U}{tx.WS}+")
    pair = lambda ws: F.transform(ws, lambda w, i: F.struct(F.btrim(w, F.lit(tx.TERM_EDGE)).alias("form"), F.get(ws, i + 1).alias("term")))
    held = corpus.select(F.explode(let(F.filter(words, lambda w: w != ""), pair)).alias("p")).select("p.*").filter("term is not null")
    named = held.join(wanted.select("form").distinct(), "form", "left_semi").groupBy("form", "term").agg(F.count("*").alias("n"))
    return named.join(wanted, "form").groupBy("qid", "term").agg(F.sum("n").alias("follows"))


def question_contrast(words: DataFrame, questions: DataFrame, corpus: DataFrame, vocab: Vocabulary, text: str = "text") -> DataFrame:
    """Add `score` to counted words (.., qid, word, count): log2 of how much likelier the question makes the word.

    Without the question a word has its corpus share p. With it, its share among the successors of the question's terms, the
    terms themselves counted as one successor each, smoothed by one word drawn by p.
    questions: qid, terms. A word without a question scores 0.
    """
    follows = question_successors(corpus, questions, text)
    own = questions.select("qid", F.explode("terms").alias("term")).withColumn("follows", F.lit(1).cast("bigint"))
    given = materialize(follows.unionByName(own).groupBy("qid", "term").agg(F.sum("follows").alias("follows")))
    sums = given.groupBy("qid").agg(F.sum("follows").alias("_all"))
    if measured_bytes(given) <= SMALL_BYTES:  # then the words stay where they are
        given, sums = F.broadcast(given), F.broadcast(sums)
    held = words.withColumn("term", F.lower("word")).join(given, ["qid", "term"], "left").join(sums, "qid", "left")
    share = F.col("count") / F.lit(float(max(1, vocab.total)))
    score = F.log2((F.coalesce("follows", F.lit(0)) / share + 1) / (F.coalesce("_all", F.lit(0)) + 1))
    return held.withColumn("score", F.round(score, 6)).drop("term", "follows", "_all")


# --- documents against a question ---------------------------------------------
def document_frequency(df: DataFrame, wanted: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Number of texts holding each wanted term (term, df).

    Words that no question asks for drop out before anything is shuffled.
    """
    seen = df.select(key, F.explode(F.split(F.lower(text), f"{tx.U}{tx.WS}+")).alias("w"))
    seen = seen.select(key, F.btrim("w", F.lit(tx.TERM_EDGE)).alias("term"))
    asked = seen.join(wanted.select("term").distinct(), "term", "left_semi").dropDuplicates([key, "term"])
    return asked.groupBy("term").agg(F.count("*").alias("df"))


def bm25(
    docs: DataFrame, questions: DataFrame, corpus: DataFrame, text: str = "text"
) -> DataFrame:
    """Add `score` in (0, 1): BM25 of each text for its question, squashed.

    docs: .., qid, text   questions: qid, terms   corpus: the texts idf is taken from.
    The per-question term list with its idf is joined, the sum runs inside the row.
    """
    wanted = questions.select("qid", F.explode("terms").alias("term"))
    stats = corpus.agg(F.count("*").alias("n"), F.avg(tx.word_count(F.col(text))).alias("avg_len"))
    n_docs, avg_len = stats.select("n").scalar(), stats.select("avg_len").scalar()
    freq = document_frequency(corpus, wanted, text)
    idf = F.log(1 + (n_docs - F.coalesce("df", F.lit(0)) + 0.5) / (F.coalesce("df", F.lit(0)) + 0.5))
    weighted = (
        wanted.join(freq, "term", "left")
        .select("qid", "term", idf.alias("idf"))
        .groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("term", "idf"))).alias("query"))
    )
    # texts do not move by question: the list of questions comes to them while its measured size allows
    weighted = materialize(weighted)
    weighted = F.broadcast(weighted) if measured_bytes(weighted) <= SMALL_BYTES else weighted
    held = docs.join(weighted, "qid", "left").withColumn(
        "query", F.coalesce("query", F.array().cast("array<struct<term:string,idf:double>>"))
    )
    held = held.withColumn("_avg", avg_len)

    def total(size: Column, query: Column, hits: Column) -> Column:
        # term frequencies only for the question's terms, over the few matching words
        norm = BM25_K1 * (1 - BM25_B + BM25_B * size / F.col("_avg"))
        tf = lambda x: F.size(F.filter(hits, lambda w: w == x["term"]))
        part = lambda x: let(tf(x), lambda t: x["idf"] * t * (BM25_K1 + 1) / (t + norm))
        return F.aggregate(F.transform(query, part), F.lit(0.0), lambda acc, v: acc + v)

    form = lambda w: F.btrim(w, F.lit(tx.TERM_EDGE))
    raw = let(
        F.split(tx.strip(F.lower(text)), f"{tx.U}{tx.WS}+"),
        lambda ws: let(
            F.transform("query", lambda x: x["term"]),
            lambda names: let(
                F.transform(F.filter(ws, lambda w: F.array_contains(names, form(w))), form),
                lambda hits: total(F.size(ws), F.col("query"), hits),
            ),
        ),
    )
    return held.withColumn("score", F.round(1 / (1 + F.exp(-raw)), 6)).drop("query", "_avg")


# --- vectors -------------------------------------------------------------------
def tfidf_rows(df: DataFrame, text: str = "text", keep: str = "doc_id") -> DataFrame:
    """Unit TF-IDF vectors as sparse rows (keep, term, weight), smoothed idf."""
    n_docs = df.agg(F.count("*").alias("n")).scalar()
    tf = (
        by_key(df, [keep], text)
        .select(keep, F.explode(tx.split_words(F.lower(text))).alias("term"))
        .groupBy(keep, "term").agg(F.count("*").alias("tf"))
    )
    # written once, so that the words are not cut and counted again for the join
    tf = materialize(tf)
    freq = materialize(tf.groupBy("term").agg(F.count("*").alias("df")))
    size = measured_bytes(freq)
    held = lookup(tf, freq, "term", size, frequent(freq, "df", size))
    weighted = held.withColumn("w", F.col("tf") * F.log((n_docs + 1) / (F.col("df") + 1)))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(keep)))
    return weighted.select(keep, "term", F.try_divide("w", norm).alias("weight"))


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, p: acc + p)


def cosine_to(df: DataFrame, intent: list[float], vector: str = "embedding") -> DataFrame:
    """Cosine of unit vectors to one intent vector."""
    fixed = F.array(*[F.lit(float(x)) for x in intent])
    return df.withColumn("relevance", dot(F.col(vector), fixed))


def model_scores(
    df: DataFrame, column: str, make_predict: Callable, batch_size: int = 64, width: int | None = None
) -> DataFrame:
    """Score rows with a user's model, loaded once per Python worker and fed batches."""
    shape = [[width]] if width else None
    udf = predict_batch_udf(
        make_predict, return_type=T.DoubleType(), batch_size=batch_size, input_tensor_shapes=shape
    )
    return df.withColumn("score", udf(F.col(column)))


def pair_scores(df: DataFrame, query: str, passage: str, make_predict: Callable, batch_size: int = 64) -> DataFrame:
    """Score (query, passage) pairs with a user's reranker: predict(queries, passages) -> one number each, normalised as the model likes.

    Loaded once per Python worker and fed batches of two string arrays. Null texts are handed over as empty.
    """
    udf = predict_batch_udf(make_predict, return_type=T.DoubleType(), batch_size=batch_size)
    empty = lambda c: F.coalesce(F.col(c), F.lit(""))
    return df.withColumn("score", udf(empty(query), empty(passage)))


def embed(df: DataFrame, text: str, make_predict: Callable, batch_size: int = 64, out: str = "embedding", once: bool = False) -> DataFrame:
    """Vectors of texts from a user's embedder: predict(texts) -> a row of floats each. Null texts are handed over as empty.

    With `once` each different text is embedded once and joined back, for short texts that repeat, such as questions.
    """
    udf = predict_batch_udf(make_predict, return_type=T.ArrayType(T.FloatType()), batch_size=batch_size)
    held = df.withColumn("_text", F.coalesce(F.col(text), F.lit("")))
    if not once:
        return held.withColumn(out, udf("_text")).drop("_text")
    known = held.select("_text").distinct().withColumn(out, udf("_text"))
    return held.join(known, "_text").drop("_text")
