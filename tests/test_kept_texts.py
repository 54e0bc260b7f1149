"""Keep-rate compression of whole texts, token membership and TF-IDF beyond a broadcast vocabulary."""

import time
from dataclasses import replace

from pyspark.sql import functions as F

from terseframe.operators import compress as cp, evaluate as ev, scores as sc

TEXTS = [
    (1, "b a c a . . a 7 , , ! x y z z z a a"), (2, "q w e r t y u i o p"), (3, "a a a a b"), (4, ""), (5, None),
    (6, ". . . a . b"), (7, "long" * 80 + " a b " + "long" * 80 + " c"), (None, "a b"), (None, "q a ."), (8, "a z z 9 . x"), (8, "a z z 9 . x"),
]


def docs(spark):
    return spark.createDataFrame(TEXTS, "doc_id long, text string")


def test_texts_keep_what_marked_words_keep(spark):
    df = docs(spark).filter("doc_id is not null and doc_id <> 8")
    for limit in (64 << 20, 0):
        vocab = replace(sc.vocabulary(df), limit=limit)
        for rate in (0.0, 0.2, 0.5, 1.0):
            was = cp.keep_words(sc.counted_words(df, vocab), ["doc_id"], F.lit(rate))
            budget = cp.word_budget(F.lit(rate))
            now = cp.with_kept(cp.counted_texts(df, vocab, budget), budget)
            assert sorted(map(tuple, was.collect())) == sorted(map(tuple, now.select("doc_id", "words", "kept").collect()))


def test_rare_words_inside_the_budget_do_not_move(spark):
    df = spark.createDataFrame([(1, "a " * 30 + "rare1 rare2"), (2, "a b c d e f g h " * 3)], "doc_id long, text string")
    vocab = replace(sc.vocabulary(df), limit=0)
    full = sc.vocabulary(df).table

    class Cut(type(vocab)):
        hot = property(lambda self: full.filter("count >= 3"))

    held = cp.counted_texts(df, Cut(full, vocab.bytes, vocab.total, 0), cp.word_budget(F.lit(0.5)))
    nulls = {r.doc_id: sum(x["count"] is None for x in r["_w"]) for r in held.collect()}
    assert nulls == {1: 2, 2: 0}


def test_rates_share_their_words(spark):
    df = docs(spark).filter("doc_id < 8")
    vocab = sc.vocabulary(df)
    rows = cp.compress_rates(df, vocab, [0.75, 0.5], ["doc_id"]).collect()
    for rate in (0.75, 0.5):
        one = {r.doc_id: r.compressed for r in cp.compress(df, vocab, rate).collect()}
        assert one == {r.doc_id: r.compressed for r in rows if r.rate == rate}


def test_long_answers_are_not_compared_token_by_token(spark):
    rows = spark.range(1).select(F.transform(F.sequence(F.lit(0), F.lit(19_999)), lambda i: F.concat(F.lit("w"), i.cast("string"))).alias("p"))
    rows = rows.select("p", F.reverse("p").alias("g")).localCheckpoint()
    began = time.monotonic()
    got = rows.select(ev.bag_overlap(F.col("p"), F.col("g")), ev.count_held(F.col("p"), F.slice("g", 1, 10_000))).first()
    assert tuple(got) == (20_000, 10_000) and time.monotonic() - began < 10


def test_shared_tokens(spark):
    rows = spark.createDataFrame([(list("aabbc"), list("abbbd")), ([], ["a"]), (["a"], []), (list("ax"), None)], "p array<string>, g array<string>")
    got = rows.select(ev.bag_overlap(F.col("p"), F.coalesce("g", F.array())).alias("n"), ev.count_held(F.col("p"), F.col("g")).alias("h"), ev.words_held("p", "g").alias("w"))
    assert [tuple(r) for r in got.collect()] == [(3, 4, list("aabb")), (0, 0, []), (0, 0, []), (0, 0, [])]
