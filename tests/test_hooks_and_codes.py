"""Model hooks on pairs and texts, question contrast, and packed codes with a stored state."""

import math

import numpy as np
from pyspark.sql import functions as F

from terseframe.operators import scores as sc, vectors as vq
from terseframe.plans.compress_queries import shared_words, word_lengths
from terseframe.session import scratch_path


def test_pair_scorer_and_embedder(spark):
    df = spark.createDataFrame([("a b", "b c a"), ("x", None), (None, "y"), ("a b", "")], "q string, p string")
    got = [round(r.score, 6) for r in sc.pair_scores(df, "q", "p", shared_words).collect()]
    assert got == [round(1 / (1 + math.exp(-n)), 6) for n in (2, 0, 0, 0)]
    for once in (False, True):
        rows = sc.embed(df, "q", word_lengths, once=once).collect()
        assert sorted((r.q or "", list(r.embedding)[0]) for r in rows) == [("", 0.0), ("a b", 2.0), ("a b", 2.0), ("x", 1.0)]


def test_question_makes_its_successors_likelier(spark):
    texts = ["red fox runs fast.", "the red fox sleeps", "blue fox runs", "the dog runs"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    asked = spark.createDataFrame([(1, ["red"]), (2, [])], "qid long, terms array<string>")
    vocab = sc.vocabulary(docs)
    words = sc.counted_words(docs.filter("doc_id = 0").withColumn("qid", F.lit(1)), vocab, keep=["doc_id", "qid"])
    got = {r.word: r.score for r in sc.question_contrast(words, asked, docs, vocab).collect()}
    total = 14
    # two successors of red, both fox, and red itself
    share = {"red": 2, "fox": 3, "runs": 3, "fast.": 1}
    want = {w: round(math.log2(({"red": 1, "fox": 2}.get(w, 0) / (n / total) + 1) / 4), 6) for w, n in share.items()}
    assert got == want and got["fox"] > got["runs"]
    none = sc.question_contrast(words.withColumn("qid", F.lit(2)), asked, docs, vocab)
    assert {r.score for r in none.collect()} == {0.0}


def test_packed_codes_round_trip(spark):
    rnd = np.random.default_rng(3)
    x = rnd.normal(size=(40, 16)) * np.where(np.arange(16) % 5 == 0, 9.0, 1.0)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    sink = scratch_path(spark, "packed")
    vq.append_packed(df.filter("vec_id < 30"), 0, sink, 16, 3, 5, 4)
    vq.append_packed(df.filter("vec_id >= 30"), 1, sink, 16, 3, 5, 4)
    state = vq.QuantizerState.load(spark, f"{sink}-state")
    assert state.outliers == (0, 5, 10, 15)
    rows = spark.read.parquet(sink)
    done = rows.select("vec_id", F.length("packed.codes").alias("n"), vq.unpacked_vector(F.col("packed"), state).alias("back"))
    back = {r.vec_id: (r.n, r.back) for r in done.collect()}
    assert {n for n, _ in back.values()} == {(12 * 3 + 4 * 5) // 8}
    whole = vq.mixed_round_trip(df, 16, 3, 5, list(state.outliers)).collect()
    assert all(np.allclose(back[r.vec_id][1], r.restored, rtol=1e-5, atol=1e-5) for r in whole)
    # a batch that runs again leaves the state and the other codes alone
    before = sorted(map(str, rows.collect()))
    vq.append_packed(df.filter("vec_id >= 30"), 1, sink, 16, 3, 5, 4)
    assert sorted(map(str, spark.read.parquet(sink).collect())) == before
    plain = vq.QuantizerState.of_first(df, 16, 3, 0, 4)
    assert plain.outliers == () and len(plain.parts) == 1
    assert all(len(r.p.norms) == 1 and len(r.p.codes) == 6 for r in df.select(vq.pack(F.col("embedding"), plain).alias("p")).collect())
