"""Evaluation compress on texts without words, both decisions of a text, counts of its words, places of given words, similar sentences."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from terseframe.operators import compress as cp, dedup, merge as mg, scores as sc
from terseframe.operators.lookup import counts_of

TEXTS = [(1, "A b c. D e f g. H i."), (2, ""), (3, " \n"), (4, None), (5, "\xa0"), (6, ". . ."), (None, " ")]


@pytest.fixture()
def docs(spark):
    return spark.createDataFrame([(i, t, ["a", "d"]) for i, t in TEXTS], "doc_id long, text string, terms array<string>")


def test_texts_without_words_give_no_cell(docs):
    rows = cp.eval_compress(docs, sc.vocabulary(docs), [0.75, 0.5], 0.8, 3, 6).collect()
    assert sorted((r.doc_id, r.use_dedup, r.rate, r.origin_words) for r in rows) == [
        (i, d, r, n) for i, n in ((1, 9), (6, 3)) for d in (False, True) for r in (0.5, 0.75)
    ]


def test_documents_without_words_score_nothing(docs):
    units = docs.filter("doc_id is not null").select(F.lit("r").alias("req_id"), F.col("doc_id").alias("unit_idx"), "text", "terms")
    cells = cp.eval_compress_documents(units, sc.vocabulary(docs), [0.5], 0.8, 6)
    got = sorted((r.use_dedup, r["rank"], r.unit_idx, r.score > 0) for r in cells.collect())
    assert got == [(False, 1, 1, True), (False, 6, 6, False), (True, 1, 1, True), (True, 6, 6, False)]
    total = cp.eval_document_totals(cells, units).collect()
    assert {(r.use_dedup, r.total_units, r.origin_words, tuple(r.kept_indices)) for r in total} == {(d, 6, 12, (1, 6)) for d in (False, True)}


def test_both_decisions_share_a_worker_and_short_batches(spark, docs, monkeypatch):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    vocab, known = sc.vocabulary(docs), docs.filter("doc_id is not null")
    rows = []
    for held in (cp.HELD_WORDS, 1):
        monkeypatch.setattr(cp, "HELD_WORDS", held)
        both = cp.two_decisions(known, vocab, 0.5)
        plan = both._jdf.queryExecution().executedPlan().toString()
        assert plan.partition("== Initial Plan")[0].count("ArrowEvalPython") == 2  # the cut with both decisions, the words that stay
        rows.append(sorted(both.select("doc_id", "words", "kept", "guided").collect()))
    assert rows[0] == rows[1] and [r.doc_id for r in rows[0]] == [1, 6]
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "1000"


def test_counts_of_names():
    terms, counts = pa.array(["a", "b", "c"]), pa.array([3, 2, 1])
    assert counts_of(pa.array(["x", "c", "a", ""]), terms, counts).to_pylist() == [None, 1, 3, None]
    assert counts_of(pa.array([], pa.string()), terms, counts).to_pylist() == []
    assert counts_of(pa.array(["a"]), terms[:0], counts[:0]).to_pylist() == [None]


def test_words_are_located_once_although_a_filter_reads_the_spans(spark):
    words = [(1, "a b  c a", ["a", "", "c", "zz", "a", None, "b"]), (2, "x y", ["x", "y"]), (3, "", [])]
    rows = spark.createDataFrame([(i, t, [(w, 1) for w in ws]) for i, t, ws in words], "doc_id long, text string, labels array<struct<word:string,keep:int>>")
    held = mg.located(rows).select("doc_id", F.col("found.spans").alias("s")).filter(F.size("s") > 0)
    assert held._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    got = {r.doc_id: [tuple(x) for x in r.s] for r in held.collect()}
    assert got == {1: [(0, 1), (1, 1), (5, 6), (6, 6), (7, 8), (8, 8), (2, 3)], 2: [(0, 1), (2, 3)]}


def test_many_words_past_the_cursor_are_found_by_the_automaton():
    text = " ".join(f"w{i}" for i in range(2000))
    words = [f"w{i}" for i in range(1999, -1, -1)]
    assert [text[a:b] for a, b in mg.locate_words(text, words).tolist()] == words


def test_top_pairs_above_a_threshold_leave_no_pair_out(spark, monkeypatch):
    rng, texts = random.Random(3), []
    for i in range(40):
        pool = [" ".join(rng.choices("abcdefghij", k=rng.randint(1, 5))) for _ in range(rng.randint(1, 12))]
        texts.append((i if i % 9 else None, ". ".join(rng.choices(pool, k=rng.randint(1, 15)))))
    texts += [(100, "q r. q r. q r. s t"), (101, None), (102, " "), (102, "q r. q r"), (103, texts[5][1]), (103, texts[5][1])]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    moved, similar = [], dedup.similar_classes
    monkeypatch.setattr(dedup, "similar_classes", lambda classes, *a, **kw: moved.append(classes.count()) or similar(classes, *a, **kw))
    got = dedup.top_pairs(df, 0.6, 4).collect()
    every = lambda df, keys, sents, rel, *a, **kw: dedup.sentence_classes(df, keys, sents).withColumn("solid", F.lit(False))
    monkeypatch.setattr(dedup, "close_classes", every)
    assert sorted(map(str, got)) == sorted(map(str, dedup.top_pairs(df, 0.6, 4).collect()))
    assert moved[0] < moved[1]
