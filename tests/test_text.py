from pyspark.sql import functions as F

from terseframe.functions import prompts, text as tx
from terseframe.operators import segment as sg, selection as sel


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "v string").select(fn(F.col("v")).alias("r")).first()["r"]


def test_sentences_reproduce_text(spark):
    text = "Daniel went home. Mary is in the park! Where now? Done."
    df = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    rows = sg.sentence_rows(df).orderBy("idx").collect()
    assert [r["sentence"] for r in rows] == ["Daniel went home.", "Mary is in the park!", "Where now?", "Done."]
    assert all(text[r["start"]:r["end"]] == r["sentence"] for r in rows)


def test_newlines_end_sentences(spark):
    df = spark.createDataFrame([(1, "First line\nSecond line here\nThird.")], "doc_id bigint, text string")
    assert [r["sentence"] for r in sg.sentence_rows(df).orderBy("idx").collect()] == ["First line", "Second line here", "Third."]


def test_unicode_blanks_separate_words(spark):
    text = "a b　c\x1cd  e"
    df = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    rows = sg.words(df).orderBy("pos").collect()
    assert [r["word"] for r in rows] == text.split()
    assert all(text[r["start"]:r["end"]] == r["word"] for r in rows)


def test_long_text_chunks_tile_it(spark):
    text = "  " + " ".join(f"w{i}" for i in range(3000)) + " "
    df = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    rows = sg.word_chunks(df, 300).orderBy("chunk").collect()
    assert len(rows) == 10 and all(text[r["start"]:r["end"]] == r["body"] for r in rows)
    assert [len(r["body"].split()) for r in rows] == [300] * 10


def test_label_strings(spark):
    pairs = lambda s: [(x["word"], x["keep"]) for x in one(spark, s, tx.parse_labels)]
    assert pairs("a,1 b,0") == [("a", 1), ("b", 0)]
    assert pairs("Daniel 1\t\t|\t\ttravelled 1\t\t|\t\tto 0") == [("Daniel", 1), ("travelled", 1), ("to", 0)]
    assert pairs(None) == [] and pairs("") == []


def test_label_coercion(spark):
    got = {v: one(spark, v, tx.coerce_label) for v in ["1", " True ", "TRUE", "0.5", "0.51", "1.0", "nan", "x", "1d"]}
    assert got == {"1": 1, " True ": 1, "TRUE": 0, "0.5": 0, "0.51": 1, "1.0": 1, "nan": 0, "x": 0, "1d": 0}


def test_rates(spark):
    assert [one(spark, v, tx.parse_rate) for v in ["45.0%", "0.7", "bad", "1"]] == [0.45, 0.7, 0.0, 1.0]


def test_none_anchor(spark):
    got = [one(spark, v, tx.is_none_anchor) for v in [None, " ", "None.", '"nonesuch', "park"]]
    assert got == [True, True, True, True, False]


def test_normalize_answer_keeps_accented_words(spark):
    assert one(spark, "The  Éa, a (test) an-swer", tx.normalize_answer) == "éa test answer"


def test_fillers(spark):
    assert one(spark, "Um basically fine , 2nd  try", tx.strip_fillers) == "fine, 2nd try"


def test_question_suffix_removed(spark):
    df = spark.createDataFrame([("body text Where? ", "Where?")], "t string, q string")
    assert df.select(tx.ends_with_question(F.col("t"), F.col("q")).alias("r")).first()["r"] == "body text"


def test_anchor_prompt_ends(spark):
    df = spark.createDataFrame([("X.", "Is it raining?", ""), ("Y.", "Where is Daniel?", "Daniel is in the")], "c string, q string, p string")
    out = [r["r"] for r in df.select(prompts.anchor_prompt(F.col("c"), F.col("q"), F.col("p")).alias("r")).collect()]
    assert out[0].endswith("Answer:") and out[1].endswith("Answer: Daniel is in the")
    assert "Context: Y." in out[1] and "Question: Where is Daniel?" in out[1]


def test_hint_prefix(spark):
    df = spark.createDataFrame([("Is Daniel home?",), ("Where is Daniel?",)], "q string")
    out = df.select(sel.is_empty_prefix(sel.hint_prefix(F.col("q"))).alias("e"), sel.hint_prefix(F.col("q"), fixed=True).alias("f")).collect()
    assert [r["e"] for r in out] == [True, False]
    assert all(r["f"].startswith("Please output the most relevant keyword") for r in out)
