"""The merge rules on literal inputs."""

import pytest
from pyspark.sql import functions as F

from terseframe.operators import merge as mg

CAT = "the cat and the dog"
CAT_LABELS = [("the", 0), ("cat", 1), ("and", 0), ("the", 1), ("dog", 1)]


def merged(spark, text, labels, spans, mode="intersection", empty=False):
    schema = "doc_id bigint, text string, labels array<struct<word:string,keep:int>>, mode string, guided_empty boolean"
    df = spark.createDataFrame([(1, text, labels, mode, empty)], schema)
    kept = spark.createDataFrame([(1, s, e) for s, e in spans], "doc_id bigint, start int, `end` int")
    return mg.merge_labels(df, kept).first()


def test_duplicate_words_get_successive_spans():
    spans = mg.locate_words(CAT, [w for w, _ in CAT_LABELS])
    assert [tuple(s) for s in spans.tolist()] == [(0, 3), (4, 7), (8, 11), (12, 15), (16, 19)]


def test_missed_word_moves_the_cursor_back():
    spans = mg.locate_words("ab cd ab", ["cd", "ab", "cd", "zz", "", None])
    assert [tuple(s) for s in spans.tolist()] == [(3, 5), (6, 8), (3, 5), (5, 5), (5, 5), (5, 5)]


def test_places_equal_a_search_from_the_cursor():
    import random

    rnd = random.Random(9)
    for _ in range(200):
        text = "".join(rnd.choice("aab ") for _ in range(rnd.randrange(40)))
        words = ["".join(rnd.choice("aab") for _ in range(rnd.randrange(4))) for _ in range(rnd.randrange(12))]
        free, want = 0, []
        for w in words:
            at = text.find(w, free) if w else -1
            at = text.find(w) if w and at < 0 else at
            start = at if at >= 0 else free
            free = at + len(w) if at >= 0 else free
            want.append([start, free])
        assert mg.locate_words(text, words).tolist() == want


def test_overlap_mask(spark):
    assert merged(spark, CAT, CAT_LABELS, [(4, 19)])["mask_guided"] == [0, 1, 1, 1, 1]


@pytest.mark.parametrize("mode,text", [("intersection", "cat the dog"), ("union", "cat and the dog")])
def test_modes(spark, mode, text):
    row = merged(spark, CAT, CAT_LABELS, [(4, 19)], mode)
    assert row["compressed"] == text and row["fallback"] is False


@pytest.mark.parametrize("spans,empty", [([], False), ([(0, 19)], True)])
def test_fallback_keeps_labels(spark, spans, empty):
    row = merged(spark, CAT, CAT_LABELS, spans, empty=empty)
    assert row["compressed"] == "cat the dog" and row["fallback"] is True and row["n_kept"] == 3


def test_punctuation_stays_with_its_word(spark):
    text = "Daniel, who left, is in the park."
    labels = list(zip(text.split(), [1, 0, 0, 1, 1, 1, 1]))
    assert merged(spark, text, labels, [(0, len(text))])["compressed"] == "Daniel, is in the park."


def test_second_sentence_only(spark):
    text = "The weather was cold. Daniel is in the park near the fountain."
    keep = {"Daniel", "park", "fountain.", "cold."}
    labels = [(w, int(w in keep)) for w in text.split()]
    assert merged(spark, text, labels, [(text.index("Daniel"), len(text))])["compressed"] == "Daniel park fountain."


def test_masks_are_nested(spark):
    inter = merged(spark, CAT, CAT_LABELS, [(4, 11)], "intersection")
    union = merged(spark, CAT, CAT_LABELS, [(4, 11)], "union")
    for i, l, g, u in zip(inter["merged"], inter["mask_label"], inter["mask_guided"], union["merged"]):
        assert i["keep"] <= l <= u["keep"] and i["keep"] <= g <= u["keep"]


def test_swept_overlap_equals_brute_force(spark):
    import random

    rnd = random.Random(3)
    words = [(1, i, s, s + rnd.choice([0, 3, 700])) for i, s in enumerate(rnd.randrange(5000) for _ in range(300))]
    kept = [(1, s, s + rnd.choice([1, 40, 900])) for s in (rnd.randrange(5000) for _ in range(15))]
    w = spark.createDataFrame(words, "doc_id bigint, pos int, start int, `end` int")
    k = spark.createDataFrame(kept, "doc_id bigint, start int, `end` int")
    got = sorted(r["pos"] for r in mg.overlapping_words(w, k).collect())
    hit = lambda s, e: any((s < b and e > a) or (s == e and a <= s < b) for _, a, b in kept)
    assert got == [i for _, i, s, e in words if hit(s, e)]
    inside = mg.overlaps(mg.np.array([(s, e) for _, _, s, e in words]), mg.np.array([(a, b) for _, a, b in kept]))
    assert [i for i, h in enumerate(inside.tolist()) if h] == got
    assert not mg.overlaps(mg.np.array([(0, 3)]), mg.np.empty((0, 2), int)).any()


def test_splice_spans_sorts_and_falls_back(spark):
    df = spark.createDataFrame([("ab cd ef", [(6, 8), (0, 3), (4, 4)]), ("ab", [])], "t string, s array<struct<start:int,`end`:int>>")
    assert [r["r"] for r in df.select(mg.splice_spans(F.col("t"), F.col("s")).alias("r")).collect()] == ["ab ef", "ab"]


def test_spans_are_the_first_place_ahead_or_the_first_of_all():
    import random
    from bisect import bisect_left

    r = random.Random(3)
    for _ in range(200):
        text = "".join(r.choice("ab ") for _ in range(r.randint(0, 400)))
        words = [r.choice(["", None, "c", "ab"]) if r.random() < 0.3 else "".join(r.choice("ab") for _ in range(r.randint(1, 9))) for _ in range(150)]
        want, free = [], 0
        for w in words:
            at = [i for i in range(len(text)) if text.startswith(w, i)] if w else []
            a = at[bisect_left(at, free) % len(at)] if at else free
            free = a + len(w) if at else free
            want.append([a, free])
        assert mg.locate_words(text, words).tolist() == want


def test_located_words_stay_in_arrow_arrays():
    import tracemalloc

    import pyarrow as pa

    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    text = " ".join(f"w{i}" for i in range(300))
    texts, words = pa.array([text] * 500 + [None]), pa.array([text.split() + ["none"]] * 500 + [None])
    kept = pa.array([[{"start": 0, "end": 1}]] + [None] * 500, span)
    tracemalloc.start()
    got = mg.located_udf.func(texts, words, kept)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got.field("spans")[0].as_py()[1] == {"start": 3, "end": 5} and got.field("hits")[0].as_py()[:2] == [True, False]
    assert len(got) == 501 and len(got.field("spans")[500]) == 0
    assert peak < 8_000_000  # 150,000 spans; a dict for each took over 30 MB
