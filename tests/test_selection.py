from pyspark.sql import functions as F

from terseframe.operators import dedup, selection as sel, windows as wn


def select(spark, body, boosted, k, base=0.1):
    attention = [boosted.get(w.strip("."), base) for w in body.split()]
    df = spark.createDataFrame([(1, body, attention)], "doc_id bigint, body string, attention array<double>")
    row = sel.select_sentences(df, k).first()
    return row["kept_text"], row["kept_idx"]


def guided(spark, text, terms, size, k):
    df = spark.createDataFrame([(1, text, terms)], "doc_id bigint, text string, terms array<string>")
    return sel.guided_text(df, size, k).first(), sel.guided_spans(df, size, k).first()


def test_needle_sentence(spark):
    got = select(spark, "Alpha beta gamma. The keyword apple is here. Delta epsilon zeta.", {"apple": 10.0}, 1)
    assert got == ("The keyword apple is here.", [1])


def test_two_sentences(spark):
    assert select(spark, "Cats sleep. Dogs run fast. Birds fly high.", {"Cats": 9.0, "high": 9.0}, 2) == ("Cats sleep. Birds fly high.", [0, 2])


def test_k_above_token_count(spark):
    assert select(spark, "Short one.", {}, 50, 1.0) == ("Short one.", [0])


def test_gate_drops_the_second_chunk(spark):
    text, spans = guided(spark, "Daniel is in the park today. Totally unrelated filler sentence here.", ["park"], 6, 3)
    assert (text["n_chunks"], text["n_kept_chunks"]) == (2, 1)
    assert "park" in text["compressed"] and "filler" not in text["compressed"]
    assert spans["n_kept_chunks"] == 1


def test_whole_pipeline_keeps_the_answer(spark):
    text = "The weather was cold that morning. Daniel is in the park near the old fountain. Many tourists visit the city each summer."
    row, spans = guided(spark, text, ["park"], 100, 1)
    assert row["compressed"] == "Daniel is in the park near the old fountain."
    assert [text[s["start"]:s["end"]] for s in spans["spans"]] == [row["compressed"]]


def test_only_chunk_is_kept_by_spans_but_not_by_text(spark):
    row, spans = guided(spark, "One here. Two there.", ["park"], 100, 1)
    assert row["compressed"] == "" and len(spans["spans"]) == 2 and spans["n_kept_chunks"] == 1


def test_rank_rows_forms_agree(spark):
    df = spark.range(5000).select((F.col("id") % 3 % 2).alias("g"), (F.col("id") * 7919 % 97).alias("v"), "id")
    order = [F.col("v").desc(), F.col("id").asc()]
    plain = {(r["id"], r["rank"]) for r in wn.rank_rows(df, ["g"], order, bounded=True).collect()}
    assert {(r["id"], r["rank"]) for r in wn.rank_rows(df, ["g"], order).collect()} == plain


def test_blocked_windows_match_plain_loops(spark):
    rows = [("a", i, i * i % 13) for i in range(0, 100, 3)] + [("b", 5, 1)]
    df = spark.createDataFrame(rows, "k string, o bigint, v bigint")
    total = {(r["k"], r["o"]): r["s"] for r in wn.running_sum(df, ["k"], "o", F.col("v"), "s", block=10).collect()}
    prev = {(r["k"], r["o"]): r["p"] for r in wn.previous(df, ["k"], "o", "v", "p", block=10).collect()}
    acc, last = 0, None
    for k, o, v in rows[:-1]:
        acc += v
        assert total[(k, o)] == acc and prev[(k, o)] == last
        last = v
    assert total[("b", 5)] == 1 and prev[("b", 5)] is None


def brute_cosines(texts):
    """Per text a table of cosines of unit TF-IDF vectors; None where a sentence is none."""
    from collections import Counter
    from math import log, sqrt

    bags = [[Counter(s.lower().split()) for s in sents] for sents in texts]
    df = Counter(w for sents in bags for b in sents for w in b)
    n = sum(map(len, bags))
    unit = [[{w: c * log((n + 1) / (df[w] + 1)) for w, c in b.items()} for b in sents] for sents in bags]
    size = lambda v: sqrt(sum(x * x for x in v.values()))
    dot = lambda a, b: sum(x * b.get(w, 0) for w, x in a.items())
    return [[[dot(a, b) / size(a) / size(b) if size(a) and size(b) else None for b in sents] for a in sents] for sents in unit]


def sentence_texts():
    import random

    rnd = random.Random(5)
    texts = [[" ".join(rnd.choice("aabcdefgh") for _ in range(rnd.randrange(1, 8))) + "." for _ in range(rnd.choice([1, 3, 60]))] for _ in range(12)]
    return texts + [["same words here."] * 40 + ["here words same."] * 3 + ["other one."]]


def test_dedupe_equals_the_sequential_rule(spark):
    texts = sentence_texts()
    df = spark.createDataFrame([(i if i else None, " ".join(t), ["a.", "c", "here"]) for i, t in enumerate(texts)], "doc_id long, text string, terms array<string>")
    got = {r.doc_id or 0: r for r in dedup.dedupe(df, 0.6).collect()}
    for i, (sents, cos) in enumerate(zip(texts, brute_cosines(texts))):
        rel = [sum(w in ("a.", "c", "here") for w in s.lower().split()) / (3 * len(s.split())) ** 0.5 for s in sents]
        order = sorted(range(len(sents)), key=lambda x: (-round(rel[x], 9), x))
        kept, why = [], {}
        for x in order:
            near = [(round(cos[x][y], 9), y) for y in kept if cos[x][y] is not None and round(cos[x][y], 9) >= 0.6]
            if near:
                why[x] = max(near, key=lambda c: (c[0], -order.index(c[1])))
            else:
                kept.append(x)
        assert got[i].sents == sents and got[i].kept == sorted(kept)
        assert {d.idx: (d.sim, d.closest) for d in got[i].dropped} == why and all(d.sentence == sents[d.idx] for d in got[i].dropped)


def test_top_pairs_equal_brute_force(spark):
    texts = sentence_texts()
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    got = sorted(tuple(r) for r in dedup.top_pairs(df, 0.5, 7).collect())
    want = []
    for d, cos in enumerate(brute_cosines(texts)):
        pairs = [(round(cos[i][j], 6), i, j) for j in range(len(cos)) for i in range(j) if cos[i][j] is not None and round(cos[i][j], 9) >= 0.5]
        want += [(d, i, j, s) for s, i, j in sorted(pairs, reverse=True)[:7]]
    assert got == sorted(want)


def test_dedupe_leaves_short_texts(spark):
    df = spark.createDataFrame([(1, "  Only one sentence here ", ["x"])], "doc_id bigint, text string, terms array<string>")
    row = dedup.dedupe(df, 0.5).first()
    assert row["deduped"] == "  Only one sentence here " and row["kept"] == [0]


def test_top_pairs_without_threshold_equal_brute_force(spark):
    texts = sentence_texts()
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    got = sorted(tuple(r) for r in dedup.top_pairs(df, None, 7).collect())
    want = []
    for d, cos in enumerate(brute_cosines(texts)):
        pairs = [(round(cos[i][j], 6), i, j) for j in range(len(cos)) for i in range(j) if cos[i][j] is not None and cos[i][j] > 0]
        want += [(d, i, j, s) for s, i, j in sorted(pairs, reverse=True)[:7]]
    assert got == sorted(want) and any(s < 0.5 for *_, s in got)


def test_blocks_of_sentences_find_the_same_pairs(spark):
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(sentence_texts())], "doc_id long, text string")
    classes = dedup.sentence_classes(df, ["doc_id"], dedup.tx.split_sentences(dedup.F.col("text")))
    whole, cut = ({tuple(r) for r in dedup.similar_classes(classes, ["doc_id"], None, block=b).collect()} for b in (512, 2))
    assert len(whole) > 20 and whole == cut


def test_classes_without_a_near_one_are_left_out(spark, monkeypatch):
    texts = [["red apples grow on old trees.", "old trees grow red apples now.", "nothing else is said here."], ["one line.", "one line.", "two lines."]]
    df = spark.createDataFrame([(i, " ".join(t), ["trees."]) for i, t in enumerate(texts)], "doc_id long, text string, terms array<string>")
    sents, rel = dedup.tx.split_sentences(F.col("text")), dedup.term_relevance(dedup.tx.split_sentences(F.col("text")), "terms")
    freq = dedup.sentence_frequency(df, sents)
    assert freq.sentences == 6 and {r.term: r.df for r in freq.table.collect()}["red"] == 2
    for whole in (True, False):  # the other idf are bounds
        if not whole:
            monkeypatch.setattr(dedup, "frequent", lambda table, *_: table.filter("df > 1"))
        rows = dedup.close_classes(df, ["doc_id"], sents, rel, freq, 0.4).collect()
        held = {(r.doc_id, r.idx): (r.copies, r.words is not None) for r in rows}
        assert held[1, 0] == ([0, 1], False) and held[0, 0][1] and held[0, 1][1] and (0, 2) not in held and (1, 2) not in held
        assert all(r.solid for r in rows)


def test_dedupe_by_bounds_equals_the_sequential_rule(spark, monkeypatch):
    monkeypatch.setattr(dedup, "frequent", lambda table, *_: table.filter("df > 150"))
    test_dedupe_equals_the_sequential_rule(spark)


def test_spans_equal_the_rows_of_chunks(spark):
    texts = ["Park one. two park!  three?no four\n five park" * 3, "  ", None, "no hit. at all", "x " * 9 + "park.", "\x1cA.b.C park \x85 d? (e) \"f.\" g"]
    df = spark.createDataFrame([(i, t, ["park", "four"]) for i, t in enumerate(texts)], "doc_id long, text string, terms array<string>")
    for size, k in ((4, 2), (6, 1), (300, 12)):
        rows = sel.guided_chunks(df, size, k).orderBy("doc_id", "chunk").collect()
        got = {r.doc_id: r for r in sel.guided_spans(df, size, k).collect()}
        assert set(got) == {r.doc_id for r in rows}
        for doc, row in got.items():
            chunks = [r for r in rows if r.doc_id == doc]
            want = [(r.start + s.start, r.start + s.end) for r in chunks if not r.skipped for s in r.kept]
            alone = len(chunks) == 1 and chunks[0].skipped
            assert row.n_chunks == len(chunks) and row.n_kept_chunks == (1 if alone else sum(not r.skipped for r in chunks))
            assert alone or [(s.start, s.end) for s in row.spans] == want
            words = texts[doc].split()
            assert all(words[s.w0].startswith(texts[doc][s.start:s.end].split()[0][:1]) or s.w0 == s.w1 or texts[doc][s.start - 1] not in " \n" for s in row.spans)


def test_both_decisions_in_one_pass(spark):
    from terseframe.operators import compress as cp, scores as sc

    df = spark.createDataFrame([(1, "a park. b c. park d.", ["park"]), (1, "a park. b c. park d.", ["park"]), (None, "a b c.", ["a"]), (3, " ", ["a"])], "doc_id long, text string, terms array<string>")
    vocab = sc.vocabulary(df)
    rows = {r.doc_id: r for r in cp.two_decisions(df, vocab, 0.5).collect()}
    assert set(rows) == {1, None} and rows[1].n_chunks == 2 and len(rows[1].words) == 12 and rows[None].guided == [] and rows[None].n_chunks == 0
    plan = cp.two_decisions(df, vocab, 0.5)._jdf.queryExecution().executedPlan().toString()
    assert "posexplode" not in plan and "Join" not in plan
    assert [r.doc_id for r in cp.two_decisions(df.withColumn("question", F.lit("q")), vocab, 0.5, carry=["question"]).collect()] == [1, 1]
