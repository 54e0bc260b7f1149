"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for every operator and stage."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from terseframe.llm import bottom_k, golay_dedup, line_windows, ngram_trie, pfair_mix, quality_crf, topk_hist, url_words, var_pack, wrapper

rnd = random.Random(5)
PROSE = [" ".join(rnd.choice("alpha beta gamma delta the of and to in river stone".split()) + str(rnd.randrange(40)) for _ in range(60)) for _ in range(12)]
LONG = "\n".join(PROSE * 40)
ROWS = [
    (1, PROSE[0], "en", "a"), (2, PROSE[0], "en", "a"), (2, PROSE[0], "en", "a"), (3, None, None, None), (4, "", "en", "b"),
    (5, " \n\t", "en", "b"), (None, PROSE[1], "en", "b"), (6, LONG, "fr", "c"), (7, "*** ### $$$\n" * 9, "en", "b"), (8, "Łódź ß 漢字 🙂 " * 20, "xx", "c"),
    (9, PROSE[2] + "\n" + PROSE[3], "en", "c"), (10, PROSE[3] + "\n" + PROSE[4], "en", "a"), (11, "word", "en", "a"),
]
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, fp string, mix_slot string, part string"
LABELS = "doc_id long, quality int, toxic int, label string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, len(r[1] or ""), 0.5, "x", "s", "p") for r in ROWS], DOCS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0, "x"), (9, 1, 0, None), (7, 0, 0, "y"), (None, 1, 0, "z"), (8, None, 1, ""), (7, 0, 0, "y"), (10, 1, 0, "")], LABELS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def test_quality(docs, none, labels):
    rows = quality_crf.score_documents(docs, labels).collect()
    assert len(rows) == len(ROWS) and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id in (3, 4)}) == 1
    assert quality_crf.score_documents(none, labels).count() == 0
    assert all(abs(r.score - 0.5) < 1e-9 for r in quality_crf.score_documents(docs, labels.filter("false")).collect())


def test_quality_bounds(spark, docs, labels):
    """Repeated rows, long texts and small chunks change no score; texts too long to learn from are scored."""
    model = quality_crf.fit(docs, labels)
    again = quality_crf.fit(docs.unionByName(docs), labels.unionByName(labels))
    assert (model.weight == again.weight).all() and (model.move == again.move).all()
    short = quality_crf.fit(docs, labels, max_lines=1)
    assert (short.weight == quality_crf.fit(docs.filter("doc_id is null or doc_id not in (6, 7, 9, 10)"), labels).weight).all()
    whole = sorted(str(r) for r in quality_crf.score_documents(docs, labels).collect())
    size, quality_crf.CHUNK_CHARS = quality_crf.CHUNK_CHARS, 1
    try:
        assert sorted(str(r) for r in quality_crf.score_documents(docs, labels).collect()) == whole
    finally:
        quality_crf.CHUNK_CHARS = size


def test_mix(docs, none):
    rows = pfair_mix.mix(docs, {"a": 2, "b": 1}, block_docs=2).collect()
    assert len(rows) == len(ROWS) and all(r.mix_release <= r.mix_slot < r.mix_deadline for r in rows)
    assert pfair_mix.mix(none, {"a": 2}).count() == 0
    out = pfair_mix.in_order(docs, {"a": 2, "b": 1}, block_docs=2)
    assert out.columns == docs.columns and sorted(map(str, out.collect())) == sorted(map(str, docs.collect()))
    with pytest.raises(ValueError):
        pfair_mix.mix(docs, {"a": 0})


def test_line_dedup(docs, none):
    rows = line_windows.drop_repeats(docs).collect()
    left = {r.doc_id: r.text for r in rows if r.doc_id is not None}
    assert len(rows) == len(ROWS) and left[1] == PROSE[0] and left[2] == "" and left[3] is None and left[4] == "" and left[5] == " \n\t"
    assert left[10] == "" and left[9] == "" and left[6] == "\n".join(PROSE[1:12]) and next(r.text for r in rows if r.doc_id is None) == PROSE[1]
    out = line_windows.deduplicated(docs)
    assert out.columns == docs.columns and {r.doc_id for r in out.collect()} == {1, 3, 4, 5, None, 6, 7, 8, 11}
    assert all(r.n_chars == len(r.text or "") for r in out.collect())
    assert line_windows.drop_repeats(none).count() == 0


def test_fingerprints(docs, none):
    rows = bottom_k.fingerprints(docs).collect()
    assert len(rows) == len(ROWS)
    same = {r.fingerprint for r in rows if r.doc_id in (1, 2)}
    assert len(same) == 1 and all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows)
    assert {(r.n_chars, r.fingerprint, r.near_edited) for r in rows if r.doc_id in (3, 4)} == {(0, "", 1.0)}
    assert bottom_k.fingerprints(none).count() == 0
    one = bottom_k.fingerprints(docs.filter("doc_id = 11")).collect()
    assert one[0].near_next == 1.0


def test_near_duplicates(docs, none):
    rows = golay_dedup.near_duplicates(docs).collect()
    group = {r.doc_id: r.component_id for r in rows}
    assert len(rows) == len(ROWS) and group[2] == 1 and group[3] == group[4] == group[5] == 3 and group[11] == 11
    kept = golay_dedup.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect() if r.doc_id)[:2] == [1, 3]
    assert golay_dedup.near_duplicates(none).count() == 0


def test_language_model(docs, none):
    rows = ngram_trie.score_held_out(docs).collect()
    assert len(rows) == len(ROWS) and all(r.score < 0 for r in rows)
    assert {r.n_tokens for r in rows if r.doc_id in (3, 4, 5)} == {1}
    assert ngram_trie.score_held_out(none).count() == 0


def test_packing(docs, none):
    pieces = var_pack.piece_rows(var_pack.pack(docs, capacities=(16, 64, 256), runs=3)).collect()
    words = [len((r[1] or "").encode().split()) + 1 for r in ROWS]
    assert sum(p.length for p in pieces) == sum(words)
    assert var_pack.pack(none).count() == 0
    with pytest.raises(ValueError):
        var_pack.pack(docs, capacities=())


def test_top_k(spark):
    vectors = [[0.5, 1.0], [0.5, 1.0], None, [float("nan"), 1.0], [None, 1.0], [float("inf"), 0.0], [-3.0, 2.0], [1.0], []]
    df = spark.createDataFrame([(i, v, "e") for i, v in enumerate(vectors)] + [(None, [1.0, 1.0], "n"), (0, [0.5, 1.0], "r")], "vec_id long, embedding array<float>, score string")
    whole = topk_hist.whole_vectors(df)
    rows = topk_hist.top_k(whole, whole.filter("vec_id % 100 = 0"), k=2).orderBy("rank").collect()
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in rows] == [(0, 1, 1, 512 * 512 + 1024 * 1024), (0, 2, 6, -3072 * 512 + 2048 * 1024)]
    assert topk_hist.top_k(whole.filter("false"), whole).count() == 0


def test_top_k_of_large_parts(spark):
    rows = [(0, [0.5, 1.0]), (1, [4e6, 1.0]), (2, [0.1, 0.2]), (3, [-3e9, 7.0]), (4, [5e15, 5e15]), (100, [6e15, -2e15]), (200, [1e300, 1e300]), (201, [-1e300, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    whole = topk_hist.whole_vectors(df)
    most = 2**63 - 1
    part = lambda x: max(-most - 1, min(most, int(x * 1024 // 1)))
    v = {i: [part(x) for x in e] for i, e in rows}
    score = lambda a, b: max(-most, min(most, sum(x * y for x, y in zip(v[a], v[b]))))
    for k in (1, 3, 10):
        want = [(q, n, i, s) for q in (0, 100, 200) for n, (s, i) in enumerate(sorted(((score(q, i), i) for i in v if i != q), key=lambda x: (-x[0], x[1]))[:k], 1)]
        got = topk_hist.top_k(whole, whole.filter("vec_id % 100 = 0"), k=k)
        assert sorted(tuple(r) for r in got.collect()) == sorted(want)
    small = whole.filter("vec_id < 3")
    assert [r.vec_id for r in topk_hist.top_k(small, small.filter("vec_id = 0")).orderBy("rank").collect()] == [1, 2]


PAGES = [
    (1, None, None), (2, "", ""), (3, "no url", "<p>bare"), (4, "http://A.b/de/x?q#f", "<div><p>one &amp;  two<br>three<table><tr><td>x</table>"),
    (5, "x://u@casino-win.example.net:80#f/y", "<article><p>a<p>b<script>var t='</p>'</script></article><footer>c</footer>"), (5, "x://u@casino-win.example.net:80#f/y", "<b"),
    (None, "://", "<article>" + "<p>word</p>" * 3000), (7, "http://com/de/1", "<!-- x <p>never</p>"),
]


def test_pages(spark):
    df = spark.createDataFrame([(*p, "h") for p in PAGES], "page_id long, url string, html string, host string")
    judged = {r.page_id: r for r in url_words.judge(df).collect()}
    assert (judged[4].host, judged[4].path) == ("a.b", "/de/x") and (judged[3].host, judged[1].host, judged[2].path) == ("", "", "")
    assert judged[7].rule == "com/de/" and judged[7].verdict == "block" and judged[5].verdict == "block" and judged[1].verdict == "allow"
    assert url_words.judge(df.filter("false")).count() == 0
    texts = {(r.page_id, r.n_chars): r.text for r in wrapper.main_text(df).collect()}
    assert len(texts) == len(PAGES) and texts[(1, 0)] == texts[(2, 0)] == texts[(7, 0)] == "" and texts[(3, 4)] == "bare"
    assert "one & two three\nx" in texts.values()
    assert "a\nb" in texts.values() and max(n for _, n in texts) == 3000 * 5 - 1
    assert wrapper.main_text(df.filter("false")).count() == 0


def test_stages(spark, docs, labels, none, tmp_path):
    docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert {i for r in out.collect() for i in r.doc_ids} <= {r[0] for r in ROWS}
    empty = none.select("doc_id", "text", "lang", "source", "n_chars")
    empty.write.parquet(str(tmp_path / "e/documents.parquet"))
    labels.filter("false").write.parquet(str(tmp_path / "e/labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "e")).count() == 0


def test_sketch_parts(spark):
    df = spark.range(6).select((F.col("id") % 2).alias("g"), F.concat_ws(" ", *[F.concat(F.lit(f"w{i}x"), F.col("id")) for i in range(9)]).alias("t"))
    parts = df.withColumn("s", bottom_k.sketch(F.col("t"), k=8))
    merged = {r.g: r.s for r in bottom_k.merge_groups(parts, ["g"], "s", k=8).collect()}
    for g in (0, 1):
        assert merged[g] == sorted({h for r in parts.filter(F.col("g") == g).collect() for h in r.s})[:8]
