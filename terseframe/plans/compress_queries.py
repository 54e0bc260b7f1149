"""Scores, selection, merging and the composite compression jobs."""

from dataclasses import replace

from pyspark.sql import functions as F

from ..functions import spans, text as tx
from ..operators import account, compress as cp, dedup, evaluate as ev, merge as mg, scores as sc, segment as sg, selection as sel
from ..operators.windows import rank_rows
from . import fixtures as fx, sqltext as q
from .registry import query
from .text_queries import BLANKS, label_text


def join_ints(c):
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",")


# --- score providers --------------------------------------------------------------------
@query(
    "x1_self_information",
    q.sql("SELECT term, c AS count, round(-log2(c / (SELECT sum(c) FROM counts)), 6) AS info FROM counts", "counts"),
)
def x1(spark, sf):
    v = sc.vocabulary(fx.docs(spark, sf))
    return sc.self_information(v.table, v.total).withColumn("info", F.round("info", 6))


@query("x1_counted_words", q.sql("SELECT p.doc_id, sum(c.c) AS total, min(c.c) AS rarest, max(c.c) AS commonest FROM plain p JOIN counts c ON c.term = lower(p.word) GROUP BY 1", "plain", "counts"))
def x1_counted(spark, sf):
    rows = sc.counted_words(fx.docs(spark, sf), sc.vocabulary(fx.docs(spark, sf)))
    return rows.groupBy("doc_id").agg(F.sum("count").alias("total"), F.min("count").alias("rarest"), F.max("count").alias("commonest"))


@query("x1_counted_words_split", q.sql("SELECT p.doc_id, sum(c.c) AS total, min(c.c) AS rarest, max(c.c) AS commonest FROM plain p JOIN counts c ON c.term = lower(p.word) GROUP BY 1", "plain", "counts"))
def x1_split(spark, sf):
    """With a vocabulary too large to broadcast: frequent words meet a broadcast set, the rest shuffles."""
    vocab = replace(sc.vocabulary(fx.docs(spark, sf)), limit=0)
    rows = sc.counted_words(fx.docs(spark, sf), vocab)
    return rows.groupBy("doc_id").agg(F.sum("count").alias("total"), F.min("count").alias("rarest"), F.max("count").alias("commonest"))


@query("x2_bm25", q.sql("SELECT req_id, unit_idx, doc_id, score FROM scored", "scored"))
def x2(spark, sf):
    return fx.ranked_requests(spark, sf).select("req_id", "unit_idx", "doc_id", "score")


@query(
    "x3_term_hits",
    q.sql(
        """SELECT doc_id, chunk, bool_or(hit) AS hit, CASE WHEN bool_or(hit) THEN 'hit' ELSE 'none' END AS anchor, count(*) AS n_tokens,
             round(sum(CASE WHEN hit THEN 10.0 ELSE 1.0 / (i + 2) END), 6) AS attention FROM gtok GROUP BY ALL""",
        "gtok",
    ),
)
def x3(spark, sf):
    rows = sel.focus(sg.word_chunks(fx.asked(spark, sf), 300, keep=["doc_id", "terms"]))
    total = F.aggregate("attention", F.lit(0.0), lambda a, x: a + x)
    return rows.select("doc_id", "chunk", "hit", "anchor", "n_tokens", F.round(total, 6).alias("attention"))


@query(
    "x4_tfidf_vectors",
    q.sql(
        """SELECT doc_id, term, round(w / nullif(sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 0), 6) AS weight FROM (
             SELECT t.doc_id, t.term, t.tf * ln(((SELECT count(*) FROM documents) + 1) / (f.df + 1)) AS w
             FROM tf t JOIN (SELECT term, count(*) AS df FROM tf GROUP BY 1) f USING (term))""",
        "plain", tf="SELECT doc_id, lower(word) AS term, count(*) AS tf FROM plain GROUP BY ALL",
    ),
)
def x4(spark, sf):
    return sc.tfidf_rows(fx.docs(spark, sf)).withColumn("weight", F.round("weight", 6))


INTENT = [((i * 7) % 13 - 6) / 32.0 for i in range(64)]


@query(
    "x5_cosine_to_intent",
    f"SELECT vec_id, label, round(list_sum(list_transform(embedding, lambda x, i: x::DOUBLE * (([{', '.join(map(str, INTENT))}])[i])::DOUBLE)), 6) AS relevance FROM embeddings",
)
def x5(spark, sf):
    rows = sc.cosine_to(fx.table(spark, sf, "embeddings"), INTENT)
    return rows.select("vec_id", "label", F.round("relevance", 6).alias("relevance"))


def mean_model():
    """Stand-in for a user's model: the mean coordinate of each vector."""

    def predict(batch):
        return batch.mean(axis=1)

    return predict


@query("x6_model_hook", "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)) / 64, 6) AS score FROM embeddings")
def x6(spark, sf):
    rows = fx.table(spark, sf, "embeddings").withColumn("v", F.col("embedding").cast("array<double>"))
    return sc.model_scores(rows, "v", mean_model, 256, 64).select("vec_id", F.round("score", 6).alias("score"))


def shared_words():
    """Stand-in for a user's reranker: more shared words, a higher score in (0, 1)."""
    import numpy as np

    def predict(queries, passages):
        shared = [len(set(a.lower().split()) & set(b.lower().split())) for a, b in zip(queries.ravel(), passages.ravel())]
        return 1 / (1 + np.exp(-np.array(shared, float)))

    return predict


def word_lengths():
    """Stand-in for a user's embedder: how many words have 1 to 7 letters, and more."""
    import numpy as np

    def predict(texts):
        rows = [np.bincount([min(len(w), 8) - 1 for w in t.split()], minlength=8) for t in texts.ravel()]
        return np.array(rows, np.float32).reshape(-1, 8)

    return predict


@query(
    "f2_pair_scorer",
    q.sql(
        r"""SELECT doc_id, round(1 / (1 + exp(-len(list_intersect(list_distinct(regexp_extract_all(lower(question), '\S+')), list_distinct(regexp_extract_all(lower(text), '\S+')))))), 6) AS score FROM asked""",
        "asked",
    ),
)
def f2_pairs(spark, sf):
    rows = sc.pair_scores(fx.asked(spark, sf), "question", "text", shared_words)
    return rows.select("doc_id", F.round("score", 6).alias("score"))


@query(
    "f2_embedder",
    r"""SELECT doc_id, array_to_string(list_transform(range(1, 9), lambda k: len(list_filter(ws, lambda w: least(length(w), 8) = k))), ',') AS vector
        FROM (SELECT doc_id, regexp_extract_all(text, '\S+') AS ws FROM documents)""",
)
def f2_vectors(spark, sf):
    rows = sc.embed(fx.docs(spark, sf), "text", word_lengths, 256)
    return rows.select("doc_id", join_ints(F.transform("embedding", lambda x: x.cast("int"))).alias("vector"))


# --- tokens and sentences of a chunk ---------------------------------------------------------
@query(
    "j6_position_to_sentence",
    q.sql(
        """SELECT t.doc_id, t.chunk, count(*) AS n, sum(idx) AS idx_sum, sum(idx * (i + 1)) AS idx_mix FROM (
             SELECT t.doc_id, t.chunk, t.i, coalesce(s.pos, 0) AS idx FROM (SELECT g.doc_id, g.chunk, g.i, g.s - c.cs AS at FROM gtok g JOIN gchunk c USING (doc_id, chunk)) t
             ASOF LEFT JOIN gsent s ON s.doc_id = t.doc_id AND s.chunk = t.chunk AND s.s <= t.at) t GROUP BY ALL""",
        "gtok", "gchunk", "gsent",
    ),
)
def j6(spark, sf):
    key = ["doc_id", "chunk"]
    chunks = sg.word_chunks(fx.docs(spark, sf), 300)
    words = sg.words(chunks, "body", key)
    sents = chunks.select(*key, F.explode(F.array_compact(F.transform(
        spans.fold_spans(spans.match_all(F.col("body"), spans.SENTENCE)),
        lambda s, i: F.struct(i.alias("idx"), s["start"].alias("start")),
    ))).alias("s")).select(*key, "s.idx", "s.start")
    rows = sel.sentences_of_words(words, sents, key)
    return rows.groupBy(*key).agg(
        F.count("*").alias("n"), F.sum("idx").alias("idx_sum"), F.sum(F.col("idx") * (F.col("pos") + 1)).alias("idx_mix")
    )


@query("w2_top_tokens", q.sql("SELECT doc_id, chunk, i, rk AS rank FROM gtop", "gtop"))
def w2(spark, sf):
    rows = sel.focus(sg.word_chunks(fx.asked(spark, sf), 300, keep=["doc_id", "terms"])).filter("hit")
    top = sel.top_positions(F.col("attention"), 12)
    return rows.select("doc_id", "chunk", F.posexplode(top).alias("p", "i")).select("doc_id", "chunk", "i", (F.col("p") + 1).alias("rank"))


@query(
    "c7_select_sentences",
    q.sql(
        "SELECT s.doc_id, s.chunk, string_agg(s.pos, ',' ORDER BY s.pos) AS kept_idx, string_agg(s.sentence, ' ' ORDER BY s.pos) AS kept_text FROM gsent s "
        "JOIN gidx k ON k.doc_id = s.doc_id AND k.chunk = s.chunk AND k.idx = s.pos GROUP BY ALL",
        "gsent", "gidx",
    ),
)
def c7(spark, sf):
    rows = sel.guided_chunks(fx.asked(spark, sf), 300, 12).filter("not skipped")
    return rows.select("doc_id", "chunk", join_ints(F.col("kept_idx")).alias("kept_idx"), "kept_text")


@query("p2_relevance_gate", q.sql("SELECT doc_id, chunk, NOT hit AS skipped FROM gchunk", "gchunk"))
def p2(spark, sf):
    rows = sel.gated(sel.focus(sg.word_chunks(fx.asked(spark, sf), 300, keep=["doc_id", "terms"])))
    return rows.select("doc_id", "chunk", "skipped")


@query("p3_single_chunk_kept", q.sql("SELECT doc_id, n_chunks, n_kept_chunks, n_spans FROM gdoc WHERE n_chunks = 1 AND n_kept_chunks = 1", "gdoc"))
def p3(spark, sf):
    rows = sel.guided_spans(fx.asked(spark, sf), 300, 12)
    return rows.filter("n_chunks = 1").select("doc_id", "n_chunks", "n_kept_chunks", F.size("spans").alias("n_spans"))


@query(
    "c8_guided_compress",
    q.sql(
        """SELECT c.doc_id, c.n_chunks, c.n_kept AS n_kept_chunks, coalesce(t.t, '') AS compressed FROM
             (SELECT doc_id, count(*) AS n_chunks, count(*) FILTER (hit) AS n_kept FROM gchunk GROUP BY 1) c LEFT JOIN
             (SELECT doc_id, string_agg(t, chr(10) ORDER BY chunk) AS t FROM (
                SELECT s.doc_id, s.chunk, string_agg(s.sentence, ' ' ORDER BY s.pos) AS t FROM gsent s JOIN gidx k
                ON k.doc_id = s.doc_id AND k.chunk = s.chunk AND k.idx = s.pos GROUP BY ALL) GROUP BY 1) t USING (doc_id)""",
        "gchunk", "gsent", "gidx",
    ),
)
def c8(spark, sf):
    return sel.guided_text(fx.asked(spark, sf), 300, 12)


@query(
    "c9_guided_spans",
    q.sql('SELECT doc_id, s::INT AS start, e::INT AS "end" FROM gkept', "gkept"),
)
def c9(spark, sf):
    rows = sel.guided_spans(fx.asked(spark, sf), 300, 12)
    return rows.select("doc_id", F.explode("spans").alias("s")).select("doc_id", "s.start", "s.end")


@query(
    "u6_spans_of_all_chunks",
    q.sql("SELECT doc_id, count(*) AS n_spans, sum(e - s) AS kept_chars, count(DISTINCT chunk) AS chunks FROM gkept GROUP BY 1", "gkept"),
)
def u6(spark, sf):
    chunks = sel.guided_chunks(fx.asked(spark, sf), 300, 12)
    spans_ = sel.guided_spans(fx.asked(spark, sf), 300, 12).select("doc_id", F.explode("spans").alias("s"))
    per = spans_.groupBy("doc_id").agg(
        F.count("*").alias("n_spans"), F.sum(F.col("s.end") - F.col("s.start")).alias("kept_chars"),
        F.count_distinct(F.floor(F.col("s.w0") / 300)).alias("chunks"),
    )
    return per


@query(
    "a19_chunk_counters",
    q.sql("SELECT doc_id, n_chunks, n_kept_chunks, n_kept_chunks || '/' || n_chunks AS kept_chunks FROM gdoc WHERE n_chunks > 0", "gdoc"),
)
def a19(spark, sf):
    rows = sel.guided_spans(fx.asked(spark, sf), 300, 12)
    return rows.select("doc_id", "n_chunks", "n_kept_chunks", F.format_string("%d/%d", "n_kept_chunks", "n_chunks").alias("kept_chunks"))


# --- keep-rate ---------------------------------------------------------------------------------
@query("c11_keep_rate", q.sql("SELECT *, round_even(origin_words / greatest(kept_words, 1), 2) AS ratio FROM rate_text", "rate_text"))
def c11(spark, sf):
    rows = cp.compress(fx.docs(spark, sf), sc.vocabulary(fx.docs(spark, sf)), 0.5)
    ratio = account.hard_ratio(F.col("origin_words"), F.col("kept_words"))
    return rows.select("doc_id", "origin_words", "kept_words", "compressed", ratio.alias("ratio"))


@query(
    "c11_given_scores",
    q.sql(
        """SELECT p.doc_id, any_value(n) AS origin_words, count(*) FILTER (stays) AS kept_words, coalesce(string_agg(word, ' ' ORDER BY pos) FILTER (stays), '') AS compressed FROM (
             SELECT *, held AND NOT (word IN ('.', '!', '?', ',') AND word IS NOT DISTINCT FROM
               last_value(CASE WHEN held THEN word END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS stays FROM (
               SELECT *, rk <= ceil(0.4 * n) OR regexp_matches(word, '[0-9]') OR word IN ('.', '!', '?', ',') AS held FROM (
                 SELECT doc_id, pos, word, count(*) OVER (PARTITION BY doc_id) AS n, row_number() OVER (
                   PARTITION BY doc_id ORDER BY CASE WHEN pos % 11 > 0 THEN length(word) / 4.0 + pos % 3 END DESC NULLS LAST, pos) AS rk FROM plain))) p
           GROUP BY p.doc_id""",
        "plain",
    ),
)
def c11_given(spark, sf):
    """Scores come as a table of their own, by text and word position; every eleventh word has none."""
    docs = fx.docs(spark, sf)
    words = sg.plain_words(docs).filter(F.col("pos") % 11 > 0)
    given = words.select("doc_id", "pos", (F.length("word") / 4.0 + F.col("pos") % 3).alias("score"))
    return cp.compress(docs, None, 0.4, scores=given)


@query(
    "c11_target_budget",
    q.sql(
        """SELECT doc_id, count(*) AS kept_words, sum(pos) AS pos_sum FROM (
             SELECT *, lag(word) OVER (PARTITION BY doc_id ORDER BY pos) AS prev FROM (
               SELECT p.doc_id, p.pos, p.word, row_number() OVER (PARTITION BY p.doc_id ORDER BY c.c, p.pos) AS rk, count(*) OVER (PARTITION BY p.doc_id) AS n
               FROM plain p JOIN counts c ON c.term = lower(p.word))
             WHERE rk <= CASE WHEN doc_id % 2 = 0 THEN 40 ELSE ceil(0.5 * n) END OR regexp_matches(word, '[0-9]') OR word IN ('.', '!', '?', ','))
           WHERE NOT (word IN ('.', '!', '?', ',') AND prev IS NOT DISTINCT FROM word) GROUP BY 1""",
        "plain", "counts",
    ),
)
def c11_target(spark, sf):
    rows = sc.counted_words(fx.docs(spark, sf), sc.vocabulary(fx.docs(spark, sf)))
    target = F.when(F.col("doc_id") % 2 == 0, 40).otherwise(-1)
    out = cp.keep_words(rows, ["doc_id"], F.lit(0.5), target)
    total = F.aggregate("kept", F.lit(0).cast("bigint"), lambda a, x: a + x)
    return out.filter(F.size("kept") > 0).select("doc_id", F.size("kept").alias("kept_words"), total.alias("pos_sum"))


@query("a18_ordered_rebuild", q.sql("SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS rebuilt FROM plain GROUP BY 1", "plain"))
def a18(spark, sf):
    rows = sg.words(fx.docs(spark, sf))
    ordered = F.array_sort(F.collect_list(F.struct("pos", "word")))
    return rows.groupBy("doc_id").agg(F.array_join(F.transform(ordered, lambda x: x["word"]), " ").alias("rebuilt"))


@query("l3_reading_order", q.sql("SELECT doc_id, string_agg(pos, ',' ORDER BY pos) AS kept FROM rate_kept GROUP BY 1", "rate_kept"))
def l3(spark, sf):
    rows = sc.counted_words(fx.docs(spark, sf), sc.vocabulary(fx.docs(spark, sf)))
    out = cp.keep_words(rows, ["doc_id"], F.lit(0.5))
    return out.filter(F.size("kept") > 0).select("doc_id", join_ints(F.col("kept")).alias("kept"))


# --- merge ---------------------------------------------------------------------------------------
@query(
    "j5_span_overlap",
    q.sql("SELECT doc_id, pos FROM gword", "gword"),
)
def j5(spark, sf):
    words = sg.words(fx.docs(spark, sf)).select("doc_id", "pos", "start", "end")
    kept = sel.guided_spans(fx.asked(spark, sf), 300, 12).select("doc_id", F.explode("spans").alias("s"))
    return mg.overlapping_words(words, kept.select("doc_id", "s.start", "s.end")).select("doc_id", "pos")


@query("c2_guided_mask", q.sql("SELECT doc_id, string_agg(pos, ',' ORDER BY pos) AS mask FROM gword GROUP BY 1", "gword"))
def c2(spark, sf):
    rows = sel.guided_spans(fx.asked(spark, sf), 300, 12)
    return rows.select("doc_id", join_ints(sel.span_words(F.col("spans"))).alias("mask")).filter("mask <> ''")


def modes(df):
    return df.withColumn("mode", F.explode(F.array(F.lit("intersection"), F.lit("union"))))


@query("p5_mode_predicate", q.sql("SELECT doc_id, mode, n_kept FROM merged", "merged"))
def p5(spark, sf):
    rows = modes(fx.decisions(spark, sf))
    out = cp.merged_text(rows, F.col("mode"), F.size(F.coalesce("spans", F.array())) == 0)
    return out.select("doc_id", "mode", F.size("merged").alias("n_kept"))


@query("u1_keep_intersection", q.sql("SELECT l.doc_id, count(*) AS n FROM rate_kept l JOIN gword g ON g.doc_id = l.doc_id AND g.pos = l.pos GROUP BY 1", "rate_kept", "gword"))
def u1(spark, sf):
    rows = fx.decisions(spark, sf)
    n = F.size(mg.combine_positions(F.lit("intersection"), F.col("kept"), F.col("guided")))
    return rows.select("doc_id", n.alias("n")).filter("n > 0")


@query("u2_keep_union", q.sql("SELECT doc_id, count(*) AS n FROM (SELECT doc_id, pos FROM rate_kept UNION SELECT doc_id, pos FROM gword) GROUP BY 1", "rate_kept", "gword"))
def u2(spark, sf):
    rows = fx.decisions(spark, sf)
    n = F.size(mg.combine_positions(F.lit("union"), F.col("kept"), F.col("guided")))
    return rows.select("doc_id", n.alias("n")).filter("n > 0")


@query(
    "c15_two_methods",
    q.sql(
        """SELECT m.doc_id, m.mode, CASE WHEN m.doc_id % 9 = 4 THEN 'rate' ELSE 'both' END AS route, m.merged_text, m.n_kept, coalesce(r.origin_words, 0) AS n_words,
             m.fallback, d.n_kept_chunks || '/' || d.n_chunks AS kept_chunks FROM merged2 m JOIN gdoc d USING (doc_id) LEFT JOIN rate_text r USING (doc_id)""",
        "gdoc", "rate_text", "modes", "rate_kept", "gword",
        merged2="""SELECT d.doc_id, m.mode, d.fb AS fallback, count(w.pos) AS n_kept, coalesce(string_agg(w.word, ' ' ORDER BY w.pos), '') AS merged_text
           FROM (SELECT *, doc_id % 9 <> 4 AND (n_spans = 0 OR (doc_id % 7 = 0 AND n_chunks <> 1) OR doc_id % 11 = 3) AS fb FROM gdoc) d CROSS JOIN modes m LEFT JOIN (
             SELECT coalesce(l.doc_id, g.doc_id) AS doc_id, coalesce(l.pos, g.pos) AS pos, coalesce(l.word, g.word) AS word,
               l.pos IS NOT NULL AS in_l, g.pos IS NOT NULL AS in_g FROM rate_kept l FULL JOIN gword g ON l.doc_id = g.doc_id AND l.pos = g.pos) w
           ON w.doc_id = d.doc_id AND CASE WHEN d.fb OR d.doc_id % 9 = 4 THEN in_l WHEN m.mode = 'union' THEN in_l OR in_g ELSE in_l AND in_g END GROUP BY ALL""",
    ),
)
def c15(spark, sf):
    rows = modes(fx.decisions(spark, sf, carry=["question"]))
    empty = cp.guided_is_empty(
        "empty_prefix", F.size(F.coalesce("spans", F.array())), sel.is_empty_prefix(sel.hint_prefix(F.col("question"))), F.col("n_chunks")
    )
    # every ninth request asks nothing, and for every eleventh the question side fails
    asked, failed = F.col("doc_id") % 9 != 4, F.col("doc_id") % 11 == 3
    out = cp.merged_text(rows, F.col("mode"), empty, asked, failed)
    return out.select(
        "doc_id", "mode", F.when(asked, "both").otherwise("rate").alias("route"), "merged_text", F.size("merged").alias("n_kept"), F.size("words").alias("n_words"), "fallback",
        F.format_string("%d/%d", "n_kept_chunks", "n_chunks").alias("kept_chunks"),
    )


@query(
    "p11_empty_policies",
    q.sql("SELECT doc_id, n_spans = 0 AS no_spans, n_spans = 0 OR (doc_id % 7 = 0 AND n_chunks <> 1) AS empty_prefix FROM gdoc WHERE n_chunks > 0", "gdoc"),
)
def p11(spark, sf):
    rows = sel.guided_spans(fx.asked(spark, sf), 300, 12).join(fx.asked(spark, sf).select("doc_id", "question"), "doc_id")
    n, prefix = F.size("spans"), sel.is_empty_prefix(sel.hint_prefix(F.col("question")))
    return rows.select(
        "doc_id", cp.guided_is_empty("no_spans", n, prefix, F.col("n_chunks")).alias("no_spans"),
        cp.guided_is_empty("empty_prefix", n, prefix, F.col("n_chunks")).alias("empty_prefix"),
    )


@query("c6_splice_spans", q.sql("SELECT d.doc_id, coalesce(k.t, d.text) AS spliced FROM documents d LEFT JOIN (SELECT doc_id, string_agg(sentence, ' ' ORDER BY s) AS t FROM gkept GROUP BY 1) k USING (doc_id)", "gkept"))
def c6(spark, sf):
    kept = sel.guided_spans(fx.asked(spark, sf), 300, 12).select("doc_id", "spans")
    rows = fx.docs(spark, sf).join(kept, "doc_id", "left")
    return rows.select("doc_id", mg.splice_spans(F.col("text"), F.col("spans")).alias("spliced"))


@query("l6_sorted_spans", q.sql("SELECT doc_id, string_agg(s || '-' || e, ',' ORDER BY s) AS spans FROM gkept WHERE e > s GROUP BY 1", "gkept"))
def l6(spark, sf):
    kept = sel.guided_spans(fx.asked(spark, sf), 300, 12)
    shown = F.transform(mg.clean_spans(F.col("spans")), lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string")))
    return kept.select("doc_id", F.array_join(shown, ",").alias("spans")).filter("spans <> ''")


# label words as an external classifier returns them: most are the text's own; some are missing from it, empty,
# cut short, or the text's first word again, which is found behind the cursor
LABEL_WORD = r"CASE WHEN i % 13 = 7 THEN '' WHEN i % 17 = 5 THEN ws[1] WHEN i % 19 = 11 THEN w || 'zq' WHEN i % 23 = 9 THEN left(w, 2) ELSE w END"
LABELS_SQL = rf"""SELECT doc_id, text, list_transform(list_zip(ws, range(len(ws))), lambda x: {{'w': {LABEL_WORD.replace("i %", "x[2] %").replace("w ||", "x[1] ||").replace("left(w", "left(x[1]").replace("ELSE w", "ELSE x[1]")},
    'keep': CASE WHEN x[2] % 3 = 1 THEN 0 ELSE 1 END}}) AS labels FROM (SELECT doc_id, text, regexp_extract_all(text, '\S+') AS ws FROM documents)"""


def let_sql(value: str, name: str, body: str) -> str:
    return f"list_transform([{value}], lambda {name}: {body})[1]"


def fold_sql(table: str, fields: dict[str, tuple[str, str]], carry: str, hit: str = "false", m: str = "false") -> str:
    """A fold over the labels of `table` with a moving cursor; fields: name -> (start value, next value).

    In a next value c is the state so far, x the label, z.a and z.e the span found for it, h.hit whether it overlaps
    one of `kept`, h.m the merged decision.
    """
    first = ", ".join([f"'{n}': {v}" for n, (v, _) in fields.items()])
    after = ", ".join([f"'{n}': {v}" for n, (_, v) in fields.items()])
    ahead = "CASE WHEN x.w = '' THEN 0 ELSE instr(substr(text, c.free + 1), x.w) END"
    place = "CASE WHEN x.w = '' THEN -1 WHEN p > 0 THEN c.free + p - 1 ELSE instr(text, x.w) - 1 END"
    span = "{'a': CASE WHEN q < 0 THEN c.free ELSE q END, 'e': CASE WHEN q < 0 THEN c.free ELSE q + length(x.w) END}"
    step = let_sql(f"{{'hit': {hit}}}", "g", let_sql(f"{{'hit': g.hit, 'm': {m}}}", "h", f"{{'w': '', 'keep': 0, 'free': z.e::BIGINT, {after}}}"))
    step = let_sql(ahead, "p", let_sql(place, "q", let_sql(span, "z", step)))
    start = f"{{'w': '', 'keep': 0, 'free': 0::BIGINT, {first}}}"
    return (
        f"SELECT {carry}, unnest(list_reduce(list_prepend({start}, list_transform(labels, lambda x: "
        f"{start.replace(chr(39) * 2 + ',', 'x.w,', 1).replace(': 0,', ': x.keep,', 1)})), lambda c, x: {step})) FROM {table}"
    )


HIT_SQL = "NOT fallback AND len(list_filter(kept, lambda k: (z.a < k.e AND z.e > k.s) OR (z.a = z.e AND k.s <= z.a AND z.a < k.e))) > 0"
MERGED_SQL = "CASE WHEN fallback THEN x.keep = 1 WHEN mode = 'union' THEN x.keep = 1 OR g.hit ELSE x.keep = 1 AND g.hit END"


def labelled(spark, sf):
    def label(w, i):
        word = (
            F.when(i % 13 == 7, "").when(i % 17 == 5, F.get("ws", F.lit(0))).when(i % 19 == 11, F.concat(w, F.lit("zq")))
            .when(i % 23 == 9, F.substring(w, 1, 2)).otherwise(w)
        )
        return F.struct(word.alias("word"), F.when(i % 3 == 1, 0).otherwise(1).alias("keep"))

    rows = fx.docs(spark, sf).withColumn("ws", tx.split_words(F.col("text")))
    return rows.withColumn("labels", F.transform("ws", label)).drop("ws")


@query(
    "c1_word_positions",
    q.sql(
        "SELECT doc_id, n, chars, lo, hi, mix FROM spans WHERE n > 0", labels=LABELS_SQL,
        spans=fold_sql("labels", {
            "n": ("0::BIGINT", "c.n + 1"), "chars": ("0::BIGINT", "c.chars + z.e - z.a"), "lo": ("1000000000::BIGINT", "least(c.lo, z.a)"),
            "hi": ("0::BIGINT", "greatest(c.hi, z.e)"), "mix": ("0::BIGINT", "(c.mix * 31 + 7 * z.a + z.e) % 1000000007"),
        }, "doc_id"),
    ),
)
def c1(spark, sf):
    rows = mg.located(labelled(spark, sf)).select("doc_id", F.col("found.spans").alias("s")).filter(F.size("s") > 0)
    fold = lambda first, step: F.aggregate("s", F.lit(first).cast("bigint"), step)
    return rows.select(
        "doc_id", F.size("s").cast("bigint").alias("n"), fold(0, lambda c, x: c + x["end"] - x["start"]).alias("chars"),
        fold(10**9, lambda c, x: F.least(c, x["start"])).alias("lo"), fold(0, lambda c, x: F.greatest(c, x["end"])).alias("hi"),
        fold(0, lambda c, x: (c * 31 + 7 * x["start"] + x["end"]) % 1000000007).alias("mix"),
    )


@query("c3_splice_words", q.sql("SELECT doc_id, array_to_string(list_transform(list_filter(labels, lambda x: x.keep = 1), lambda x: x.w), ' ') AS spliced FROM labels WHERE len(labels) > 0", labels=LABELS_SQL))
def c3(spark, sf):
    """The exact substring of every kept label that has one, else the label word."""
    rows = mg.located(labelled(spark, sf)).filter(F.size("labels") > 0)
    spans = F.filter(F.arrays_zip(F.col("labels").alias("l"), F.col("found.spans").alias("s")), lambda z: z["l"]["keep"] == 1)
    exact = lambda z: F.when(z["s"]["start"] < z["s"]["end"], F.substr("text", z["s"]["start"] + 1, z["s"]["end"] - z["s"]["start"]))
    return rows.select("doc_id", F.array_join(F.transform(spans, lambda z: F.coalesce(exact(z), z["l"]["word"])), " ").alias("spliced"))


@query(
    "c4_merge_labels",
    q.sql(
        "SELECT doc_id, mode, fallback, n_words, n_kept, compressed, guided FROM folded",
        "gdoc", "gkept", labels=LABELS_SQL,
        asked_labels="""SELECT l.doc_id, l.text, l.labels, CASE WHEN l.doc_id % 2 = 0 THEN 'union' ELSE 'intersection' END AS mode,
            n_spans = 0 OR l.doc_id % 10 = 3 AS fallback, coalesce(k.kept, []) AS kept FROM labels l JOIN gdoc USING (doc_id)
            LEFT JOIN (SELECT doc_id, list({'s': s, 'e': e}) AS kept FROM gkept GROUP BY 1) k USING (doc_id)""",
        folded=fold_sql("asked_labels", {
            "n_words": ("0::BIGINT", "c.n_words + 1"),
            "n_kept": ("0::BIGINT", "c.n_kept + CASE WHEN h.m THEN 1 ELSE 0 END"),
            "guided": ("0::BIGINT", "c.guided + CASE WHEN h.hit THEN 1 ELSE 0 END"),
            "compressed": ("''", "CASE WHEN NOT h.m THEN c.compressed WHEN c.n_kept = 0 THEN x.w ELSE c.compressed || ' ' || x.w END"),
        }, "doc_id, mode, fallback", HIT_SQL, MERGED_SQL),
    ),
)
def c4(spark, sf):
    rows = labelled(spark, sf).withColumn("mode", F.when(F.col("doc_id") % 2 == 0, "union").otherwise("intersection"))
    rows = rows.withColumn("guided_empty", F.col("doc_id") % 10 == 3)
    kept = sel.guided_spans(fx.asked(spark, sf), 300, 12).select("doc_id", F.explode("spans").alias("s")).select("doc_id", "s.start", "s.end")
    out = mg.merge_labels(rows, kept)
    guided = F.aggregate("mask_guided", F.lit(0), lambda a, x: a + x)
    return out.select("doc_id", "mode", "fallback", "n_words", "n_kept", "compressed", guided.alias("guided"))


@query(
    "c5_overshoot_guard",
    q.sql(
        """SELECT doc_id, CASE WHEN length(rebuilt) > length(text) THEN array_to_string(kept, ' ') ELSE rebuilt END AS guarded FROM (
             SELECT doc_id, text, kept, replace(array_to_string(kept, chr(1)), chr(1), repeat(' ', 1 + doc_id % 6)) AS rebuilt
             FROM (SELECT doc_id, text, list_transform(list_filter(labels, lambda x: x.keep = 1), lambda x: x.w) AS kept FROM labels))""",
        labels=LABELS_SQL,
    ),
)
def c5(spark, sf):
    # rebuilt with one to six blanks between the kept words, so that some texts overshoot and some do not
    rows = labelled(spark, sf)
    kept = F.transform(F.filter("labels", lambda x: x["keep"] == 1), lambda x: x["word"])
    gap = F.repeat(F.lit(" "), (1 + F.col("doc_id") % 6).cast("int"))
    return rows.withColumn("rebuilt", F.call_function("array_join", kept, gap)).select(
        "doc_id", mg.guard_overshoot(F.col("rebuilt"), F.col("text"), F.col("labels")).alias("guarded")
    )


# --- documents of a request ------------------------------------------------------------------------
@query("w1_rank_units", q.sql("SELECT req_id, unit_idx, rank FROM ranked", "ranked"))
def w1(spark, sf):
    return sel.rank_units(fx.ranked_requests(spark, sf)).select("req_id", "unit_idx", "rank")


@query(
    "w1_rank_any_group",
    "SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS rank FROM events",
)
def w1_any(spark, sf):
    rows = fx.table(spark, sf, "events").select("event_type", "event_id", "value")
    return rank_rows(rows, ["event_type"], [F.col("value").desc(), F.col("event_id").asc()]).select("event_type", "event_id", "rank")


@query("p1_score_floor", q.sql("SELECT req_id, unit_idx, score FROM scored WHERE score >= 0.6", "scored"))
def p1(spark, sf):
    return fx.ranked_requests(spark, sf).filter(F.col("score") >= 0.6).select("req_id", "unit_idx", "score")


@query("l1_budget_cap", q.sql("SELECT req_id, unit_idx, rank FROM ranked WHERE score >= 0.55 AND rank <= 6", "ranked"))
def l1(spark, sf):
    return sel.select_and_reorder(fx.ranked_requests(spark, sf), 6, 0.55).select("req_id", "unit_idx", "rank")


@query("l2_relevance_order", q.sql("SELECT req_id, string_agg(unit_idx, ',' ORDER BY rank) AS kept FROM ranked WHERE rank <= 6 GROUP BY 1", "ranked"))
def l2(spark, sf):
    kept = sel.select_and_reorder(fx.ranked_requests(spark, sf), 6)
    ordered = F.array_sort(F.collect_list(F.struct("rank", "unit_idx")))
    return kept.groupBy("req_id").agg(join_ints(F.transform(ordered, lambda x: x["unit_idx"])).alias("kept"))


@query("c10_select_and_reorder", q.sql("SELECT req_id, unit_idx, doc_id, rank, score FROM ranked WHERE rank <= 4 AND score >= 0.52", "ranked"))
def c10(spark, sf):
    return sel.select_and_reorder(fx.ranked_requests(spark, sf), 4, 0.52).select("req_id", "unit_idx", "doc_id", "rank", "score")


@query(
    "w12_dynamic_rate",
    q.sql("SELECT req_id, unit_idx, round(greatest(least((1 - 2 * (rank - 1) / n) * 0.3 + 0.75, 1), 0), 6) AS rate FROM ranked", "ranked"),
)
def w12(spark, sf):
    ranked = sel.rank_units(fx.ranked_requests(spark, sf))
    n = ranked.groupBy("req_id").agg(F.count("*").alias("n"))
    rate = sel.dynamic_rate(F.col("rank") - 1, F.col("n"), 0.75)
    return ranked.join(n, "req_id").select("req_id", "unit_idx", F.round(rate, 6).alias("rate"))


@query("j11_score_join", q.sql("SELECT r.req_id, r.unit_idx, l.quality / 1.0 AS score FROM req r LEFT JOIN labels l USING (doc_id)", "req"))
def j11(spark, sf):
    given = fx.table(spark, sf, "labels").select("doc_id", F.col("quality").cast("double").alias("score"))
    return sc.join_scores(fx.requests(spark, sf), given, ["doc_id"]).select("req_id", "unit_idx", "score")


@query(
    "u3_leaked_distractors",
    q.sql("SELECT req_id, unit_idx FROM ranked JOIN labels USING (doc_id) WHERE rank <= 6 AND (quality = 0 OR toxic = 1)", "ranked"),
)
def u3(spark, sf):
    kept = sel.select_and_reorder(fx.ranked_requests(spark, sf), 6)
    bad = fx.table(spark, sf, "labels").filter("quality = 0 or toxic = 1").select("doc_id")
    return kept.join(bad, "doc_id", "left_semi").select("req_id", "unit_idx")


# --- whole jobs over requests ---------------------------------------------------------------------------
TASK = "Answer from the passages."
QUESTION_SQL = "SELECT qid, 'Where is ' || array_to_string(terms, ' ') || '?' AS question FROM questions"


@query(
    "c12_two_stage",
    q.sql(
        f"""SELECT req_id, kept_documents, total_documents, documents_origin, context_origin, context_kept, documents_origin + {q.wc(f"'{TASK}'")} + {q.wc("question")} AS prompt_origin,
             {q.wc("prompt")} AS prompt_words, kept_units, kept_scores, prompt FROM (
           SELECT r.req_id, coalesce(k.kept_documents, 0) AS kept_documents, r.total_documents, r.o AS documents_origin, coalesce(k.o, 0) AS context_origin, coalesce(k.c, 0) AS context_kept,
             coalesce(k.units, '') AS kept_units, coalesce(k.scores, '') AS kept_scores, coalesce(q.question, '') AS question,
             concat_ws(chr(10)||chr(10), '{TASK}', nullif(trim(coalesce(k.t, ' '), {BLANKS}), ''), nullif(q.question, '')) AS prompt
           FROM (SELECT req_id, any_value(qid) AS qid, count(*) AS total_documents, sum(len) AS o FROM ranked JOIN dlen USING (doc_id) GROUP BY 1) r
           LEFT JOIN (SELECT req_id, count(*) AS kept_documents, sum(len) AS o, sum(kept_words) AS c, string_agg(compressed, chr(10)||chr(10) ORDER BY rank) AS t,
             string_agg(unit_idx::VARCHAR, ',' ORDER BY rank) AS units, string_agg(round(score * 1000000)::BIGINT::VARCHAR, ',' ORDER BY rank) AS scores
             FROM ranked JOIN rate_text USING (doc_id) JOIN dlen USING (doc_id) WHERE rank <= 4 GROUP BY 1) k USING (req_id)
           LEFT JOIN ({QUESTION_SQL}) q ON q.qid = r.qid)""",
        "ranked", "dlen", "rate_text", "questions",
    ),
)
def c12(spark, sf):
    units = fx.ranked_requests(spark, sf)
    out = cp.two_stage(units, fx.shown_questions(spark, sf), sc.vocabulary(fx.docs(spark, sf)), TASK, 0.5, 4)
    millionths = F.transform("kept_scores", lambda x: F.round(x * 1_000_000).cast("bigint"))
    return out.withColumn("kept_units", F.coalesce(join_ints(F.col("kept_units")), F.lit(""))).withColumn("kept_scores", F.coalesce(join_ints(millionths), F.lit("")))


@query(
    "c17_question_conditioned",
    q.sql(
        f"""SELECT r.doc_id, r.req_id, r.rank, count(k.pos) AS kept_words, any_value(m.contrast) AS contrast, coalesce(string_agg(k.word, ' ' ORDER BY k.pos), '') AS compressed
           FROM bud r JOIN (SELECT doc_id, round(avg(score), 6) AS contrast FROM rk GROUP BY 1) m ON m.doc_id = r.doc_id LEFT JOIN kept k ON k.doc_id = r.doc_id GROUP BY r.doc_id, r.req_id, r.rank""",
        "ranked", "dlen", "plain", "counts", "qterm",
        bud="""SELECT *, round(greatest(least((1 - 2 * (rank - 1) / n) * 0.3 + 0.5, 1), 0), 9) AS rate FROM (
                 SELECT r.*, sum(l.len) OVER (PARTITION BY req_id ORDER BY rank) - l.len AS before, sum(l.len) OVER (PARTITION BY req_id) AS total
                 FROM ranked r JOIN dlen l USING (doc_id)) WHERE before <= 0.5 * total + 100""",
        given=f"""SELECT qid, term, sum(n) AS follows FROM (SELECT q.qid, lower(p.next) AS term, count(*) AS n FROM (
                    SELECT {q.term("word")} AS form, lead(word) OVER (PARTITION BY doc_id ORDER BY pos) AS next FROM plain) p JOIN qterm q ON q.term = p.form WHERE next IS NOT NULL GROUP BY ALL
                  UNION ALL SELECT qid, term, 1 FROM qterm) GROUP BY ALL""",
        rk="""SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, c, pos) AS r, count(*) OVER (PARTITION BY doc_id) AS n FROM (
              SELECT p.doc_id, p.pos, p.word, c.c, round(log2((coalesce(g.follows, 0) / (c.c / (SELECT sum(c) FROM counts)) + 1) / (coalesce(s.a, 0) + 1)), 6) AS score
              FROM bud b JOIN plain p USING (doc_id) JOIN counts c ON c.term = lower(p.word) LEFT JOIN given g ON g.qid = b.qid AND g.term = lower(p.word)
              LEFT JOIN (SELECT qid, sum(follows) AS a FROM given GROUP BY 1) s ON s.qid = b.qid)""",
        kept="""SELECT doc_id, pos, word FROM (SELECT *, lag(word) OVER (PARTITION BY doc_id ORDER BY pos) AS prev FROM (
                  SELECT p.* FROM bud b JOIN rk p USING (doc_id) WHERE p.r <= ceil(b.rate * p.n) OR regexp_matches(p.word, '[0-9]') OR p.word IN ('.', '!', '?', ',')))
                WHERE NOT (word IN ('.', '!', '?', ',') AND prev IS NOT DISTINCT FROM word)""",
    ),
)
def c17(spark, sf):
    asked = fx.questions(spark, sf).join(fx.shown_questions(spark, sf), "qid")
    docs = fx.docs(spark, sf)
    return cp.question_conditioned(fx.ranked_requests(spark, sf), asked, docs, sc.vocabulary(docs), 0.5)


# --- dedup -------------------------------------------------------------------------------------------------
DEDUP_T = 0.8
SENTENCE_SQL = r"""SELECT doc_id, unnest(ss) AS sentence, generate_subscripts(ss, 1) - 1 AS idx FROM (
          SELECT doc_id, list_filter(list_transform(flatten(list_transform(string_split(text, chr(10)),
            lambda p: string_split(regexp_replace(trim(p, chr(9)||chr(13)||' '), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)))),
            lambda s: trim(s, chr(9)||chr(13)||' ')), lambda s: s <> '') AS ss FROM documents)"""
BAG_SQL = r"SELECT doc_id, idx, w, count(*) AS c FROM (SELECT doc_id, idx, unnest(regexp_extract_all(lower(sentence), '\S+')) AS w FROM sent) GROUP BY ALL"
PAIR_SQL = """SELECT a.doc_id, a.idx AS i, b.idx AS j, sum(a.c * b.c) / sqrt(any_value(x.sq) * any_value(y.sq)) AS sim FROM bag a JOIN bag b ON b.doc_id = a.doc_id AND b.w = a.w AND a.idx < b.idx
              JOIN sq x ON x.doc_id = a.doc_id AND x.idx = a.idx JOIN sq y ON y.doc_id = b.doc_id AND y.idx = b.idx GROUP BY ALL"""
SQ_SQL = "SELECT doc_id, idx, sum(c * c) AS sq FROM bag GROUP BY ALL HAVING sum(c * c) > 0"
# unit vectors: word counts times the smoothed idf over all sentences
IDF_SQL = "SELECT doc_id, idx, w, c * ln(((SELECT count(*) FROM sent) + 1.0) / (df + 1)) AS c FROM tf JOIN (SELECT w, count(*) AS df FROM tf GROUP BY w) USING (w)"
VECTOR_CTES = dict(sent=SENTENCE_SQL, tf=BAG_SQL, bag=IDF_SQL, sq=SQ_SQL, pair=PAIR_SQL)
PAIR_T = 0.5


@query(
    "j7_similar_sentences",
    q.sql(
        """SELECT doc_id, i, j, sim FROM (SELECT doc_id, i, j, round(round(sim, 9), 6) AS sim, row_number() OVER (PARTITION BY doc_id ORDER BY round(round(sim, 9), 6) DESC, i DESC, j DESC) AS rk
            FROM pair) WHERE rk <= 18""",
        **VECTOR_CTES,
    ),
)
def j7(spark, sf):
    return dedup.top_pairs(fx.docs(spark, sf), None, 18)


@query(
    "l4_top_pairs",
    q.sql(
        f"SELECT doc_id, i, j, round(round(sim, 9), 6) AS sim FROM pair WHERE round(sim, 9) >= {PAIR_T} ORDER BY round(round(sim, 9), 6) DESC, doc_id, i DESC, j DESC LIMIT 18",
        **VECTOR_CTES,
    ),
)
def l4(spark, sf):
    pairs = dedup.top_pairs(fx.docs(spark, sf), PAIR_T, 18)
    return pairs.orderBy(F.desc("sim"), "doc_id", F.desc("i"), F.desc("j")).limit(18)


DEDUP_CTES = dict(
    VECTOR_CTES,
    rel=r"""SELECT s.doc_id, s.idx, row_number() OVER (PARTITION BY s.doc_id ORDER BY round(len(list_filter(regexp_extract_all(lower(s.sentence), '\S+'), lambda w: list_contains(a.terms, w)))
              / sqrt(len(regexp_extract_all(lower(s.sentence), '\S+')) * greatest(len(a.terms), 1)), 9) DESC, s.idx) AS rk FROM sent s JOIN asked a USING (doc_id)""",
    near=f"SELECT doc_id, i, list(j) AS js FROM (SELECT doc_id, i, j FROM pair WHERE round(sim, 9) >= {DEDUP_T} UNION ALL SELECT doc_id, j, i FROM pair WHERE round(sim, 9) >= {DEDUP_T}) GROUP BY ALL",
    step="SELECT r.doc_id, r.rk, r.idx, coalesce(n.js, []) AS js FROM rel r LEFT JOIN near n ON n.doc_id = r.doc_id AND n.i = r.idx",
    walk="""SELECT doc_id, 0::BIGINT AS rk, []::BIGINT[] AS kept FROM (SELECT DISTINCT doc_id FROM rel)
            UNION ALL SELECT w.doc_id, s.rk, CASE WHEN list_has_any(w.kept, s.js) THEN w.kept ELSE list_append(w.kept, s.idx) END FROM walk w JOIN step s ON s.doc_id = w.doc_id AND s.rk = w.rk + 1""",
    fin="SELECT doc_id, arg_max(kept, rk) AS kept FROM walk GROUP BY 1",
    dtext="""SELECT d.doc_id, CASE WHEN coalesce(n.n, 0) <= 1 THEN d.text ELSE k.t END AS text FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n FROM sent GROUP BY 1) n USING (doc_id)
             LEFT JOIN (SELECT f.doc_id, string_agg(s.sentence, ' ' ORDER BY s.idx) AS t FROM fin f JOIN sent s ON s.doc_id = f.doc_id AND list_contains(f.kept, s.idx) GROUP BY 1) k USING (doc_id)""",
)


def recursive(sql: str) -> str:
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


@query(
    "c13_dedupe_sentences",
    recursive(q.sql(
        """SELECT n.doc_id, n.n AS n_sentences, len(f.kept) AS n_kept, d.text AS deduped FROM (SELECT doc_id, count(*) AS n FROM sent GROUP BY 1) n
           JOIN fin f USING (doc_id) JOIN dtext d USING (doc_id) WHERE n.n > 1""",
        "asked", **DEDUP_CTES,
    )),
)
def c13(spark, sf):
    rows = dedup.dedupe(fx.asked(spark, sf), DEDUP_T)
    return rows.filter(F.size("sents") > 1).select("doc_id", F.size("sents").alias("n_sentences"), F.size("kept").alias("n_kept"), "deduped")


@query(
    "a20_dropped_sentences",
    recursive(q.sql(
        """SELECT doc_id, n, idx, sentence, sim, closest FROM (
             SELECT s.doc_id, n.n, s.idx, s.sentence, round(p.sim, 9) AS sim, k.idx AS closest, row_number() OVER (PARTITION BY s.doc_id, s.idx ORDER BY round(p.sim, 9) DESC, k.rk) AS first
             FROM close p JOIN fin f USING (doc_id) JOIN (SELECT doc_id, count(*) AS n FROM sent GROUP BY 1) n USING (doc_id)
             JOIN sent s ON s.doc_id = p.doc_id AND s.idx = p.idx JOIN rel r ON r.doc_id = p.doc_id AND r.idx = p.idx
             JOIN rel k ON k.doc_id = p.doc_id AND k.idx = p.k AND list_contains(f.kept, p.k) AND k.rk < r.rk
             WHERE NOT list_contains(f.kept, s.idx)) WHERE first = 1""",
        "asked", **DEDUP_CTES,
        close=f"SELECT doc_id, i AS idx, j AS k, sim FROM pair WHERE round(sim, 9) >= {DEDUP_T} UNION ALL SELECT doc_id, j, i, sim FROM pair WHERE round(sim, 9) >= {DEDUP_T}",
    )),
)
def a20(spark, sf):
    rows = dedup.dedupe(fx.asked(spark, sf), DEDUP_T)
    return rows.withColumn("n", F.size("sents")).select("doc_id", "n", F.explode("dropped").alias("d")).select("doc_id", "n", "d.*")


# --- evaluation compress and arms ---------------------------------------------------------------------------
CELL_CTES = dict(
    arm="SELECT doc_id, FALSE AS use_dedup, text FROM documents UNION ALL SELECT doc_id, TRUE, text FROM dtext",
    asent=SENTENCE_SQL.replace("SELECT doc_id, unnest", "SELECT doc_id, use_dedup, unnest").replace("SELECT doc_id, list_filter", "SELECT doc_id, use_dedup, list_filter").replace("FROM documents", "FROM arm"),
    aunit="SELECT doc_id, use_dedup, idx // 3 AS unit, string_agg(sentence, ' ' ORDER BY idx) AS body FROM asent GROUP BY ALL",
    abest=r"""SELECT * FROM (SELECT u.*, row_number() OVER (PARTITION BY doc_id, use_dedup ORDER BY round(len(list_filter(regexp_extract_all(lower(u.body), '\S+'), lambda w: list_contains(a.terms, w)))
              / sqrt(len(regexp_extract_all(lower(u.body), '\S+')) * greatest(len(a.terms), 1)), 9) DESC, unit) AS rank FROM aunit u JOIN asked a USING (doc_id)) WHERE rank <= 6""",
    aword=r"""SELECT doc_id, use_dedup, generate_subscripts(ws, 1) - 1 AS pos, unnest(ws) AS word FROM (
              SELECT doc_id, use_dedup, regexp_extract_all(string_agg(body, ' ' ORDER BY rank), '\S+') AS ws FROM abest GROUP BY ALL)""",
    akept="""SELECT * FROM (SELECT *, lag(word) OVER (PARTITION BY doc_id, use_dedup, rate ORDER BY pos) AS prev FROM (
               SELECT w.*, row_number() OVER (PARTITION BY w.doc_id, use_dedup ORDER BY c.c, pos) AS rk, count(*) OVER (PARTITION BY w.doc_id, use_dedup) AS n
               FROM aword w JOIN counts c ON c.term = lower(w.word)) CROSS JOIN (SELECT unnest([0.75, 0.5])::DOUBLE AS rate)
               WHERE rk <= ceil(rate * n) OR regexp_matches(word, '[0-9]') OR word IN ('.', '!', '?', ','))
             WHERE NOT (word IN ('.', '!', '?', ',') AND prev IS NOT DISTINCT FROM word)""",
    cell="""SELECT a.doc_id, a.use_dedup, rate, l.len AS origin_words, count(*) AS kept_words, string_agg(word, ' ' ORDER BY pos) AS compressed,
              round_even(count(*) / greatest(any_value(l.len), 1), 3) AS retention FROM akept a JOIN dlen l USING (doc_id) GROUP BY ALL""",
)


@query("c14_eval_compress", recursive(q.sql("SELECT * FROM cell", "asked", "counts", "dlen", **DEDUP_CTES, **CELL_CTES)))
def c14(spark, sf):
    v = sc.vocabulary(fx.docs(spark, sf))
    return cp.eval_compress(fx.asked(spark, sf), v, [0.75, 0.5], DEDUP_T, 3, 6)


# requests of several documents: the terms are the request's, so the dedup walks by them
MULTI_ASKED = "SELECT r.doc_id, r.text, r.qid, coalesce(q.terms, []) AS terms FROM req r LEFT JOIN questions q USING (qid)"
MULTI_CTES = dict(
    marm="""SELECT r.req_id, r.unit_idx, r.doc_id, a.terms, u.use_dedup, CASE WHEN u.use_dedup THEN d.text ELSE r.text END AS text,
              CASE WHEN u.use_dedup THEN coalesce(f.n_sent - len(f.kept), 0) ELSE 0 END AS dropped_sentences
            FROM req r JOIN asked a USING (doc_id) JOIN dtext d USING (doc_id) LEFT JOIN (SELECT fin.doc_id, fin.kept, n.n AS n_sent FROM fin JOIN (
              SELECT doc_id, count(*) AS n FROM sent GROUP BY 1) n USING (doc_id)) f USING (doc_id), (SELECT unnest([false, true]) AS use_dedup) u""",
    mbest=r"""SELECT *, regexp_extract_all(text, '\S+') AS ws FROM (SELECT *, row_number() OVER (PARTITION BY req_id, use_dedup ORDER BY score DESC, unit_idx) AS rank FROM (
              SELECT *, coalesce(round(len(list_filter(lw, lambda w: list_contains(terms, w))) / nullif(sqrt(len(lw) * greatest(len(terms), 1)), 0), 9), 0) AS score
              FROM (SELECT *, regexp_extract_all(lower(text), '\S+') AS lw FROM marm))) WHERE rank <= 5""",
    mword="SELECT req_id, use_dedup, rank, generate_subscripts(ws, 1) - 1 AS pos, unnest(ws) AS word FROM mbest",
    mkept="""SELECT * FROM (SELECT *, lag(word) OVER (PARTITION BY req_id, use_dedup, rate, rank ORDER BY pos) AS prev FROM (
               SELECT w.*, row_number() OVER (PARTITION BY req_id, use_dedup, rank ORDER BY c.c, pos) AS rk, count(*) OVER (PARTITION BY req_id, use_dedup, rank) AS n
               FROM mword w JOIN counts c ON c.term = lower(w.word)) CROSS JOIN (SELECT unnest([0.75, 0.5])::DOUBLE AS rate)
               WHERE rk <= ceil(rate * n) OR regexp_matches(word, '[0-9]') OR word IN ('.', '!', '?', ','))
             WHERE NOT (word IN ('.', '!', '?', ',') AND prev IS NOT DISTINCT FROM word)""",
    mcell="""SELECT b.req_id, b.use_dedup, k.rate, b.rank, b.unit_idx, b.score, b.dropped_sentences, k.kept_words, k.compressed FROM mbest b JOIN (
               SELECT req_id, use_dedup, rate, rank, count(*) AS kept_words, string_agg(word, ' ' ORDER BY pos) AS compressed FROM mkept GROUP BY ALL) k
             USING (req_id, use_dedup, rank)""",
)


def multi_sql(final: str) -> str:
    own = dict(asked=MULTI_ASKED, **DEDUP_CTES, **MULTI_CTES)
    return recursive(q.sql(final, "req", "questions", "counts", **own))


def multi_units(spark, sf):
    rows = fx.requests(spark, sf).join(fx.questions(spark, sf), "qid", "left")
    return rows.withColumn("terms", F.coalesce("terms", F.array().cast("array<string>")))


def multi_cells(spark, sf):
    return cp.eval_compress_documents(multi_units(spark, sf), sc.vocabulary(fx.docs(spark, sf)), [0.75, 0.5], DEDUP_T, 5)


@query("c14_eval_documents", multi_sql("SELECT * FROM mcell"))
def c14_documents(spark, sf):
    return multi_cells(spark, sf)


@query(
    "c14_document_totals",
    multi_sql(
        """SELECT m.req_id, use_dedup, rate, kept_words::BIGINT AS kept_words, idx AS kept_indices, total_units, origin_words::BIGINT AS origin_words, round_even(kept_words / greatest(origin_words, 1), 3) AS retention
           FROM (SELECT req_id, use_dedup, rate, sum(kept_words) AS kept_words, string_agg(unit_idx::VARCHAR, ',' ORDER BY rank) AS idx FROM mcell GROUP BY ALL) m
           JOIN (SELECT req_id, count(*) AS total_units, sum(len(regexp_extract_all(text, '\\S+'))) AS origin_words FROM req GROUP BY 1) o USING (req_id)"""
    ),
)
def c14_totals(spark, sf):
    rows = cp.eval_document_totals(multi_cells(spark, sf), multi_units(spark, sf))
    return rows.withColumn("kept_indices", join_ints(F.col("kept_indices")))


@query(
    "c18_arm_grid",
    recursive(q.sql(
        "SELECT rate, use_dedup, count(*) AS n_texts, sum(origin_words) AS origin_words, sum(kept_words) AS kept_words, round(avg(retention), 6) AS mean_retention FROM cell GROUP BY ALL",
        "asked", "counts", "dlen", **DEDUP_CTES, **CELL_CTES,
    )),
)
def c18(spark, sf):
    v = sc.vocabulary(fx.docs(spark, sf))
    cells = cp.eval_compress(fx.asked(spark, sf), v, [0.75, 0.5], DEDUP_T, 3, 6)
    return cells.groupBy("rate", "use_dedup").agg(
        F.count("*").alias("n_texts"), F.sum("origin_words").alias("origin_words"), F.sum("kept_words").alias("kept_words"),
        F.round(F.avg("retention"), 6).alias("mean_retention"),
    )
