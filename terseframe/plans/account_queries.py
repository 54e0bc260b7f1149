"""Routing, validation, accounting, sessions and transcript timing."""

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import account as ac, compress as cp, merge as mg, scores as sc, selection as sel
from ..operators.chat import chat_messages
from ..session import materialize
from . import fixtures as fx, sqltext as q
from .registry import query

CONV = ["conv_id"]


# --- requests -------------------------------------------------------------------------------
REQUEST_COLS = {
    "rate": "CASE WHEN event_id % 17 = 0 THEN 0.0 WHEN event_id % 19 = 0 THEN 1.5 ELSE (event_id % 10 + 1) / 10.0 END",
    "mode": "CASE WHEN event_id % 23 = 0 THEN 'both' WHEN event_id % 2 = 0 THEN 'union' ELSE 'intersection' END",
    "chunk_size": "CASE WHEN event_id % 29 = 0 THEN 0 ELSE 300 END",
    "top_k": "CASE WHEN event_id % 31 = 0 THEN -1 ELSE 12 END",
    "bits": "event_id % 9",
    "max_tokens": "CASE WHEN event_id % 37 = 0 THEN 4096 ELSE 256 END",
}
REQUESTS_SQL = "SELECT event_id, " + ", ".join(f"{e} AS {n}" for n, e in REQUEST_COLS.items()) + " FROM events"


@query(
    "p6_validation",
    f"""SELECT event_id, CASE WHEN NOT (rate > 0 AND rate <= 1) THEN 'rate' WHEN mode NOT IN ('intersection', 'union') THEN 'mode' WHEN NOT chunk_size > 0 THEN 'chunk_size'
          WHEN NOT top_k > 0 THEN 'top_k' WHEN bits NOT BETWEEN 2 AND 8 THEN 'bits' WHEN max_tokens NOT BETWEEN 1 AND 2048 THEN 'max_tokens' END AS error FROM ({REQUESTS_SQL})""",
)
def p6(spark, sf):
    rows = fx.table(spark, sf, "events").select("event_id", *[F.expr(e).alias(n) for n, e in REQUEST_COLS.items()])
    c = F.col
    error = cp.validation_error(c("rate"), c("mode"), c("chunk_size"), c("top_k"), c("bits"), c("max_tokens"))
    return rows.select("event_id", error.alias("error"))


@query(
    "p7_routing",
    """SELECT event_id, query, CASE WHEN r AND g AND query <> '' THEN 'both' WHEN r THEN 'rate' WHEN g THEN 'guided' ELSE 'none' END AS route,
         CASE WHEN NOT r AND NOT g THEN 'no compression' WHEN r AND g AND query = '' THEN 'attentionrag skipped (no question)' END AS note
       FROM (SELECT event_id, event_id % 4 IN (1, 3) AS r, event_id % 4 IN (2, 3) AS g,
         trim(CASE WHEN event_id % 3 = 0 THEN 'focus ' || event_type WHEN event_id % 5 = 0 THEN ' ' ELSE coalesce(CASE WHEN event_id % 7 <> 0 THEN event_type END, '') END) AS query FROM events)""",
)
def p7(spark, sf):
    e = F.col("event_id")
    methods = F.array_compact(F.array(F.when(e % 4 % 2 == 1, " LLMLingua "), F.when((e % 4).isin(2, 3), "AttentionRAG")))
    rows = fx.table(spark, sf, "events").select(
        "event_id", methods.alias("methods"),
        F.when(e % 3 == 0, F.concat(F.lit("focus "), "event_type")).when(e % 5 == 0, " ").alias("attn_query"),
        F.when(e % 7 != 0, F.col("event_type")).alias("question"),
    )
    return cp.route(rows).select("event_id", "query", "route", "note")


CHOICE_SQL = ["none", "llmlingua", "attentionrag", "both-intersection", "both-union"]
ANSWER_SQL = ["claude", "chatgpt", "qwen", "qwen-quant", "lclm", "lclm-quant"]


@query(
    "p8_panel_options",
    """SELECT event_id, c AS compression, a AS answerer, CASE c WHEN 'none' THEN '' WHEN 'llmlingua' THEN 'llmlingua' WHEN 'attentionrag' THEN 'attentionrag' ELSE 'llmlingua,attentionrag' END AS methods,
         CASE WHEN c = 'both-union' THEN 'union' ELSE 'intersection' END AS combine, split_part(a, '-', 1) AS backend, ends_with(a, '-quant') AS quantized
       FROM (SELECT event_id, (['none', 'llmlingua', 'attentionrag', 'both-intersection', 'both-union'])[event_id % 5 + 1] AS c,
         (['claude', 'chatgpt', 'qwen', 'qwen-quant', 'lclm', 'lclm-quant'])[event_id % 6 + 1] AS a FROM events)""",
)
def p8(spark, sf):
    a, b = ac.option_tables(spark)
    pick = lambda names, n: F.get(F.array(*[F.lit(x) for x in names]), (F.col("event_id") % n).cast("int"))
    rows = fx.table(spark, sf, "events").select("event_id", pick(CHOICE_SQL, 5).alias("compression"), pick(ANSWER_SQL, 6).alias("answerer"))
    # both option tables have a fixed number of rows
    held = rows.join(F.broadcast(a), "compression").join(F.broadcast(b), "answerer")
    return held.withColumn("methods", F.array_join("methods", ","))


STAT_ROWS = """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_id % 50 END AS ot, CASE WHEN event_id % 2 = 0 THEN event_id % 40 END AS nw, props AS t,
                 CASE WHEN event_id % 3 = 0 THEN event_id % 7 END AS ct, CASE WHEN event_id % 2 = 0 THEN event_id % 11 END AS nk, event_type AS ctext FROM events"""


@query(
    "p9_token_stats",
    rf"""SELECT event_id, origin, kept, round_even(CASE WHEN kept > 0 THEN origin / kept END, 2) AS ratio_2dp, floor(CASE WHEN kept > 0 THEN origin / kept END * 10 + 0.5) / 10 AS ratio_1dp
         FROM (SELECT event_id, coalesce(ot, nw, {q.wc('t')}) AS origin, coalesce(ct, nk, {q.wc('ctext')}) AS kept FROM ({STAT_ROWS}))""",
)
def p9(spark, sf):
    e = F.col("event_id")
    stats = ac.token_stats(
        F.when(e % 3 == 0, e % 50), F.when(e % 2 == 0, e % 40), F.col("props"),
        F.when(e % 3 == 0, e % 7), F.when(e % 2 == 0, e % 11), F.col("event_type"),
    )
    return fx.table(spark, sf, "events").select("event_id", *[c.alias(n) for n, c in stats.items()])


@query("p10_hard_ratio", q.sql("SELECT doc_id, origin_words, kept_words, round_even(origin_words / greatest(kept_words, 1), 2) AS hard_ratio FROM rate_text", "rate_text"))
def p10(spark, sf):
    rows = cp.compress(fx.docs(spark, sf), sc.vocabulary(fx.docs(spark, sf)), 0.5)
    return rows.select("doc_id", "origin_words", "kept_words", ac.hard_ratio(F.col("origin_words"), F.col("kept_words")).alias("hard_ratio"))


@query("p12_percent_saved", q.sql("SELECT conv_id, turn, round((1 - compressed_tokens / greatest(1, origin_tokens)) * 100, 6) AS pct FROM utt_done WHERE n > 0", "utt_done"))
def p12(spark, sf):
    rows = fx.compressed_utterances(spark, sf).filter("origin_tokens is not null")
    return rows.select("conv_id", "turn", F.round(ac.percent_saved(F.col("origin_tokens"), F.col("compressed_tokens")), 6).alias("pct"))


@query(
    "p13_retention",
    q.sql(
        "SELECT conv_id, turn, round(CASE WHEN n = 0 THEN 0 ELSE compressed_tokens / n END, 6) AS bench, round_even(coalesce(compressed_tokens, 0) / greatest(n, 1), 3) AS eval, "
        "round_even(n / greatest(coalesce(compressed_tokens, 0), 1), 2) AS inverse FROM utt_done",
        "utt_done",
    ),
)
def p13(spark, sf):
    rows = fx.compressed_utterances(spark, sf)
    kept = F.coalesce("compressed_tokens", F.lit(0))
    return rows.select(
        "conv_id", "turn", F.round(F.when(F.col("n") == 0, 0.0).otherwise(kept / F.col("n")), 6).alias("bench"),
        F.bround(kept / F.greatest("n", F.lit(1)), 3).alias("eval"), ac.hard_ratio(F.col("n"), kept).alias("inverse"),
    )


@query("p4_blank_guards", q.sql("SELECT r.req_id, coalesce(k.t, ' ') AS context FROM (SELECT DISTINCT req_id FROM req) r LEFT JOIN (SELECT req_id, string_agg(unit_idx, ',' ORDER BY rank) AS t FROM ranked WHERE score >= 0.9 AND rank <= 3 GROUP BY 1) k USING (req_id)", "ranked"))
def p4(spark, sf):
    kept = sel.select_and_reorder(fx.ranked_requests(spark, sf), 3, 0.9)
    ordered = F.array_sort(F.collect_list(F.struct("rank", F.col("unit_idx").cast("string").alias("u"))))
    text = kept.groupBy("req_id").agg(F.array_join(F.transform(ordered, lambda x: x["u"]), ",").alias("context"))
    ids = fx.requests(spark, sf).select("req_id").distinct()
    return ids.join(text, "req_id", "left").select("req_id", F.coalesce("context", F.lit(" ")).alias("context"))


# --- the two panels ----------------------------------------------------------------------------
def panels(rows, choices):
    """Layer-one text per panel over the same decisions; panels are rows of one plan."""
    cell = lambda name, methods, mode: F.struct(
        F.lit(name).alias("panel"), F.array(*[F.lit(m) for m in methods]).cast("array<string>").alias("methods"), F.lit(mode).alias("mode")
    )
    each = rows.withColumn("_p", F.explode(F.array(*[cell(*c) for c in choices]))).select("*", "_p.*").drop("_p")
    routed = cp.route(each.withColumn("attn_query", F.lit(None).cast("string")))
    both = cp.merged_text(routed, F.col("mode"), F.size(F.coalesce("spans", F.array())) == 0)
    return both.withColumn(
        "shown",
        F.when(F.col("route") == "both", F.col("merged_text"))
        .when(F.col("route") == "rate", mg.words_at(F.col("words"), F.col("kept")))
        .when(F.col("route") == "guided", mg.splice_spans(F.col("text"), F.col("spans")))
        .otherwise(F.col("text")),
    )


PANELS = [("none", [], "intersection"), ("rate", ["llmlingua"], "intersection"), ("guided", ["attentionrag"], "intersection"),
          ("both", ["llmlingua", "attentionrag"], "union")]


@query(
    "c16_playground",
    q.sql(
        f"""SELECT doc_id, panel, t AS shown, {q.wc('t')} AS kept_words, round_even({q.wc('text')} / greatest({q.wc('t')}, 1), 2) AS hard_ratio FROM (
             SELECT d.doc_id, d.text, p.panel, CASE p.panel WHEN 'none' THEN d.text WHEN 'rate' THEN r.compressed WHEN 'guided' THEN coalesce(k.t, d.text) ELSE m.merged_text END AS t
             FROM gdoc d CROSS JOIN (SELECT unnest(['none', 'rate', 'guided', 'both']) AS panel) p JOIN rate_text r USING (doc_id)
             LEFT JOIN (SELECT doc_id, string_agg(sentence, ' ' ORDER BY s) AS t FROM gkept GROUP BY 1) k USING (doc_id) JOIN merged m ON m.doc_id = d.doc_id AND m.mode = 'union')""",
        "gdoc", "rate_text", "gkept", "merged",
    ),
)
def c16(spark, sf):
    out = panels(fx.decisions(spark, sf, carry=["text", "question"]), PANELS)
    kept = tx.word_count(F.col("shown"))
    return out.select("doc_id", "panel", "shown", kept.alias("kept_words"), ac.hard_ratio(tx.word_count(F.col("text")), kept).alias("hard_ratio"))


@query(
    "j10_two_panels",
    q.sql(
        "SELECT r.doc_id, r.kept_words AS kept_a, m.n_kept AS kept_b, m.n_kept - r.kept_words AS delta FROM rate_text r JOIN merged m ON m.doc_id = r.doc_id AND m.mode = 'union'",
        "rate_text", "merged",
    ),
)
def j10(spark, sf):
    out = panels(fx.decisions(spark, sf, carry=["text", "question"]), [PANELS[1], PANELS[3]])
    of = lambda name: F.max(F.when(F.col("panel") == name, tx.word_count(F.col("shown"))))
    both = out.groupBy("doc_id").agg(of("rate").alias("kept_a"), of("both").alias("kept_b"))
    return both.withColumn("delta", F.col("kept_b") - F.col("kept_a"))


# --- sessions -------------------------------------------------------------------------------------
@query("j8_row_results", q.sql("SELECT u.conv_id, u.turn, CASE WHEN u.turn % 6 = 5 THEN 'error' WHEN d.compressed_tokens IS NULL THEN 'compressing' ELSE 'ready' END AS state, d.compressed_tokens FROM utt u LEFT JOIN utt_done d USING (conv_id, turn)", "utt_done"))
def j8(spark, sf):
    rows = fx.compressed_utterances(spark, sf)
    results = rows.filter("compressed_tokens is not null").select(
        "conv_id", "turn", "compressed_tokens", F.lit(1).alias("result_ts"), F.when(F.col("turn") % 6 == 5, "failed").alias("error")
    )
    from ..streaming.rows import lifecycle

    out = lifecycle(rows.select("conv_id", "turn"), results, ["conv_id", "turn"])
    return out.select("conv_id", "turn", "state", "compressed_tokens")


@query(
    "j9_raw_against_compressed",
    q.sql(
        r"""SELECT conv_id, turn, CASE WHEN r IS NULL OR c IS NULL OR r = '' OR c = '' THEN NULL ELSE n(r) = n(c) END AS match FROM (
              SELECT conv_id, turn, text AS r, CASE WHEN turn % 3 = 0 THEN text || ' !' WHEN turn % 3 = 1 THEN compressed END AS c FROM utt_done)""".replace(
            "n(r)", r"trim(regexp_replace(regexp_replace(lower(r), '[^a-z0-9\s]', '', 'g'), '\s+', ' ', 'g'))"
        ).replace("n(c)", r"trim(regexp_replace(regexp_replace(lower(c), '[^a-z0-9\s]', '', 'g'), '\s+', ' ', 'g'))"),
        "utt_done",
    ),
)
def j9(spark, sf):
    rows = materialize(fx.compressed_utterances(spark, sf).select("conv_id", "turn", "text", "compressed"))
    raw = rows.select("conv_id", "turn", F.nullif("text", F.lit("")).alias("r"))
    short = rows.select("conv_id", "turn", F.nullif(F.when(F.col("turn") % 3 == 0, F.concat("text", F.lit(" !"))).when(F.col("turn") % 3 == 1, F.col("compressed")), F.lit("")).alias("c"))
    held = raw.join(short, ["conv_id", "turn"])
    same = tx.normalize_loose(F.col("r")) == tx.normalize_loose(F.col("c"))
    return held.select("conv_id", "turn", same.alias("match"))


PRICE_SQL = "(VALUES ('sonnet-4-6', 3.0, 15.0), ('opus-4-7', 15.0, 75.0), ('haiku-4-5', 1.0, 5.0), ('gpt-4o', 2.5, 10.0)) p(model, i, o)"
TOTALS_SQL = """SELECT conv_id, sum(origin_tokens) AS origin, sum(compressed_tokens) AS compressed, sum(origin_tokens) - sum(compressed_tokens) AS saved,
  round(CASE WHEN sum(origin_tokens) > 0 THEN (sum(origin_tokens) - sum(compressed_tokens)) / sum(origin_tokens) ELSE 0 END, 6) AS pct_saved, count(*) AS utterances,
  round(coalesce(avg(nullif(latency_ms, 0)), 0), 6) AS avg_latency FROM utt_done WHERE compressed_tokens IS NOT NULL GROUP BY 1"""


@query("j12_price_join", q.sql(f"SELECT conv_id, turn, model, round(origin_tokens / 1e6 * i, 9) AS input_usd, round(compressed_tokens / 1e6 * o, 9) AS output_usd FROM utt_done, {PRICE_SQL} WHERE model = (['sonnet-4-6', 'opus-4-7', 'haiku-4-5', 'gpt-4o'])[turn % 4 + 1]", "utt_done"))
def j12(spark, sf):
    models = F.array(*[F.lit(m) for m, _, _ in ac.PRICES])
    rows = fx.compressed_utterances(spark, sf).withColumn("model", F.get(models, (F.col("turn") % 4).cast("int")))
    held = rows.join(F.broadcast(ac.price_list(spark)), "model")
    return held.select(
        "conv_id", "turn", "model", F.round(ac.input_cost(F.col("origin_tokens"), F.col("input_per_mtok")), 9).alias("input_usd"),
        F.round(ac.input_cost(F.col("compressed_tokens"), F.col("output_per_mtok")), 9).alias("output_usd"),
    )


@query("a14_session_totals", q.sql(TOTALS_SQL, "utt_done"))
def a14(spark, sf):
    return ac.session_totals(fx.compressed_utterances(spark, sf), CONV)


@query("a14_ratio_series", q.sql("SELECT conv_id, turn, round(compressed_tokens / origin_tokens, 6) AS ratio FROM utt_done WHERE origin_tokens > 0", "utt_done"))
def a14_series(spark, sf):
    return ac.ratio_series(fx.compressed_utterances(spark, sf), CONV, "turn").withColumn("ratio", F.round("ratio", 6))


@query("a15_usd_saved", q.sql(f"SELECT conv_id, model, saved, round(saved / 1e6 * i, 9) AS usd_saved FROM tot, {PRICE_SQL}", "utt_done", tot=TOTALS_SQL))
def a15(spark, sf):
    totals = ac.session_totals(fx.compressed_utterances(spark, sf), CONV)
    prices = F.array(*[F.struct(F.lit(m).alias("model"), F.lit(i).alias("i")) for m, i, _ in ac.PRICES])
    each = totals.select("conv_id", "saved", F.explode(prices).alias("p"))
    return each.select("conv_id", "p.model", "saved", F.round(ac.input_cost(F.col("saved"), F.col("p.i")), 9).alias("usd_saved"))


@query(
    "a16_hourly_projection",
    q.sql(
        """SELECT conv_id, saved, round(CASE WHEN n >= 2 AND saved > 0 THEN saved / greatest(0.0001, (l - f) / 3600000) ELSE 0 END, 4) AS per_hour FROM (
             SELECT conv_id, count(*) AS n, coalesce(sum(origin_tokens - compressed_tokens), 0) AS saved, arg_min(start_ms, turn) AS f, arg_max(end_ms, turn) AS l FROM utt_done GROUP BY 1)""",
        "utt_done",
    ),
)
def a16(spark, sf):
    return ac.hourly_projection(fx.compressed_utterances(spark, sf), CONV, "turn")


@query(
    "a17_sparkline",
    q.sql(
        """SELECT conv_id, turn, round((v - min(v) OVER w) / CASE WHEN max(v) OVER w = min(v) OVER w THEN 1 ELSE max(v) OVER w - min(v) OVER w END, 6) AS y FROM (
             SELECT conv_id, turn, 1 - compressed_tokens / origin_tokens AS v, count(*) OVER (PARTITION BY conv_id) AS n FROM utt_done WHERE origin_tokens > 0) WHERE n >= 2 WINDOW w AS (PARTITION BY conv_id)""",
        "utt_done",
    ),
)
def a17(spark, sf):
    return ac.sparkline(ac.ratio_series(fx.compressed_utterances(spark, sf), CONV, "turn"), CONV, "turn")


@query(
    "w11_running_totals",
    q.sql(
        "SELECT conv_id, turn, sum(coalesce(origin_tokens, 0)) OVER w AS origin_so_far, sum(coalesce(compressed_tokens, 0)) OVER w AS compressed_so_far FROM utt_done WINDOW w AS (PARTITION BY conv_id ORDER BY turn)",
        "utt_done",
    ),
)
def w11(spark, sf):
    done = fx.compressed_utterances(spark, sf).select("conv_id", "turn", "origin_tokens", "compressed_tokens")
    rows = ac.running_totals(done, CONV, "turn")
    return rows.select("conv_id", "turn", "origin_so_far", "compressed_so_far")


SHAPE = dict(layers=48, heads=8, dim=128)
SEQ_SQL = "SELECT conv_id, count(*) AS turns, sum(n) AS seq FROM utt GROUP BY 1"


@query(
    "a23_kv_cost",
    q.sql(
        """SELECT conv_id, turns, seq, 2 * 48 * 8 * 128 * 2 * seq AS fp16_bytes, 2 * 48 * 8 * (4 * 128 + 32) * seq // 8 AS coded_bytes, 2 * 48 * 8 * (3 * 96 + 4 * 32 + 64) * seq // 8 AS mixed_bytes,
             round_even((2 * 48 * 8 * 128 * 2 * seq) / nullif(2 * 48 * 8 * (4 * 128 + 32) * seq // 8, 0), 2) AS factor FROM (SELECT conv_id, turns, seq::BIGINT AS seq FROM seqs)""",
        "utt", seqs=SEQ_SQL,
    ),
)
def a23(spark, sf):
    seqs = fx.utterances(spark, sf).groupBy("conv_id").agg(F.count("*").alias("turns"), F.sum("n").alias("seq"))
    seq = F.col("seq")
    full = ac.kv_bytes(SHAPE["layers"], SHAPE["heads"], seq, SHAPE["dim"])
    coded = ac.coded_kv_bytes(SHAPE["layers"], SHAPE["heads"], seq, SHAPE["dim"], 4)
    mixed = ac.coded_kv_bytes(SHAPE["layers"], SHAPE["heads"], seq, SHAPE["dim"], 3, 32, 4)
    return seqs.select(
        "conv_id", "turns", "seq", full.alias("fp16_bytes"), coded.alias("coded_bytes"), mixed.alias("mixed_bytes"),
        F.bround(F.try_divide(full, coded), 2).alias("factor"),
    )


@query(
    "a24_run_averages",
    q.sql("SELECT turn % 3 AS config, round(avg(latency_ms), 6) AS latency, round(avg(origin_tokens), 6) AS origin, round(avg(compressed_tokens), 6) AS kept FROM utt_done GROUP BY 1", "utt_done"),
)
def a24(spark, sf):
    rows = fx.compressed_utterances(spark, sf).withColumn("config", F.col("turn") % 3)
    mean = lambda c, n: F.round(F.avg(c), 6).alias(n)
    return rows.groupBy("config").agg(mean("latency_ms", "latency"), mean("origin_tokens", "origin"), mean("compressed_tokens", "kept"))


@query(
    "a25_unit_cost",
    q.sql(
        """SELECT n // 100 AS size_class, round(sum(latency_ms) / greatest(sum(n), 1), 6) AS ms_per_token, round(sum(latency_ms) / greatest(sum(ceil(n / 300)), 1), 6) AS ms_per_chunk
           FROM utt_done GROUP BY 1""",
        "utt_done",
    ),
)
def a25(spark, sf):
    rows = fx.compressed_utterances(spark, sf).withColumn("size_class", F.floor(F.col("n") / 100))
    ms = F.sum("latency_ms")
    return rows.groupBy("size_class").agg(
        F.round(ms / F.greatest(F.sum("n"), F.lit(1)), 6).alias("ms_per_token"),
        F.round(ms / F.greatest(F.sum(F.ceil(F.col("n") / 300)), F.lit(1)), 6).alias("ms_per_chunk"),
    )


@query(
    "a26_chat_turns",
    """WITH req AS (SELECT conv_id, CASE WHEN conv_id % 3 = 1 THEN arg_min(text, turn) END AS prompt, CASE WHEN conv_id % 2 = 0 THEN 'Be brief.' END AS system FROM conversations GROUP BY 1)
       SELECT conv_id, 0 AS ord, 'system' AS role, system AS content, NULL AS error FROM req WHERE system IS NOT NULL AND (conv_id % 3 = 0 OR prompt IS NOT NULL)
       UNION ALL SELECT conv_id, turn + 1, role, text, NULL FROM conversations WHERE conv_id % 3 = 0
       UNION ALL SELECT conv_id, 1, CASE WHEN prompt IS NOT NULL THEN 'user' END, prompt, CASE WHEN prompt IS NULL THEN 'Provide either ''prompt'' or ''messages''.' END FROM req WHERE conv_id % 3 > 0""",
)
def a26(spark, sf):
    """Every third conversation asks with its turns, every third with its first text as prompt, the rest with nothing."""
    rows = fx.table(spark, sf, "conversations")
    asks = rows.groupBy("conv_id").agg(F.min_by("text", "turn").alias("first"))
    asks = asks.select(
        "conv_id", F.when(F.col("conv_id") % 3 == 1, F.col("first")).alias("prompt"), F.when(F.col("conv_id") % 2 == 0, "Be brief.").alias("system")
    )
    return chat_messages(asks, rows.filter("conv_id % 3 = 0"), "conv_id", "turn")


# --- timing ------------------------------------------------------------------------------------------
@query(
    "w7_pause_gap",
    q.sql(
        """SELECT conv_id, turn, least(greatest(start_ms - coalesce(lag(end_ms) OVER w, start_ms), 0), 1500) AS gap_ms, greatest(start_ms - coalesce(lag(end_ms) OVER w, start_ms), 0) AS full_gap
           FROM utt WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""",
        "utt",
    ),
)
def w7(spark, sf):
    rows = fx.utterances(spark, sf)
    capped = ac.pause_gaps(rows, CONV, "turn")
    return ac.pause_gaps(capped.withColumnRenamed("gap_ms", "capped"), CONV, "turn", None).select(
        "conv_id", "turn", F.col("capped").alias("gap_ms"), F.col("gap_ms").alias("full_gap")
    )


TIMELINE_SQL = r"""SELECT conv_id, turn, text, p AS n_pieces, per AS per_word_ms, sum(gap + p * per) OVER w AS final_ms, sum(gap + p * per) OVER w - p * per AS first_ms FROM (
    SELECT *, least(greatest(start_ms - coalesce(lag(end_ms) OVER w0, start_ms), 0), 1500) AS gap, greatest(60, least(180, (end_ms - start_ms) // greatest(p, 1))) AS per
    FROM (SELECT *, len(string_split_regex(text, '\s+')) AS p FROM utt) WINDOW w0 AS (PARTITION BY conv_id ORDER BY turn)) WINDOW w AS (PARTITION BY conv_id ORDER BY turn)"""


@query("w9_replay_timeline", q.sql("SELECT conv_id, turn, n_pieces, per_word_ms, first_ms, final_ms FROM tl", "utt", tl=TIMELINE_SQL))
def w9(spark, sf):
    rows = ac.replay_timeline(fx.utterances(spark, sf), CONV, "turn")
    return rows.select("conv_id", "turn", "n_pieces", "per_word_ms", "first_ms", "final_ms")


@query(
    "w10_growing_partials",
    q.sql(
        r"""SELECT conv_id, turn, i, first_ms + i * per_word_ms AS at_ms, array_to_string(string_split_regex(text, '\s+')[1:i + 1], ' ') AS partial
            FROM (SELECT *, unnest(range(n_pieces)) AS i FROM tl)""",
        "utt", tl=TIMELINE_SQL,
    ),
)
def w10(spark, sf):
    return ac.partials(ac.replay_timeline(fx.utterances(spark, sf), CONV, "turn"), CONV, "turn")
