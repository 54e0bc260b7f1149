"""Live transcripts: messages, takes, compression on arrival, totals, sessions."""

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import scores as sc
from ..session import scratch_path
from ..sources import files, schemas, transcripts as tr
from ..streaming import rows as st, takes as tk
from . import fixtures as fx, sqltext as q
from .registry import query

SEGMENT = 3
# one take per turn; segment k holds words 3k..3k+2; interim guesses carry the first word
TAKE_SQL = "conv_id || ':' || turn"
SEG_SQL = f"""SELECT {TAKE_SQL} AS take, k, array_to_string(ws[3 * k + 1:3 * k + 3], ' ') AS seg, ws[3 * k + 1] AS w1, start_ms, n, speaker, k = (n - 1) // 3 AND turn % 8 <> 6 AS last
  FROM (SELECT *, unnest(range((n + 2) // 3)) AS k FROM (SELECT *, regexp_extract_all(text, '\\S+') AS ws FROM utt WHERE n > 0))"""
DONE_SQL = f"SELECT {TAKE_SQL} AS take, array_to_string(regexp_extract_all(text, '\\S+'), ' ') AS text, start_ms, start_ms + 300 * n AS end_ms, speaker FROM utt WHERE n > 0 AND turn % 8 <> 6"
# takes of every eighth turn never get an end mark and expire
ENDED_SQL = f"""SELECT {TAKE_SQL} AS take, CASE WHEN turn % 8 = 6 THEN 'expired' ELSE 'utterance' END AS type, array_to_string(ws, ' ') AS text, start_ms, start_ms + 300 * n AS end_ms, speaker,
  array_to_string(list_transform(list_zip(ws, range(len(ws))), lambda x: x[1] || '@' || (start_ms + 300 * x[2])::BIGINT), ' ') AS words, 2 * ((n - 1) // 3) + 2 AS seq
  FROM (SELECT *, regexp_extract_all(text, '\\S+') AS ws FROM utt WHERE n > 0)"""


def at_clock(ms):
    """The clock of the turns as a time; all begin on one day, since a stream's first watermark is the year 1970."""
    return F.timestamp_millis(F.lit(1_704_067_200_000) + ms.cast("bigint"))


def messages(spark, sf) -> str:
    """Writes the turns as recognition messages (take, seq, last, value), JSON lines.

    Every segment sends an interim guess and then its final form; the last final form of a
    take carries the end mark, but for every eighth turn. A message a month later moves the clock on. A message of another type, or damaged text, takes the first number.
    """
    said = fx.utterances(spark, sf).filter("n > 0").withColumn("ws", tx.split_words(F.col("text")))
    seg = said.withColumn("k", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / SEGMENT).cast("int"))))
    part = F.slice("ws", F.col("k") * SEGMENT + 1, SEGMENT)
    at = lambda i: (F.col("start_ms") + 300 * (F.col("k") * SEGMENT + i)) / 1000.0
    words = F.transform(part, lambda w, i: F.struct(
        w.alias("word"), F.col("speaker").alias("speaker"), at(i).alias("start"), at(i + 1).alias("end")))
    alt = lambda text, ws: F.struct(F.array(F.struct(text.alias("transcript"), ws.alias("words"))).alias("alternatives"))
    final = F.to_json(F.struct(F.lit("Results").alias("type"), F.lit(True).alias("is_final"), alt(F.array_join(part, " "), words).alias("channel")))
    guess = F.to_json(F.struct(F.lit("Results").alias("type"), F.lit(False).alias("is_final"), alt(F.get(part, F.lit(0)), F.slice(words, 1, 1)).alias("channel")))
    end = (F.col("k") == F.floor((F.col("n") - 1) / SEGMENT)) & (F.col("turn") % 8 != 6)
    clock = lambda ms: at_clock(ms).alias("at")
    entry = lambda seq, last, value: F.struct(seq.cast("bigint").alias("seq"), last.alias("last"), clock(F.col("start_ms") + 900 * F.col("k")), value.alias("value"))
    both = F.array(entry(2 * F.col("k") + 1, F.lit(False), guess), entry(2 * F.col("k") + 2, end, final))
    take = F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    rows = seg.select(take.alias("take"), F.explode(both).alias("m")).select("take", "m.*")
    noise = said.select(take.alias("take"), F.lit(0).cast("bigint").alias("seq"), F.lit(False).alias("last"), clock(F.col("start_ms")),
                        F.when(F.col("turn") % 2 == 0, '{"type":"SpeechStarted"}').otherwise("{damaged").alias("value"))
    path = scratch_path(spark, "messages")
    later = F.max("start_ms") + F.lit(30 * 86_400_000)
    tick = said.agg(clock(later)).select(F.lit("clock").alias("take"), F.lit(0).cast("bigint").alias("seq"), F.lit(False).alias("last"), "at", F.lit("{}").alias("value"))
    rows.unionByName(noise).repartition(F.rand(7)).unionByName(tick).write.json(path)
    return path


@query("s8_transcript_scan", q.sql(f"SELECT {TAKE_SQL} AS id, text, start_ms AS \"startMs\", end_ms AS \"endMs\", speaker, n AS n_words FROM utt", "utt"))
def s8(spark, sf):
    path = scratch_path(spark, "utterances")
    said = fx.utterances(spark, sf)
    words = F.transform(tx.split_words(F.col("text")), lambda w: F.struct(w.alias("text"), F.col("speaker").alias("speaker")))
    said.select(
        F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"), "text",
        F.col("start_ms").alias("startMs"), F.col("end_ms").alias("endMs"), "speaker", words.alias("words"),
    ).write.json(path)
    rows = files.read_utterances(spark, path, multi_line=False)
    return rows.select("id", "text", "startMs", "endMs", "speaker", F.size("words").alias("n_words"))


@query(
    "s9_live_messages",
    q.sql(
        """SELECT take, 2 * k + 1 AS seq, false AS is_final, w1 AS text, start_ms + 900 * k AS start_ms FROM seg
           UNION ALL SELECT take, 2 * k + 2, true, seg, start_ms + 900 * k FROM seg""",
        "utt", seg=SEG_SQL,
    ),
)
def s9(spark, sf):
    rows = tr.parse_messages(tr.message_batch(spark, messages(spark, sf)))
    return rows.select("take", "seq", "is_final", "text", "start_ms")


@query("s10_swappable_source", q.sql(f"SELECT 'live' AS kind, take, text FROM done UNION ALL SELECT 'recorded', {TAKE_SQL}, text FROM utt", "utt", done=DONE_SQL))
def s10(spark, sf):
    use_rocksdb(spark)
    live = streamed(spark, tr.source(spark, "live", messages(spark, sf), stream=True), "live").withColumn("kind", F.lit("live"))
    path = scratch_path(spark, "recorded")
    said = fx.utterances(spark, sf)
    said.select(
        F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"), "text",
        F.col("start_ms").alias("startMs"), F.col("end_ms").alias("endMs"), "speaker",
    ).write.json(path)
    recorded = streamed(spark, tr.source(spark, "recorded", path, stream=True), "replayed").withColumn("kind", F.lit("recorded"))
    return live.unionByName(recorded).select("kind", "take", "text")


def streamed_events(spark, sf):
    sink = st.run_available(tk.take_events(tr.message_stream(spark, messages(spark, sf))), scratch_path(spark, "events"))
    return spark.read.schema(schemas.EVENT).parquet(sink)


def streamed(spark, df, name):
    """The rows of an append stream, drained into a written table."""
    return spark.read.schema(df.schema).parquet(st.run_available(df, scratch_path(spark, name)))


def use_rocksdb(spark):
    """State of transformWithState needs the RocksDB provider."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def shown_words(words):
    return F.array_join(F.transform(words, lambda w: F.concat(w["word"], F.lit("@"), w["start_ms"].cast("string"))), " ")


@query("st1_take_stream", q.sql("SELECT take, type, text, start_ms, end_ms, speaker, words FROM ended", "utt", ended=ENDED_SQL))
def st1(spark, sf):
    use_rocksdb(spark)
    ended = streamed_events(spark, sf).filter("type <> 'partial'")
    return ended.select("take", "type", "text", "start_ms", "end_ms", "speaker", shown_words("words").alias("words"))


@query(
    "st2_live_partials",
    q.sql(
        """SELECT take, 2 * k + 2 AS seq, string_agg(seg, ' ') OVER w AS text FROM seg WINDOW w AS (PARTITION BY take ORDER BY k)
           UNION ALL SELECT take, 2 * k + 1, concat_ws(' ', string_agg(seg, ' ') OVER (PARTITION BY take ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), w1) FROM seg""",
        "utt", seg=SEG_SQL,
    ),
)
def st2(spark, sf):
    use_rocksdb(spark)
    return tk.only(streamed_events(spark, sf), "partial").select("take", "seq", "text")


@query("st3_take_batch", q.sql("SELECT take, text, start_ms, end_ms, speaker, words FROM ended WHERE type = 'utterance'", "utt", ended=ENDED_SQL))
def st3(spark, sf):
    return tk.takes_batch(tr.message_batch(spark, messages(spark, sf))).withColumn("words", shown_words("words"))


@query(
    "st4_silence_sessions",
    """SELECT user_id, min(ts) AS first_ts, count(*) AS n FROM (
         SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sid FROM (
           SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 300 SECOND THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, sid""",
)
def st4(spark, sf):
    """As a stream in append mode: a session is sent when the watermark has passed its gap; the newest event moves it past all."""
    path = scratch_path(spark, "user_events")
    rows = fx.table(spark, sf, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    tick = rows.agg((F.max("ts") + F.expr("INTERVAL 30 DAYS")).alias("ts")).select(F.lit(None).cast(rows.schema["user_id"].dataType).alias("user_id"), "ts")
    rows.unionByName(tick).write.parquet(path)
    stream = spark.readStream.schema(rows.schema).parquet(path).withWatermark("ts", "1 hour")
    out = st.sessions(stream, ["user_id"]).select("user_id", F.col("w.start").alias("first_ts"), "n")
    return streamed(spark, out, "sessions").filter("user_id is not null")  # in the stream it would hide the last row from the watermark


ROW_CASE = "CASE WHEN turn % 6 = 5 THEN 'error' WHEN compressed_tokens IS NULL OR turn % 5 = 4 THEN 'compressing' ELSE 'ready' END"


def attached(spark, sf):
    """Rows and their results as two streams; every fifth result comes too late, every sixth says that the work failed."""
    row_path, result_path = scratch_path(spark, "arrivals"), scratch_path(spark, "results")
    done = fx.compressed_utterances(spark, sf)
    clock = at_clock
    rows = done.select("conv_id", "turn", clock(F.col("end_ms")).alias("arrived"))
    wait = F.when(F.col("turn") % 6 == 5, 50).when(F.col("turn") % 5 == 4, 600_000).otherwise(10 + F.col("n") % 50)
    results = done.filter((F.col("compressed_tokens").isNotNull()) | (F.col("turn") % 6 == 5)).select(
        "conv_id", "turn", clock(F.col("end_ms") + wait).alias("answered"), F.when(F.col("turn") % 6 == 5, "failed").alias("error")
    )
    tick = done.agg(clock(F.max("end_ms") + 30 * 86_400_000).alias("at"))  # moves both watermarks past all rows
    none = F.lit(-1).cast("bigint")  # no conversation; a null key would be filtered out before the watermark
    rows.unionByName(tick.select(none.alias("conv_id"), none.alias("turn"), F.col("at").alias("arrived"))).write.parquet(row_path)
    results.unionByName(tick.select(none.alias("conv_id"), none.alias("turn"), F.col("at").alias("answered"), F.lit(None).cast("string").alias("error"))).write.parquet(result_path)
    read = lambda df, path: spark.readStream.schema(df.schema).parquet(path)
    out = st.attach_results(read(rows, row_path), read(results, result_path), ["conv_id", "turn"])
    return streamed(spark, out, "attached").filter("conv_id >= 0")


@query("st5_row_lifecycle", q.sql(f"SELECT conv_id, turn, {ROW_CASE} AS state FROM utt_done", "utt_done"))
def st5(spark, sf):
    return attached(spark, sf).select("conv_id", "turn", "state")


@query("st6_compress_on_arrival", q.sql("SELECT conv_id, turn, origin_tokens AS origin_words, compressed_tokens AS kept_words, compressed FROM utt_done WHERE n > 0", "utt_done"))
def st6(spark, sf):
    path, sink = scratch_path(spark, "turns"), scratch_path(spark, "compressed")
    turns = fx.table(spark, sf, "conversations").select("conv_id", "turn", "text")
    turns.repartition("conv_id").write.parquet(path)
    stream = spark.readStream.schema(turns.schema).option("maxFilesPerTrigger", 1).parquet(path)
    st.compress_on_arrival(stream, sc.vocabulary(turns), 0.7, ["conv_id", "turn"], sink)
    return spark.read.parquet(sink).select("conv_id", "turn", "origin_words", "kept_words", "compressed")


@query(
    "st7_running_totals",
    q.sql(
        """SELECT conv_id, sum(origin_tokens) AS origin, sum(compressed_tokens) AS compressed, sum(origin_tokens - compressed_tokens) AS saved, count(*) AS utterances,
             round(CASE WHEN count(*) >= 2 AND sum(origin_tokens - compressed_tokens) > 0 THEN sum(origin_tokens - compressed_tokens) / greatest(0.0001, (max(end_ms) - min(start_ms)) / 3600000) ELSE 0 END, 4) AS per_hour
           FROM utt_done GROUP BY 1""",
        "utt_done",
    ),
)
def st7(spark, sf):
    path = scratch_path(spark, "done_rows")
    done = fx.compressed_utterances(spark, sf).select("conv_id", "turn", "start_ms", "end_ms", "origin_tokens", "compressed_tokens")
    done.write.parquet(path)
    stream = spark.readStream.schema(done.schema).option("maxFilesPerTrigger", 1).parquet(path)
    return st.upsert_to(st.totals_stream(stream, ["conv_id"]), ["conv_id"], scratch_path(spark, "totals"))


PARTIAL_SQL = """SELECT take, 2 * k + 2 AS seq, string_agg(seg, ' ') OVER (PARTITION BY take ORDER BY k) AS text FROM seg
  UNION ALL SELECT take, 2 * k + 1, concat_ws(' ', string_agg(seg, ' ') OVER (PARTITION BY take ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), w1) FROM seg"""


@query(
    "st8_event_dispatch",
    q.sql("SELECT take, seq, 'partial' AS type, text AS interim FROM heard UNION ALL SELECT take, seq, type, '' FROM ended", "utt", seg=SEG_SQL, heard=PARTIAL_SQL, ended=ENDED_SQL),
)
def st8(spark, sf):
    """Partial and finishing events go to sinks of their own; an utterance that lands clears the interim text."""
    use_rocksdb(spark)
    sinks = {kind: scratch_path(spark, kind) for kind in ("partial", "utterance", "expired")}
    st.route_events(tk.take_events(tr.message_stream(spark, messages(spark, sf))), sinks)
    every = [spark.read.schema(schemas.EVENT).parquet(sink) for sink in sinks.values()]
    return every[0].unionByName(every[1]).unionByName(every[2]).select("take", "seq", "type", "interim")


@query("st9_latency", q.sql(f"SELECT conv_id, turn, CASE {ROW_CASE} WHEN 'error' THEN 50 WHEN 'ready' THEN n % 50 + 10 END AS latency_ms FROM utt_done", "utt_done"))
def st9(spark, sf):
    return attached(spark, sf).select("conv_id", "turn", "latency_ms")


@query("s13_fixture_recorder", q.sql(f"SELECT {TAKE_SQL} AS id, text FROM utt WHERE start_ms >= 20000 AND start_ms < 90000", "utt"))
def s13(spark, sf):
    """While the recording runs, every finished utterance is appended to the fixture."""
    path, sink = scratch_path(spark, "said"), scratch_path(spark, "fixture")
    said = fx.utterances(spark, sf).select(
        F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"), "text",
        F.col("start_ms").alias("startMs"), F.col("end_ms").alias("endMs"),
    )
    said.write.parquet(path)
    stream = spark.readStream.schema(said.schema).parquet(path)
    st.run_available(stream.filter("startMs >= 20000 and startMs < 90000"), sink, fmt="json")
    return spark.read.schema("id string, text string").json(sink)
