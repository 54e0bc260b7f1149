import json

import pytest
from pyspark.sql import functions as F

from terseframe.plans import stream_queries as sq
from terseframe.session import scratch_path
from terseframe.sources import transcripts as tr
from terseframe.streaming import rows as st, takes as tk

DAY = 86_400


def rows(df):
    return sorted(map(str, df.collect()))


def test_take_stream_equals_batch(spark, sf):
    cols = ["take", "text", "start_ms", "end_ms", "speaker", "words"]
    assert rows(sq.st1(spark, sf).filter("type = 'utterance'").select(cols)) == rows(sq.st3(spark, sf).select(cols))


def test_arrival_compression_equals_batch(spark, sf):
    from terseframe.plans import fixtures as fx

    cols = ["conv_id", "turn", "compressed"]
    batch = fx.compressed_utterances(spark, sf).filter("n > 0").select(cols)
    assert rows(sq.st6(spark, sf).select(cols)) == rows(batch)


def message(take, seq, second, text, final=True, last=False):
    words = [{"word": w, "start": float(second), "end": second + 0.5, "speaker": 1} for w in text.split()]
    value = {"type": "Results", "is_final": final, "channel": {"alternatives": [{"transcript": text, "words": words}]}}
    return (take, seq, last, second, json.dumps(value))


def write(spark, path, messages):
    df = spark.createDataFrame(messages, "take string, seq bigint, last boolean, at long, value string")
    df.withColumn("at", F.timestamp_seconds(F.col("at") + 20_000 * DAY)).coalesce(1).write.mode("append").json(path)


@pytest.fixture
def rocks(spark):
    sq.use_rocksdb(spark)


def drain(spark, path, sink):
    """Runs the take stream over what has come since the last run with this sink."""
    st.run_available(tk.take_events(tr.message_stream(spark, path, 1), "1 hour"), sink)
    found = spark.read.schema(tk.EVENT).parquet(sink).filter("type <> 'partial'")
    return sorted((r.take, r.type, r.text, [w.word for w in r.words]) for r in found.collect())


def test_takes_outlive_a_restart_and_expire(spark, rocks):
    path, sink = scratch_path(spark, "said"), scratch_path(spark, "heard")
    write(spark, path, [message("a", 2, 2, "three four"), message("b", 0, 0, "left open"), message("c", 1, 1, "behind")])
    write(spark, path, [message("a", 0, 0, "one"), message("a", 1, 1, "two guess", final=False)])
    assert drain(spark, path, sink) == []
    write(spark, path, [message("a", 3, 3, "five", last=True)])
    assert drain(spark, path, sink) == [("a", "utterance", "one three four five", ["one", "three", "four", "five"])]
    write(spark, path, [message("d", 0, 3 * DAY, "much later")])  # moves the watermark past the silence of b
    got = drain(spark, path, sink)
    assert got == [("a", "utterance", "one three four five", ["one", "three", "four", "five"]), ("b", "expired", "left open", ["left", "open"])]
    write(spark, path, [message("b", 1, 5, "too late", last=True)])
    assert drain(spark, path, sink) == got  # behind the watermark


def test_interim_text_is_cleared(spark, rocks):
    path = scratch_path(spark, "said")
    write(spark, path, [message("a", 0, 0, "he", final=False), message("a", 1, 1, "hello"), message("a", 2, 2, "wor", final=False), message("a", 3, 3, "world", last=True)])
    sinks = {kind: scratch_path(spark, kind) for kind in ("partial", "utterance", "expired")}
    st.route_events(tk.take_events(tr.message_stream(spark, path)), sinks)
    found = {kind: [(r.seq, r.interim) for r in spark.read.schema(tk.EVENT).parquet(sink).orderBy("seq").collect()] for kind, sink in sinks.items()}
    assert found == {"partial": [(0, "he"), (1, "hello"), (2, "hello wor"), (3, "hello world")], "utterance": [(3, "")], "expired": []}


def test_results_join_their_rows(spark):
    """In time, failed, after the bound, and none at all; then a result behind the watermark."""
    row_path, result_path = scratch_path(spark, "rows"), scratch_path(spark, "results")
    clock = lambda c: F.timestamp_seconds(F.col(c) + 20_000 * DAY).alias(c)

    def add(path, data, schema, *times):
        df = spark.createDataFrame(data, schema)
        df.select(*[clock(c) if c in times else c for c in df.columns]).coalesce(1).write.mode("append").parquet(path)

    def drain_all(sink):
        read = lambda p, s: spark.readStream.schema(s).option("maxFilesPerTrigger", 1).parquet(p)
        out = st.attach_results(read(row_path, "id bigint, arrived timestamp"), read(result_path, "id bigint, answered timestamp, error string"), ["id"])
        st.run_available(out, sink)
        return sorted((r.id, r.state, r.latency_ms) for r in spark.read.parquet(sink).filter("id >= 0").collect())

    sink = scratch_path(spark, "joined")
    add(row_path, [(1, 0), (2, 10), (3, 20), (4, 30)], "id long, arrived long", "arrived")
    add(result_path, [(1, 2, None), (2, 11, "failed"), (3, 900, None)], "id long, answered long, error string", "answered")
    assert drain_all(sink) == [(1, "ready", 2000), (2, "error", 1000)]
    add(row_path, [(-1, 2 * DAY)], "id long, arrived long", "arrived")
    add(result_path, [(-1, 2 * DAY, None)], "id long, answered long, error string", "answered")
    want = [(1, "ready", 2000), (2, "error", 1000), (3, "compressing", None), (4, "compressing", None)]
    assert drain_all(sink) == want
    add(result_path, [(4, 40, None)], "id long, answered long, error string", "answered")
    assert drain_all(sink) == want


def test_upsert_writes_changed_keys_and_replays_to_the_same(spark):
    path, sink = scratch_path(spark, "done"), scratch_path(spark, "totals")
    schema = "conv_id long, start_ms long, end_ms long, origin_tokens long, compressed_tokens long"
    for part in ([(1, 0, 9, 10, 4), (2, 0, 9, 5, 5)], [(1, 9, 3_600_000, 10, 6)]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    out = st.upsert_to(st.totals_stream(stream, ["conv_id"]), ["conv_id"], sink)
    got = rows(out)
    assert [(r.conv_id, r.origin, r.saved, r.per_hour) for r in out.orderBy("conv_id").collect()] == [(1, 20, 10, 10.0), (2, 5, 0, 0.0)]
    versions = spark.read.parquet(sink)
    assert sorted((r.batch, r.conv_id) for r in versions.collect()) == [(0, 1), (0, 2), (1, 1)]  # the second batch changed one key
    again = versions.filter("batch = 1").drop("batch").collect()
    spark.createDataFrame(again, versions.drop("batch").schema).write.mode("overwrite").parquet(f"{sink}/batch=1")
    assert rows(st.newest(spark.read.parquet(sink), ["conv_id"])) == got


def test_a_take_that_ends_in_its_batch_asks_the_state_once():
    import pandas as pd

    class State:
        def __init__(self):
            self.calls = 0

        def __getattr__(self, name):
            def call(*args):
                self.calls += 1
                return False if name == "exists" else []

            return call

    collector, states = tk.TakeCollector(), [State() for _ in range(4)]
    collector.handle, collector.held, collector.waiting, collector.words = states
    words = '[{"word":"so","start_ms":1,"end_ms":2}]'
    part = pd.DataFrame({
        "seq": [2, 0, 1], "last": [True, False, False], "is_final": [True, False, False], "text": ["so", None, "s"], "start_ms": [1.0, None, None],
        "end_ms": [2.0, None, None], "speaker": [0.0, None, None], "words": [words, None, None], "at": pd.to_datetime(["2024-01-01"] * 3),
    })
    (frame,) = collector.handleInputRows(("t",), iter([part]), None)
    assert frame["type"].tolist() == ["partial", "partial", "utterance"] and frame["text"].tolist() == ["s", "so", "so"]
    assert frame["words"].tolist()[2] == [{"word": "so", "start_ms": 1, "end_ms": 2}] and frame["end_ms"].tolist()[2] == 2
    assert sum(s.calls for s in states) == 1
