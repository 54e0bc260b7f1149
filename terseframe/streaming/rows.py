"""Transcript rows as streams: compression on arrival, lifecycle, running totals."""

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import compress as cp
from ..operators.scores import Vocabulary
from ..session import scratch_path


def run_available(df: DataFrame, sink: str, mode: str = "append", fmt: str = "parquet") -> str:
    """Drain a stream into files under `sink`; returns the folder."""
    q = (
        df.writeStream.format(fmt).outputMode(mode).trigger(availableNow=True)
        .option("checkpointLocation", f"{sink}-progress").option("path", sink).start()
    )
    q.awaitTermination()
    return sink


def run_batches(df: DataFrame, sink: str, each: Callable[[DataFrame, int], None], mode: str = "append") -> str:
    q = (
        df.writeStream.foreachBatch(each).outputMode(mode).trigger(availableNow=True)
        .option("checkpointLocation", f"{sink}-progress").start()
    )
    q.awaitTermination()
    return sink


def compress_on_arrival(stream: DataFrame, vocab: Vocabulary, rate: float, keep: list[str], sink: str) -> str:
    """Compress each micro-batch with the batch operator and append it.

    A batch that is run again overwrites its own folder, so every row lands once.
    """

    def each(batch: DataFrame, n: int) -> None:
        out = cp.compress(batch, vocab, rate, keep)
        out.write.mode("overwrite").parquet(f"{sink}/batch={n}")

    return run_batches(stream, sink, each)


def lifecycle(rows: DataFrame, results: DataFrame, on: list[str]) -> DataFrame:
    """Rows with the state their result gives them: compressing, ready or error."""
    state = F.when(F.col("error").isNotNull(), "error").when(F.col("result_ts").isNotNull(), "ready").otherwise("compressing")
    return rows.join(results, on, "left").withColumn("state", state)


def attach_results(rows: DataFrame, results: DataFrame, on: list[str], delay: str = "1 hour", within: str = "5 minutes") -> DataFrame:
    """Streaming form, as a left outer join of two streams in append mode: on.., arrived, answered, error, state, latency_ms.

    rows: on.., arrived   results: on.., answered, error. A result counts if it comes within `within` of its row; a row is
    sent once its result is there, or as still compressing once the watermarks of both streams have passed
    that time, and its state is freed. Rows and results more than `delay` behind their stream are dropped.
    """
    late = results.withColumnsRenamed({k: f"_{k}" for k in on}).withWatermark("answered", delay)
    cond = F.expr(f"answered >= arrived AND answered <= arrived + INTERVAL {within}")
    for k in on:
        cond = cond & (F.col(k) == F.col(f"_{k}"))
    held = rows.withWatermark("arrived", delay).join(late, cond, "leftOuter").drop(*[f"_{k}" for k in on])
    state = F.when(F.col("error").isNotNull(), "error").when(F.col("answered").isNotNull(), "ready").otherwise("compressing")
    return held.withColumn("state", state).withColumn("latency_ms", F.unix_millis("answered") - F.unix_millis("arrived"))


def route_events(events: DataFrame, sinks: dict[str, str]) -> None:
    """Drain a stream of tagged events (column type) into one folder per tag; a batch that runs again overwrites its own files."""

    def each(batch: DataFrame, n: int) -> None:
        batch.persist()  # the stateful step runs once for all sinks
        for kind, sink in sinks.items():
            batch.filter(F.col("type") == kind).write.mode("overwrite").parquet(f"{sink}/batch={n}")
        batch.unpersist()

    run_batches(events, scratch_path(events.sparkSession, "routes"), each)


def totals_stream(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Running totals per session, projection included; for update mode, in which only changed sessions are sent."""
    saved = F.sum(F.col("origin_tokens") - F.col("compressed_tokens"))
    agg = rows.groupBy(*keys).agg(
        F.sum("origin_tokens").alias("origin"), F.sum("compressed_tokens").alias("compressed"),
        saved.alias("saved"), F.count("*").alias("utterances"),
        F.min("start_ms").alias("first"), F.max("end_ms").alias("last"),
    )
    hours = F.greatest(F.lit(0.0001), (F.col("last") - F.col("first")) / 3_600_000)
    return agg.withColumn(
        "per_hour",
        F.round(F.when((F.col("utterances") >= 2) & (F.col("saved") > 0), F.col("saved") / hours).otherwise(0.0), 4),
    ).drop("first", "last")


def upsert_to(stream: DataFrame, keys: list[str], sink: str) -> DataFrame:
    """Drain an update-mode aggregation: each batch writes only the keys it changed, as version `batch`; returns the newest of each key.

    A batch that runs again overwrites its own version, so a replay changes nothing.
    """

    def each(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink}/batch={n}")

    run_batches(stream, sink, each, "update")
    return newest(stream.sparkSession.read.parquet(sink), keys)


def newest(versions: DataFrame, keys: list[str]) -> DataFrame:
    """The row of the highest `batch` of each key."""
    rest = [c for c in versions.columns if c not in (*keys, "batch")]
    return versions.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_r")).select(*keys, "_r.*")


def sessions(events: DataFrame, keys: list[str], gap: str = "300 seconds") -> DataFrame:
    """Activity sessions closed by a silent gap; the same call serves batch and stream."""
    return events.groupBy(*keys, F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
