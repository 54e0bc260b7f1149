"""Live and recorded transcripts behind one event schema."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from . import schemas


def parse_messages(raw: DataFrame, value: str = "value", keep_other: bool = False) -> DataFrame:
    """Recognition messages -> is_final, text, start_ms, end_ms, speaker, words.

    Works on a batch or a stream. Unreadable text, other message types and messages
    without an alternative are left out, or kept as silent rows where their numbers matter.
    """
    held = raw.withColumn("m", F.from_json(value, schemas.MESSAGE))
    alt = F.get("m.channel.alternatives", F.lit(0))
    heard = F.coalesce((F.col("m.type") == "Results") & alt.isNotNull(), F.lit(False))
    held = held.withColumn("alt", F.when(heard, alt)).withColumn("m", F.when(heard, F.col("m")))
    held = held if keep_other else held.filter("alt is not null")
    ws = F.col("alt.words")
    ms = lambda s: tx.half_up(F.coalesce(s, F.lit(0.0)) * 1000).cast("bigint")
    first, last = F.get(ws, F.lit(0)), F.try_element_at(ws, F.lit(-1))
    carried = [c for c in raw.columns if c != value]
    return held.select(
        *carried,
        F.coalesce("m.is_final", F.lit(False)).alias("is_final"),
        tx.strip(F.coalesce("alt.transcript", F.lit(""))).alias("text"),
        F.when(F.size(ws) > 0, ms(first["start"])).alias("start_ms"),
        F.when(F.size(ws) > 0, ms(last["end"])).alias("end_ms"),
        F.when(F.size(ws) > 0, first["speaker"]).alias("speaker"),
        F.transform(ws, lambda w: F.struct(
            F.coalesce(w["punctuated_word"], w["word"]).alias("word"), ms(w["start"]).alias("start_ms"), ms(w["end"]).alias("end_ms")
        )).alias("words"),
    )


def message_stream(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """Messages appended as JSON lines (take, seq, last, at, value) to a folder, as a stream."""
    reader = spark.readStream.schema(schemas.MESSAGE_LINE)
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).json(path)


def message_batch(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.MESSAGE_LINE).json(path)


def source(spark: SparkSession, kind: str, path: str, stream: bool = False) -> DataFrame:
    """Finished utterances from either source with one schema, as a batch or as a stream: 'live' messages are taken
    together per take, 'recorded' utterances are read as they are."""
    from ..streaming.takes import only, take_events, takes_batch

    if kind == "live":
        rows = only(take_events(message_stream(spark, path)), "utterance") if stream else takes_batch(message_batch(spark, path))
        return rows.select("take", "text", "start_ms", "end_ms", "speaker")
    rows = (spark.readStream if stream else spark.read).schema(schemas.UTTERANCE).json(path)
    return rows.select(
        F.col("id").alias("take"), "text", F.col("startMs").alias("start_ms"), F.col("endMs").alias("end_ms"), "speaker"
    )
