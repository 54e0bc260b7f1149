"""Chat request assembly."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NO_INPUT = "Provide either 'prompt' or 'messages'."


def chat_messages(requests: DataFrame, turns: DataFrame, key: str, order: str) -> DataFrame:
    """Ordered messages of each request as rows: key, ord, role, content, error.

    requests: key (unique), prompt, system (nullable)   turns: key, `order`, role, text. An
    optional system turn comes first, then the request's turns; without turns its prompt is
    one user turn, and without a prompt too it gets one error row. Turns of keys that are
    no request are left out. Messages stay rows, so a request of any length is never
    gathered into one value.
    """
    none = F.lit(None).cast("string")
    body = turns.select(key, (F.col(order) + 1).cast("bigint").alias("ord"), F.coalesce("role", F.lit("user")).alias("role"), F.col("text").alias("content"))
    told = requests.join(body.select(key).distinct().withColumn("told", F.lit(True)), key, "left")
    bare = told.filter("told is null")
    said = body.join(requests.select(key), key).withColumn("error", none)
    head = told.filter("system is not null and (told or prompt is not null)").select(
        key, F.lit(0).cast("bigint").alias("ord"), F.lit("system").alias("role"), F.col("system").alias("content"), none.alias("error")
    )
    lone = bare.select(
        key, F.lit(1).cast("bigint").alias("ord"), F.when(F.col("prompt").isNotNull(), "user").alias("role"), F.col("prompt").alias("content"),
        F.when(F.col("prompt").isNull(), NO_INPUT).alias("error"),
    )
    return head.unionByName(said).unionByName(lone)
