"""Batch scans of the benchmark, task, answer and text files, and the result sinks.

Every reader declares its schema and reads permissively: a damaged record becomes NULL
and is filtered, it never fails the job.
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators.evaluate import TOKEN_ARMS, latest
from ..operators.windows import top_rows
from . import schemas


def cut(context: Column, max_words: int | None) -> Column:
    """The context as it is, or its first `max_words` words."""
    return context if max_words is None else tx.truncate_words(context, max_words)


def spread(scan: DataFrame) -> DataFrame:
    """Deal a scan out when its files give fewer splits than there are cores (one small or
    unsplittable file). A scan of many splits passes through without a shuffle."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def read_examples(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Files holding {config, examples: [..]} -> one row per example with its config."""
    doc = spark.read.schema(schemas.EXAMPLES).json(path, multiLine=multi_line)
    return doc.select("config", F.explode("examples").alias("e")).select("config", "e.*")


def read_answers(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """All answer files under a glob; the last record of an (arm, id) in path order wins."""
    doc = spark.read.schema(schemas.ANSWERS).json(
        path, multiLine=multi_line, columnNameOfCorruptRecord="_bad", mode="PERMISSIVE"
    )
    rows = (
        doc.filter("_bad is null and answers is not null")
        .select(F.input_file_name().alias("file"), F.posexplode("answers").alias("pos", "a"))
        .select("file", "pos", "a.*")
        .filter("arm is not null and arm <> ''")
    )
    return latest(rows, ["arm", "id"], ["file", "pos"]).drop("file", "pos")


def read_arms(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Map of arms per example -> rows of the known arms that carry a retention."""
    doc = spark.read.schema(schemas.ARMS).json(path, multiLine=multi_line)
    rows = doc.select(F.explode("examples").alias("e")).select("e.id", F.explode("e.arms").alias("arm", "info"))
    return rows.select("id", "arm", "info.*").filter(
        F.col("arm").isin(TOKEN_ARMS) & F.col("retention").isNotNull()
    )


def read_task_lines(spark: SparkSession, path: str, task: str, head: int | None = None, max_words: int | None = None) -> DataFrame:
    """One JSON object per line with its line number; all lines, or the first `head` per task."""
    rows = spark.read.schema(schemas.TASK_LINES).json(path).filter("line is not null")
    if head is not None:
        rows = rows.filter(F.col("line") < head)
    return rows.select(
        F.concat(F.lit(task), F.lit("-"), "line").alias("id"), F.lit(task).alias("task"),
        cut(F.col("context"), max_words).alias("context"),
        F.col("input").alias("question"), "answers",
    )


def first_per_task(df: DataFrame, n: int, order: list[Column]) -> DataFrame:
    return top_rows(df, ["task"], order, n)


def read_paragraphs(spark: SparkSession, path: str, max_words: int | None = None) -> DataFrame:
    """Nested sentence lists flattened to one context, single answer wrapped in a list."""
    rows = spark.read.schema(schemas.PARAGRAPHS).json(path)
    return rows.select(
        "id", "question",
        cut(F.array_join(F.flatten("context.sentences"), " "), max_words).alias("context"),
        F.array("answer").alias("answers"),
    )


def read_squad(spark: SparkSession, path: str, max_words: int | None = None) -> DataFrame:
    rows = spark.read.schema(schemas.SQUAD).json(path)
    return rows.select(
        "id", "question", cut(F.col("context"), max_words).alias("context"),
        F.col("answers.text").alias("answers"),
    )


def first_available(candidates: list[Callable[[], DataFrame]]) -> DataFrame:
    """The first source that loads and is not empty."""
    problems = []
    for make in candidates:
        try:
            df = make()
            if not df.isEmpty():
                return df
            problems.append("empty")
        except Exception as e:  # a missing or unreadable source moves on to the next one
            problems.append(type(e).__name__)
    raise ValueError(f"no source had rows: {problems}")


def read_utterances(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Transcript files: an array of utterances per file, or one utterance per line."""
    return spark.read.schema(schemas.UTTERANCE).json(path, multiLine=multi_line)


def read_texts(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Whole files as texts, trimmed; blank files go to the second, rejected table."""
    rows = spark.read.text(path, wholetext=True).select(
        F.input_file_name().alias("file"), tx.strip(F.col("value")).alias("text")
    )
    rejected = rows.filter("text = ''").select("file", F.lit("No extractable text in this file.").alias("error"))
    return rows.filter("text <> ''"), rejected


def write_results(df: DataFrame, path: str, config: dict[str, str], fmt: str = "json") -> None:
    """Result rows under path/rows and the one-row run configuration under path/config."""
    df.write.format(fmt).save(f"{path}/rows")
    spark = df.sparkSession
    keys = sorted(config)
    head = spark.range(1).select(*[F.lit(str(config[k])).alias(k) for k in keys])
    head.write.json(f"{path}/config")


def read_results(spark: SparkSession, path: str, fmt: str = "json", schema=None) -> tuple[DataFrame, DataFrame]:
    reader = spark.read.format(fmt)
    rows = (reader.schema(schema) if schema is not None else reader).load(f"{path}/rows")
    return rows, spark.read.json(f"{path}/config")
