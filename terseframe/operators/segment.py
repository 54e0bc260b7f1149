"""Word, sentence and chunk tables with exact character spans.

The text is shuffled once by its key, before it fans out. Every later window, group-by
or join on that key finds its rows in place, and the much larger word rows never move.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import spans, text as tx

DOC = ["doc_id"]


def by_key(df: DataFrame, keep: list[str], text: str) -> DataFrame:
    return df.select(*keep, text).repartition(*keep)


def texts_by_key(placed: DataFrame, keep: list[str], others: list[str] = []) -> DataFrame:
    """One row per key of texts that are placed by it: keep.., _texts (text, others..; of all rows of the key)."""
    return placed.groupBy(*keep).agg(F.collect_list(F.struct(*dict.fromkeys(["text", *others]))).alias("_texts"))


def _tiled(df: DataFrame, pattern: str, text: str, keep: list[str], pos: str, unit: str) -> DataFrame:
    rows = by_key(df, keep, text).select(
        *keep, F.posexplode(spans.match_all(F.col(text), pattern)).alias(pos, "piece")
    )
    so_far = Window.partitionBy(*keep).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    body = tx.lstrip(F.col("piece"))
    upto = F.sum(F.length("piece")).over(so_far)
    rows = rows.select(*keep, pos, body.alias("body"), upto.cast("int").alias("upto"))
    core = tx.rstrip(F.col("body"))
    start = F.col("upto") - F.length("body")
    return rows.select(
        *keep, pos, core.alias(unit), start.alias("start"), (start + F.length(core)).alias("end")
    )


def words(df: DataFrame, text: str = "text", keep: list[str] = DOC) -> DataFrame:
    """The word table: keep.., pos, word, start, end."""
    return _tiled(df, spans.WORD, text, keep, "pos", "word")


def sentence_rows(df: DataFrame, text: str = "text", keep: list[str] = DOC) -> DataFrame:
    """Sentence spans: keep.., idx, sentence, start, end."""
    return _tiled(df, spans.SENTENCE, text, keep, "idx", "sentence")


def plain_words(df: DataFrame, text: str = "text", keep: list[str] = DOC) -> DataFrame:
    """Words without offsets: keep.., pos, word. Narrow."""
    return df.select(*keep, F.posexplode(tx.split_words(F.col(text))).alias("pos", "word"))


def split_sentence_rows(df: DataFrame, text: str = "text", keep: list[str] = DOC) -> DataFrame:
    """Paragraph-then-mark sentences (no spans): keep.., idx, sentence. Narrow."""
    return df.select(*keep, F.posexplode(tx.split_sentences(F.col(text))).alias("idx", "sentence"))


def word_chunks(df: DataFrame, size: int, text: str = "text", keep: list[str] = DOC) -> DataFrame:
    """Chunks of `size` words as exact substrings: keep.., chunk, start, end, body. Narrow."""
    blocks = spans.fold_spans(spans.match_all(F.col(text), spans.word_block(size)))
    return df.select(*keep, F.posexplode(blocks).alias("chunk", "b")).select(
        *keep, "chunk", "b.start", "b.end", F.col("b.text").alias("body")
    )


def _grouped(units: Column, k: int) -> Column:
    last = F.greatest(F.ceil(F.size(units) / k).cast("int") - 1, F.lit(0))
    return F.transform(F.sequence(F.lit(0), last), lambda g: F.array_join(F.slice(units, g * k + 1, k), " "))


def sentence_windows(df: DataFrame, k: int, text: str = "text", keep: list[str] = DOC) -> DataFrame:
    """Runs of `k` sentences joined by a space (keep.., unit, body); blank text -> ' '."""
    held = df.select(*keep, tx.split_sentences(F.col(text)).alias("units"))
    runs = F.when(F.size("units") > 0, _grouped(F.col("units"), k)).otherwise(F.array(F.lit(" ")))
    return held.select(*keep, F.posexplode(runs).alias("unit", "body"))


def rejoined_chunks(df: DataFrame, size: int, text: str = "text", keep: list[str] = DOC) -> DataFrame:
    """Chunks re-joined by one space instead of cut out (keep.., chunk, body); blank -> ''."""
    held = df.select(*keep, tx.split_words(F.col(text)).alias("units"))
    return held.select(*keep, F.posexplode(_grouped(F.col("units"), size)).alias("chunk", "body"))
