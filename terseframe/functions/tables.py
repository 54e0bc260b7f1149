"""Span functions as SQL table functions: `SELECT ... FROM t, LATERAL sentence_spans(t.text)`.

A table function in SQL with a running sum is planned as a join on distinct texts, and one
without it copies its arrays at each step. These read a text once, in the row's own task.
"""

import re
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from . import spans, text as tx


def _pieces(pattern: str, text: str | None) -> Iterator[tuple[int, str, int, int]]:
    """(number, piece without outer blanks, start, end) of every piece of a tiling pattern."""
    for i, m in enumerate(re.finditer(pattern.removeprefix(tx.U), text or "")):
        body = m[0].strip()
        start = m.end() - len(m[0].lstrip())
        yield i, body, start, start + len(body)


@udtf(returnType="idx int, sentence string, start int, end int")
class SentenceSpans:
    def eval(self, text: str):
        yield from _pieces(spans.SENTENCE, text)


@udtf(returnType="pos int, word string, start int, end int")
class WordSpans:
    def eval(self, text: str):
        yield from _pieces(spans.WORD, text)


def register(spark: SparkSession) -> None:
    """Registers both in the session; a null or empty text gives no rows."""
    spark.udtf.register("sentence_spans", SentenceSpans)
    spark.udtf.register("word_spans", WordSpans)
