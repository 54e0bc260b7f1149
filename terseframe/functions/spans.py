"""Tiling patterns: matches follow each other without gaps, so an offset is a running
sum of match lengths and no scanner is needed."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import NOT_WS, U, WS, lstrip, rstrip

WORD = rf"{U}{WS}*{NOT_WS}+"
_OPEN, _BODY = r"[^.!?\n\s\x1c-\x1f]", r"[^.!?\n]*"
SENTENCE = rf"{U}{WS}*(?:{_OPEN}{_BODY})?[.!?]+[\"')\]}}.!?]*|{WS}*{_OPEN}{_BODY}"


def word_block(n: int) -> str:
    """Pattern of up to `n` consecutive words with their leading whitespace."""
    return rf"{U}{WS}*+{NOT_WS}++(?:{WS}++{NOT_WS}++){{0,{n - 1}}}+"


def match_all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def fold_spans(pieces: Column, base: Column | int = 0) -> Column:
    """Tiling pieces -> ARRAY<STRUCT<start, end, text>>. For short arrays only (the
    sentences of one chunk, the chunks of one text): folding copies its result."""
    base = F.lit(base) if isinstance(base, int) else base
    zero = F.struct(
        base.cast("int").alias("at"),
        F.array().cast("array<struct<start:int,end:int,text:string>>").alias("out"),
    )

    def step(acc: Column, p: Column) -> Column:
        body = rstrip(lstrip(p))
        begin = acc["at"] + F.length(p) - F.length(lstrip(p))
        span = F.struct(
            begin.cast("int").alias("start"),
            (begin + F.length(body)).cast("int").alias("end"),
            body.alias("text"),
        )
        return F.struct(
            (acc["at"] + F.length(p)).cast("int").alias("at"),
            F.concat(acc["out"], F.array(span)).alias("out"),
        )

    return F.aggregate(pieces, zero, step, lambda acc: acc["out"])
