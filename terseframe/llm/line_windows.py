"""Removal of repeated runs of lines by window minima over line hashes.

Every line with a word gets a hash of its stripped text. A window starts at each such line and ends where it
holds `min_words` words; another one ends at each line and starts where it last holds as many. A window selects the position of its least line hash
(the last on ties) as fingerprint. Any run of at least that many words that occurs twice
holds the same windows in both places, so both select the same fingerprint. Fingerprints
seen at one position only are dropped. At the others the match reaches to both sides as far as the
windows that selected the position: equal windows (by a 64-bit hash of their lines, within the fingerprint's own 64 bits) are the matched
stretches, and overlapping ones make up the whole run. In the order of (doc_id, line) the first
occurrence of a window stays, the lines of later ones go.

A maximal equal run of that many words holds the window that ends at its last line, and
the windows that start in it and fit reach at least as far as where that one starts; so both
kinds together cover every line of the run, and nothing outside of equal runs. Pairs of positions are not
written out and followed line by line: a line that a third of all documents have would make
pairs of them all, and following only the pair with a line's first position misses runs that a later position shares.

Only windows move, not lines or texts; the position join and the first-occurrence join are
plain equi-joins with one row per fingerprint or window on one side, so adaptive execution
may split a line or passage that a third of all documents share. A row is known by its doc_id and a hash of its text.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..session import materialize
from .common import fresh

MIN_WORDS = 50

WINDOW = "doc_id long, text_key long, first int, last int, print_at int, print long, win long"


def text_windows(text: str, min_words: int) -> list[tuple[int, int, int, int, int]]:
    """(first line, last line, fingerprint line, fingerprint, window hash) of each window."""
    lines = text.split("\n")
    sizes = [len(x.split()) for x in lines]
    at = [i for i, n in enumerate(sizes) if n]
    if sum(sizes) < min_words:
        return []
    hashes = np.array([xxhash.xxh3_64_intdigest(lines[i].strip().encode("utf-8", "surrogatepass")) for i in at], "<u8")
    upto = np.concatenate(([0], np.cumsum([sizes[i] for i in at])))
    ends = np.searchsorted(upto, upto[:-1] + min_words)  # lines a..ends-1 hold min_words words
    buf, nums, out = hashes.tobytes(), hashes.tolist(), []
    found = [(a, b) for a, b in enumerate(ends.tolist()) if b <= len(at)]
    starts = np.searchsorted(upto, upto[1:] - min_words, side="right") - 1
    found = sorted({*found, *((a, b) for b, a in enumerate(starts.tolist(), 1) if a >= 0)})  # both ends still only grow
    best = -1
    for a, b in found:
        if best < a:
            best = min(range(a, b), key=lambda i: (nums[i], -i))
            seen = b
        for i in range(seen, b):
            if nums[i] <= nums[best]:
                best = i
        seen = max(seen, b)
        win = xxhash.xxh3_64_intdigest(buf[8 * a : 8 * b], seed=b - a)
        out.append((at[a], at[b - 1], at[best], nums[best], win))
    return out


def _windows(min_words: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids, keys, rows = [], [], []
            for doc_id, key, text in zip(batch["doc_id"].tolist(), batch["text_key"].tolist(), batch["text"].tolist()):
                found = text_windows(text, min_words)
                ids += [doc_id] * len(found)
                keys += [key] * len(found)
                rows += found
            if rows:
                cols = list(zip(*rows))
                signed = [np.array(c, "<u8").view("<i8") for c in cols[3:]]
                yield pd.DataFrame(dict(zip(
                    ("doc_id", "text_key", "first", "last", "print_at", "print", "win"), (ids, keys, *cols[:3], *signed)
                )))

    return run


def text_key(text: Column) -> Column:
    return F.xxhash64(text.cast("string"))


def repeated_windows(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, text_key, first, last (line numbers from 0), kept_id, kept_line of every window with an earlier copy.

    Rows with a null doc_id or text are left out. Rows of one doc_id are told apart by
    their texts, in the order of text_key; where the texts are equal too they count as one document.
    """
    texts = docs.filter("doc_id is not null and text is not null")
    rows = texts.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("text_key"), F.col("text").cast("string").alias("text"))
    made = materialize(rows.mapInPandas(_windows(min_words), WINDOW))
    spot = F.struct("doc_id", "text_key", "print_at")
    often = made.groupBy("print").agg(F.min(spot).alias("lo"), F.max(spot).alias("hi")).filter("lo < hi").select("print")
    often = materialize(often)  # both sides of the joins are plain shuffles, which can be split
    met = made.join(often, "print")
    spot = F.struct("doc_id", "text_key", "first")
    # windows are dealt by a hash of their own, since a common line may select many different ones
    met = met.withColumn("cell", F.xxhash64("print", "win"))
    origin = met.groupBy("cell", "win").agg(F.min(spot).alias("origin"), F.max(spot).alias("hi"))
    origin = materialize(origin.filter("origin < hi").drop("hi"))
    later = met.join(origin, ["cell", "win"]).filter(spot > F.col("origin"))
    return later.select(
        "doc_id", "text_key", "first", "last", F.col("origin.doc_id").alias("kept_id"), F.col("origin.first").alias("kept_line")
    )


def cut_lines(text: str | None, spans: list | None) -> str | None:
    """The text without the lines of the spans (first, last)."""
    if text is None or spans is None or not len(spans):
        return text
    lines = text.split("\n")
    gone = np.zeros(len(lines) + 1, np.int64)
    for first, last in spans:
        gone[first] += 1
        gone[last + 1] -= 1
    gone = np.cumsum(gone[:-1])
    return "\n".join(x for x, g in zip(lines, gone.tolist()) if not g)


@F.pandas_udf(StringType())
def _cut(texts: pd.Series, spans: pd.Series) -> pd.Series:
    return pd.Series([cut_lines(t, None if s is None else [(x["first"], x["last"]) for x in s]) for t, s in zip(texts, spans)], dtype=object)


_cut = _cut.asNondeterministic()  # so that a filter on the text does not run it a second time


def runs(found: DataFrame) -> DataFrame:
    """doc_id, text_key and spans: the removed windows of each document, as sorted distinct (first, last)."""
    return found.groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_set(F.struct("first", "last"))).alias("spans"))


def drop_repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """`docs` with later repeated runs cut from `text`; found_spans lists the cut windows (null: none).

    Null texts and ids, and texts under `min_words` words, come back as they are. A text
    may become empty; the caller decides whether to keep it. All columns and rows stay, and rows that
    repeat a doc_id are cut each by its own text.
    """
    found = runs(repeated_windows(docs, min_words))
    key, own, spans = fresh(docs, "found_id"), fresh(docs, "found_key"), fresh(docs, "found_spans")
    found = found.select(F.col("doc_id").alias(key), F.col("text_key").alias(own), F.col("spans").alias(spans))
    joined = docs.join(found, (F.col("doc_id") == F.col(key)) & (text_key(F.col("text")) == F.col(own)), "left")
    cut = F.when(F.col(spans).isNull(), F.col("text")).otherwise(_cut("text", spans))
    return joined.withColumn("text", cut).drop(key, own)


def deduplicated(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The pipeline's stage: texts cut, n_chars counted anew, documents with nothing left dropped.

    A document that was empty or null before stays.
    """
    was, spans = fresh(docs, "was_blank"), fresh(docs, "found_spans")
    before = docs.withColumn(was, ~F.coalesce(F.col("text"), F.lit("")).rlike(r"\S"))
    out = drop_repeats(before, min_words)
    out = out.filter(F.col(was) | F.col("text").rlike(r"\S"))
    changed = F.when(F.col(spans).isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long"))
    return out.withColumn("n_chars", changed).select(*docs.columns)
