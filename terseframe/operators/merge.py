"""Align two keep-decisions on one word sequence, combine them, rebuild the text."""

import re
from bisect import bisect_left

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as tx
from ..functions.bind import let

TILE = re.compile(r"\S+")
MODES = ("intersection", "union")
NEAR, FEW = 64, 512  # characters ahead of the cursor that are looked at first; words searched one by one


# --- spans of externally labelled words --------------------------------------------
def word_places(text: str, words: set[str]) -> dict[str, list[int]]:
    """All places of each word in `text`, ascending, by one pass of an automaton over the words."""
    found: dict[str, list[int]] = {w: [] for w in words if w}
    if found:
        automaton = ahocorasick.Automaton()
        for w in found:
            automaton.add_word(w, w)
        automaton.make_automaton()
        for last, w in automaton.iter(text):
            found[w].append(last + 1 - len(w))
    return found


def all_places(text: str, word: str) -> list[int]:
    found, a = [], text.find(word)
    while a >= 0:
        found.append(a)
        a = text.find(word, a + 1)
    return found


def locate_words(text: str, words: list[str | None]) -> np.ndarray:
    """Spans (start, end) of externally given words in `text`.

    Words that are the text's own, in order, get the spans of its tiling. Otherwise each
    word takes its first place at or after the end of the last span, or, past its last place, its
    first one, which moves the cursor back; a word without a place (null and empty too) gets a zero-width span at the cursor.
    So a span that is not empty reads the word itself.
    """
    if TILE.findall(text) == words:
        return np.array([m.span() for m in TILE.finditer(text)], np.int32).reshape(-1, 2)
    places: dict[str, list[int]] = {}
    spans, free, find = [], 0, text.find
    for w in words:
        a = find(w, free, free + NEAR + len(w)) if w else -1
        if a < 0:
            if w and w not in places:  # few words are searched one by one, more by the automaton
                if len(places) >= FEW:
                    places = word_places(text, set(words))
                else:
                    places[w] = all_places(text, w)
            at = places.get(w) if w else None
            a = at[bisect_left(at, free) % len(at)] if at else free
            w = w if at else ""
        spans.append(a)
        free = a + len(w)
        spans.append(free)
    return np.array(spans, np.int32).reshape(-1, 2)


def overlaps(spans: np.ndarray, kept: np.ndarray) -> np.ndarray:
    """Which spans overlap a kept one (half-open; a zero-width span counts inside one), by one sweep.

    Of the kept spans that begin before a span ends, the furthest end decides.
    """
    kept = kept[kept[:, 1] > kept[:, 0]]
    kept = kept[np.argsort(kept[:, 0], kind="stable")]
    reach = np.concatenate(([-1], np.maximum.accumulate(kept[:, 1]))) if len(kept) else np.array([-1])
    start, end = spans[:, 0], spans[:, 1]
    before = np.where(end > start, np.searchsorted(kept[:, 0], end, "left"), np.searchsorted(kept[:, 0], start, "right"))
    return reach[before] > start


SPAN = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
FOUND = T.StructType([T.StructField("spans", T.ArrayType(SPAN)), T.StructField("hits", T.ArrayType(T.BooleanType()))])


@F.arrow_udf(FOUND)
def located_udf(text: pa.Array, words: pa.Array, kept: pa.Array) -> pa.Array:
    """Words become strings one text at a time; spans stay in arrays of eight bytes a word."""
    offsets, spans, hits = np.zeros(len(text) + 1, np.int32), [np.empty((0, 2), np.int32)], [np.empty(0, bool)]
    for row in range(len(text)):
        found = locate_words(text[row].as_py() or "", words[row].as_py() or [])
        known = kept[row].values
        known = np.empty((0, 2), np.int64) if known is None else np.stack([known.field(x).to_numpy(zero_copy_only=False) for x in ("start", "end")], 1)
        offsets[row + 1] = offsets[row] + len(found)
        spans.append(found)
        hits.append(overlaps(found, known))
    flat = np.concatenate(spans)
    each = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(flat[:, side])) for side in (0, 1)], ["start", "end"])
    lists = [pa.ListArray.from_arrays(offsets, each), pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(hits)))]
    return pa.StructArray.from_arrays(lists, ["spans", "hits"])


def located(df: DataFrame, labels: str = "labels", text: str = "text", kept: str | None = None) -> DataFrame:
    """`df` with found.spans, one per label, and found.hits: which of them overlap a span of the column `kept`. Narrow."""
    spans = F.col(kept) if kept else F.lit(None)
    found = located_udf.asNondeterministic()  # not moved or doubled by the optimizer
    return df.withColumn("found", found(F.col(text), F.transform(labels, lambda x: x["word"]), spans.cast(T.ArrayType(SPAN))))


# --- interval overlap ----------------------------------------------------------------
def overlapping_words(words: DataFrame, kept: DataFrame, keep: list[str] = ["doc_id"]) -> DataFrame:
    """Words overlapping any kept span of the same text (half-open); a zero-width word
    counts when it lies inside a span.

    One sweep per text over both sides in one sort: words stand at their end, spans at their start, and
    the furthest span end so far decides. Words and spans meet once and none is repeated.
    """
    s, e = F.col("start"), F.col("end")
    carried = F.struct(*[c for c in words.columns if c not in keep])
    wide = e > s
    none = F.lit(None)
    left = words.select(
        *keep, carried.alias("_row"), F.when(wide, e).otherwise(s).alias("_at"), F.when(wide, 0).otherwise(2).alias("_turn"),
        s.alias("_start"), none.cast("int").alias("_end"),
    )
    right = kept.filter(wide).select(
        *keep, none.cast(left.schema["_row"].dataType).alias("_row"), s.alias("_at"), F.lit(1).alias("_turn"), none.cast("int").alias("_start"), e.alias("_end")
    )
    sweep = Window.partitionBy(*keep).orderBy("_at", "_turn").rowsBetween(Window.unboundedPreceding, 0)
    met = left.unionByName(right).withColumn("_reach", F.max("_end").over(sweep))
    return met.filter("_row is not null and _reach > _start").select(*keep, "_row.*")


# --- masks -----------------------------------------------------------------------------
def combine(mode: Column, a: Column, b: Column) -> Column:
    return F.when(mode == "intersection", a & b).otherwise(a | b)


def combine_positions(mode: Column, left: Column, guided: Column) -> Column:
    """The same rule on ascending position arrays."""
    both = F.array_intersect(left, guided)
    either = F.sort_array(F.array_union(left, guided))
    return F.when(mode == "intersection", both).otherwise(either)


def words_at(words: Column, positions: Column) -> Column:
    """Kept words in reading order, joined by one space."""
    return F.array_join(F.transform(positions, lambda p: F.get(words, p)), " ")


def merge_labels(df: DataFrame, kept: DataFrame, keep: list[str] = ["doc_id"]) -> DataFrame:
    """Merge label words with kept spans, one row per text.

    df: keep.., text, labels (array of word, keep), mode, guided_empty
    kept: keep.., start, end. A text without spans, or flagged empty, keeps its labels.
    Returns compressed, merged (array of word, keep), both masks, counts and the flag.

    The spans of a text come to its row in one join; labels are located and swept over the spans there.
    """
    spans = kept.groupBy(*keep).agg(F.collect_list(F.struct(F.col("start").cast("int"), F.col("end").cast("int"))).alias("_kept"))
    held = located(df.join(spans, keep, "left"), kept="_kept")
    fallback = F.coalesce("guided_empty", F.lit(False)) | F.col("_kept").isNull()
    held = held.withColumn("fallback", fallback).withColumn("labels", F.coalesce("labels", F.array().cast(df.schema["labels"].dataType)))

    def both(x: Column, i: Column) -> Column:
        lab, a = F.coalesce(x["keep"] == 1, F.lit(False)), F.get("found.hits", i) & ~F.col("fallback")
        m = F.when(F.col("fallback"), lab).otherwise(combine(F.col("mode"), a, lab))
        return F.struct(x["word"].alias("word"), x["keep"].alias("l"), a.alias("a"), m.alias("m"))

    held = held.withColumn("_w", F.transform("labels", both))
    return held.select(
        *keep, "mode", "fallback",
        F.array_join(F.transform(F.filter("_w", lambda x: x["m"]), lambda x: x["word"]), " ").alias("compressed"),
        F.transform("_w", lambda x: F.struct(x["word"].alias("word"), x["m"].cast("int").alias("keep"))).alias("merged"),
        F.transform("_w", lambda x: x["l"]).alias("mask_label"),
        F.transform("_w", lambda x: x["a"].cast("int")).alias("mask_guided"),
        F.size("_w").alias("n_words"), F.size(F.filter("_w", lambda x: x["m"])).alias("n_kept"),
    )


def guard_overshoot(compressed: Column, original: Column, merged: Column) -> Column:
    """A rebuilt text longer than its original is rebuilt from the label words."""
    plain = F.array_join(F.transform(F.filter(merged, lambda x: x["keep"] == 1), lambda x: x["word"]), " ")
    return F.when(F.length(compressed) > F.length(original), plain).otherwise(compressed)


def clean_spans(spans: Column) -> Column:
    return F.array_sort(F.filter(F.coalesce(spans, F.array()), lambda s: s["end"] > s["start"]))


def splice_spans(text: Column, spans: Column) -> Column:
    """Spans in order, stripped, joined by a space; without spans the text itself."""
    cut = lambda s: tx.strip(F.substr(text, s["start"] + 1, s["end"] - s["start"]))
    joined = lambda c: tx.strip(F.array_join(F.transform(c, cut), " "))
    return let(clean_spans(spans), lambda c: F.when(F.size(c) == 0, text).otherwise(joined(c)))
