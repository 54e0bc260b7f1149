"""Near-duplicate sentences inside one text, as blocks of sentences against blocks.

Sentences of one text with the same words count as one class, so copies never meet. A text
moves once by its key, and its words become one row per (text, word) with the classes that
have it. These rows get their corpus counts and are gathered by text and pair of blocks of
BLOCK sentences: most texts are one block, a long one spreads over many tasks. The cosines
of a pair of blocks are products of its weight matrices, with only the words that two
classes share, some columns at a time; what a caller does not ask for never leaves the task.

Dedup visits sentences by relevance and drops one that is too close to a kept one. On the
pair rows this is a peel in rounds: a sentence with no open pair before it is kept, all
that are close to a kept one are dropped, and the pairs of both go.
"""

from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as tx
from ..functions.bind import let
from ..session import materialize, short_batches
from .lookup import ROW_BYTES, SMALL_CHARS, counts_of, frequent, lookup
from .windows import top_rows

BLOCK = 512  # sentences
COLUMNS = 4096  # words of a product at a time
DIGITS, SHOWN = 9, 6
MARGIN = 1e-6  # of a bound against its rounding


class Frequency(NamedTuple):
    table: DataFrame  # term, df: sentences with the word
    bytes: int  # measured
    sentences: int


def matched(left: DataFrame, right: DataFrame, on: list[str], how: str) -> DataFrame:
    """Join on equal columns of which null equals null; one copy of them stays."""
    right = right.withColumnsRenamed({k: f"_{k}" for k in on})
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in on]
    return left.join(right, reduce(Column.__and__, same), how).drop(*[f"_{k}" for k in on])


def _runs(bag: Column) -> Column:
    """(term, tf) of a sorted array of words."""
    def cut(words: Column) -> Column:
        places = F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: (i == 0) | (F.get(words, i) != F.get(words, i - 1)))
        end = lambda at, k: F.coalesce(F.get(at, k + 1), F.size(words))
        return let(places, lambda at: F.transform(at, lambda a, k: F.struct(F.get(words, a).alias("term"), (end(at, k) - a).alias("tf"))))

    return F.when(F.size(bag) > 0, let(bag, cut))


def sentence_classes(df: DataFrame, keys: list[str], sentences: Column, relevance: Column | None = None) -> DataFrame:
    """Sentences of a text by their words: keys.., idx (the first), copies (all, ascending), top (the text's last idx), relevance, words (term, tf); written once."""
    if relevance is None:
        rows = df.repartition(*keys).select(*keys, F.posexplode(sentences).alias("idx", "sentence")).withColumn("relevance", F.lit(0.0))
    else:
        held = df.repartition(*keys).select(*keys, F.arrays_zip(sentences.alias("sentence"), relevance.alias("relevance")).alias("_s"))
        rows = held.select(*keys, F.posexplode("_s").alias("idx", "s")).select(*keys, "idx", "s.*")
    rows = rows.select(*keys, "idx", "relevance", F.sort_array(tx.split_words(F.lower("sentence"))).alias("bag"))
    each = rows.groupBy(*keys, "bag").agg(F.min("idx").alias("idx"), F.sort_array(F.collect_list("idx")).alias("copies"), F.max("relevance").alias("relevance"))
    each = each.withColumn("top", F.max(F.element_at("copies", -1)).over(Window.partitionBy(*keys)))
    return materialize(each.select(*keys, "idx", "copies", "top", "relevance", _runs(F.col("bag")).alias("words")))


def class_frequency(classes: DataFrame) -> Frequency:
    n = classes.agg(F.sum(F.size("copies"))).first()[0] or 0
    rows = classes.select(F.size("copies").alias("_n"), F.explode("words.term").alias("term"))
    freq = materialize(rows.groupBy("term").agg(F.sum("_n").alias("df")))
    return Frequency(freq, freq.agg(F.sum(F.octet_length("term") + ROW_BYTES)).first()[0] or 0, n)


def sentence_frequency(df: DataFrame, sentences: Column) -> Frequency:
    """`class_frequency` straight from texts; a null word in every sentence counts them."""
    words = F.array_distinct(tx.split_words(F.lower("s")))
    rows = df.select(F.explode(sentences).alias("s")).select(F.explode(F.concat(words, F.array(F.lit(None).cast("string")))).alias("term"))
    every = materialize(rows.groupBy("term").agg(F.count("*").alias("df")))
    freq = every.filter("term is not null")
    n = every.filter("term is null").agg(F.sum("df")).first()[0] or 0
    return Frequency(freq, freq.agg(F.sum(F.octet_length("term") + ROW_BYTES)).first()[0] or 0, n)


def term_rows(classes: DataFrame, keys: list[str], frequency: Frequency | None = None) -> DataFrame:
    """The words of each text: keys.., top, idf (smoothed, over all sentences of the table), at (idx, n copies, tf of each class with the word)."""
    freq, size, n = frequency or class_frequency(classes)
    rows = classes.select(*keys, "idx", "top", F.size("copies").alias("n"), "words").repartition(*keys).select(*keys, "idx", "top", "n", F.explode("words").alias("_w"))
    rows = rows.groupBy(*keys, F.col("_w.term").alias("term")).agg(F.max("top").alias("top"), F.collect_list(F.struct("idx", "n", "_w.tf")).alias("at"))
    held = lookup(rows, freq, "term", size, frequent(freq, "df", size))
    return held.select(*keys, "top", F.log((F.lit(n) + 1.0) / (F.col("df") + 1)).alias("idf"), "at")


def cosines(idf: np.ndarray, lengths: np.ndarray, idx: np.ndarray, n: np.ndarray, tf: np.ndarray, a: int, b: int, least: float | None, k: int | None, block: int = BLOCK):
    """(i, j, sim) of the classes of two blocks, i < j; a class of copies with itself is 1.

    `idf` and `lengths` are per word, the other arrays per place of a word. Pairs below `least` are left out (None: those
    without a common word); `k` keeps the most similar of different classes, ties to the larger i, then the larger j.
    """
    ids, at = np.unique(idx, return_inverse=True)
    weight = tf * np.repeat(idf, lengths)
    square = np.bincount(at, weight * weight, len(ids))
    left, right = (np.flatnonzero((ids // block == x) & (square > 0)) for x in (a, b))
    shared = lengths > 1
    here = np.flatnonzero(np.repeat(shared, lengths))
    column = np.repeat(np.arange(shared.sum()), lengths[shared])
    dots, met = np.zeros((len(left), len(right))), np.zeros((len(left), len(right)), bool)
    flat = np.repeat(idf[shared] == 0, lengths[shared])  # words that every sentence has
    for first in range(0, int(shared.sum()), COLUMNS):
        part = slice(*np.searchsorted(column, (first, first + COLUMNS)))
        x = np.zeros((len(ids), min(COLUMNS, int(shared.sum()) - first)))
        np.add.at(x, (at[here[part]], column[part] - first), weight[here[part]])
        dots += x[left] @ x[right].T
        if least is None and flat[part].any():
            x[:] = 0
            x[at[here[part]][flat[part]], column[part][flat[part]] - first] = 1
            met |= x[left] @ x[right].T > 0
    sim = _half_up(dots / np.sqrt(np.outer(square[left], square[right])), DIGITS)
    met = (met | (dots > 0) if least is None else sim >= least) & (ids[left][:, None] < ids[right][None, :])
    one, two = np.nonzero(met)
    i, j, sim = ids[left][one], ids[right][two], sim[one, two]
    if k is not None and len(i) > k:
        best = np.lexsort((-j, -i, -_half_up(sim, SHOWN)))[:k]
        i, j, sim = i[best], j[best], sim[best]
    if a == b:
        twice = np.unique(idx[(n > 1) & (square[at] > 0)])
        i, j, sim = np.concatenate((i, twice)), np.concatenate((j, twice)), np.concatenate((sim, np.ones(len(twice))))
    return i, j, sim


def _half_up(x: np.ndarray, digits: int) -> np.ndarray:
    return np.floor(x * 10**digits + 0.5) / 10**digits


def may_be_close(codes: np.ndarray, row: np.ndarray, tf: np.ndarray, low: np.ndarray, high: np.ndarray, m: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """For m classes: which may have a cosine of `least` with another one, and the squared lengths at least; by the lowest and highest idf of each word.

    A place (codes, row, tf) is a word of a class. No pair at or above `least` is missed, others may be found.
    """
    square = np.bincount(row, (tf * low[codes]) ** 2, m)
    words, column, held = np.unique(codes, return_inverse=True, return_counts=True)
    shared = np.cumsum(held > 1) - 1  # new numbers of the words that two classes have
    here = np.flatnonzero(held[column] > 1)
    here = here[np.argsort(column[here], kind="stable")]
    at, weight, dots = shared[column[here]], (tf * high[codes])[here], np.zeros((m, m))
    for first in range(0, int((held > 1).sum()), COLUMNS):
        part = slice(*np.searchsorted(at, (first, first + COLUMNS)))
        x = np.zeros((m, min(COLUMNS, int((held > 1).sum()) - first)))
        x[row[here[part]], at[part] - first] = weight[part]
        dots += x @ x.T
    np.fill_diagonal(dots, 0)
    length = np.sqrt(square)
    return ((dots > 0) & (dots >= (least - MARGIN) * np.outer(length, length))).any(1), square


def close_classes(df: DataFrame, keys: list[str], sentences: Column, relevance: Column, frequency: Frequency, least: float, block: int = BLOCK, apart: bool = False) -> DataFrame:
    """`sentence_classes` that have copies or may be close to another: .., words (null: to no other), solid (its vector is not zero); written once.

    A text finds them where it lies, by the idf of frequent words and bounds for the others. Texts of several blocks leave it to `similar_classes`;
    `apart`: several texts of one key too.
    """
    short_batches(df.sparkSession)
    cut = lambda x, i: F.struct(i.alias("idx"), tx.split_words(F.lower(x["sentence"])).alias("words"), x["relevance"].alias("relevance"))
    rows = df.repartition(*keys).select(*keys, F.transform(F.arrays_zip(sentences.alias("sentence"), relevance.alias("relevance")), cut).alias("_s"))
    rows = rows.groupBy(*keys).agg(F.flatten(F.collect_list("_s")).alias("_s"))
    hot = frequent(frequency.table, "df", frequency.bytes)
    n, least_hot = frequency.sentences, hot.agg(F.min("df")).first()[0]
    below = n if least_hot is None else least_hot - 1  # of a short word that is not hot
    known = df.sparkSession.sparkContext.broadcast(hot.select("term", "df").toArrow().combine_chunks())
    shape = T.StructType([rows.schema[key] for key in keys] + T._parse_datatype_string(
        "idx int, copies array<int>, top int, relevance double, solid boolean, words array<struct<term:string,tf:bigint>>"
    ).fields)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, counts = (known.value[c].combine_chunks() for c in ("term", "df"))
        for batch in batches:
            texts = batch.column("_s")
            sents = texts.flatten()
            places, rel = sents.field("idx").to_pylist(), sents.field("relevance").to_pylist()
            words = sents.field("words")
            each = words.flatten().dictionary_encode()
            codes, names = each.indices.to_numpy(), each.dictionary
            ends = np.concatenate(([0], np.cumsum(words.value_lengths().to_numpy()))).astype(int)
            df_ = counts_of(names, terms, counts)
            long = pc.greater(pc.utf8_length(names), SMALL_CHARS).to_numpy(zero_copy_only=False)
            idf = lambda x: np.log((n + 1.0) / (x + 1))
            high = idf(df_.fill_null(1).to_numpy())
            low = np.where(df_.is_null().to_numpy(zero_copy_only=False) & long, 0.0, idf(df_.fill_null(below).to_numpy()))
            out, begin = [], 0
            for text, size in enumerate(texts.value_lengths().to_pylist()):
                classes: dict[bytes, list[int]] = {}
                for i in range(begin, begin := begin + (size or 0)):
                    classes.setdefault(np.sort(codes[ends[i]:ends[i + 1]]).tobytes(), []).append(i)
                if not classes:
                    continue
                bags = [np.unique(codes[ends[c[0]]:ends[c[0] + 1]], return_counts=True) for c in classes.values()]
                row = np.repeat(np.arange(len(bags)), [len(b) for b, _ in bags])
                near, square = np.ones(len(bags), bool), np.zeros(len(bags))
                top = max(places[i] for c in classes.values() for i in c)
                several = apart and len({places[i] for c in classes.values() for i in c}) < sum(map(len, classes.values()))
                if not several and (len(bags) == 1 or top < block):
                    flat, tf = (np.concatenate([b[side] for b in bags]) for side in (0, 1))
                    near, square = may_be_close(flat, row, tf, low, high, len(bags), least)
                    near |= (square == 0) & (np.bincount(row, high[flat], len(bags)) > 0)  # not known whether it is zero
                for copies, bag, close, solid in zip(classes.values(), bags, near.tolist(), (square > 0).tolist()):
                    if close or len(copies) > 1:
                        at = sorted(places[i] for i in copies)
                        most = max((rel[i] for i in copies if rel[i] is not None), default=None)
                        out.append((text, at[0], at, top, most, solid, bag if close else None))
            if out:
                take = pa.array([x[0] for x in out], pa.int32())
                columns = [batch.column(key).take(take) for key in keys] + [pa.array([x[i] for x in out], t) for i, t in zip(range(1, 6), (pa.int32(), pa.list_(pa.int32()), pa.int32(), pa.float64(), pa.bool_()))]
                bags = [x[6] for x in out]
                sizes = np.cumsum([0] + [0 if b is None else len(b[0]) for b in bags])
                flat, tf = (np.concatenate([np.empty(0, np.int64), *(b[side] for b in bags if b is not None)]).astype(np.int64) for side in (0, 1))
                pairs = pa.StructArray.from_arrays([names.take(pa.array(flat)), pa.array(tf)], ["term", "tf"])
                columns.append(pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pairs, mask=pa.array([b is None for b in bags])))
                yield pa.RecordBatch.from_arrays(columns, names=shape.names)

    return materialize(rows.mapInArrow(found, shape))


def similar_classes(
    classes: DataFrame, keys: list[str], least: float | None, k: int | None = None, block: int = BLOCK, frequency: Frequency | None = None
) -> DataFrame:
    """Pairs of classes: keys.., i, j (i < j), sim; and each class of copies with itself. See `cosines`. `frequency`: of all sentences, where these are not all classes."""
    div = lambda x: F.floor(x / block).cast("int")
    rows = term_rows(classes, keys, frequency)
    blocks = F.array_distinct(F.transform("at", lambda x: div(x["idx"])))
    every = F.sequence(F.lit(0), div(F.col("top")))
    pairs = F.array_distinct(F.flatten(F.transform(blocks, lambda x: F.transform(every, lambda y: F.struct(F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))))))
    rows = rows.select(*keys, "top", "idf", "at", F.explode(F.when(F.col("top") < block, F.array(F.struct(F.lit(0).alias("a"), F.lit(0).alias("b")))).otherwise(pairs)).alias("_p"))
    inside = F.filter("at", lambda x: div(x["idx"]).isin(F.col("_p.a"), F.col("_p.b")))
    rows = rows.select(*keys, "_p.*", F.struct("idf", F.when(F.col("top") < block, F.col("at")).otherwise(inside).alias("at")).alias("_t"))
    grouped = rows.groupBy(*keys, "a", "b").agg(F.collect_list("_t").alias("terms"))
    shape = T.StructType([grouped.schema[key] for key in keys] + [T.StructField("i", T.IntegerType()), T.StructField("j", T.IntegerType()), T.StructField("sim", T.DoubleType())])

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                words = batch.column("terms")[row].values
                at = words.field("at").combine_chunks() if isinstance(words, pa.ChunkedArray) else words.field("at")
                places = at.flatten()
                idx, n, tf = (places.field(name).to_numpy(zero_copy_only=False) for name in ("idx", "n", "tf"))
                lengths = at.value_lengths().to_numpy(zero_copy_only=False)
                a, b = batch.column("a")[row].as_py(), batch.column("b")[row].as_py()
                i, j, sim = cosines(words.field("idf").to_numpy(zero_copy_only=False), lengths, idx, n, tf, a, b, least, k, block)
                if len(i):
                    names = [pa.repeat(batch.column(key)[row], len(i)) for key in keys]
                    yield pa.RecordBatch.from_arrays([*names, pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(sim, pa.float64())], names=[*keys, "i", "j", "sim"])

    return grouped.mapInArrow(found, shape)


def top_pairs(df: DataFrame, threshold: float | None, k: int, text: str = "text", keys: list[str] = ["doc_id"]) -> DataFrame:
    """The `k` most similar sentence pairs of each text, of those at or above `threshold` (None: with a common word): keys.., i, j, sim.

    Ties go to the larger i, then the larger j. So of each class of equal sentences only the last k + 1 can be in a pair, and a
    class stands in the order of pairs with its last one. With a threshold only sentences that may reach it with another one move on.
    """
    sents, last = tx.split_sentences(F.col(text)), F.element_at("copies", -1).alias("idx")
    if threshold is None:
        classes = sentence_classes(df.select(*keys, text), keys, sents)
        pairs = similar_classes(classes.withColumn("idx", last), keys, threshold, k)
    else:
        frequency = sentence_frequency(df, sents)
        classes = close_classes(df.select(*keys, text), keys, sents, F.transform(sents, lambda s: F.lit(0.0)), frequency, threshold, apart=True)
        pairs = similar_classes(classes.filter("words is not null").withColumn("idx", last), keys, threshold, k, frequency=frequency)
        alone = classes.filter((F.size("copies") > 1) & F.col("words").isNull() & F.col("solid"))
        pairs = pairs.unionByName(alone.select(*keys, last.alias("i"), last.alias("j"), F.lit(1.0).alias("sim")))
    # a class with itself stands for copies that both come before its last one, so it takes no other pair's place
    order = Window.partitionBy(*keys, F.col("i") == F.col("j")).orderBy(F.desc(F.round("sim", SHOWN)), F.desc("i"), F.desc("j"))
    pairs = pairs.withColumn("_rank", F.row_number().over(order)).filter((F.col("_rank") <= k) | (F.col("i") == F.col("j"))).drop("_rank")
    many = classes.filter(F.size("copies") > 1).select(*keys, last, F.reverse(F.slice(F.reverse("copies"), 1, k + 1)).alias("last"))
    for side in ("i", "j"):
        pairs = matched(pairs, many.select(*keys, F.col("idx").alias(side), F.col("last").alias(f"of_{side}")), [*keys, side], "left")
        pairs = pairs.withColumn(f"of_{side}", F.coalesce(f"of_{side}", F.array(side)))
    same = F.col("i") == F.col("j")
    tagged = lambda c: F.transform(c, lambda x, at: F.struct(x.alias("idx"), at.alias("at")))
    whole = pairs.select(*keys, "sim", same.alias("_same"), F.explode(tagged(F.col("of_i"))).alias("a"), "of_j")
    whole = whole.select(*keys, "sim", "_same", "a", F.explode(tagged(F.col("of_j"))).alias("b")).filter(~F.col("_same") | (F.col("a.at") < F.col("b.at")))
    every = whole.select(*keys, F.least("a.idx", "b.idx").alias("i"), F.greatest("a.idx", "b.idx").alias("j"), F.round("sim", SHOWN).alias("sim"))
    return top_rows(every, keys, [F.desc("sim"), F.desc("i"), F.desc("j")], k).drop("rank")


def blocked(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Nodes (keys.., n) outside the first independent set of pairs (keys.., a, b), a visited before b; written in rounds.

    A round takes the nodes that no open node stands before, blocks all they point to, and
    drops the pairs of both.
    """
    open_pairs, parts = materialize(pairs.select(*keys, "a", "b")), []
    while not open_pairs.isEmpty():
        later = open_pairs.select(*keys, F.col("b").alias("a")).distinct()
        gone = materialize(matched(open_pairs, later, [*keys, "a"], "left_anti").select(*keys, F.col("b").alias("n")).distinct())
        parts.append(gone)
        left = matched(open_pairs, gone.withColumnRenamed("n", "a"), [*keys, "a"], "left_anti")
        open_pairs = materialize(matched(left, gone.withColumnRenamed("n", "b"), [*keys, "b"], "left_anti"))
    return reduce(DataFrame.unionByName, parts) if parts else open_pairs.select(*keys, F.col("b").alias("n"))


def dropped_sentences(df: DataFrame, threshold: float, text: str = "text", terms: str = "terms", keys: list[str] = ["doc_id"]) -> DataFrame:
    """Sentences that dedup drops: keys.., idx, sim and closest (the closest kept sentence visited before, the first of equals).

    Sentences are visited by relevance, the highest first, ties in reading order. Of equal sentences the first
    one stands for all: where it is kept the others are dropped by it.
    """
    sents = tx.split_sentences(F.col(text))
    frequency = sentence_frequency(df, sents)
    classes = close_classes(df.select(*keys, text, terms), keys, sents, term_relevance(sents, terms), frequency, threshold)
    near = materialize(similar_classes(classes.filter("words is not null"), keys, threshold, frequency=frequency))
    own = lambda side: classes.select(*keys, F.col("idx").alias(side), F.col("relevance").alias(f"rel_{side}"))
    found = matched(matched(near.filter("i < j"), own("i"), [*keys, "i"], "inner"), own("j"), [*keys, "j"], "inner")
    found = materialize(found)
    first = (F.col("rel_i") > F.col("rel_j")) | ((F.col("rel_i") == F.col("rel_j")) & (F.col("i") < F.col("j")))
    gone = blocked(found.select(
        *keys, F.when(first, F.col("i")).otherwise(F.col("j")).alias("a"), F.when(first, F.col("j")).otherwise(F.col("i")).alias("b")
    ), keys)
    # a copy is visited after its class, so kept sentences in between count for it too
    ends = lambda a, b: F.struct(F.col(a).alias("closest"), F.col(f"rel_{a}").alias("rel"), F.col(b).alias("idx"))
    met = found.select(*keys, "sim", F.explode(F.array(ends("i", "j"), ends("j", "i"))).alias("e")).select(*keys, "sim", "e.*")
    met = matched(met, gone.withColumnRenamed("n", "closest"), [*keys, "closest"], "left_anti")
    met = matched(met, gone.withColumnRenamed("n", "idx"), [*keys, "idx"], "left_semi")
    met = matched(met, classes.select(*keys, "idx", "copies", F.col("relevance").alias("own")), [*keys, "idx"], "inner")
    met = met.select(*keys, "closest", "sim", "rel", "own", F.explode("copies").alias("idx"))
    met = met.filter((F.col("rel") > F.col("own")) | ((F.col("rel") == F.col("own")) & (F.col("closest") < F.col("idx"))))
    best = F.max_by(F.struct("sim", "closest"), F.struct("sim", "rel", -F.col("closest")))
    causes = met.groupBy(*keys, "idx").agg(best.alias("c")).select(*keys, "idx", "c.sim", "c.closest")
    alike = matched(classes.filter(F.size("copies") > 1), gone.withColumnRenamed("n", "idx"), [*keys, "idx"], "left_anti")
    proven = near.filter("i = j").select(*keys, F.col("i").alias("idx"), F.lit(True).alias("_proven"))
    alike = matched(alike, proven, [*keys, "idx"], "left").filter("solid or _proven")
    copies = alike.select(*keys, F.explode(F.slice("copies", 2, F.size("copies"))).alias("idx"), F.lit(1.0).alias("sim"), F.get("copies", F.lit(0)).alias("closest"))
    return causes.unionByName(copies)


def term_relevance(sentences: str | Column, terms: str) -> Column:
    """Cosine of each sentence's word counts to the set of intent terms; NULL without words."""

    def one(words):
        hits = F.size(F.filter(words, lambda w: F.array_contains(F.col(terms), w)))
        return F.round(F.try_divide(hits, F.sqrt(F.size(words) * F.greatest(F.size(F.col(terms)), F.lit(1)))), 9)

    columns = F.col(sentences) if isinstance(sentences, str) else sentences
    return F.transform(columns, lambda s: let(tx.split_words(F.lower(s)), one))


def dedupe(df: DataFrame, threshold: float, text: str = "text", terms: str = "terms", keys: list[str] = ["doc_id"]) -> DataFrame:
    """Drop near-duplicate sentences: adds sents, kept, dropped (idx, sentence, sim, closest), deduped. `keys` name a text."""
    gone = dropped_sentences(df, threshold, text, terms, keys)
    gone = gone.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("idx", "sim", "closest"))).alias("_gone"))
    held = matched(df, gone, keys, "left").withColumn("sents", tx.split_sentences(F.col(text)))
    held = held.withColumn("_gone", F.coalesce("_gone", F.array().cast("array<struct<idx:int,sim:double,closest:int>>")))
    every = F.when(F.size("sents") > 0, F.sequence(F.lit(0), F.size("sents") - 1)).otherwise(F.array().cast("array<int>"))
    held = held.withColumn("kept", F.array_except(every, F.transform("_gone", lambda x: x["idx"])))
    dropped = F.transform("_gone", lambda x: F.struct(x["idx"].alias("idx"), F.get("sents", x["idx"]).alias("sentence"), x["sim"].alias("sim"), x["closest"].alias("closest")))
    rebuilt = F.array_join(F.transform("kept", lambda i: F.get("sents", i)), " ")
    return held.withColumn("dropped", dropped).drop("_gone").withColumn(
        "deduped", F.when(F.size("sents") <= 1, F.col(text)).otherwise(rebuilt)
    )
