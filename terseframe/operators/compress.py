"""Keep-rate compression and the composite compression jobs."""

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import prompts, text as tx
from ..session import materialize, short_batches
from . import dedup, merge, selection
from .lookup import SMALL_CHARS, counts_of, lookup
from .scores import Vocabulary, counted_words, join_scores, question_contrast
from .segment import by_key, plain_words, sentence_windows, texts_by_key
from .windows import running_sum

CHUNK, TOP_K = 300, 12


# --- keep-rate compression ---------------------------------------------------------------
def cut_rank(n: Column, rate: Column, target: Column | None = None) -> Column:
    """How many words the budget allows: a hard target where given, else ceil(rate * n)."""
    by_rate = F.ceil(rate * n)
    return by_rate if target is None else F.when(target > 0, target).otherwise(by_rate)


RARE_FIRST = (F.asc, "count")
HIGH_FIRST = (F.desc_nulls_last, "score")


def mark_words(
    scored: DataFrame, keep: list[str], rate: Column, target: Column | None = None, first: tuple = RARE_FIRST
) -> DataFrame:
    """Add `stays` to scored words: keep.., pos, word, count (or score), stays.

    Rare words stay first (HIGH_FIRST: those of a high score), ties in reading order, up to the budget. Words with a digit and
    the forced marks always stay; a forced mark that repeats the staying word before it goes.
    The windows run over one text's words, and the rows are already placed by text.
    """
    text = Window.partitionBy(*keep)
    rank = F.row_number().over(text.orderBy(first[0](first[1]), "pos"))
    held = scored.withColumn("_rank", rank).withColumn("_n", F.count("*").over(text))
    forced = F.col("word").isin(tx.FORCED_TOKENS)
    within = F.col("_rank") <= cut_rank(F.col("_n"), rate, target)
    held = held.withColumn("_in", within | F.col("word").rlike("[0-9]") | forced)
    before = text.orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    previous = F.last(F.when(F.col("_in"), F.col("word")), ignorenulls=True).over(before)
    repeated = forced & F.coalesce(previous == F.col("word"), F.lit(False))
    return held.withColumn("stays", F.col("_in") & ~repeated).drop("_rank", "_n", "_in")


def keep_words(scored: DataFrame, keep: list[str], rate: Column, target: Column | None = None) -> DataFrame:
    """Pruned words as arrays: keep.., words (all), kept (ascending positions)."""
    marked = mark_words(scored, keep, rate, target)
    item = F.struct("pos", "word", "stays")
    held = marked.groupBy(*keep).agg(F.array_sort(F.collect_list(item)).alias("_w"))
    return held.select(
        *keep, F.transform("_w", lambda x: x["word"]).alias("words"),
        F.transform(F.filter("_w", lambda x: x["stays"]), lambda x: x["pos"]).alias("kept"),
    )


def staying(counts: np.ndarray, marks: np.ndarray, budget: int) -> np.ndarray:
    """Places that stay of the words of a text, by the rule of `mark_words`. marks: 0 a plain word, 1 one with a digit, from 2 on the forced marks."""
    inside = marks > 0
    inside[np.argsort(counts, kind="stable")[: max(budget, 0)]] = True
    at = np.flatnonzero(inside)
    again = (marks[at][1:] > 1) & (marks[at][1:] == marks[at][:-1])
    return np.delete(at, np.flatnonzero(again) + 1).astype(np.int32)


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def staying_udf(counts: pa.Array, marks: pa.Array, budget: pa.Array, pos: pa.Array) -> pa.Array:
    """`pos` of the words that stay; a null count is the smallest."""
    parts = [np.empty(0, np.int32)]
    for row in range(len(counts)):
        known, codes, at = (x[row].values for x in (counts, marks, pos))
        if known is None:
            parts.append(parts[0])
        else:
            stay = staying(known.fill_null(0).to_numpy(zero_copy_only=False), codes.to_numpy(zero_copy_only=False), budget[row].as_py())
            parts.append(at.to_numpy(zero_copy_only=False)[stay])
    offsets = np.cumsum([len(x) for x in parts], dtype=np.int32)
    return pa.ListArray.from_arrays(offsets, np.concatenate(parts))


def word_budget(rate: Column, target: Column | None = None) -> Column:
    """`cut_rank` of collected words `_w`; 0 without a rate."""
    return F.coalesce(cut_rank(F.size("_w"), rate, target).cast("int"), F.lit(0))


HELD_WORDS = 1 << 16  # that a worker holds as Python strings, and those of one more text
WORDS = T.ArrayType(T.StructType([
    T.StructField("pos", T.IntegerType()), T.StructField("word", T.StringType()), T.StructField("count", T.LongType()), T.StructField("mark", T.IntegerType()),
]))


def word_marks(words: pa.Array) -> pa.Array:
    """See `staying`."""
    forced = pc.add(pc.index_in(words, value_set=pa.array(tx.FORCED_TOKENS)), 2)
    return pc.coalesce(forced, pc.cast(pc.match_substring_regex(words, "[0-9]"), pa.int32()))


def counting_udf(hot: DataFrame, only: bool):
    """Words (see WORDS) of the texts of a key (text, lower) with their counts in the small table `hot`; `only`: no words without one."""
    known = hot.sparkSession.sparkContext.broadcast(hot.select("term", "count").toArrow().combine_chunks())

    @F.arrow_udf(WORDS)
    def found(texts: pa.Array) -> pa.Array:
        each = texts.flatten()
        pairs = zip(*((v.as_py() for v in each.field(x)) for x in ("text", "lower")))
        pos, words, terms, ends, held = [], [], [], [0], []

        def encode() -> None:
            held.append((pa.array(pos, pa.int32()), *(pa.array(x, pa.string()).dictionary_encode() for x in (words, terms))))
            for x in (pos, words, terms):
                x.clear()

        before = 0
        for n in texts.value_lengths().to_pylist():
            cut = [(t.split(), low.split()) for t, low in (next(pairs) for _ in range(n or 0)) if t]
            if len(cut) == 1:
                pos.extend(range(len(cut[0][0])))
                words += cut[0][0]
                terms += cut[0][1]
            elif cut:
                for i, w, low in sorted(x for pair in cut for x in zip(range(len(pair[0])), *pair)):
                    pos.append(i)
                    words.append(w)
                    terms.append(low)
            ends.append(before + len(words))
            if len(words) >= HELD_WORDS:
                before = ends[-1]
                encode()
        encode()
        at, own, low = (pa.chunked_array([x[i] for x in held]).unify_dictionaries().combine_chunks() for i in range(3))
        ends = np.array(ends)
        counts = counts_of(low.dictionary, *(known.value[c].combine_chunks() for c in ("term", "count"))).take(low.indices)
        rows = [at, own.dictionary_decode(), counts, word_marks(own.dictionary).take(own.indices)]
        if only and counts.null_count:
            stays = counts.is_valid()
            ends = np.concatenate(([0], np.cumsum(stays.to_numpy(zero_copy_only=False))))[ends]
            rows = [x.filter(stays) for x in rows]
        pa.default_memory_pool().release_unused()
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(rows, WORDS.elementType.names))

    return found.asNondeterministic()  # not moved or doubled by the optimizer


def counted_texts(
    df: DataFrame, vocab: Vocabulary, least: Column, keep: list[str] = ["doc_id"], text: str = "text", placed: bool = False, carry: dict[str, Column] = {}
) -> DataFrame:
    """Words of each text in reading order: keep.., carry.., _w (pos, word, count, mark; for marks see `staying`). `placed`: df is `segment.texts_by_key`.

    Words meet the counts that can be broadcast where their text lies, text by text. Words without one are rarer than all with one, so where
    the budget `least` (of `word_budget`, the smallest asked for) holds them all, their order decides nothing and they keep a null count;
    only the words of the other texts meet the rest of the counts. Texts of one key count as one. The columns `carry` come along; Python ones among them share the worker.
    """
    short_batches(df.sparkSession)
    whole = vocab.bytes <= vocab.limit
    held = df if placed else texts_by_key(by_key(df, keep, text).withColumnRenamed(text, "text"), keep)
    lower = F.transform("_texts", lambda x: F.struct(x["text"].alias("text"), F.lower(x["text"]).alias("lower")))
    held = held.select(*keep, *[c.alias(name) for name, c in carry.items()], counting_udf(vocab.hot, whole)(lower).alias("_w")).filter(F.size("_w") > 0)
    if whole:
        return held
    unknown = F.filter("_w", lambda x: x["count"].isNull())
    open_ = (F.size(unknown) > least) | F.exists(unknown, lambda x: F.length(F.lower(x["word"])) > SMALL_CHARS)
    held = materialize(held.withColumn("_open", open_))
    rest = held.filter("_open").select(*keep, F.explode("_w").alias("w")).select(*keep, "w.pos", "w.word", "w.mark", F.lower("w.word").alias("term"))
    collected = F.sort_array(F.collect_list(F.struct("pos", "word", "count", "mark"))).alias("_w")
    rest = lookup(rest, vocab.table, "term", vocab.bytes, vocab.hot, vocab.limit).groupBy(*keep).agg(collected)
    if carry:
        rest = dedup.matched(rest, held.filter("_open").select(*keep, *carry), keep, "inner")
    return held.filter("not _open").drop("_open").unionByName(rest)


def with_kept(held: DataFrame, budget: Column) -> DataFrame:
    """Texts of `counted_texts` with words (all) and kept (ascending positions) in place of `_w`."""
    kept = staying_udf("_w.count", "_w.mark", budget, "_w.pos")
    return held.withColumn("kept", kept).withColumn("words", F.col("_w.word")).drop("_w")


def keep_texts(texts: DataFrame, keep: list[str], budget: Column) -> DataFrame:
    """Keep-rate compression of the texts of `counted_texts`: keep.., compressed, origin_words, kept_words."""
    places = F.sequence(F.lit(0), F.size("_w") - 1)  # a text has words
    held = texts.withColumn("_at", staying_udf("_w.count", "_w.mark", budget, places))
    words = F.transform("_at", lambda i: F.get("_w", i)["word"])
    return held.select(*keep, F.array_join(words, " ").alias("compressed"), F.size("_w").alias("origin_words"), F.size("_at").alias("kept_words"))


def compress(
    df: DataFrame, vocab: Vocabulary | None, rate: float | Column, keep: list[str] = ["doc_id"], text: str = "text",
    target: Column | None = None, scores: DataFrame | None = None,
) -> DataFrame:
    """Keep-rate compression of texts: keep.., compressed, origin_words, kept_words.

    `scores` (keep.., pos, score) decides in place of the corpus counts; words without one go first.
    """
    rate = F.lit(float(rate)) if isinstance(rate, (int, float)) else rate
    if scores is None:
        budget = word_budget(rate, target)
        return keep_texts(counted_texts(df, vocab, budget, keep, text), keep, budget)
    rows = join_scores(plain_words(by_key(df, keep, text), text, keep), scores, [*keep, "pos"])
    marked = mark_words(rows, keep, rate, target, HIGH_FIRST)
    held = marked.groupBy(*keep).agg(
        F.array_sort(F.collect_list(F.when(F.col("stays"), F.struct("pos", "word")))).alias("_k"),
        F.count("*").cast("int").alias("origin_words"),
    )
    return held.select(
        *keep, F.array_join(F.transform("_k", lambda x: x["word"]), " ").alias("compressed"),
        "origin_words", F.size("_k").alias("kept_words"),
    )


def compress_rates(df: DataFrame, vocab: Vocabulary, rates: list[float], keep: list[str], text: str = "text") -> DataFrame:
    """`compress` at several rates: a row per text and rate, on words that are counted once."""
    texts = counted_texts(df, vocab, word_budget(F.lit(float(min(rates)))), keep, text)
    cells = texts.withColumn("rate", F.explode(F.array(*[F.lit(float(r)) for r in rates])))
    return keep_texts(cells, [*keep, "rate"], word_budget(F.col("rate")))


# --- two methods at once ---------------------------------------------------------------------
def two_decisions(
    docs: DataFrame, vocab: Vocabulary, rate: float, size: int = CHUNK, top_k: int = TOP_K, keep: list[str] = ["doc_id"], carry: list[str] = []
) -> DataFrame:
    """Both keep-decisions of each text on one word sequence.

    docs: keep.., text, terms, carry... The result has words, kept (rate), guided (question),
    spans, n_chunks, n_kept_chunks; all arrays are aligned on the same whitespace words.
    Columns named in `carry` come along in the one shuffle of the texts.
    """
    body = F.struct(*dict.fromkeys(["text", "terms", *carry])).alias("body")
    held = texts_by_key(by_key(docs.select(*keep, body), keep, "body").select(*keep, "body.*"), keep, ["terms", *carry])
    # a null key has no question side, and nothing comes along with it
    known = reduce(Column.__and__, [F.col(k).isNotNull() for k in keep])
    asked = F.when(known, selection.span_rows(F.col("_texts"), size, top_k))
    others = F.transform("_texts", lambda x: F.struct(*[x[c].alias(c) for c in carry] or [F.lit(0)]))
    budget = word_budget(F.lit(float(rate)))
    both = with_kept(counted_texts(held, vocab, budget, keep, placed=True, carry={"_s": asked, "_c": others}), budget)
    if carry:
        both = both.filter(known).withColumn("_c", F.explode("_c")).select("*", "_c.*")
    none = F.array().cast("array<int>")
    return both.select("*", "_s.*").drop("_s", "_c").withColumns(
        {
            "guided": F.coalesce(selection.span_words(F.col("spans")), none),
            "n_chunks": F.coalesce("n_chunks", F.lit(0)),
            "n_kept_chunks": F.coalesce("n_kept_chunks", F.lit(0)),
        }
    )


def guided_is_empty(policy: str, n_spans: Column, empty_prefix: Column, n_chunks: Column) -> Column:
    """When the question side counts as empty: no spans, or by policy an empty prefix on
    a text of several chunks."""
    none = n_spans == 0
    return none if policy == "no_spans" else none | (empty_prefix & (n_chunks != 1))


def merged_text(df: DataFrame, mode: Column, empty: Column, asked: Column | None = None, failed: Column | None = None) -> DataFrame:
    """Combine the decisions of `two_decisions`; an empty or failed question side falls back to the rate side.

    Where nothing is asked the rate side stands alone, which is no fallback.
    """
    asked = F.lit(True) if asked is None else F.coalesce(asked, F.lit(False))
    empty = asked & (empty if failed is None else empty | F.coalesce(failed, F.lit(False)))
    chosen = F.when(~asked | empty, F.col("kept")).otherwise(merge.combine_positions(mode, F.col("kept"), F.col("guided")))
    return df.withColumn("fallback", empty).withColumn("merged", chosen).withColumn(
        "merged_text", merge.words_at(F.col("words"), F.col("merged"))
    )


# --- routing -----------------------------------------------------------------------------------
METHOD_RATE, METHOD_GUIDED = "llmlingua", "attentionrag"  # fixed request values


def route(df: DataFrame) -> DataFrame:
    """Add query, route and note from methods, attn_query and question."""
    names = F.transform("methods", lambda m: F.lower(tx.strip(m)))
    use_rate, use_guided = F.array_contains(names, METHOD_RATE), F.array_contains(names, METHOD_GUIDED)
    first = F.when(F.coalesce("attn_query", F.lit("")) != "", F.col("attn_query")).otherwise(
        F.coalesce("question", F.lit(""))
    )
    query = tx.strip(first)
    asked = query != ""
    return df.withColumn("query", query).withColumn(
        "route",
        F.when(use_rate & use_guided & asked, "both")
        .when(use_rate, "rate")
        .when(use_guided, "guided")
        .otherwise("none"),
    ).withColumn(
        "note",
        F.when(~use_rate & ~use_guided, "no compression").when(
            use_rate & use_guided & ~asked, "attentionrag skipped (no question)"
        ),
    )


def validation_error(
    rate: Column, mode: Column, chunk_size: Column, top_k: Column, bits: Column, max_tokens: Column
) -> Column:
    """First broken rule of a request, NULL when it is valid."""
    return (
        F.when(~((rate > 0) & (rate <= 1)), "rate")
        .when(~mode.isin(*merge.MODES), "mode")
        .when(~(chunk_size > 0), "chunk_size")
        .when(~(top_k > 0), "top_k")
        .when(~bits.between(2, 8), "bits")
        .when(~max_tokens.between(1, 2048), "max_tokens")
    )


# --- whole jobs ----------------------------------------------------------------------------------
def two_stage(
    units: DataFrame, questions: DataFrame, vocab: Vocabulary, instruction: str, rate: float, top_k: int,
    floor: float | None = None,
) -> DataFrame:
    """Rerank, keep the best `top_k` documents, compress those, assemble the prompt.

    units: req_id, unit_idx, doc_id, text, qid, score. Only survivors reach the word stage,
    and a request collects at most `top_k` of them. A request without survivors gets ' '.
    context_origin counts the words of the survivors, documents_origin those of all units, prompt_origin and
    prompt_words those of the whole prompt before and after; kept_units and kept_scores stand in the order of relevance.
    """
    chosen = selection.select_and_reorder(units, top_k, floor)
    fine = compress(chosen, vocab, rate, ["req_id", "rank", "unit_idx", "score"])
    ordered = F.array_sort(F.collect_list(F.struct("rank", "unit_idx", "score", "compressed")))
    part = lambda name: F.transform(ordered, lambda x: x[name])
    kept = fine.groupBy("req_id").agg(
        F.count("*").alias("kept_documents"), F.sum("kept_words").alias("context_kept"),
        F.sum(F.col("origin_words").cast("bigint")).alias("context_origin"),
        F.array_join(part("compressed"), "\n\n").alias("context"), part("unit_idx").alias("kept_units"), part("score").alias("kept_scores"),
    )
    whole = units.groupBy("req_id").agg(
        F.first("qid").alias("qid"), F.count("*").alias("total_documents"),
        F.sum(tx.word_count(F.col("text")).cast("bigint")).alias("documents_origin"),
    )
    rows = whole.join(kept, "req_id", "left").join(questions, "qid", "left")
    context, question = F.coalesce("context", F.lit(" ")), F.coalesce("question", F.lit(""))
    prompt_origin = F.col("documents_origin") + tx.word_count(F.lit(instruction)) + tx.word_count(question)
    rows = rows.withColumn("prompt", prompts.assemble(F.lit(instruction), context, question))
    return rows.select(
        "req_id", F.coalesce("kept_documents", F.lit(0)).alias("kept_documents"), "total_documents", "documents_origin",
        F.coalesce("context_origin", F.lit(0)).alias("context_origin"), F.coalesce("context_kept", F.lit(0)).alias("context_kept"),
        prompt_origin.cast("bigint").alias("prompt_origin"), tx.word_count(F.col("prompt")).cast("bigint").alias("prompt_words"),
        "kept_units", "kept_scores", "prompt",
    )


def question_conditioned(units: DataFrame, questions: DataFrame, corpus: DataFrame, vocab: Vocabulary, rate: float, extra: int = 100) -> DataFrame:
    """Long-context form: documents by relevance until the word budget is used up, each
    with a keep-rate that falls with its rank. The formulas follow the published method.

    The budget is `rate` of the request's words plus `extra`; the document that crosses it
    is still taken. Words stay by how much likelier the question makes them (`scores.question_contrast`), the rarer
    first of equals. Ranks are found over ids; texts come back for the documents inside the budget only. A trailing question is
    cut from the compressed text. contrast is the mean over the words of a document.

    units: doc_id, req_id, unit_idx, text, qid, score   questions: qid, terms, question
    """
    light = units.select("doc_id", "req_id", "unit_idx", "score", tx.word_count(F.col("text")).alias("n_words"))
    ranked = selection.rank_units(light)
    upto = running_sum(ranked, ["req_id"], "rank", F.col("n_words"), "upto")
    size = ranked.groupBy("req_id").agg(F.count("*").alias("n"), F.sum("n_words").alias("total"))
    inside = upto.join(size, "req_id").filter(F.col("upto") - F.col("n_words") <= rate * F.col("total") + extra)
    doc_rate = F.round(selection.dynamic_rate(F.col("rank") - 1, F.col("n"), rate), 9)
    inside = inside.select("req_id", "unit_idx", "rank", doc_rate.alias("doc_rate"))
    rows = units.join(inside, ["req_id", "unit_idx"]).select("doc_id", "req_id", "rank", "text", "doc_rate", "qid")
    keep = ["doc_id", "req_id", "rank", "doc_rate", "qid"]
    words = question_contrast(counted_words(rows, vocab, keep=keep), questions, corpus, vocab)
    words = words.withColumn("contrast", F.col("score")).withColumn("score", F.struct("contrast", -F.col("count")))
    marked = mark_words(words, keep, F.col("doc_rate"), first=HIGH_FIRST)
    held = marked.groupBy(*keep).agg(
        F.array_sort(F.collect_list(F.when(F.col("stays"), F.struct("pos", "word")))).alias("_k"), F.round(F.avg("contrast"), 6).alias("contrast")
    )
    text = F.array_join(F.transform("_k", lambda x: x["word"]), " ")
    asked = held.join(questions.select("qid", "question"), "qid", "left")
    return asked.select(
        "doc_id", "req_id", "rank", F.size("_k").alias("kept_words"), "contrast",
        tx.ends_with_question(text, F.coalesce("question", F.lit(""))).alias("compressed"),
    )


def eval_compress(
    docs: DataFrame, vocab: Vocabulary, rates: list[float], threshold: float, window: int, top_k: int
) -> DataFrame:
    """Evaluation compress of single texts under a rate x dedup grid, all cells in one plan.

    docs: doc_id, text, terms. Text or deduplicated text, cut to runs of sentences, the
    `top_k` most relevant runs in relevance order, then keep-rate compression. Retention
    is against the full text.
    """
    held = dedup.dedupe(docs, threshold).select("doc_id", "text", "terms", "deduped")
    texts = F.array(
        F.struct(F.lit(False).alias("use_dedup"), F.col("text").alias("text")),
        F.struct(F.lit(True).alias("use_dedup"), F.col("deduped").alias("text")),
    )
    arms = held.select("doc_id", "terms", tx.word_count(F.col("text")).alias("origin"), F.explode(texts).alias("a"))
    arms = arms.select("doc_id", "terms", "origin", "a.*")
    units = sentence_windows(arms, window, keep=["doc_id", "use_dedup", "terms", "origin"])
    scored = units.withColumn("score", F.get(dedup.term_relevance(F.array("body"), "terms"), F.lit(0)))
    # a text's runs are bounded by the text; the first top_k are cut before the shuffle
    best = selection.top_rows(scored, ["doc_id", "use_dedup"], [F.col("score").desc(), F.col("unit").asc()], top_k)
    ordered = F.array_sort(F.collect_list(F.struct("rank", "body")))
    chosen = best.groupBy("doc_id", "use_dedup", "origin").agg(
        F.array_join(F.transform(ordered, lambda x: x["body"]), " ").alias("text")
    )
    keep = ["doc_id", "use_dedup", "origin"]
    fine = compress_rates(chosen, vocab, rates, keep)
    retention = F.bround(F.col("kept_words") / F.greatest("origin", F.lit(1)), 3)
    return fine.select(
        "doc_id", "use_dedup", "rate", F.col("origin").alias("origin_words"), "kept_words", "compressed",
        retention.alias("retention"),
    )


def eval_compress_documents(
    units: DataFrame, vocab: Vocabulary, rates: list[float], threshold: float, top_k: int
) -> DataFrame:
    """Evaluation compress of requests of several documents, one row per kept document and cell.

    units: req_id, unit_idx, text, terms. Every document is deduplicated by itself, so that
    documents stay units; the `top_k` of highest relevance, dedup on or off, are compressed.
    Rows: req_id, use_dedup, rate, rank, unit_idx (its place in the request), score,
    dropped_sentences, kept_words, compressed. Requests may hold any number of documents:
    Spark trims every task to `top_k` rows per request before the shuffle.
    """
    held = dedup.dedupe(units, threshold, keys=["req_id", "unit_idx"])
    score = lambda c: F.get(dedup.term_relevance(F.array(c), "terms"), F.lit(0))
    texts = F.array(
        F.struct(F.lit(False).alias("use_dedup"), F.col("text").alias("text"), F.lit(0).alias("dropped_sentences")),
        F.struct(F.lit(True).alias("use_dedup"), F.col("deduped").alias("text"), F.size("dropped").alias("dropped_sentences")),
    )
    arms = held.select("req_id", "unit_idx", "terms", F.explode(texts).alias("a")).select("req_id", "unit_idx", "terms", "a.*")
    scored = arms.withColumn("score", F.coalesce(score(F.col("text")), F.lit(0.0))).drop("terms")
    best = selection.top_rows(scored, ["req_id", "use_dedup"], [F.col("score").desc(), F.col("unit_idx").asc()], top_k)
    keep = ["req_id", "use_dedup", "rank", "unit_idx", "score", "dropped_sentences"]
    cells = compress_rates(best, vocab, rates, keep)
    return cells.select("req_id", "use_dedup", "rate", *keep[2:], "kept_words", "compressed")


def eval_document_totals(kept: DataFrame, units: DataFrame) -> DataFrame:
    """One row per request and cell: words of the whole request, kept words and retention, best documents in order."""
    origin = units.groupBy("req_id").agg(F.count("*").alias("total_units"), F.sum(tx.word_count(F.col("text"))).alias("origin_words"))
    order = F.array_sort(F.collect_list(F.struct("rank", "unit_idx")))  # at most top_k
    each = kept.groupBy("req_id", "use_dedup", "rate").agg(
        F.sum("kept_words").alias("kept_words"), F.transform(order, lambda x: x["unit_idx"]).alias("kept_indices")
    )
    retention = F.bround(F.col("kept_words") / F.greatest("origin_words", F.lit(1)), 3)
    return each.join(origin, "req_id").withColumn("retention", retention)
