"""Answer scoring, fault attribution, reports, and the file sources they read."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as tx
from ..operators import dedup, evaluate as ev, merge as mg
from ..operators.windows import rank_rows
from ..session import materialize, scratch_path
from ..sources import files
from . import fixtures as fx, sqltext as q
from .compress_queries import DEDUP_CTES, DEDUP_T, recursive
from .registry import query

ARMS = ["full", "lingua", "union", "intersection"]
SENTS = (
    r"list_filter(list_transform(flatten(list_transform(string_split(text, chr(10)), lambda p: string_split(regexp_replace(trim(p, chr(9)||chr(13)||' '), "
    r"'([.!?])\s+', '\1' || chr(1), 'g'), chr(1)))), lambda s: trim(s, chr(9)||chr(13)||' ')), lambda s: s <> '')"
)


# --- fixtures: facts are the documents' own sentences, answers what survives of them -----------
def golds(spark, sf):
    """Gold aliases per document: its last sentence and the first five words of it."""
    rows = fx.docs(spark, sf).withColumn("ss", tx.split_sentences(F.col("text"))).filter(F.size("ss") > 0)
    last = F.element_at("ss", -1)
    return rows.select(
        F.col("doc_id").alias("id"), F.array(last, tx.truncate_words(last, 5)).alias("golds"),
        (F.size("ss") == 1).alias("single"),
    )


GOLDS_SQL = (
    f"SELECT doc_id AS id, ss[len(ss)] AS g1, array_to_string(regexp_extract_all(ss[len(ss)], '\\S+')[1:5], ' ') AS g2, len(ss) = 1 AS single "
    f"FROM (SELECT doc_id, {SENTS} AS ss FROM documents) WHERE len(ss) > 0"
)


def contexts(spark, sf):
    """Context of every document per arm: id, arm, context, origin, kept."""
    rows = fx.decisions(spark, sf)
    none = F.size(F.coalesce("spans", F.array())) == 0
    pos = lambda mode: F.when(none, F.col("kept")).otherwise(mg.combine_positions(F.lit(mode), F.col("kept"), F.col("guided")))
    arm = lambda name, text, n: F.struct(F.lit(name).alias("arm"), text.alias("context"), n.alias("kept_words"))
    rows = rows.withColumn("_u", pos("union")).withColumn("_i", pos("intersection"))
    cells = F.array(
        arm("full", F.array_join("words", " "), F.size("words")),
        arm("lingua", mg.words_at(F.col("words"), F.col("kept")), F.size("kept")),
        arm("union", mg.words_at(F.col("words"), F.col("_u")), F.size("_u")),
        arm("intersection", mg.words_at(F.col("words"), F.col("_i")), F.size("_i")),
    )
    each = rows.select(F.col("doc_id").alias("id"), F.size("words").alias("origin"), F.explode(cells).alias("c"))
    return each.select("id", "origin", "c.*")


CTX_DEPS = ("gdoc", "rate_kept", "rate_text", "gword", "merged", "plain")
CTX_SQL = """SELECT n.doc_id AS id, a.arm, n.origin_words AS origin, CASE a.arm WHEN 'full' THEN f.t WHEN 'lingua' THEN n.compressed ELSE m.merged_text END AS context,
    CASE a.arm WHEN 'full' THEN n.origin_words WHEN 'lingua' THEN n.kept_words ELSE m.n_kept END AS kept_words
  FROM rate_text n CROSS JOIN (SELECT unnest(['full', 'lingua', 'union', 'intersection']) AS arm) a
  JOIN (SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS t FROM plain GROUP BY 1) f USING (doc_id)
  LEFT JOIN merged m ON m.doc_id = n.doc_id AND m.mode = a.arm"""


def read_answers(held, facts):
    """Answer of a reader that repeats the fact words still in its context, or UNKNOWN; the golds stay with it."""
    fact = tx.split_words(F.get("golds", F.lit(0)))
    left = F.array_join(ev.words_held(fact, F.split("context", " ")), " ")
    return held.join(facts, "id").withColumn("answer", F.when(left != "", left).otherwise("UNKNOWN"))


def answers(spark, sf):
    return read_answers(contexts(spark, sf), golds(spark, sf))


ANS_SQL = r"""SELECT id, arm, context, origin, kept_words, g1, g2, single, CASE WHEN len(l) > 0 THEN array_to_string(l, ' ') ELSE 'UNKNOWN' END AS answer FROM (
    SELECT c.*, g.g1, g.g2, g.single, list_filter(regexp_extract_all(g.g1, '\S+'), lambda w: list_contains(string_split(c.context, ' '), w)) AS l FROM ctx c JOIN gold g USING (id))"""


def f1_sql(p: str, g: str) -> str:
    same = f"list_sum(list_transform(list_distinct({p}), lambda t: least(len(list_filter({p}, lambda x: x = t)), len(list_filter({g}, lambda x: x = t)))))"
    return (
        f"CASE WHEN len({p}) = 0 OR len({g}) = 0 THEN CASE WHEN len({p}) = len({g}) THEN 1.0 ELSE 0.0 END "
        f"WHEN coalesce({same}, 0) = 0 THEN 0.0 ELSE 2.0 * {same} / len({p}) * {same} / len({g}) / ({same} / len({p}) + {same} / len({g})) END"
    )


SCORED_SQL = f"""SELECT *, greatest({f1_sql('pt', 'gt1')}, {f1_sql('pt', 'gt2')}) AS f1, array_to_string(pt, ' ') IN (array_to_string(gt1, ' '), array_to_string(gt2, ' ')) AS em
  FROM (SELECT *, {q.norm_list('answer')} AS pt, {q.norm_list('g1')} AS gt1, {q.norm_list('g2')} AS gt2 FROM ans)"""
ALL = dict(gold=GOLDS_SQL, ctx=CTX_SQL, ans=ANS_SQL, scored_ans=SCORED_SQL)


def scored(spark, sf):
    return ev.score_rows(answers(spark, sf))


@query(
    "a1_bag_overlap",
    q.sql(
        "SELECT id, arm, coalesce(list_sum(list_transform(list_distinct(pt), lambda t: least(len(list_filter(pt, lambda x: x = t)), len(list_filter(gt1, lambda x: x = t))))), 0) AS same FROM scored_ans",
        *CTX_DEPS, **ALL,
    ),
)
def a1(spark, sf):
    held = answers(spark, sf)
    same = ev.let(ev.answer_tokens(F.col("answer")), lambda p: ev.bag_overlap(p, ev.answer_tokens(F.get("golds", F.lit(0)))))
    return held.select("id", "arm", same.alias("same"))


@query("a2_token_f1", q.sql(f"SELECT id, arm, round({f1_sql('pt', 'gt1')}, 6) AS f1 FROM scored_ans", *CTX_DEPS, **ALL))
def a2(spark, sf):
    held = answers(spark, sf)
    return held.select("id", "arm", F.round(ev.best_f1(F.col("answer"), F.slice("golds", 1, 1)), 6).alias("f1"))


@query("a3_best_f1", q.sql("SELECT id, arm, round(f1, 6) AS f1 FROM scored_ans", *CTX_DEPS, **ALL))
def a3(spark, sf):
    return scored(spark, sf).select("id", "arm", F.round("f1", 6).alias("f1"))


@query("a4_exact_match", q.sql("SELECT id, arm, em FROM scored_ans", *CTX_DEPS, **ALL))
def a4(spark, sf):
    return scored(spark, sf).select("id", "arm", "em")


@query("j1_answers_golds", q.sql("SELECT a.id, a.arm, g.g1 AS gold FROM (SELECT id, arm FROM ans UNION ALL SELECT -1, 'full') a JOIN gold g USING (id)", *CTX_DEPS, **ALL))
def j1(spark, sf):
    stray = spark.range(1).select(F.lit(-1).cast("bigint").alias("id"), F.lit("full").alias("arm"))
    rows = answers(spark, sf).select("id", "arm").unionByName(stray)
    return rows.join(golds(spark, sf), "id").select("id", "arm", F.get("golds", F.lit(0)).alias("gold"))


SUM_COLS = "round(avg(f1), 6) AS mean_f1, count(*) FILTER (em) AS em, count(*) FILTER (f1 >= 0.5) AS correct, count(*) AS total"


@query("a5_arm_summary", q.sql(f"SELECT arm, {SUM_COLS} FROM scored_ans GROUP BY 1", *CTX_DEPS, **ALL))
def a5(spark, sf):
    return ev.summarize(scored(spark, sf))


@query("a6_single_mention", q.sql(f"SELECT arm, {SUM_COLS}, count(*) FILTER (single AND f1 >= 0.5) AS single_correct, count(*) FILTER (single) AS single_total FROM scored_ans GROUP BY 1", *CTX_DEPS, **ALL))
def a6(spark, sf):
    return ev.summarize(scored(spark, sf), single="single")


@query("a7_null_skipping_mean", "SELECT event_type, round(avg(CASE WHEN event_type <> 'view' AND event_id % 3 > 0 THEN value END), 6) AS mean FROM events GROUP BY 1")
def a7(spark, sf):
    v = F.when((F.col("event_type") != "view") & (F.col("event_id") % 3 > 0), F.col("value"))
    return fx.table(spark, sf, "events").groupBy("event_type").agg(F.round(F.avg(v), 6).alias("mean"))


RET_SQL = "SELECT arm, round(avg(kept_words / origin), 6) AS retention, round(1 / avg(kept_words / origin), 6) AS factor FROM ctx WHERE arm <> 'full' GROUP BY 1"


def retentions(spark, sf):
    rows = contexts(spark, sf).filter("origin > 0").select("arm", (F.col("kept_words") / F.col("origin")).alias("retention"))
    return ev.mean_retention(rows)


@query("a8_mean_retention", q.sql(RET_SQL, *CTX_DEPS, ctx=CTX_SQL))
def a8(spark, sf):
    return retentions(spark, sf)


def recall_sql(text: str) -> str:
    held = q.norm_list(text)
    one = lambda g: f"coalesce(len(list_filter({g}, lambda t: list_contains(cx, t))) / nullif(len({g}), 0), 0)"
    return f"(SELECT greatest({one('gt1')}, {one('gt2')}) FROM (SELECT {held} AS cx))"


RECALL_SQL = f"SELECT id, arm, f1, greatest(coalesce(len(list_filter(gt1, lambda t: list_contains(cx, t))) / nullif(len(gt1), 0), 0), coalesce(len(list_filter(gt2, lambda t: list_contains(cx, t))) / nullif(len(gt2), 0), 0)) AS recall, gt1, gt2 FROM (SELECT *, {q.norm_list('context')} AS cx FROM scored_ans)"


@query("a10_gold_recall", q.sql("SELECT id, arm, round(recall, 6) AS recall FROM rc", *CTX_DEPS, **ALL, rc=RECALL_SQL))
def a10(spark, sf):
    held = answers(spark, sf)
    return held.select("id", "arm", F.round(ev.gold_recall(F.col("golds"), F.col("context")), 6).alias("recall"))


@query("j13_surviving_tokens", q.sql(f"SELECT id, arm, len(list_filter(gt1, lambda t: list_contains(cx, t))) AS survived, len(gt1) AS tokens FROM (SELECT *, {q.norm_list('context')} AS cx FROM scored_ans)", *CTX_DEPS, **ALL))
def j13(spark, sf):
    held = answers(spark, sf)
    gold = ev.answer_tokens(F.get("golds", F.lit(0)))
    rows = held.select("id", "arm", ev.let(gold, lambda g: F.struct(ev.count_held(g, ev.answer_tokens(F.col("context"))).alias("survived"), F.size(g).alias("tokens"))).alias("n"))
    return rows.select("id", "arm", "n.*")


def dedup_arm(spark, sf):
    """The arm that ran sentence dedup: its context and the text it dropped."""
    rows = dedup.dedupe(fx.asked(spark, sf), DEDUP_T)
    text = F.array_join(F.transform("dropped", lambda d: d["sentence"]), " ")
    return rows.select(F.col("doc_id").alias("id"), F.lit("dedup").alias("arm"), F.col("deduped").alias("context"), text.alias("dropped_text"))


def faults(spark, sf):
    every = contexts(spark, sf).unionByName(dedup_arm(spark, sf), allowMissingColumns=True)
    held = ev.score_rows(read_answers(every, golds(spark, sf)))
    why = ev.fault(F.col("correct"), F.col("golds"), F.col("context"), F.col("dropped_text"))
    return held.select("id", "arm", why.alias("fault"))


FAULT_CTES = dict(
    DEDUP_CTES, **(ALL | dict(ctx=CTX_SQL + " UNION ALL SELECT doc_id, 'dedup', NULL, text, NULL FROM dtext")), rc=RECALL_SQL,
    drp=f"""SELECT f.doc_id AS id, {q.norm_list("coalesce(string_agg(s.sentence, ' ' ORDER BY s.idx) FILTER (NOT list_contains(f.kept, s.idx)), '')")} AS dx FROM fin f JOIN sent s USING (doc_id) GROUP BY 1""",
    flt="""SELECT r.id, r.arm, CASE WHEN f1 >= 0.5 THEN '' WHEN recall >= 0.6 THEN 'READER_ERROR'
             WHEN r.arm = 'dedup' AND greatest(coalesce(len(list_filter(gt1, lambda t: list_contains(dx, t))) / nullif(len(gt1), 0), 0), coalesce(len(list_filter(gt2, lambda t: list_contains(dx, t))) / nullif(len(gt2), 0), 0)) >= 0.6
             THEN 'MMR_OVERPRUNED' ELSE 'INFO_LOST_IN_COMPRESSION' END AS fault FROM rc r JOIN drp USING (id)""",
)


@query("a11_fault_attribution", recursive(q.sql("SELECT * FROM flt", *CTX_DEPS, "asked", **FAULT_CTES)))
def a11(spark, sf):
    return faults(spark, sf)


@query("a12_fault_tally", recursive(q.sql("SELECT arm, fault, count(*) AS n FROM flt WHERE fault <> '' GROUP BY ALL", *CTX_DEPS, "asked", **FAULT_CTES)))
def a12(spark, sf):
    return faults(spark, sf).filter("fault <> ''").groupBy("arm", "fault").agg(F.count("*").alias("n"))


@query("a13_task_breakdown", "SELECT lang AS task, count(*) AS n FROM documents GROUP BY 1")
def a13(spark, sf):
    return fx.table(spark, sf, "documents").groupBy(F.col("lang").alias("task")).agg(F.count("*").alias("n"))


# --- model arms: numbers a reader reports, derived from the word counts ---------------------------
def model_answers(spark, sf):
    """Answers of all seven arms with the reader's optional numbers; vanilla_llm reads the full text."""
    # the full text serves three arms: they fan out in the row, after the scoring
    readers = F.array(F.lit("vanilla_llm"), F.lit("llm_tq"), F.lit("vanilla_lclm"))
    every = scored(spark, sf).withColumn("arm", F.explode(F.when(F.col("arm") == "full", readers).otherwise(F.array("arm"))))
    coded = F.col("arm") == "llm_tq"
    latent = F.col("arm") == "vanilla_lclm"
    return every.select(
        "id", "arm", "f1", "em", "correct", "origin", "kept_words",
        F.when(coded & (F.col("id") % 5 > 0), 3.5 + F.col("origin") % 10 / 20.0).alias("kv_compression_x"),
        F.when(coded, 4.0).alias("eff_bits"),
        F.when(latent, F.col("origin")).alias("input_tokens"),
        F.when(latent, F.floor(F.col("origin") / 16)).alias("latent_tokens"),
    )


MODEL_SQL = """SELECT id, arm, f1, em, f1 >= 0.5 AS correct, CASE WHEN arm = 'llm_tq' AND id % 5 > 0 THEN (3.5 + origin % 10 / 20.0)::DOUBLE END AS kvx, CASE WHEN arm = 'llm_tq' THEN 4.0::DOUBLE END AS bits,
    CASE WHEN arm = 'vanilla_lclm' AND origin // 16 > 0 THEN origin / (origin // 16) END AS seqx FROM (
      SELECT id, CASE arm WHEN 'full' THEN 'vanilla_llm' ELSE arm END AS arm, f1, em, origin FROM scored_ans
      UNION ALL SELECT id, unnest(['llm_tq', 'vanilla_lclm']), f1, em, origin FROM scored_ans WHERE arm = 'full')"""
CELL_SQL = """SELECT m.arm, CASE WHEN r.retention IS NOT NULL THEN printf('%.1f%%', r.retention * 100) || printf(' kept (%.2fx)', 1 / r.retention) WHEN m.arm = 'vanilla_llm' THEN '1.00x (baseline)'
      WHEN concat_ws(' / ', kv, sq) = '' THEN '—' ELSE concat_ws(' / ', kv, sq) END AS compression,
    CASE WHEN r.retention IS NOT NULL THEN '' WHEN m.arm = 'vanilla_llm' THEN 'full fp16 KV' ELSE coalesce(b, '') END AS notes
  FROM (SELECT arm, CASE WHEN avg(kvx) IS NOT NULL THEN printf('%.2fx KV', avg(kvx)) END AS kv, CASE WHEN avg(seqx) IS NOT NULL THEN printf('%.2fx seq', avg(seqx)) END AS sq,
      CASE WHEN avg(bits) IS NOT NULL THEN printf('%.2f eff_bits', avg(bits)) END AS b FROM mods GROUP BY 1) m LEFT JOIN ret r USING (arm)"""
REPORT = dict(ALL, ret=RET_SQL, mods=MODEL_SQL, cells=CELL_SQL)


@query("a9_compression_cell", q.sql("SELECT * FROM cells", *CTX_DEPS, **REPORT))
def a9(spark, sf):
    return ev.compression_cells(*report_rows(spark, sf))


@query("q9_sequence_factor", q.sql("SELECT arm, round(avg(seqx), 6) AS seqx, count(seqx) AS n FROM mods WHERE arm = 'vanilla_lclm' GROUP BY 1", *CTX_DEPS, **REPORT))
def q9(spark, sf):
    rows = model_answers(spark, sf).filter("arm = 'vanilla_lclm' and latent_tokens > 0 and input_tokens > 0")
    ratio = F.col("input_tokens") / F.col("latent_tokens")
    return rows.groupBy("arm").agg(F.round(F.avg(ratio), 6).alias("seqx"), F.count("*").alias("n"))


def report_rows(spark, sf):
    """Scored answers, written once, and the retention of the token arms taken from them."""
    rows = materialize(model_answers(spark, sf))
    share = rows.filter("origin > 0").select("arm", (F.col("kept_words") / F.col("origin")).alias("retention"))
    return rows, ev.mean_retention(share)


ARM_ORDER = "(VALUES (0, 'lingua'), (1, 'union'), (2, 'intersection'), (3, 'vanilla_llm'), (4, 'llm_tq'), (5, 'vanilla_lclm'), (6, 'lclm_tq')) o(ord, arm)"


@query(
    "s14_report",
    q.sql(
        f"""SELECT ord, arm, printf('| %s | %.3f | %d/%d | %d/%d | %s | %s |', arm, f, em, n, c, n, compression, notes) AS line FROM {ARM_ORDER} JOIN (
              SELECT arm, round(avg(f1), 6) AS f, count(*) FILTER (em) AS em, count(*) FILTER (correct) AS c, count(*) AS n FROM mods GROUP BY 1) USING (arm) JOIN cells USING (arm)""",
        *CTX_DEPS, **REPORT,
    ),
)
def s14(spark, sf):
    rows, kept = report_rows(spark, sf)
    return ev.report(ev.summarize(rows), ev.compression_cells(rows, kept))


@query("c19_scored_evaluation", q.sql(f"SELECT arm, {SUM_COLS.replace('f1 >= 0.5', 'correct')}, c.compression, c.notes FROM mods JOIN cells c USING (arm) GROUP BY arm, c.compression, c.notes", *CTX_DEPS, **REPORT))
def c19(spark, sf):
    rows, kept = report_rows(spark, sf)
    return ev.summarize(rows).join(ev.compression_cells(rows, kept), "arm")


@query("u4_missing_arms", q.sql(f"SELECT ord, arm FROM {ARM_ORDER} WHERE arm NOT IN (SELECT arm FROM mods)", *CTX_DEPS, **REPORT))
def u4(spark, sf):
    return ev.missing_arms(model_answers(spark, sf))


@query("u5_union_of_groups", q.sql("SELECT id, arm, CASE WHEN arm = 'llm_tq' THEN bits END AS eff_bits, CASE WHEN arm = 'vanilla_lclm' THEN origin END AS latent FROM (SELECT m.*, s.origin FROM mods m JOIN (SELECT id, origin FROM scored_ans WHERE arm = 'full') s USING (id)) WHERE arm IN ('llm_tq', 'vanilla_lclm')", *CTX_DEPS, **REPORT))
def u5(spark, sf):
    rows, _ = report_rows(spark, sf)
    a = rows.filter("arm = 'llm_tq'").select("id", "arm", "eff_bits")
    b = rows.filter("arm = 'vanilla_lclm'").select("id", "arm", F.col("input_tokens").alias("latent"))
    return a.unionByName(b, allowMissingColumns=True)


# --- work lists ---------------------------------------------------------------------------------------
@query("j3_work_list", "SELECT doc_id, arm FROM documents, (SELECT unnest(['lingua', 'union', 'intersection']) AS arm) WHERE NOT (arm = 'union' AND doc_id % 4 = 0)")
def j3(spark, sf):
    rows = ev.work_list(fx.docs(spark, sf).select("doc_id"), ev.TOKEN_ARMS)
    missing = (F.col("arm") == "union") & (F.col("doc_id") % 4 == 0)
    return rows.withColumn("prompt", F.when(~missing, "x")).filter("prompt is not null").select("doc_id", "arm")


@query("j4_grid", "SELECT doc_id, rate, use_dedup FROM documents, (SELECT unnest([0.75, 0.5])::DOUBLE AS rate), (SELECT unnest([false, true]) AS use_dedup)")
def j4(spark, sf):
    return ev.grid(fx.docs(spark, sf).select("doc_id"), [0.75, 0.5])


@query(
    "j2_missing_questions",
    "SELECT doc_id, l.doc_id IS NULL AS missing FROM documents d LEFT JOIN labels l USING (doc_id)".replace("SELECT doc_id, l.doc_id IS NULL", "SELECT d.doc_id, l.doc_id IS NULL"),
)
def j2(spark, sf):
    rows = fx.docs(spark, sf).select("doc_id")
    known = fx.table(spark, sf, "labels").select("doc_id")
    found = rows.join(known, "doc_id").withColumn("missing", F.lit(False))
    return found.unionByName(rows.join(known, "doc_id", "left_anti").withColumn("missing", F.lit(True)))


@query("w6_first_per_task", "SELECT source AS task, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rk FROM documents) WHERE rk <= 10")
def w6(spark, sf):
    rows = fx.table(spark, sf, "documents").select(F.col("source").alias("task"), "doc_id")
    return files.first_per_task(rows, 10, [F.col("doc_id")]).select("task", "doc_id")


@query("w8_last_record_wins", "SELECT user_id, event_type, arg_max(value, event_id) AS value, max(event_id) AS event_id FROM events GROUP BY ALL")
def w8(spark, sf):
    rows = fx.table(spark, sf, "events").select("user_id", "event_type", "event_id", "value")
    held = rows.withColumn("pos", F.col("event_id"))
    return ev.latest(held, ["user_id", "event_type"], ["pos"]).select("user_id", "event_type", "value", "event_id")


@query("l5_input_order", "SELECT doc_id, row_number() OVER (ORDER BY source, doc_id DESC) - 1 AS ord, length(text) AS size FROM documents")
def l5(spark, sf):
    # the input order is by source, newest first; the ordinal carried through the shuffled work restores it
    rows = rank_rows(fx.texts(spark, sf).withColumn("list", F.lit(0)), ["list"], [F.col("source"), F.col("doc_id").desc()])
    worked = rows.repartition(F.hash("doc_id")).select("doc_id", (F.col("rank") - 1).alias("ord"), F.length("text").cast("long").alias("size"))
    return worked.orderBy("ord")


# --- files -----------------------------------------------------------------------------------------------
EXAMPLE_TYPE = "array<struct<id:string,task:string,context:string,question:string,answers:array<string>>>"
PER_FILE = 128


def example_files(spark, sf):
    """Writes {config, examples} objects of at most PER_FILE documents, one object per file."""
    path = scratch_path(spark, "examples")
    ex = F.struct(
        F.concat(F.col("lang"), F.lit("-"), F.col("doc_id").cast("string")).alias("id"), F.col("lang").alias("task"),
        F.col("text").alias("context"), F.concat(F.lit("q"), F.col("doc_id").cast("string")).alias("question"),
        F.array(F.col("source")).alias("answers"),
    )
    rows = fx.table(spark, sf, "documents").groupBy(F.floor(F.col("doc_id") / PER_FILE).alias("b")).agg(F.collect_list(ex).alias("examples"))
    config = F.struct(F.lit("given").alias("source"), F.array(F.lit("en")).alias("tasks"), F.lit(10).alias("n_per_task"), F.lit(2500).alias("max_context_words"))
    rows.select(config.alias("config"), "examples").write.option("maxRecordsPerFile", 1).json(path)
    return path


@query("s1_examples_scan", f"SELECT lang || '-' || doc_id AS id, lang AS task, 'q' || doc_id AS question, source AS answer, 2500 AS max_context_words, {q.wc('text')} AS n_words FROM documents")
def s1(spark, sf):
    rows = files.read_examples(spark, example_files(spark, sf))
    return rows.select("id", "task", "question", F.get("answers", F.lit(0)).alias("answer"), "config.max_context_words", tx.word_count(F.col("context")).alias("n_words"))


def answer_files(spark, sf):
    """Answer files from the events: groups a and b repeat some ids, one damaged file, records without an arm."""
    path = scratch_path(spark, "answers")
    ev_rows = fx.table(spark, sf, "events")
    arm = F.when(F.col("event_type") == "error", F.lit(None)).otherwise(F.col("event_type"))
    rec = F.struct(
        F.col("user_id").cast("string").alias("id"), arm.alias("arm"), F.col("value").cast("string").alias("answer"),
        F.struct(F.col("value").alias("kv_compression_x")).alias("extra"),
    )
    for name, lo in (("a", 0), ("b", 1)):
        part = ev_rows.filter(F.col("event_id") % 2 == lo)
        docs_ = part.groupBy(F.floor(F.col("event_id") / 1000).alias("blk")).agg(F.array_sort(F.collect_list(F.struct("event_id", rec.alias("r")))).alias("x"))
        docs_.select("blk", F.lit(name).alias("arm_group"), F.transform("x", lambda v: v["r"]).alias("answers")).write.partitionBy("blk").option("maxRecordsPerFile", 1).json(f"{path}/group={name}")
    spark.range(1).select(F.lit("{not json").alias("value")).write.text(f"{path}/group=z/blk=0")
    return path


@query("s2_answers_scan", """SELECT user_id::VARCHAR AS id, event_type AS arm, round(arg_max(value, (event_id % 2, (event_id // 1000)::VARCHAR, event_id)), 6) AS kvx FROM events WHERE event_type <> 'error' GROUP BY ALL""")
def s2(spark, sf):
    rows = files.read_answers(spark, f"{answer_files(spark, sf)}/*/*")
    return rows.select("id", "arm", F.round("extra.kv_compression_x", 6).alias("kvx"))


@query(
    "s3_arms_scan",
    q.sql("SELECT id::VARCHAR AS id, arm, origin AS origin_tokens, kept_words AS compressed_tokens, round(kept_words / origin, 6) AS retention FROM ctx WHERE arm <> 'full' AND NOT (arm = 'union' AND id % 5 = 0)", *CTX_DEPS, ctx=CTX_SQL),
)
def s3(spark, sf):
    path = scratch_path(spark, "arms")
    rows = contexts(spark, sf)
    info = F.struct(
        F.col("context").alias("prompt"), F.col("origin").cast("bigint").alias("origin_tokens"), F.col("kept_words").cast("bigint").alias("compressed_tokens"),
        F.when(~((F.col("arm") == "union") & (F.col("id") % 5 == 0)), F.col("kept_words") / F.col("origin")).alias("retention"),
    )
    # the arms of one example: four entries
    per = rows.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("arm", info))).alias("arms"))
    objs = per.select(F.array(F.struct(F.col("id").cast("string").alias("id"), "arms")).alias("examples"))
    objs.write.json(path)
    return files.read_arms(spark, path, multi_line=False).select("id", "arm", "origin_tokens", "compressed_tokens", F.round("retention", 6).alias("retention"))


@query("s4_task_lines", "SELECT 'docs-' || line AS id, question, answer FROM (SELECT doc_id AS line, 'q' || doc_id AS question, source AS answer FROM documents)")
def s4(spark, sf):
    path = scratch_path(spark, "tasks")
    fx.table(spark, sf, "documents").select(
        F.concat(F.lit("q"), F.col("doc_id").cast("string")).alias("input"), F.col("text").alias("context"),
        F.array("source").alias("answers"), F.col("doc_id").alias("line"),
    ).write.json(path)
    rows = files.read_task_lines(spark, path, "docs", head=None)
    return rows.select("id", "question", F.get("answers", F.lit(0)).alias("answer"))


@query("s5_fallback_chain", "SELECT lang AS task, count(*) AS n FROM documents GROUP BY 1")
def s5(spark, sf):
    empty = lambda: fx.table(spark, sf, "documents").filter("doc_id < 0")
    chosen = files.first_available([lambda: spark.read.parquet(f"{sf}/absent.parquet"), empty, lambda: fx.table(spark, sf, "documents")])
    return chosen.groupBy(F.col("lang").alias("task")).agg(F.count("*").alias("n"))


@query("s6_nested_sentences", rf"SELECT doc_id::VARCHAR AS id, array_to_string({SENTS}, ' ') AS context FROM documents")
def s6(spark, sf):
    path = scratch_path(spark, "paragraphs")
    lines = F.transform(F.split("text", "\n"), lambda p: tx.split_sentences(p))
    fx.table(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("id"), F.col("lang").alias("question"), F.col("source").alias("answer"),
        F.struct(lines.alias("sentences")).alias("context"),
    ).write.json(path)
    return files.read_paragraphs(spark, path).select("id", "context")


@query("s7_answer_arrays", "SELECT item_id::VARCHAR AS id, text AS a1, 'x' AS a2 FROM benchmark")
def s7(spark, sf):
    path = scratch_path(spark, "squad")
    fx.table(spark, sf, "benchmark").select(
        F.col("item_id").cast("string").alias("id"), F.lit("q").alias("question"), F.col("text").alias("context"),
        F.struct(F.array("text", F.lit("x")).alias("text")).alias("answers"),
    ).write.json(path)
    return files.read_squad(spark, path).select("id", F.get("answers", F.lit(0)).alias("a1"), F.get("answers", F.lit(1)).alias("a2"))


@query("s11_whole_files", rf"SELECT page_id, trim(html, chr(9)||chr(10)||chr(13)||' ') AS text FROM pages")
def s11(spark, sf):
    path = scratch_path(spark, "pages")
    pages = fx.table(spark, sf, "pages")
    pages.select("page_id", F.concat(F.lit(" \n"), "html", F.lit("\n\n")).alias("value")).write.partitionBy("page_id").text(path)
    good, _ = files.read_texts(spark, f"{path}/*")
    return good.select(F.regexp_extract("file", "page_id=([0-9]+)", 1).cast("bigint").alias("page_id"), "text")


@query("s12_result_sink", q.sql("SELECT doc_id, kept_words, '0.5' AS rate FROM rate_text", "rate_text"))
def s12(spark, sf):
    from ..operators import compress as cp, scores as sc

    path = scratch_path(spark, "results")
    rows = cp.compress(fx.docs(spark, sf), sc.vocabulary(fx.docs(spark, sf)), 0.5).select("doc_id", "kept_words")
    files.write_results(rows, path, {"rate": "0.5"})
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("kept_words", T.IntegerType())])
    back, config = files.read_results(spark, path, schema=schema)
    return back.withColumn("rate", config.select("rate").scalar())
