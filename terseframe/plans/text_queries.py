"""Segmentation and scalar functions over the documents (T1-T20, W3-W5)."""

from pyspark.sql import functions as F

from ..functions import prompts, tables, text as tx
from ..operators import account, compress as cp, segment as sg, selection as sel
from . import fixtures as fx, sqltext as q
from .registry import query

BLANKS = "chr(9)||chr(10)||chr(13)||' '"


@query(
    "t1_split_sentences",
    r"""SELECT doc_id, idx, sentence FROM (SELECT doc_id, unnest(ss) AS sentence, generate_subscripts(ss, 1) - 1 AS idx FROM (
          SELECT doc_id, list_filter(list_transform(flatten(list_transform(string_split(text, chr(10)),
            lambda p: string_split(regexp_replace(trim(p, chr(9)||chr(13)||' '), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)))),
            lambda s: trim(s, chr(9)||chr(13)||' ')), lambda s: s <> '') AS ss FROM documents))""",
)
def t1(spark, sf):
    return sg.split_sentence_rows(fx.docs(spark, sf))


@query("t2_sentence_spans", q.sql('SELECT doc_id, idx, sentence, s::INT AS start, e::INT AS "end" FROM (' + q.tiles("documents", "doc_id", q.SENT, "sentence").replace("pos, w AS", "pos AS idx, w AS", 1) + ")"))
def t2(spark, sf):
    return sg.sentence_rows(fx.docs(spark, sf))


@query(
    "f3_span_functions",
    "SELECT s.doc_id, n_sentences, sentence_chars, n_words, word_ends FROM (SELECT doc_id, count(*) AS n_sentences, sum(e - s)::BIGINT AS sentence_chars FROM ("
    + q.tiles("documents", "doc_id", q.SENT, "sentence") + ") GROUP BY 1) s JOIN (SELECT doc_id, count(*) AS n_words, sum(e)::BIGINT AS word_ends FROM ("
    + q.tiles("documents", "doc_id", r"\s*\S+", "word") + ") GROUP BY 1) w USING (doc_id)",
)
def f3(spark, sf):
    """Both span functions called from SQL."""
    tables.register(spark)
    return spark.sql(
        """SELECT doc_id, n_sentences, sentence_chars, n_words, word_ends FROM (
             SELECT doc_id, count(*) AS n_sentences, sum(s.end - s.start) AS sentence_chars FROM {docs} d, LATERAL sentence_spans(d.text) s GROUP BY doc_id
           ) JOIN (SELECT doc_id, count(*) AS n_words, sum(w.end) AS word_ends FROM {docs} d, LATERAL word_spans(d.text) w GROUP BY doc_id) USING (doc_id)""",
        docs=fx.docs(spark, sf),
    )


@query("t3_word_spans", q.sql('SELECT doc_id, pos, word, s::INT AS start, e::INT AS "end" FROM words', "words"))
def t3(spark, sf):
    return sg.words(fx.docs(spark, sf))


@query("t3_page_tokens", r"SELECT page_id, len(regexp_extract_all(html, '\S+')) AS n_words, len(regexp_extract_all(html, '\S+')) - len(list_distinct(regexp_extract_all(html, '\S+'))) AS repeated FROM pages")
def t3_pages(spark, sf):
    words = tx.split_words(F.col("html"))
    pages = fx.table(spark, sf, "pages").select("page_id", words.alias("w"))
    return pages.select("page_id", F.size("w").alias("n_words"), (F.size("w") - F.size(F.array_distinct("w"))).alias("repeated"))


@query("t4_word_count", f"SELECT doc_id, {q.wc('text')} AS n_words FROM documents UNION ALL SELECT -1, 0")
def t4(spark, sf):
    rows = fx.docs(spark, sf).select("doc_id", tx.word_count(F.col("text")).alias("n_words"))
    # a NULL text counts zero words
    absent = fx.docs(spark, sf).agg(F.lit(-1).cast("bigint").alias("doc_id"), tx.word_count(F.lit(None).cast("string")).alias("n_words"))
    return rows.unionByName(absent)


@query(
    "t5_truncate_words",
    r"""SELECT doc_id, n, array_to_string(regexp_extract_all(text, '\S+')[1:n], ' ') AS cut, len(regexp_extract_all(text, '\S+')) > n AS was_cut
        FROM documents CROSS JOIN (SELECT unnest([2500, 2000]) AS n)""",
)
def t5(spark, sf):
    rows = fx.docs(spark, sf).withColumn("n", F.explode(F.array(F.lit(2500), F.lit(2000))))
    ws = tx.split_words(F.col("text"))
    cut = F.when(F.col("n") == 2500, tx.truncate_words(F.col("text"), 2500)).otherwise(tx.truncate_words(F.col("text"), 2000))
    return rows.select("doc_id", "n", cut.alias("cut"), (F.size(ws) > F.col("n")).alias("was_cut"))


@query("t6_normalize_answer", f"SELECT doc_id, {q.norm('text')} AS normalized FROM documents")
def t6(spark, sf):
    return fx.docs(spark, sf).select("doc_id", tx.normalize_answer(F.col("text")).alias("normalized"))


@query("t7_normalize_loose", r"SELECT doc_id, trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9\s]', '', 'g'), '\s+', ' ', 'g')) AS normalized FROM documents")
def t7(spark, sf):
    return fx.docs(spark, sf).select("doc_id", tx.normalize_loose(F.col("text")).alias("normalized"))


FILLER_SQL = ", ".join(f"'{w}'" for w in tx.FILLERS)


@query(
    "t8_strip_fillers",
    rf"""SELECT doc_id, trim(regexp_replace(regexp_replace(array_to_string(list_filter(
           regexp_extract_all(text, '\s+|[.,!?;:]|[^\s.,!?;:]+'), lambda t: regexp_matches(t, '^[0-9]') OR lower(t) NOT IN ({FILLER_SQL})), ''),
           '\s{{2,}}', ' ', 'g'), '\s+([.,!?;:])', '\1', 'g'), {BLANKS}) AS stripped FROM documents""",
)
def t8(spark, sf):
    return fx.docs(spark, sf).select("doc_id", tx.strip_fillers(F.col("text")).alias("stripped"))


RAW_LABEL = (
    "CASE event_id % 9 WHEN 0 THEN '1' WHEN 1 THEN ' true ' WHEN 2 THEN 'True' WHEN 3 THEN 'TRUE' "
    "WHEN 4 THEN cast(value AS {s}) WHEN 5 THEN ' 0.5 ' WHEN 6 THEN 'x1' WHEN 7 THEN '.51' ELSE '1.0' END"
)
NUM_SQL = r"CASE WHEN regexp_matches(trim(r), '^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$') THEN try_cast(trim(r) AS DOUBLE) END"


@query(
    "t9_coerce_label",
    f"SELECT event_id, CASE WHEN trim(r) IN ('true', 'True') THEN 1 WHEN {NUM_SQL} > 0.5 THEN 1 ELSE 0 END AS keep "
    f"FROM (SELECT event_id, {RAW_LABEL.format(s='VARCHAR')} AS r FROM events)",
)
def t9(spark, sf):
    rows = fx.table(spark, sf, "events").select("event_id", F.expr(RAW_LABEL.format(s="STRING")).alias("r"))
    return rows.select("event_id", tx.coerce_label(F.col("r")).alias("keep"))


LABEL_TEXT = (
    "array_to_string(list_transform(regexp_extract_all(text, '\\S+'), lambda w, i: CASE (i - 1) % 3 WHEN 0 THEN w || ' 1' "
    "WHEN 1 THEN w || ' 0' ELSE w || ',1' END), chr(9)||chr(9)||'|'||chr(9)||chr(9))"
)


def label_text(words):
    """Label string of the word classifier: '<word> <label>' items, some in comma form."""
    item = lambda w, i: F.when(i % 3 == 0, F.concat(w, F.lit(" 1"))).when(i % 3 == 1, F.concat(w, F.lit(" 0"))).otherwise(F.concat(w, F.lit(",1")))
    return F.array_join(F.transform(words, item), "\t\t|\t\t")


@query(
    "t10_parse_labels",
    rf"""SELECT doc_id, len(ls) AS n_labels, coalesce(array_to_string(list_transform(ls, lambda x: x[1] || ':' || x[2]), ' '), '') AS labels FROM (
          SELECT doc_id, list_transform(list_filter(list_transform(CASE WHEN contains(s, '|') THEN string_split_regex(s, '\s*\|\s*') ELSE regexp_extract_all(s, '\S+') END, lambda p: trim(p, {BLANKS})), lambda p: p <> ''),
            lambda p: CASE
              WHEN regexp_matches(p, '(?s)^.*\S\s+[01]$') THEN [array_to_string(regexp_extract_all(left(p, -1), '\S+'), ' '), right(p, 1)]
              WHEN contains(p, ',') THEN [regexp_extract(p, '(?s)^(.*),([^,]*)$', 1), CASE WHEN trim(regexp_extract(p, '(?s)^(.*),([^,]*)$', 2), {BLANKS}) = '1' THEN '1' ELSE '0' END]
              ELSE [p, '1'] END) AS ls
          FROM (SELECT doc_id, {LABEL_TEXT} AS s FROM documents))""",
)
def t10(spark, sf):
    rows = fx.docs(spark, sf).select("doc_id", tx.parse_labels(label_text(tx.split_words(F.col("text")))).alias("ls"))
    return rows.select(
        "doc_id", F.size("ls").alias("n_labels"),
        F.array_join(F.transform("ls", lambda x: F.concat(x["word"], F.lit(":"), x["keep"].cast("string"))), " ").alias("labels"),
    )


@query(
    "t10_label_arrays",
    r"""SELECT doc_id, count(*) AS n, sum(CASE WHEN pos % 4 IN (0, 1, 3) THEN 1 ELSE 0 END) AS kept FROM (
          SELECT doc_id, generate_subscripts(ws, 1) - 1 AS pos, unnest(ws) AS w FROM (SELECT doc_id, regexp_extract_all(text, '\S+') AS ws FROM documents)) GROUP BY 1""",
)
def t10_arrays(spark, sf):
    words = tx.split_words(F.col("text"))
    raw = F.transform(words, lambda w, i: F.when(i % 4 == 0, "1").when(i % 4 == 1, "0.9").when(i % 4 == 2, "0"))
    rows = fx.docs(spark, sf).select("doc_id", tx.labels_from_pairs(words, raw).alias("ls"))
    return rows.filter(F.size("ls") > 0).select(
        "doc_id", F.size("ls").alias("n"), F.size(F.filter("ls", lambda x: x["keep"] == 1)).alias("kept")
    )


RAW_RATE = (
    "CASE event_id % 5 WHEN 0 THEN cast(value AS {s}) || '%' WHEN 1 THEN cast(value / 100 AS {s}) WHEN 2 THEN 'n/a' "
    "WHEN 3 THEN ' 45.0% ' ELSE '1' END"
)


@query(
    "t11_parse_rate",
    rf"""SELECT event_id, round(coalesce(CASE WHEN regexp_matches(u, '^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$') THEN try_cast(u AS DOUBLE) END
           / CASE WHEN ends_with(t, '%') THEN 100 ELSE 1 END, 0), 6) AS rate
         FROM (SELECT event_id, t, rtrim(t, '%') AS u FROM (SELECT event_id, trim({RAW_RATE.format(s='VARCHAR')}) AS t FROM events))""",
)
def t11(spark, sf):
    rows = fx.table(spark, sf, "events").select("event_id", F.expr(RAW_RATE.format(s="STRING")).alias("r"))
    return rows.select("event_id", F.round(tx.parse_rate(F.col("r")), 6).alias("rate"))


@query(
    "t12_none_anchor",
    f"""SELECT doc_id, a IS NULL OR t = '' OR starts_with(t, 'none') AS is_none FROM (SELECT doc_id, a, lower(trim(trim(a, {BLANKS}), '.,;:!?"''')) AS t FROM (
          SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN ' "None".' WHEN 1 THEN NULL WHEN 2 THEN ' ?! ' WHEN 3 THEN 'Nonesuch' ELSE regexp_extract(text, '\\S+') END AS a FROM documents))""",
)
def t12(spark, sf):
    a = (
        F.when(F.col("doc_id") % 6 == 0, ' "None".').when(F.col("doc_id") % 6 == 1, F.lit(None)).when(F.col("doc_id") % 6 == 2, " ?! ")
        .when(F.col("doc_id") % 6 == 3, "Nonesuch").otherwise(F.get(tx.split_words(F.col("text")), F.lit(0)))
    )
    return fx.docs(spark, sf).select("doc_id", tx.is_none_anchor(a).alias("is_none"))


ALIAS_CASE = "CASE event_type WHEN 'click' THEN ' Claude ' WHEN 'view' THEN 'ANTHROPIC' WHEN 'signup' THEN 'gpt' WHEN 'purchase' THEN 'ChatGPT' ELSE event_type END"


@query(
    "t13_provider_alias",
    f"""SELECT event_id, provider, CASE WHEN provider IS NULL THEN 'Unknown provider: ' || a END AS error FROM (
          SELECT event_id, a, CASE WHEN a IN ('claude', 'anthropic') THEN 'claude' WHEN a IN ('chatgpt', 'openai', 'gpt') THEN 'openai' END AS provider
          FROM (SELECT event_id, lower(trim({ALIAS_CASE})) AS a FROM events))""",
)
def t13(spark, sf):
    rows = fx.table(spark, sf, "events").select("event_id", F.expr(ALIAS_CASE).alias("raw"))
    return account.canonical_provider(rows, "raw").select("event_id", "provider", "error")


@query(
    "t14_hint_prefix",
    q.sql(
        """SELECT doc_id, hint, lower(trim(hint)) IN ('none', '') AS is_empty, CASE WHEN lower(trim(hint)) IN ('none', '') THEN '' ELSE trim(hint) END AS effective, fixed_hint FROM (
             SELECT doc_id, trim(CASE WHEN doc_id % 5 = 0 THEN ' Known answer is' WHEN doc_id % 5 = 1 THEN ' ' WHEN doc_id % 5 = 2 THEN 'It is' || chr(10) || 'on line two' WHEN doc_id % 7 = 0 THEN 'None' ELSE 'The answer is' END) AS hint,
               'Please output the most relevant keyword or phrase that is relevant to the answer of the question.' AS fixed_hint FROM asked)""",
        "asked",
    ),
)
def t14(spark, sf):
    rows = fx.asked(spark, sf)
    given = F.when(F.col("doc_id") % 5 == 0, " Known answer is").when(F.col("doc_id") % 5 == 1, " ").when(
        F.col("doc_id") % 5 == 2, "It is\non line two"
    )
    hint = tx.strip(sel.hint_prefix(F.col("question"), given))
    empty = sel.is_empty_prefix(hint)
    return rows.select(
        "doc_id", hint.alias("hint"), empty.alias("is_empty"), F.when(empty, "").otherwise(hint).alias("effective"),
        sel.hint_prefix(F.col("question"), fixed=True).alias("fixed_hint"),
    )


@query("t15_yes_no", q.sql("SELECT doc_id, regexp_matches(lower(ltrim(question)), '^(is|are|do|does) ') AS yes_no FROM asked", "asked"))
def t15(spark, sf):
    return fx.asked(spark, sf).select("doc_id", tx.is_yes_no(F.col("question")).alias("yes_no"))


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


P = prompts


@query(
    "t16_prompts",
    q.sql(
        f"""SELECT doc_id,
          {lit(P.INSTRUCTION)} || chr(10)||chr(10)||'Context:'||chr(10) || text || chr(10)||chr(10)||'Question: ' || question || chr(10)||'Answer:' AS qa,
          {lit(P.ANCHOR_LEAD)} || text || chr(10)||'Hint: ' || CASE WHEN p <> '' THEN {lit(P.HINT_HEAD)} || p || {lit(P.HINT_MID)} || p || ' none.' ELSE {lit(P.HINT_BARE)} END
            || chr(10)||'Question: ' || question || chr(10) || CASE WHEN p <> '' THEN 'Answer: ' || p ELSE 'Answer:' END AS anchor,
          {lit(P.ANSWER_LEAD)} || text || chr(10)||chr(10)||'Question: ' || question || chr(10)||'Answer:' AS answer,
          CASE WHEN ctx <> '' THEN '<|memory_start|>' || ctx || '<|memory_end|>' || chr(10)||chr(10) || question
            WHEN contains(question, '<|memory_start|>') THEN question
            ELSE '<|memory_start|>' || question || '<|memory_end|>' || chr(10)||chr(10) || {lit(P.MEMORY_ASK)} END AS memory,
          concat_ws(chr(10)||chr(10), nullif(trim(p), ''), nullif(trim(text, {BLANKS}), ''), nullif(trim(question), '')) AS staged,
          CASE WHEN doc_id % 3 = 0 THEN text ELSE text || chr(10)||chr(10)||'Question: ' || trim(question) END AS chat
        FROM (SELECT doc_id, text, CASE WHEN doc_id % 11 = 3 THEN '<|memory_start|>x<|memory_end|> ' || question ELSE question END AS question,
          CASE WHEN doc_id % 7 = 0 THEN '' ELSE 'The answer is' END AS p,
          CASE WHEN doc_id % 2 = 0 THEN text ELSE '' END AS ctx FROM asked)""",
        "asked",
    ),
)
def t16(spark, sf):
    marked = F.when(F.col("doc_id") % 11 == 3, F.concat(F.lit("<|memory_start|>x<|memory_end|> "), "question")).otherwise(F.col("question"))
    rows = fx.asked(spark, sf).withColumn("question", marked)
    text, ask = F.col("text"), F.col("question")
    prefix = F.when(F.col("doc_id") % 7 == 0, "").otherwise("The answer is")
    context = F.when(F.col("doc_id") % 2 == 0, text).otherwise("")
    return rows.select(
        "doc_id", prompts.qa_prompt(text, ask).alias("qa"), prompts.anchor_prompt(text, ask, prefix).alias("anchor"),
        prompts.answer_prompt(text, ask).alias("answer"), prompts.memory_prompt(ask, context).alias("memory"),
        prompts.assemble(prefix, text, ask).alias("staged"),
        prompts.chat_turn(text, F.when(F.col("doc_id") % 3 != 0, ask)).alias("chat"),
    )


@query(
    "t17_strip_question",
    q.sql(
        f"SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN trim(text, {BLANKS}) ELSE text || ' tail' END AS body FROM asked WHERE question <> ''",
        "asked",
    ),
)
def t17(spark, sf):
    rows = fx.asked(spark, sf)
    ended = F.when(F.col("doc_id") % 2 == 0, F.concat("text", F.lit("\n\n"), "question", F.lit(" \n"))).otherwise(F.concat("text", F.lit(" tail")))
    return rows.select("doc_id", tx.ends_with_question(ended, F.col("question")).alias("body"))


@query(
    "t18_needle",
    "SELECT 'page' AS kind, page_id AS id, contains(lower(html), 'the</a>') AS found FROM pages UNION ALL SELECT 'doc', doc_id, contains(lower(text), 'violet-harbor-1987') FROM (SELECT doc_id, CASE WHEN doc_id % 13 = 0 THEN text || ' Violet-Harbor-1987.' ELSE text END AS text FROM documents)",
)
def t18(spark, sf):
    pages = fx.table(spark, sf, "pages").select(
        F.lit("page").alias("kind"), F.col("page_id").alias("id"), tx.contains_literal(F.col("html"), "The</a>").alias("found")
    )
    planted = F.when(F.col("doc_id") % 13 == 0, F.concat("text", F.lit(" Violet-Harbor-1987."))).otherwise(F.col("text"))
    texts = fx.docs(spark, sf).select(
        F.lit("doc").alias("kind"), F.col("doc_id").alias("id"), tx.contains_literal(planted, "violet-harbor-1987").alias("found")
    )
    return pages.unionByName(texts)


@query(
    "t19_display_formats",
    """SELECT event_id, CASE WHEN u < 0.01 THEN printf('$%.4f', u) WHEN u < 1 THEN printf('$%.3f', u) ELSE printf('$%.2f', u) END AS usd,
         printf('%.1f%%', p * 100) AS pct, printf('%.2fx', r) AS ratio
       FROM (SELECT event_id, (value * 1000 + 0.3) / 1e6 * 3 AS u, (value + 0.01) * 0.00100037 AS p, (value + 1.003) * 0.33337 AS r FROM events)""",
)
def t19(spark, sf):
    v = F.col("value")
    usd, pct, ratio = (v * 1000 + 0.3) / 1e6 * 3, (v + 0.01) * 0.00100037, (v + 1.003) * 0.33337
    return fx.table(spark, sf, "events").select(
        "event_id", tx.format_usd(usd).alias("usd"), tx.format_pct(pct).alias("pct"), tx.format_ratio(ratio).alias("ratio")
    )


@query(
    "t20_strike",
    r"""SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN text ELSE array_to_string(list_transform(regexp_extract_all(text, '\S+'),
          lambda w, i: CASE WHEN (i - 1) % 3 = 1 THEN '~~' || w || '~~' ELSE w END), ' ') END AS shown FROM documents""",
)
def t20(spark, sf):
    labels = F.transform(tx.split_words(F.col("text")), lambda w, i: F.struct(w.alias("word"), F.when(i % 3 == 1, 0).otherwise(1).alias("keep")))
    rows = fx.docs(spark, sf).withColumn("labels", F.when(F.col("doc_id") % 9 != 0, labels))
    return rows.select("doc_id", tx.strike(F.col("labels"), F.col("text")).alias("shown"))


@query(
    "w3_word_chunks",
    q.sql(
        'SELECT doc_id, chunk, s::INT AS start, e::INT AS "end", substr(text, (s + 1)::INT, (e - s)::INT) AS body FROM (SELECT doc_id, pos // 300 AS chunk, min(s) AS s, max(e) AS e FROM words GROUP BY ALL) JOIN documents USING (doc_id)',
        "words",
    ),
)
def w3(spark, sf):
    return sg.word_chunks(fx.docs(spark, sf), 300)


@query(
    "w3_rejoined_chunks",
    q.sql("SELECT doc_id, pos // 300 AS chunk, string_agg(word, ' ' ORDER BY pos) AS body FROM plain GROUP BY ALL", "plain"),
)
def w3b(spark, sf):
    return sg.rejoined_chunks(fx.docs(spark, sf), 300)


@query(
    "w4_sentence_windows",
    r"""SELECT doc_id, (pos - 1) // 3 AS unit, string_agg(s, ' ' ORDER BY pos) AS body FROM (SELECT doc_id, unnest(ss) AS s, generate_subscripts(ss, 1) AS pos FROM (
          SELECT doc_id, list_filter(list_transform(flatten(list_transform(string_split(text, chr(10)),
            lambda p: string_split(regexp_replace(trim(p, chr(9)||chr(13)||' '), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)))),
            lambda s: trim(s, chr(9)||chr(13)||' ')), lambda s: s <> '') AS ss FROM documents)) GROUP BY ALL""",
)
def w4(spark, sf):
    return sg.sentence_windows(fx.docs(spark, sf), 3)


@query("w5_running_offset", q.sql("SELECT doc_id, pos, e::INT AS upto FROM words", "words"))
def w5(spark, sf):
    return sg.words(fx.docs(spark, sf)).select("doc_id", "pos", F.col("end").alias("upto"))
