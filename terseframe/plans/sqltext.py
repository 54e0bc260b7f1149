"""Shared pieces of the checking SQL, composed by name."""

PUNCT = "!\"#$%&''()*+,-./:;<=>?@[\\]^_`{|}~"
SENT = r"""\s*(?:[^.!?\n\s][^.!?\n]*)?[.!?]+["'')\]}.!?]*|\s*[^.!?\n\s][^.!?\n]*"""


def norm(x: str) -> str:
    return (
        rf"array_to_string(list_filter(string_split_regex(translate(lower({x}), '{PUNCT}', ''), '\s+'), "
        r"lambda t: t NOT IN ('', 'a', 'an', 'the')), ' ')"
    )


def norm_list(x: str) -> str:
    return (
        rf"list_filter(string_split_regex(translate(lower({x}), '{PUNCT}', ''), '\s+'), "
        r"lambda t: t NOT IN ('', 'a', 'an', 'the'))"
    )


def wc(x: str) -> str:
    return rf"len(regexp_extract_all({x}, '\S+'))"


def term(x: str) -> str:
    return f"trim(lower({x}), '.,!?;:\"''')"


def half_even(x: str, d: int) -> str:
    return f"round_even({x}, {d})"


def tiles(table: str, key: str, pattern: str, out: str) -> str:
    """Rows (key, pos, word, s, e) of a tiling pattern over `text` of `table`."""
    return (
        f"SELECT {key}, pos, w AS {out}, e0 - length(ltrim(piece, chr(9)||chr(10)||chr(13)||' ')) AS s, "
        f"e0 - length(ltrim(piece, chr(9)||chr(10)||chr(13)||' ')) + length(w) AS e FROM ("
        f"SELECT *, trim(piece, chr(9)||chr(10)||chr(13)||' ') AS w, "
        f"sum(length(piece)) OVER (PARTITION BY {key} ORDER BY pos) AS e0 FROM ("
        f"SELECT {key}, unnest(ps) AS piece, generate_subscripts(ps, 1) - 1 AS pos FROM ("
        f"SELECT {key}, regexp_extract_all(text, '{pattern}') AS ps FROM {table})))"
    )


CTES: dict[str, tuple[list[str], str]] = {
    "words": ([], tiles("documents", "doc_id", r"\s*\S+", "word")),
    "plain": (
        [],
        r"SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS pos "
        r"FROM (SELECT doc_id, regexp_extract_all(text, '\S+') AS ws FROM documents)",
    ),
    "counts": (["plain"], "SELECT lower(word) AS term, count(*) AS c FROM plain GROUP BY 1"),
    "questions": (
        [],
        "SELECT item_id AS qid, list_sort(list_distinct(list_filter(list_transform("
        r"regexp_extract_all(text, '\S+'), lambda w: " + term("w") + "), lambda t: length(t) >= 1))) AS terms FROM benchmark",
    ),
    "asked": (
        ["questions"],
        "SELECT d.doc_id, d.text, d.doc_id % (SELECT count(*) FROM benchmark) AS qid, coalesce(q.terms, []) AS terms, "
        "CASE WHEN d.doc_id % 7 = 0 THEN 'Is it ' ELSE 'Where is ' END || array_to_string(coalesce(q.terms, []), ' ') || '?' AS question "
        "FROM documents d LEFT JOIN questions q ON q.qid = d.doc_id % (SELECT count(*) FROM benchmark)",
    ),
    # keep-rate decision at 0.5 on documents
    "rate_kept": (
        ["plain", "counts"],
        """SELECT doc_id, pos, word FROM (
             SELECT *, lag(word) OVER (PARTITION BY doc_id ORDER BY pos) AS prev FROM (
               SELECT p.doc_id, p.pos, p.word,
                 row_number() OVER (PARTITION BY p.doc_id ORDER BY c.c, p.pos) AS rk,
                 count(*) OVER (PARTITION BY p.doc_id) AS n
               FROM plain p JOIN counts c ON c.term = lower(p.word))
             WHERE rk <= ceil(0.5 * n) OR regexp_matches(word, '[0-9]') OR word IN ('.', '!', '?', ','))
           WHERE NOT (word IN ('.', '!', '?', ',') AND prev IS NOT DISTINCT FROM word)""",
    ),
    "rate_text": (
        ["rate_kept", "plain"],
        """SELECT n.doc_id, n.n AS origin_words, coalesce(k.k, 0) AS kept_words, coalesce(k.t, '') AS compressed FROM
             (SELECT doc_id, count(*) AS n FROM plain GROUP BY 1) n LEFT JOIN
             (SELECT doc_id, count(*) AS k, string_agg(word, ' ' ORDER BY pos) AS t FROM rate_kept GROUP BY 1) k USING (doc_id)""",
    ),
    # question-guided decision, 300-word chunks, top 12
    "gtok": (
        ["words", "asked"],
        "SELECT w.doc_id, w.pos // 300 AS chunk, w.pos % 300 AS i, w.pos, w.word, w.s, w.e, "
        "list_contains(a.terms, " + term("w.word") + ") AS hit FROM words w JOIN asked a USING (doc_id)",
    ),
    "gchunk": (
        ["gtok"],
        "SELECT g.*, substr(d.text, (cs + 1)::INT, (ce - cs)::INT) AS text FROM ("
        "SELECT doc_id, chunk, min(s) AS cs, max(e) AS ce, count(*) AS n_tokens, bool_or(hit) AS hit, "
        "count(*) OVER (PARTITION BY doc_id) AS n_chunks FROM gtok GROUP BY doc_id, chunk) g JOIN documents d USING (doc_id)",
    ),
    "gsent": (["gchunk"], tiles("gchunk", "doc_id, chunk", SENT, "sentence")),
    "gtop": (
        ["gtok", "gchunk"],
        "SELECT * FROM (SELECT t.doc_id, t.chunk, t.i, t.s - c.cs AS at, row_number() OVER ("
        "PARTITION BY t.doc_id, t.chunk ORDER BY CASE WHEN t.hit THEN 10.0 ELSE 1.0 / (t.i + 2) END DESC, t.i) AS rk "
        "FROM gtok t JOIN gchunk c USING (doc_id, chunk) WHERE c.hit) WHERE rk <= 12",
    ),
    "gidx": (
        ["gtop", "gsent"],
        "SELECT DISTINCT doc_id, chunk, idx FROM (SELECT t.doc_id, t.chunk, t.i, coalesce(max(s.pos), 0) AS idx "
        "FROM gtop t LEFT JOIN gsent s ON s.doc_id = t.doc_id AND s.chunk = t.chunk AND s.s <= t.at GROUP BY ALL)",
    ),
    "gkept": (
        ["gidx", "gsent", "gchunk"],
        "SELECT s.doc_id, s.chunk, s.pos AS idx, s.sentence, c.cs + s.s AS s, c.cs + s.e AS e FROM gsent s "
        "JOIN gchunk c USING (doc_id, chunk) WHERE (c.hit AND EXISTS (SELECT 1 FROM gidx k WHERE k.doc_id = s.doc_id "
        "AND k.chunk = s.chunk AND k.idx = s.pos)) OR (NOT c.hit AND c.n_chunks = 1)",
    ),
    "gword": (
        ["words", "gkept"],
        "SELECT DISTINCT w.doc_id, w.pos, w.word FROM words w JOIN gkept k ON k.doc_id = w.doc_id AND w.s < k.e AND w.e > k.s",
    ),
    "gdoc": (
        ["asked", "gchunk", "gkept"],
        "SELECT a.doc_id, a.text, a.question, coalesce(c.n_chunks, 0) AS n_chunks, coalesce(c.n_kept, 0) AS n_kept_chunks, "
        "coalesce(k.n_spans, 0) AS n_spans FROM asked a LEFT JOIN (SELECT doc_id, any_value(n_chunks) AS n_chunks, "
        "CASE WHEN any_value(n_chunks) = 1 THEN 1 ELSE count(*) FILTER (hit) END AS n_kept FROM gchunk GROUP BY 1) c USING (doc_id) "
        "LEFT JOIN (SELECT doc_id, count(*) AS n_spans FROM gkept GROUP BY 1) k USING (doc_id)",
    ),
    "merged": (
        ["gdoc", "rate_kept", "gword", "modes"],
        """SELECT d.doc_id, m.mode, d.n_spans = 0 AS fallback, count(w.pos) AS n_kept,
             coalesce(string_agg(w.word, ' ' ORDER BY w.pos), '') AS merged_text
           FROM gdoc d CROSS JOIN modes m LEFT JOIN (
             SELECT coalesce(l.doc_id, g.doc_id) AS doc_id, coalesce(l.pos, g.pos) AS pos, coalesce(l.word, g.word) AS word,
               l.pos IS NOT NULL AS in_l, g.pos IS NOT NULL AS in_g
             FROM rate_kept l FULL JOIN gword g ON l.doc_id = g.doc_id AND l.pos = g.pos) w
           ON w.doc_id = d.doc_id AND CASE WHEN d.n_spans = 0 THEN in_l WHEN m.mode = 'union' THEN in_l OR in_g ELSE in_l AND in_g END
           GROUP BY ALL""",
    ),
    "modes": ([], "SELECT unnest(['intersection', 'union']) AS mode"),
    # requests
    "req": (
        [],
        "SELECT source AS req_id, doc_id AS unit_idx, doc_id, text, "
        "coalesce(try_cast(regexp_extract(source, '[0-9]+') AS BIGINT), 0) % (SELECT count(*) FROM benchmark) AS qid FROM documents",
    ),
    "qterm": (["questions"], "SELECT qid, unnest(terms) AS term FROM questions"),
    "forms": (["plain"], "SELECT doc_id, " + term("word") + " AS term, count(*) AS tf FROM plain GROUP BY ALL"),
    "dlen": ([], "SELECT doc_id, " + wc("text") + " AS len FROM documents"),
    "idf": (
        ["qterm", "forms"],
        "SELECT term, ln(1 + ((SELECT count(*) FROM documents) - coalesce(df, 0) + 0.5) / (coalesce(df, 0) + 0.5)) AS idf "
        "FROM (SELECT DISTINCT term FROM qterm) LEFT JOIN (SELECT term, count(*) AS df FROM forms GROUP BY 1) USING (term)",
    ),
    "scored": (
        ["req", "qterm", "forms", "dlen", "idf"],
        "SELECT r.req_id, r.unit_idx, r.doc_id, r.text, r.qid, round(1 / (1 + exp(-coalesce(sum(i.idf * f.tf * 2.2 / "
        "(f.tf + 1.2 * (0.25 + 0.75 * l.len / (SELECT avg(len) FROM dlen)))), 0))), 6) AS score "
        "FROM req r JOIN dlen l USING (doc_id) LEFT JOIN qterm q ON q.qid = r.qid LEFT JOIN forms f "
        "ON f.doc_id = r.doc_id AND f.term = q.term LEFT JOIN idf i ON i.term = f.term GROUP BY r.req_id, r.unit_idx, r.doc_id, r.text, r.qid",
    ),
    "ranked": (
        ["scored"],
        "SELECT *, row_number() OVER (PARTITION BY req_id ORDER BY score DESC, unit_idx) AS rank, count(*) OVER (PARTITION BY req_id) AS n FROM scored",
    ),
    # transcripts
    "utt": (
        [],
        "SELECT conv_id, turn, role, text, n, sum(n * 300 + (turn % 9) * 250) OVER w - n * 300 AS start_ms, "
        "sum(n * 300 + (turn % 9) * 250) OVER w AS end_ms, CASE WHEN role = 'user' THEN 0 ELSE 1 END AS speaker FROM ("
        "SELECT *, " + wc("text") + " AS n FROM conversations) WINDOW w AS (PARTITION BY conv_id ORDER BY turn)",
    ),
    "uwords": (
        [],
        r"SELECT conv_id, turn, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS pos "
        r"FROM (SELECT conv_id, turn, regexp_extract_all(text, '\S+') AS ws FROM conversations)",
    ),
    "ukept": (
        ["uwords"],
        """SELECT conv_id, turn, pos, word FROM (
             SELECT *, lag(word) OVER (PARTITION BY conv_id, turn ORDER BY pos) AS prev FROM (
               SELECT p.*, row_number() OVER (PARTITION BY conv_id, turn ORDER BY c.c, p.pos) AS rk,
                 count(*) OVER (PARTITION BY conv_id, turn) AS n
               FROM uwords p JOIN (SELECT lower(word) AS term, count(*) AS c FROM uwords GROUP BY 1) c ON c.term = lower(p.word))
             WHERE rk <= ceil(0.7 * n) OR regexp_matches(word, '[0-9]') OR word IN ('.', '!', '?', ','))
           WHERE NOT (word IN ('.', '!', '?', ',') AND prev IS NOT DISTINCT FROM word)""",
    ),
    "utt_done": (
        ["utt", "ukept"],
        "SELECT u.*, CASE WHEN u.n > 0 THEN u.n END AS origin_tokens, CASE WHEN u.n > 0 THEN coalesce(k.k, 0) END AS compressed_tokens, "
        "CASE WHEN u.n > 0 THEN coalesce(k.t, '') END AS compressed, CASE WHEN turn % 10 = 0 THEN 0 ELSE 10 + n % 50 END AS latency_ms "
        "FROM utt u LEFT JOIN (SELECT conv_id, turn, count(*) AS k, string_agg(word, ' ' ORDER BY pos) AS t FROM ukept GROUP BY ALL) k USING (conv_id, turn)",
    ),
}


def sql(final: str, *names: str, **extra: str) -> str:
    """`final` with the CTEs it names and everything they rest on. `extra` adds own CTEs."""
    order: list[str] = []

    def need(name: str) -> None:
        if name in order:
            return
        for dep in CTES[name][0]:
            need(dep)
        order.append(name)

    for n in names:
        need(n)
    parts = [f"{n} AS ({CTES[n][1]})" for n in order] + [f"{n} AS ({q})" for n, q in extra.items()]
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + final
