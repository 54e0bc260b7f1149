"""The registered queries of this subpackage: each operator over its whole table."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    bottom_k, byte_bpe, golay_dedup, hadamard_kmeans, line_windows, ngram_trie, pfair_mix, quality_crf, topk_hist, turn_repair, url_words,
    var_pack, wrapper,
)

#: Target weights of the mixture: sources src0 to src19 by the rule 1 + i mod 4, two parts for all others.
TARGETS = {f"src{i}": 1 + i % 4 for i in range(20)} | {pfair_mix.OTHER: 2}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def op1_quality(spark: SparkSession, sf: str) -> DataFrame:
    return quality_crf.score_documents(table(spark, sf, "documents"), table(spark, sf, "labels"))


def op2_mix(spark: SparkSession, sf: str) -> DataFrame:
    rows = pfair_mix.mix(table(spark, sf, "documents").select("doc_id", "source"), TARGETS)
    return rows.select(
        "doc_id", "source", F.col("mix_class").alias("class"), F.col("mix_rank").alias("rank"), F.col("mix_block").alias("block"),
        F.col("mix_slot").alias("slot"), F.col("mix_release").alias("release"), F.col("mix_deadline").alias("deadline"),
    )


def op3_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """doc_id, removed_lines, removed_chars, sha256 of the text left, of every document."""
    docs = table(spark, sf, "documents")
    out = line_windows.drop_repeats(docs.select("doc_id", "text", F.col("text").alias("whole")))
    lines = lambda c: F.length(c) - F.length(F.replace(c, F.lit("\n"))) + 1
    left = F.when(F.col("text") == "", 0).otherwise(lines(F.col("text")))
    return out.select(
        "doc_id", F.when(F.col("found_spans").isNull(), 0).otherwise(lines(F.col("whole")) - left).cast("long").alias("removed_lines"),
        (F.length("whole") - F.length("text")).cast("long").alias("removed_chars"), F.sha2("text", 256).alias("text_sha256"),
    )


def op4_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    return bottom_k.fingerprints(table(spark, sf, "documents"))


def op5_top_k(spark: SparkSession, sf: str) -> DataFrame:
    rows = topk_hist.whole_vectors(table(spark, sf, "embeddings"))
    return topk_hist.top_k(rows, rows.filter("vec_id % 100 = 0"))


def op6_near_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    found = golay_dedup.near_duplicates(table(spark, sf, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_language_model(spark: SparkSession, sf: str) -> DataFrame:
    return ngram_trie.score_held_out(table(spark, sf, "documents"))


def op8_packing(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    run, place = var_pack.stored_order(docs)
    return var_pack.piece_rows(var_pack.pack(docs, run=run, place=place))


def op9_url_filter(spark: SparkSession, sf: str) -> DataFrame:
    return url_words.judge(table(spark, sf, "pages"))


def op10_main_text(spark: SparkSession, sf: str) -> DataFrame:
    return wrapper.main_text(table(spark, sf, "pages"))


def op11_byte_bpe(spark: SparkSession, sf: str) -> DataFrame:
    import public_tokenizers

    tokenizer = byte_bpe.load_tokenizer(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return byte_bpe.digests(table(spark, sf, "documents"), tokenizer)


def op12_turn_repair(spark: SparkSession, sf: str) -> DataFrame:
    return turn_repair.repair(table(spark, sf, "conversations"))


def op13_clusters(spark: SparkSession, sf: str) -> DataFrame:
    return hadamard_kmeans.clusters_with_inertia(table(spark, sf, "embeddings"))


TOP_K_SQL = """
WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, x.vec_id, list_dot_product(q.v::DOUBLE[], x.v::DOUBLE[])::BIGINT AS score
  FROM whole q JOIN whole x ON q.vec_id <> x.vec_id AND len(q.v) = len(x.v) WHERE q.vec_id % 100 = 0
)
SELECT query_id, rank::INT AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 10
"""

# States: 0 nothing kept yet, 1 after a system row, 2 after a user row, 3 after an assistant row.
REPAIR_SQL = """
WITH RECURSIVE crc_table AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce([i::BIGINT, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c
    FROM range(256) r(i))
), keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: unicode(x)::BIGINT) AS bytes
  FROM conversations
), harmed AS (
  SELECT *, xor(list_reduce(list_concat([4294967295::BIGINT], bytes), lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)])), 4294967295) % 20 AS harm
  FROM keyed, crc_table
), damaged AS (
  SELECT conv_id, turn, CASE WHEN harm = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN harm = 1 THEN '' WHEN harm = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE WHEN harm = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM harmed WHERE harm <> 0
), ids AS (SELECT conv_id, row_number() OVER (ORDER BY conv_id) AS g FROM (SELECT DISTINCT conv_id FROM conversations)
), numbered AS (
  SELECT g, turn, role, text, row_number() OVER (PARTITION BY g ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i
  FROM damaged JOIN ids ON damaged.conv_id IS NOT DISTINCT FROM ids.conv_id
), judged AS (
  SELECT *, left(role, 1) AS initial, CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'blank'
    WHEN row_number() OVER (PARTITION BY g, role, text ORDER BY i) > 1 THEN 'duplicate'
    WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') THEN 'truncated' ELSE 'none' END AS fault,
    lag(left(role, 1)) OVER (PARTITION BY g ORDER BY i) AS before
  FROM numbered
), written(s, s2, price, letters, made) AS (VALUES
  (0, 0, 0, '', []::VARCHAR[]), (1, 1, 0, '', []), (2, 2, 0, '', []), (3, 3, 0, '', []),
  (0, 2, 3, 'I', ['user:']), (1, 2, 3, 'I', ['user:']), (2, 3, 3, 'I', ['assistant:']), (3, 2, 3, 'I', ['user:']),
  (0, 3, 6, 'II', ['user:', 'assistant:']), (1, 3, 6, 'II', ['user:', 'assistant:']), (2, 2, 6, 'II', ['assistant:', 'user:']), (3, 3, 6, 'II', ['user:', 'assistant:'])
), arcs(letter, initial, s, s2, price) AS (
  SELECT 'D', NULL::VARCHAR, s, s, 4 FROM range(4) r(s) UNION ALL SELECT 'R', NULL::VARCHAR, s, CASE WHEN s = 2 THEN 3 ELSE 2 END, 3 FROM range(4) r(s)
  UNION ALL VALUES ('K', 's', 0, 1, 0), ('K', 'u', 0, 2, 0), ('K', 'u', 1, 2, 0), ('K', 'u', 3, 2, 0), ('K', 'a', 2, 3, 0)
), walked AS (
  SELECT g, 0::BIGINT AS i, 0::BIGINT AS s, {'cost': 0::BIGINT, 'audit': '', 'lines': []::VARCHAR[]} AS v FROM ids
  UNION ALL
  SELECT w.g, j.i, a.s2, min({'cost': v.cost + n.price + a.price + CASE WHEN letter <> 'D' AND fault = 'truncated' THEN 3 ELSE 0 END,
    'audit': v.audit || letters || letter,
    'lines': list_concat(v.lines, made, CASE letter WHEN 'D' THEN [] WHEN 'K' THEN [role || ':' || text]
      ELSE [CASE WHEN a.s = 2 THEN 'assistant:' ELSE 'user:' END || text] END)})
  FROM walked w JOIN judged j ON j.g = w.g AND j.i = w.i + 1 JOIN written n ON n.s = w.s
  JOIN arcs a ON a.s = n.s2 AND (a.initial IS NULL OR a.initial = j.initial) AND (letter = 'D' OR fault IN ('none', 'truncated'))
  GROUP BY w.g, j.i, a.s2
), best AS (
  SELECT w.g, min({'cost': v.cost + n.price, 'audit': v.audit || letters, 'lines': list_concat(v.lines, made)}) AS v
  FROM walked w JOIN written n ON n.s = w.s AND n.s2 IN (0, 3)
  WHERE w.i = coalesce((SELECT max(j.i) FROM judged j WHERE j.g = w.g), 0) GROUP BY w.g
), sums AS (
  SELECT g, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
    count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal
  FROM judged GROUP BY g
)
SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
  coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, v.cost AS cost, v.audit AS audit,
  sha256(array_to_string(v.lines, chr(10))) AS repaired_sha256
FROM ids JOIN best USING (g) LEFT JOIN sums USING (g)
"""


def _cluster_sql(k: int = 16, rounds: int = 3) -> str:
    parts = [f"""
WITH kept AS (
  SELECT row_number() OVER () AS id, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), c0 AS (
  SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), v) - 1 AS j, v AS c FROM kept QUALIFY j < {k}
)"""]
    for r in range(rounds + 1):
        parts.append(f"""a{r} AS MATERIALIZED (
  SELECT id, min({{'d': list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT, 'j': j}}) AS b FROM kept, c{r} GROUP BY id
)""")
        if r < rounds:
            parts.append(f"""m{r} AS (
  SELECT j, list((s - ((s % n) + n) % n) // n ORDER BY p) AS c FROM (
    SELECT j, p, sum(x)::BIGINT AS s, count(*) AS n FROM (SELECT b.j AS j, unnest(v) AS x, unnest(range(64)) AS p FROM kept JOIN a{r} USING (id)) GROUP BY j, p
  ) GROUP BY j
), c{r + 1} AS MATERIALIZED (SELECT j, coalesce(m.c, o.c) AS c FROM c{r} o LEFT JOIN m{r} m USING (j))""")
    return ", ".join(parts) + f"""
SELECT vec_id, b.j::INT AS cluster, b.d AS distance, sum(b.d) OVER (PARTITION BY b.j)::BIGINT AS cluster_inertia, sum(b.d) OVER ()::BIGINT AS inertia,
  sha256(array_to_string(c, ',')) AS centroid_sha256
FROM kept JOIN a{rounds} USING (id) JOIN c{rounds} ON j = b.j
"""


QUERIES = {
    f.__name__: f
    for f in (
        op1_quality, op2_mix, op3_line_dedup, op4_fingerprints, op5_top_k, op6_near_duplicates, op7_language_model, op8_packing,
        op9_url_filter, op10_main_text, op11_byte_bpe, op12_turn_repair, op13_clusters,
    )
}
ORACLES = {"op5_top_k": TOP_K_SQL, "op12_turn_repair": REPAIR_SQL, "op13_clusters": _cluster_sql()}
