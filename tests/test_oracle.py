"""A query of each group against its checking SQL on the smallest tables."""

import math

import duckdb
import pytest

from terseframe.plans import ORACLES, QUERIES

TABLES = ["documents", "benchmark", "labels", "conversations", "embeddings", "pages", "events"]
KEYS = [
    "t2_sentence_spans", "t10_parse_labels", "x2_bm25", "c9_guided_spans", "c11_keep_rate", "c15_two_methods", "c4_merge_labels",
    "c13_dedupe_sentences", "w1_rank_any_group", "a5_arm_summary", "s2_answers_scan", "s14_report", "a17_sparkline", "w9_replay_timeline",
    "q3_quantize", "st4_silence_sessions", "q1_fitted_codebook", "q6_outlier_channels", "f3_span_functions", "a12_fault_tally",
    "a26_chat_turns", "c5_overshoot_guard", "c14_document_totals", "l5_input_order", "j7_similar_sentences", "a20_dropped_sentences",
    "c1_word_positions", "c17_question_conditioned", "q7_append_codes", "f2_pair_scorer", "st5_row_lifecycle", "st8_event_dispatch",
]


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9) + 0.0)
    return str(v)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("key", KEYS)
def test_query_matches_sql(spark, sf, duck, key):
    df = QUERIES[key](spark, sf)
    cols = sorted(df.columns)
    want = duck.execute(ORACLES[key])
    names = [d[0] for d in want.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert sorted(tuple(plain(r[c]) for c in cols) for r in df.collect()) == sorted(tuple(plain(r[i]) for i in at) for r in want.fetchall())


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
