from . import account_queries, compress_queries, eval_queries, stream_queries, text_queries, vector_queries  # noqa: F401
from .registry import ORACLES, QUERIES, as_bigint

# sums the checking engine widens to 128 bits
as_bigint({
    "a14_session_totals": ["origin", "compressed", "saved"],
    "a15_usd_saved": ["saved"],
    "a16_hourly_projection": ["saved"],
    "w11_running_totals": ["origin_so_far", "compressed_so_far"],
    "w7_pause_gap": ["gap_ms", "full_gap"],
    "w9_replay_timeline": ["per_word_ms", "first_ms", "final_ms"],
    "w10_growing_partials": ["at_ms"],
    "t10_label_arrays": ["kept"],
    "x1_counted_words": ["total"],
    "x1_counted_words_split": ["total"],
    "j6_position_to_sentence": ["idx_sum", "idx_mix"],
    "u6_spans_of_all_chunks": ["kept_chars"],
    "c11_target_budget": ["pos_sum"],
    "c1_word_positions": ["n", "chars", "lo", "hi", "mix"],
    "c4_merge_labels": ["guided", "n_words", "n_kept"],
    "c12_two_stage": ["documents_origin", "context_origin", "context_kept"],
    "c18_arm_grid": ["origin_words", "kept_words"],
    "a1_bag_overlap": ["same"],
    "s8_transcript_scan": ["startMs", "endMs"],
    "s9_live_messages": ["start_ms"],
    "st1_take_stream": ["start_ms", "end_ms"],
    "st3_take_batch": ["start_ms", "end_ms"],
    "st7_running_totals": ["origin", "compressed", "saved"],
})

__all__ = ["ORACLES", "QUERIES"]
