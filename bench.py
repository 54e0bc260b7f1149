"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import sys
import time

from terseframe.plans import QUERIES
from terseframe.session import build_session

HEADLINE = [
    "t1_split_sentences",
    "t3_word_spans",
    "x1_self_information",
    "x2_bm25",
    "c8_guided_compress",
    "c9_guided_spans",
    "c11_keep_rate",
    "j5_span_overlap",
    "c15_two_methods",
    "c12_two_stage",
    "c13_dedupe_sentences",
    "c19_scored_evaluation",
    "a14_session_totals",
    "q3_quantize",
    "q5_distortion",
    "st4_silence_sessions",
    "c4_merge_labels",
    "c17_question_conditioned",
    "w10_growing_partials",
    "st7_running_totals",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "16g",
           "spark.sql.shuffle.partitions": str(2 * int(cpus))},
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()  # start the executor threads
    took = {}
    for key in HEADLINE:
        began = time.perf_counter()
        QUERIES[key](spark, sf).write.format("noop").mode("overwrite").save()
        took[key] = round(time.perf_counter() - began, 3)
        print(key, took[key], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec",
        "queries": took, "sf": os.path.basename(sf.rstrip("/")),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
