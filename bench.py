"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

The tables are first copied into a folder of their own, spread over as many files as there are cores,
so that row-wise queries are not timed on one core. Each query is written to the no-op sink: one
warm-up run, then the median of the timed runs; ``rows_per_sec`` relates it to its largest input table.
"""

import json
import os
import shutil
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

#: Query and the table whose rows it reads.
HEADLINE = {
    "A17_scene_summary": "events", "W4_segments": "events", "W1_exact_dedup": "events", "W1_anchored_dedup": "events", "W9_merge_boxes": "lineitem",
    "W10_text_cues": "events", "W12_trajectory": "events", "W13_moving_average": "events", "W15_rolling_progress": "events", "W22_frame_gaps": "lineitem",
    "A4_trend_direction": "lineitem", "A5_video_averages": "lineitem", "A15_degradation_rollup": "lineitem", "A21_gate_decision": "lineitem",
    "A24_metric_difference": "lineitem", "A66_pooled_scores": "lineitem", "J6_nearest_anchor": "events", "J8_best_offset": "events",
    "J10_points_in_intervals": "events", "J14_cache_split": "lineitem", "J18_identity_match": "embeddings", "J21_box_containment": "lineitem",
    "J24_box_iou": "lineitem", "J25_suitable_offers": "orders", "T5_eviction_list": "lineitem", "W5_merge_short_scenes": "events", "W16_ema": "events", "ST3_event_counts": "events", "ST4_rate_limiter": "events",
    "F36_era_and_medium": "lineitem", "X11_request_tags": "part",
    "X17_cost_estimate": "lineitem", "SRC8_cmx3600": "orders", "UD9_frame_features": "embeddings",
}


def main():
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    from reelmetrics.plans import QUERIES
    from reelmetrics.plans.bindings import TABLES
    from reelmetrics.session import build_session

    work = tempfile.mkdtemp(prefix="spark-bench-")
    conf = {
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "spark.ui.showConsoleProgress": "false",
        "spark.checkpoint.dir": f"{work}/shared", "spark.sql.warehouse.dir": f"{work}/warehouse",
    }
    spark = build_session(f"local[{cpus}]", "bench", **conf)
    spark.sparkContext.setLogLevel("ERROR")
    rows = {}
    for name in TABLES:
        table = spark.read.parquet(f"{folder}/{name}.parquet")
        rows[name] = table.count()
        table.repartition(int(cpus) if rows[name] > 1000 else 1).write.parquet(f"{work}/{name}.parquet")
    times = {}
    for name in HEADLINE:
        took = []
        for _ in range(runs + 1):
            start = time.time()
            QUERIES[name](spark, work).write.format("noop").mode("overwrite").save()
            took.append(time.time() - start)
        times[name] = round(statistics.median(took[1:]), 3)
        print(name, times[name], file=sys.stderr, flush=True)
    out = {
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "rows_per_sec": {n: round(rows[HEADLINE[n]] / t) for n, t in times.items()}, "sf": folder.rstrip("/").rsplit("sf", 1)[-1],
    }
    print(json.dumps(out), flush=True)
    spark.stop()
    shutil.rmtree(work, ignore_errors=True)


if __name__ == "__main__":
    main()
