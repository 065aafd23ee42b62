"""Wall time of the headline queries, one JSON line on stdout.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose
the data and the local cores. Each query runs once to warm up; the reported
time is the median of three more runs that write every row to a no-op sink.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import pairs
from chirpframe.plans.session import local_session

HEADLINE = [
    "flt08_combinators", "prj01_file_events", "trf05_apply_all", "tgt07_encode_peak", "agg01_class_summary",
    "spl01_split_by_recordings", "clp01_tile_recordings", "jon01_events_in_clips", "det01_suppress", "det02_peaks",
    "fea02_max_power", "lbl01_heatmaps", "sig04_stft", "sig06_resize", "sig07_pcen", "snk03_result_documents",
    "mat01_detection_matches", "mat01_box_matches", "mat03_per_class_matches", "met02_average_precision",
    "met03_detection_metrics", "met04_classification_metrics", "met07_confusion_matrix", "met14_legacy_per_class",
    "mat02_free_choice", "mat05_assign_classes", "sig11_preprocess", "aug07_maybe_apply",
]


def run(spark, sf_dir: str, name: str) -> float:
    started = time.perf_counter()
    pairs.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - started


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    names = os.environ.get("BENCH_QUERIES", "").split() or HEADLINE
    spark = local_session(cores, app="bench", spark__sql__shuffle__partitions=cores)
    times = {}
    for name in names:
        run(spark, sf_dir, name)
        times[name] = round(statistics.median(run(spark, sf_dir, name) for _ in range(3)), 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline_queries_total_sec", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
        "cores": int(cores), "spark": spark.version,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
