"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from formloom import fixtures as X  # noqa: E402
from formloom.operators import gaps, resample  # noqa: E402
from formloom.plans import load  # noqa: E402
from formloom.session import local_session  # noqa: E402

REGISTERED = ("efa_07_label", "efa_02", "efa_04", "efa_09", "fun_33", "win_10", "agg_06", "agg_07", "agg_15", "mul_01",
              "mul_05", "clu_02", "clu_05", "clu_07", "clu_08", "clu_09_rows", "res_04", "res_21", "res_24", "set_01", "set_02", "jon_01", "jon_14",
              "img_07", "img_09")


def saturation_defaults(spark, d):
    """Ten sample sizes, 200 bootstraps, eight axes."""
    return resample.saturation(X.scores(spark, d), [i / 10 for i in range(1, 11)], 200)


def gap_test_script(spark, d):
    """Grid 100, 50 draws x 50 bootstraps on PC1-PC2, thresholds 0.80 and 0.90."""
    return gaps.detect_gaps(X.scores(spark, d, 2), ["PC1", "PC2"], resolution=100, mc=50, bootstraps=50,
                            thresholds=(0.8, 0.9))["summary"]


def gap_exploratory(spark, d):
    """Grid 100, 50 draws x 100 bootstraps on two axes."""
    return gaps.detect_gaps(X.scores(spark, d, 2), ["PC1", "PC2"], resolution=100, mc=50, bootstraps=100)["summary"]


def gap_defaults(spark, d):
    """Grid 150, 100 draws x 200 bootstraps on the six pairs of four axes (four pairs in the published figure)."""
    return gaps.detect_gaps(X.scores(spark, d, 4), ["PC1", "PC2", "PC3", "PC4"])["summary"]


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(int(os.environ.get("BENCH_CPUS", os.cpu_count() or 8)))
    spark.sparkContext.setLogLevel("ERROR")
    queries, _ = load()
    todo = {k: queries[k] for k in REGISTERED}
    todo["saturation_defaults"] = saturation_defaults
    todo["gap_test_script"] = gap_test_script
    todo["gap_exploratory"] = gap_exploratory
    todo["gap_defaults"] = gap_defaults
    only = sys.argv[1:]
    times = {}
    # start the JVM's and the Python workers' code once, outside the timings
    for name in ("fun_26", "efa_06"):
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    for name, fn in todo.items():
        if only and name not in only:
            continue
        t = time.time()
        fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
