"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR names the input folder, BENCH_CPUS the number of cores, BENCH_QUERIES a comma list that
replaces the default choice.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "riskiest_target", "indicator_ttc", "indicator_tadv", "indicator_ttc2d", "indicator_act", "indicator_ei",
    "current_features", "every_frame_scenes", "sample_scenes", "interaction_pairs", "regrid_interpolate",
    "reconnect_tracks", "determine_target_large", "warning_records_large", "warning_records_voted_large",
    "threshold_sweep_intensity", "eval_metrics", "score_intensity", "exact_quartiles", "vehicle_dims", "unnest_ragged",
    "attribution_by_condition", "filter_ego_tracks", "attribute_intensity",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or list(HEADLINE)
    from nearmiss.catalog.registry import load_all
    from nearmiss.session import build_session

    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "12g", "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        # the inputs are small and the work per row is not: keep one task per core
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
    })
    spark.sparkContext.setLogLevel("ERROR")
    entries = load_all()
    spark.range(1000).selectExpr("sum(id)").collect()  # start the executor threads outside the timing
    times = {}
    for name in names:
        start = time.perf_counter()
        entries[name].job(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    spark.stop()
    print(json.dumps({
        "metric": "total wall time of the headline queries", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
