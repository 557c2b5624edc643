"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
os.environ["PYTHONPATH"] = os.path.dirname(os.path.abspath(__file__)) + os.pathsep + os.environ.get("PYTHONPATH", "")

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = [
    "search_topk", "normalize_words", "name_variants", "gaps_islands", "first_per_group", "forward_fill", "competition_counts", "label_election", "containment_join",
    "guarded_overlay", "interval_overlap_parity", "snapshot_diff", "radius_join_topk", "nearest_segment", "point_in_polygon", "geo_gcj02", "geo_utm_forward", "merge_candidates",
    "site_clusters", "hold_filter", "html_cell_text", "validate_conserved",
]


def main() -> None:
    from pyspark.sql import SparkSession

    from placewright import catalogue

    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").appName("bench").config("spark.sql.shuffle.partitions", CPUS).config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{SF_DIR}/lineitem.parquet").count()  # start the session's threads before the clock runs
    took, failed = {}, {}
    for name in HEADLINE:
        best = float("inf")
        try:
            for _ in range(2):
                start = time.perf_counter()
                catalogue.QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
                best = min(best, time.perf_counter() - start)
            took[name] = round(best, 3)
        except Exception as error:  # the others still count
            failed[name] = str(error).splitlines()[0][:200]
        print(f"{name} {took.get(name, 'failed')}", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": SF_DIR.rsplit("sf", 1)[-1], "failed": failed}))
    if failed:
        raise SystemExit(1)


if __name__ == "__main__":
    main()
