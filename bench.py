"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line. Seconds are of a second run; first runs are listed beside."""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


def main() -> None:
    from pyspark.sql import SparkSession

    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from spanforge import catalog
    from spanforge.operators import overlaps

    lists = lambda **how: lambda s, d: overlaps.find_overlaps_lists(catalog.order_groups(s, d), catalog.part_groups(s, d), bins=128, **how)
    flat = lambda **how: lambda s, d: overlaps.find_overlaps_lists(catalog.order_groups(s, d), catalog.parts(s, d), subject_flat=True, bins=128, **how)
    headline = {
        "find_overlaps_list_list": lists(),
        "find_overlaps_list_list_ignore_strand": lists(ignore_strand=True),
        "find_overlaps_list_flat": flat(),
        "find_overlaps_list_flat_ignore_strand": flat(ignore_strand=True),
        "summarize_overlaps": catalog.queries()["j4_count_overlaps_by_space"],
        "merge": catalog.queries()["a2_merge"],
        "disjoin": catalog.queries()["a4_disjoin"],
        "coverage": catalog.queries()["a7_coverage"],
        "intersect": catalog.queries()["u2_intersect"],
        "nearest": catalog.queries()["j9_nearest_all"],
        "k_nearest": catalog.queries()["j12_k_nearest"],
        "subtract": catalog.queries()["j16_subtract"],
    }

    def seconds(query) -> float:
        began = time.time()
        query(spark, sf_dir).write.format("noop").mode("overwrite").save()
        return round(time.time() - began, 3)

    first = {k: seconds(q) for k, q in headline.items()}
    again = {k: min(seconds(q) for _ in range(2)) for k, q in headline.items()}
    print(json.dumps({"metric": "headline_total", "value": round(sum(again.values()), 3), "unit": "sec", "queries": again, "first": first, "sf": sf_dir.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
