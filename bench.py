"""Time the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Every query runs once to warm up and then three times; the median counts. A result is written to Spark's ``noop`` sink, so
every row is made and none is collected.
"""

from __future__ import annotations

import json
import os
import sys
import time
from statistics import median

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from rarefia import operators as ops  # noqa: E402
from rarefia.plans import Diversity, views  # noqa: E402


def cases(spark: SparkSession, sf_dir: str) -> dict:
    """Each case makes a result and what to do when it has been read: an analysis removes its tables."""
    out = {"counts_line": lambda: (ops.allele_counts(views.line(spark, sf_dir)), lambda: None)}
    for g in (8, 32):
        def case(view, result, g=g):
            def make():
                d = Diversity(view(spark, sf_dir), g)
                return result(d), d.close

            return make

        out[f"richness_line_g{g}"] = case(views.line, Diversity.richness)
        out[f"private_line_g{g}"] = case(views.line, Diversity.private)
        out[f"comb2_line_g{g}"] = case(views.line, lambda d: d.combinations(2))
        out[f"richness_part_g{g}"] = case(views.part, Diversity.richness)
        out[f"private_part_g{g}"] = case(views.part, Diversity.private)
        out[f"comb3_part_g{g}"] = case(views.part, lambda d: d.combinations(3))
    return out


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.driver.memory", "8g").config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name, make in cases(spark, sf_dir).items():
        times = []
        for _ in range(4):
            began = time.perf_counter()
            df, done = make()
            df.write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - began)
            done()
        seconds[name] = round(median(times[1:]), 3)
    spark.stop()
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline queries, sum of medians", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": sf}))


if __name__ == "__main__":
    main()
