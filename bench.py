"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; one JSON line with the median seconds of each."""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import SparkSession

from quernel import queries

HEADLINE = ["q1", "q3", "q6", "filter_cmp", "point_lookup", "hash_join", "filter_and_or_not", "join_5way", "agg_group", "agg_count_distinct", "in_subquery", "order_limit"]
RUNS = 5


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    conf = {"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.session.timeZone": "UTC", "spark.driver.memory": "8g"}
    spark = SparkSession.builder.master(f"local[{cpus}]").appName("bench").config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    out = {}
    for name in HEADLINE:
        seconds = []
        for i in range(RUNS + 2):  # the first two compile and warm up
            began = time.perf_counter()
            queries.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            if i >= 2:
                seconds.append(time.perf_counter() - began)
        out[name] = round(statistics.median(seconds), 4)
    print(json.dumps({"metric": "headline_query_seconds", "value": round(sum(out.values()), 4), "unit": "sec", "queries": out, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
