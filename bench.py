"""Times the headline queries; prints one JSON line."""

import json
import os
import time

from pyspark.sql import SparkSession

from hearthmark import store
from hearthmark.plans import catalog

HEADLINE = ["leaderboard", "walk_forward", "c1_grid", "b5_segment", "a2_pooled", "lc2_curve", "e2_blend", "b4_nearest", "conformal_apply", "pair_elasticity", "fuzzy_dedup", "reconcile", "audit", "fe_slope", "token_records", "reconstruct", "bootstrap_ci", "half_tables", "profit_records", "nearest_edge", "weight_holdout"]


def main() -> None:
    sf, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    catalog.QUERIES["hygiene"](spark, sf).collect()
    took = {}
    for name in HEADLINE:
        start = time.time()
        catalog.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - start, 3)
    store.release(spark)
    print(json.dumps({"metric": "headline query seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf}))


if __name__ == "__main__":
    main()
