"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from topicloom.plans.queries import QUERIES

HEADLINE = ("dtm_counts", "dtm_vocab", "init_z", "nw_counts", "nd_counts", "post_phi", "fixed_phi_pass", "adlda_pass", "adlda_documents", "merge_models", "online_nw", "lineitem_topics")


def main() -> None:
    d, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    conf = {"spark.driver.memory": "12g", "spark.sql.shuffle.partitions": cpus, "spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"}
    spark = SparkSession.builder.master(f"local[{cpus}]").config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{d}/documents.parquet").count()
    took = {}
    for name in HEADLINE:
        began = time.time()
        QUERIES[name](spark, d).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(d).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
