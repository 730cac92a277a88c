"""Times the build and the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

The queries read the tables that the build writes; its time is a row of its own, and part of the total.
"""

import json
import os
import time

from pyspark.sql import SparkSession

from ledgerlight.plans import corpus
from ledgerlight.plans.reading import QUERIES

HEADLINE = ["case_ranking_topn", "rule_firing_counts", "rollup_state", "rollup_agency", "fund_accounts_two_grain", "agency_hhi", "exact_clusters", "ingest_rejects", "alerts_new", "member_utilisation_percentile", "ablation_measures", "duplicate_evidence", "audit_openings"]


def main() -> None:
    folder, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    small = os.path.join(os.path.dirname(folder.rstrip("/")), "sf0.001")
    if os.path.isdir(small) and small != folder.rstrip("/"):
        QUERIES["corpus_measures"](spark, small).collect()  # warm-up, on other tables
    began = time.time()
    for name in ("cases", "hits", "rollup_state", "rollup_district", "rollup_agency", "rollup_member"):
        corpus.built(spark, folder, name)
    took = {"build": round(time.time() - began, 3)}
    for name in HEADLINE:
        began = time.time()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "build and headline queries, total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(folder.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
