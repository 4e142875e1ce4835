"""Times the headline queries over the tables in $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from pyspark.sql import SparkSession

from lethe import registry

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = [
    "drop_retention", "score_levels", "neighbour_retention_geo", "afc_certificates", "gate_compare", "contamination_contains",
    "leave_out_manifest", "bootstrap_nested", "bootstrap_crossed", "holm", "ledger_lineage", "connected_groups", "upsert_latest",
    "budget_fold", "early_stop", "corpus_rules", "rouge_l_turns", "summary_by_job", "export_round_trip", "eval_probes", "splits_masked",
    "rules_group", "document_differences", "copies_split", "split_assignment", "gateway_requests", "gateway_replay", "source_bundles",
    "exclusion_run", "document_nodes", "fixture_subsets",
]


def main() -> None:
    scratch = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.local.dir", scratch)
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = {name: registry.queries()[name] for name in HEADLINE}
    try:
        from lethe.llm import QUERIES

        queries |= QUERIES
    except ImportError:
        pass
    spark.range(1000).selectExpr("sum(id)").collect()  # start the engine before the clock
    seconds = {}
    for name, query in queries.items():
        began = time.time()
        query(spark, FOLDER).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - began, 2)
        print(name, seconds[name], file=sys.stderr)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(seconds.values()), 2), "unit": "sec", "queries": seconds, "sf": FOLDER.rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
