"""Headline queries, timed. Prints one JSON line: total and per-query seconds at $BENCH_SF_DIR on local[$BENCH_CPUS]."""

import json
import os
import time

from pyspark.sql import SparkSession

from weftgraph.plans import registry

HEADLINE = (
    "link_auc_by_predictor", "predict_l3_paths", "precision_at_depth", "temporal_split_summary", "edge_evidence_weights", "background_enrichment", "ppi_best_channel",
    "resolve_components", "mention_resolution", "alias_mentions", "sentence_split", "cooccurrence", "cosine_topk", "bfs_degree_capped", "majority_vote",
)


def main() -> None:
    folder, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", str(2 * int(cpus))).config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    run = registry.queries()
    spark.read.parquet(f"{folder}/lineitem.parquet").count()
    seconds = {}
    for name in HEADLINE:
        start = time.time()
        run[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 2)
    print(json.dumps({"metric": "headline_total", "value": round(sum(seconds.values()), 2), "unit": "sec", "queries": seconds, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
