"""Times headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import time
from pathlib import Path

from pyspark.sql import SparkSession

from ledgerline.plans import registry

HEADLINE = [
    "jurisdiction_progress", "registry_kpis", "field_confidence", "velocity_7day", "duplicate_documents", "snapshot_reconcile",
    "upsert_preserve", "learn_rules", "apply_rules", "script_profile", "normalise_text", "cross_audit", "check_status",
    "survey_number_sets", "evidence_line", "payload_changes", "audit_timeline", "duplicate_register", "gis_hierarchy",
    "record_checklist", "canonical_records", "stage_feedback", "page_languages", "deed_fields", "deed_documents", "stored_upserts", "plot_spans",
]


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in HEADLINE:
        times = []
        for _ in range(3):  # the first run warms up
            began = time.time()
            registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.time() - began)
        seconds[name] = round(sorted(times[1:])[0], 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": Path(sf_dir).name}))
    spark.stop()


if __name__ == "__main__":
    main()
