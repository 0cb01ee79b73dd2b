"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores.
Every result is produced in full (written to the no-op sink). One short query runs first so
that the session's start is not charged to the first headline query.
"""

from __future__ import annotations

import json
import os
import sys
import time

from stintwise.plans.catalogue import QUERIES
from stintwise.session import build_session

HEADLINE = (
    "a1_mapped_rows", "b12_sequence_index", "c1_record_contract", "c5_c7_temporal_flags", "c15_bin_rules",
    "c22_text_scan_documents", "c24_content_fingerprint", "d1_price_summary_by_brand", "d3_concept_availability",
    "d4_summary_by_lap", "f5_exclusion_cascade", "f6_attrition_funnel", "f18_pairing", "f24_comparability_status",
    "g6_paired_effect_by_car", "g8_dispersion_ratio", "g9_theil_sen_trend", "g11_exact_sign_test",
    "g14_percentile_interval", "g17_holm", "g21_leave_one_cluster_out", "h1_lifecycle_edges", "h7_export_references",
    "i3_claims_versus_inventory",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["d6_one_scan_many_computations"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    wanted = sys.argv[1:] or HEADLINE
    seconds = {}
    for name in wanted:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
