"""Time the headline queries and print one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
Each query is planned and run to the end, results written to the noop sink.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINES = (
    "c1_unmatched_credits", "c2_open_invoices", "c7_b20_anchor_and_target", "a3_bank_ingest", "c18_invoice_gate",
    "b6_b7_b8_h27_extraction", "h11_h12_fuzzy_verdict", "h13_h14_waterfall", "c9_k1_subsets",
    "k3_k4_b17_b21_fast_path", "k6_c14_posting", "h32_g1_ledger_lines", "c13_d9_headers_with_lines",
    "k7_h26_tickets_from_review", "e1_e2_page_groups", "h18_masked_text", "h21_tokenized_text", "d5_batch_funnel",
    "d6_d7_d8_kpis", "d14_telemetry_fold", "k9_e3_e4_e5_expected_feed", "i4_a6_ledger_stream",
)


def main() -> None:
    from ledgerloom.plans.registry import queries
    from ledgerloom.session import build_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(app_name="bench", master=f"local[{cpus}]", spark__ui__enabled="false",
                          spark__sql__shuffle__partitions=cpus, spark__driver__memory="16g")
    spark.sparkContext.setLogLevel("ERROR")
    plans = queries()
    plans["c2_open_invoices"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # JVM warm-up
    times = {}
    for name in HEADLINES:
        start = time.time()
        plans[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
