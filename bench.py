"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose
the input and the cores.  Every query is run to the end into a sink that keeps
nothing.  BENCH_ALL=1 times every registered query; BENCH_WARM=1 adds a second
round over the same queries and reports that one.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "pages_per_host", "page_owners", "capped_pages_per_host", "fetch_list", "page_records", "discovery_funnel",
    "newest_event_per_entity", "newest_three_events", "trailing_day_volume", "purchase_after_newest_view",
    "tri_state_of_claims", "screening_history", "content_changes_per_key", "audit_chain", "profile_completeness",
    "stage_rollup", "campaign_metrics", "targets_with_newest_results", "risk_from_signals", "plan_totals",
    "suggested_allocation", "campaign_fit", "shared_services", "merge_roots", "outlet_snapshot", "placement_values",
    "compliance_decisions", "passages_in_documents", "watched_words_in_documents", "term_search", "genres_of_text",
    "page_class_of_text", "message_payload_hashes", "service_page_facts", "screened_services", "approval_validity",
]


def main() -> None:
    from wayfold.registry import load
    from wayfold.session import local_session
    root = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    queries = load()
    names = list(queries) if os.environ.get("BENCH_ALL") else HEADLINE
    spark.range(1000).selectExpr("sum(id)").collect()
    times: dict[str, float] = {}
    for _ in range(2 if os.environ.get("BENCH_WARM") else 1):
        for name in names:
            start = time.perf_counter()
            queries[name].run(spark, root).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - start, 3)
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "headline_queries_total_seconds", "value": total, "unit": "sec", "queries": times,
                      "sf": os.path.basename(root.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
