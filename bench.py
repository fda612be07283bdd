"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line. Every query builds its own snapshots."""
from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "fragility_ranking", "market_indicators", "outsider_placing", "order_statistic_thresholds", "single_quarter_growth", "financial_indicators",
    "typed_steps", "propagation_paths", "key_paths", "supply_layers", "guarantee_circles", "exposure_on_date", "stress_ranking",
    "relation_summary", "linked_names", "name_resolution", "validity_windows", "events_in_following_year", "study_panel", "rank_correlation",
    "event_reaction", "collapsed_events", "detection_by_document", "exact_pairs", "evidence_report", "rule_classifier", "printed_rows", "web_blocks",
    "stream_daily_counts", "correlation_permutation", "new_document_paths", "suppressed_records", "named_parties", "price_shock_layers", "stream_keyed_state",
]


def main() -> None:
    from faultline.catalog import QUERIES
    from faultline.catalog.views import forget_snapshots
    from faultline.session import local_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    names = sys.argv[1:] or HEADLINE
    if names == ["all"]:
        names = list(QUERIES)
    spark.range(1000).selectExpr("sum(id)").collect()                    # start the executor threads
    times = {}
    for name in names:
        forget_snapshots()
        start = time.time()
        QUERIES[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
        if os.environ.get("BENCH_VERBOSE"):
            print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "total wall time of the headline queries", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
