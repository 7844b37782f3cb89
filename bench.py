"""Headline timings as one JSON line.

Reads BENCH_SF_DIR (default sf0.1) on local[BENCH_CPUS]. Every query runs once to warm up and then
BENCH_RUNS times (default 1) into the noop sink; the best time counts. BENCH_MODEL=1 adds the model
queries; the fit is then reported by itself and not part of the total.
"""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame  # noqa: E402

from alertloom.plans import catalogue  # noqa: E402
from alertloom.session import local_session  # noqa: E402
from alertloom.sources import fixtures  # noqa: E402

HEADLINE = [
    "parsed_alerts", "canonical_summary", "feature_vector", "weak_label", "rolling_counters",
    "policy_override_intended", "explanation_doc", "top_features", "dashboard_page",
    "feedback_metrics_pct", "latency_summary", "consistency_summary", "average_precision",
    "log_templates", "stream_equals_batch",
]
# With BENCH_MODEL=1. Fitting 600 trees takes minutes on eight cores at sf0.1.
MODEL = ["forest_score", "tree_attribution", "background_attribution"]


def to_noop(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def timed(action) -> float:
    start = time.perf_counter()
    action()
    return round(time.perf_counter() - start, 3)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    only = sys.argv[1:] or HEADLINE + (MODEL if os.environ.get("BENCH_MODEL") == "1" else [])
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "alertloom-bench")
    spark.sparkContext.setLogLevel("ERROR")
    queries = {"write_alert_table": timed(lambda: fixtures.alerts(spark, sf))}
    n = fixtures.alerts(spark, sf).count()
    if any(q in only for q in MODEL):
        queries["fit_model"] = timed(lambda: catalogue.trained(spark, sf))
    for name in only:
        query = catalogue.QUERIES[name]
        to_noop(query(spark, sf))
        queries[name] = min(timed(lambda: to_noop(query(spark, sf))) for _ in range(runs))
        print(f"\n{name}: {queries[name]}", file=sys.stderr, flush=True)
    measured = [queries[name] for name in only]
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(measured), 3), "unit": "sec",
        "queries": queries, "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf"),
        "alerts": n,
        "alerts_per_sec": {name: round(n / queries[name]) for name in only},
    }))


if __name__ == "__main__":
    main()
