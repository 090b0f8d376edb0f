"""Headline queries at one scale factor; prints one JSON line with wall times in seconds."""
import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tremor.session import build_session  # noqa: E402

HEADLINE = ["E06_impact_query", "E07_impact_batch", "D02_dedupe_edges", "D13_communities", "K13_match_routes",
            "J07_resolve_method", "H06_resolution_coverage", "I03_match_calls", "F06_review_report"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.checkpoint.dir": tempfile.mkdtemp(prefix="spark-bench-"),
        "spark.sql.shuffle.partitions": str(2 * int(cpus)), "spark.driver.memory": "16g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    from tremor import catalog

    spark.range(1000).count()
    times = {}
    for name in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(","):
        started = time.time()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - started, 2)
        print(f"{name} {times[name]}s", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_queries_wall_time", "value": round(sum(times.values()), 2), "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
