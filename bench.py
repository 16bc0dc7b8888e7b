"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import glob
import json
import os
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from eventloom.plans import registry, registry_sources, registry_text  # noqa: E402, F401
from eventloom.session import local_session  # noqa: E402

HEADLINES = ("w1_clash_report", "a1_dashboard_metrics", "a5_clash_groups", "b3_view_query", "c1_score_cascade",
             "d1_parse_datetime", "x10_analyze_caption", "j5_directory_contacts", "q1_inverted_index", "q2_ranked_search_top",
             "e4_jaccard_pairs", "e2_client_resolve", "s3_jsonld_events", "s5_card_fallback")


def spread_out(spark, sf_dir: str, files: int) -> str:
    """A copy of the tables in several files each, as a cluster's store holds them; the given ones are one row group."""
    root = tempfile.mkdtemp(prefix="bench-")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        spark.read.parquet(path).repartition(files).write.parquet(f"{root}/{os.path.basename(path)}")
    return root


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    names = os.environ.get("BENCH_QUERIES", ",".join(HEADLINES)).split(",")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    sf_dir = spread_out(spark, sf_dir, int(os.environ.get("BENCH_CPUS", "8")))
    registry.QUERIES["a5_clash_groups"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm-up
    times: dict[str, float] = {}
    for name in names:
        taken = []
        for _ in range(runs):
            start = time.perf_counter()
            registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - start)
        times[name] = round(statistics.median(taken), 3)
        print(f"{name}: {times[name]}s", file=sys.stderr)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(sf) if sf.replace(".", "").isdigit() else sf}))


if __name__ == "__main__":
    main()
