"""Time the headline queries; prints one JSON line.

Environment: BENCH_SF_DIR (tables), BENCH_CPUS (cores), BENCH_RUNS (timed runs per query,
the best one counts), BENCH_QUERIES (names, comma-separated).
"""

from __future__ import annotations

import json
import os
import tempfile
import time

from gavelspark.plans import PLANS
from gavelspark.session import build_session
from gavelspark.sources.files import discard

HEADLINE = [
    "q1_currency",
    "q3_local_items", "q3_pending_join", "q3_latest_join",
    "bid_auction_join", "q4_avg_price_by_category", "record_highs_category", "running_avg",
    "q5_bid_counts", "q5_hot_items",
    "q6_avg_price_by_seller_last10", "q6_windowed_avg",
    "q7_highest_bid_per_auction", "q7_highest_bid",
    "q8_new_sellers", "q8_range_join",
    "bid_auction_buffered_watermark", "late_flags",
    "bid_codec", "recovery_duration", "lag_samples",
    "stream_q5_bid_counts", "stream_q6_last10", "stream_running_avg", "stream_q3_latest_join", "stream_bid_auction_buffered",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE

    scratch = tempfile.mkdtemp(prefix="bench-")  # one machine: what streams and files write goes there
    spark = build_session("bench", cpus, **{"spark.sql.shuffle.partitions": cpus, "spark.checkpoint.dir": scratch})
    discard(PLANS["q1_currency"](spark, sf_dir))  # start-up is not part of any query
    seconds = {}
    for name in names:
        taken = []
        for _ in range(runs):
            start = time.perf_counter()
            discard(PLANS[name](spark, sf_dir))
            taken.append(time.perf_counter() - start)
        seconds[name] = round(min(taken), 3)
    print(json.dumps({
        "metric": "total of the headline queries",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
        "cores": int(cpus),
        "shuffle_partitions": int(cpus),
        "spark": spark.version,
        "runs": f"best of {runs}",
    }))
    spark.stop()


if __name__ == "__main__":
    main()
