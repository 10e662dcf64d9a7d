"""Times the headline queries once each, from the source tables to the last row, after
one untimed-in-total warm-up query that is reported on its own (``warmup``).

BENCH_SF_DIR  directory of the tables   (default /root/testdata/sf0.1)
BENCH_CPUS    local cores               (default 8)
Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import time

from ledgerweave.catalog.queries import QUERIES
from ledgerweave.session import local_session

HEADLINE = (
    "account_features",
    "event_features",
    "dedupe_tx",
    "bank_view_tx",
    "tx_mix",
    "bank_overview",
    "daily_activity",
    "split_assign",
    "numeric_stats",
    "global_vocab",
    "encode_long",
    "predict_scores",
    "pr_curve",
    "val_metrics",
    "test_report",
    "masked_metrics",
    "gd_round",
    "local_update",
    "federated_round",
    "local_baseline",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(int(os.environ.get("BENCH_CPUS", "8")), "ledgerweave-bench")
    seconds: dict[str, float] = {}
    rows: dict[str, int] = {}
    started = time.perf_counter()
    QUERIES[HEADLINE[0]](spark, sf_dir).write.format("noop").mode("overwrite").save()
    warmup = round(time.perf_counter() - started, 3)
    for name in HEADLINE:
        started = time.perf_counter()
        # A count would let the optimizer drop columns; the noop sink computes them all.
        result = QUERIES[name](spark, sf_dir)
        result.write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
        if name in ("account_features", "split_assign", "numeric_stats", "val_metrics"):
            rows[name] = result.count()
    print(
        json.dumps(
            {
                "metric": "total wall-clock of headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "warmup": warmup,
                "rows": rows,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
