"""Run the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINES = [
    "px_index_deltas",
    "mask_fractions",
    "stat_scene_cut_mad",
    "stat_tail_p95_p99",
    "gate_decide",
    "kernel_components",
    "metric_roc_auc",
    "funnel_reductions",
    "cost_usage_rates",
    "budget_curve",
    "conformal_lambda",
    "sweep_argmax",
    "emb_dispersion",
    "spend_running_cap",
    "join_nearest_time",
    "quality_season_delta",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))

    from terrashift import plans
    from terrashift.session import build_session

    spark = build_session(cpus, "bench")

    def run(name: str) -> float:
        began = time.perf_counter()
        plans.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - began

    run("gate_decide")  # compiles what all of them share
    seconds = {name: round(min(run(name) for _ in range(2)), 3) for name in HEADLINES}
    spark.stop()
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "headline queries, total", "value": total, "unit": "sec", "queries": seconds, "sf": Path(sf_dir).name.removeprefix("sf")}))


if __name__ == "__main__":
    main()
