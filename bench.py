"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tarnlake.plans import REGISTRY  # noqa: E402
from tarnlake.session import build_session  # noqa: E402

HEADLINES = [
    "e1_pass_rate_per_prompt", "e6_difficulty_classes", "c13_pass_rate_band", "d1_pass_rate_annotation", "e7_pass_at_k",
    "e9_mean_std_at_n", "e10_best_worst_at_n", "e11_majority_at_n", "e21_difficulty_histogram", "f1_group_advantage",
    "f3_best_only_advantage", "f4_baseline_whitened", "f8_discounted_returns", "f9_gae", "e15_batch_metrics", "e27_loss_modes",
    "f21_clipped_policy_diagnostics", "f25_pairwise_accuracy", "f24_detached_loss", "d8_weighted_resample", "g1_seeded_sample",
    "g3_proportional_allocation", "h1_balanced_parts", "i2_exact_dedup", "c1_length_filter", "recipe_documents_sampled",
    "j4_default_math_grade", "j_scored_pass_rates", "j19_instruction_checks", "l1_dense_top_k", "l2_bm25_top_k", "s1_incremental_scoring",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "spark.ui.showConsoleProgress": "false",
    })
    spark.sparkContext.setLogLevel("ERROR")
    wanted = sys.argv[1:] or HEADLINES
    times: dict[str, float] = {}
    REGISTRY["e31_data_source_counts"].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
    for name in wanted:
        t0 = time.time()
        REGISTRY[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
