"""Times the headline queries and prints one JSON line.

``BENCH_SF_DIR`` names the data, ``BENCH_CPUS`` the cores. Each query is run once to warm up
and once for its time; the result is computed in full and thrown away. Name queries, or
``all`` of them, as arguments to time others.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent))

from workload.queries import queries  # noqa: E402


# The jobs, and the costliest operators of each family.
HEADLINE = (
    "score_runs a10_accuracy a10_accuracy_math a22_validate e4_gsm e5_math e6_last_boxed e8_normalize e9_equiv "
    "r5_tags r6_math r6_math_answers f1_reward_table f1_documents j2_gold a1_total a3_func_mean a4_std a7_adv_stats "
    "w1_rloo w2_grpo w4_group_std p1_prompt p3_prompt p6_pad p9_eos p11_prompt_mask p14_shuffle t1_segment t3_inputs "
    "k4_sample t5_sample_mask a8_coverage t6_schedule t7_schedule k1_select k1_audit j3_logps a12_grpo a13_dapo "
    "a15_gspo_partial a16_gspo_token a19_clip_mask a20_kl a21_total s6_update_metrics r8_token_logp r9_confidence "
    "a9_merge l3_bt l4_softmax l5_segment l6_position l8_block_segment l8_block_position"
).split()


def session(cpus: str) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus if cpus.isdigit() else "8")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def run(frame: DataFrame) -> None:
    frame.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = list(queries()) if sys.argv[1:] == ["all"] else sys.argv[1:] or HEADLINE
    spark = session(cpus)
    times: dict[str, float] = {}
    for name in chosen:
        for _ in range(2):
            start = time.perf_counter()
            run(queries()[name](spark, sf_dir))
            times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "total_query_seconds",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": Path(sf_dir).name.removeprefix("sf"),
        "cpus": cpus,
        "memory": os.environ.get("BENCH_MEMORY", "12g"),
    }))


if __name__ == "__main__":
    main()
