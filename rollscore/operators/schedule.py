"""Which rollout fed which update (T7, J7), and mask seeds per iteration."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollscore.functions.ranges import each_below
from rollscore.functions.sampling import integer_below
from rollscore.plans.skew import SPLIT_ROWS, attach_aggregates

# Range of the drawn mask seeds, and the seed used without drawing.
SEED_RANGE = 4096
CONSTANT_SEED = 42


def rollout_schedule(
    log: DataFrame, grad_accum: int, iterations: int, run: Sequence[str] = ("run",), split_rows: int = SPLIT_ROWS
) -> DataFrame:
    """For each (run, step, slot), the step whose rollout is used and the iteration index.

    A slot is refilled at its first step after a start or resume, and whenever the step is a
    multiple of ``iterations``. The last refill at or before a step is then a maximum of two
    numbers, so the as-of join needs no ordering of the log.
    """
    seen = attach_aggregates(log, [*run, "slot"], split_rows, _first=F.min("step"))
    scheduled = F.col("step") - F.pmod(F.col("step"), F.lit(iterations))
    rollout_step = F.greatest(F.col("_first"), scheduled)
    counter = F.col("step") * grad_accum + F.col("slot") + 1
    return seen.select(
        *log.columns,
        (F.col("step") == rollout_step).alias("is_refreshed"),
        rollout_step.alias("rollout_step"),
        counter.alias("counter"),
        F.pmod(counter, F.lit(iterations)).alias("iteration"),
    )


def step_grid(runs: DataFrame, slots: int) -> DataFrame:
    """A (step, slot) row for every update of runs given as ``first_step`` and ``last_step``."""
    steps = runs.withColumn("step", F.explode(F.sequence("first_step", "last_step")))
    return steps.withColumn("slot", each_below(slots))


def mask_seeds(steps: DataFrame, iterations: int, random: bool, seed: int = 0, key: Sequence[str] = ("step",)) -> DataFrame:
    """A prompt-mask seed per rollout and iteration, drawn or constant."""
    each = steps.withColumn("iter", each_below(iterations))
    if not random:
        return each.withColumn("mask_seed", F.lit(CONSTANT_SEED).cast("bigint"))
    drawn = integer_below(seed, SEED_RANGE, *[F.col(k) for k in key], F.col("iter"))
    return each.withColumn("mask_seed", drawn)
