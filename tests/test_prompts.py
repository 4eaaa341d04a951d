"""Prompt texts as they must come out."""

from __future__ import annotations

from pyspark.sql import functions as F

from rollscore.functions import prompts

# The instruction texts of both tasks.
TRAIN = "\nRespond in the following format:\n<reasoning>\n...\n</reasoning>\n<answer>\n...\n</answer>\n\n\n"
TRAIN_MATH = TRAIN + (
    "You are a math expert. You will be given a question to solve. Solve it step by step. "
    "Wrap the final answer in a \\boxed{}. \n\n"
)
EVAL_GSM = (
    "\n\nPlease reason step by step. Your final answer MUST be in this exact format: <answer> \\boxed{YOUR_ANSWER} </answer>."
)
EVAL_MATH = (
    "\n\nYou are a math expert. You will be given a question to solve. Solve it step by step. Wrap the final answer in a \\boxed{}.\n"
    "Respond in the following format:\n<reasoning>\nYour reasoning here\n</reasoning>\n<answer>\n\\boxed{...}\n</answer>"
)


def test_texts(spark):
    row = spark.range(1).select(
        prompts.train_prompt("gsm8k", F.lit("Q?"))[0]["content"].alias("train"),
        prompts.train_prompt("math", F.lit("Q?"))[0]["content"].alias("train_math"),
        prompts.eval_prompt("gsm8k", F.lit("Q?"))[0]["content"].alias("eval"),
        prompts.eval_prompt("math", F.lit("Q?"))[0]["content"].alias("eval_math"),
    ).first()
    assert row.train == TRAIN + "Q?"
    assert row.train_math == TRAIN_MATH + "Q?"
    assert row.eval == "Q?" + EVAL_GSM
    assert row.eval_math == "Q?" + EVAL_MATH
