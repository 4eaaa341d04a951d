"""Prompt construction (P1-P4, P8). Messages are arrays of ``struct<role, content>``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Instruction texts of the two tasks.
TRAIN_SYSTEM = """
Respond in the following format:
<reasoning>
...
</reasoning>
<answer>
...
</answer>
"""
TRAIN_MATH_EXTRA = (
    "You are a math expert. You will be given a question to solve. Solve it step by step. "
    "Wrap the final answer in a \\boxed{}. "
)
EVAL_GSM = (
    "Please reason step by step. Your final answer MUST be in this exact format: "
    "<answer> \\boxed{YOUR_ANSWER} </answer>."
)
EVAL_MATH = """You are a math expert. You will be given a question to solve. Solve it step by step. Wrap the final answer in a \\boxed{}.
Respond in the following format:
<reasoning>
Your reasoning here
</reasoning>
<answer>
\\boxed{...}
</answer>"""
REASONING_START = "<reasoning>"
EVAL_SYSTEM = {"gsm8k": EVAL_GSM, "math": EVAL_MATH}


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def train_prompt(kind: str, question: Column) -> Column:
    """One user message, instructions first."""
    if kind == "gsm8k":
        lead = TRAIN_SYSTEM + "\n\n"
    elif kind == "math":
        lead = f"{TRAIN_SYSTEM}\n\n{TRAIN_MATH_EXTRA}\n\n"
    else:
        raise ValueError(f"Unknown task: {kind}")
    return F.array(message("user", F.concat(F.lit(lead), question)))


def eval_prompt(kind: str, question: Column) -> Column:
    """One user message, instructions last."""
    if kind not in EVAL_SYSTEM:
        raise ValueError(f"Unknown task: {kind}")
    return F.array(message("user", F.concat(question, F.lit("\n\n" + EVAL_SYSTEM[kind]))))


def apply_chat_template(messages: Column, before: str, between: str, after: str, header: str) -> Column:
    """``before role between content after`` per message, then the generation header.

    The four pieces come from the caller's tokenizer.
    """
    rendered = F.transform(
        messages,
        lambda m: F.concat(F.lit(before), m["role"], F.lit(between), m["content"], F.lit(after)),
    )
    return F.concat(F.array_join(rendered, ""), F.lit(header))


def ends_with_assistant(messages: Column) -> Column:
    return F.coalesce(F.try_element_at(messages, F.lit(-1))["role"] == "assistant", F.lit(False))


def bootstrap_prompt(messages: Column) -> Column:
    """The prompt without a closing assistant message."""
    return F.when(
        ends_with_assistant(messages), F.slice(messages, F.lit(1), F.size(messages) - 1)
    ).otherwise(messages)


def bootstrap_completion(messages: Column, completion: Column) -> Column:
    """A closing assistant message's content goes in front of the completion."""
    return F.when(
        ends_with_assistant(messages),
        F.concat(F.try_element_at(messages, F.lit(-1))["content"], completion),
    ).otherwise(completion)
