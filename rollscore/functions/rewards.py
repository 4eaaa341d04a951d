"""Reward functions and the plug-in registry.

A reward is a function from a dictionary of Columns (``completion``, ``answer`` and whatever
else the table carries) to one double Column. NULL means "does not apply".
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from rollscore.functions.answers import extract_xml_answer, last_boxed, remove_boxed
from rollscore.functions.mathnorm import is_equiv
from rollscore.functions.text import SPACE, let, occurrences

Reward = Callable[[dict[str, Column]], Column]

# What the rewards pay.
CORRECT = 2.0
FORMAT = 0.5
TAG = 0.125
TAIL_COST = 0.001

# Patterns and tags of the rewarded formats. (?d) keeps "." from matching a newline only.
STRICT_FORMAT = r"(?d)^<reasoning>\n.*?\n</reasoning>\n<answer>\n.*?\n</answer>\n$"
SOFT_FORMAT = r"(?d)\A<reasoning>.*?</reasoning>" + SPACE + r"*<answer>.*?</answer>"
OPEN_REASONING = "<reasoning>\n"
CLOSE_REASONING = "\n</reasoning>\n"
OPEN_ANSWER = "\n<answer>\n"
CLOSE_ANSWER = "\n</answer>"
CLOSE_ANSWER_LINE = "\n</answer>\n"
ANSWER_BODY_OPEN = "<answer>"
ANSWER_BODY_CLOSE = "</answer>"
BOX = "\\boxed"
BOX_COMPAT = "\boxed"  # a backspace and "oxed": the probe as originally written

# Characters that count as digits: decimal digits, superscripts, circled and the like.
DIGITS = (
    r"\A[\p{Nd}\x{B2}\x{B3}\x{B9}\x{1369}-\x{1371}\x{19DA}\x{2070}\x{2074}-\x{2079}"
    r"\x{2080}-\x{2089}\x{2460}-\x{2468}\x{2474}-\x{247C}\x{2488}-\x{2490}\x{24EA}"
    r"\x{24F5}-\x{24FD}\x{24FF}\x{2776}-\x{277E}\x{2780}-\x{2788}\x{278A}-\x{2792}"
    r"\x{10A40}-\x{10A43}\x{10E60}-\x{10E68}\x{11052}-\x{1105A}\x{1F100}-\x{1F10A}]+\z"
)


def _pay(condition: Column, amount: float) -> Column:
    return F.when(condition, F.lit(amount)).otherwise(F.lit(0.0))


def correct_answer(cols: dict[str, Column]) -> Column:
    """Extracted answer equals the gold text exactly."""
    return _pay(extract_xml_answer(cols["completion"]) == cols["answer"], CORRECT)


def integer_answer(cols: dict[str, Column]) -> Column:
    """R2: extracted answer is all digits (no sign, comma or point)."""
    return _pay(extract_xml_answer(cols["completion"]).rlike(DIGITS), FORMAT)


def strict_format(cols: dict[str, Column]) -> Column:
    """The four tags on lines of their own around single-line bodies, and nothing else."""
    return _pay(cols["completion"].rlike(STRICT_FORMAT), FORMAT)


def soft_format(cols: dict[str, Column]) -> Column:
    """Starts with both tag pairs, each without an inner newline."""
    return _pay(cols["completion"].rlike(SOFT_FORMAT), FORMAT)


def tag_count(cols: dict[str, Column]) -> Column:
    """A share per tag seen exactly once, less a cost per character after the answer."""
    text = cols["completion"]

    def once(tag: str) -> Column:
        return occurrences(text, tag) == 1

    # A regex split, since two closing tags may share a newline and the left one then wins.
    after_line = F.length(F.element_at(F.split(text, CLOSE_ANSWER_LINE, -1), -1))
    after_tag = F.length(F.substring_index(text, CLOSE_ANSWER, -1)) - 1
    return (
        _pay(once(OPEN_REASONING), TAG)
        + _pay(once(CLOSE_REASONING), TAG)
        + F.when(once(OPEN_ANSWER), TAG - after_line * TAIL_COST).otherwise(F.lit(0.0))
        + F.when(once(CLOSE_ANSWER), TAG - after_tag * TAIL_COST).otherwise(F.lit(0.0))
    )


def correct_math(cols: dict[str, Column]) -> Column:
    """Boxed answer equivalent to the gold solution's box.

    An unreadable completion is compared as it is. An unreadable gold gives NULL, so that the
    row can be found and mended instead of failing the job.
    """
    answer = F.coalesce(remove_boxed(last_boxed(cols["completion"])), cols["completion"])
    gold = remove_boxed(last_boxed(cols["answer"]))
    return let(gold, lambda g: F.when(g.isNotNull(), _pay(is_equiv(answer, g), CORRECT)))


def boxed_format(cols: dict[str, Column], compat: bool = True) -> Column:
    """Half for an answer tag, and half (else a quarter) for a box in its body.

    With ``compat`` the box probe is the one that never matches ordinary LaTeX.
    """
    text = cols["completion"]
    tagged = text.contains(ANSWER_BODY_OPEN)
    after = F.split(text, ANSWER_BODY_OPEN, 3)
    body = F.when(tagged, F.substring_index(F.get(after, F.lit(1)), ANSWER_BODY_CLOSE, 1)).otherwise(text)
    boxed = body.contains(BOX_COMPAT if compat else BOX)
    return _pay(tagged, FORMAT) + F.when(boxed, F.lit(FORMAT)).otherwise(F.lit(FORMAT / 2))


REWARDS: dict[str, Reward] = {
    "tag_count": tag_count,
    "soft_format": soft_format,
    "strict_format": strict_format,
    "integer_answer": integer_answer,
    "correct_answer": correct_answer,
    "correct_math": correct_math,
    "boxed_format": boxed_format,
}

# The rewards of each task, in their order.
TASK_REWARDS = {
    "gsm8k": ["tag_count", "soft_format", "strict_format", "integer_answer", "correct_answer"],
    "math": ["correct_math", "boxed_format"],
}


def resolve(funcs: list[str] | dict[str, Reward]) -> dict[str, Reward]:
    """Look rewards up by name; a dictionary may bring rewards of the user's own."""
    if isinstance(funcs, dict):
        return dict(funcs)
    unknown = [name for name in funcs if name not in REWARDS]
    if unknown:
        raise ValueError(f"Unknown reward functions: {unknown}")
    return {name: REWARDS[name] for name in funcs}


def python_reward(scorer: Callable[..., list[float | None]], columns: list[str]) -> Reward:
    """F2: wrap a user's batch scorer as a reward.

    ``scorer`` gets one list per named column and returns one number or None per row. It runs
    on Arrow batches in Python workers, so built-in expressions are to be preferred.
    """

    @pandas_udf("double")
    def score(*series: pd.Series) -> pd.Series:
        return pd.Series(scorer(*[s.tolist() for s in series]), dtype="float64")

    return lambda cols: score(*[cols[name] for name in columns])
