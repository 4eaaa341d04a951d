"""Final-answer extraction from free text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rollscore.functions.text import SPACE, let, strip, tag_body, to_float

# Markers and patterns of the answer formats.
OPEN_TAG = "<answer>"
CLOSE_TAG = "</answer>"
HASHES = "####"
BOX = "\\boxed"
SPACED_BOX = "\\boxed "
OPEN_BOX = "\\boxed{"
FRAMED_BOX = "\\fbox"
NUMBER = r"-?\d+\.?\d*"
HASH_NUMBER = r"####" + SPACE + r"*\$?([\d,]+(?:\.\d+)?)"
BOX_BODY = r"(?d)\\boxed\{(.*?)\}"


def extract_xml_answer(text: Column) -> Column:
    """Text after the last opening tag, up to the next closing tag; whole text without tags."""
    return strip(F.substring_index(F.substring_index(text, OPEN_TAG, -1), CLOSE_TAG, 1))


def extract_hash_answer(text: Column) -> Column:
    """Stripped text between the first and second ``####``; NULL without the mark."""
    return strip(F.get(F.split(text, HASHES, 3), F.lit(1)))


def extract_hash_number(text: Column) -> Column:
    """The unsigned number after ``####``. A group holding only commas gives NULL."""
    digits = F.regexp_extract(text, HASH_NUMBER, 1)
    return F.replace(digits, F.lit(","), F.lit("")).try_cast("double")


def extract_gsm_prediction(text: Column) -> Column:
    """First box that yields a number, else the answer tag (whole number, then its last one)."""
    boxes = F.regexp_extract_all(text, F.lit(BOX_BODY), F.lit(1))
    numbers = F.transform(
        boxes, lambda box: F.coalesce(to_float(box), F.regexp_substr(box, F.lit(NUMBER)).try_cast("double"))
    )
    from_box = F.get(F.filter(numbers, lambda x: x.isNotNull()), F.lit(0))
    from_tag = let(
        tag_body(text),
        lambda body: F.coalesce(
            to_float(body),
            F.try_element_at(F.regexp_extract_all(body, F.lit(NUMBER), F.lit(0)), F.lit(-1)).try_cast("double"),
        ),
    )
    return F.coalesce(from_box, from_tag)


def _balanced_prefix(text: Column) -> Column:
    """Text up to the closing brace that brings the brace count to 0; NULL if none does.

    Boxes without an inner brace are cut by one regex. The others are folded over their
    brace-terminated pieces, not over single characters.
    """
    nothing = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("used"), F.lit(0).alias("cut"))

    def step(seen: Column, piece: Column) -> Column:
        change = F.when(piece.endswith("{"), 1).when(piece.endswith("}"), -1).otherwise(0)
        depth = seen["depth"] + change
        used = seen["used"] + F.length(piece)
        closed = (seen["cut"] == 0) & (depth == 0) & piece.endswith("}")
        return F.struct(
            depth.alias("depth"),
            used.alias("used"),
            F.when(closed, used).otherwise(seen["cut"]).alias("cut"),
        )

    def nested(s: Column) -> Column:
        cut = F.aggregate(F.split(s, r"(?<=[{}])"), nothing, step)["cut"]
        return let(cut, lambda n: F.when(n > 0, F.substring(s, F.lit(1), n)))

    return let(
        text, lambda s: F.coalesce(F.regexp_substr(s, F.lit(r"\A[^{}]*\{[^{}]*\}")), nested(s))
    )


def last_boxed(text: Column) -> Column:
    """The last box with its wrapper; whole text without a box; NULL for unbalanced braces."""

    def from_mark(mark: str) -> Column:
        return F.concat(F.lit(mark), F.substring_index(text, mark, -1))

    spaced = F.concat(F.lit(SPACED_BOX), F.substring_index(F.substring_index(text, SPACED_BOX, -1), "$", 1))
    return (
        F.when(text.contains(SPACED_BOX), spaced)
        .when(text.contains(BOX), _balanced_prefix(from_mark(BOX)))
        .when(text.contains(FRAMED_BOX), _balanced_prefix(from_mark(FRAMED_BOX)))
        .otherwise(text)
    )


def remove_boxed(box: Column) -> Column:
    """Content of a box. Other text is kept; a misplaced spaced box or NULL gives NULL."""

    def unwrap(s: Column) -> Column:
        braced = s.startswith(OPEN_BOX) & s.endswith("}")
        return (
            F.when(s.startswith(SPACED_BOX), F.substring(s, F.lit(len(SPACED_BOX) + 1), F.length(s)))
            .when(s.contains(SPACED_BOX), F.lit(None))
            .when(braced, F.substring(s, F.lit(len(OPEN_BOX) + 1), F.length(s) - len(OPEN_BOX) - 1))
            .otherwise(s)
        )

    return let(box, unwrap)


def extract_math_prediction(text: Column) -> Column:
    """E5: content of the last box; the first answer tag only if that is missing or empty."""
    return let(
        remove_boxed(last_boxed(text)),
        lambda boxed: F.when(boxed != "", boxed).otherwise(F.coalesce(tag_body(text), boxed)),
    )
