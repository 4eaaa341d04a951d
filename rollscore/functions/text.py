"""Small text helpers shared by answer extraction, normalisation and rewards."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters str.strip() removes, as one literal and as a Java regex class.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
SPACE = r"[\s\x1c-\x1f\x85\p{Z}]"

# The spellings float() accepts, after stripping.
FLOAT = (
    r"\A[+-]?(?:\d+(?:_\d+)*(?:\.(?:\d+(?:_\d+)*)?)?|\.\d+(?:_\d+)*)"
    r"(?:[eE][+-]?\d+(?:_\d+)*)?\z"
)
INFINITE = r"(?i)\A[+-]?inf(?:inity)?\z"
NOT_A_NUMBER = r"(?i)\A[+-]?nan\z"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times in ``body``.

    Chained rewrites that mention their input more than once would otherwise double the
    expression tree at each step.
    """
    return F.transform(F.array(value), body)[0]


def strip(text: Column) -> Column:
    """Drop leading and trailing Unicode whitespace."""
    return F.btrim(text, F.lit(WHITESPACE))


def to_float(text: Column) -> Column:
    """Parse text as a double the way ``float()`` does; NULL where it would raise."""

    def parse(s: Column) -> Column:
        return (
            F.when(s.rlike(FLOAT), F.replace(s, F.lit("_"), F.lit("")).try_cast("double"))
            .when(s.rlike(INFINITE), F.when(s.startswith("-"), F.lit(float("-inf"))).otherwise(F.lit(float("inf"))))
            .when(s.rlike(NOT_A_NUMBER), F.lit(float("nan")))
        )

    return let(strip(text), parse)


def occurrences(text: Column, token: str) -> Column:
    """How often ``token`` occurs in ``text``, counted without overlap."""
    dropped = F.length(F.replace(text, F.lit(token), F.lit("")))
    return ((F.length(text) - dropped) / F.lit(len(token))).cast("int")


def tag_body(text: Column) -> Column:
    """Stripped text of the first ``<answer>..</answer>`` (across lines); NULL if there is none."""
    whole = F.regexp_substr(text, F.lit(r"(?s)<answer>.*?</answer>"))
    inner = F.regexp_replace(whole, r"\A<answer>|</answer>\z", "")
    return strip(inner)
