"""Normalisation and equality of competition-math answers.

The error cases of the normal form are carried as NULL: a step that cannot handle its input
gives NULL, and so does the whole chain.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rollscore.functions.text import SPACE, let, to_float

# Fixed values: (text, replacement) pairs in the order in which they apply.
BEFORE_UNITS = [
    ("\n", ""),
    ("\\!", ""),
    ("\\\\", "\\"),
    ("tfrac", "frac"),
    ("dfrac", "frac"),
    ("\\left", ""),
    ("\\right", ""),
    ("^{\\circ}", ""),
    ("^\\circ", ""),
    ("\\$", ""),
]
AFTER_UNITS = [("\\%", ""), (" .", " 0."), ("{.", "{0.")]
UNIT = "\\text{ "
HALF = ("0.5", "\\frac{1}{2}")
LONGEST_LEFT_SIDE = 2


def _replace_all(text: Column, pairs: list[tuple[str, str]]) -> Column:
    for old, new in pairs:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def drop_units(text: Column) -> Column:
    """Part before the unit mark; NULL if there is more than one."""
    return let(
        F.split(text, r"\\text\{ ", -1), lambda parts: F.when(F.size(parts) <= 2, parts[0])
    )


def brace_sqrt(text: Column) -> Column:
    """Put braces around the single character after a root; NULL if a root has nothing after it."""
    return let(
        text,
        lambda s: F.when(
            ~s.rlike(r"\\sqrt(?:\\sqrt|\z)"), F.regexp_replace(s, r"\\sqrt([^{])", r"\\sqrt{$1}")
        ),
    )


def brace_fracs(text: Column) -> Column:
    """Brace bare fraction operands.

    The first fraction with fewer than two operand characters decides: one character leaves
    the whole text as it was, none gives NULL.
    """
    short = r"\\frac([^{]?)(?=\\frac|\z)"

    def rewrite(s: Column) -> Column:
        half_braced = F.regexp_replace(s, r"\\frac([^{])\{", r"\\frac{$1}{")
        both = F.regexp_replace(half_braced, r"\\frac([^{])([^{])", r"\\frac{$1}{$2}")
        return (
            F.when(~s.rlike(short), both)
            .when(F.regexp_extract(s, short, 1) != "", s)
        )

    return let(text, rewrite)


def slash_to_frac(text: Column) -> Column:
    """Rewrite a fraction of two plain integers; NULL if a side of a lone slash is no integer."""
    plain = r"\A(0|-?[1-9][0-9]*)/(0|-?[1-9][0-9]*)\z"
    integer = SPACE + r"*[+-]?\p{Nd}+(?:_\p{Nd}+)*" + SPACE + r"*"

    def rewrite(s: Column) -> Column:
        return (
            F.when(~s.rlike(r"\A[^/]*/[^/]*\z"), s)
            .when(s.rlike(plain), F.regexp_replace(s, plain, r"\\frac{$1}{$2}"))
            .when(s.rlike(r"\A" + integer + "/" + integer + r"\z"), s)
        )

    return let(text, rewrite)


def _drop_left_side(text: Column) -> Column:
    """``k=5`` -> ``5`` for a single equals sign with a short left side."""
    short = r"(?s)\A[^=]{0,%d}=([^=]*)\z" % LONGEST_LEFT_SIDE
    return F.regexp_replace(text, short, "$1")


def normalize_math(text: Column) -> Column:
    """Normal form of an answer; NULL for NULL input or where normalisation fails."""
    cleaned = _replace_all(drop_units(_replace_all(text, BEFORE_UNITS)), AFTER_UNITS)
    led = F.regexp_replace(cleaned, r"\A\.", "0.")
    rooted = brace_sqrt(_drop_left_side(led))
    fractions = brace_fracs(F.replace(rooted, F.lit(" "), F.lit("")))
    halved = let(fractions, lambda s: F.when(s == HALF[0], F.lit(HALF[1])).otherwise(s))
    return slash_to_frac(halved)


def is_equiv(left: Column, right: Column) -> Column:
    """Equal normal forms; raw equality where either has none; two NULLs are equal."""

    def compare(pair: Column) -> Column:
        a, b = pair["a"], pair["b"]
        return (
            F.when(a.isNull() | b.isNull(), a.isNull() & b.isNull())
            .otherwise(F.coalesce(normalize_math(a) == normalize_math(b), a == b))
        )

    return let(F.struct(left.alias("a"), right.alias("b")), compare)


def is_close(left: Column, right: Column) -> Column:
    """E9 when one side is a number: absolute difference under 1e-6; unparsed is not close."""
    return F.coalesce(F.abs(to_float(left.cast("string")) - to_float(right.cast("string"))) < F.lit(1e-6), F.lit(False))
