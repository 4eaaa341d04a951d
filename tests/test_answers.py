"""Expected values per extraction function; each row is a case that is easy to get wrong."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from rollscore.functions import answers, mathnorm, text


def evaluate(spark, expression, values):
    """The expression over one string column, in the order of the given values."""
    rows = spark.createDataFrame(list(enumerate(values)), "i int, v string")
    return [r.out for r in rows.select("i", expression(F.col("v")).alias("out")).orderBy("i").collect()]


def check(spark, expression, cases):
    found = evaluate(spark, expression, [given for given, _ in cases])
    for (given, wanted), got in zip(cases, found):
        same = got == wanted or (isinstance(got, float) and isinstance(wanted, float) and math.isnan(got) and math.isnan(wanted))
        assert same, (given, wanted, got)


def test_strip(spark):
    check(spark, text.strip, [
        ("  a b\n", "a b"), ("\u00a0x\u2003", "x"), ("\x1cx\x1f", "x"), ("\u200bx", "\u200bx"), ("\ufeffx", "\ufeffx"),
        (" \n ", ""), ("", ""),
    ])


def test_to_float(spark):
    check(spark, text.to_float, [
        ("42", 42.0), (" 1.5 ", 1.5), ("1.", 1.0), (".5", 0.5), ("+3", 3.0), ("1e5", 1e5), ("1_000", 1000.0),
        ("1__0", None), ("_1", None), ("1d", None), ("1f", None), ("0x10", None), ("", None), ("1,234", None),
        ("inf", math.inf), ("-Infinity", -math.inf), ("nan", math.nan), ("-NaN", math.nan), ("1e", None),
    ])


def test_extract_xml_answer(spark):
    check(spark, answers.extract_xml_answer, [
        ("<answer>42</answer>", "42"),
        ("<answer>1</answer><answer> 2 </answer> tail", "2"),
        ("no tags ", "no tags"),
        ("a</answer>b<answer>c", "c"),
        ("a</answer>b", "a"),
        ("", ""),
    ])


def test_extract_hash_answer(spark):
    check(spark, answers.extract_hash_answer, [
        ("w #### 5 #### 6", "5"), ("none", None), ("####", ""), ("a####1,234", "1,234"), ("#####3", "#3"),
    ])


def test_extract_hash_number(spark):
    check(spark, answers.extract_hash_number, [
        ("Work. #### 1,234", 1234.0), ("#### $5.50", 5.5), ("#### -5", None), ("#### ,", None), ("x", None),
        ("#### -1 #### 7", 7.0), ("####\n12", 12.0),
    ])


def test_extract_gsm_prediction(spark):
    check(spark, answers.extract_gsm_prediction, [
        (r"<answer>\boxed{42}</answer>", 42.0),
        ("<answer>-3</answer>", -3.0),
        ("No answer", None),
        (r"\boxed{...} \boxed{x=5 or 3}", 5.0),
        (r"\boxed{} \boxed{7}", 7.0),
        (r"\boxed{1,234}", 1.0),
        ("<answer>1,234</answer>", 234.0),
        (r"\boxed{\frac{1}{2}}", 1.0),
        ("<answer>about 5 of 3, so 8</answer>", 8.0),
        ("<answer>one\n9</answer>", 9.0),
        ("\\boxed{a\nb}<answer>4</answer>", 4.0),
        (r"\boxed{nothing}<answer>4</answer><answer>5</answer>", 4.0),
        ("<answer>4", None),
        (r"\boxed{nan}<answer>4</answer>", math.nan),
        ("<answer></answer><answer>5</answer>", None),
    ])


def test_last_boxed(spark):
    check(spark, answers.last_boxed, [
        (r"a \boxed{1} b \boxed{\frac{1}{2}} c", r"\boxed{\frac{1}{2}}"),
        (r"\boxed 5$ end", r"\boxed 5"),
        (r"\boxed 5$ and \boxed{6}", r"\boxed 5"),
        (r"\boxed 5$ and \boxed 6 x", r"\boxed 6 x"),
        (r"\fbox{3}", r"\fbox{3}"),
        (r"\fbox{3} \boxed{4}", r"\boxed{4}"),
        ("plain", "plain"),
        (r"\boxed{1", None),
        (r"\boxed}{1}", None),
        (r"\boxed}{{a}}", r"\boxed}{{a}"),
        (r"\boxed{a{b}{c{d}}}e}", r"\boxed{a{b}{c{d}}}"),
        (r"\boxed", None),
        ("", ""),
    ])


def test_remove_boxed(spark):
    check(spark, answers.remove_boxed, [
        (r"\boxed{12}", "12"), (r"\boxed 12", "12"), (r"x \boxed 12", None), (r"\fbox{3}", r"\fbox{3}"),
        (r"\boxed{12", r"\boxed{12"), ("x", "x"), (None, None), (r"\boxed{}", ""),
    ])


def test_extract_math_prediction(spark):
    check(spark, answers.extract_math_prediction, [
        (r"\boxed{\frac{1}{2}}", r"\frac{1}{2}"),
        (r"\boxed{}<answer> 5 </answer>", "5"),
        (r"\boxed{1<answer>5</answer>", "5"),
        ("just <answer>5</answer>", "just <answer>5</answer>"),
        (r"\boxed{}", ""),
        (r"\boxed{", None),
        (r"\boxed{<answer></answer>", ""),
    ])


def test_normalisation_steps(spark):
    check(spark, mathnorm.drop_units, [("3\\text{ cm}", "3"), ("a\\text{ b}\\text{ c}", None), ("x", "x")])
    check(spark, mathnorm.brace_sqrt, [
        (r"\sqrt3x", r"\sqrt{3}x"), (r"\sqrt{3}", r"\sqrt{3}"), (r"\sqrt", None), (r"\sqrt\sqrt3", None),
        (r"\sqrt2+\sqrt3", r"\sqrt{2}+\sqrt{3}"), ("x", "x"), ("\\sqrt\U0001d7db2", "\\sqrt{\U0001d7db}2"),
    ])
    check(spark, mathnorm.brace_fracs, [
        (r"\frac12", r"\frac{1}{2}"), (r"\frac1{72}", r"\frac{1}{72}"), (r"\frac{72}1", r"\frac{72}1"),
        (r"\frac1", r"\frac1"), (r"\frac", None), (r"\frac\frac12", None), (r"\frac1\frac", r"\frac1\frac"),
        (r"\frac12+\frac34x", r"\frac{1}{2}+\frac{3}{4}x"), (r"a\fracab c", r"a\frac{a}{b} c"), ("x", "x"),
        (r"\frac12\frac", None),
    ])
    check(spark, mathnorm.slash_to_frac, [
        ("1/2", r"\frac{1}{2}"), ("-1/2", r"\frac{-1}{2}"), ("+1/2", "+1/2"), ("01/2", "01/2"), ("x/2", None),
        ("1/2/3", "1/2/3"), ("1/", None), ("-0/3", "-0/3"), ("0/3", r"\frac{0}{3}"), ("1_0/3", "1_0/3"), ("a", "a"),
        ("/", None),
    ])


def test_normalize_math(spark):
    check(spark, mathnorm.normalize_math, [
        (r"\dfrac12", r"\frac{1}{2}"), ("0.5", r"\frac{1}{2}"), (".5", r"\frac{1}{2}"), ("x = 5", "5"), ("xyz = 5", "xyz=5"),
        (r"\left(1,\! 2\right)", "(1,2)"), (r"90^\circ", "90"), (r"90^{\circ}", "90"), (r"\$5", "5"), (r"50\%", "50"),
        ("", ""), ("a=b=c", "a=b=c"), ("x/2", None), (r"\text{ a}\text{ b}", None), ("{.5}", "{0.5}"),
        ("=5", "5"), ("a\nb", "ab"), (None, None), (r"\\frac{1}{2}", r"\frac{1}{2}"), ("1 /2", r"\frac{1}{2}"),
    ])


@pytest.mark.parametrize(
    ("left", "right", "wanted"),
    [
        (r"\frac{1}{2}", "0.5", True), ("1/2", r"\dfrac{1}{2}", True), ("x/2", "x/2", True), ("x/2", "y/2", False),
        ("x/2", r"\frac{x}{2}", False), (None, None, True), (None, "1", False), ("1", None, False), ("", "", True),
        ("5", "x=5", True), (r"\sqrt", r"\sqrt", True),
    ],
)
def test_is_equiv(spark, left, right, wanted):
    row = spark.createDataFrame([(left, right)], "a string, b string")
    assert row.select(mathnorm.is_equiv(F.col("a"), F.col("b")).alias("e")).first().e is wanted


def test_whole_long_texts(spark):
    """Nested boxes after a long text, with many braces, are read to their end."""
    long_box = "\\boxed{" + "{a}" * 5000 + "z}"
    given = "word " * 20000 + long_box + " tail"
    assert evaluate(spark, answers.last_boxed, [given]) == [long_box]
    assert evaluate(spark, answers.extract_xml_answer, ["x " * 50000 + "<answer>7</answer>"]) == ["7"]
