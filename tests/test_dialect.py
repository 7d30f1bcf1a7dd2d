import pytest
from pyspark.sql import functions as F

from webquarry.functions import dialect, values


def matches(spark, pattern, text):
    row = spark.createDataFrame([(text,)], "t string").select(F.regexp_extract_all("t", F.lit(dialect.java(pattern)), F.lit(0)).alias("m")).first()
    return row["m"]


@pytest.mark.parametrize(
    "pattern, text, found",
    [
        (r"\bab\b", "éab ab", ["ab", "ab"]),
        (r"ab$", "ab\n", []),
        (r"a.b", "a\rb a\nb", ["a\rb"]),
        (r"a\sb", "a\x0bb a b", ["a b"]),
        (r"[^\s]+", "a\x0bb c", ["a\x0bb", "c"]),
        (r"(?i)k", "kK", ["k", "K"]),
        (r"(?P<a_b>x)y", "xy", ["xy"]),
        (r"[a[]+", "a[a", ["a[a"]),
        (r"[a&&b]+", "a&b", ["a&b"]),
        (r"[[:alpha:]]+", "ab1", ["ab"]),
        (r"\x{4e00}", "一", ["一"]),
        (r"a{,2}", "a{,2}", ["a{,2}"]),
    ],
)
def test_as_in_re2(spark, pattern, text, found):
    assert matches(spark, pattern, text) == found


@pytest.mark.parametrize("pattern", ["(?=a)", "(?!a)", "(?<=a)b", r"(a)\1", "a{1001}", "(a", "a)", "[a", "a**", "*a", "a\\", "(?>a)"])
def test_refused(pattern):
    with pytest.raises(dialect.PatternError):
        dialect.java(pattern)


def test_all_rules_translate_and_keywords_are_necessary():
    for _, _, _, pattern in values.RULES:
        assert dialect.java(pattern)
    assert dialect.keywords(r"\b(?:AKLT|AKTP)[a-z]{3}") is None or "aklt" in dialect.keywords(r"\b(?:AKLT|AKTP)[a-z]{3}")
    assert dialect.keywords("a|bcd") is None
    assert dialect.keywords("(?:abc|xyz)+q") == ["abc", "xyz"]
