"""Column expressions shared by the operators. All are built-in functions: no Python UDFs."""

from __future__ import annotations

import os
import zipfile
from functools import cache
from pathlib import Path

import pyspark
from pyspark.sql import Column
from pyspark.sql import functions as F

CANONICAL_START, CANONICAL_END = "2024-01-01", "2024-03-31"


def clip(x: Column, low: float | None = None, high: float | None = None) -> Column:
    """Into [low, high]; null stays null, which greatest and least alone would turn into a bound."""
    y = x
    if high is not None:
        y = F.least(y, F.lit(high))
    if low is not None:
        y = F.greatest(y, F.lit(low))
    return F.when(x.isNotNull(), y)


def difficulty_level(difficulty: Column, otherwise: float | None = None) -> Column:
    """Beginner, Intermediate, Advanced -> 1, 2, 3."""
    level = F.when(difficulty == "Beginner", 1).when(difficulty == "Intermediate", 2).when(difficulty == "Advanced", 3)
    return level if otherwise is None else level.otherwise(otherwise)


def experience_level(courses: Column) -> Column:
    return F.when(courses < 5, "Beginner").when(courses < 15, "Intermediate").otherwise("Advanced")


def performance_tier(score: Column) -> Column:
    return F.when(score < 60, "Low").when(score < 80, "Medium").otherwise("High")


def stable_fraction(*parts: Column | str) -> Column:
    """A number in [0, 1] that depends on the parts alone: the first 32 bits of their MD5 over 2**32 - 1."""
    text = F.concat_ws("|", *[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long") / F.lit(4294967295.0)


def half_even(x: Column) -> Column:
    """Rounded to whole numbers, halves to the even one."""
    return F.bround(x).cast("int")


def spread_date(lower: Column, upper: Column, *parts: Column | str) -> Column:
    """A date that the parts choose within [lower, upper], both held within the canonical quarter. Null bounds are the quarter's."""
    start, end = F.lit(CANONICAL_START).cast("date"), F.lit(CANONICAL_END).cast("date")
    low = F.greatest(F.coalesce(lower, start), start)
    high = F.greatest(F.least(F.coalesce(upper, end), end), low)
    return F.date_add(low, half_even(stable_fraction(*parts) * F.datediff(high, low)))


def tercile(x: Column, low: Column, high: Column) -> Column:
    """Low, Medium, High by two edges; a value on an edge belongs below it."""
    return F.when(x <= low, "Low").when(x <= high, "Medium").otherwise("High")


def true_or_false(x: Column) -> Column:
    """A predicate in which unknown counts as false."""
    return F.coalesce(x, F.lit(False))


@cache
def english_stop_words() -> list[str]:
    """The English stop words that Spark ML ships for its StopWordsRemover, read from its library, so that no session is needed."""
    homes = [Path(pyspark.__file__).parent, *(Path(x) for x in [os.environ.get("SPARK_HOME")] if x)]
    library = next(jar for home in homes for jar in home.glob("jars/spark-mllib_*.jar"))
    with zipfile.ZipFile(library) as z:
        return z.read("org/apache/spark/ml/feature/stopwords/english.txt").decode().split()


def tokens(text: Column, stop_words: list[str]) -> Column:
    """Lower-case runs of at least two letters, digits or underscores, without stop words."""
    found = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))
    return F.filter(found, lambda t: ~t.isin(stop_words)) if stop_words else found
