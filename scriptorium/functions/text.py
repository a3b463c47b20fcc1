"""Column functions on text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.functions import rules as R


def let(c: Column, body: Callable[[Column], Column]) -> Column:
    """body(c), with c computed once however often the body names it."""
    return F.get(F.transform(F.array(c), body), F.lit(0))


def each(df: DataFrame, keys: list[str], array: Column, name: str = "x", pos: str | None = None) -> DataFrame:
    """(keys, name[, pos]) of each item of an array; pos counts from 1. Items are not null.

    The outer explode is kept from being told beforehand which rows have items: the array would be computed a second
    time for that, before any exchange that lies below.
    """
    if pos is None:
        return df.select(*keys, F.explode_outer(array).alias(name)).where(F.col(name).isNotNull())
    out = df.select(*keys, F.posexplode_outer(array).alias(pos, name)).where(F.col(pos).isNotNull())
    return out.withColumn(pos, F.col(pos) + 1)


def strip(c: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(c, R.STRIP, "")


def measured(c: Column) -> Column:
    """A sentence without citations, note marks, emphasis, punctuation and white space."""
    c = F.regexp_replace(F.regexp_replace(c, R.CITATION_PLAIN, ""), R.NOTE_ANY, "")
    return F.regexp_replace(F.regexp_replace(c, r"\*\*|`", ""), R.PUNCT, "")


def uncited(c: Column) -> Column:
    """Text without citation and note marks."""
    return F.regexp_replace(c, f"{R.CITATION_PLAIN}|{R.NOTE_ANY}", "")


def literal_count(c: Column, phrase: str) -> Column:
    """How often a phrase occurs, without overlaps."""
    return ((F.length(c) - F.length(F.replace(c, F.lit(phrase), F.lit("")))) / len(phrase)).cast("int")


def matches(c: Column, pattern: str) -> Column:
    """How many matches a pattern has."""
    return F.regexp_count(c, F.lit(pattern))
