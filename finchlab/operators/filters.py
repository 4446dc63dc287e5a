"""Row filters and column shaping used by the corpus jobs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_category(df: DataFrame, category: str) -> DataFrame:
    return df.filter(F.col("account_category") == category)


def flagged_original(df: DataFrame) -> DataFrame:
    return df.filter(F.col("retweet") == 0)


def without_prefix(df: DataFrame, prefix: str = "RT ", column: str = "content") -> DataFrame:
    """Drops rows with the prefix, and rows whose text is null."""
    return df.filter(~F.col(column).startswith(prefix))


def in_language(df: DataFrame, language: str = "English") -> DataFrame:
    return df.filter(F.col("language") == language)


def labelled(df: DataFrame, value: int, column: str = "target") -> DataFrame:
    return df.withColumn(column, F.lit(value))


def renamed(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.toDF(*names)


def by_key(df: DataFrame, column: str, value) -> DataFrame:
    """Look one row up by its key; rows have no position."""
    return df.filter(F.col(column) == value)


def newer_than(df: DataFrame, column: str, since: int | None, upto: int | None = None) -> DataFrame:
    """Rows above the high-water mark `since` and, if given, at most `upto`."""
    if since is not None:
        df = df.filter(F.col(column) > since)
    if upto is not None:
        df = df.filter(F.col(column) <= upto)
    return df
