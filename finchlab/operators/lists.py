"""Turning list columns into rows and into n-grams."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from finchlab.functions import text as X


def exploded(df: DataFrame, items: Column, name: str, carry: Sequence[str] = ()) -> DataFrame:
    """One row per non-null item.

    A plain explode makes the optimizer test the list before exploding it, which
    computes an expensive list twice; the outer form with a filter does not.
    """
    return df.select(*carry, F.explode_outer(items).alias(name)).filter(F.col(name).isNotNull())


def _only(words: Column, kept: Sequence[str]) -> Column:
    """Null in place of other words."""
    return F.transform(words, lambda w: F.when(w.isin(list(kept)), w))


def with_ngrams(
    df: DataFrame,
    words: Column,
    longest: int,
    name: str,
    first: Sequence[str] | None = None,
    every: Sequence[str] | None = None,
) -> DataFrame:
    """Add all 1..`longest`-grams of a word list as column `name`; with `first`, those that begin with such a word.

    With `every`, which holds all of `first`, only those of which every word is one of them.
    Every length is a column of its own, so no list is computed more than once.
    """
    if longest == 1 and first is None:
        return df.withColumn(name, F.array_compact(words))
    kept = df.columns
    steps = [f"_{name}{n}" for n in range(1, longest + 1)]
    listed = f"_{name}"
    # a null word makes every n-gram over it null
    df = df.withColumn(listed, words if every is None else _only(words, every))
    begin = F.col(listed)
    if first is not None and (every is None or set(first) != set(every)):
        begin = _only(begin, first)
    df = df.withColumn(steps[0], begin)
    for n in range(2, longest + 1):
        longer = X.longer_grams(F.col(listed), F.col(steps[n - 2]), n)
        df = df.withColumn(steps[n - 1], longer)
    return df.select(*kept, F.array_compact(F.concat(*steps)).alias(name))
