"""Mergeable summaries per day: distinct texts or authors, and frequent hashtags, of any range of days.

The posts are read once; a day is one row, and a range of days merges its rows. Sizes do
not depend on the number of posts: a HyperLogLog sketch has 2**`precision` registers and a
relative standard error of 1.04 / sqrt(2**precision); a frequent-items sketch follows at
most `tracked` items, and is exact while a range holds no more of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from finchlab.functions import patterns as P
from finchlab.functions import text as X
from finchlab.operators.lists import exploded

PRECISION = 12
TRACKED = 4096


def relative_error(precision: int = PRECISION) -> float:
    """One standard error of a distinct count."""
    return 1.04 / 2 ** (precision / 2)


def daily_sketches(posts: DataFrame, precision: int = PRECISION, tracked: int = TRACKED) -> DataFrame:
    """(day, posts, authors, texts, hashtags): one row per day, the last three are sketches. Posts without a date have none."""
    dated = posts.filter(F.col("publish_date").isNotNull()).withColumn("day", F.to_date("publish_date"))
    counts = dated.groupBy("day").agg(
        F.count("*").alias("posts"),
        F.hll_sketch_agg("author", F.lit(precision)).alias("authors"),
        F.hll_sketch_agg(F.sha2("content", 256), F.lit(precision)).alias("texts"),
    )
    tags = exploded(dated, X.matches(F.col("content"), P.HASHTAG), "hashtag", ["day"])
    items = tags.groupBy("day").agg(F.expr(f"approx_top_k_accumulate(hashtag, {int(tracked)})").alias("hashtags"))
    return counts.join(items, "day", "left")


def in_range(sketches: DataFrame, groups: list[Column], tracked: int = TRACKED, top: int = 10) -> DataFrame:
    """Per group of days: posts, estimated authors and texts, and the most frequent hashtags with their counts."""
    return sketches.groupBy(*groups).agg(
        F.sum("posts").alias("posts"),
        F.hll_sketch_estimate(F.hll_union_agg("authors")).alias("authors"),
        F.hll_sketch_estimate(F.hll_union_agg("texts")).alias("texts"),
        F.expr(f"approx_top_k_estimate(approx_top_k_combine(hashtags, {int(tracked)}), {int(top)})").alias("hashtags"),
    )
