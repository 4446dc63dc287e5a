"""First row per key, top-k per group: built so that no hot group lands in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from finchlab.session import stage_table


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Keep the first row of every key in `order` (which must be unique per key).

    An aggregate rather than a window: copies are reduced before the shuffle, so a text
    that makes up a third of all rows costs one row per map task. Rows are grouped and
    sorted by a digest of the key, never by the text itself. Nulls form one group.
    """
    rest = list(dict.fromkeys([*order, *df.columns]))
    digests = [F.coalesce(F.sha2(F.col(c).cast("string"), 256), F.lit("null")) for c in keys]
    best = df.groupBy(F.concat_ws("|", *digests).alias("_digest")).agg(F.min(F.struct(*rest)).alias("_first"))
    return best.select(*[F.col("_first")[c].alias(c) for c in df.columns])


def top_k_per_group(
    df: DataFrame,
    groups: Sequence[str],
    order: Sequence[Column],
    k: int,
    salt_by: Sequence[str],
    rank_column: str = "rank",
    salts: int = 1024,
) -> DataFrame:
    """The first `k` rows of every group, with their rank.

    A group is first cut to k rows within hashed slices of itself, so one task holds at
    most `salts` times k rows of it; for a large k see `newest_per_group`.
    """
    slices = F.pmod(F.xxhash64(*salt_by), F.lit(salts))
    window = Window.partitionBy(*groups, "_slice").orderBy(*order)
    df = (
        df.withColumn("_slice", slices)
        .withColumn("_r", F.row_number().over(window))
        .filter(F.col("_r") <= k)
        .drop("_r", "_slice")
    )
    window = Window.partitionBy(*groups).orderBy(*order)
    return df.withColumn(rank_column, F.row_number().over(window)).filter(
        F.col(rank_column) <= k
    )


def newest_per_group(
    df: DataFrame, group: str, time: str, key: str, cap: str, rank_column: str = "rank"
) -> DataFrame:
    """The newest rows of every group up to the group's own `cap`, with their rank.

    The time of the last row wanted is found from counts per day, then per moment of the
    day it falls on. Rows before it are filtered away, and only what is left is ranked:
    a task holds no more of a group than its cap and the ties of one moment. Ties go to
    the largest key; rows without a time are not ranked.
    """
    timed = df.filter(F.col(time).isNotNull())
    day = timed.withColumn("_day", F.to_date(time))

    def edge(counts: DataFrame, unit: str, before: Column) -> DataFrame:
        down = Window.partitionBy(group).orderBy(F.col(unit).desc())
        running = F.sum("_n").over(down.rowsBetween(Window.unboundedPreceding, 0)) + before
        placed = counts.withColumn("_upto", running)
        return placed.filter((F.col("_upto") >= F.col(cap)) & (F.col("_upto") - F.col("_n") < F.col(cap)))

    days = day.groupBy(group, cap, "_day").agg(F.count("*").alias("_n"))
    days = edge(days, "_day", F.lit(0)).select(group, "_day", (F.col("_upto") - F.col("_n")).alias("_before"))
    # one row per group, here and below: written first, so that its size decides the join
    days = stage_table(days, "edge-days")
    moments = day.join(days, [group, "_day"]).groupBy(group, cap, "_before", time).agg(F.count("*").alias("_n"))
    cuts = edge(moments, time, F.col("_before")).select(group, F.col(time).alias("_cut"))
    cuts = stage_table(cuts, "edge-moments")
    near = timed.join(cuts, group, "left").filter(F.col("_cut").isNull() | (F.col(time) >= F.col("_cut")))
    newest = Window.partitionBy(group).orderBy(F.col(time).desc(), F.col(key).desc())
    ranked = near.drop("_cut").withColumn(rank_column, F.row_number().over(newest))
    return ranked.filter(F.col(rank_column) <= F.col(cap))
