"""Bounded collection of arriving posts: so many per seed hashtag, then stop; resumed by the next run.

The state of a seed is what has been taken so far: rows, and the lowest and highest id. It
is read from the collected table, which is written batch by batch under the number of the
batch, so a batch that is run again starts from the same state and replaces its own rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from finchlab.functions import text as X
from finchlab.operators.lists import exploded
from finchlab.operators.ranking import top_k_per_group
from finchlab.session import stage_table
from finchlab.streaming.firsts import _exists


def collected_state(spark, target: str, key: str, before: int | None = None) -> DataFrame | None:
    """(seed, taken, lowest, highest) of all batches, or of those before one; None before the first."""
    if not _exists(spark, target):
        return None
    rows = spark.read.parquet(target)
    rows = rows if before is None else rows.filter(F.col("batch") < before)
    return rows.groupBy("seed").agg(
        F.count("*").alias("taken"), F.min(key).alias("lowest"), F.max(key).alias("highest")
    )


def take_batch(
    batch: DataFrame, batch_id: int, seeds: DataFrame, target: str, key: str, since: int | None, until: int | None
) -> None:
    """The rows of a batch that the seeds still have room for, lowest keys first.

    `seeds` is (seed, cap); hashtags match without regard to case. `since` and `until`
    are the least and the largest key wanted.
    """
    spark = batch.sparkSession
    if since is not None:
        batch = batch.filter(F.col(key) >= since)
    if until is not None:
        batch = batch.filter(F.col(key) <= until)
    state = collected_state(spark, target, key, batch_id)
    room = seeds.withColumn("room", F.col("cap"))
    if state is not None:
        room = seeds.join(state, "seed", "left").withColumn("room", F.col("cap") - F.coalesce("taken", F.lit(0)))
    room = stage_table(room.filter("room > 0").select("seed", "room"), "room")
    most = room.agg(F.max("room")).first()[0] or 0
    tags = F.array_distinct(F.transform(X.hashtags(F.col("content")), F.lower))
    columns = batch.columns
    room = room.withColumn("_tag", F.lower("seed"))
    tagged = exploded(batch, tags, "_tag", columns).join(room, "_tag").drop("_tag")
    # no seed has more room than `most`: a group is cut to that inside slices first
    ranked = top_k_per_group(tagged, ["seed"], [F.col(key)], most, salt_by=[key]) if most else tagged.withColumn("rank", F.lit(1))
    taken = ranked.filter(F.col("rank") <= F.col("room")).select("seed", *columns)
    taken.write.mode("overwrite").parquet(f"{target}/batch={batch_id}")


def collect_available(
    stream: DataFrame, seeds: DataFrame, folder: str, key: str = "post_id", since: int | None = None, until: int | None = None
) -> str:
    """Collect from everything that has landed since the last run; returns the folder of collected posts."""
    target = f"{folder}/collected"
    query = (
        stream.writeStream.foreachBatch(
            lambda batch, number: take_batch(batch, number, seeds, target, key, since, until)
        )
        .option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return target
