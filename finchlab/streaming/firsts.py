"""First copies of arriving texts, by an index of digests that grows with each batch.

The index is a table of digests, partitioned by their first two characters. A micro-batch
is first reduced to one row per text; of the index only the partitions that the batch
touches are read. Batches are written under their number, so a batch that is run again
replaces its own rows: a rerun after a failure neither repeats nor loses a text.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from finchlab.operators.ranking import first_per_key
from finchlab.session import stage_table

PREFIX = 2


def _exists(spark, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def known_digests(spark, index: str, batch_id: int, prefixes: Sequence[str]) -> DataFrame | None:
    """Digests of earlier batches with one of the prefixes; None where there are none yet."""
    if not _exists(spark, index):
        return None
    rows = spark.read.schema("digest string, batch long, prefix string").parquet(index)
    return rows.filter((F.col("batch") < batch_id) & F.col("prefix").isin(list(prefixes))).select("digest")


def add_batch(batch: DataFrame, batch_id: int, index: str, target: str, key: str, order: Sequence[str]) -> None:
    """The first copies of a batch that no earlier batch holds, appended to `target` and the index."""
    spark = batch.sparkSession
    first = first_per_key(batch, [key], order)
    digest = F.coalesce(F.sha2(F.col(key), 256), F.lit("null"))
    first = first.withColumn("digest", digest).withColumn("prefix", F.substring("digest", 1, PREFIX))
    first = stage_table(first, "batch-firsts")
    prefixes = [r["prefix"] for r in first.select("prefix").distinct().collect()]  # at most 257
    known = known_digests(spark, index, batch_id, prefixes)
    new = first if known is None else first.join(known, "digest", "left_anti")
    new = stage_table(new, "batch-new")
    rows = new.select("digest", F.lit(batch_id).cast("long").alias("batch"), "prefix")
    new.drop("digest", "prefix").write.mode("overwrite").parquet(f"{target}/batch={batch_id}")
    (
        rows.repartition("prefix")
        .write.partitionBy("batch", "prefix")
        .option("partitionOverwriteMode", "dynamic")
        .mode("overwrite")
        .parquet(index)
    )


def first_copies_available(stream: DataFrame, folder: str, key: str, order: Sequence[str]) -> str:
    """Add everything that has landed since the last run; returns the folder of first copies."""
    target = f"{folder}/firsts"
    query = (
        stream.writeStream.foreachBatch(
            lambda batch, number: add_batch(batch, number, f"{folder}/index", target, key, order)
        )
        .option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return target
