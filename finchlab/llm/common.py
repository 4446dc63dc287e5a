"""Input tables and lineage cutting shared by the operators."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from finchlab.session import checkpoint_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared checkpoint folder."""
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write once to the shared checkpoint folder and read back: cuts lineage, survives lost executors."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tagged(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, tag, text); `tag` tells rows of one id apart by a hash of their text, and is 0 elsewhere."""
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc"), F.col(text_col).alias("text"))
    ids = texts.filter("doc is not null").groupBy("doc").agg(F.count("*").alias("n"))
    ids = staged(ids.filter("n > 1").select("doc", F.lit(True).alias("again")), "repeated-ids")
    tag = F.when(F.col("again"), F.xxhash64("text")).otherwise(F.lit(0).cast("bigint")).alias("tag")
    return texts.join(ids, "doc", "left").select("doc", tag, "text")
