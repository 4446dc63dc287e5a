"""File sources. Splits of the file scan replace hand-made chunking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from finchlab.schemas import POSTS, RAW_LABELLED_POSTS

TIMESTAMP = "yyyy-MM-dd HH:mm:ss"


def read_csv(
    spark: SparkSession,
    path: str | list[str],
    schema: T.StructType,
    timestamp_format: str = TIMESTAMP,
    multi_line: bool = False,
) -> DataFrame:
    """CSV with a header and an explicit schema, columns matched by position.

    By default a post is one line, and large files are split between tasks. Files
    whose quoted fields hold line breaks need `multi_line=True`; such a file cannot be
    split, so keep those moderate in size.
    """
    return (
        spark.read.schema(schema)
        .option("header", True)
        .option("multiLine", multi_line)
        .option("escape", '"')
        .option("timestampNTZFormat", timestamp_format)
        .csv(path)
    )


def read_labelled(
    spark: SparkSession,
    path: str | list[str],
    timestamp_format: str = "M/d/yyyy H:mm",
    multi_line: bool = False,
) -> DataFrame:
    """Raw labelled posts from any number of files; `src_file` and `src_row` order them."""
    return _with_source_order(
        read_csv(spark, path, RAW_LABELLED_POSTS, timestamp_format, multi_line)
    )


def read_control(
    spark: SparkSession,
    folder: str,
    first_file: str,
    multi_line: bool = False,
) -> DataFrame:
    """All crawler CSVs directly in `folder`; sub-folders are not read.

    Columns are named by the header, which must be the same in all files, and
    stay strings. `src_first` is 0 for the rows of `first_file`, which win over
    their copies.
    """
    posts = (
        spark.read.option("header", True)
        .option("enforceSchema", False)
        .option("multiLine", multi_line)
        .option("escape", '"')
        .option("pathGlobFilter", "*.csv")
        .csv(folder)
    )
    return _with_source_order(posts).withColumn(
        "src_first", F.when(F.col("src_file").endswith("/" + first_file), 0).otherwise(1)
    )


def _with_source_order(posts: DataFrame) -> DataFrame:
    """File name plus a row number that grows within a file.

    The row id is the task index and the position within the task, so it keeps
    file order for a given set of files. Write the result as a table before
    relying on it in more than one job.
    """
    return posts.select(
        "*",
        F.col("_metadata.file_path").alias("src_file"),
        F.col("_metadata.file_block_start").alias("src_block"),
        F.monotonically_increasing_id().alias("src_row"),
    )


SOURCE_ORDER = ["src_file", "src_block", "src_row"]
CONTROL_ORDER = ["src_first", *SOURCE_ORDER]


def read_posts(
    spark: SparkSession, path: str | list[str], timestamp_format: str = TIMESTAMP, multi_line: bool = False
) -> DataFrame:
    """The unified corpus from CSV."""
    return read_csv(spark, path, POSTS, timestamp_format, multi_line)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A stage table written by `write_table`."""
    return spark.read.parquet(path)


def single_post(spark: SparkSession, text: str) -> DataFrame:
    """One unlabelled post as a table; its key, 0, lets words be looked up in a dictionary."""
    return spark.createDataFrame([(None, text, None, None)], schema=POSTS).withColumn("post_id", F.lit(0))
