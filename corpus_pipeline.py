"""The corpus pipeline: quality rules, exact and near duplicates, source mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next one's input. All but the last return the columns of
`documents`. A stage works on every row the one before kept:

* `quality` keeps the rows that pass the base rules and the divergence rules;
* `exact` keeps one row of each group of equal texts, the one with the smallest id;
* `near` keeps one document of each group of near duplicates, the one with the smallest id;
* `mix` repeats rows so that sources reach their target weights, and shuffles them;
* `pack` cuts the tokens of all rows into windows and returns one row per piece.

SQL cannot express the tokenizer of the last stage, so there is no oracle SQL; tests
compare the stages with brute-force versions.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from finchlab.llm import exact_dedup, mixing, near_dedup, packing, quality
from finchlab.llm.common import new_folder, table

ORACLE_SQL = None


def whole(docs: DataFrame, *columns: str) -> DataFrame:
    """The columns an operator reads, and the row itself: none of its columns can clash with a result."""
    return docs.select(*columns, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.judged(whole(docs, "text", "lang")).filter("kept").select("_row.*")


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_copies(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.drop_near_copies(docs)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.replicated(whole(docs, "doc_id", "source")).select("_row.*")


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    pieces = packing.packed(docs, public_tokenizers.path("word_bpe_49k.json"))
    return pieces.withColumnRenamed("doc", "doc_id")


STAGES = [
    ("quality", quality_stage),
    ("exact", exact_stage),
    ("near", near_stage),
    ("mix", mix_stage),
    ("pack", pack_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = new_folder(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.schema(out.schema).parquet(f"{folder}/{k}-{name}")
    return docs
