"""Table, CSV and model sinks."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame

from finchlab.sources.readers import TIMESTAMP


def write_table(df: DataFrame, path: str, partition_by: list[str] = ()) -> None:
    """Typed stage table (Parquet)."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_csv(df: DataFrame, path: str, timestamp_format: str = TIMESTAMP, mode: str = "overwrite") -> None:
    """CSV folder with header, no row index."""
    (
        df.write.mode(mode)
        .option("header", True)
        .option("escape", '"')
        .option("timestampNTZFormat", timestamp_format)
        .option("timestampFormat", timestamp_format)
        .csv(path)
    )


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
