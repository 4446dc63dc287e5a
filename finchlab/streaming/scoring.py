"""Scoring a stream of posts with a fitted pipeline."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame

from finchlab.plans.models import score


def score_available(
    model: PipelineModel, posts: DataFrame, target: str, checkpoint: str, keep: list[str]
) -> None:
    """Score all landed posts of a stream into a table, one folder `batch=n` per micro-batch.

    A micro-batch is scored like a batch, so a pipeline may join a dictionary. Its folder
    is overwritten when a failed micro-batch is run again.
    """

    def scored(batch: DataFrame, number: int) -> None:
        out = score(model, batch).select(*keep, "prediction", "y_pred_proba")
        out.write.mode("overwrite").parquet(f"{target}/batch={number}")

    query = (
        posts.writeStream.foreachBatch(scored)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
