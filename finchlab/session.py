"""Session defaults, input spreading and lineage cutting."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(
    cores: int | str = "*", app: str = "finchlab", checkpoints: str | None = None
) -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own."""
    parallel = "8" if cores == "*" else str(cores)
    checkpoints = checkpoints or tempfile.mkdtemp(prefix=f"{app}-")
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", parallel)
        .config("spark.checkpoint.dir", checkpoints)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        # HotSpot does not compile methods above 8000 bytes; long text expressions
        # run faster operator by operator than in one generated method beyond that
        .config("spark.sql.codegen.hugeMethodLimit", "8000")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


# a split may hold this many times the rows of a fair share per core
UNEVEN = 2


def spread(df: DataFrame, key: str) -> DataFrame:
    """Give a CPU-heavy stage enough tasks when the rows lie in too few splits.

    A file is cut into splits by its length, but its rows come by row group: a large
    file with one row group has many splits of which a single one holds rows. So rows
    are counted per split (no column is read). An input whose rows are spread already
    is returned as it is, without a shuffle; any other is hashed on its unique key.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    splits = df.rdd.getNumPartitions()
    if splits >= cores:
        held = [r["n"] for r in df.groupBy(F.spark_partition_id().alias("at")).agg(F.count("*").alias("n")).collect()]
        if max(held, default=0) * cores <= UNEVEN * sum(held):
            return df
    return df.repartition(max(cores, splits), key)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by the cluster; a temporary one only in local mode."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named:
        return named
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="finchlab-"))
    return context.getCheckpointDir()


def stage_table(
    df: DataFrame, name: str = "stage", partition_by: Sequence[str] = ()
) -> DataFrame:
    """Write `df` as Parquet in the shared folder and read it back.

    Cuts the lineage, survives lost executors and keeps column pruning, which a
    row-wise checkpoint would lose.
    """
    path = f"{checkpoint_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).select(*df.columns)


def sized(df: DataFrame, rows_per_task: int = 2_500) -> DataFrame:
    """A stage table with no more tasks than its rows are worth, for iterative fits.

    A fit runs many short jobs over the same table; with few rows per task they
    spend their time on scheduling. A large table is returned as it is.
    """
    tasks = max(1, -(-df.count() // rows_per_task))
    return df.coalesce(tasks) if tasks < df.rdd.getNumPartitions() else df


def checkpointed(df: DataFrame) -> DataFrame:
    """Reliable checkpoint for iterative jobs whose plan grows every round."""
    context = df.sparkSession.sparkContext
    folder = checkpoint_dir(df.sparkSession)
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return df.checkpoint(eager=True)
