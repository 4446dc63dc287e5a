"""Connected components of a table of links, each named by its smallest member."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from finchlab.llm.common import staged
from finchlab.llm.words import mix

EDGES = "x bigint, y bigint"


def _forest(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union-find over one block of links: every node but the smallest, linked to the smallest."""
    nodes, ends = np.unique(np.concatenate((x, y)), return_inverse=True)
    parent = list(range(len(nodes)))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    half = len(x)
    for i, j in zip(ends[:half].tolist(), ends[half:].tolist(), strict=True):
        a, b = find(i), find(j)
        if a != b:
            parent[max(a, b)] = min(a, b)
    root = np.array([find(i) for i in range(len(nodes))], dtype=np.int64)
    moved = root != np.arange(len(nodes))
    return nodes[root[moved]], nodes[moved]


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            x, y = _forest(batch.column(0).to_numpy(), batch.column(1).to_numpy())
            yield pa.record_batch([pa.array(x), pa.array(y)], names=["x", "y"])


def _relabelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids as labels in a random order (a bijection), so that no chain of ids is a chain of labels."""
    for batch in batches:
        columns = [pa.array(mix(c.to_numpy().view(np.uint64)).view(np.int64)) for c in batch.columns]
        yield pa.record_batch([*columns, *batch.columns], names=["lx", "ly", "x", "y"])


def connected_components(links: DataFrame) -> DataFrame:
    """(doc, component) of every document that has a link; the component is its smallest document.

    A round sends each label to the smallest label next to it, twice over, and rewrites
    the links by that map, until no link joins two labels. A map inside components keeps
    them connected and apart, so what is left is one label each. Labels are in random
    order, so rounds grow with the logarithm of the longest chain. The links of a task
    are first thinned to a forest: a dense group costs no more than its members.
    """
    edges = links.select(F.col("x").cast("bigint"), F.col("y").cast("bigint")).filter("x <> y")
    edges = edges.mapInArrow(_contracted, EDGES).mapInArrow(_relabelled, "lx bigint, ly bigint, x bigint, y bigint")
    edges = staged(edges, "edges")
    named = edges.select(F.inline(F.array(
        F.struct(F.col("x").alias("doc"), F.col("lx").alias("label")),
        F.struct(F.col("y").alias("doc"), F.col("ly").alias("label")),
    ))).distinct()
    named = staged(named, "labels")
    edges = edges.select(F.col("lx").alias("x"), F.col("ly").alias("y"))
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("y").alias("x"), F.col("x").alias("y")))
        hook = both.groupBy("x").agg(F.min("y").alias("low")).select("x", F.least("x", "low").alias("low"))
        hook = staged(hook, "hooks")
        further = hook.select(F.col("x").alias("low"), F.col("low").alias("lower"))
        jump = hook.join(further, "low").select("x", F.col("lower").alias("to"))
        jump = staged(jump, "jumps")
        named = named.join(jump.withColumnRenamed("x", "label"), "label", "left")
        named = staged(named.select("doc", F.coalesce("to", "label").alias("label")), "labels")
        edges = (
            edges.join(jump, "x")
            .select(F.col("to").alias("x"), "y")
            .join(jump.select(F.col("x").alias("y"), F.col("to").alias("to_y")), "y")
            .select("x", F.col("to_y").alias("y"))
            .filter("x <> y")
            .distinct()
        )
        edges = staged(edges.mapInArrow(_contracted, EDGES), "edges")
    least = named.groupBy("label").agg(F.min("doc").alias("component"))
    return named.join(least, "label").select("doc", "component")
