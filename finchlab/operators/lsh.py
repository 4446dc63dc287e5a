"""Approximate nearest neighbours by random projections, with verified distances.

A table cuts the space by `bits` random planes, each through the median of the training
rows' projections, so its buckets are of similar size however the data lie. A query looks
into its own bucket and into those on the other side of the planes it is nearest to. Rows
that meet a query in some table are compared exactly, so what can be missed is a
neighbour, never a distance. Buckets that share the sides of their first planes lie in one
place: a training row travels once for each table, a query at most once for each bucket it
looks into, and only the best k of a place leave its task, never all pairs. `bits` follows the number of training rows and the rows
aimed at per bucket. Of training rows with equal vectors only the k + 1 first by id take
part: no query needs more, and a vector that is a third of all rows fills no bucket.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from finchlab.operators.ranking import top_k_per_group
from finchlab.session import stage_table

TABLES = 8
PROBES = 8
BUCKET_ROWS = 512
SEED = 5
MAX_BITS = 40
# coordinates of the training rows that a task holds, and numbers computed at once
PLACE_BYTES = 32 * 1024 * 1024
SENT_NUMBERS = 2_000_000


def _matrix(lists: pa.Array) -> np.ndarray:
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(lists), -1) if len(lists) else flat.reshape(0, 0)


def flips(bits: int, probes: int) -> list[tuple[int, ...]]:
    """Which planes, by rank of nearness, each probe crosses: cheap ones first."""
    width = min(bits, 8)
    sets = (s for n in range(width + 1) for s in itertools.combinations(range(width), n))
    return sorted(sets, key=lambda s: (sum(r + 1 for r in s), s))[:probes]


def _projected(planes: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                shown = _matrix(batch.column(0)) @ planes.T
                ends = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * len(planes))
                yield pa.record_batch([pa.ListArray.from_arrays(ends, pa.array(shown.ravel()))], names=["p"])

    return run


def _dealt(planes: np.ndarray, medians: np.ndarray, tables: int, bits: int, coarse: int, probes: int, kind: pa.DataType):
    """A row for every place where it has buckets, with their codes.

    A place is a table and the sides of its first `coarse` planes.
    """
    powers = np.int64(1) << np.arange(bits, dtype=np.int64)
    crossed = flips(bits, probes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, SENT_NUMBERS // (planes.shape[1] * len(crossed)))
        for whole in batches:
            for low in range(0, whole.num_rows, step):
                batch = whole.slice(low, step)
                gap = (_matrix(batch.column("v")) @ planes.T - medians).reshape(batch.num_rows, tables, bits)
                side = gap > 0
                near = np.abs(gap).argsort(axis=2, kind="stable")
                rows = np.arange(batch.num_rows)
                for t in range(tables):
                    codes = np.empty((batch.num_rows, len(crossed)), dtype=np.int64)
                    for i, ranks in enumerate(crossed):
                        own = side[:, t].copy()
                        for r in ranks:
                            own[rows, near[:, t, r]] ^= True
                        codes[:, i] = (own * powers).sum(axis=1)
                    place = codes & ((1 << coarse) - 1)
                    row = np.repeat(rows, len(crossed))
                    order = np.lexsort((place.ravel(), row))
                    row, flat, place = row[order], codes.ravel()[order], place.ravel()[order]
                    first = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (place[1:] != place[:-1])))
                    ends = pa.array(np.append(first, len(row)).astype(np.int32))
                    sent = batch.take(pa.array(row[first]))
                    yield pa.record_batch(
                        [
                            pa.array(((t << coarse) + place[first]).astype(np.int32)),
                            *(sent.column(c) for c in ("row", "id", "label")),
                            pa.ListArray.from_arrays(ends, pa.array(flat)),
                            sent.column("v").cast(kind),
                        ],
                        names=["place", "row", "id", "label", "codes", "v"],
                    )

    return run


class _Buckets:
    """The training rows of a place by bucket."""

    def __init__(self, held: list[pa.RecordBatch]):
        rows = pa.Table.from_batches(held)
        code = rows["codes"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
        order = np.argsort(code, kind="stable")
        self.code = code[order]
        self.row, self.id, self.label = (rows[c].to_numpy()[order] for c in ("row", "id", "label"))
        self.vectors = _matrix(rows["v"].combine_chunks())[order]

    def best(self, part: pa.RecordBatch, k: int, skip_self: bool) -> pa.RecordBatch:
        """The k closest rows of the buckets that each query looks into, distances computed."""
        ids, rows = (part.column(c).to_numpy(zero_copy_only=False) for c in ("id", "row"))
        vectors, lists = _matrix(part.column("v")), part.column("codes")
        query = np.repeat(np.arange(len(ids)), lists.value_lengths().to_numpy(zero_copy_only=False))
        codes = lists.flatten().to_numpy(zero_copy_only=False)
        low, high = np.searchsorted(self.code, codes), np.searchsorted(self.code, codes, side="right")
        ends = np.cumsum(high - low)
        q, t, d = (np.empty(0, dtype=kind) for kind in (np.int64, np.int64, np.float64))
        step = max(1, SENT_NUMBERS // self.vectors.shape[1])
        for start in range(0, int(ends[-1]) if len(ends) else 0, step):
            pair = np.arange(start, min(start + step, int(ends[-1])))
            at = np.searchsorted(ends, pair, side="right")
            own, other = query[at], high[at] - (ends[at] - pair)
            if skip_self:
                kept = ids[own] != self.id[other]
                own, other = own[kept], other[kept]
            gap = vectors[own] - self.vectors[other]
            q, t, d = np.append(q, own), np.append(t, other), np.append(d, np.sqrt(np.einsum("ij,ij->i", gap, gap)))
            if len(q) >= SENT_NUMBERS:
                q, t, d = self._first(q, t, d, k)
        q, t, d = self._first(q, t, d, k)
        columns = [rows[q], self.row[t], ids[q], self.id[t], self.label[t], d]
        return pa.record_batch([pa.array(c) for c in columns], names=MET_NAMES)

    def _first(self, q: np.ndarray, t: np.ndarray, d: np.ndarray, k: int):
        order = np.lexsort((self.id[t], d, q))
        q, t, d = q[order], t[order], d[order]
        top = np.arange(len(q)) - np.searchsorted(q, q) < k
        return q[top], t[top], d[top]


MET = "query_row long, train_row long, query_id long, train_id long, label int, distance double"
MET_NAMES = [c.split(" ")[0] for c in MET.split(", ")]


def _streamed(k: int, skip_self: bool):
    """The best k of each place for the queries that follow its rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, held, ready = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("place", "part", "kind")])
            edge = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
            bounds = [0, *edge.tolist(), batch.num_rows]
            for low, high in zip(bounds[:-1], bounds[1:], strict=True):
                part = batch.slice(low, high - low)
                if tuple(keys[:2, low]) != place:
                    place, held, ready = tuple(keys[:2, low]), [], None
                if keys[2, low] == 0:
                    held.append(part)
                elif ready or held:
                    if ready is None:
                        ready, held = _Buckets(held), []
                    yield ready.best(part, k, skip_self)

    return run


def approximate_nearest(
    train: DataFrame,
    queries: DataFrame,
    k: int,
    key: str = "id",
    vector: str = "vector",
    label: str = "label",
    skip_self: bool = False,
    tables: int = TABLES,
    probes: int = PROBES,
    bucket_rows: int = BUCKET_ROWS,
    seed: int = SEED,
) -> DataFrame:
    """(query_id, train_id, label, distance, rank) with rank 1..k of the rows met; see the module."""
    narrow = dict(train.dtypes)[vector] == dict(queries.dtypes)[vector] == "array<float>"
    v = F.col(vector).cast("array<double>").alias("v")
    row = F.monotonically_increasing_id().alias("row")
    own = F.col(key).cast("long").alias("id")
    train = train.select(own, v, F.col(label).cast("int").alias("label")).filter("id is not null")
    queries = queries.select(own, v, F.lit(0).alias("label")).filter("id is not null")
    alike = train.withColumn("same", F.xxhash64("v"))
    train = top_k_per_group(alike, ["same"], [F.col("id")], k + 1, salt_by=["id"]).drop("same", "rank")
    train = stage_table(train.select("*", row), "lsh-train")
    queries = stage_table(queries.select("*", row), "lsh-queries")
    kinds = "query_id long, train_id long, label int, distance double"
    first = train.first()
    if first is None:
        return train.sparkSession.createDataFrame([], kinds + ", rank int")
    n, width = train.count(), len(first["v"])
    bits = min(MAX_BITS, max(1, math.ceil(math.log2(max(2, n / bucket_rows)))))
    planes = np.random.default_rng(seed).normal(size=(tables * bits, width))
    # a number per plane reaches the driver
    shown = train.select("v").mapInArrow(_projected(planes), "p array<double>").select(F.posexplode("p").alias("plane", "x"))
    middle = dict(shown.groupBy("plane").agg(F.percentile_approx("x", 0.5, 1000)).collect())
    medians = np.array([middle[i] for i in range(len(planes))])
    # places: so many that their rows fit a task and every core has some
    per_place = max(1, PLACE_BYTES // (8 * width))
    cores = train.sparkSession.sparkContext.defaultParallelism
    coarse = min(bits, max(0, math.ceil(math.log2(max(n / per_place, 2 * cores / tables)))))
    kind, sent = ("float", pa.list_(pa.float32())) if narrow else ("double", pa.list_(pa.float64()))
    dealt = f"place int, row long, id long, label int, codes array<long>, v array<{kind}>"
    right = train.mapInArrow(_dealt(planes, medians, tables, bits, coarse, 1, sent), dealt)
    left = queries.mapInArrow(_dealt(planes, medians, tables, bits, coarse, probes, sent), dealt)
    # a place that holds far more rows than others is cut by a hash; a number per place reaches the driver
    parts = dict(right.groupBy("place").agg(F.count("*")).collect())
    parts = F.lit([-(-parts.get(i, 1) // per_place) for i in range(tables << coarse)])
    parts = F.element_at(parts, F.col("place") + 1)
    right = right.withColumn("kind", F.lit(0)).withColumn("part", F.pmod(F.xxhash64("row"), parts).cast("int"))
    left = left.withColumn("kind", F.lit(1)).withColumn("part", F.explode(F.sequence(F.lit(0), (parts - 1).cast("int"))))
    order = ["place", "part", "kind"]
    met = right.unionByName(left).repartition("place", "part").sortWithinPartitions(*order).mapInArrow(_streamed(k, skip_self), MET)
    # a pair met in several tables is one
    met = met.repartition("query_id").groupBy("query_id", "query_row", "train_row").agg(
        F.min("train_id").alias("train_id"), F.min("label").alias("label"), F.min("distance").alias("distance")
    )
    nearest = Window.partitionBy("query_id").orderBy("distance", "train_id")
    best = met.withColumn("rank", F.row_number().over(nearest)).filter(F.col("rank") <= k)
    return best.select("query_id", "train_id", "label", "distance", "rank")


def recall(approximate: DataFrame, exact: DataFrame) -> DataFrame:
    """(queries, wanted, found): neighbours of the exact table, and those of them that the other has."""
    hits = exact.join(approximate.select("query_id", "train_id", F.lit(1).alias("hit")), ["query_id", "train_id"], "left")
    return hits.agg(F.count_distinct("query_id").alias("queries"), F.count("*").alias("wanted"), F.count("hit").alias("found"))
