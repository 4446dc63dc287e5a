"""Mixing sources to target weights by Poisson replication.

A source with `size` rows and target weight `w` gets the mean repetition rate
`w * total / size`. Each row draws its number of copies from a Poisson distribution
with that mean, by inverting it at a uniform number made from a hash of the row's id
and the seed, so a rerun draws the same copies and no row depends on another. Rows
are repeated by that count and then dealt anew to tasks, and ordered inside them, by
a hash of id and copy number: a global shuffle that needs no sampling pass.

Defined results: a null source is a source of its own; a null id is hashed as the
word "null"; rows that repeat an id get the same count each; a weight of zero or a
source missing from given weights drops the source; an empty table gives an empty
table. Extra columns are kept, but for `copy` and
`mix_key`, which are given anew. Without given weights the target of a source is
proportional to its size to the power `temperature` (1: as it is; 0: all alike).
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from finchlab.llm.common import staged

TEMPERATURE = 0.5
SEED = 7
# 13 hex digits of md5 are 52 bits, exact in a double
_DIGITS = 13


def uniform(key: Column, seed: int, tag: str) -> Column:
    """A number in (0, 1) from a hash of the key."""
    text = F.concat(F.coalesce(key.cast("string"), F.lit("null")), F.lit(f"|{tag}|{seed}"))
    return (F.conv(F.substring(F.md5(text), 1, _DIGITS), 16, 10).cast("double") + 0.5) / 2.0 ** (4 * _DIGITS)


def rates(
    docs: DataFrame, source_col: str, weights: Mapping[str, float] | None, temperature: float
) -> DataFrame:
    """(source, size, rate): one row per source; the rates give the input's size in the mean."""
    sizes = docs.select(F.col(source_col).alias("_source")).groupBy("_source").agg(F.count("*").alias("_size"))
    if weights is None:
        weight = F.pow(F.col("_size").cast("double"), F.lit(float(temperature)))
    else:
        weight = F.lit(0.0)
        for name, value in weights.items():
            weight = F.when(F.col("_source") == F.lit(name), F.lit(float(value))).otherwise(weight)
    sizes = sizes.withColumn("_weight", weight)
    total = sizes.agg(F.sum("_size").alias("rows"), F.sum("_weight").alias("all")).first()
    scale = (total["rows"] or 0) / (total["all"] or 1.0)
    return sizes.select("_source", "_size", (F.col("_weight") * F.lit(scale) / F.col("_size")).alias("_rate"))


# exp(-rate) must be a normal double; larger means are a sum of equal parts
_PART = 500.0


def _thresholds(rate: Column) -> Column:
    """P(X <= 0), P(X <= 1), ... up to where the rest is below the resolution of `uniform`."""
    most = F.ceil(rate + 12.0 * F.sqrt(rate) + 40.0).cast("int")
    start = F.struct(F.exp(-rate).alias("p"), F.exp(-rate).alias("c"), F.array(F.exp(-rate)).alias("all"))

    def step(s: Column, k: Column) -> Column:
        p = s["p"] * rate / k
        return F.struct(p.alias("p"), (s["c"] + p).alias("c"), F.concat(s["all"], F.array(s["c"] + p)).alias("all"))

    return F.aggregate(F.sequence(F.lit(1), most), start, step, lambda s: s["all"])


def replicated(
    docs: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    weights: Mapping[str, float] | None = None,
    temperature: float = TEMPERATURE,
    seed: int = SEED,
) -> DataFrame:
    """The rows of the mixture, globally shuffled: all columns of `docs`, `copy` and `mix_key`."""
    parts = F.greatest(F.lit(1), F.ceil(F.col("_rate") / _PART)).cast("int")
    plan = rates(docs, source_col, weights, temperature).filter("_rate > 0").withColumn("_parts", parts)
    plan = plan.select("_source", "_parts", _thresholds(F.col("_rate") / F.col("_parts")).alias("_cdf"))
    # one row per source, written first: its size is then known and decides how it is joined
    plan = staged(plan, "rates")
    # the row as one value: none of its columns can clash with the ones made here
    names = [c for c in docs.columns if c not in ("copy", "mix_key")]
    row = F.struct(*[F.col(f"`{c}`") for c in names]) if names else F.lit(0)
    rows = docs.select(row.alias("_row"), F.col(id_col).cast("string").alias("_id"), F.col(source_col).alias("_s"))
    joined = rows.join(plan, F.col("_s").eqNullSafe(F.col("_source")))
    key = F.coalesce("_id", F.lit("null"))

    def drawn(total: Column, part: Column) -> Column:
        u = uniform(F.concat_ws("#", key, part), seed, "count")
        return total + F.size(F.filter("_cdf", lambda c: c <= u))

    copies = F.aggregate(F.sequence(F.lit(1), F.col("_parts")), F.lit(0), drawn)
    counted = joined.select("_row", "_id", copies.alias("_copies")).filter("_copies > 0")
    repeated = counted.select("_row", "_id", F.explode(F.sequence(F.lit(1), F.col("_copies"))).alias("_copy"))
    repeated = repeated.withColumn("_key", F.md5(F.concat_ws("|", key, "_copy", F.lit(f"mix|{seed}"))))
    dealt = repeated.repartition("_key").sortWithinPartitions("_key")
    own = [F.col("_row").getField(c).alias(c) for c in names]
    return dealt.select(*own, F.col("_copy").alias("copy"), F.col("_key").alias("mix_key"))
