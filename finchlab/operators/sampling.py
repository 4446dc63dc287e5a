"""Exact-size random samples, splits and folds by hash rank.

Rows are ordered by `md5(key|seed)`. A sample of exactly n rows is every row up
to the n-th hash, so once that hash is known the selection is a plain filter:
no payload is shuffled and no global sort is needed. The n-th hash is found from
two narrow passes over the key: counts per hash prefix, then ranks inside the
one prefix that holds position n. `key` must be unique where a cut falls: rows that
share the hash at a cut would all fall on one side of it, so that is an error. A null
key is hashed like a word of its own.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from finchlab.session import stage_table

# 16^4 hash prefixes: the counts table has at most 65,536 rows at any scale
PREFIX_DIGITS = 4


def hash_of(key: Column, seed: int) -> Column:
    return F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("null")), F.lit(f"|{seed}")))


def _cuts(
    df: DataFrame,
    key: str,
    seed: int,
    targets: Callable[[Column], Sequence[Column]],
    how_many: int,
    stratum: str | None = None,
) -> DataFrame:
    """Per stratum, the hash at each target rank (null for rank 0)."""
    strata = [stratum] if stratum else []
    keyed = df.select(*strata, hash_of(F.col(key), seed).alias("_h"))
    keyed = keyed.withColumn("_p", F.substring("_h", 1, PREFIX_DIGITS))
    counts = keyed.groupBy(*strata, "_p").agg(F.count("*").alias("_c"))
    per = Window.partitionBy(*strata)
    running = per.orderBy("_p").rowsBetween(Window.unboundedPreceding, 0)
    placed = counts.select(
        *strata,
        "_p",
        "_c",
        (F.sum("_c").over(running) - F.col("_c")).alias("_before"),
        F.sum("_c").over(per).alias("_total"),
    )
    # targets may be scalar subqueries, so they become columns of their own first
    placed = placed.select(
        "*",
        *[t.cast("bigint").alias(f"_t{i}") for i, t in enumerate(targets(F.col("_total")))],
    )
    wanted = [
        F.struct(F.lit(i).alias("i"), (F.col(f"_t{i}") - F.col("_before")).alias("r"))
        for i in range(how_many)
    ]
    # at most one prefix per target and stratum
    edges = placed.select(
        *strata,
        "_p",
        F.inline(F.filter(F.array(*wanted), lambda w: (w["r"] > 0) & (w["r"] <= F.col("_c")))),
    )
    inside = Window.partitionBy(*strata, "_p", "i").orderBy("_h")
    repeated = F.raise_error(F.lit("the key is not unique where the sample is cut"))
    hits = (
        keyed.join(edges, [*strata, "_p"])
        .withColumn("_rn", F.row_number().over(inside))
        .withColumn("_next", F.lead("_h").over(inside))
        .filter(F.col("_rn") == F.col("r"))
        .withColumn("_h", F.when(F.col("_next") == F.col("_h"), repeated.cast("string")).otherwise(F.col("_h")))
    )
    return hits.groupBy(*strata).agg(
        F.array(
            *[F.max(F.when(F.col("i") == i, F.col("_h"))) for i in range(how_many)]
        ).alias("_cuts")
    )


def _up_to(hash_column: Column, cut: Column) -> Column:
    return F.coalesce(hash_column <= cut, F.lit(False))


def sample_exact(
    df: DataFrame, n: int | Column | Callable[[Column], Column], key: str, seed: int
) -> DataFrame:
    """Exactly n random rows without replacement; an error when there are fewer.

    `n` is a number, a scalar subquery or a function of the row count.
    """

    too_many = F.raise_error(F.lit("cannot take a larger sample than there are rows"))

    def target(total: Column) -> list[Column]:
        size = n(total) if callable(n) else (n if isinstance(n, Column) else F.lit(n))
        return [F.when(size > total, too_many.cast("bigint")).otherwise(size)]

    cuts = _cuts(df, key, seed, target, 1)
    if not callable(n):
        # an empty input has no row on which the check above could run
        size = n if isinstance(n, Column) else F.lit(n)
        missing = F.col("_cuts")[0].isNull() & (size > 0)
        cuts = cuts.select(
            F.when(missing, too_many.cast("array<string>")).otherwise(F.col("_cuts"))
        )
    return df.filter(_up_to(hash_of(F.col(key), seed), cuts.scalar()[0]))


def label_split(
    df: DataFrame, test_size: float, validation_size: float, key: str, seed: int
) -> DataFrame:
    """Add `split`: test first, then validation out of the rest, then train.

    Sizes are ceil(n * test_size) and ceil((n - test) * validation_size).
    """

    def targets(total: Column) -> list[Column]:
        test = F.ceil(total * F.lit(float(test_size)))
        valid = F.ceil((total - test) * F.lit(float(validation_size)))
        return [test, test + valid]

    cuts = _cuts(df, key, seed, targets, 2).scalar()
    h = hash_of(F.col(key), seed)
    return df.withColumn(
        "split",
        F.when(_up_to(h, cuts[0]), "test")
        .when(_up_to(h, cuts[1]), "validation")
        .otherwise("train"),
    )


def three_way_split(
    df: DataFrame, test_size: float, validation_size: float, key: str, seed: int
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(train, test, validation).

    The labelled rows are written once, partitioned by split, so that the parts
    are read without finding the cuts or scanning the other parts again.
    """
    labelled = label_split(df, test_size, validation_size, key, seed)
    labelled = stage_table(labelled, "split", ["split"])
    return tuple(
        labelled.filter(F.col("split") == part).drop("split")
        for part in ("train", "test", "validation")
    )


def two_way_split(
    df: DataFrame, test_size: float, key: str, seed: int
) -> tuple[DataFrame, DataFrame]:
    """(train, test)."""
    labelled = label_split(df, test_size, 0.0, key, seed)
    train = labelled.filter(F.col("split") == "train").drop("split")
    test = labelled.filter(F.col("split") == "test").drop("split")
    return train, test


def rebalance(
    df: DataFrame, share: float, key: str, seed: int, label: str = "target"
) -> DataFrame:
    """All negatives and round(negatives * share) sampled positives.

    Rounds half to even, as the share is applied to a whole number of rows.
    """
    negatives = df.filter(F.col(label) == 0)
    positives = df.filter(F.col(label) == 1)
    n = negatives.agg(
        F.bround(F.count("*") * F.lit(float(share))).cast("bigint").alias("n")
    ).scalar()
    return negatives.unionByName(sample_exact(positives, n, key, seed))


def downsample_to(larger: DataFrame, smaller: DataFrame, key: str, seed: int) -> DataFrame:
    """Sample `larger` to the row count of `smaller` and append `smaller`."""
    n = smaller.agg(F.count("*").alias("n")).scalar()
    return sample_exact(larger, n, key, seed).unionByName(smaller, allowMissingColumns=True)


def assign_folds(
    df: DataFrame,
    folds: int,
    key: str,
    seed: int,
    label: str,
    fold_column: str = "fold",
) -> DataFrame:
    """Stratified folds of equal size within each class (sizes differ by at most 1).

    The classes are those of the data; rows without a label are a class of their own.

    The folds of a class are consecutive ranges of its hash order, so only
    `folds - 1` hashes per class are needed and the rows stay where they are.
    """

    def targets(total: Column) -> list[Column]:
        small = F.floor(total / F.lit(folds))
        larger = total % F.lit(folds)
        return [small * i + F.least(larger, F.lit(i)) for i in range(1, folds)]

    known = df.withColumn("_class", F.coalesce(F.concat(F.lit("="), F.col(label).cast("string")), F.lit("null")))
    # one row per class, written first so that its size decides how it is joined
    cuts = stage_table(_cuts(known, key, seed, targets, folds - 1, stratum="_class"), "fold-cuts")
    h = hash_of(F.col(key), seed)
    below = [F.when(_up_to(h, F.col("_cuts")[i]), F.lit(i)) for i in range(folds - 1)]
    return (
        known.join(cuts, "_class", "left")
        .withColumn(fold_column, F.coalesce(*below, F.lit(folds - 1)).cast("int"))
        .select(*df.columns, fold_column)
    )
