"""Exact duplicates by progressive refinement: length, then prefix hash, then full hash.

Texts are compared after each run of white space has become one space. The first
pass keeps only lengths and a hash of the first characters, and counts them; pairs
of a length and a prefix that occur once are unique texts, whose full content is
never hashed. The others are written as a table and joined, so the refinement works
at any number of them: a second pass deals the rows by length and prefix, and hashes
the full text where the pair is in the table. Its result is written once; only rows
with a full hash are grouped and dealt by it.

Defined results: null counts as empty, and all empty texts are one group; of equal
texts the row with the smallest id stays; null ids sort last; rows that repeat an
id and a text count in `group_size` one by one and all carry `kept`, but
`drop_copies` leaves one of them. Extra columns are ignored unless named in `carry`.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from finchlab.llm.common import staged

SPACE = r"[\x20\x09-\x0D]+"
PREFIX = 64


def normalised(text: Column) -> Column:
    """White-space runs as one space; null as the empty text."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def _refined(sized: DataFrame, text: Column, carry: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Rows with a key, written once, and the groups of two and more.

    `sized` has doc, _length, _prefix, what `text` reads, and the `carry` columns. Rows that
    are alone after the first pass have no key.
    """
    # 1: lengths that occur once need no hash at all; 2: nor do prefixes that occur once
    alive = sized.groupBy("_length", "_prefix").agg(F.count("*").alias("_n")).filter("_n > 1")
    alive = staged(alive.select("_length", "_prefix", F.lit(True).alias("_alive")), "repeated-prefixes")
    # 3: the full text of what is left; dealt by key at every size of the table
    marked = sized.join(alive.hint("merge"), ["_length", "_prefix"], "left")
    full = F.when(F.col("_alive"), F.sha2(normalised(text), 256))
    hashed = staged(marked.select("doc", full.alias("_key"), *carry), "hashed-texts")
    first = F.min(F.struct(F.col("doc").isNull().alias("last"), "doc", "_n"))
    groups = (
        hashed.filter("_key is not null")
        .groupBy("_key", "doc")
        .agg(F.count("*").alias("_n"))
        .groupBy("_key")
        .agg(first.alias("_first"), F.sum("_n").alias("_size"))
        .filter("_size > 1")
    )
    # written first, the join has an exchange on both sides and a group of many copies can be split
    return hashed, staged(groups, "copy-groups")


def _sized(docs: DataFrame, prefix: int, *others: Column) -> DataFrame:
    """(doc, _length, _prefix) and others; `docs` has `doc` and `_norm`."""
    short = F.xxhash64(F.substring("_norm", 1, prefix)).alias("_prefix")
    return docs.select("doc", F.length("_norm").alias("_length"), short, *others)


def _labelled(hashed: DataFrame, groups: DataFrame, carry: Sequence[str]) -> DataFrame:
    """All rows with a key, with their group."""
    rows = hashed.filter("_key is not null").join(groups.hint("merge"), "_key", "left")
    alone = F.col("_first").isNull()
    return rows.select(
        "doc",
        F.when(alone, F.col("doc")).otherwise(F.col("_first.doc")).alias("keep_id"),
        F.coalesce("_size", F.lit(1)).cast("bigint").alias("group_size"),
        (alone | F.col("doc").eqNullSafe(F.col("_first.doc"))).alias("kept"),
        F.coalesce("_first._n", F.lit(1)).alias("_ties"),
        "_key",
        *carry,
    )


def exact_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    carry: Mapping[str, Column] | None = None,
    prefix: int = PREFIX,
) -> DataFrame:
    """One row per input row: doc, keep_id, group_size, kept, and the `carry` columns.

    `carry` maps names to expressions over the columns of `docs` and `_norm`, the
    normalised text.
    """
    carry = dict(carry or {})
    base = docs.withColumn("_norm", normalised(F.col(text_col)))
    own = [c.alias(n) for n, c in carry.items()]
    base = base.select(F.col(id_col).cast("bigint").alias("doc"), "_norm", F.col(text_col).alias("_text"), *own)
    hashed, groups = _refined(_sized(base, prefix, F.col("_text"), *carry), F.col("_text"), list(carry))
    alone = hashed.filter("_key is null").select(
        "doc",
        F.col("doc").alias("keep_id"),
        F.lit(1).cast("bigint").alias("group_size"),
        F.lit(True).alias("kept"),
        *carry,
    )
    return _labelled(hashed, groups, list(carry)).drop("_ties", "_key").unionByName(alone)


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix: int = PREFIX) -> DataFrame:
    """The rows that stay, with all their columns."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    whole = docs.select(
        F.col(id_col).cast("bigint").alias("doc"), normalised(F.col(text_col)).alias("_norm"), row
    )
    text = F.col("_row").getField(text_col)
    hashed, groups = _refined(_sized(whole, prefix, F.col("_row")), text, ["_row"])
    alone = hashed.filter("_key is null").select("_row.*")
    rows = _labelled(hashed, groups, ["_row"]).filter("kept")
    if groups.filter("_first._n > 1").isEmpty():
        return rows.select("_row.*").unionByName(alone)
    # rows that repeat both id and text
    tied = rows.filter("_ties > 1").dropDuplicates(["_key"])
    return rows.filter("_ties = 1").unionByName(tied).select("_row.*").unionByName(alone)
