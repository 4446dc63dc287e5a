"""A Merkle tree over a table of documents, built and read by slot pivots.

Every row is a leaf. The leaves of one source, in order of their ids, are the bottom of
that source's tree; the roots of the sources, in order of their names, are the bottom of
the tree above. Ranks come from one range-partitioned sort, so a source of any size is
spread over many tasks. One level is one aggregate: a node at position p is child
p mod 3 of parent p div 3, and `max(when(slot = k, hash))` for k = 0, 1, 2 puts the three
children of a parent side by side. The columns joined and hashed are the parent; the
columns without the own slot are the siblings. The way down carries the siblings of all
upper levels to the families of the level below, a third of the rows of that level.

Defined results: nulls are encoded as `-`, so null and empty differ; a null source is a
source of its own, before all others; null ids come first in their source and are never
tampered with; rows that repeat an id are ordered by their leaf, and rows equal in all
five columns share a leaf, but not a place. An empty table gives no row. Extra columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from finchlab.llm.common import staged

FANOUT = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_PATH = "array<struct<l:string,r:string>>"


def encoded(value: Column) -> Column:
    """`-` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*parts: Column) -> Column:
    """SHA-256 of the parts joined, in lowercase hex."""
    return F.sha2(F.concat(*parts), 256)


def leaves(docs: DataFrame, fields: Sequence[str] = FIELDS) -> DataFrame:
    """(doc_id, source, leaf, changed): `changed` is the leaf of the tampered row, null where nothing is tampered.

    Rows with an even crc32 of the decimal id lose the line feeds of the text, the last field.
    """
    key, source, *rest, text = (F.col(f"`{c}`") for c in fields)
    head = F.concat(*[encoded(c) for c in (key, source, *rest)])
    chosen = (F.crc32(key.cast("string")) % 2 == 0) & (F.instr(text, "\n") > 0)
    other = F.when(chosen, digest(head, encoded(F.translate(text, "\n", ""))))
    return docs.select(
        key.cast("bigint").alias("doc_id"),
        source.alias("source"),
        digest(head, encoded(text)).alias("leaf"),
        other.alias("changed"),
    )


def ranked(rows: DataFrame, group: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """`rows` with `pos`, the rank inside the group from 0, and `n`, the size of the group.

    Rows are dealt by ranges of (group, order) and numbered inside their range; what a
    group has in earlier ranges is summed from one row per group and range.
    """
    keys = [F.col(c).asc_nulls_first() for c in (*group, *order)]
    dealt = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    dealt = staged(dealt.withColumn("_at", F.monotonically_increasing_id()), name)
    part = F.shiftright("_at", 33)
    counts = dealt.groupBy(*group, part.alias("_part")).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    whole = Window.partitionBy(*group)
    before = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shift = F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")
    counts = counts.select(*group, "_part", shift.alias("_shift"), F.sum("_n").over(whole).alias("n"))
    shifts = staged(counts, f"{name}-shifts").select(*[F.col(c).alias(f"_{c}") for c in group], "_part", "_shift", "n")
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in group]
    match = part == F.col("_part")
    for condition in same:
        match &= condition
    joined = dealt.join(shifts, match)
    return joined.select(*rows.columns, (F.col("_at") + F.col("_shift")).alias("pos"), "n")


def _pivot(nodes: DataFrame) -> DataFrame:
    """(tree, parent, n, s0, s1, s2) of all trees with two nodes or more."""
    slot = F.pmod("pos", F.lit(FANOUT))
    return (
        nodes.filter("n > 1")
        .groupBy("tree", F.floor(F.col("pos") / FANOUT).alias("parent"))
        .agg(
            F.max("n").alias("n"),
            *[F.max(F.when(slot == k, F.col("hash"))).alias(f"s{k}") for k in range(FANOUT)],
        )
    )


def _slots() -> list[Column]:
    return [F.coalesce(f"s{k}", F.lit("")) for k in range(FANOUT)]


def _siblings(slot: Column) -> Column:
    """The columns left and right of the own slot."""
    s = _slots()
    pairs = [
        F.struct(F.concat(F.lit(""), *s[:k]).alias("l"), F.concat(F.lit(""), *s[k + 1 :]).alias("r"))
        for k in range(FANOUT)
    ]
    chosen = pairs[-1]
    for k in reversed(range(FANOUT - 1)):
        chosen = F.when(slot == k, pairs[k]).otherwise(chosen)
    return chosen


def _climb(nodes: DataFrame, name: str) -> tuple[list[DataFrame], DataFrame]:
    """The families of every level from the bottom up, and (tree, root) of every tree.

    `nodes` has (tree, pos, n, hash), n being the number of nodes in the tree.
    """
    levels: list[DataFrame] = []
    roots = nodes.filter("n = 1").select("tree", F.col("hash").alias("root"))
    most = nodes.agg(F.max("n")).first()[0] or 0
    while most > 1:
        families = staged(_pivot(nodes), f"{name}-{len(levels)}")
        levels.append(families)
        nodes = families.select(
            "tree",
            F.col("parent").alias("pos"),
            F.ceil(F.col("n") / FANOUT).alias("n"),
            digest(*_slots()).alias("hash"),
        )
        roots = roots.unionByName(nodes.filter("n = 1").select("tree", F.col("hash").alias("root")))
        most = -(-most // FANOUT)
    return levels, staged(roots, f"{name}-roots")


def _descend(levels: list[DataFrame], above: DataFrame, name: str) -> DataFrame | None:
    """(tree, parent, s0, s1, s2, path) of the bottom families; None where no tree has two nodes.

    `above` has (tree, path): the siblings from the root of each tree upwards.
    """
    below = None
    for k in reversed(range(len(levels))):
        families = levels[k].withColumn("_top", F.col("n") <= FANOUT)
        top = families.filter("_top").join(above, "tree")
        rows = top.select("tree", "parent", "s0", "s1", "s2", "path")
        if below is not None:
            upper = below.select(
                "tree",
                F.col("parent").alias("_up"),
                F.explode(F.array(*[
                    F.struct(F.lit(j).alias("slot"), _siblings(F.lit(j)).alias("pair")) for j in range(FANOUT)
                ])).alias("_own"),
                "path",
            ).select(
                "tree",
                (F.col("_up") * FANOUT + F.col("_own.slot")).alias("parent"),
                F.concat(F.array("_own.pair"), F.col("path")).cast(_PATH).alias("path"),
            )
            rest = families.filter("not _top").join(upper, ["tree", "parent"])
            rows = rows.unionByName(rest.select("tree", "parent", "s0", "s1", "s2", "path"))
        below = staged(rows, f"{name}-{k}")
    return below


def manifest(docs: DataFrame, fields: Sequence[str] = FIELDS) -> DataFrame:
    """One row per input row: doc_id, source, pos, leaf, subroot, root, proof, folded_root, verified.

    `proof` holds, level by level, the siblings left and right of the node; hashing each with
    what lies between them, from the leaf up, gives the root again. `folded_root` does that
    from the leaf of the tampered row, or from the original one, and `verified` compares.
    """
    rows = ranked(staged(leaves(docs, fields), "leaves"), ["source"], ["doc_id", "leaf"], "leaf-ranks")
    named = ranked(rows.select("source").distinct(), [], ["source"], "source-ranks")
    named = staged(named.select(F.col("source").alias("_source"), F.col("pos").alias("tree"), F.col("n").alias("_n")), "sources")
    rows = rows.join(named.drop("_n"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    rows = staged(rows, "placed-leaves")

    families, subroots = _climb(rows.select("tree", "pos", "n", F.col("leaf").alias("hash")), "families")
    one = F.lit(0).cast("bigint").alias("tree")
    sources = subroots.join(named, "tree")
    upper, top = _climb(sources.select(one, F.col("tree").alias("pos"), F.col("_n").alias("n"), F.col("root").alias("hash")), "upper")
    root = F.lit((top.first() or {"root": None})["root"]).cast("string")  # one value
    no_path = F.array().cast(_PATH)
    tops = _descend(upper, top.select("tree", no_path.alias("path")), "upper-paths")
    if tops is None:
        paths = subroots.select("tree", F.col("root").alias("subroot"), no_path.alias("path"))
    else:
        own = subroots.select(
            F.col("tree").alias("_tree"), F.floor(F.col("tree") / FANOUT).alias("parent"), F.col("root").alias("subroot")
        ).join(tops.drop("tree"), "parent")
        pair = _siblings(F.pmod("_tree", F.lit(FANOUT)))
        path = F.concat(F.array(pair), F.col("path")).cast(_PATH).alias("path")
        paths = own.select(F.col("_tree").alias("tree"), "subroot", path)
    paths = staged(paths, "paths")

    bottom = _descend(families, paths.drop("subroot"), "families-paths")
    alone = rows.filter("n = 1").join(paths, "tree")
    out = alone.select("doc_id", "source", "pos", "leaf", "changed", "subroot", F.col("path").alias("proof"))
    if bottom is not None:
        many = rows.filter("n > 1").withColumn("parent", F.floor(F.col("pos") / FANOUT)).join(bottom, ["tree", "parent"])
        pair = _siblings(F.pmod("pos", F.lit(FANOUT)))
        many = many.select(
            "tree", "doc_id", "source", "pos", "leaf", "changed",
            F.concat(F.array(pair), F.col("path")).cast(_PATH).alias("proof"),
        ).join(paths.drop("path"), "tree")
        out = many.select(*out.columns).unionByName(out)
    start = F.coalesce("changed", "leaf")
    folded = F.aggregate("proof", start, lambda h, s: digest(s["l"], h, s["r"]))
    out = out.withColumn("root", root).withColumn("folded_root", folded)
    return out.withColumn("verified", F.col("folded_root") == F.col("root")).drop("changed")


def proof_digest(proof: Column | str) -> Column:
    """H of all siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(proof, lambda s: F.concat(s["l"], s["r"])), ""), 256)
