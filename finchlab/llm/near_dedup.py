"""Near duplicates by SuperMinHash, banding, verification on full sets, and union-find.

A document is its set of distinct word shingles, as 64-bit hashes.

* **Signature.** Every shingle holds a pseudo-random permutation of the slots (affine
  over a prime number of slots) and, at each rank of it, a uniform number; slot s
  keeps the smallest rank + number of all shingles. Ranks of one shingle are all
  different, which lowers the variance, and once every slot of a document is below
  rank r no later rank can matter: long documents stop after the first.
* **Equal sets** are folded into one document first, so thousands of copies are one.
* **Bands** of `rows` slots give candidate buckets. A bucket of up to `crowd`
  documents lists its pairs. A larger one compares all its members with one of them,
  the one with the largest buckets in all, and its members are marked as crowded.
* **Crowded documents** are completed exactly: any pair with similarity t shares a
  shingle among the `(1 - t) |set| + 1` that come first in one global order, rare
  first, and no more shingles can be common than follow the first common one in either
  set. Documents that already hang together need no further pair, so only such
  shingles are used whose documents lie in different components: `2**24` slots tell
  first where components meet, and only shingles of such slots become rows.
* **Verification** counts the common shingles of full sets. Links are joined into
  components by union-find inside tasks, then rounds of smallest-neighbour hooking.

Frequencies for the order come from `2**20` counters (any order is correct; the
counters only decide how rare "rare" is). They and a bit per slot are all that is sent
to all tasks.

Defined results: null or empty text has an empty set and links with nothing; fewer
words than the shingle size make one shingle of all words; ids must not be null to
take part (such rows come back alone); rows that repeat an id are one document with
the links of each. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from finchlab.llm.common import staged
from finchlab.llm.components import connected_components
from finchlab.llm.words import find_words, give_back, mix, pieces, stream, word_hashes

SHINGLE = 5
PERCENT = 75
BANDS, ROWS = 32, 3
# the smallest prime that holds all bands; the last slot is not banded
SLOTS = 97
CROWD = 48
COUNTERS = 1 << 20
# slots in which shingles of different components are looked for
MEETING_BITS = 24
MEETING_BLOCK = (1 << MEETING_BITS) // 32

_PLACE = stream(64, 31) | np.uint64(1)
_RANK = stream(SLOTS, 32)
_STEP = stream(2, 33)


def shingle_sets(words_hashes: np.ndarray, rows: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each document, sorted, and the offsets of the documents."""
    counts = np.diff(rows)
    n_docs = len(counts)
    lengths = np.where(counts >= size, counts - size + 1, (counts > 0).astype(np.int64))
    owner = np.repeat(np.arange(n_docs), lengths)
    first = np.repeat(rows[:-1] - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths) + np.arange(lengths.sum())
    width = np.minimum(np.repeat(counts, lengths), size)
    value = np.zeros(len(first), dtype=np.uint64)
    last = max(len(words_hashes) - 1, 0)
    for k in range(size):
        part = words_hashes[np.minimum(first + k, last)] * _PLACE[k]
        value += part if (width == size).all() else np.where(width > k, part, np.uint64(0))
    value = mix(value + width.astype(np.uint64))
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    new = np.ones(len(value), dtype=bool)
    new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    value, owner = value[new], owner[new]
    return value, np.searchsorted(owner, np.arange(n_docs + 1))


def signatures(values: np.ndarray, marks: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """SuperMinHash of each set: (documents, slots) of float64, infinite for empty sets.

    Rank by rank over all elements of the documents that still have a slot to settle.
    """
    n_docs = len(marks) - 1
    out = np.full((n_docs, slots), np.inf)
    flat = out.reshape(-1)
    sizes = np.diff(marks)
    owner = np.repeat(np.arange(n_docs), sizes)
    p = np.uint64(slots)
    first = mix(values ^ _STEP[0]) % p
    step = np.uint64(1) + mix(values ^ _STEP[1]) % (p - np.uint64(1))
    for rank in range(slots):
        if not len(values):
            break
        number = (mix(values ^ _RANK[rank]) >> np.uint64(11)).astype(np.float64) * 2.0**-53
        slot = (first + step * np.uint64(rank)) % p
        np.minimum.at(flat, owner * slots + slot.astype(np.int64), number + rank)
        # a document whose slots are all below the next rank is finished
        unsettled = out.max(axis=1) >= rank + 1
        go = unsettled[owner]
        if not go.all():
            values, owner, first, step = values[go], owner[go], first[go], step[go]
    return out


def band_keys(signature: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """(documents, bands) of 64-bit bucket keys."""
    bits = np.ascontiguousarray(signature[:, : bands * rows]).view(np.uint64).reshape(len(signature), bands, rows)
    key = np.tile(stream(bands, 34), (len(signature), 1))
    for k in range(rows):
        key = mix(key ^ mix(bits[:, :, k] + np.uint64(k)))
    return key


SIGNED = "doc bigint, n_shingles bigint, a bigint, b bigint, bands array<bigint>"


def _signed(size: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text", 1 << 20):
                words = find_words(part.column(1))
                values, marks = shingle_sets(word_hashes(words, lower=True), words.rows, size)
                sums = [np.concatenate(([np.uint64(0)], np.cumsum(mix(values ^ s), dtype=np.uint64))) for s in _STEP]
                a, b = (s[marks[1:]] - s[marks[:-1]] for s in sums)
                keys = band_keys(signatures(values, marks), bands, rows)
                flat = pa.array(keys.reshape(-1).view(np.int64))
                yield pa.record_batch(
                    [
                        part.column(0),
                        pa.array(np.diff(marks).astype(np.int64)),
                        pa.array(a.view(np.int64)),
                        pa.array(b.view(np.int64)),
                        pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, bands, dtype=np.int32)), flat),
                    ],
                    names=["doc", "n_shingles", "a", "b", "bands"],
                )
            give_back()

    return run


SETS = "doc bigint, n bigint, shingles binary"


def _sets(size: int):
    """The full set of each document, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text", 1 << 20):
                words = find_words(part.column(1))
                values, marks = shingle_sets(word_hashes(words, lower=True), words.rows, size)
                packed = [values[s:e].tobytes() for s, e in zip(marks[:-1], marks[1:], strict=True)]
                yield pa.record_batch(
                    [part.column(0), pa.array(np.diff(marks)), pa.array(packed, pa.binary())],
                    names=["doc", "n", "shingles"],
                )
            give_back()

    return run


LINKS = "x bigint, y bigint"


def _verified(percent: int):
    """Pairs with their two sets: those whose intersection is large enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column(2), batch.column(3)
            fits = np.zeros(batch.num_rows, dtype=bool)
            for i in range(batch.num_rows):
                s = np.frombuffer(left[i].as_buffer(), dtype=np.uint64)
                t = np.frombuffer(right[i].as_buffer(), dtype=np.uint64)
                both = np.concatenate((s, t))
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                fits[i] = 100 * common >= percent * (len(both) - common)
            yield pa.record_batch([batch.column(0), batch.column(1)], names=["x", "y"]).filter(pa.array(fits))
        give_back()

    return run


RARE = "doc bigint, n bigint, component bigint, shingles binary"


def _rare_first(percent: int, counters: np.ndarray):
    """The shingles of a set that come first in the global order, rare first, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = []
            for value in batch.column(3):
                s = np.frombuffer(value.as_buffer(), dtype=np.uint64)
                # at least ceil(t n) shingles are common to any partner
                need = -(-percent * len(s) // 100)
                rank = np.lexsort((s, counters[(s >> np.uint64(44)).astype(np.int64)]))[: len(s) - need + 1]
                packed.append(s[rank].tobytes())
            columns = [batch.column(i) for i in range(3)]
            yield pa.record_batch([*columns, pa.array(packed, pa.binary())], names=["doc", "n", "component", "shingles"])

    return run


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All packed shingles of a batch, the row of each and its slot."""
    sets = [np.frombuffer(value.as_buffer(), dtype=np.uint64) for value in batch.column(3)]
    shingles = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    rows = np.repeat(np.arange(len(sets)), np.array([len(s) for s in sets], dtype=np.int64))
    return shingles, rows, (shingles >> np.uint64(64 - MEETING_BITS)).astype(np.int64)


MET = "block int, slots binary, low binary, high binary"


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task, the smallest and largest component of the shingles in each slot, in blocks of slots."""
    slots, low, high = (np.zeros(0, np.int64) for _ in range(3))
    for batch in batches:
        _, rows, slot = _flat(batch)
        component = batch.column(2).to_numpy(zero_copy_only=False)[rows]
        every, least = np.concatenate((slots, slot)), np.concatenate((low, component))
        most = np.concatenate((high, component))
        order = np.argsort(every, kind="stable")
        every = every[order]
        first = np.flatnonzero(np.concatenate(([True], every[1:] != every[:-1]))) if len(every) else every
        if len(every):
            slots = every[first]
            low, high = np.minimum.reduceat(least[order], first), np.maximum.reduceat(most[order], first)
    blocks, starts = np.unique(slots // MEETING_BLOCK, return_index=True)
    ends = [*starts, len(slots)][1:]
    own = (slots % MEETING_BLOCK).astype(np.int32)
    columns = [[x[s:e].tobytes() for s, e in zip(starts, ends, strict=True)] for x in (own, low, high)]
    arrays = [pa.array(blocks, pa.int32()), *[pa.array(c, pa.binary()) for c in columns]]
    yield pa.record_batch(arrays, names=["block", "slots", "low", "high"])


MEETINGS = "block int, open binary"


def _meetings(rows: pa.Table) -> pa.Table:
    """The slots of one block in which components meet, as bits."""
    low = np.full(MEETING_BLOCK, np.iinfo(np.int64).max)
    high = np.full(MEETING_BLOCK, np.iinfo(np.int64).min)
    for slots, least, most in zip(*(rows[c] for c in ("slots", "low", "high")), strict=True):
        at = np.frombuffer(slots.as_buffer(), np.int32)
        low[at] = np.minimum(low[at], np.frombuffer(least.as_buffer(), np.int64))
        high[at] = np.maximum(high[at], np.frombuffer(most.as_buffer(), np.int64))
    bits = np.packbits(low < high).tobytes()
    return pa.table({"block": rows["block"].slice(0, 1), "open": pa.array([bits], pa.binary())})


PREFIX = "shingle bigint, doc bigint, n bigint, component bigint, at bigint"


def _prefixes(open_: np.ndarray):
    """A row for each packed shingle whose slot is open, with its place in the order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        is_open = np.unpackbits(open_).view(bool)
        for batch in batches:
            shingles, owner, slot = _flat(batch)
            place = np.arange(len(owner)) - np.searchsorted(owner, owner)
            go = is_open[slot]
            rows = pa.array(owner[go])
            yield pa.record_batch(
                [
                    pa.array(shingles[go].view(np.int64)),
                    batch.column(0).take(rows),
                    batch.column(1).take(rows),
                    batch.column(2).take(rows),
                    pa.array(place[go]),
                ],
                names=["shingle", "doc", "n", "component", "at"],
            )

    return run


PREFIX_COLUMNS = ("doc", "n", "component", "at")


COUNTS = "block int, counts binary"
BLOCK = COUNTERS // 32


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task, how many shingles fall into each counter, in blocks of counters."""
    total = np.zeros(COUNTERS, dtype=np.int64)
    for batch in batches:
        for value in batch.column(0):
            s = np.frombuffer(value.as_buffer(), dtype=np.uint64)
            np.add.at(total, (s >> np.uint64(44)).astype(np.int64), 1)
    blocks = [k for k in range(COUNTERS // BLOCK) if total[k * BLOCK : (k + 1) * BLOCK].any()]
    packed = [zlib.compress(total[k * BLOCK : (k + 1) * BLOCK].tobytes(), 1) for k in blocks]
    yield pa.record_batch([pa.array(blocks, pa.int32()), pa.array(packed, pa.binary())], names=["block", "counts"])


def _added(rows: pa.Table) -> pa.Table:
    """The sum of one block of counters over all tasks."""
    total = np.zeros(BLOCK, dtype=np.int64)
    for value in rows["counts"].to_pylist():
        total += np.frombuffer(zlib.decompress(value), dtype=np.int64)
    return pa.table({"block": rows["block"].slice(0, 1), "counts": pa.array([total.tobytes()], pa.binary())})


def _fitting(n: str, m: str, percent: int):
    """Sizes alone allow the similarity."""
    return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & (F.least(n, m) > 0)


def verified_links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs (x, y) whose full sets are similar enough."""
    left = sets.select(F.col("doc").alias("x"), F.col("shingles").alias("s"))
    right = sets.select(F.col("doc").alias("y"), F.col("shingles").alias("t"))
    both = pairs.join(left, "x").join(right, "y").select("x", "y", "s", "t")
    return both.mapInArrow(_verified(percent), LINKS)


def near_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    size: int = SHINGLE,
    percent: int = PERCENT,
    bands: int = BANDS,
    rows: int = ROWS,
    crowd: int = CROWD,
) -> DataFrame:
    """(doc, n_shingles, component_id): one row per input row."""
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc"), F.col(text_col).alias("text"))
    signed = staged(texts.mapInArrow(_signed(size, bands, rows), SIGNED), "signatures")

    # equal sets are one document: the smallest id stands for them
    filled = signed.filter("n_shingles > 0 and doc is not null")
    folds = filled.groupBy("n_shingles", "a", "b").agg(F.min("doc").alias("lead"), F.max("doc").alias("most"))
    folds = staged(folds.filter("lead < most").drop("most"), "folds")
    same = ["n_shingles", "a", "b"]
    members = filled.join(folds, same).select("doc", "lead", F.col("n_shingles").alias("n"))
    members = staged(members, "copies")
    # a row goes with its own set: other rows of its id may hold other texts
    leads = filled.join(folds, same, "left").filter("lead is null or doc = lead")

    # buckets
    banded = leads.select("doc", F.col("n_shingles").alias("n"), F.explode("bands").alias("key"))
    buckets = banded.groupBy("key").agg(F.count("*").alias("m")).filter("m > 1")
    placed = staged(banded.join(buckets, "key"), "buckets")
    listed = (
        placed.filter(F.col("m") <= crowd)
        .groupBy("key")
        .agg(F.sort_array(F.collect_set(F.struct("doc", "n"))).alias("all"))
        .select(F.explode(F.transform("all", lambda u, i: F.struct(u.alias("u"), i.alias("i")))).alias("u"), "all")
        .select(F.col("u.u").alias("u"), F.explode(F.slice("all", F.col("u.i") + 2, crowd)).alias("v"))
        .select(F.col("u.doc").alias("x"), F.col("v.doc").alias("y"), F.col("u.n").alias("n"), F.col("v.n").alias("k"))
    )
    crowded = placed.filter(F.col("m") > crowd)
    # copies agree with their common source more than with one another: the source sits in the
    # largest buckets, so the member with the largest buckets in all is the one to compare with
    weight = crowded.groupBy("doc").agg(F.sum("m").alias("weight"))
    crowded = staged(crowded.join(weight, "doc").select("key", "doc", "n", "weight"), "crowded")
    order = F.struct("weight", (-F.col("doc")).alias("minus"), "n")
    heads = crowded.groupBy("key").agg(F.max(order).alias("h"))
    heads = heads.select("key", (-F.col("h.minus")).alias("head"), F.col("h.n").alias("k"))
    starred = crowded.join(heads, "key").select(
        F.least("head", "doc").alias("x"), F.greatest("head", "doc").alias("y"), "n", "k"
    )
    pairs = listed.unionByName(starred).filter("x < y").filter(_fitting("n", "k", percent)).select("x", "y").distinct()
    pairs = staged(pairs, "pairs")

    # sets of the documents that need one, made once from their texts
    wanted = pairs.select(F.explode(F.array("x", "y")).alias("doc"))
    wanted = wanted.unionByName(crowded.select("doc")).distinct()
    # texts are dealt by id at every size of the other side
    sets = staged(texts.join(wanted.hint("merge"), "doc", "left_semi").mapInArrow(_sets(size), SETS), "sets")
    copies = members.filter("doc > lead").select(F.col("lead").alias("x"), F.col("doc").alias("y"))
    links = staged(verified_links(pairs, sets, percent).unionByName(copies), "links")

    inside = connected_components(links)
    more = _crowded_links(crowded.select("doc").distinct(), sets, inside, percent)
    component = connected_components(links.unionByName(more))
    return signed.join(component, "doc", "left").select(
        "doc", "n_shingles", F.coalesce("component", "doc").alias("component_id")
    )


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with all their columns: those that are the smallest of their group."""
    groups = near_groups(docs, id_col, text_col)
    # only the ids that go are joined; a null id links with nothing and stays
    gone = staged(groups.filter("doc <> component_id").select("doc").distinct(), "gone")
    return docs.join(gone.hint("merge"), docs[id_col].cast("bigint") == gone["doc"], "left_anti")


def _crowded_links(crowded: DataFrame, sets: DataFrame, component: DataFrame, percent: int) -> DataFrame:
    """Links between crowded documents of different components, by rare-first prefixes."""
    spark = sets.sparkSession
    own = sets.join(crowded, "doc").join(component, "doc", "left")
    own = own.select("doc", "n", F.coalesce("component", "doc").alias("component"), "shingles")
    counters = np.zeros(COUNTERS, dtype=np.int64)
    summed = own.select("shingles").mapInArrow(_counted, COUNTS).groupBy("block").applyInArrow(_added, COUNTS)
    # COUNTERS numbers, whatever the input
    for row in summed.collect():
        counters[row["block"] * BLOCK : (row["block"] + 1) * BLOCK] = np.frombuffer(row["counts"], dtype=np.int64)
    rare = staged(own.mapInArrow(_rare_first(percent, counters), RARE), "rare-shingles")
    # a shingle of one component links nothing new: only those get rows that share a slot with another component
    open_ = np.zeros((1 << MEETING_BITS) // 8, dtype=np.uint8)
    met = rare.mapInArrow(_met, MET).groupBy("block").applyInArrow(_meetings, MEETINGS)
    # a bit per slot, whatever the input
    for row in met.collect():
        bits = np.frombuffer(row["open"], dtype=np.uint8)
        open_[row["block"] * len(bits) : (row["block"] + 1) * len(bits)] = bits
    prefixes = staged(rare.mapInArrow(_prefixes(open_), PREFIX), "prefixes")
    # a slot may hold several shingles
    shared = prefixes.groupBy("shingle").agg(F.min("component").alias("c0"), F.max("component").alias("c1"))
    members = prefixes.join(shared.filter("c0 < c1").select("shingle"), "shingle")
    x, y = (members.select("shingle", *[F.col(c).alias(f"{side}_{c}") for c in PREFIX_COLUMNS]) for side in "xy")
    # no more than what follows the first common shingle can be common
    most = F.least(F.col("x_n") - F.col("x_at"), F.col("y_n") - F.col("y_at"))
    enough = (100 + percent) * most >= percent * (F.col("x_n") + F.col("y_n"))
    pairs = x.join(y, (x["shingle"] == y["shingle"]) & (F.col("x_component") < F.col("y_component")) & enough)
    pairs = pairs.select(F.col("x_doc").alias("x"), F.col("y_doc").alias("y")).distinct()
    return staged(verified_links(staged(pairs, "crowded-pairs"), sets, percent), "crowded-links")
