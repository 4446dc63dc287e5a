"""Removal of repeated byte strings, found in suffix order by prefix-free parsing.

A rolling hash is taken of every `trigger` bytes. In each window of `window` bytes the
place with the smallest hash is its trigger (leftmost on ties), so equal windows have the
same trigger at the same distance. Triggers cut the texts into phrases; a phrase ends with
the whole trigger string, so no phrase suffix is a proper prefix of another, and a window is
a suffix of the phrase before its trigger followed by a prefix of the parse behind it. All
windows of one trigger lie in a block of at most 2 * window - trigger bytes.

1. Trigger strings are counted. Windows whose trigger occurs once cannot repeat: most of a
   text that is not repetitive ends here.
2. Blocks of the others are grouped by trigger and block. Of equal blocks all but the first
   lose all windows; triggers with a single block are settled.
3. For triggers with several blocks, the first of each travels as bytes to the task of its
   trigger. There the dictionary, the distinct phrases before the triggers, is sorted by
   its suffixes, and so is the parse, the text from the triggers on; both with the length
   of the common prefix of neighbours. For every distance from the trigger, the two orders
   combine into the corpus order of the windows, where neighbours whose common prefix is as
   long as the window are one string; its first occurrence stays. Phrase suffixes end where
   their triggers do, so one sort from the right end orders those of all lengths.
   A trigger with more than `crowd` blocks would be too much for a task; its windows are
   grouped by a 128-bit fingerprint instead, which Spark can spread. The result is the same.

Defined results: null or empty text has no bytes; texts shorter than `window` lose nothing;
matches never cross rows; rows with a null id are never removed from and never taken as a
source; of rows that repeat an id, the one with the smaller hash of its text comes first,
and rows that repeat both id and text are treated alike, none coming before another. Equal
blocks are told by 128 bits (trigger and block). Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from finchlab.llm.common import staged, tagged
from finchlab.llm.words import column_bytes, mix, pieces, stream

WINDOW = 100
TRIGGER = 24
CROWD = 4096

_CHUNK = 1 << 18
_PIECE = 1 << 20
_PLACE_BITS = np.uint64(20)
_ODD = stream(16, 41) | np.uint64(1)
_CODE = stream(512, 42).reshape(2, 256)
_BASE = stream(2, 43) | np.uint64(1)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POWER = [_powers(int(b), _CHUNK + 1024) for b in _BASE]
_BACK = [_powers(pow(int(b), -1, 2**64), _CHUNK + 1024) for b in _BASE]


def fingerprints(data: np.ndarray, start: np.ndarray, end: np.ndarray, which: int) -> np.ndarray:
    """A 64-bit hash of each range of at most `_CHUNK` + 1,000 bytes of data."""
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_CODE[which][data] * _POWER[which][: len(data)], dtype=np.uint64, out=sums[1:])
    raw = (sums[end] - sums[start]) * _BACK[which][start]
    return mix(raw ^ mix((end - start).astype(np.uint64) + _BASE[1 - which]))


def _rolling(data: np.ndarray, trigger: int) -> np.ndarray:
    """A hash of every `trigger` bytes, a multiple of 8, from words of 8 bytes."""
    n = len(data) - 7
    eight = np.empty(n, dtype=np.uint64)
    for k in range(8):
        own = len(eight[k::8])
        eight[k::8] = data[k : k + 8 * own].view("<u8")
    eight *= _ODD[0]
    eight ^= eight >> np.uint64(32)
    n -= trigger - 8
    out = eight[:n] * _ODD[1]
    for k in range(1, trigger // 8):
        out += eight[8 * k : 8 * k + n] * _ODD[1 + k]
    out ^= out >> np.uint64(29)
    out *= _ODD[0]
    return out


def _smallest(ranked: np.ndarray, width: int) -> np.ndarray:
    """The smallest of every `width` neighbours."""
    span, least = 1, ranked
    while 2 * span <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    n = len(ranked) - width + 1
    return np.minimum(least[:n], least[width - span : width - span + n])


def parse(data: np.ndarray, marks: np.ndarray, window: int, trigger: int, block: bool = True):
    """The triggers of texts: row, hash of the trigger, block fingerprint, first window, windows, place.

    `marks` are the text bounds in `data`. Windows that follow one another and have the
    same trigger are one entry. Yielded for about `_CHUNK` bytes at once.
    """
    width = window - trigger + 1
    n = len(data) - window + 1
    if n <= 0:
        return
    sizes = np.diff(marks)
    low = 0
    mask = (np.uint64(1) << _PLACE_BITS) - np.uint64(1)
    while low < n:
        high = min(low + _CHUNK, n)
        row = np.searchsorted(marks, np.array([low, high]), side="right") - 1
        near = np.arange(row[0], min(row[1], len(sizes) - 1) + 1)
        own = data[low : high + window - 1]
        hashes = _rolling(own, trigger)
        ranked = (hashes & ~mask) | np.arange(len(hashes), dtype=np.uint64)
        place = (_smallest(ranked, width) & mask).astype(np.int64)
        # windows that end inside their text
        inside = np.zeros(high - low + 1, dtype=np.int64)
        first = np.clip(marks[near] - low, 0, high - low)
        last = np.clip(marks[near + 1] - window + 1 - low, first, high - low)
        np.add.at(inside, first, 1)
        np.add.at(inside, last, -1)
        starts = np.flatnonzero(np.cumsum(inside[:-1]) > 0)
        if not len(starts):
            low = high
            continue
        place = place[starts]
        new = np.flatnonzero(np.concatenate(([True], (place[1:] != place[:-1]) | (starts[1:] != starts[:-1] + 1))))
        count = np.diff(np.concatenate((new, [len(starts)])))
        start, place = starts[new], place[new]
        if high < n:  # the last entry may go on
            low += int(start[-1]) if start[-1] else high - low
            start, place, count = start[:-1], place[:-1], count[:-1]
            base = high if not len(start) else None
        else:
            base, low = None, n
        if base is not None and not len(start):
            continue
        offset = high - len(own) + window - 1
        prints = fingerprints(own, start, start + count + window - 1, 0) if block else None
        at = start + offset
        yield np.searchsorted(marks, at, side="right") - 1, mix(hashes[place]), prints, at, count, place + offset


def _packed(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    return first.astype(np.int64) << 8 | count


ENTRY = "key bigint, block bigint, doc bigint, tag bigint, pos bigint"


def _entries(window: int, trigger: int, block: bool):
    """All entries of each text; `pos` is the first window and the number of windows in 8 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text", _PIECE):
                data, marks = column_bytes(part.column(2))
                for row, key, prints, first, count, _ in parse(data, marks, window, trigger, block):
                    columns = [pa.array(key.view(np.int64))]
                    if block:
                        columns += [
                            pa.array(prints.view(np.int64)),
                            part.column(0).take(pa.array(row)),
                            part.column(1).take(pa.array(row)),
                            pa.array(_packed(first - marks[row], count)),
                        ]
                    yield pa.record_batch(columns, names=["key", "block", "doc", "tag", "pos"][: len(columns)])

    return run


CUT = "key bigint, print bigint, doc bigint, tag bigint, first bigint, block binary"


def _cut(window: int):
    """The bytes of listed blocks, or, for crowded triggers, the fingerprints of their windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text", _PIECE):
                data, marks = column_bytes(part.column(2))
                listed = part.column(3)
                row = np.repeat(np.arange(part.num_rows), listed.value_lengths().to_numpy(zero_copy_only=False))
                if not len(row):
                    continue
                flat = listed.flatten()
                pos = flat.field(0).to_numpy(zero_copy_only=False)
                crowded = flat.field(2).to_numpy(zero_copy_only=False)
                first, size = pos >> 8, (pos & 255) + window - 1
                start = marks[row] + first
                doc, tag = part.column(0).take(pa.array(row)), part.column(1).take(pa.array(row))
                few = np.flatnonzero(~crowded)
                if len(few):
                    whole = [data[s : s + n].tobytes() for s, n in zip(start[few], size[few], strict=True)]
                    yield pa.record_batch(
                        [
                            flat.field(1).take(pa.array(few)),
                            pa.nulls(len(few), pa.int64()),
                            doc.take(pa.array(few)),
                            tag.take(pa.array(few)),
                            pa.array(first[few]),
                            pa.array(whole, pa.binary()),
                        ],
                        names=["key", "print", "doc", "tag", "first", "block"],
                    )
                many = np.flatnonzero(crowded)
                step = _CHUNK // (window + 255)
                for low in range(0, len(many), step):
                    some = many[low : low + step]
                    joined = np.concatenate([data[s : s + n] for s, n in zip(start[some], size[some], strict=True)])
                    begin = np.concatenate(([0], np.cumsum(size[some])[:-1]))
                    windows = size[some] - window + 1
                    own = np.repeat(np.arange(len(some)), windows)
                    inner = np.arange(len(own)) - np.repeat(np.cumsum(windows) - windows, windows)
                    p = begin[own] + inner
                    yield pa.record_batch(
                        [
                            pa.array(fingerprints(joined, p, p + window, 0).view(np.int64)),
                            pa.array(fingerprints(joined, p, p + window, 1).view(np.int64)),
                            doc.take(pa.array(some[own])),
                            tag.take(pa.array(some[own])),
                            pa.array(first[some[own]] + inner),
                            pa.nulls(len(own), pa.binary()),
                        ],
                        names=["key", "print", "doc", "tag", "first", "block"],
                    )

    return run


def suffix_order(group: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows of `text` inside their groups, and the common prefix of each with the one before.

    -1 stands before the first of a group. `text` is a matrix of bytes, padded with zeros.
    """
    n, width = text.shape
    wide = np.zeros((n, -(-width // 8) * 8), dtype=np.uint8)
    wide[:, :width] = text
    columns = wide.view(">u8").astype(np.uint64)
    order = np.lexsort((*columns.T[::-1], group))
    sorted_ = text[order]
    differs = np.ones((n, width + 1), dtype=bool)
    differs[1:, :width] = sorted_[1:] != sorted_[:-1]
    common = differs.argmax(axis=1)
    new = np.ones(n, dtype=bool)
    new[1:] = group[order][1:] != group[order][:-1]
    common[new] = -1
    return order, common


def _classes(order: np.ndarray, common: np.ndarray, depth: int) -> np.ndarray:
    """A number per row: equal for rows that share a prefix of `depth` bytes, rising in suffix order."""
    out = np.empty(len(order), dtype=np.int64)
    out[order] = np.cumsum(common < depth)
    return out


def first_windows(
    group: np.ndarray, data: np.ndarray, marks: np.ndarray, place: np.ndarray, age: np.ndarray, window: int
) -> np.ndarray:
    """Which windows of which blocks are the first of their string: a matrix, blocks by window number.

    `place` is the trigger of each block in `data`; blocks of one group have the same
    trigger. `age` orders the blocks by document and place.
    """
    n = len(place)
    far = place - marks[:-1]  # distance of the first window from the trigger
    near = far - (np.diff(marks) - window)  # of the last one
    deepest = int(far.max())
    # dictionary: distinct phrases that end at the triggers, read from there to the left
    back = place[:, None] - 1 - np.arange(max(deepest, 1))[None, :]
    left = np.where(back >= marks[:-1, None], data[np.maximum(back, 0)], 0).astype(np.uint8)
    l_order, l_common = suffix_order(group, left)
    # parse: the text from the triggers on
    ahead = place[:, None] + np.arange(window)[None, :]
    right = np.where(ahead < marks[1:, None], data[np.minimum(ahead, len(data) - 1)], 0).astype(np.uint8)
    r_order, r_common = suffix_order(group, right)
    out = np.zeros((n, deepest + 1), dtype=bool)
    for d in range(deepest + 1):
        own = np.flatnonzero((near <= d) & (d <= far))
        if not len(own):
            continue
        # corpus order of the windows that begin d bytes before their triggers
        rank = _classes(l_order, l_common, d)[own] * (n + 1) + _classes(r_order, r_common, window - d)[own]
        order = np.argsort(rank, kind="stable")
        own, rank = own[order], rank[order]
        start = np.flatnonzero(np.concatenate(([True], rank[1:] != rank[:-1])))
        least = np.repeat(np.minimum.reduceat(age[own], start), np.diff(np.concatenate((start, [len(own)]))))
        first = own[age[own] == least]
        out[first, far[first] - d] = True
    return out


KEPT = "doc bigint, tag bigint, pos bigint"


def _ordered(window: int, trigger: int):
    """Windows that are the first of their string, of blocks that come sorted by trigger."""

    def settled(part: pa.RecordBatch) -> pa.RecordBatch:
        key, doc, tag, first = (part.column(i).to_numpy(zero_copy_only=False) for i in (0, 2, 3, 4))
        group = np.concatenate(([0], np.cumsum(key[1:] != key[:-1])))
        data, marks = column_bytes(part.column(5))
        place = np.concatenate([p for *_, p in parse(data, marks, window, trigger, False)])
        age = np.empty(len(key), dtype=np.int64)
        age[np.lexsort((first + place - marks[:-1], tag, doc))] = np.arange(len(key))
        keep = first_windows(group, data, marks, place, age, window)
        edge = np.diff(np.pad(keep, ((0, 0), (1, 1))).astype(np.int8), axis=1)
        row, begin = np.nonzero(edge == 1)
        end = np.nonzero(edge == -1)[1]
        pos = _packed(first[row] + begin, end - begin)
        return pa.record_batch([pa.array(doc[row]), pa.array(tag[row]), pa.array(pos)], names=["doc", "tag", "pos"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # the blocks of a trigger whose last ones have not come yet
        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column(0).to_numpy(zero_copy_only=False)
            cut = int(np.searchsorted(key, key[-1]))
            if cut or (held and held[-1].column(0)[0].as_py() != key[0]):
                whole = pa.Table.from_batches([*held, batch.slice(0, cut)]).combine_chunks()
                held = []
                for part in whole.to_batches():
                    yield settled(part)
            held.append(batch.slice(cut))
        if held:
            for part in pa.Table.from_batches(held).combine_chunks().to_batches():
                yield settled(part)

    return run


TRIMMED = "doc bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary"


def _trim(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text", _PIECE):
                data, marks = column_bytes(part.column(1))
                gone = np.zeros(len(data) + 1, dtype=np.int32)
                back = np.zeros(len(data) + 1, dtype=np.int32)
                listed = part.column(2)
                sizes = listed.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                row = np.repeat(np.arange(part.num_rows), sizes)
                flat = listed.flatten().to_numpy(zero_copy_only=False)
                for out, which in ((gone, flat >= 0), (back, flat < 0)):
                    pos = flat[which]
                    pos = np.where(pos < 0, ~pos, pos)
                    first = marks[row[which]] + (pos >> 8)
                    np.add.at(out, first, 1)
                    np.add.at(out, first + (pos & 255), -1)
                starts = (np.cumsum(gone[:-1]) > 0) & (np.cumsum(back[:-1]) <= 0)
                total = np.cumsum(starts, dtype=np.int64)
                total[window:] -= total[:-window].copy() if len(total) > window else 0
                covered = total > 0
                head = covered.copy()
                head[1:] &= ~covered[:-1]
                begins = marks[:-1][marks[:-1] < len(data)]
                head[begins] = covered[begins]
                removed = np.concatenate(([0], np.cumsum(covered)))
                spans = np.concatenate(([0], np.cumsum(head)))
                kept = data[~covered]
                ends = (marks - removed[marks]).astype(np.int32)
                kept = pa.Array.from_buffers(
                    pa.binary(), part.num_rows, [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(kept.tobytes())]
                )
                columns = [np.diff(marks), np.diff(removed[marks]), np.diff(spans[marks])]
                yield pa.record_batch(
                    [part.column(0), *[pa.array(c.astype(np.int64)) for c in columns], kept],
                    names=["doc", "n_bytes", "n_removed", "n_spans", "kept"],
                )

    return run


def window_marks(texts: DataFrame, window: int = WINDOW, trigger: int = TRIGGER, crowd: int = CROWD) -> DataFrame:
    """(doc, tag, marks) of texts with repeated triggers.

    A mark names windows by their first one and their number, in the lowest 8 bits. Those
    from 0 on occur earlier, unless a negative mark, its bits inverted, calls them first.
    """
    if trigger % 8 or not 8 <= trigger <= window or window - trigger > 254:
        raise ValueError("a trigger has a multiple of 8 bytes, and at most 254 less than a window")
    known = texts.filter("doc is not null")
    shared = (
        known.mapInArrow(_entries(window, trigger, False), "key bigint")
        .groupBy("key")
        .agg(F.count("*").alias("n"))
        .filter("n > 1")
        .select("key")
    )
    # written first, the join has an exchange on both sides and a frequent trigger can be split
    shared = staged(shared, "shared-triggers")
    entries = staged(known.mapInArrow(_entries(window, trigger, True), ENTRY).join(shared, "key"), "shared-entries")
    first = F.min(F.struct("doc", "tag", "pos")).alias("first")
    classes = staged(entries.groupBy("key", "block").agg(first).select("key", "first.*"), "blocks")
    mixed = staged(classes.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "mixed-triggers")
    alone = classes.join(mixed, "key", "left_anti").select("doc", "tag", "pos")
    listed = (
        classes.join(mixed, "key")
        .groupBy("doc", "tag")
        .agg(F.collect_list(F.struct("pos", "key", (F.col("n") > crowd).alias("crowded"))).alias("blocks"))
    )
    cut = staged(known.join(listed, ["doc", "tag"]).mapInArrow(_cut(window), CUT), "cut-blocks")
    few = cut.filter("block is not null").repartition("key").sortWithinPartitions("key")
    ordered = few.mapInArrow(_ordered(window, trigger), KEPT)
    earliest = F.min(F.struct("doc", "tag", "first")).alias("first")
    many = cut.filter("block is null").groupBy("key", "print").agg(earliest).select("first.*")
    many = many.select("doc", "tag", F.expr("shiftleft(first, 8) + 1").alias("pos"))
    kept = alone.unionByName(ordered).unionByName(many).withColumn("pos", F.expr("~pos"))
    marks = entries.select("doc", "tag", "pos").unionByName(kept)
    return marks.groupBy("doc", "tag").agg(F.collect_list("pos").alias("marks"))


def trim_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    window: int = WINDOW, trigger: int = TRIGGER, crowd: int = CROWD,
) -> DataFrame:
    """One row per input row: doc, n_bytes, n_removed, n_spans and the bytes that stay (`kept`)."""
    texts = tagged(docs, id_col, text_col)
    marks = window_marks(texts, window, trigger, crowd)
    whole = texts.join(marks, ["doc", "tag"], "left").select("doc", "text", "marks")
    return whole.mapInArrow(_trim(window), TRIMMED)
