"""Removal of word windows that repeat across documents, found by recompression.

Each text is rewritten in rounds. A round first names runs of one symbol, then
names every adjacent pair of a "left" and a "right" symbol, the two sides being
drawn by a hash of the symbol and the round. A name is a 64-bit hash of what it
stands for, so it is the same in every task without an exchange, and equal
stretches of words get equal symbols except near their ends. For every symbol the
words that decide it are known: its context. A window of `window` words owns the
symbols whose context lies inside it and picks one of them (highest round that
has any, longest span, largest hash, leftmost), so equal windows pick equal
symbols. Only these picks are shuffled, about one per 15 words:

1. per picked symbol, smallest and largest document, and whether its blocks (all
   the words of the windows that picked it) differ;
2. symbols of two or more documents are joined back. Equal blocks are settled at
   once: all but the smallest document lose them;
3. where the blocks of one symbol differ, one document per distinct block lists its
   windows, which are compared by a 128-bit fingerprint.

Defined results: null or empty text has no words and is kept as it is; texts with
fewer than `window` words lose nothing; windows are judged on the input and on
documents with a strictly smaller id, so repeats inside one document, and rows
with the same id, do not count as repeats; each row of an id that several texts
share is judged on its own; rows with a null id are never removed from and never
taken as a source. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from finchlab.llm.common import staged, tagged
from finchlab.llm.words import find_words, mix, pieces, stream, word_hashes

WINDOW = 50
ROUNDS = 4

_SALT = stream(64, 21)
_BASE = stream(2, 22) | np.uint64(1)
_NAME = stream(4, 23)
_NO = np.uint64(0)


def _inverse(odd: int) -> np.uint64:
    return np.uint64(pow(int(odd), -1, 2**64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


class Rolling:
    """Fingerprint of any range of a sequence of word hashes, from two prefix sums."""

    def __init__(self, hashes: np.ndarray):
        n = len(hashes)
        self.sums, self.back = [], []
        for base in _BASE:
            self.sums.append(np.concatenate(([_NO], np.cumsum(hashes * _powers(base, n), dtype=np.uint64))))
            self.back.append(_powers(_inverse(base), n + 1))

    def of(self, start: np.ndarray, end: np.ndarray, which: int) -> np.ndarray:
        raw = (self.sums[which][end] - self.sums[which][start]) * self.back[which][start]
        return mix(raw ^ mix((end - start).astype(np.uint64) + _NAME[2 + which]))


def _levels(hashes: np.ndarray, row: np.ndarray, begin: np.ndarray, finish: np.ndarray, rounds: int):
    """Per round: names, first word, end word, context start, context end of the symbols.

    `begin` and `finish` are the word range of each word's document. A context that
    reaches past the document is marked by a bound outside that range.
    """
    at = np.arange(len(hashes))
    name, start, end, left, right = hashes, at, at + 1, at, at + 1
    yield name, start, end, left, right
    for k in range(rounds):
        # runs of one symbol
        same = (name[1:] == name[:-1]) & (row[1:] == row[:-1])
        head = np.concatenate(([True], ~same))
        first = np.flatnonzero(head)
        last = np.concatenate((first[1:], [len(name)])) - 1
        length = last - first + 1
        inner = row[1:] == row[:-1]
        has_before = np.concatenate(([False], inner))[first]
        has_after = np.concatenate((inner, [False]))[last]
        run = name[first]
        long = length > 1
        run[long] = mix(run[long] ^ mix(length[long].astype(np.uint64) + _NAME[0]))
        # a run is known to be whole only with the symbols beside it
        n_left = np.where(has_before, left[np.maximum(first - 1, 0)], begin[start[first]] - 1)
        n_right = np.where(has_after, right[np.minimum(last + 1, len(name) - 1)], finish[start[first]] + 1)
        name, start, end, row = run, start[first], end[last], row[first]
        left, right = n_left, n_right
        # pairs of a left and a right symbol
        is_left = (mix(name ^ _SALT[k]) & np.uint64(1)).astype(bool)
        together = np.concatenate((is_left[:-1] & ~is_left[1:] & (row[1:] == row[:-1]), [False]))
        second = np.concatenate(([False], together[:-1]))
        inner = row[1:] == row[:-1]
        before = np.concatenate(([False], inner))
        after = np.concatenate((inner, [False]))
        nxt = np.minimum(np.arange(len(name)) + 1, len(name) - 1)
        prv = np.maximum(np.arange(len(name)) - 1, 0)
        # alone: a left symbol depends on what follows, a right one on what precedes
        n_right = np.where(is_left, np.where(after, right[nxt], finish[start] + 1), right)
        n_left = np.where(~is_left, np.where(before, left[prv], begin[start] - 1), left)
        n_right = np.where(together, np.maximum(right, right[nxt]), np.maximum(n_right, right))
        n_left = np.where(together, np.minimum(left, left[nxt]), np.minimum(n_left, left))
        joined = mix(mix(name + _NAME[1]) ^ (name[nxt] * _BASE[0]))
        n_name = np.where(together, joined, name)
        n_end = np.where(together, end[nxt], end)
        keep = ~second
        name, start, end, row = n_name[keep], start[keep], n_end[keep], row[keep]
        left, right = n_left[keep], n_right[keep]
        # widen contexts, where needed, so that both bounds rise with the position
        left = np.minimum.accumulate(left[::-1])[::-1]
        right = np.maximum.accumulate(right)
        yield name, start, end, left, right


def _largest(rank: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Index of the largest rank in [low, high), leftmost on ties; ranges are not empty."""
    table = [np.arange(len(rank))]
    widest = int((high - low).max())
    step = 1
    while 2 * step <= widest:
        a = table[-1]
        b = a[step:]
        a = a[: len(b)]
        table.append(np.where(rank[a] >= rank[b], a, b))
        step *= 2
    depth = np.frexp((high - low).astype(np.float64))[1] - 1
    out = np.empty(len(low), dtype=np.int64)
    for k, best in enumerate(table):
        pick = np.flatnonzero(depth == k)
        if len(pick):
            a, b = best[low[pick]], best[high[pick] - (1 << k)]
            out[pick] = np.where(rank[a] >= rank[b], a, b)
    return out


def picks(hashes: np.ndarray, rows: np.ndarray, window: int, rounds: int):
    """Symbol of every window, grouped: row, symbol, first window, windows.

    Windows that follow one another and pick the same symbol in the same place are
    one entry. Positions count words of the whole sequence.
    """
    sizes = np.diff(rows)
    row = np.repeat(np.arange(len(sizes)), sizes)
    begin, finish = np.repeat(rows[:-1], sizes), np.repeat(rows[1:], sizes)
    at = np.arange(len(hashes))
    todo = at[at + window <= finish]
    none = np.zeros(0, np.int64)
    if not len(todo):
        return none, none.astype(np.uint64), none, none
    symbol = np.empty(len(todo), dtype=np.uint64)
    place = np.empty(len(todo), dtype=np.int64)
    open_ = np.ones(len(todo), dtype=bool)
    for k, (name, start, end, left, right) in reversed(
        list(enumerate(_levels(hashes, row, begin, finish, rounds)))
    ):
        p = todo[open_]
        low = np.searchsorted(left, p, side="left")
        high = np.searchsorted(right, p + window, side="right")
        some = high > low
        if some.any():
            span = np.minimum(end - start, 15).astype(np.uint64)
            rank = (span << np.uint64(60)) | (mix(name + _NAME[3]) >> np.uint64(4))
            best = _largest(rank, low[some], high[some])
            where = np.flatnonzero(open_)[some]
            symbol[where] = mix(name[best] ^ _SALT[32 + k])
            place[where] = start[best] * 64 + k
            open_[where] = False
        if not open_.any():
            break
    new = np.ones(len(todo), dtype=bool)
    new[1:] = (place[1:] != place[:-1]) | (todo[1:] != todo[:-1] + 1) | (row[todo[1:]] != row[todo[:-1]])
    first = np.flatnonzero(new)
    count = np.diff(np.concatenate((first, [len(todo)])))
    return row[todo[first]], symbol[first], todo[first], count


ANCHORS = "doc bigint, tag bigint, symbol bigint, block bigint, first int, windows int"


def _anchors(window: int, rounds: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                words = find_words(part.column(2))
                hashes = word_hashes(words)
                row, symbol, first, count = picks(hashes, words.rows, window, rounds)
                block = Rolling(hashes).of(first, first + count + window - 1, 0)
                yield pa.record_batch(
                    [
                        part.column(0).take(pa.array(row)),
                        part.column(1).take(pa.array(row)),
                        pa.array(symbol.view(np.int64)),
                        pa.array(block.view(np.int64)),
                        pa.array((first - words.rows[row]).astype(np.int32)),
                        pa.array(count.astype(np.int32)),
                    ],
                    names=["doc", "tag", "symbol", "block", "first", "windows"],
                )

    return run


WINDOWS = "doc bigint, tag bigint, a bigint, b bigint, first int"


def _windows(window: int):
    """Fingerprints of the listed windows of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(batch.column(3).is_valid())
            for part in pieces(batch, "text"):
                words = find_words(part.column(2))
                rolling = Rolling(word_hashes(words))
                spans = part.column(3)
                row = np.repeat(np.arange(part.num_rows), spans.value_lengths().to_numpy(zero_copy_only=False))
                flat = spans.flatten()
                first = flat.field(0).to_numpy(zero_copy_only=False).astype(np.int64)
                count = flat.field(1).to_numpy(zero_copy_only=False).astype(np.int64)
                if not len(row):
                    continue
                inner = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                own = np.repeat(row, count)
                local = np.repeat(first, count) + inner
                p = words.rows[own] + local
                yield pa.record_batch(
                    [
                        part.column(0).take(pa.array(own)),
                        part.column(1).take(pa.array(own)),
                        pa.array(rolling.of(p, p + window, 0).view(np.int64)),
                        pa.array(rolling.of(p, p + window, 1).view(np.int64)),
                        pa.array(local.astype(np.int32)),
                    ],
                    names=["doc", "tag", "a", "b", "first"],
                )

    return run


def repeated_windows(texts: DataFrame, window: int = WINDOW, rounds: int = ROUNDS) -> DataFrame:
    """(doc, tag, spans): per row of `tagged` texts the windows that start in a document with a smaller id.

    `spans` is an array of (first window, number of windows), in words of the document.
    """
    anchors = texts.mapInArrow(_anchors(window, rounds), ANCHORS).filter("doc is not null")
    symbols = (
        anchors.groupBy("symbol")
        .agg(
            F.min("doc").alias("least"),
            F.max("doc").alias("most"),
            F.min("block").alias("b0"),
            F.max("block").alias("b1"),
        )
        .filter("least < most")
        .select("symbol", "least", (F.col("b0") < F.col("b1")).alias("mixed"))
    )
    # written first, the join has an exchange on both sides and a frequent symbol can be split
    symbols = staged(symbols, "symbols")
    # read three times below, and a small part of all picks: written once
    shared = staged(anchors.join(symbols, "symbol"), "shared-symbols")
    settled = shared.filter("not mixed and doc > least").select("doc", "tag", "first", "windows")
    mixed = shared.filter("mixed").select("doc", "tag", "symbol", "block", "first", "windows")
    classes = staged(mixed.groupBy("symbol", "block").agg(F.min("doc").alias("least")), "classes")
    placed = mixed.join(classes, ["symbol", "block"])
    copied = placed.filter("doc > least").select("doc", "tag", "first", "windows")
    listed = (
        placed.filter("doc = least")
        .groupBy("doc", "tag")
        .agg(F.collect_list(F.struct("first", "windows")).alias("spans"))
    )
    windows = texts.join(listed, ["doc", "tag"], "left").select("doc", "tag", "text", "spans")
    windows = windows.mapInArrow(_windows(window), WINDOWS)
    owners = windows.groupBy("a", "b").agg(F.min("doc").alias("least"), F.max("doc").alias("most"))
    later = windows.join(owners.filter("least < most").drop("most"), ["a", "b"]).filter("doc > least")
    single = later.select("doc", "tag", "first", F.lit(1).alias("windows"))
    return (
        settled.unionByName(copied)
        .unionByName(single)
        .groupBy("doc", "tag")
        .agg(F.collect_list(F.struct("first", "windows")).alias("spans"))
    )


TRIMMED = "doc bigint, n_words bigint, n_removed bigint, kept_text string"


def _trim(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                words = find_words(part.column(1))
                n = words.counts
                gone = np.zeros(len(words.starts) + 1, dtype=np.int64)
                spans = part.column(2)
                sizes = spans.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                flat = spans.flatten()
                if len(flat):
                    row = np.repeat(np.arange(part.num_rows), sizes)
                    first = words.rows[row] + flat.field(0).to_numpy(zero_copy_only=False)
                    end = first + flat.field(1).to_numpy(zero_copy_only=False) + window - 1
                    np.add.at(gone, first, 1)
                    np.add.at(gone, end, -1)
                removed = np.cumsum(gone)[:-1] > 0
                total = np.concatenate(([0], np.cumsum(removed)))
                lost = total[words.rows[1:]] - total[words.rows[:-1]]
                kept = []
                for i in range(part.num_rows):
                    which = np.arange(words.rows[i], words.rows[i + 1])
                    kept.append(words.text(which[~removed[which]] if lost[i] else which))
                yield pa.record_batch(
                    [
                        part.column(0),
                        pa.array(n.astype(np.int64)),
                        pa.array(lost.astype(np.int64)),
                        pa.array(kept, pa.binary()).cast(pa.string()),
                    ],
                    names=["doc", "n_words", "n_removed", "kept_text"],
                )

    return run


def trim_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, rounds: int = ROUNDS
) -> DataFrame:
    """One row per input row: doc, n_words, n_removed and the kept words joined by one space."""
    texts = tagged(docs, id_col, text_col)
    spans = repeated_windows(texts, window, rounds)
    whole = texts.join(spans, ["doc", "tag"], "left").select("doc", "text", "spans")
    return whole.mapInArrow(_trim(window), TRIMMED)
