"""Stupid-backoff scores of documents against n-gram counts of all other documents.

The score of a word is `count(n-gram) / count(context)` for the longest n-gram that
occurs in another document, times `BACKOFF` per step down; for single words the count
over all words. A document's own occurrences are taken off every count, so that it is
scored by the rest of the corpus and backs off at all.

Counts are relations keyed by the 64-bit hash of an n-gram and partitioned by it. To
carry hundreds of n-grams per document cheaply, rows are packed: documents are dealt to
chunks of about `CHUNK_BYTES`; a chunk sends, per hash partition, one row with the
sorted distinct hashes of its n-grams and their counts. A partition adds them up and
joins the sums back to each chunk's hashes, in the chunk's order, so that only counts
return; the chunk joins them to the n-grams of its documents and sums per document. A
frequent n-gram is one entry per chunk, wherever it occurs, and chunks and partitions
both grow in number with the corpus.

Defined results: null or empty text has no words, log_score 0 and a null mean; ids may
be null or repeat, each row is a document of its own; a word that no other document
has counts as `BACKOFF` over the number of all words. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from finchlab.llm.words import Words, find_words, mix, pieces, stream, word_hashes

ORDER = 2
BACKOFF = 0.4
CHUNK_BYTES = 8 << 20

_PLACE = stream(16, 51) | np.uint64(1)

SIZES = "bytes bigint, words bigint"


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    size = words = 0
    for batch in batches:
        for part in pieces(batch, "text"):
            found = find_words(part.column(0))
            size += len(found.data)
            words += len(found.starts)
    yield pa.record_batch([pa.array([size]), pa.array([words])], names=["bytes", "words"])


class Grams:
    """The n-grams of a chunk: distinct hashes in partition order, and each position's place among them."""

    def __init__(self, words: Words, order: int, parts: int):
        hashes = word_hashes(words, lower=True)
        self.rows = words.rows
        counts = words.counts
        self.owner = np.repeat(np.arange(len(counts)), counts)
        place = np.arange(len(hashes)) - self.rows[self.owner]
        every, self.at = [], []
        for n in range(1, order + 1):
            # the n-gram that ends at each word with n - 1 words before it
            ends = np.flatnonzero(place >= n - 1)
            value = np.full(len(ends), np.uint64(n))
            for k in range(n):
                value += hashes[ends - k] * _PLACE[k]
            self.at.append(ends)
            every.append(mix(value))
        # partition by the high bits, so sorted hashes are in partition order
        self.distinct, inverse, self.counts = np.unique(
            np.concatenate(every), return_inverse=True, return_counts=True
        )
        self.index = np.split(inverse, np.cumsum([len(e) for e in every])[:-1])
        self.part = part_of(self.distinct, parts)

    def blocks(self) -> Iterator[tuple[int, slice]]:
        if not len(self.part):
            return
        first = np.flatnonzero(np.concatenate(([True], self.part[1:] != self.part[:-1])))
        for s, e in zip(first, [*first[1:], len(self.part)], strict=True):
            yield int(self.part[s]), slice(int(s), int(e))


def part_of(hashes: np.ndarray, parts: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int32)


BLOCKS = "chunk bigint, part int, hashes binary, counts binary"


def _packed(counts: np.ndarray) -> bytes:
    """Mostly ones and other small numbers."""
    return zlib.compress(counts.astype("<u4").tobytes(), 1)


def _unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data), dtype="<u4")


def _chunk_blocks(order: int, parts: int):
    def run(chunk: pa.Table) -> pa.Table:
        grams = Grams(find_words(chunk["text"].combine_chunks()), order, parts)
        blocks = list(grams.blocks())
        return pa.table(
            {
                "chunk": pa.array([chunk["chunk"][0].as_py()] * len(blocks), pa.int64()),
                "part": pa.array([p for p, _ in blocks], pa.int32()),
                "hashes": pa.array([grams.distinct[s].tobytes() for _, s in blocks], pa.binary()),
                "counts": pa.array([_packed(grams.counts[s]) for _, s in blocks], pa.binary()),
            }
        )

    return run


SUMS = "chunk bigint, part int, sums binary"


def _partition_sums(blocks: pa.Table) -> pa.Table:
    """The count table of one hash partition, joined back to the hashes of every chunk."""
    hashes = [np.frombuffer(b.as_buffer(), dtype=np.uint64) for b in blocks["hashes"]]
    counts = np.concatenate([_unpacked(b.as_py()) for b in blocks["counts"]])
    _, inverse = np.unique(np.concatenate(hashes), return_inverse=True)
    total = np.bincount(inverse, weights=counts).astype(np.int64)
    marks = np.cumsum([0, *map(len, hashes)])
    sums = [_packed(total[inverse[s:e]]) for s, e in zip(marks[:-1], marks[1:], strict=True)]
    return pa.table({"chunk": blocks["chunk"], "part": blocks["part"], "sums": pa.array(sums, pa.binary())})


SCORES = "doc bigint, n_words bigint, log_score double"


def _scores(order: int, parts: int, backoff: float, all_words: int):
    def run(chunk: pa.Table, sums: pa.Table) -> pa.Table:
        words = find_words(chunk["text"].combine_chunks())
        grams = Grams(words, order, parts)
        rows = sorted(zip(sums["part"].to_pylist(), sums["sums"].to_pylist(), strict=True))
        total = np.concatenate([_unpacked(data) for _, data in rows] or [np.zeros(0, np.uint32)]).astype(np.int64)
        n = len(grams.owner)
        # occurrences elsewhere of the n-gram that ends at each word, by n
        elsewhere = []
        for ends, index in zip(grams.at, grams.index, strict=True):
            key = grams.owner[ends] * max(len(grams.distinct), 1) + index
            _, inverse, own = np.unique(key, return_inverse=True, return_counts=True)
            left = np.zeros(n, dtype=np.int64)
            left[ends] = total[index] - own[inverse]
            elsewhere.append(left)
        others = all_words - words.counts[grams.owner]
        single = elsewhere[0]
        value = np.log(np.where(single > 0, single, backoff) / np.maximum(np.where(single > 0, others, all_words), 1))
        for k in range(1, order):
            here = elsewhere[k] > 0
            context = np.concatenate(([0], elsewhere[k - 1][:-1]))
            ratio = np.log(np.where(here, elsewhere[k], 1) / np.maximum(context, 1))
            # words too early in the document for this order have nothing to back off from
            reach = np.zeros(n, dtype=bool)
            reach[grams.at[k]] = True
            value = np.where(here, ratio, value + np.where(reach, np.log(backoff), 0.0))
        sums_ = np.concatenate(([0.0], np.cumsum(value)))
        score = sums_[grams.rows[1:]] - sums_[grams.rows[:-1]]
        return pa.table(
            {"doc": chunk["doc"], "n_words": pa.array(words.counts.astype(np.int64)), "log_score": pa.array(score)}
        )

    return run


def scored(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    order: int = ORDER,
    backoff: float = BACKOFF,
    chunk_bytes: int = CHUNK_BYTES,
) -> DataFrame:
    """One row per input row: doc, n_words, log_score (natural logarithm) and mean_log_score."""
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc"), F.col(text_col).alias("text"))
    size = texts.select("text").mapInArrow(_sizes, SIZES).agg(F.sum("bytes").alias("b"), F.sum("words").alias("w")).first()
    chunks = max(1, -(-(size["b"] or 0) // chunk_bytes))
    chunk = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(chunks))
    dealt = texts.select("doc", "text", chunk.alias("chunk"))
    blocks = dealt.groupBy("chunk").applyInArrow(_chunk_blocks(order, chunks), BLOCKS)
    sums = blocks.groupBy("part").applyInArrow(_partition_sums, SUMS)
    scores = _scores(order, chunks, backoff, size["w"] or 0)
    out = dealt.groupBy("chunk").cogroup(sums.groupBy("chunk")).applyInArrow(scores, SCORES)
    return out.withColumn("mean_log_score", F.when(F.col("n_words") > 0, F.col("log_score") / F.col("n_words")))
