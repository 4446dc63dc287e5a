"""Packing token sequences into windows by the online sum-of-squares rule.

Each task packs the documents it reads. A document longer than a window gives full
windows; what remains is placed into the fill level that leaves the smallest sum of
squared counts of partly filled windows, read off an array with one count per level.
Ties go to the fullest window. When a task has no more documents, the pieces of its
emptiest open windows are cut to fill its fullest ones, so that at most one window
per task stays partly filled.

Pieces are written once, then numbered: windows of earlier tasks come first. Only
pieces are written, not ids.

Defined results: null text counts as empty and has the end id alone; rows that repeat
an id are packed separately; a null id is kept; an empty table gives no piece. Extra
columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from finchlab.llm.common import staged
from finchlab.llm.tokens import encoder
from finchlab.llm.words import give_back, pieces

WINDOW = 4096
END_ID = 2

# a piece: row number, start in its document, ids, document's tokens
Piece = tuple[int, int, np.ndarray, int]


class SumOfSquares:
    """Open windows by fill level, and the count of each level."""

    def __init__(self, size: int):
        self.size = size
        self.count = np.zeros(size + 1, dtype=np.int64)
        self.open: dict[int, list[list[Piece]]] = defaultdict(list)
        self.levels = np.arange(size + 1)

    def place(self, piece: Piece) -> list[Piece] | None:
        """Put a piece of less than a window; the window, if that fills it."""
        n = len(piece[2])
        before = self.count[: self.size - n + 1]
        after = self.count[n:]
        # change of the sum: a window leaves its level and enters another; a full one counts no more
        change = 1 - 2 * before
        change[0] = 0
        change[:-1] += 2 * after[: len(before) - 1] + 1
        allowed = before > 0
        allowed[0] = True
        change = np.where(allowed, change, np.iinfo(np.int64).max)
        best = len(change) - 1 - int(np.argmin(change[::-1]))
        if best:
            window = self.open[best].pop()
            self.count[best] -= 1
        else:
            window = []
        window.append(piece)
        if best + n == self.size:
            return window
        self.open[best + n].append(window)
        self.count[best + n] += 1
        return None

    def drain(self) -> Iterator[list[Piece]]:
        """Close all windows: the emptiest are cut up to fill the fullest."""
        rest = [w for level in sorted(self.open, reverse=True) for w in self.open[level]]
        spare: list[Piece] = []
        for at in range(len(rest)):
            if at >= len(rest):
                break
            window = rest[at]
            room = self.size - sum(len(p[2]) for p in window)
            while room and (spare or len(rest) > at + 1):
                if not spare:
                    spare = rest.pop()
                row, start, ids, total = spare.pop()
                window.append((row, start, ids[:room], total))
                if len(ids) > room:
                    spare.append((row, start + room, ids[room:], total))
                room -= min(room, len(ids))
            yield window
        while spare:
            window, room = [], self.size
            while room and spare:
                row, start, ids, total = spare.pop()
                window.append((row, start, ids[:room], total))
                if len(ids) > room:
                    spare.append((row, start + room, ids[room:], total))
                room -= min(room, len(ids))
            yield window


PIECES = "part int, doc bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, window bigint, offset bigint"


def _packed(path: str, end_id: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        packer = SumOfSquares(size)
        docs: dict[int, int | None] = {}
        out: list[tuple] = []
        windows = row = 0

        def close(window: list[Piece]) -> None:
            nonlocal windows
            offset = 0
            for number, start, ids, total in window:
                crc = zlib.crc32(ids.astype("<u4").tobytes())
                out.append((part, docs[number], start, len(ids), crc, total, windows, offset))
                offset += len(ids)
            windows += 1

        def written() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [()] * 8
            kinds = [pa.int32()] + [pa.int64()] * 7
            out.clear()
            names = [f.split()[0] for f in PIECES.split(", ")]
            return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

        for batch in batches:
            for some in pieces(batch, "text", 4 << 20):
                ids, marks = encoder(path).encode(some.column(1))
                names = some.column(0).to_pylist()
                for i, name in enumerate(names):
                    own = np.append(ids[marks[i] : marks[i + 1]], np.uint32(end_id))
                    docs[row] = name
                    whole = len(own) // size * size
                    for at in range(0, whole, size):
                        close([(row, at, own[at : at + size], len(own))])
                    if whole < len(own):
                        full = packer.place((row, whole, own[whole:], len(own)))
                        if full:
                            close(full)
                    row += 1
                waiting = {p[0] for stack in packer.open.values() for w in stack for p in w}
                docs = {k: v for k, v in docs.items() if k in waiting}
                yield written()
            give_back()
        for window in packer.drain():
            close(window)
        yield written()

    return run


def packed(
    docs: DataFrame,
    tokenizer: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int = END_ID,
    size: int = WINDOW,
) -> DataFrame:
    """One row per piece: doc, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc"), F.col(text_col).alias("text"))
    rows = staged(texts.mapInArrow(_packed(tokenizer, end_id, size), PIECES), "pieces")
    # one row per task that read documents
    tasks = rows.groupBy("part").agg((F.max("window") + 1).alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    tasks = staged(tasks.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")), "tasks")
    return rows.join(tasks, "part").select(
        "doc",
        "start",
        "length",
        "ids_crc32",
        "doc_tokens",
        (F.col("base") + F.col("window")).alias("sequence_id"),
        "offset",
    )
