"""Token ids in files, compressed by Re-Pair grammars per shard.

Documents are ordered by id over range partitions, encoded, and cut into shards of
about `shard_tokens` ids. In a shard, frequent pairs of neighbouring ids are replaced
by new symbols, round after round, until no pair occurs LEAST times. A round takes the
most frequent pairs of which no symbol is both a left and a right side, so none of their
occurrences overlap and all are replaced at once; a pair of one symbol with itself is
counted and replaced two by two from the start of a run. Pairs never cross documents. A shard stores its rules (two
symbols each, older ones first), the expansion length of every rule, the reduced
sequence, and where each document begins in it; so one document is decoded, whole or
from any id on, without the others.

Files are Parquet, one row per shard, in the folder the caller names, or in the
shared checkpoint folder. A task writes its own shards; nothing is gathered.

Defined results: null text counts as empty and has the end id alone; rows with equal
ids follow one another in no set order; null ids come first; an empty table gives
an empty folder with a schema. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from finchlab.llm.common import new_folder
from finchlab.llm.tokens import encoder
from finchlab.llm.words import pieces

END_ID = 0
SHARD_TOKENS = 1 << 20
PAIRS = 1024
# text that is encoded at once; pieces of text repeat in it
ENCODED_BYTES = 16 << 20
# parts per generation: more than such a text has, about 80 MB
REMEMBERED = 400_000
LEAST = 12


def chosen_pairs(keys: np.ndarray, counts: np.ndarray, most: int) -> list[int]:
    """Places of up to `most` frequent pairs, no symbol on both sides of two pairs, most frequent first."""
    if len(keys) > 2 * most:
        top = np.argpartition(-counts, 2 * most)[: 2 * most]
    else:
        top = np.arange(len(keys))
    top = top[np.lexsort((keys[top], -counts[top]))]
    is_left, is_right, chosen = set(), set(), []
    for at, k in zip(top.tolist(), keys[top].tolist(), strict=True):
        a, b = k >> 32, k & 0xFFFFFFFF
        if a in is_right or b in is_left or (a == b and a in is_left):
            continue
        is_left.add(a)
        is_right.add(b)
        chosen.append(at)
        if len(chosen) == most:
            break
    return chosen


def pair_keys(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return (left.astype(np.uint64) << np.uint64(32)) | right


def in_order(places: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places by their pairs, and where another pair begins. Pair and place are sorted as one number if they fit."""
    wide = int(max(left.max(), right.max())).bit_length()
    far = int(places[-1]).bit_length()
    if 2 * wide + far <= 64:
        key = left.astype(np.uint64)
        key <<= np.uint64(wide)
        key |= right
        key <<= np.uint64(far)
        key |= places.view(np.uint64)
        key.sort()
        places = (key & np.uint64((1 << far) - 1)).view(np.int64)
        key >>= np.uint64(far)
    else:
        key = pair_keys(left, right)
        order = np.argsort(key, kind="stable")
        places, key = places[order], key[order]
    new = np.ones(len(key), dtype=bool)
    np.not_equal(key[1:], key[:-1], out=new[1:])
    return places, new


class Pairs:
    """Occurrences of the pairs of two different symbols, kept up to date from round to round.

    `at` names the pair that begins at each place; 0 stands for the end of a document, for
    a symbol followed by itself, and for all pairs that occur less than `least` times: a
    replacement brings no old symbols together, so a pair of old symbols never gets more
    frequent, and these are not looked at again.
    """

    def __init__(self, seq: np.ndarray, inner: np.ndarray, least: int):
        self.least = least
        self.at = np.zeros(len(seq), dtype=np.int32)
        self.keys, self.counts = np.zeros(1, dtype=np.uint64), np.zeros(1, dtype=np.int64)
        self.count(seq, inner, np.ones(len(seq), dtype=bool))

    def count(self, seq: np.ndarray, inner: np.ndarray, marked: np.ndarray) -> None:
        """Name the pairs at the marked places, all of them pairs not counted before."""
        places = np.flatnonzero(marked[:-1] & inner[:-1] & (seq[:-1] != seq[1:]))
        if not len(places):
            return
        places, new = in_order(places, seq[places], seq[places + 1])
        start = np.flatnonzero(new)
        counts = np.diff(start, append=len(places))
        frequent = counts >= self.least
        name = np.zeros(len(start), dtype=np.int32)
        name[frequent] = len(self.keys) + np.arange(np.count_nonzero(frequent))
        self.at[places] = np.repeat(name, counts)
        first = places[start[frequent]]
        self.keys = np.concatenate((self.keys, pair_keys(seq[first], seq[first + 1])))
        self.counts = np.concatenate((self.counts, counts[frequent]))

    def forget(self, places: np.ndarray) -> None:
        self.counts -= np.bincount(self.at[places], minlength=len(self.counts))
        self.counts[0] = 0
        self.at[places] = 0


def doubles(seq: np.ndarray, inner: np.ndarray) -> np.ndarray:
    """Where a symbol is followed by itself, two by two from the start of a run, so that no two of them overlap."""
    at = np.flatnonzero((seq[:-1] == seq[1:]) & inner[:-1])
    if not len(at):
        return at
    new = np.concatenate(([True], np.diff(at) != 1))
    return at[(at - at[new][np.cumsum(new) - 1]) % 2 == 0]


def compress(
    ids: np.ndarray, marks: np.ndarray, rounds: int | None = None, most: int = PAIRS, least: int = LEAST
):
    """Reduced sequence, document offsets in it, rules, expansion lengths, first rule symbol."""
    seq = ids.astype(np.uint32)
    base = int(seq.max()) + 1 if len(seq) else 1
    symbols = base
    inner = np.ones(len(seq), dtype=bool)
    inner[marks[1:][marks[1:] > 0] - 1] = False  # the last id of each document
    rules = [np.zeros((0, 2), dtype=np.uint32)]
    pairs = Pairs(seq, inner, least)
    while len(seq) > 1 and (rounds is None or len(rules) <= rounds):
        # a symbol followed by itself: few places, looked for anew as runs get shorter from either end
        twin = doubles(seq, inner)
        double, times = np.unique(seq[twin], return_counts=True)
        double, times = double[times >= least], times[times >= least]
        often = np.flatnonzero(pairs.counts >= least)
        keys = np.concatenate((pairs.keys[often], pair_keys(double, double)))
        chosen = chosen_pairs(keys, np.concatenate((pairs.counts[often], times)), most)
        if not chosen:
            break
        both = keys[chosen]
        of_pair = np.full(len(pairs.keys), -1, dtype=np.int32)
        of_double: dict[int, int] = {}
        for k, i in enumerate(chosen):
            if i < len(often):
                of_pair[often[i]] = k
            else:
                of_double[int(double[i - len(often)])] = k
        hit = of_pair[pairs.at]
        for symbol, k in of_double.items():
            hit[twin[seq[twin] == symbol]] = k
        at = np.flatnonzero(hit >= 0)
        new = symbols + hit[at].astype(np.uint32)
        gone = np.zeros(len(seq) + 1, dtype=bool)
        gone[at] = gone[at + 1] = gone[at - 1] = True  # place -1 is none
        pairs.forget(np.flatnonzero(gone[:-1]))
        seq[at] = new
        inner[at] = inner[at + 1]
        keep = np.ones(len(seq), dtype=bool)
        keep[at + 1] = False
        seq, inner, pairs.at = seq[keep], inner[keep], pairs.at[keep]
        # the new symbols lie as many places further on the left as there are before them
        at -= np.arange(len(at))
        beside = np.zeros(len(seq) + 1, dtype=bool)
        beside[at] = beside[at - 1] = True
        pairs.count(seq, inner, beside[:-1])
        rules.append(np.stack((both >> np.uint64(32), both & np.uint64(0xFFFFFFFF)), axis=1).astype(np.uint32))
        symbols += len(both)
    table = np.concatenate(rules)
    lengths: list[int] = []
    for a, b in table.tolist():
        lengths.append((lengths[a - base] if a >= base else 1) + (lengths[b - base] if b >= base else 1))
    ends = np.flatnonzero(~inner) + 1
    empty = np.diff(marks) == 0
    starts = np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(~empty)))]
    return seq, starts, table, np.array(lengths, dtype=np.int64), base


def expand(seq: np.ndarray, rules: np.ndarray, base: int) -> np.ndarray:
    """The ids of a reduced sequence."""
    seq = seq.copy()
    while len(seq) and len(rules):
        big = seq >= base
        if not big.any():
            break
        out = np.repeat(seq, 1 + big)
        first = np.cumsum(1 + big) - (1 + big)
        pair = rules[seq[big] - base]
        out[first[big]] = pair[:, 0]
        out[first[big] + 1] = pair[:, 1]
        seq = out
    return seq


def expand_shard(seq: np.ndarray, rules: np.ndarray, lengths: np.ndarray, base: int) -> np.ndarray:
    """The ids of the whole reduced sequence of a shard: every rule is expanded once, then looked up."""
    known = np.concatenate((np.arange(base, dtype=np.uint32), expand(rules.ravel(), rules, base)))
    size = np.concatenate((np.ones(base, dtype=np.int64), lengths))
    first = np.cumsum(size) - size
    size = size[seq]
    source = np.repeat(first[seq] - (np.cumsum(size) - size), size)
    source += np.arange(len(source))
    return known[source]


def sequence(shard: dict) -> np.ndarray:
    """The reduced sequence; two bytes a symbol where all fit."""
    return np.frombuffer(shard["symbols"], f"<u{shard['width']}").astype(np.uint32)


def decode_document(shard: dict, i: int, start: int = 0, stop: int | None = None) -> np.ndarray:
    """Ids [start, stop) of the i-th document of a shard; symbols outside the range are only measured."""
    starts = np.frombuffer(shard["starts"], np.uint32)
    rules = np.frombuffer(shard["rules"], np.uint32).reshape(-1, 2)
    lengths = np.frombuffer(shard["lengths"], np.uint32)
    seq = sequence(shard)[starts[i] : starts[i + 1]]
    base = shard["base"]
    big = seq >= base
    size = np.ones(len(seq), dtype=np.int64)
    size[big] = lengths[seq[big] - base]
    end = np.cumsum(size)
    stop = int(end[-1]) if stop is None and len(end) else (stop or 0)
    low = int(np.searchsorted(end, start, side="right"))
    high = int(np.searchsorted(end - size, stop, side="left"))
    skipped = int(end[low] - size[low]) if low < len(end) else 0
    return expand(seq[low:high], rules, base)[start - skipped : stop - skipped]


SHARDS = (
    "part int, shard int, docs array<bigint>, tokens bigint, base int, width int, "
    "starts binary, symbols binary, rules binary, lengths binary"
)


def _encoded(path: str, end_id: int, shard_tokens: int, rounds: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        shard, names, held, sizes, total = 0, [], [], [], 0

        def written() -> pa.RecordBatch:
            ids = np.concatenate(held) if held else np.zeros(0, np.uint32)
            marks = np.concatenate(([0], np.cumsum(np.concatenate(sizes) if sizes else [0])))
            seq, starts, rules, lengths, base = compress(ids, marks.astype(np.int64), rounds)
            docs = pa.concat_arrays(names)
            row = [
                pa.array([part], pa.int32()),
                pa.array([shard], pa.int32()),
                pa.ListArray.from_arrays(pa.array([0, len(docs)], pa.int32()), docs),
                pa.array([len(ids)], pa.int64()),
                pa.array([base], pa.int32()),
            ]
            width = 2 if base + len(rules) <= 1 << 16 else 4
            packed = (starts.astype("<u4"), seq.astype(f"<u{width}"), rules.astype("<u4"), lengths.astype("<u4"))
            row.append(pa.array([width], pa.int32()))
            row += [pa.array([x.tobytes()], pa.binary()) for x in packed]
            return pa.record_batch(row, names=[f.split()[0] for f in SHARDS.split(", ")])

        for batch in batches:
            # encoded many at a time, as a piece of text is looked up once for all of them
            for many in pieces(batch, "text", ENCODED_BYTES):
                coded, ends = encoder(path, REMEMBERED).encode(many.column(1))
                low = 0
                for some in pieces(many, "text"):
                    marks = ends[low : low + some.num_rows + 1]
                    low += some.num_rows
                    # the end id behind each document
                    size = np.diff(marks) + 1
                    both = np.full(marks[-1] - marks[0] + some.num_rows, end_id, dtype=np.uint32)
                    own = np.ones(len(both), dtype=bool)
                    own[np.cumsum(size) - 1] = False
                    both[own] = coded[marks[0] : marks[-1]]
                    names.append(some.column(0))
                    held.append(both)
                    sizes.append(size)
                    total += len(both)
                    if total >= shard_tokens:
                        yield written()
                        shard, names, held, sizes, total = shard + 1, [], [], [], 0
        if names:
            yield written()

    return run


def write_tokens(
    docs: DataFrame,
    tokenizer: str,
    folder: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int = END_ID,
    shard_tokens: int = SHARD_TOKENS,
    rounds: int | None = None,
) -> str:
    """Write all texts; returns the folder."""
    folder = folder or new_folder(docs.sparkSession, "token-shards")
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc"), F.col(text_col).alias("text"))
    ordered = texts.repartitionByRange("doc").sortWithinPartitions("doc")
    ordered.mapInArrow(_encoded(tokenizer, end_id, shard_tokens, rounds), SHARDS).write.parquet(folder)
    return folder


READ = "part int, shard int, doc bigint, at bigint, n_tokens bigint, ids_crc32 bigint"


def _decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            rules = np.frombuffer(row["rules"], np.uint32).reshape(-1, 2)
            seq = sequence(row)
            starts = np.frombuffer(row["starts"], np.uint32)
            lengths = np.frombuffer(row["lengths"], np.uint32)
            size = np.ones(len(seq), dtype=np.int64)
            big = seq >= row["base"]
            size[big] = lengths[seq[big] - row["base"]]
            marks = np.concatenate(([0], np.cumsum(size)))[starts]
            ids = memoryview(expand_shard(seq, rules, lengths, row["base"]).astype("<u4", copy=False))
            n = len(row["docs"])
            crc = [zlib.crc32(ids[s:e]) for s, e in zip(marks[:-1], marks[1:], strict=True)]
            yield pa.record_batch(
                [
                    pa.array([row["part"]] * n, pa.int32()),
                    pa.array([row["shard"]] * n, pa.int32()),
                    pa.array(row["docs"], pa.int64()),
                    pa.array(marks[:-1]),
                    pa.array(np.diff(marks)),
                    pa.array(crc, pa.int64()),
                ],
                names=[f.split()[0] for f in READ.split(", ")],
            )


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """One row per document of the files: doc, start among all ids, n_tokens, ids_crc32."""
    shards = spark.read.schema(SHARDS).parquet(folder)
    sizes = shards.select("part", "shard", "tokens")
    # totals of tasks first, then of shards within a task: no window holds all shards
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = sizes.groupBy("part").agg(F.sum("tokens").alias("n"))
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    within = sizes.select("part", "shard", F.coalesce(F.sum("tokens").over(inside), F.lit(0)).alias("first"))
    bases = within.join(parts, "part").select("part", "shard", (F.col("base") + F.col("first")).alias("base"))
    return (
        shards.mapInArrow(_decoded, READ)
        .join(bases, ["part", "shard"])
        .select("doc", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
    )
