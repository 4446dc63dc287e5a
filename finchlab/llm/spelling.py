"""Spelling variants: words one edit apart, found over a reduced alphabet.

1. Words of all texts are counted, first per piece of text in a task, then by Spark.
2. Letters are hashed to a few symbols. Two words one edit apart have reduced words that
   are equal or one edit apart, so the neighbourhood of every distinct reduced word is
   generated and joined to the reduced vocabulary: the word itself, every deletion and
   every replacement by a higher symbol. What a neighbourhood holds besides is found from
   the other end, since an insertion is a deletion of the longer word and a replacement
   by a lower symbol is one by a higher symbol there; every pair is met once and read both
   ways. Reduced words travel as 64-bit hashes, so a very long word costs no more a letter.
3. Pairs are verified on the words themselves, and per word the near ones are counted and
   the most frequent one is kept. Chains of forms are followed by pointer jumping.

Defined results: null and empty texts have no words; the place where a run loses a letter
depends on the id and the run, a null id counting as an empty one; rows that repeat an id
count one by one; of near words with the same count the first in code-point order is the
form; a form has at least `ratio` times the count of its word, so chains end. An empty
table gives no word. Extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from finchlab.llm.common import staged
from finchlab.llm.words import _LOWER, column_bytes, mix, stream

SHORTEST = 7
LEAST = 2
RATIO = 10
SYMBOLS = 8
EVERY = 31

RUN = re.compile("[a-zA-ZÀ-ÿ]+")
_OTHER = re.compile("[^a-zA-ZÀ-ÿ]")
_CHARS = 1 << 20
_ENTRIES = 1 << 17
_PLACES = 1 << 16


def runs(text: str) -> Iterator[list[str]]:
    """Letter runs of a text, in lists from pieces of about a million characters."""
    at = 0
    while at < len(text):
        cut = _OTHER.search(text, at + _CHARS) if at + _CHARS < len(text) else None
        end = cut.start() if cut else len(text)
        yield RUN.findall(text, at, end)
        at = end


def damaged(run: str, start: int, every: int = EVERY) -> str:
    """The run without the letter its checksum names, or as it is; `start` is the checksum of what stands before."""
    h = zlib.crc32(run.encode(), start)
    if h % every:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def _counts(shortest: int, every: int):
    def emitted(found: Counter) -> pa.RecordBatch:
        return pa.record_batch([pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.int64())], names=["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for batch in batches:
            data, marks = column_bytes(batch.column(1))
            data = _LOWER[data]
            for i, doc in enumerate(batch.column(0).to_pylist()):
                if marks[i] == marks[i + 1]:
                    continue
                start = zlib.crc32(f"{'' if doc is None else doc}:".encode())
                for some in runs(data[marks[i] : marks[i + 1]].tobytes().decode()):
                    for word, n in Counter(some).items():
                        word = damaged(word, start, every)
                        if len(word) >= shortest:
                            found[word] += n
                if len(found) >= _ENTRIES:
                    yield emitted(found)
                    found = Counter()
        yield emitted(found)

    return run


def vocabulary(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    shortest: int = SHORTEST, least: int = LEAST, every: int = EVERY,
) -> DataFrame:
    """(word, n) of all words of at least `shortest` letters with at least `least` occurrences."""
    texts = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    counts = texts.mapInArrow(_counts(shortest, every), "word string, n bigint")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


_PLACE = int(stream(1, 31)[0] | np.uint64(1))
_SYMBOL = stream(256, 32)
_LETTER = stream(256, 33)


class Reduced:
    """Reduced words of a column: symbols, and hashes of the words and their changes.

    The hash of symbols s is the sum of code(s[i]) * base ** i, so prefix sums give the hash
    of any deletion or replacement. Letters are all below 256, one byte each.
    """

    def __init__(self, words: list[str], symbols: int):
        self.symbols = symbols
        raw = np.frombuffer("".join(words).encode("latin-1"), dtype=np.uint8)
        self.sizes = np.fromiter(map(len, words), np.int64, len(words))
        self.first = np.concatenate(([0], np.cumsum(self.sizes)))
        self.symbol = (_LETTER % np.uint64(symbols)).astype(np.int64)[raw]
        longest = int(self.sizes.max(initial=0))
        power = np.full(longest + 1, _PLACE, dtype=np.uint64)
        power[0] = 1
        self.power = np.multiply.accumulate(power)
        self.own = np.repeat(np.arange(len(words)), self.sizes)
        self.at = np.arange(len(raw)) - self.first[self.own]
        terms = _SYMBOL[self.symbol] * self.power[self.at]
        self.sums = np.concatenate(([np.uint64(0)], np.cumsum(terms, dtype=np.uint64)))
        self.total = self.sums[self.first[1:]] - self.sums[self.first[:-1]]

    @staticmethod
    def named(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        return mix(hashes ^ mix(sizes.astype(np.uint64) + _SYMBOL[255])).view(np.int64)

    @property
    def keys(self) -> np.ndarray:
        return self.named(self.total, self.sizes)

    def changes(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(word, key) of every deletion and of every replacement by a higher symbol, without repeats."""
        back = np.uint64(pow(_PLACE, -1, 2**64))
        for low in range(0, len(self.symbol), _PLACES):
            i = np.arange(low, min(low + _PLACES, len(self.symbol)))
            own, at = self.own[i], self.at[i]
            # of a run of one symbol, only the last is deleted
            last = (at + 1 == self.sizes[own]) | (self.symbol[i] != self.symbol[np.minimum(i + 1, len(self.symbol) - 1)])
            d, w = i[last], own[last]
            left = self.sums[d] - self.sums[self.first[w]]
            right = (self.sums[self.first[w + 1]] - self.sums[d + 1]) * back
            yield w, self.named(left + right, self.sizes[w] - 1)
            for c in range(1, self.symbols):
                lower = self.symbol[i] < c
                s, w = i[lower], own[lower]
                if len(s):
                    moved = self.total[w] + (_SYMBOL[c] - _SYMBOL[self.symbol[s]]) * self.power[self.at[s]]
                    yield w, self.named(moved, self.sizes[w])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with about `_CHARS` letters at once; a longer word stands alone."""
    for batch in batches:
        marks = column_bytes(batch.column(0))[1]
        at = 0
        while at < batch.num_rows:
            end = int(np.searchsorted(marks, marks[at] + _CHARS, side="right")) - 1
            end = min(max(end, at + 1), batch.num_rows)
            yield batch.slice(at, end - at)
            at = end


def _keyed(symbols: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _blocks(batches):
            keys = Reduced(part.column(0).to_pylist(), symbols).keys
            yield pa.record_batch([part.column(0), part.column(1), pa.array(keys)], names=["word", "n", "key"])

    return run


def _neighbourhoods(symbols: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _blocks(batches):
            reduced = Reduced(part.column(0).to_pylist(), symbols)
            keys = reduced.keys
            yield pa.record_batch([pa.array(keys), pa.array(keys)], names=["key", "probe"])
            for which, probe in reduced.changes():
                yield pa.record_batch([pa.array(keys[which]), pa.array(probe)], names=["key", "probe"])

    return run


def near_pairs(words: DataFrame, symbols: int = SYMBOLS) -> DataFrame:
    """(a, n_a, b, n_b) of all pairs of words one edit apart, each once; `words` has (word, n), each word once."""
    keyed = staged(words.mapInArrow(_keyed(symbols), "word string, n bigint, key bigint"), "reduced-words")
    one = keyed.groupBy("key").agg(F.min("word").alias("word")).select("word")  # a word of each reduced word
    probes = one.mapInArrow(_neighbourhoods(symbols), "key bigint, probe bigint")
    other = keyed.select(F.col("word").alias("b"), F.col("n").alias("n_b"), F.col("key").alias("probe"))
    hits = staged(probes.join(other, "probe"), "reduced-neighbours")
    pairs = hits.join(keyed.withColumnsRenamed({"word": "a", "n": "n_a"}), "key")
    # words with the same reduced word meet in both orders
    once = (F.col("probe") != F.col("key")) | (F.col("a") < F.col("b"))
    return pairs.filter(once & (F.levenshtein("a", "b", 1) == 1)).select("a", "n_a", "b", "n_b")


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of all words with a form; `forms` has (word, root), the root being the form."""
    forms = staged(forms, "forms")
    while True:
        further = forms.select(F.col("word").alias("root"), F.col("root").alias("to"))
        if forms.join(further, "root", "left_semi").isEmpty():
            return forms
        step = forms.join(further, "root", "left").select("word", F.coalesce("to", "root").alias("root"))
        forms = staged(step, "forms")


def variants(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    shortest: int = SHORTEST, least: int = LEAST, every: int = EVERY, ratio: int = RATIO, symbols: int = SYMBOLS,
) -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n."""
    words = staged(vocabulary(docs, id_col, text_col, shortest, least, every), "vocabulary")
    pairs = near_pairs(words, symbols)
    both = pairs.select(F.inline(F.array(
        F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("n_b").alias("near_n")),
        F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("n_a").alias("near_n")),
    )))
    best = both.groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best")
    )
    largest = -F.col("best.less")
    far = largest >= ratio * F.col("n")
    table = words.join(best, "word", "left").select(
        "word",
        F.when(far, F.col("best.near")).alias("form"),
        "n",
        F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
        F.when(far, largest).alias("form_n"),
    )
    table = staged(table, "word-forms")
    roots = _roots(table.filter("form is not null").select("word", F.col("form").alias("root")))
    return table.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
