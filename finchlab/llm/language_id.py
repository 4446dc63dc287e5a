"""Language identification: multinomial naive Bayes over hashed character n-grams.

Texts become lower-case letters, anything else a space; each n-gram of neighbouring
characters falls into one of `FEATURES` counters by a hash. Fitting sums the counters
per language over all training rows, in each task first. The log-probability matrix
has one row per counter and one column per language and is broadcast: its size is the
number of languages times `FEATURES` times four bytes, whatever the input. More than
`MAX_LANGUAGES` languages are an error before any text is read, for then the column holds
something else. Scoring visits only the n-grams that occur, for a whole batch at a time.

Defined results: a text that is null or has no letter is `und` with score 0; a row
without a language trains nothing; without any training row all texts are `und`; ties
go to the language that sorts first; repeated rows are counted and scored one by one.
Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from finchlab.llm.letters import code_points, letters, lower_letters
from finchlab.llm.words import pieces

UNDETERMINED = "und"
FEATURES = 1 << 15
ORDERS = (2, 3)
SMOOTHING = 0.5
# 64 MB of log-probabilities
MAX_LANGUAGES = 512

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def features(points: np.ndarray, order: int) -> np.ndarray:
    """The counter of the n-gram that starts at each code point."""
    h = points.astype(np.uint64)
    out = h.copy()
    for k in range(1, order):
        out *= np.uint64(0x100000001B3)
        out[:-k] += h[k:]
    return ((out + np.uint64(order)) * _MULTIPLIER >> np.uint64(64 - 15)).astype(np.int32)


def across(marks: np.ndarray, order: int) -> np.ndarray:
    """Where n-grams begin that reach past the space behind their text, into the next one."""
    ends = [marks[1:][marks[1:] - 1 - j >= marks[:-1]] - 1 - j for j in range(order - 2)]
    return np.concatenate(ends) if ends else np.zeros(0, np.int64)


COUNTS = "lang string, feature int, n bigint"


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task and language, the counters of its texts; counter -1 counts the texts."""
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        for part in pieces(batch, "text", 1 << 20):
            points, marks = code_points(part.column(1).to_pylist())
            points = lower_letters()[points]
            names, which = np.unique(np.array(part.column(0).to_pylist(), dtype=object), return_inverse=True)
            owner = np.repeat(which, np.diff(marks))
            for name in names:
                sums.setdefault(name, np.zeros(FEATURES + 1, dtype=np.int64))
            for order in ORDERS:
                key = owner.astype(np.int64) * FEATURES + features(points, order)[: len(owner)]
                key = np.delete(key, across(marks, order))
                table = np.bincount(key, minlength=len(names) * FEATURES).reshape(len(names), FEATURES)
                for name, row in zip(names, table, strict=True):
                    sums[name][:-1] += row
            for k, name in enumerate(names):
                sums[name][-1] += int((which == k).sum())
    for name, row in sums.items():
        some = np.flatnonzero(row)
        counter = np.where(some == FEATURES, -1, some).astype(np.int32)
        yield pa.record_batch(
            [pa.array([name] * len(some), pa.string()), pa.array(counter), pa.array(row[some])],
            names=["lang", "feature", "n"],
        )


class Model:
    """Log-probabilities (FEATURES, languages) and log priors."""

    def __init__(self, languages: list[str], weights: np.ndarray, priors: np.ndarray):
        self.languages, self.weights, self.priors = languages, weights, priors


def fit(rows: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model:
    """Sums over all rows that have a language; the driver gets one row per language and counter."""
    known = rows.filter(F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    if known.select("lang").distinct().limit(MAX_LANGUAGES + 1).count() > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages: {lang_col} is not a language column")
    sums = known.mapInArrow(_counted, COUNTS).groupBy("lang", "feature").agg(F.sum("n").alias("n")).toArrow()
    names = np.array(sums["lang"].to_pylist(), dtype=object)
    languages = sorted(set(names.tolist()))
    counts = np.zeros((len(languages), FEATURES + 1))
    where = np.array([languages.index(x) for x in names], dtype=np.int64)
    counts[where, sums["feature"].to_numpy()] = sums["n"].to_numpy()  # -1 is the last
    priors, counts = counts[:, -1], counts[:, :-1] + SMOOTHING
    weights = np.log(counts / counts.sum(axis=1, keepdims=True))
    return Model(languages, np.ascontiguousarray(weights.T, dtype=np.float32), np.log(priors / max(priors.sum(), 1)))


PREDICTED = "doc bigint, lang_pred string, score double"


def _predicted(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        for batch in batches:
            for part in pieces(batch, "text", 1 << 20):
                n = part.num_rows
                points, marks = code_points(part.column(1).to_pylist())
                some = np.add.reduceat(letters()[points], marks[:-1], dtype=np.int64) > 0
                if not model.languages:
                    some[:] = False
                points = lower_letters()[points]
                total = np.tile(model.priors, (n, 1))
                for order in ORDERS if model.languages else ():
                    at = features(points, order)[: marks[-1]]
                    beyond = across(marks, order)
                    for k in range(len(model.languages)):
                        weight = model.weights[at, k]
                        weight[beyond] = 0.0
                        total[:, k] += np.add.reduceat(weight, marks[:-1], dtype=np.float64)
                names, scores = [UNDETERMINED] * n, np.zeros(n)
                if model.languages:
                    best = total.argmax(axis=1)
                    share = np.exp(total - total.max(axis=1, keepdims=True))
                    scores = np.where(some, 1 / share.sum(axis=1), 0.0)
                    names = [model.languages[b] if s else UNDETERMINED for b, s in zip(best, some, strict=True)]
                yield pa.record_batch(
                    [part.column(0), pa.array(names), pa.array(scores)], names=["doc", "lang_pred", "score"]
                )

    return run


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc, lang_pred, score (posterior probability)."""
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc"), F.col(text_col).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return texts.mapInArrow(_predicted(shared), PREDICTED)


def held_out(doc_id: Column, modulus: int = 3, value: int = 1) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("null")).cast("binary")) % modulus == value
