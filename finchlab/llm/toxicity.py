"""Toxicity by a weighted lexicon, matched with Aho-Corasick on folded text.

Folding makes letters lower-case and plain: accents go, look-alike letters of other
scripts and digits written for letters become the Latin letter, anything else is a
space. A lexicon entry is the beginning of a word, or a whole word where that is short; it
matches at word starts only. Exception phrases are matched too, and entries inside one do
not count.

Entries and weights are learned from labelled rows. Up to `sample_rows` rows of each
label, those with the smallest id hashes, are joined to their texts; in each distinct
text, the distinct beginnings of its words are counted; a beginning whose texts are labelled
toxic much more often than by chance becomes an entry with the logarithm of the odds as
weight, unless a shorter beginning already says as much; of these, entries are kept, most
texts first, that explain toxic texts no kept one does. Exceptions are given, and learned:
two neighbouring words, one of which an entry matches, that are in several clean texts and
in hardly any toxic one. The sample fits a logistic
curve over the summed weight, by itself and per square root of the words, so a score
is a probability normalised by length. The lexicon holds no more words than the bounded
sample, and nothing else but a few numbers is sent to tasks.

Defined results: a text that is null, empty or without a match has the score of no
match; with no toxic row to learn from, or none that has a text, no text is toxic (all
scores are next to 0); rows with a null label teach nothing; repeated rows are scored one by
one; texts that repeat in the sample teach the lexicon once and the curve each time. Extra
columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from finchlab.llm.common import staged
from finchlab.llm.letters import code_points, folded_letters
from finchlab.llm.words import pieces

# Harmless phrases that hold words of toxic lexicons.
EXCEPTIONS = ("clown fish", "trash can", "trash bin", "moron test", "sore loser")


@dataclass(frozen=True)
class Settings:
    # bound of the labelled sample, per label
    sample_rows: int = 10_000
    # letters of a word's beginning; shorter words, from `whole` letters on, are entries as a whole
    whole: int = 2
    shortest: int = 4
    longest: int = 10
    # documents an entry needs, the share of them that are toxic, and its odds over chance
    min_documents: int = 5
    min_share: float = 0.95
    # an entry is kept if it is in this share of the toxic sample,
    # or explains so many toxic documents that no other entry does
    common_share: float = 0.05
    min_explained: int = 2
    # clean texts an exception needs, and the largest share of toxic ones
    min_exception: int = 5
    max_exception_share: float = 0.05
    seed: str = "toxicity"


SETTINGS = Settings()


@dataclass
class Lexicon:
    weights: dict[str, float] = field(default_factory=dict)
    exceptions: Sequence[str] = EXCEPTIONS
    # intercept, summed weight, weight per root of words
    curve: tuple[float, float, float] = (-20.0, 0.0, 0.0)


def folded(texts: list[str | None]) -> tuple[str, np.ndarray]:
    """All texts folded into one string, each behind a space, and their offsets in it."""
    points, marks = code_points(texts)
    return folded_letters()[points].astype("<u4").tobytes().decode("utf-32-le", "replace"), marks


def fold(text: str) -> str:
    return " ".join(folded([text])[0].split())


class Matcher:
    """Summed weights of a batch of texts."""

    def __init__(self, lexicon: Lexicon):
        self.automaton = ahocorasick.Automaton()
        for entry, weight in lexicon.weights.items():
            self.automaton.add_word(" " + entry, (len(entry) + 1, weight))
        for phrase in lexicon.exceptions:
            plain = " " + fold(phrase) + " "
            self.automaton.add_word(plain, (len(plain), None))
        self.some = bool(lexicon.weights)
        if self.some:
            self.automaton.make_automaton()

    def measured(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Summed weight and number of folded words of each text."""
        joined, marks = folded(texts)
        total = np.zeros(len(texts))
        data = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        starts = np.zeros(len(data) + 1, dtype=np.int64)
        starts[1:-1] = np.cumsum((data[:-1] == 32) & (data[1:] != 32))
        starts[-1] = starts[-2]
        words = starts[marks[1:]] - starts[marks[:-1]]
        if not self.some:
            return total, words
        at, weight, spans = [], [], []
        for end, (size, value) in self.automaton.iter(joined):
            if value is None:
                spans.append((end - size + 1, end))
            else:
                at.append(end - size + 1)
                weight.append(value)
        if at:
            at, weight = np.array(at), np.array(weight)
            for first, last in spans:
                weight[(at >= first) & (at < last)] = 0.0
            np.add.at(total, np.searchsorted(marks, at, side="right") - 1, weight)
        return total, words


def _inputs(total: np.ndarray, words: np.ndarray) -> np.ndarray:
    return np.stack((np.ones(len(total)), np.log1p(total), total / np.sqrt(np.maximum(words, 1))), axis=1)


COUNTED = "entry string, toxic bigint, clean bigint"


# entries counted in a task before they are sent on
_HELD = 1 << 18


def _counted(found):
    """Entries and in how many toxic and clean texts they are; `found` gives the distinct entries of each text."""

    def sent(counts: tuple[Counter, Counter]) -> pa.RecordBatch:
        entries = list(counts[0].keys() | counts[1].keys())
        batch = pa.record_batch(
            [
                pa.array(entries, pa.string()),
                pa.array([counts[1][e] for e in entries], pa.int64()),
                pa.array([counts[0][e] for e in entries], pa.int64()),
            ],
            names=["entry", "toxic", "clean"],
        )
        for c in counts:
            c.clear()
        return batch

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: tuple[Counter, Counter] = (Counter(), Counter())
        for batch in batches:
            for part in pieces(batch, "text", 1 << 20):
                joined, marks = folded(part.column(0).to_pylist())
                for i, label in enumerate(part.column(1).to_pylist()):
                    counts[label].update(found(joined[marks[i] : marks[i + 1]].split()))
                    if len(counts[0]) + len(counts[1]) > _HELD:
                        yield sent(counts)
        yield sent(counts)

    return run


def _beginnings(settings: Settings):
    sizes = range(settings.shortest, settings.longest + 1)
    short = range(settings.whole, settings.shortest)

    def found(words: list[str]) -> set[str]:
        words = set(words)
        return {w[:k] for w in words for k in sizes if len(w) >= k} | {w + " " for w in words if len(w) in short}

    return _counted(found)


HITS = "hits array<int>"


def _hits(entries: list[str]):
    """Which entries each text holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = ahocorasick.Automaton()
        for k, entry in enumerate(entries):
            automaton.add_word(" " + entry, k)
        automaton.make_automaton()
        for batch in batches:
            for part in pieces(batch, "text", 1 << 20):
                joined, marks = folded(part.column(0).to_pylist())
                # a text ends with the space before the next one
                found = [
                    sorted({k for _, k in automaton.iter(joined, s, e + 1)}) for s, e in zip(marks[:-1], marks[1:], strict=True)
                ]
                yield pa.record_batch([pa.array(found, pa.list_(pa.int32()))], names=["hits"])

    return run


def _explaining(texts: DataFrame, weights: dict[str, float], share: float, least: int) -> dict[str, float]:
    """Entries in a share of the toxic texts, and those that explain texts no other explains, most texts first.

    A word that only comes along with toxic ones, as in copies of one toxic text, explains nothing.
    """
    entries = list(weights)
    if not entries:
        return {}
    toxic = texts.filter("label = 1").select("text").mapInArrow(_hits(entries), HITS).toArrow()
    holders: dict[int, set[int]] = {}
    for i, hits in enumerate(toxic["hits"].to_pylist()):
        for k in hits:
            holders.setdefault(k, set()).add(i)
    common = [k for k, h in holders.items() if len(h) >= share * len(toxic)]
    kept = {entries[k]: weights[entries[k]] for k in common}
    covered = set().union(*(holders[k] for k in common))
    holders = {k: h - covered for k, h in holders.items() if k not in common}
    while holders:
        best = max(holders, key=lambda k: (len(holders[k]), weights[entries[k]], entries[k]))
        covered = holders.pop(best)
        if len(covered) < least:
            break
        kept[entries[best]] = weights[entries[best]]
        holders = {k: rest for k, h in holders.items() if len(rest := h - covered) >= least}
    return kept


def _pairs(weights: dict[str, float]):
    """Two neighbouring words of which an entry matches one, and in how many texts they are."""
    sizes = sorted({len(e) for e in weights})

    def matched(word: str) -> bool:
        return any(word[:k] in weights for k in sizes) or word + " " in weights

    def found(words: list[str]) -> set[str]:
        hit = [matched(w) for w in words]
        return {f"{a} {b}" for a, b, x, y in zip(words, words[1:], hit, hit[1:], strict=False) if x or y}

    return _counted(found)


MEASURED = "total double, words bigint, label int"


def _measured(lexicon: Lexicon):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(lexicon)
        for batch in batches:
            for part in pieces(batch, "text", 1 << 20):
                total, words = matcher.measured(part.column(0).to_pylist())
                yield pa.record_batch(
                    [pa.array(total), pa.array(words), part.column(1)], names=["total", "words", "label"]
                )

    return run


def _curve(total: np.ndarray, words: np.ndarray, label: np.ndarray) -> tuple[float, float, float]:
    """Logistic regression by Newton steps, with a small penalty that keeps it finite."""
    x, w = _inputs(total, words), np.zeros(3)
    penalty = np.diag([1e-3, 1e-2, 1e-2])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (label - p) - penalty @ w
        bend = (x * (p * (1 - p))[:, None]).T @ x + penalty
        step = np.linalg.solve(bend, slope)
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return tuple(w.tolist())


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    settings: Settings = SETTINGS,
    exceptions: Sequence[str] = EXCEPTIONS,
) -> Lexicon:
    """Learn the lexicon and its curve from the rows of `labels`."""
    key = F.md5(F.concat(F.col(id_col).cast("string"), F.lit("|" + settings.seed)))
    known = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
    known = known.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("label"), key.alias("_key"))
    shares = {row["label"]: row["n"] for row in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n = sum(shares.values())
    if not shares.get(1):
        return Lexicon({}, exceptions, (-20.0, 0.0, 0.0))
    chosen = [known.filter(F.col("label") == k).orderBy("_key").limit(settings.sample_rows) for k in (0, 1)]
    # at most two times sample_rows ids
    chosen = F.broadcast(staged(chosen[0].unionByName(chosen[1]).select("_id", "label"), "labelled"))
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).join(chosen, "_id")
    texts = staged(texts.select("text", "label").repartition(16), "labelled-texts")
    once = staged(texts.dropDuplicates(["label", "text"]).repartition(16), "labelled-texts-once")
    sampled = {row["label"]: row["n"] for row in once.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if not sampled.get(1):
        return Lexicon({}, exceptions, (-20.0, 0.0, 0.0))
    counted = once.mapInArrow(_beginnings(settings), COUNTED).groupBy("entry")
    counted = counted.agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c"))
    # classes are sampled apart: weigh them as the labels have them
    sampled = {k: sampled.get(k, 0) for k in (0, 1)}
    t = F.col("t") * F.lit(shares[1] / max(sampled[1], 1))
    c = F.col("c") * F.lit(shares.get(0, 0) / max(sampled[0], 1))
    odds = F.log((t + 0.5) / (shares[1] + 1) / ((c + 0.5) / (shares.get(0, 0) + 1)))
    good = counted.filter((F.col("t") >= settings.min_documents) & (t >= settings.min_share * (t + c)))
    good = staged(good.select("entry", odds.alias("weight"), F.col("t").alias("n"), "c").filter("weight > 1"), "beginnings")
    # a beginning in the same texts as a shorter one says nothing more
    cut = F.sequence(F.lit(1), F.length("entry") - 1)
    shorter = good.filter(F.length("entry") > 1).select(
        "entry", "n", "c", F.explode(F.transform(cut, lambda k: F.substring(F.col("entry"), F.lit(1), k))).alias("short")
    )
    same = good.select(F.col("entry").alias("short"), "n", "c")
    said = shorter.join(same, ["short", "n", "c"]).select("entry").distinct()
    rows = good.join(said, "entry", "left_anti").select("entry", "weight").collect()
    weights: dict[str, float] = {}
    for row in sorted(rows, key=lambda r: (len(r["entry"]), r["entry"])):
        entry = row["entry"]
        shorter = [weights[entry[:k]] for k in range(1, len(entry)) if entry[:k] in weights]
        if not shorter or max(shorter) < row["weight"] - 0.7:
            weights[entry] = row["weight"]
    weights = _explaining(once, weights, settings.common_share, settings.min_explained)
    phrases: list[str] = []
    if weights:
        near = once.mapInArrow(_pairs(weights), COUNTED).groupBy("entry")
        near = near.agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c"))
        rare = t <= settings.max_exception_share * (t + c)
        phrases = [r["entry"] for r in near.filter((F.col("c") >= settings.min_exception) & rare).collect()]
    lexicon = Lexicon(weights, [*exceptions, *sorted(phrases)])
    seen = texts.mapInArrow(_measured(lexicon), MEASURED).toArrow()
    arrays = [seen[c].to_numpy().astype(float) for c in ("total", "words", "label")]
    curve = list(_curve(*arrays))
    taken = {k: max(1, int((arrays[2] == k).sum())) for k in (0, 1)}
    curve[0] += math.log(shares[1] / taken[1]) - math.log(max(shares.get(0, 0), 1) / taken[0])
    lexicon.curve = tuple(curve) if n else lexicon.curve
    return lexicon


SCORED = "doc bigint, score double, weight double, words bigint"


def _scored(lexicon: Lexicon):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(lexicon)
        for batch in batches:
            for part in pieces(batch, "text", 1 << 20):
                total, words = matcher.measured(part.column(1).to_pylist())
                z = _inputs(total, words) @ np.array(lexicon.curve)
                score = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
                yield pa.record_batch(
                    [part.column(0), pa.array(score), pa.array(total), pa.array(words)],
                    names=["doc", "score", "weight", "words"],
                )

    return run


def scored(docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc, score, summed weight and words."""
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc"), F.col(text_col).alias("text"))
    return texts.mapInArrow(_scored(lexicon), SCORED)


def held_out(doc_id: Column, modulus: int = 5, value: int = 0) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("null")).cast("binary")) % modulus == value
