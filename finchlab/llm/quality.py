"""Quality rules: basic text counts, and divergence from language references.

A text is described by two histograms: characters by class, and words of the common
word lists (everything else is one more bin). Its Jensen-Shannon distance (square
root of the divergence, base 2, 0 to 1) to the reference of each language is taken,
and the nearest language counts. References are summed over all rows of the corpus
that carry a language with a word list. Every text with the words that the base rule
asks for is judged by both distances; the limits are wider for short texts, which are
further away by chance. Shorter texts fail the base rule, and have distances of 0.

Everything is built-in column functions, so no row leaves the JVM and nothing is
shuffled but one row of sums per task and language.

Defined results: null and empty text has no words, zero counts, and fails the base
rule; a corpus without any listed language has no references, and then only the base
rule decides; ids may be null or repeat, each row is judged alone; extra columns are
kept. White space is space and \\x09-\\x0D.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

# Frequent words of each language.
COMMON_WORDS = {
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als",
    "en": "the of and to a in that is was for it with as on be at by this are from",
    "es": "de la que el en y a los se del las un por con no una su para es al",
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au",
}
VOCABULARY = sorted({w for line in COMMON_WORDS.values() for w in line.split()})


@dataclass(frozen=True)
class Rules:
    min_words: int = 50
    max_repeat_percent: int = 50
    # one key or address in a short text adds to the squared distance as 1 / characters; this is allowed
    # where the words are as near as chance lets them be, a squared distance of `chance` / words
    max_class_distance: float = 0.17
    class_slack: float = 15.0
    chance: float = 5.0
    # a text without any listed word is about 0.336 away at any length, so that the limit at 50 words has to stay below
    max_word_distance: float = 0.32
    word_slack: float = 0.5
    max_reference_markup_percent: float = 1.0


RULES = Rules()


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind a value once for a body that reads it many times."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def without(text: Column, pattern: str) -> Column:
    return F.regexp_replace(text, pattern, "")


def repeated_words(w: Column) -> Column:
    """Words inside three-word windows that the text holds twice or more."""

    def covered(at: Column) -> Column:
        gaps = F.transform(
            at, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(at, i + 1), p + 3) - p)
        )
        return F.aggregate(gaps, F.lit(0), lambda a, g: a + g)

    def positions(s: Column) -> Column:
        h = "h"
        twice = F.filter(s, lambda x, i: (x[h] == F.get(s, i - 1)[h]) | (x[h] == F.get(s, i + 1)[h]))
        return F.sort_array(F.transform(twice, lambda x: x["i"]))

    def of(hashes: Column) -> Column:
        pairs = F.transform(hashes, lambda x, i: F.struct(x.alias("h"), i.alias("i")))
        some = let(let(F.sort_array(pairs), positions), covered)
        return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), some).otherwise(0)

    windows = F.transform(
        F.slice(w, F.lit(1), F.greatest(F.size(w) - 2, F.lit(0))),
        lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)),
    )
    return let(windows, of).cast("bigint")


def repeated_lines(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint")


CLASSES = ("lower", "upper", "digit", "space", "mark", "markup", "symbol", "other")
SPACES = CLASSES.index("space")
MARKUP = CLASSES.index("markup")


def class_counts(text: Column) -> Column:
    """Characters per class: each step takes one class out of what is left."""
    steps = [r"[a-z]+", r"[A-Z]+", r"[0-9]+", SPACE, r"[.,;:!?'\"()\-]+", r"[#*$%&|<>]+", r"[\x00-\x7F]+"]

    def after(rest: Column, left: Sequence[str]) -> Column:
        if not left:
            return F.array(F.length(rest))
        return let(
            without(rest, left[0]),
            lambda r: F.concat(F.array(F.length(rest) - F.length(r)), after(r, left[1:])),
        )

    return after(text, steps)


def common_counts(w: Column) -> Column:
    """(word, count) of the vocabulary words that occur, in lower case as listed."""

    def runs(s: Column) -> Column:
        ends = F.filter(
            F.transform(s, lambda x, i: F.struct(x.alias("word"), i.alias("i"))),
            lambda r: ~r["word"].eqNullSafe(F.get(s, r["i"] + 1)),
        )
        return let(
            ends,
            lambda e: F.transform(
                e,
                lambda r, k: F.struct(
                    r["word"].alias("word"), (r["i"] - F.coalesce(F.get(e, k - 1)["i"], F.lit(-1))).alias("n")
                ),
            ),
        )

    return let(F.sort_array(F.filter(w, lambda x: x.isin(VOCABULARY))), runs)


def histograms(t: Column, w: Column) -> list[Column]:
    return [
        F.size(w).cast("bigint").alias("n_words"),
        class_counts(t).alias("classes"),
        common_counts(w).alias("common"),
    ]


def repeats(t: Column, w: Column) -> list[Column]:
    return [repeated_lines(t).alias("n_dup_lines"), repeated_words(w).alias("n_repeat_words")]


def _described(text_col: str, *parts: Callable[[Column, Column], list[Column]]) -> Column:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return let(text, lambda t: let(words(t), lambda w: F.struct(*[c for part in parts for c in part(t, w)])))


def total_of(counts: Column) -> Column:
    return F.aggregate(counts, F.lit(0), lambda a, c: a + c)


@dataclass(frozen=True)
class Reference:
    """Shares of a language: character classes, and vocabulary words (the rest is all other words)."""

    classes: Sequence[float]
    words: Sequence[float]


def references(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", rules: Rules = RULES
) -> dict[str, Reference]:
    """The reference of each language that has a word list, over all its texts.

    Texts with much markup would blur what is normal and are left out of the sums.
    What reaches the driver is one row per list, and one per list and listed word.
    """
    known = docs.filter(F.col(lang_col).isin(sorted(COMMON_WORDS)))
    described = F.explode_outer(F.array(_described(text_col, histograms))).alias("_q")
    known = known.select(F.col(lang_col).alias("lang"), described)
    classes = F.col("_q.classes")
    plain = known.filter(100 * classes[MARKUP] <= rules.max_reference_markup_percent * total_of(classes))
    # one row per class and per word that occurs, summed in each task first
    bins = F.concat(
        F.transform(classes, lambda c, i: F.struct(F.concat(F.lit("#"), i).alias("bin"), c.cast("bigint").alias("n"))),
        F.transform("_q.common", lambda r: F.struct(r["word"].alias("bin"), r["n"].cast("bigint").alias("n"))),
        F.array(F.struct(F.lit("#words").alias("bin"), F.col("_q.n_words").alias("n"))),
    )
    sums = plain.select("lang", F.inline(bins)).groupBy("lang", "bin").agg(F.sum("n").alias("n"))
    found: dict[str, dict[str, int]] = {}
    for lang, name, n in sums.collect():
        found.setdefault(lang, {})[name] = n
    out = {}
    for lang, n in sorted(found.items()):
        counts = [n.get(f"#{i}", 0) for i in range(len(CLASSES))]
        if sum(counts) and n.get("#words"):
            shares = [n.get(w, 0) / n["#words"] for w in VOCABULARY]
            out[lang] = Reference([c / sum(counts) for c in counts], shares)
    return out


def _plogp(x: Column) -> Column:
    return F.when(x > 0, x * F.log2(x)).otherwise(0.0)


def _entropy(shares: Sequence[float]) -> float:
    return sum(v * math.log2(v) for v in shares if v > 0)


def _summed(terms: Column) -> Column:
    return F.aggregate(terms, F.lit(0.0), lambda a, t: a + t)


# The divergence of p and q is sum(p log p)/2 + sum(q log q)/2 - sum(m log m), m = (p + q)/2.


def _smallest(every: Sequence[Column]) -> Column:
    return F.sqrt(F.greatest(F.array_min(F.array(*every)), F.lit(0.0)))


def class_distance(classes: Column, refs: Sequence[Reference]) -> Column:
    """Jensen-Shannon distance of the class counts to the nearest reference."""

    def of(p: Column) -> Column:
        own = _summed(F.transform(p, _plogp)) / 2
        every = []
        for q in (r.classes for r in refs):
            halves = F.zip_with(p, F.lit([v / 2 for v in q]), lambda a, b: a / 2 + b)
            every.append(own + _entropy(q) / 2 - _summed(F.transform(halves, _plogp)))
        return _smallest(every)

    return let(let(total_of(classes), lambda n: F.transform(classes, lambda c: c / n)), of)


def word_distance(common: Column, n_words: Column, refs: Sequence[Reference]) -> Column:
    """The same for words. Only words that occur are visited; the others add a known amount."""

    def moved(half: Column) -> Callable[[Column], Column]:
        return lambda r: _plogp(r["p"] / 2 + F.get(half, r["at"])) - _plogp(F.get(half, r["at"]))

    def of(runs: Column) -> Column:
        rest = 1.0 - _summed(F.transform(runs, lambda r: r["p"]))
        own = (_summed(F.transform(runs, lambda r: _plogp(r["p"]))) + _plogp(rest)) / 2
        every = []
        for q in (r.words for r in refs):
            other = 1.0 - sum(q)
            absent = sum(v / 2 * math.log2(v / 2) for v in q if v > 0)
            change = F.transform(runs, moved(F.lit([v / 2 for v in q])))
            mixed = absent + _summed(change) + _plogp(rest / 2 + other / 2)
            every.append(own + (_entropy(q) + _entropy([other])) / 2 - mixed)
        return _smallest(every)

    at = F.lit(VOCABULARY)
    runs = F.transform(
        common,
        lambda r: F.struct(
            (r["n"] / n_words).alias("p"), (F.array_position(at, r["word"]) - 1).cast("int").alias("at")
        ),
    )
    return let(runs, of)


# Limits fall smoothly with the length of the text, towards those of a long one.


def class_limit(chars: Column, n_words: Column, by_word: Column, rules: Rules = RULES) -> Column:
    near = by_word * by_word * n_words <= rules.chance
    wide = F.sqrt(rules.max_class_distance**2 + rules.class_slack / chars)
    return F.when(near, wide).otherwise(rules.max_class_distance)


def word_limit(n_words: Column, rules: Rules = RULES) -> Column:
    return rules.max_word_distance + rules.word_slack / n_words


def unused(name: str, taken: Sequence[str]) -> str:
    """The name, with underscores in front until no column has it."""
    known = {c.lower() for c in taken}
    while name.lower() in known:
        name = f"_{name}"
    return name


def judged(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    rules: Rules = RULES,
    refs: dict[str, Reference] | None = None,
) -> DataFrame:
    """The columns of `docs` (but for names given anew), the counts, both distances, `base_failed`, `kept`."""
    if refs is None:
        refs = references(docs, text_col, lang_col, rules)
    # names that no column of the input has
    own, of_class, of_word = (unused(name, docs.columns) for name in ("_q", "_class_limit", "_word_limit"))
    q = F.col(own)
    known = list(refs.values())
    by_class = class_distance(q["classes"], known) if known else F.lit(0.0)
    by_word = word_distance(q["common"], q["n_words"], known) if known else F.lit(0.0)
    chars = total_of(q["classes"])
    long_enough = q["n_words"] >= rules.min_words
    base = (q["n_words"] < rules.min_words) | (
        100 * q["n_repeat_words"] > rules.max_repeat_percent * q["n_words"]
    )
    counts = {
        "n_words": q["n_words"],
        "word_chars": (chars - q["classes"][SPACES]).cast("bigint"),
        "n_symbols": q["classes"][MARKUP].cast("bigint"),
        "n_dup_lines": q["n_dup_lines"],
        "n_repeat_words": q["n_repeat_words"],
        "class_distance": F.when(long_enough, by_class).otherwise(0.0),
        of_class: F.when(long_enough, class_limit(chars, q["n_words"], by_word, rules)).otherwise(0.0),
        of_word: F.when(long_enough, word_limit(q["n_words"], rules)).otherwise(0.0),
        "word_distance": F.when(long_enough, by_word).otherwise(0.0),
        "base_failed": base,
    }
    # as the one row of a generator: a filter on the result is then not computed below it, text by text anew
    described = F.explode_outer(F.array(_described(text_col, histograms, repeats))).alias(own)
    made = [name for name in counts if name not in (of_class, of_word)]
    rows = docs.select("*", described).select(
        *[F.col(f"`{c}`") for c in docs.columns if c not in (*made, "kept")],
        *[value.alias(name) for name, value in counts.items()],
    )
    fine = (F.col("class_distance") <= F.col(of_class)) & (F.col("word_distance") <= F.col(of_word))
    return rows.withColumn("kept", ~F.col("base_failed") & fine).drop(of_class, of_word)
