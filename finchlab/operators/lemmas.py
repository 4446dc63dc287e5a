"""Replacing tokens by their lemma from a (token, lemma) table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from finchlab.functions import text as X
from finchlab.session import stage_table


def lemmatize_by_join(
    df: DataFrame, key: str, words: str, lemmas: DataFrame, tags: str | None = None
) -> DataFrame:
    """`words` with every token replaced by its lemma, for a dictionary of any size.

    Only tokens that change are moved: one join on the token, one regrouping by row.
    The dictionary is written first, so the engine knows its size, sends it to all
    tasks when small and splits a token that is a third of all tokens when not. `key`
    must be unique. With `tags`, a column of part-of-speech tags beside the words,
    dictionary tokens are `word/pos`; a word whose tag maps to no part of speech is
    kept. Of several lemmas for one token the first in order counts.
    """
    entries = lemmas.groupBy("token").agg(F.min("lemma").alias("lemma"))
    if tags is None:
        # such entries change nothing
        entries = entries.filter("token <> lemma")
    entries = stage_table(entries, "lemmas")
    tokens = F.col(words)
    if tags is not None:
        tokens = F.zip_with(words, tags, lambda w, t: F.concat(w, F.lit("/"), X.wordnet_pos(t)))
    # the outer form: a plain explode has the tokens tested before they are made, down at the scan
    exploded = df.select(key, F.posexplode_outer(tokens).alias("_pos", "token")).filter(F.col("token").isNotNull())
    found = exploded.join(entries, "token").groupBy(key).agg(
        # a position met twice is an error
        F.map_from_entries(F.collect_list(F.struct("_pos", "lemma"))).alias("_changed")
    )
    # merged whatever the sizes: rows come in the order of their key, which a fit that sums them sees
    return df.join(found.hint("merge"), key, "left").withColumn(words, _replaced(F.col(words), F.col("_changed"))).drop("_changed")


def _replaced(words: Column, changed: Column) -> Column:
    """`words` with those at the positions of a (position, lemma) map replaced.

    A map is searched entry by entry, so looking up every position costs words times
    changes. The changes in order, with nulls for the words between them, are a list
    beside the words instead.
    """
    ordered = F.array_sort(F.filter(F.map_entries(changed), lambda c: c["key"] < F.size(words)))

    def placed(entries: Column) -> Column:
        def with_gap(c: Column, i: Column) -> Column:
            gap = c["key"] - F.coalesce(F.get(entries, i - 1)["key"], F.lit(-1)) - 1
            return F.concat(F.array_repeat(F.lit(None).cast("string"), gap), F.array(c["value"]))

        return F.flatten(F.transform(entries, with_gap))

    # bound once: an expression named in a function of the elements would be computed for each of them
    beside = F.get(F.transform(F.array(ordered), placed), F.lit(0))
    return F.coalesce(F.zip_with(words, beside, lambda w, lemma: F.coalesce(lemma, w)), words)


# fixed values: noun endings and what replaces them, longest first
NOUN_ENDINGS = [
    ("ches", "ch"), ("shes", "sh"), ("ses", "s"), ("xes", "x"), ("zes", "z"),
    ("ies", "y"), ("men", "man"), ("s", ""),
]


def lemmas_from_corpus(words: DataFrame, token: str = "token") -> DataFrame:
    """A noun dictionary from the corpus itself, when no dictionary is at hand.

    A token is reduced by an ending rule only if the reduced form also occurs as
    a token; the first rule that fits wins. Works on distinct tokens, which are written
    first, as the join reads them twice.
    """
    known = stage_table(words.select(F.col(token).alias("token")).distinct(), "known")
    options = F.array(
        *[
            F.when(
                F.col("token").endswith(old) & (F.length("token") > len(old)),
                F.struct(
                    F.lit(i).alias("rule"),
                    F.concat(
                        F.expr(f"left(token, length(token) - {len(old)})"), F.lit(new)
                    ).alias("lemma"),
                ),
            )
            for i, (old, new) in enumerate(NOUN_ENDINGS)
        ]
    )
    guesses = known.select("token", F.inline(F.array_compact(options)))
    fitting = guesses.join(known.select(F.col("token").alias("lemma")), "lemma")
    return fitting.groupBy("token").agg(F.min_by("lemma", "rule").alias("lemma"))
