"""Vocabularies, TF-IDF blocks, scaling and the combined model matrix.

Fitting reads the training features three times (statistics, frequent words,
term counts) and keeps at most `size` terms per block on the driver. Transforming
is map-only: the vocabularies travel inside the fitted pipeline.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark import keyword_only
from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.feature import (
    CountVectorizerModel,
    ElementwiseProduct,
    Normalizer,
    VectorAssembler,
    VectorSizeHint,
)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from finchlab.functions import patterns as P
from finchlab.functions import text as X
from finchlab.operators.lists import exploded, with_ngrams
from finchlab.operators.ranking import top_k_per_group
from finchlab.schemas import NUMERIC_FEATURES


@dataclass(frozen=True)
class Block:
    """One vocabulary: where its terms come from and how many are kept."""

    name: str
    column: str
    size: int
    words: bool = False
    longest: int = 1
    stop_words: list[str] = field(default_factory=list)

    def terms(self) -> Column:
        text = F.col(self.column)
        return X.word_terms(text, self.stop_words) if self.words else X.space_terms(text)


# fixed values: the three vocabularies of the model matrix
WORDS = Block(
    "words", "content_tokenized_lemma_joined", 300, True, 3, P.VECTORISER_STOP_WORDS
)
EMOJIS = Block("emojis", "emojis_joined", 200)
HASHTAGS = Block("hashtags", "hashtags_joined", 300)
BLOCKS = [WORDS, EMOJIS, HASHTAGS]


def frequent_words(features: DataFrame, block: Block) -> list[str]:
    """The `size` first words, which every top n-gram begins with one of.

    The first word of an n-gram is at least as frequent as the n-gram and sorts
    before it. So behind a first word that is not among the first `size` words by
    (frequency, word) there are `size` words that all come before the n-gram.
    """
    return _leading_words(features, block)[0]


def _leading_words(features: DataFrame, block: Block) -> tuple[list[str], list[str] | None]:
    """The `frequent_words`, and all words that are as frequent as the last of them.

    An n-gram with a rarer word in any place is rarer than `size` words and not a top
    term. The second list is None where more than `size` other words are as frequent as
    the last one, as in a small table.
    """
    counts = (
        exploded(features, block.terms(), "term")
        .groupBy("term")
        .agg(F.count("*").alias("cf"))
        .orderBy(F.col("cf").desc(), "term")
    )
    found = counts.limit(2 * block.size + 1).collect()
    first = found[: block.size]
    frequent = [row["term"] for row in found if row["cf"] >= first[-1]["cf"]]
    return [row["term"] for row in first], frequent if len(frequent) <= 2 * block.size else None


def term_counts(
    features: DataFrame, blocks: list[Block] = BLOCKS, prune: bool = False
) -> DataFrame:
    """(block, term, cf, df): corpus and document frequency, one pass for all blocks.

    `prune` leaves out n-grams that cannot be among a block's top terms. Occurrences
    and first occurrences are exploded side by side and summed per term, so nothing is
    shuffled per (post, term).
    """

    def tally(block: str, items: Column, cf: int, df: int) -> Column:
        return F.transform(
            items,
            lambda t: F.struct(
                F.lit(block).alias("block"),
                t.alias("term"),
                F.lit(cf).alias("cf"),
                F.lit(df).alias("df"),
            ),
        )

    listed = features.select(*dict.fromkeys(block.column for block in blocks))
    tallies = []
    for block in blocks:
        first, every = _leading_words(features, block) if prune and block.longest > 1 else (None, None)
        name = f"{block.name}_terms"
        listed = with_ngrams(listed, block.terms(), block.longest, name, first, every)
        tallies.append(tally(block.name, F.col(name), 1, 0))
        tallies.append(tally(block.name, F.array_distinct(F.col(name)), 0, 1))
    return (
        exploded(listed, F.concat(*tallies), "t")
        .groupBy(F.col("t.block").alias("block"), F.col("t.term").alias("term"))
        .agg(F.sum("t.cf").alias("cf"), F.sum("t.df").alias("df"))
    )


def vocabulary(features: DataFrame, blocks: list[Block] = BLOCKS) -> DataFrame:
    """(block, idx, term, cf, df): the most frequent terms, numbered alphabetically.

    Ties at the cut go to the alphabetically first term.
    """
    sizes = F.create_map(*[F.lit(v) for b in blocks for v in (b.name, b.size)])
    top = top_k_per_group(
        term_counts(features, blocks, prune=True),
        ["block"],
        [F.col("cf").desc(), F.col("term")],
        max(b.size for b in blocks),
        salt_by=["term"],
    ).filter(F.col("rank") <= sizes[F.col("block")])
    by_term = Window.partitionBy("block").orderBy("term")
    return top.select(
        "block",
        (F.row_number().over(by_term) - 1).cast("int").alias("idx"),
        "term",
        "cf",
        "df",
    )


class TermLists(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Adds the term list of one block; words outside `keep` are skipped early."""

    inputCol = Param(Params._dummy(), "inputCol", "text", TypeConverters.toString)
    outputCol = Param(Params._dummy(), "outputCol", "terms", TypeConverters.toString)
    words = Param(Params._dummy(), "words", "word terms", TypeConverters.toBoolean)
    longest = Param(Params._dummy(), "longest", "longest n-gram", TypeConverters.toInt)
    stopWords = Param(Params._dummy(), "stopWords", "dropped", TypeConverters.toListString)
    keep = Param(Params._dummy(), "keep", "known words", TypeConverters.toListString)

    @keyword_only
    def __init__(
        self, inputCol="", outputCol="", words=False, longest=1, stopWords=(), keep=()
    ):
        super().__init__()
        self._set(
            inputCol=inputCol,
            outputCol=outputCol,
            words=words,
            longest=longest,
            stopWords=list(stopWords),
            keep=list(keep),
        )

    def _transform(self, dataset: DataFrame) -> DataFrame:
        get = self.getOrDefault
        block = Block(
            get(self.outputCol),
            get(self.inputCol),
            0,
            get(self.words),
            get(self.longest),
            get(self.stopWords),
        )
        known = get(self.keep)
        return with_ngrams(dataset, _masked(block.terms(), known), block.longest, block.name)


def _masked(words: Column, keep: list[str]) -> Column:
    """Null in place of words outside the vocabulary's words: no n-gram over them is in it."""
    return F.transform(words, lambda w: F.when(w.isin(keep), w))


class PopulationScaler(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """(x - mean) / population deviation; a constant column becomes 0."""

    inputCols = Param(Params._dummy(), "inputCols", "columns", TypeConverters.toListString)
    outputCol = Param(Params._dummy(), "outputCol", "vector", TypeConverters.toString)
    means = Param(Params._dummy(), "means", "means", TypeConverters.toListFloat)
    deviations = Param(Params._dummy(), "deviations", "deviations", TypeConverters.toListFloat)

    @keyword_only
    def __init__(self, inputCols=(), outputCol="", means=(), deviations=()):
        super().__init__()
        self._set(
            inputCols=list(inputCols),
            outputCol=outputCol,
            means=list(means),
            deviations=list(deviations),
        )

    def scaled(self) -> list[Column]:
        get = self.getOrDefault
        return [
            F.lit(0.0) if s == 0 else (F.col(c).cast("double") - F.lit(m)) / F.lit(s)
            for c, m, s in zip(get(self.inputCols), get(self.means), get(self.deviations))
        ]

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return dataset.withColumn(
            self.getOrDefault(self.outputCol), array_to_vector(F.array(*self.scaled()))
        )


def numeric_statistics(features: DataFrame, columns: list[str] = NUMERIC_FEATURES) -> DataFrame:
    """One row: count, and mean and population deviation of every column."""
    return features.agg(
        F.count("*").alias("n"),
        *[F.avg(c).alias(f"{c}_mean") for c in columns],
        *[F.stddev_pop(c).alias(f"{c}_std") for c in columns],
    )


def fit_scaler(
    features: DataFrame, columns: list[str] = NUMERIC_FEATURES, output: str = "numerics"
) -> tuple[PopulationScaler, int]:
    """The fitted scaler and the number of rows it saw."""
    row = numeric_statistics(features, columns).first()
    scaler = PopulationScaler(
        inputCols=columns,
        outputCol=output,
        means=[row[f"{c}_mean"] or 0.0 for c in columns],
        deviations=[row[f"{c}_std"] or 0.0 for c in columns],
    )
    return scaler, row["n"]


@dataclass
class FittedVectors:
    """Fitted feature stages and the name of every feature in order."""

    stages: list[Transformer]
    names: list[str]
    slices: dict[str, list[str]]

    @property
    def model(self) -> PipelineModel:
        return PipelineModel(stages=self.stages)

    def transform(self, df: DataFrame) -> DataFrame:
        return self.model.transform(df)


def _block_stages(block: Block, rows: list, n: int, weighting: str) -> list[Transformer]:
    terms = [row["term"] for row in rows]
    known = sorted({word for t in terms for word in (t.split(" ") if block.longest > 1 else [t])})
    lists, counts = f"{block.name}_terms", f"{block.name}_counts"
    stages = [
        TermLists(
            inputCol=block.column,
            outputCol=lists,
            words=block.words,
            longest=block.longest,
            stopWords=block.stop_words,
            keep=known,
        )
    ]
    raw = block.name if weighting == "count" else counts
    stages.append(CountVectorizerModel.from_vocabulary(terms, inputCol=lists, outputCol=raw))
    if weighting == "tfidf":
        idf = [math.log((1 + n) / (1 + row["df"])) + 1 for row in rows]
        stages.append(
            ElementwiseProduct(
                scalingVec=Vectors.dense(idf), inputCol=counts, outputCol=f"{block.name}_weighted"
            )
        )
        stages.append(
            Normalizer(p=2.0, inputCol=f"{block.name}_weighted", outputCol=block.name)
        )
    return stages


def fit_vectors(
    train: DataFrame,
    blocks: list[Block] = BLOCKS,
    numerics: list[str] = NUMERIC_FEATURES,
    weighting: str = "tfidf",
    output: str = "features",
) -> FittedVectors:
    """Fit vocabularies, idf and scaling on `train` (read several times: stage it).

    A block without any term in `train` is left out of the matrix.
    """
    scaler, n = fit_scaler(train, numerics) if numerics else (None, train.count())
    fitted: dict[str, list] = {block.name: [] for block in blocks}
    if blocks:
        for row in vocabulary(train, blocks).orderBy("block", "idx").collect():
            fitted[row["block"]].append(row)
    stages: list[Transformer] = []
    slices: dict[str, list[str]] = {}
    for block in blocks:
        rows = fitted[block.name]
        if rows:
            stages += _block_stages(block, rows, n, weighting)
            slices[block.name] = [row["term"] for row in rows]
    if numerics:
        stages.append(scaler)
        # tells the assembler the width, which it would otherwise read from a row
        stages.append(
            VectorSizeHint(inputCol="numerics", size=len(numerics), handleInvalid="optimistic")
        )
        slices["numerics"] = list(numerics)
    stages.append(VectorAssembler(inputCols=list(slices), outputCol=output))
    names = [name for part in slices.values() for name in part]
    return FittedVectors(stages, names, slices)


def long_form(vectors: DataFrame, key: str, fitted: FittedVectors) -> DataFrame:
    """(key, block, term, weight) of all non-zero weights; map-only."""

    def named(block: str, names: list[str]) -> Column:
        pairs = F.arrays_zip(
            F.array(*[F.lit(n) for n in names]).alias("term"),
            vector_to_array(F.col(block)).alias("weight"),
        )
        return F.transform(
            F.filter(pairs, lambda e: e["weight"] != 0),
            lambda e: F.struct(
                F.lit(block).alias("block"), e["term"].alias("term"), e["weight"].alias("weight")
            ),
        )

    parts = [named(block, names) for block, names in fitted.slices.items()]
    weights = exploded(vectors, F.concat(*parts), "w", [key])
    return weights.select(key, "w.block", "w.term", "w.weight")


def combined_features(
    train: DataFrame, *others: DataFrame
) -> tuple[FittedVectors, list[DataFrame]]:
    """Fit on `train`, return the fitted stages and every frame with `features`."""
    fitted = fit_vectors(train)
    return fitted, [fitted.transform(part) for part in (train, *others)]
