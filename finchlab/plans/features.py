"""The feature table: one row per post, numeric counts and cleaned text."""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Transformer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from finchlab.functions import patterns as P
from finchlab.functions import text as X
from finchlab.operators.lemmas import lemmatize_by_join
from finchlab.schemas import FEATURE_COLUMNS, NUMERIC_FEATURES, TEXT_FEATURES
from finchlab.session import stage_table


def add_matches(
    df: DataFrame, pattern: str, column: str, new_column: str, strip: bool = False
) -> DataFrame:
    """List of all matches as a new column; `strip` also removes them from `column`."""
    out = df.withColumn(new_column, X.matches(F.col(column), pattern))
    return out.withColumn(column, X.without(F.col(column), pattern)) if strip else out


def add_count(df: DataFrame, column: str) -> DataFrame:
    """Length of a list column as `<column>_count`."""
    return df.withColumn(f"{column}_count", X.count_of(F.col(column)))


def with_clean_text(df: DataFrame, column: str, new_column: str) -> DataFrame:
    """`clean` of a column as a new column.

    Every step reads its input once: a filter on a derived column is substituted
    down to the scan, and steps that read it twice would double the expression.
    """
    return df.withColumn(new_column, X.clean(F.col(column)))


def tokenised_posts(posts: DataFrame, punctuation_source: str = "raw", keep: list[str] = ()) -> DataFrame:
    """All that is read off the text of a post, with its words in `_words`; map-only.

    `punctuation_source="clean"` counts `!`, `?` and `$` after punctuation has
    been removed, which always gives 0; `"raw"` counts them in the post.
    """
    if punctuation_source not in ("raw", "clean"):
        raise ValueError("punctuation_source is 'raw' or 'clean'")
    carried = [*keep, "author", "publish_date", "target"]
    raw, clean = F.col("_raw"), F.col("_clean")
    parsed = posts.select(*carried, F.coalesce(F.col("content"), F.lit("")).alias("_raw"))
    parsed = with_clean_text(parsed, "_raw", "_clean")
    marks = raw if punctuation_source == "raw" else clean
    tokenised = parsed.select(
        *carried,
        "_raw",
        X.emojis(raw).alias("_emojis"),
        X.hashtags(raw).alias("_hashtags"),
        X.match_count(raw, P.URL).alias("urls_count"),
        X.match_count(raw, P.MENTION).alias("mentions_count"),
        X.match_count(raw, P.RESERVED).alias("reserved_words_count"),
        X.character_count(marks, "!").alias("exclams_count"),
        X.character_count(marks, "?").alias("ques_marks_count"),
        X.character_count(marks, "$").alias("dollar_marks_count"),
        X.match_count(raw, P.PICTURE).alias("pics_count"),
        X.pct_upper(clean).alias("pct_upper"),
        X.tokens(F.lower(clean)).alias("_tokens"),
    )
    counted = [X.count_of(F.col("_tokens")).alias("word_count") if c == "_tokens" else c for c in tokenised.columns]
    return tokenised.select(*counted, X.drop_words(F.col("_tokens"), P.ENGLISH_STOP_WORDS).alias("_words"))


def shaped_features(tokenised: DataFrame, keep: list[str] = ()) -> DataFrame:
    """The feature columns of `tokenised_posts`, whose words may have been replaced meanwhile."""
    shaped = tokenised.select(
        *keep,
        "author",
        "publish_date",
        "target",
        X.without(F.col("_raw"), P.PICTURE).alias("content"),
        *[c for c in NUMERIC_FEATURES if c in tokenised.columns],
        X.count_of(F.col("_hashtags")).alias("hashtags_count"),
        X.count_of(F.col("_emojis")).alias("emojis_count"),
        X.joined(F.col("_words")).alias("content_tokenized_lemma_joined"),
        X.joined(F.col("_emojis")).alias("emojis_joined"),
        X.joined(F.col("_hashtags")).alias("hashtags_joined"),
    )
    return shaped.select(*keep, *FEATURE_COLUMNS)


def post_features(
    posts: DataFrame,
    punctuation_source: str = "raw",
    lemmas: DataFrame | None = None,
    keep: list[str] = (),
) -> DataFrame:
    """The 18 feature columns, preceded by the columns named in `keep`.

    Map-only: one narrow stage of built-in expressions, no shuffle, no Python. With a
    (token, lemma) table, tokens are replaced by a join; the first column of `keep` is
    then the key of the posts, and what is read off their texts is written first, as the
    join reads it twice.
    """
    if lemmas is not None and not keep:
        raise ValueError("lemmas need the key of the posts as first column of keep")
    tokenised = tokenised_posts(posts, punctuation_source, keep)
    if lemmas is not None:
        tokenised = lemmatize_by_join(stage_table(tokenised, "tokenised"), keep[0], "_words", lemmas)
    return shaped_features(tokenised, keep)


def model_columns(features: DataFrame, keep: list[str] = ()) -> DataFrame:
    """The 15 columns the models need."""
    return features.select(*keep, "target", *NUMERIC_FEATURES, *TEXT_FEATURES)


class PostFeatures(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """`post_features` as a pipeline stage, for batch and streaming scoring."""

    punctuationSource = Param(
        Params._dummy(), "punctuationSource", "raw or clean", TypeConverters.toString
    )
    lemmaPath = Param(
        Params._dummy(), "lemmaPath", "(token, lemma) table, or empty", TypeConverters.toString
    )
    keep = Param(Params._dummy(), "keep", "columns to carry along", TypeConverters.toListString)

    @keyword_only
    def __init__(self, punctuationSource="raw", lemmaPath="", keep=()):
        super().__init__()
        self._setDefault(punctuationSource="raw", lemmaPath="", keep=[])
        self._set(punctuationSource=punctuationSource, lemmaPath=lemmaPath, keep=list(keep))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        path = self.getOrDefault(self.lemmaPath)
        lemmas = dataset.sparkSession.read.parquet(path) if path else None
        return post_features(
            dataset,
            self.getOrDefault(self.punctuationSource),
            lemmas,
            self.getOrDefault(self.keep),
        )
