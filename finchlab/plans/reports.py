"""Reporting tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from finchlab.functions import patterns as P
from finchlab.functions import text as X
from finchlab.operators.lists import exploded
from finchlab.operators.ranking import top_k_per_group


def hashtag_counts(posts: DataFrame, pattern: str = P.HASHTAG) -> DataFrame:
    """(hashtag, counts), case-sensitive, most frequent first."""
    return (
        exploded(posts, X.matches(F.col("content"), pattern), "hashtag")
        .groupBy("hashtag")
        .agg(F.count("*").alias("counts"))
        .orderBy(F.col("counts").desc(), "hashtag")
    )


def daily_counts(posts: DataFrame) -> DataFrame:
    """(publish_date, num_of_tweets) per calendar day; posts without a date are left out."""
    return (
        posts.filter(F.col("publish_date").isNotNull())
        .groupBy(F.to_date("publish_date").alias("publish_date"))
        .agg(F.count("*").alias("num_of_tweets"))
        .orderBy("publish_date")
    )


def value_counts(df: DataFrame, column: str, top: int | None = None) -> DataFrame:
    """(column, count) of the non-null values, most frequent first."""
    counts = (
        df.filter(F.col(column).isNotNull())
        .groupBy(column)
        .agg(F.count("*").alias("count"))
        .orderBy(F.col("count").desc(), column)
    )
    return counts.limit(top) if top else counts


def value_shares(df: DataFrame, column: str) -> DataFrame:
    """(column, share) of the non-null values.

    The total is an aggregate of the counts, not a window over all of them.
    """
    counts = value_counts(df, column)
    total = counts.agg(F.sum("count").alias("n")).scalar()
    return counts.select(column, (F.col("count") / total).alias("share"))


def distinct_authors(posts: DataFrame, approximate: bool = False) -> DataFrame:
    count = F.approx_count_distinct if approximate else F.count_distinct
    return posts.agg(count("author").alias("authors"))


def date_range(posts: DataFrame) -> DataFrame:
    return posts.agg(
        F.min("publish_date").alias("first_post"), F.max("publish_date").alias("last_post")
    )


def class_terms(
    features: DataFrame,
    k: int = 300,
    label: str = "target",
    text: str = "content_tokenized_lemma_joined",
    with_all: bool = True,
) -> DataFrame:
    """(class, term, count, rank): the most frequent words of every class.

    With `with_all`, class `all` covers every post; it is summed from the class
    counts, so the text is read once.
    """
    per_class = (
        exploded(features, X.space_terms(F.col(text)), "term", [label])
        .groupBy(F.col(label).cast("string").alias("class"), "term")
        .agg(F.count("*").alias("count"))
    )
    if with_all:
        classes = F.array(F.col("class"), F.lit("all"))
        per_class = (
            per_class.withColumn("class", F.explode(classes))
            .groupBy("class", "term")
            .agg(F.sum("count").alias("count"))
        )
    order = [F.col("count").desc(), F.col("term")]
    return top_k_per_group(per_class, ["class"], order, k, salt_by=["term"])


def seed_hashtags(
    counts: DataFrame, over: int = 1000, skip: int = 23, then: int = 30
) -> DataFrame:
    """Hashtags used more than `over` times, plus `then` capitalised ones after `skip`.

    Both parts are short reports of the counts; `part` tells them apart.
    """
    order = [F.col("counts").desc(), F.col("hashtag")]
    frequent = counts.filter(F.col("counts") > over).select("hashtag", "counts")
    capitalised = (
        counts.filter(F.col("hashtag").rlike("[A-Z]+"))
        .orderBy(*order)
        .offset(skip)
        .limit(then)
        .select("hashtag", "counts")
    )
    return frequent.withColumn("part", F.lit("frequent")).unionByName(
        capitalised.withColumn("part", F.lit("capitalised"))
    )


def explorer_extract(predictions: DataFrame) -> DataFrame:
    """Predictions as shown by the explorer: handle, text, day, probability, class, colour."""
    return predictions.select(
        X.at_name(F.col("author")).alias("username"),
        F.col("content").alias("tweet_text"),
        F.to_date("publish_date").alias("datetime"),
        F.col("y_pred_proba").alias("pred_proba"),
        X.zero_else(F.col("target"), "No", "Yes").alias("troll"),
        X.zero_else(F.col("target"), "turquoise", "salmon").alias("color"),
    )
