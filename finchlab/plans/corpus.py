"""From raw posts to the labelled corpus."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from finchlab.functions import text as X
from finchlab.operators import filters
from finchlab.operators.ranking import first_per_key
from finchlab.operators.sampling import downsample_to
from finchlab.schemas import POST_COLUMNS
from finchlab.session import stage_table


def union_all(*frames: DataFrame) -> DataFrame:
    """Union by name; a column missing from one side is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def labelled_category(raw: DataFrame, category: str = "RightTroll") -> DataFrame:
    """Posts of one account category with target 1."""
    return filters.labelled(filters.with_category(raw, category), 1)


def trim_posts(
    posts: DataFrame, order: list[str], language: str = "English", keep: list[str] = ()
) -> DataFrame:
    """Original posts in one language, pruned, first copy of each text.

    `order` says which copy is first and must be unique; its columns that are
    not part of the result are dropped.
    """
    kept = filters.in_language(
        filters.without_prefix(filters.flagged_original(posts)), language
    )
    columns = list(dict.fromkeys([*keep, *POST_COLUMNS]))
    pruned = kept.select(*dict.fromkeys([*columns, *order]))
    return first_per_key(pruned, ["content"], order).select(*columns)


def trim_step_counts(
    posts: DataFrame, language: str = "English"
) -> DataFrame:
    """Rows left after every step of `trim_posts`, in one pass over the input.

    Distinct texts are counted from sums per text digest: hot texts are combined
    before the shuffle, and 64 characters stand for a text of any length.
    """
    flagged = F.col("retweet") == 0
    original = flagged & ~F.col("content").startswith("RT ")
    native = original & (F.col("language") == language)
    per_text = posts.groupBy(F.sha2("content", 256).alias("text")).agg(
        F.count("*").alias("all_rows"),
        F.count_if(flagged).alias("flagged"),
        F.count_if(original).alias("original"),
        F.count_if(native).alias("native"),
    )
    totals = per_text.agg(
        F.coalesce(F.sum("all_rows"), F.lit(0)).alias("input"),
        F.coalesce(F.sum("flagged"), F.lit(0)).alias("retweet_flag"),
        F.coalesce(F.sum("original"), F.lit(0)).alias("retweet_prefix"),
        F.coalesce(F.sum("native"), F.lit(0)).alias("language"),
        F.count_if(F.col("native") > 0).alias("distinct_text"),
    )
    steps = ["input", "retweet_flag", "retweet_prefix", "language", "distinct_text"]
    rows = F.array(
        *[
            F.struct(
                F.lit(i).alias("step"),
                F.lit(name).alias("stage"),
                F.col(name).alias("rows"),
                (F.col(steps[max(i - 1, 0)]) - F.col(name)).alias("filtered_out"),
            )
            for i, name in enumerate(steps)
        ]
    )
    return totals.select(F.inline(rows))


def trim_posts_counted(
    posts: DataFrame, order: list[str], path: str, language: str = "English", keep: list[str] = ()
) -> tuple[DataFrame, DataFrame]:
    """`trim_posts` and the counts of `trim_step_counts`, both from one pass over the posts.

    The aggregate that finds the first copy of each text counts its rows step by step, and
    is written to `path`, one row per text; the counts are sums over its narrow columns.
    (Not `observe`: a session that has observed once can no longer serialise ML models.)
    """
    columns = list(dict.fromkeys([*keep, *POST_COLUMNS]))
    flagged = F.col("retweet") == 0
    original = flagged & ~F.col("content").startswith("RT ")
    native = original & (F.col("language") == language)
    row = F.struct(*dict.fromkeys([*order, *columns]))
    per_text = posts.groupBy(F.coalesce(F.sha2("content", 256), F.lit("null")).alias("text")).agg(
        F.min(F.when(native, row)).alias("first"),
        F.count("*").alias("input"),
        F.count_if(flagged).alias("retweet_flag"),
        F.count_if(original).alias("retweet_prefix"),
        F.count_if(native).alias("language"),
    )
    per_text.drop("text").write.parquet(path)
    written = posts.sparkSession.read.schema(per_text.drop("text").schema).parquet(path)
    steps = ["input", "retweet_flag", "retweet_prefix", "language", "distinct_text"]
    sums = written.agg(
        *[F.coalesce(F.sum(s), F.lit(0)).alias(s) for s in steps[:-1]],
        F.count_if(F.col("language") > 0).alias("distinct_text"),
    )
    rows = F.array(*[
        F.struct(
            F.lit(i).alias("step"), F.lit(s).alias("stage"), F.col(s).alias("rows"),
            (F.col(steps[max(i - 1, 0)]) - F.col(s)).alias("filtered_out"),
        )
        for i, s in enumerate(steps)
    ])
    trimmed = written.filter("first is not null").select(*[F.col("first")[c].alias(c) for c in columns])
    return trimmed, sums.select(F.inline(rows))


def control_posts(raw: DataFrame, order: list[str], keep: list[str] = ()) -> DataFrame:
    """Crawled control posts: first copy of each text, target 0, unified columns."""
    first = first_per_key(raw, ["tweet"], order)
    return filters.labelled(first, 0).select(
        *keep,
        F.col("username").alias("author"),
        F.col("tweet").alias("content"),
        X.timestamp_of(F.col("date"), F.col("time")).alias("publish_date"),
        "target",
    )


def combined_corpus(
    labelled: DataFrame, control: DataFrame, key: str, seed: int = 123
) -> DataFrame:
    """Both classes in equal number: the labelled posts are sampled down.

    Both inputs are written as stage tables first, because counting, finding the
    cut and selecting read them three times and their deduplication is a shuffle.
    """
    return downsample_to(
        stage_table(labelled, "labelled"), stage_table(control, "control"), key, seed
    )
