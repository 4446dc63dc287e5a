"""The `posts` view: every document as a social post.

A projection of the whole `documents` table. The decorations (links, mentions,
hashtags, emojis, ...) depend on the text alone, so copies of a document stay
copies. The same text runs on both engines; only the timestamp type differs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from finchlab.session import spread

POSTS_SQL = """
select doc_id as post_id, source as author,
 concat(
  case when text like 'T%' then 'RT ' else '' end,
  text,
  case when n_chars % 3 = 0 then concat(' https://ex.org/p', cast(n_chars as varchar(20))) else '' end,
  case when n_chars % 4 = 0 then concat(' @', lang, '_user') else '' end,
  concat(' #', regexp_extract(text, '([A-Za-z]+)', 1)),
  case when n_chars % 2 = 0 then concat(' #Topic', cast(n_chars % 5 as varchar(20))) else '' end,
  case when n_chars % 5 = 0 then ' 😀 🎉' when n_chars % 5 = 1 then ' 🚀' else '' end,
  case when n_chars % 11 = 0 then ' :)' else '' end,
  case when n_chars % 6 = 0 then concat(' pic.twitter.com/a', cast(n_chars as varchar(20))) else '' end,
  case when n_chars % 8 = 0 then ' I cannot wait?' else '' end
 ) as content,
 case when n_chars % 10 = 0 then 'French' else 'English' end as language,
 {TS} '2015-01-01 00:00:00' + doc_id * interval '1' hour as publish_date,
 case when lang = 'en' then 'RightTroll' else 'NewsFeed' end as account_category,
 case when n_chars % 7 = 0 then 1 else 0 end as retweet
from documents
"""

DUCK_POSTS = POSTS_SQL.replace("{TS}", "timestamp")
SPARK_POSTS = POSTS_SQL.replace("{TS}", "timestamp_ntz").replace("from documents", "from {documents}")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def posts(spark: SparkSession, sf_dir: str, heavy: bool = False) -> DataFrame:
    """`heavy` spreads the few splits of a small input over all cores."""
    documents = table(spark, sf_dir, "documents")
    if heavy:
        documents = spread(documents, "doc_id")
    return spark.sql(SPARK_POSTS, documents=documents)


def labelled_posts(spark: SparkSession, sf_dir: str, heavy: bool = False) -> DataFrame:
    """Posts with target 1 for the studied account category."""
    return posts(spark, sf_dir, heavy).selectExpr(
        "*", "cast(account_category = 'RightTroll' as int) as target"
    )
