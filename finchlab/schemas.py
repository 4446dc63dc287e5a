"""Explicit schemas; nothing in the package infers a schema from data."""

from pyspark.sql import types as T

RAW_LABELLED_POSTS = T.StructType([
    T.StructField("external_author_id", T.StringType()),
    T.StructField("author", T.StringType()),
    T.StructField("content", T.StringType()),
    T.StructField("region", T.StringType()),
    T.StructField("language", T.StringType()),
    T.StructField("publish_date", T.TimestampNTZType()),
    T.StructField("harvested_date", T.TimestampNTZType()),
    T.StructField("following", T.IntegerType()),
    T.StructField("followers", T.IntegerType()),
    T.StructField("updates", T.IntegerType()),
    T.StructField("post_type", T.StringType()),
    T.StructField("account_type", T.StringType()),
    T.StructField("retweet", T.IntegerType()),
    T.StructField("account_category", T.StringType()),
    T.StructField("new_june_2018", T.IntegerType()),
    T.StructField("alt_external_id", T.StringType()),
    T.StructField("tweet_id", T.StringType()),
    T.StructField("article_url", T.StringType()),
    T.StructField("tco1_step1", T.StringType()),
    T.StructField("tco2_step1", T.StringType()),
    T.StructField("tco3_step1", T.StringType()),
])

POSTS = T.StructType([
    T.StructField("author", T.StringType()),
    T.StructField("content", T.StringType()),
    T.StructField("publish_date", T.TimestampNTZType()),
    T.StructField("target", T.IntegerType()),
])

# fixed values: the columns of the unified corpus
POST_COLUMNS = ["author", "content", "publish_date", "target"]

# fixed values: the numeric features, in the order they enter the model matrix
NUMERIC_FEATURES = [
    "urls_count",
    "mentions_count",
    "hashtags_count",
    "reserved_words_count",
    "emojis_count",
    "word_count",
    "pct_upper",
    "exclams_count",
    "ques_marks_count",
    "dollar_marks_count",
    "pics_count",
]

# fixed values: the text features behind the three vocabularies
TEXT_FEATURES = ["content_tokenized_lemma_joined", "emojis_joined", "hashtags_joined"]

FEATURE_COLUMNS = POST_COLUMNS + NUMERIC_FEATURES + TEXT_FEATURES
