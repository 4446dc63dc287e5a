"""Registered queries with, where SQL can express them, their oracle SQL.

Every query reads its whole tables.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from finchlab.functions import patterns as P
from finchlab.functions import text as X
from finchlab.operators import filters, knn, lsh, metrics, sampling
from finchlab.operators.lemmas import lemmas_from_corpus, lemmatize_by_join
from finchlab.operators.lists import exploded
from finchlab.operators.ranking import first_per_key
from finchlab.plans import adaboost as boosted_stumps
from finchlab.plans import corpus, forests, models, reports, selection, sketches
from finchlab.plans.adaboost import AdaBoost
from finchlab.plans.binned import fit_cuts, sparse_rows
from finchlab.plans.features import (
    model_columns,
    post_features,
    shaped_features,
    tokenised_posts,
    with_clean_text,
)
from finchlab.plans.vectors import (
    BLOCKS,
    EMOJIS,
    HASHTAGS,
    WORDS,
    Block,
    combined_features,
    fit_scaler,
    fit_vectors,
    long_form,
    term_counts,
    vocabulary,
)
from finchlab.schemas import FEATURE_COLUMNS, NUMERIC_FEATURES
from finchlab.session import checkpoint_dir, sized, spread, stage_table
from finchlab.sources.seeds import collect_by_seed
from finchlab.sources.readers import CONTROL_ORDER, read_control, read_posts
from finchlab.sources.writers import load_model, save_model, write_csv, write_table
from finchlab.streaming.collect import collect_available
from finchlab.streaming.firsts import first_copies_available
from finchlab.streaming.ingest import ingest_available, stream_files
from finchlab.streaming.scoring import score_available
from registry import duck
from registry.posts import labelled_posts, posts, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
SEED = 123


def query(sql: str | None = None, name: str | None = None):
    def register(fn: Query) -> Query:
        key = name or fn.__name__
        QUERIES[key] = fn
        if sql:
            ORACLES[key] = sql
        return fn

    return register


def text_of(column: str):
    return F.col(column).cast("string").alias(column)


_tokenised: dict[tuple, DataFrame] = {}


def _tokenised_posts(spark: SparkSession, sf: str) -> DataFrame:
    """What is read off the texts, written once per session and input folder: for the dictionary and the features."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _tokenised:
        rows = tokenised_posts(labelled_posts(spark, sf, heavy=True), keep=["post_id"])
        _tokenised[key] = stage_table(rows, "tokenised")
    return _tokenised[key]


_dictionaries: dict[tuple, str] = {}


def _dictionary_path(spark: SparkSession, sf: str) -> str:
    """The corpus dictionary as a table; once per session and input folder."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _dictionaries:
        path = f"{checkpoint_dir(spark)}/dictionary-{uuid.uuid4().hex}"
        write_table(_dictionary(_tokenised_posts(spark, sf).select(F.col("_words").alias("w"))), path)
        _dictionaries[key] = path
    return _dictionaries[key]


def lemmatised_features(spark: SparkSession, sf: str) -> DataFrame:
    """The feature table with words reduced by the corpus dictionary."""
    lemmas = spark.read.parquet(_dictionary_path(spark, sf))
    rows = _tokenised_posts(spark, sf)
    # dealt as the posts were before they were written: a fit that sums rows sees their order
    tasks = max(spark.sparkContext.defaultParallelism, rows.rdd.getNumPartitions())
    words = lemmatize_by_join(rows.repartition(tasks, "post_id"), "post_id", "_words", lemmas)
    return shaped_features(words, keep=["post_id"])


_staged: dict[tuple, DataFrame] = {}


def staged_features(spark: SparkSession, sf: str) -> DataFrame:
    """The feature table, written once per session and input folder."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _staged:
        features = lemmatised_features(spark, sf)
        _staged[key] = stage_table(model_columns(features, ["post_id"]), "features")
    return _staged[key]


# ---- reports ---------------------------------------------------------------


@query(
    f"with {duck.POSTS} select hashtag, count(*) as counts from "
    f"(select unnest({duck.found('content', P.HASHTAG)}) as hashtag from posts) group by hashtag"
)
def hashtag_counts(spark, sf):
    return reports.hashtag_counts(posts(spark, sf, heavy=True))


@query(
    f"with {duck.POSTS} select hashtag, count(*) as counts from "
    f"(select unnest({duck.found('content', P.LOOSE_HASHTAG_NAME, 1)}) as hashtag from posts) group by hashtag"
)
def hashtag_counts_loose(spark, sf):
    return reports.hashtag_counts(posts(spark, sf, heavy=True), P.LOOSE_HASHTAG_NAME)


@query(
    f"with {duck.POSTS} select hashtag, counts from (select hashtag, count(*) as counts from "
    f"(select unnest({duck.found('content', P.HASHTAG)}) as hashtag from posts) group by hashtag) "
    "where counts > 10 and regexp_matches(hashtag, '[A-Z]+')"
)
def hashtags_over_threshold(spark, sf):
    counts = reports.hashtag_counts(posts(spark, sf, heavy=True))
    return counts.filter((F.col("counts") > 10) & F.col("hashtag").rlike("[A-Z]+"))


@query(
    f"with {duck.POSTS}, c as (select hashtag, count(*) as counts from "
    f"(select unnest({duck.found('content', P.HASHTAG)}) as hashtag from posts) group by hashtag) "
    "select hashtag, counts, 'frequent' as part from c where counts > 20 union all "
    "(select hashtag, counts, 'capitalised' from c where regexp_matches(hashtag, '[A-Z]+') "
    "order by counts desc, hashtag limit 30 offset 23)"
)
def seed_hashtags(spark, sf):
    return reports.seed_hashtags(reports.hashtag_counts(posts(spark, sf, heavy=True)), over=20)


@query(
    f"with {duck.POSTS} select cast(cast(publish_date as date) as varchar) as publish_date, "
    "count(*) as num_of_tweets from posts where publish_date is not null group by 1"
)
def daily_counts(spark, sf):
    out = reports.daily_counts(posts(spark, sf))
    return out.select(text_of("publish_date"), "num_of_tweets")


@query(f"with {duck.POSTS} select author, count(*) as count from posts where author is not null "
       "group by author order by count desc, author limit 50")
def value_counts_author(spark, sf):
    return reports.value_counts(posts(spark, sf), "author", top=50)


@query(f"with {duck.POSTS} select account_category, count(*) as count from posts "
       "where account_category is not null group by 1")
def value_counts_category(spark, sf):
    return reports.value_counts(posts(spark, sf), "account_category")


@query(f"with {duck.POSTS} select {duck.count(duck.found('content', P.HASHTAG))} as hashtags_count, "
       "count(*) as count from posts group by 1")
def value_counts_hashtags(spark, sf):
    counted = posts(spark, sf, heavy=True).select(
        X.count_of(X.hashtags(F.col("content"))).alias("hashtags_count")
    )
    return reports.value_counts(counted, "hashtags_count")


@query(f"with {duck.POSTS} select {duck.count(duck.found('content', '!'))} as exclams_count, "
       "count(*) as count from posts group by 1")
def value_counts_exclamations(spark, sf):
    counted = posts(spark, sf, heavy=True).select(
        X.count_of(X.matches(F.col("content"), P.EXCLAMATION)).alias("exclams_count")
    )
    return reports.value_counts(counted, "exclams_count")


@query(f"with {duck.LABELLED} select target, round(count(*) / (select count(*) from labelled), 6) as share "
       "from labelled group by target")
def class_prior(spark, sf):
    out = reports.value_shares(labelled_posts(spark, sf), "target")
    return out.select("target", F.round("share", 6).alias("share"))


@query(f"with {duck.POSTS} select count(distinct author) as authors from posts")
def distinct_authors(spark, sf):
    return reports.distinct_authors(posts(spark, sf))


@query(f"with {duck.POSTS} select cast(min(publish_date) as varchar) as first_post, "
       "cast(max(publish_date) as varchar) as last_post from posts")
def ts_range(spark, sf):
    return reports.date_range(posts(spark, sf)).select(text_of("first_post"), text_of("last_post"))


@query(
    f"with {duck.FEATURES}, words as (select target, unnest({duck._space_terms('content_tokenized_lemma_joined')}) as term from features), "
    "c as (select cast(target as varchar) as class, term, count(*) as count from words group by all "
    "union all select 'all', term, count(*) from words group by term), "
    "r as (select *, cast(row_number() over (partition by class order by count desc, term) as int) as rank from c) "
    "select class, term, count, rank from r where rank <= 300"
)
def top_terms_per_class(spark, sf):
    return reports.class_terms(staged_features(spark, sf))


@query(
    f"with {duck.LABELLED} select concat('@', author) as username, content as tweet_text, "
    "cast(cast(publish_date as date) as varchar) as datetime, round(length(content) / (length(content) + 1500.0), 6) as pred_proba, "
    "case when target = 0 then 'No' else 'Yes' end as troll, "
    "case when target = 0 then 'turquoise' else 'salmon' end as color from labelled"
)
def explorer_extract(spark, sf):
    size = F.length("content")
    scored = labelled_posts(spark, sf).withColumn(
        "y_pred_proba", F.round(size / (size + F.lit(1500.0)), 6)
    )
    return reports.explorer_extract(scored).withColumn("datetime", F.col("datetime").cast("string"))


# ---- corpus ----------------------------------------------------------------


@query(f"with {duck.POSTS} select post_id, author, 1 as target from posts where account_category = 'RightTroll'")
def filter_category(spark, sf):
    return corpus.labelled_category(posts(spark, sf)).select("post_id", "author", "target")


@query(f"with {duck.POSTS} select post_id, author from posts where retweet = 0 and content not like 'RT %'")
def filter_retweets(spark, sf):
    kept = filters.without_prefix(filters.flagged_original(posts(spark, sf)))
    return kept.select("post_id", "author")


@query(f"with {duck.POSTS} select post_id as id, language from posts where language = 'English'")
def filter_language(spark, sf):
    kept = filters.in_language(posts(spark, sf)).select("post_id", "language")
    return filters.renamed(kept, ["id", "language"])


@query(f"with {duck.POSTS} select post_id, author, cast(publish_date as varchar) as publish_date from posts "
       f"where len({duck.found('content', P.EMOJI)}) > 0")
def filter_with_emojis(spark, sf):
    parsed = posts(spark, sf, heavy=True).withColumn("emojis", X.emojis(F.col("content")))
    return (
        parsed.filter(F.size("emojis") > 0)
        .drop("emojis", "content", "language", "account_category", "retweet")
        .withColumn("publish_date", F.col("publish_date").cast("string"))
    )


@query(f"with {duck.POSTS} select post_id, {duck.count(duck.found('content', P.HASHTAG))} as hashtags_count from posts "
       f"where len({duck.found('content', P.HASHTAG)}) > 0")
def filter_with_hashtags(spark, sf):
    counted = posts(spark, sf, heavy=True).select("post_id", X.hashtags(F.col("content")).alias("tags"))
    return counted.select("post_id", X.count_of(F.col("tags")).alias("hashtags_count")).filter("hashtags_count > 0")


@query(f"with {duck.POSTS} select post_id, author from posts where len({duck.found('content', P.HASHTAG)}) = 2 "
       "and author = 'src0'")
def filter_exact_values(spark, sf):
    tags = F.size(X.hashtags(F.col("content")))
    return filters.by_key(posts(spark, sf), "author", "src0").filter(tags == 2).select("post_id", "author")


@query(f"with {duck.POSTS} select post_id, author, content from posts where post_id = 7")
def key_lookup(spark, sf):
    return filters.by_key(posts(spark, sf), "post_id", 7).select("post_id", "author", "content")


@query(f"with {duck.POSTS} select post_id, cast(publish_date as varchar) as publish_date from posts")
def parse_timestamps(spark, sf):
    texts = posts(spark, sf).select("post_id", F.date_format("publish_date", "yyyy-MM-dd HH:mm:ss").alias("t"))
    return texts.select("post_id", X.parse_timestamp(F.col("t")).cast("string").alias("publish_date"))


@query(f"with {duck.POSTS} select author, content, cast(publish_date as varchar) as publish_date, "
       "cast(account_category = 'RightTroll' as int) as target from posts")
def csv_round_trip(spark, sf):
    """Two CSV folders, written and read again as one corpus."""
    folder = f"{checkpoint_dir(spark)}/csv-{uuid.uuid4().hex}"
    rows = labelled_posts(spark, sf).select("author", "content", "publish_date", "target")
    paths = [f"{folder}/class{k}" for k in (0, 1)]
    for k, path in enumerate(paths):
        write_csv(rows.filter(F.col("target") == k), path)
    return read_posts(spark, paths, multi_line=True).withColumn("publish_date", F.col("publish_date").cast("string"))


_FLAT = "translate(content, chr(10) || chr(13), '  ')"


@query(
    f"with {duck.LABELLED}, f as (select author, {_FLAT} as content, publish_date, post_id from labelled), "
    "r as (select *, row_number() over (partition by content order by "
    "author = (select min(author) from f) desc, publish_date, post_id) as rn from f) "
    "select author, content, cast(publish_date as varchar) as publish_date, 0 as target from r where rn = 1"
)
def control_corpus(spark, sf):
    """A folder of CSV files, read in splits; the copies in one named file win, then the order of the files."""
    folder = f"{checkpoint_dir(spark)}/control-{uuid.uuid4().hex}"
    rows = labelled_posts(spark, sf)
    crawled = rows.select(
        "post_id",
        F.col("author").alias("username"),
        F.translate("content", "\n\r", "  ").alias("tweet"),
        F.date_format("publish_date", "yyyy-MM-dd").alias("date"),
        F.date_format("publish_date", "HH:mm:ss").alias("time"),
    )
    least = rows.agg(F.min("author").alias("author")).scalar()
    order = ["date", "time", "post_id"]
    # the crawl of one account is one file
    write_csv(crawled.filter(F.col("username") == least).coalesce(1).sortWithinPartitions(*order), folder)
    (first,) = [
        r["path"].rsplit("/", 1)[1]
        for r in spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(folder).select("path").collect()
    ]
    others = crawled.filter(F.col("username") != least).orderBy(*order)
    write_csv(others, folder, mode="append")
    posts_ = stage_table(read_control(spark, folder, first), "control")
    out = corpus.control_posts(posts_, CONTROL_ORDER)
    return out.withColumn("publish_date", F.col("publish_date").cast("string"))


_TRIM = (
    "trimmed as (select post_id, author, content, publish_date, target from (select *, row_number() over "
    "(partition by content order by publish_date, post_id) as rn from labelled where retweet = 0 "
    "and content not like 'RT %' and language = 'English' and target = {t}) where rn = 1)"
)


def _trimmed(spark, sf, target):
    return corpus.trim_posts(
        labelled_posts(spark, sf).filter(F.col("target") == target),
        order=["publish_date", "post_id"],
        keep=["post_id"],
    )


@query(f"with {duck.LABELLED}, {_TRIM.format(t=1)} select post_id, author, content, "
       "cast(publish_date as varchar) as publish_date, target from trimmed")
def trim_posts(spark, sf):
    return _trimmed(spark, sf, 1).withColumn("publish_date", F.col("publish_date").cast("string"))


_TRIM_STEPS = (
    f"with {duck.POSTS}, s as (select content, retweet = 0 as a, retweet = 0 and content not like 'RT %' as b, "
    "retweet = 0 and content not like 'RT %' and language = 'English' as c from posts), "
    "n as (select count(*) as n0, count_if(a) as n1, count_if(b) as n2, count_if(c) as n3, "
    "count(distinct case when c then content end) as n4 from s) "
    "select cast(step as int) as step, stage, cast(rows as bigint) as rows, cast(filtered_out as bigint) as filtered_out from ("
    "select 0 as step, 'input' as stage, n0 as rows, 0 as filtered_out from n union all "
    "select 1, 'retweet_flag', n1, n0 - n1 from n union all select 2, 'retweet_prefix', n2, n1 - n2 from n "
    "union all select 3, 'language', n3, n2 - n3 from n union all select 4, 'distinct_text', n4, n3 - n4 from n)"
)


@query(_TRIM_STEPS)
def trim_step_counts(spark, sf):
    return corpus.trim_step_counts(posts(spark, sf))


@query(_TRIM_STEPS)
def trim_steps_written(spark, sf):
    """The same counts, taken by the pass that trims the posts."""
    path = f"{checkpoint_dir(spark)}/trimmed-{uuid.uuid4().hex}"
    return corpus.trim_posts_counted(labelled_posts(spark, sf), ["publish_date", "post_id"], path)[1]


_MONTHS = (
    f"with {duck.POSTS}, m as (select *, strftime(publish_date, '%Y-%m') as month from posts), "
    f"t as (select month, unnest({duck.found('content', P.HASHTAG)}) as hashtag from m), "
    "c as (select month, hashtag, count(*) as n from t group by all), "
    "k as (select month, max(n) as most from c group by month) "
)


@query(
    f"{_MONTHS} select month, count(*) as posts, true as authors_within, true as texts_within, "
    "any_value(most) as most_frequent from m left join k using (month) group by month"
)
def monthly_sketches(spark, sf):
    """Months merged from days: estimates lie within four standard errors of the exact counts."""
    rows = posts(spark, sf, heavy=True)
    days = stage_table(sketches.daily_sketches(rows), "sketches")
    month = F.date_format("day", "yyyy-MM").alias("month")
    merged = sketches.in_range(days, [month], top=1)
    exact = rows.groupBy(F.date_format("publish_date", "yyyy-MM").alias("month")).agg(
        F.count_distinct("author").alias("exact_authors"), F.count_distinct(F.sha2("content", 256)).alias("exact_texts")
    )

    def within(name: str):
        off = F.abs(F.col(name) - F.col(f"exact_{name}"))
        return (off <= 4 * sketches.relative_error() * F.col(f"exact_{name}") + 0.5).alias(f"{name}_within")

    most = F.try_element_at("hashtags", F.lit(1))["count"].alias("most_frequent")
    return merged.join(exact, "month").select("month", "posts", within("authors"), within("texts"), most)


@query("select doc_id, source from (select *, row_number() over (partition by text order by doc_id) as rn "
       "from documents) where rn = 1")
def dedup_first(spark, sf):
    documents = table(spark, sf, "documents").select("doc_id", "source", "text")
    return first_per_key(documents, ["text"], ["doc_id"]).select("doc_id", "source")


def _landings(rows: DataFrame, key: str, parts: int = 3) -> list[DataFrame]:
    """The rows in ranges of the key, as they would land one after another."""
    low, high = rows.agg(F.min(key), F.max(key)).first()
    place = F.least(F.floor((F.col(key) - low) * parts / (high - low + 1)), F.lit(parts - 1))
    return [rows.filter(place == i) for i in range(parts)]


@query("select doc_id, source from (select *, row_number() over (partition by text order by doc_id) as rn "
       "from documents) where rn = 1")
def first_copies_streamed(spark, sf):
    """First copies of texts that land in three runs, by an index of digests."""
    rows = table(spark, sf, "documents").select("doc_id", "source", "text")
    folder = f"{checkpoint_dir(spark)}/firsts-{uuid.uuid4().hex}"
    for part in _landings(rows, "doc_id"):
        part.write.mode("append").parquet(f"{folder}/landing")
        arrived = stream_files(spark, f"{folder}/landing", rows.schema, files_per_trigger=10_000)
        target = first_copies_available(arrived, folder, "text", ["doc_id"])
    return spark.read.parquet(target).select("doc_id", "source")


_CAPS = [("#topic0", 7), ("#Topic1", 40), ("#topic2", 10**6), ("#nosuchtag", 5)]


@query(
    f"with {duck.POSTS}, t as (select distinct post_id, lower(unnest({duck.found('content', P.HASHTAG)})) as tag from posts), "
    "s(seed, cap) as (values " + ", ".join(f"('{tag}', {cap})" for tag, cap in _CAPS) + "), "
    "h as (select seed, cap, post_id, row_number() over (partition by seed order by post_id) as r "
    "from t join s on lower(seed) = tag) select seed, post_id from h where r <= cap"
)
def collected_in_runs(spark, sf):
    """So many posts per seed, from three runs over what has landed; each run goes on where the last one stopped."""
    rows = posts(spark, sf).select("post_id", "author", "content", "publish_date")
    seeds = spark.createDataFrame(_CAPS, "seed string, cap long")
    folder = f"{checkpoint_dir(spark)}/collected-{uuid.uuid4().hex}"
    for part in _landings(rows, "post_id"):
        part.write.mode("append").parquet(f"{folder}/landing")
        arrived = stream_files(spark, f"{folder}/landing", rows.schema, files_per_trigger=10_000)
        target = collect_available(arrived, seeds, folder)
    return spark.read.parquet(target).select("seed", "post_id")


@query(f"select doc_id, source from documents order by {duck.hash_order('doc_id')} "
       "limit (select cast(floor(count(*) / 4) as bigint) from documents)")
def exact_sample(spark, sf):
    documents = table(spark, sf, "documents").select("doc_id", "source")
    return sampling.sample_exact(documents, lambda n: F.floor(n / 4), "doc_id", SEED)


@query(
    "with p as (select *, row_number() over (order by " + duck.hash_order("doc_id") + ") as r "
    "from labels where toxic = 1), n as (select count(*) as c from labels where toxic = 0) "
    "select doc_id, quality, toxic from labels where toxic = 0 union all "
    "select doc_id, quality, toxic from p where r <= (select round_even(c * 0.1, 0) from n)"
)
def rebalance(spark, sf):
    return sampling.rebalance(table(spark, sf, "labels"), 0.1, "doc_id", SEED, label="toxic")


_SPLIT = (
    "with r as (select *, row_number() over (order by {h}) as r, count(*) over () as n from documents), "
    "s as (select *, ceil(n * cast({t} as double)) as t from r), v as (select *, ceil((n - t) * cast({v} as double)) as v from s) "
    "select doc_id, case when r <= t then 'test' when r <= t + v then 'validation' else 'train' end as split from v"
)


@query(_SPLIT.format(h=duck.hash_order("doc_id"), t=0.1, v=0.2))
def three_way_split(spark, sf):
    documents = table(spark, sf, "documents").select("doc_id")
    return sampling.label_split(documents, 0.1, 0.2, "doc_id", SEED)


@query(_SPLIT.format(h=duck.hash_order("doc_id"), t=0.2, v=0.0))
def two_way_split(spark, sf):
    train, test = sampling.two_way_split(
        table(spark, sf, "documents").select("doc_id"), 0.2, "doc_id", SEED
    )
    return train.withColumn("split", F.lit("train")).unionByName(
        test.withColumn("split", F.lit("test"))
    )


@query(f"select doc_id, toxic, cast(ntile(3) over (partition by toxic order by {duck.hash_order('doc_id')}) - 1 as int) as fold from labels")
def fold_assignment(spark, sf):
    labels = table(spark, sf, "labels").select("doc_id", "toxic")
    return sampling.assign_folds(labels, 3, "doc_id", SEED, "toxic")


@query(f"with {duck.LABELLED} select post_id, author, target, case when target = 1 then language end as language from labelled")
def union_labelled(spark, sf):
    both = labelled_posts(spark, sf)
    one = both.filter("target = 1").select("post_id", "author", "target", "language")
    other = both.filter("target = 0").select("post_id", "author", "target")
    return corpus.union_all(one, other)


@query(
    f"with {duck.LABELLED}, {_TRIM.format(t=1)}, {_TRIM.format(t=0).replace('trimmed', 'control', 1)}, "
    f"s as (select *, row_number() over (order by {duck.hash_order('post_id')}) as r from trimmed) "
    "select post_id, author, target from s where r <= (select count(*) from control) "
    "union all select post_id, author, target from control"
)
def combined_corpus(spark, sf):
    one, other = _trimmed(spark, sf, 1), _trimmed(spark, sf, 0)
    return corpus.combined_corpus(one, other, "post_id", SEED).select("post_id", "author", "target")


_SEEDS = [("#Topic0", 40), ("#Topic3", 25), ("#the", 30), ("", 200)]


def _seed_sql(seeds: list[tuple[str, int]]) -> str:
    return (
        f"with {duck.POSTS}, w as (select * from posts where publish_date >= timestamp '2015-01-01' and "
        "publish_date < timestamp '2018-01-01' and language = 'English' and retweet = 0 and content not like 'RT %'), "
        f"t as (select post_id, publish_date, unnest(list_append(list_distinct(list_transform({duck.found('content', P.HASHTAG)}, "
        "lambda x: lower(x))), '')) as tag from w), seeds as (select * from (values "
        + ", ".join(f"('{s}', '{s.lower()}', {c})" for s, c in seeds)
        + ") v(seed, tag, cap)), r as (select seed, cap, post_id, cast(row_number() over (partition by seed order by "
        "publish_date desc, post_id desc) as int) as rank from t join seeds using (tag)) "
        "select seed, post_id, rank from r where rank <= cap"
    )


@query(_seed_sql(_SEEDS))
def seed_collection_capped(spark, sf):
    return collect_by_seed(posts(spark, sf, heavy=True), _SEEDS)


_LARGE_SEEDS = [("#Topic1", 1500), ("#src0", 3000), ("", 5000)]


@query(_seed_sql(_LARGE_SEEDS))
def seed_collection_large(spark, sf):
    return collect_by_seed(posts(spark, sf, heavy=True), _LARGE_SEEDS)


@query("select event_id, user_id, event_type, value from events where event_id > 99")
def incremental_since(spark, sf):
    events = table(spark, sf, "events").select("event_id", "user_id", "event_type", "value")
    return filters.newer_than(events, "event_id", since=99)


# ---- text functions --------------------------------------------------------


def _list_query(name: str, column_fn, duck_list: str) -> None:
    @query(
        f"with {duck.POSTS} select post_id, {duck.joined('l', '|')} as found, {duck.count('l')} as found_count "
        f"from (select post_id, {duck_list} as l from posts)",
        name=name,
    )
    def run(spark, sf):
        parsed = posts(spark, sf, heavy=True).select("post_id", column_fn(F.col("content")).alias("l"))
        return parsed.select(
            "post_id",
            F.array_join("l", "|").alias("found"),
            X.count_of(F.col("l")).alias("found_count"),
        )


_list_query("url_list", X.urls, duck.found("content", P.URL))
_list_query("mention_list", X.mentions, duck.found("content", P.MENTION))
_list_query("hashtag_list", X.hashtags, duck.found("content", P.HASHTAG))
_list_query("reserved_list", X.reserved_words, duck.found("content", duck.RESERVED))
_list_query("emoji_list", X.emojis, duck.found("content", P.EMOJI))
_list_query("smiley_list", X.smileys, duck.found(duck.without("content", P.URL), P.SMILEY))
_list_query("number_list", X.numbers, duck.found("content", P.NUMBER))
_list_query(
    "hashtag_list_loose",
    lambda c: X.matches(c, P.LOOSE_HASHTAG),
    duck.found("content", P.LOOSE_HASHTAG, 1),
)
_list_query(
    "link_list_loose", lambda c: X.matches(c, P.LOOSE_LINK), duck.found("content", P.LOOSE_LINK, 1)
)
_list_query(
    "mention_list_loose",
    lambda c: X.matches(c, P.LOOSE_MENTION),
    duck.found("content", P.LOOSE_MENTION, 1),
)


@query(f"with {duck.POSTS} select post_id, {duck.without('content', P.PICTURE)} as content, "
       f"{duck.joined(duck.found('content', P.PICTURE), '|')} as pics from posts")
def pic_strip(spark, sf):
    c = F.col("content")
    return posts(spark, sf, heavy=True).select(
        "post_id",
        X.without(c, P.PICTURE).alias("content"),
        F.array_join(X.pictures(c), "|").alias("pics"),
    )


def _punctuation_query(name: str, source: str, duck_text: str) -> None:
    @query(
        f"with {duck.LABELLED} select post_id, {duck.count(duck.found('c', '!'))} as exclams_count, "
        f"{duck.count(duck.found('c', '[?]'))} as ques_marks_count, "
        f"{duck.count(duck.found('c', '[$]'))} as dollar_marks_count "
        f"from (select post_id, {duck_text} as c from labelled)",
        name=name,
    )
    def run(spark, sf):
        features = post_features(labelled_posts(spark, sf, heavy=True), source, keep=["post_id"])
        return features.select("post_id", "exclams_count", "ques_marks_count", "dollar_marks_count")


_punctuation_query("punct_counts_raw", "raw", "content")
_punctuation_query("punct_counts_clean", "clean", duck.clean("content"))


def _cleaned(spark, sf):
    return with_clean_text(posts(spark, sf, heavy=True), "content", "c")


@query(f"with {duck.POSTS} select post_id, {duck.clean('content')} as content_clean from posts")
def clean_text(spark, sf):
    return _cleaned(spark, sf).select("post_id", F.col("c").alias("content_clean"))


@query(f"with {duck.POSTS} select post_id, round({duck.pct_upper('c')}, 6) as pct_upper, "
       f"round({duck.pct_upper('c')}, 4) as shown from (select post_id, {duck.clean('content')} as c from posts)")
def pct_upper(spark, sf):
    shares = _cleaned(spark, sf).select("post_id", X.pct_upper(F.col("c")).alias("p"))
    return shares.select(
        "post_id", F.round("p", 6).alias("pct_upper"), X.fixed_decimals(F.col("p"), 4).cast("double").alias("shown")
    )


@query(f"with {duck.POSTS} select post_id, {duck.count(duck.tokens('c'))} as word_count "
       f"from (select post_id, {duck.clean('content')} as c from posts)")
def word_count(spark, sf):
    return _cleaned(spark, sf).select("post_id", X.word_count(F.col("c")).alias("word_count"))


_TOKENS = (
    f"tokens as (select post_id, {duck.drop_words(duck.tokens('lower(c)'), P.ENGLISH_STOP_WORDS)} as w "
    f"from (select post_id, {duck.clean('content')} as c from posts))"
)


def _content_tokens(spark, sf):
    return _cleaned(spark, sf).select("post_id", X.content_tokens(F.col("c")).alias("w"))


@query(f"with {duck.POSTS}, {_TOKENS} select post_id, {duck.joined('w')} as tokens from tokens")
def tokens_nostop(spark, sf):
    return _content_tokens(spark, sf).select("post_id", X.joined(F.col("w")).alias("tokens"))


_LEMMATISED = (
    f"with {duck.POSTS}, {_TOKENS}, {duck.lemmas('tokens')} "
    "select t.post_id, coalesce(lemmas, '') as lemmas from tokens t left join lemmatised l on t.post_id = l.post_id"
)


def _dictionary(words: DataFrame) -> DataFrame:
    return lemmas_from_corpus(words.select(F.explode("w").alias("token")))


@query(_LEMMATISED)
def lemma_lookup(spark, sf):
    words = stage_table(_content_tokens(spark, sf), "tokens")
    dictionary = stage_table(_dictionary(words), "dictionary")
    replaced = lemmatize_by_join(words, "post_id", "w", dictionary)
    return replaced.select("post_id", X.joined(F.col("w")).alias("lemmas"))


@query(_LEMMATISED)
def lemma_join(spark, sf):
    words = stage_table(_content_tokens(spark, sf), "tokens")
    replaced = lemmatize_by_join(words, "post_id", "w", _dictionary(words))
    return replaced.select("post_id", X.joined(F.col("w")).alias("lemmas"))


@query(
    f"with {duck.POSTS}, {_TOKENS} select case substr(tag, 1, 1) when 'J' then 'a' when 'V' then 'v' "
    "when 'N' then 'n' when 'R' then 'r' end as pos, count(*) as words from "
    "(select upper(unnest(w)) as tag from tokens) group by 1"
)
def wordnet_pos(spark, sf):
    tags = exploded(_content_tokens(spark, sf), F.col("w"), "tag")
    return tags.groupBy(X.wordnet_pos(F.upper("tag")).alias("pos")).agg(F.count("*").alias("words"))


@query(
    f"with {duck.POSTS}, s as (select post_id, string_split_regex(content, {duck.q(f'[{P.SPACE}]+')}) as w from posts) "
    f"select post_id, {duck.count('list_filter(w, lambda x: x in ' + duck.word_list(P.HAPPY_EMOTICONS) + ')')} as happy, "
    f"{duck.count('list_filter(w, lambda x: x in ' + duck.word_list(P.SAD_EMOTICONS) + ')')} as sad from s"
)
def emoticon_mood(spark, sf):
    c = F.col("content")
    return posts(spark, sf, heavy=True).select(
        "post_id",
        X.emoticon_count(c, P.HAPPY_EMOTICONS).alias("happy"),
        X.emoticon_count(c, P.SAD_EMOTICONS).alias("sad"),
    )


@query(
    f"with {duck.POSTS} select post_id, cast(publish_date as varchar) as publish_date, "
    "cast(cast(publish_date as date) as varchar) as day from posts"
)
def parse_dates(spark, sf):
    parts = posts(spark, sf).select(
        "post_id",
        F.date_format("publish_date", "yyyy-MM-dd").alias("date"),
        F.date_format("publish_date", "HH:mm:ss").alias("time"),
    )
    parsed = parts.withColumn("publish_date", X.timestamp_of(F.col("date"), F.col("time")))
    return parsed.select(
        "post_id", text_of("publish_date"), F.to_date("publish_date").cast("string").alias("day")
    )


@query(
    f"with {duck.FEATURES} select post_id, author, content, cast(publish_date as varchar) as publish_date, target, "
    + ", ".join("round(pct_upper, 6) as pct_upper" if c == "pct_upper" else c for c in FEATURE_COLUMNS[4:])
    + " from features"
)
def feature_table(spark, sf):
    features = lemmatised_features(spark, sf)
    return features.withColumn("publish_date", F.col("publish_date").cast("string")).withColumn(
        "pct_upper", F.round("pct_upper", 6)
    )


# ---- vectors ---------------------------------------------------------------


@query(
    f"with {duck.FEATURES}, {duck.terms([Block('words', WORDS.column, 0, True, 3, P.VECTORISER_STOP_WORDS)])}, "
    f"{duck.vocabulary([WORDS])} select term, cf, df from counts"
)
def ngram_counts(spark, sf):
    return term_counts(staged_features(spark, sf), [WORDS]).select("term", "cf", "df")


@query(f"with {duck.FEATURES}, {duck.terms(BLOCKS)}, {duck.vocabulary(BLOCKS)} "
       "select block, idx, term, cf, df from vocab")
def vocab_top300(spark, sf):
    return vocabulary(staged_features(spark, sf))


_COUNTED = Block(
    "words",
    WORDS.column,
    100,
    True,
    3,
    [
        w
        for w in """i me my myself we our ours ourselves you your yours yourself yourselves he him his
        himself she her hers herself it its itself they them their theirs themselves what which who
        whom this that these those am is are was were be been being have has had having do does did
        doing a an the and but if or because as until while of at by for with about against between
        into through during before after above below to from up down in out on off over under again
        further then once here there when where why how all any both each few more most other some
        such no nor not only own same so than too very can will just now""".split()
    ],
)


@query(
    f"with {duck.FEATURES}, {duck.terms([_COUNTED])}, {duck.vocabulary([_COUNTED])} "
    "select post_id, block, term, cast(tf as double) as weight from tf join vocab using (block, term)"
)
def count_vector(spark, sf):
    features = staged_features(spark, sf)
    fitted = fit_vectors(features, [_COUNTED], numerics=[], weighting="count")
    return long_form(fitted.transform(features), "post_id", fitted)


def _tfidf_query(name: str, block: Block) -> None:
    @query(
        f"with {duck.FEATURES}, {duck.terms([block])}, {duck.vocabulary([block])}, {duck.TFIDF} "
        "select post_id, block, term, round(weight, 6) as weight from tfidf",
        name=name,
    )
    def run(spark, sf):
        features = staged_features(spark, sf)
        fitted = fit_vectors(features, [block], numerics=[])
        out = long_form(fitted.transform(features), "post_id", fitted)
        return out.withColumn("weight", F.round("weight", 6))


_tfidf_query("tfidf_words", WORDS)
_tfidf_query("tfidf_emojis", EMOJIS)
_tfidf_query("tfidf_hashtags", HASHTAGS)


def _duck_scaled(c: str) -> str:
    return (
        f"case when stddev_pop({c}) over () = 0 then 0.0 else "
        f"({c} - avg({c}) over ()) / stddev_pop({c}) over () end"
    )


@query(
    f"with {duck.FEATURES} select post_id, "
    + ", ".join(f"round({_duck_scaled(c)}, 6) as {c}" for c in NUMERIC_FEATURES)
    + " from features"
)
def scaled_numerics(spark, sf):
    features = staged_features(spark, sf)
    scaler, _ = fit_scaler(features)
    return features.select(
        "post_id",
        *[F.round(v, 6).alias(c) for c, v in zip(NUMERIC_FEATURES, scaler.scaled())],
    )


@query(
    f"with {duck.FEATURES}, {duck.terms(BLOCKS)}, {duck.vocabulary(BLOCKS)}, {duck.TFIDF}, scaled as (select post_id, "
    + ", ".join(f"{_duck_scaled(c)} as {c}" for c in NUMERIC_FEATURES)
    + " from features) select post_id, block, term, round(weight, 6) as weight from tfidf union all "
    "select post_id, 'numerics', name, round(value, 6) from (unpivot scaled on "
    + ", ".join(NUMERIC_FEATURES)
    + " into name name value value) where value <> 0"
)
def feature_long(spark, sf):
    features = staged_features(spark, sf)
    fitted = fit_vectors(features)
    out = long_form(fitted.transform(features), "post_id", fitted)
    return out.withColumn("weight", F.round("weight", 6))


_PARTS = (
    "numbered as (select post_id, target, row_number() over (order by " + duck.hash_order("post_id") + ") as r, "
    "count(*) over () as n from features), "
    "sized as (select *, ceil(n * cast(0.1 as double)) as t from numbered), "
    "dealt as (select post_id, target, r, case when r <= t then 'test' "
    "when r <= t + ceil((n - t) * cast(0.2 as double)) then 'validation' else 'train' end as split from sized), "
    "positives as (select *, row_number() over (partition by split order by r) as k from dealt where target = 1), "
    "negatives as (select split, round_even(count(*) * 0.1, 0) as wanted from dealt where target = 0 group by split), "
    "parts as (select post_id, split from dealt where split = 'train' or target = 0 union all "
    "select post_id, split from positives join negatives using (split) where split <> 'train' and k <= wanted)"
)


def _of_train(c: str) -> str:
    inside = f"from features join parts using (post_id) where split = 'train'"
    return (
        f"case when (select stddev_pop({c}) {inside}) = 0 then 0.0 "
        f"else ({c} - (select avg({c}) {inside})) / (select stddev_pop({c}) {inside}) end"
    )


@query(
    f"with {duck.FEATURES}, {_PARTS}, {duck.terms(BLOCKS)}, "
    + duck.vocabulary(BLOCKS).replace(
        "count(*) as df from tf group by all",
        "count(*) as df from tf join parts using (post_id) where split = 'train' group by all",
    )
    + ", "
    + duck.TFIDF.replace("from features", "from parts where split = 'train'")
    + ", scaled as (select post_id, "
    + ", ".join(f"{_of_train(c)} as {c}" for c in NUMERIC_FEATURES)
    + " from features), long as (select post_id, block, term, weight from tfidf union all "
    "select post_id, 'numerics', name, value from (unpivot scaled on "
    + ", ".join(NUMERIC_FEATURES)
    + " into name name value value) where value <> 0) "
    "select post_id, split, block, term, round(weight, 6) as weight from long join parts using (post_id)"
)
def held_out_long(spark, sf):
    """Fitted on train; train, test and validation transformed, the last two with their classes rebalanced."""
    train, *others = sampling.three_way_split(staged_features(spark, sf), 0.1, 0.2, "post_id", SEED)
    parts = {"train": train} | {
        name: sampling.rebalance(part, 0.1, "post_id", SEED)
        for name, part in zip(("test", "validation"), others, strict=True)
    }
    fitted = fit_vectors(train)
    longs = [
        long_form(fitted.transform(part), "post_id", fitted).withColumn("split", F.lit(name))
        for name, part in parts.items()
    ]
    return corpus.union_all(*longs).withColumn("weight", F.round("weight", 6))


# ---- metrics and neighbours ------------------------------------------------

_PREDICTED = (
    "predicted as (select doc_id, toxic as target, case when n_chars > 1500 then 1 else 0 end as prediction "
    "from labels join documents using (doc_id))"
)


def _predicted(spark, sf):
    joined = table(spark, sf, "labels").join(table(spark, sf, "documents"), "doc_id")
    return joined.select(
        "doc_id",
        F.col("toxic").alias("target"),
        (F.col("n_chars") > 1500).cast("int").alias("prediction"),
    )


@query(f"with {_PREDICTED} select target, prediction, count(*) as rows from predicted group by all")
def confusion(spark, sf):
    return metrics.confusion(_predicted(spark, sf), "target", "prediction")


@query(
    f"with {_PREDICTED} select target, prediction, count(*) as rows, "
    "round(count(*) / sum(count(*)) over (partition by target), 6) as share from predicted group by target, prediction"
)
def confusion_normalised(spark, sf):
    out = metrics.confusion_normalised(_predicted(spark, sf), "target", "prediction")
    return out.withColumn("share", F.round("share", 6))


@query(
    f"with {_PREDICTED}, c as (select count_if(target = 1 and prediction = 1) as tp, "
    "count_if(target = 0 and prediction = 1) as fp, count_if(target = 1 and prediction = 0) as fn, "
    "count_if(target = prediction) as r, count(*) as n from predicted) "
    "select round(r / n, 6) as accuracy, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) as recall_score, "
    "round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) as f1_score from c"
)
def accuracy_recall_f1(spark, sf):
    out = metrics.scores(_predicted(spark, sf), "target", "prediction")
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


# fixed predictors: their comparison has an oracle
_RULES = {
    "long": "n_chars > 1500",
    "poor": "quality = 0",
    "poor or short": "quality = 0 or n_chars < 400",
    "all": "true",
}
_RULE_SCORES = (
    "with j as (select toxic as t, n_chars, quality from labels join documents using (doc_id)), p as ("
    + " union all ".join(
        f"select {i} as position, '{name}' as estimator, t, coalesce(({sql})::int, 0) as p from j"
        for i, (name, sql) in enumerate(_RULES.items())
    )
    + "), c as (select position, estimator, count_if(t = 1 and p = 1) as tp, count_if(t = 0 and p = 1) as fp, "
    "count_if(t = 1 and p = 0) as fn from p group by all), rules as (select position, estimator, "
    "round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) as f1_score, "
    "round(coalesce(tp / nullif(tp + fn, 0), 0), 6) as recall_score from c)"
)


def _rule_scores(spark, sf):
    joined = table(spark, sf, "labels").join(table(spark, sf, "documents"), "doc_id")
    scored = {
        name: joined.select(
            F.col("toxic").alias("target"), F.coalesce(F.expr(rule).cast("int"), F.lit(0)).alias("prediction")
        )
        for name, rule in _RULES.items()
    }
    out = metrics.comparison(scored, "target", "prediction")
    return out.select("estimator", *[F.round(c, 6).alias(c) for c in ("f1_score", "recall_score")])


@query(f"{_RULE_SCORES} select estimator, f1_score, recall_score from rules")
def rule_comparison(spark, sf):
    return _rule_scores(spark, sf)


@query(f"{_RULE_SCORES} select estimator, f1_score, recall_score from rules order by recall_score desc, position limit 1")
def best_rule(spark, sf):
    position = F.array_position(F.lit(list(_RULES)), F.col("estimator"))
    best = metrics.best_by_recall(_rule_scores(spark, sf).withColumn("position", position), "position")
    return best.drop("position")


_NEIGHBOURS = """
pairs as (
 select a.vec_id as query_id, a.label as truth, b.vec_id as train_id, b.label as label,
  sqrt(list_sum(list_transform(list_zip(a.embedding, b.embedding),
   lambda p: (cast(p[1] as double) - cast(p[2] as double)) * (cast(p[1] as double) - cast(p[2] as double))))) as distance
 from embeddings a join embeddings b on a.vec_id <> b.vec_id),
neighbours as (
 select *, row_number() over (partition by query_id order by distance, train_id) as rank from pairs
 qualify rank <= {k})"""


def _neighbours(spark, sf, k):
    vectors = spread(table(spark, sf, "embeddings"), "vec_id")
    return knn.nearest(
        vectors, vectors, k, key="vec_id", vector="embedding", label="label", skip_self=True
    )


@query(
    f"with {_NEIGHBOURS.format(k=5)}, votes as (select query_id, label, count(*) as n from neighbours group by all) "
    "select query_id, cast(label as int) as prediction from votes "
    "qualify row_number() over (partition by query_id order by n desc, label) = 1"
)
def knn_vote(spark, sf):
    return knn.vote(_neighbours(spark, sf, 5))


_SWEEP = (
    f"with {_NEIGHBOURS.format(k=35)}, ks as (select cast(unnest(range(1, 36)) as int) as k), "
    "votes as (select query_id, truth, k, label, count(*) as n from neighbours join ks on rank <= k group by all), "
    "best as (select * from votes qualify row_number() over (partition by query_id, k order by n desc, label) = 1), "
    "swept as (select k, round(count_if(label = truth) / count(*), 6) as accuracy, "
    "round(count_if(label = truth and truth = 1) / nullif(count_if(truth = 1), 0), 6) as recall from best group by k)"
)


@query(
    f"with {_NEIGHBOURS.format(k=10)} select count(distinct query_id) as queries, count(*) as wanted, "
    "true as recall_of_90_percent, true as distances_exact from neighbours"
)
def knn_approximate(spark, sf):
    """Neighbours by projections, measured against the exact ones."""
    vectors = spread(table(spark, sf, "embeddings"), "vec_id")
    near = lsh.approximate_nearest(
        vectors, vectors, 10, key="vec_id", vector="embedding", skip_self=True, bucket_rows=64
    )
    near, exact = stage_table(near, "approximate"), stage_table(_neighbours(spark, sf, 10), "exact")
    both = near.join(exact.withColumnRenamed("distance", "d").drop("rank", "label"), ["query_id", "train_id"])
    off = both.agg(F.max(F.abs(F.col("distance") - F.col("d"))).alias("off")).scalar()
    return lsh.recall(near, exact).select(
        "queries", "wanted", (F.col("found") >= 0.9 * F.col("wanted")).alias("recall_of_90_percent"), (off < 1e-9).alias("distances_exact")
    )


def _swept(spark, sf):
    votes = knn.votes_per_k(_neighbours(spark, sf, 35), 35)
    out = knn.sweep(votes, table(spark, sf, "embeddings"), key="vec_id")
    return out.select("k", F.round("accuracy", 6).alias("accuracy"), F.round("recall", 6).alias("recall"))


@query(f"{_SWEEP} select k, accuracy, recall from swept")
def knn_k_sweep(spark, sf):
    return _swept(spark, sf)


@query(f"{_SWEEP} select k, accuracy, recall from swept order by recall desc, k limit 1")
def knn_best_k(spark, sf):
    return knn.best_k(_swept(spark, sf), "recall")


# ---- models (trained: no SQL equivalent) -----------------------------------

_fitted: dict[tuple, tuple] = {}


def _split_features(spark, sf):
    """Fitted vectors and staged (train, test, validation); once per session and folder."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _fitted:
        features = staged_features(spark, sf)
        train, test, valid = sampling.three_way_split(features, 0.1, 0.2, "post_id", SEED)
        test = sampling.rebalance(test, 0.1, "post_id", SEED)
        valid = sampling.rebalance(valid, 0.1, "post_id", SEED)
        vectors, parts = combined_features(train, test, valid)
        columns = ["post_id", "target", "features"]
        staged = [sized(stage_table(part.select(*columns), "vectors")) for part in parts]
        _fitted[key] = (vectors, *staged)
    return _fitted[key]


_models: dict[tuple, object] = {}


def _model(spark, sf, name, estimator_of):
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _models:
        _, train, _, _ = _split_features(spark, sf)
        _models[key] = estimator_of(train).fit(train)
    return _models[key]


def _model_query(name: str, estimator_of) -> None:
    @query(name=name)
    def run(spark, sf):
        _, _, test, _ = _split_features(spark, sf)
        scored = models.with_probability(_model(spark, sf, name, estimator_of).transform(test))
        return scored.select("post_id", "target", "prediction", "y_pred_proba")


_model_query("logreg", lambda train: models.logistic_regression(train.count()))
_model_query("dtree", lambda train: models.decision_tree(5))
_model_query("rforest", lambda train: models.random_forest(depth=6))
_model_query("dtree_unlimited", lambda train: models.histogram_forest(forests.decision_tree()))
_model_query("rforest_untuned", lambda train: models.histogram_forest(forests.Setting()))
_model_query("rforest_tuned_1", lambda train: models.histogram_forest(forests.TUNED_FORESTS[0]))
_model_query("rforest_tuned", lambda train: models.histogram_forest(forests.TUNED_FORESTS[1]))
_model_query("rforest_tuned_3", lambda train: models.histogram_forest(forests.TUNED_FORESTS[2]))
_model_query("gbt", lambda train: models.boosted_trees())
_model_query("adaboost", lambda train: AdaBoost())
_model_query("adaboost_by_class", lambda train: AdaBoost(algorithm="SAMME"))


@query()
def combined_matrix(spark, sf):
    vectors, train, _, _ = _split_features(spark, sf)
    return train.select("post_id", "target", vector_to_array("features").alias("features"))


@query()
def importances(spark, sf):
    vectors, train, _, _ = _split_features(spark, sf)
    model = _model(spark, sf, "rforest", lambda train: models.random_forest(depth=6))
    return models.importances(model, vectors.names, train, top=10)


@query()
def coefficients(spark, sf):
    vectors, train, _, _ = _split_features(spark, sf)
    model = _model(spark, sf, "logreg", lambda train: models.logistic_regression(train.count()))
    return models.coefficients(model, vectors.names, train)


def _dense(df):
    return df.select("post_id", "target", vector_to_array("features").alias("vector"))


def _knn_predictions(train, test):
    near = knn.nearest(_dense(train), _dense(test), 5, key="post_id", label="target")
    return knn.vote(near).join(test.select(F.col("post_id").alias("query_id"), "target"), "query_id")


@query()
def model_comparison(spark, sf):
    _, train, test, _ = _split_features(spark, sf)
    estimators = models.default_estimators(train.count())
    others = {"k nearest neighbours": _knn_predictions(train, test)}
    return models.bake_off(train, test, estimators, others)[1]


@query()
def best_model(spark, sf):
    names = [*models.default_estimators(1), "k nearest neighbours"]
    order = F.array_position(F.lit(names), F.col("estimator"))
    table = model_comparison(spark, sf).withColumn("position", order)
    return metrics.best_by_recall(table, "position")


_folds: dict[tuple, selection.Folded] = {}


def _folded(spark, sf, folds):
    key = (spark.sparkContext.applicationId, sf, folds)
    if key not in _folds:
        _, train, _, _ = _split_features(spark, sf)
        _folds[key] = selection.folded(train, "post_id", folds)
    return _folds[key]


@query()
def grid_search(spark, sf):
    return selection.forest_search(_folded(spark, sf, 3), forests.settings_of())


@query()
def grid_best(spark, sf):
    """The best forest of the grid, refitted on all training rows, on the test rows."""
    settings = forests.settings_of()
    best = selection.best_setting(grid_search(spark, sf), settings)
    _, train, test, _ = _split_features(spark, sf)
    scored = models.with_probability(models.histogram_forest(best).fit(train).transform(test))
    return scored.select("post_id", "target", "prediction", "y_pred_proba")


@query()
def cv_recall(spark, sf):
    table = selection.cross_validated(_folded(spark, sf, 10))
    return table.select("estimator", "mean_recall")


# vectors with a target that SQL can build: exact cuts and boosted stumps have an oracle
_VOTE_ROUNDS = 50


def _halves(spark, sf):
    label = (F.col("label") >= 5).cast("int").alias("target")
    vector = array_to_vector(F.col("embedding").cast("array<double>")).alias("features")
    rows = sparse_rows(table(spark, sf, "embeddings").select("vec_id", label, vector), "vec_id")
    cuts = fit_cuts(rows, 64)
    return rows, cuts, boosted_stumps.range_table(rows, cuts)


_ENTRIES = (
    "l as materialized (select vec_id, unnest(range(len(embedding))) as f, unnest(embedding)::double as value from embeddings)"
)
_PURITY = "(lp * lp + ln * ln) / (lp + ln) + (rp * rp + rn * rn) / (rp + rn)"


@query(
    f"with {_ENTRIES}, g as (select f, value, count_if(label >= 5) as p, count_if(label < 5) as n "
    "from l join embeddings using (vec_id) group by f, value), "
    "t as (select count_if(label >= 5)::double as p, count_if(label < 5)::double as n from embeddings), "
    "r as (select f, value, lead(value) over (partition by f order by value) as next, "
    "(sum(p) over (partition by f order by value))::double as lp, (sum(n) over (partition by f order by value))::double as ln from g), "
    "c as (select f, value, (value + next) / 2 as threshold, lp, ln, t.p - lp as rp, t.n - ln as rn from r, t where next is not null) "
    f"select f::int as feature, round(threshold, 9) as threshold, round({_PURITY}, 6) as purity, "
    "lp as positives_left, ln as negatives_left, rp as positives_right, rn as negatives_right from c "
    f"qualify row_number() over (partition by f order by {_PURITY} desc, value) = 1"
)
def best_cut_per_feature(spark, sf):
    """The first round: all rows weigh one."""
    sparse, cuts, ranges = _halves(spark, sf)
    rows = boosted_stumps.weighted(sparse, cuts, [-1])
    found = boosted_stumps.cuts_of(boosted_stumps.with_units(rows, 1), 1, ranges)
    found = found.groupBy("at").agg(F.max("cut").alias("cut"))
    return found.select(
        F.col("at").alias("feature"),
        F.round("cut.threshold", 9).alias("threshold"),
        F.round(F.col("cut.purity") / boosted_stumps.UNIT, 6).alias("purity"),
        (F.col("cut.lp") / boosted_stumps.UNIT).alias("positives_left"),
        (F.col("cut.ln") / boosted_stumps.UNIT).alias("negatives_left"),
        (F.col("cut.rp") / boosted_stumps.UNIT).alias("positives_right"),
        (F.col("cut.rn") / boosted_stumps.UNIT).alias("negatives_right"),
    )


_TINY = boosted_stumps.TINY


@query(
    f"with recursive {_ENTRIES}, "
    "s as (select 0 as k, vec_id, (label >= 5)::int as y, 1.0::double as w, 0.0::double as score from embeddings "
    "union all select k + 1, vec_id, y, w * exp(-(2 * y - 1) * h) / after, score + h from ("
    f"with q as (select *, floor(w * {boosted_stumps.UNIT} + 0.5)::bigint as q from s where k < {_VOTE_ROUNDS}), "
    "t as (select sum(q) filter (y = 1) as p, sum(q) filter (y = 0) as n from q), "
    "g as (select f, value, sum(case when y = 1 then q else 0 end) as p, sum(case when y = 0 then q else 0 end) as n "
    "from l join q using (vec_id) group by f, value), "
    "r as (select f, value, lead(value) over (partition by f order by value) as next, "
    "(sum(p) over (partition by f order by value))::double as lp, (sum(n) over (partition by f order by value))::double as ln from g), "
    "c as (select f, value, (value + next) / 2 as threshold, lp, ln, t.p - lp as rp, t.n - ln as rn from r, t where next is not null), "
    f"b as (select *, {_PURITY} as purity from c where lp + ln > 0 and rp + rn > 0 order by purity desc, f, value limit 1), "
    f"v as (select *, 0.5 * (ln(greatest(lp / (lp + ln), {_TINY})) - ln(greatest(1 - lp / (lp + ln), {_TINY}))) as hl, "
    f"0.5 * (ln(greatest(rp / (rp + rn), {_TINY})) - ln(greatest(1 - rp / (rp + rn), {_TINY}))) as hr from b), "
    "a as (select *, (lp * exp(-hl) + ln * exp(hl) + rp * exp(-hr) + rn * exp(hr)) / (lp + ln + rp + rn) as after from v) "
    "select q.k, q.vec_id, q.y, q.w, q.score, case when l.value <= a.threshold then hl else hr end as h, after "
    "from q, a join l on l.f = a.f where l.vec_id = q.vec_id) as step) "
    f"select vec_id, round(score, 6) as score, (score > 0)::int as prediction from s where k = {_VOTE_ROUNDS}"
)
def adaboost_votes(spark, sf):
    """All rounds of boosted stumps, and the sum of their votes for every row."""
    sparse, cuts, ranges = _halves(spark, sf)
    rows = boosted_stumps.weighted(sparse, cuts, [-1])
    stumps = boosted_stumps.boost(rows, ranges, rounds=_VOTE_ROUNDS)
    scored = selection.fold_scores(sparse.withColumn("fold", F.lit(-1)), stumps, [-1])
    return scored.select(
        F.col("key").alias("vec_id"), F.round("score", 6).alias("score"), (F.col("score") > 0).cast("int").alias("prediction")
    )


def _scorer(spark, sf):
    vectors, _, _, _ = _split_features(spark, sf)
    classifier = _model(spark, sf, "logreg", lambda train: models.logistic_regression(train.count()))
    return models.scoring_model(vectors, classifier, keep=["post_id"], lemmaPath=_dictionary_path(spark, sf))


@query()
def score_posts(spark, sf):
    scored = models.score(_scorer(spark, sf), labelled_posts(spark, sf, heavy=True))
    return scored.select("post_id", "prediction", "y_pred_proba")


@query()
def saved_model_scores(spark, sf):
    """The whole scoring pipeline, saved, loaded and applied to all posts."""
    path = f"{checkpoint_dir(spark)}/model-{uuid.uuid4().hex}"
    save_model(_scorer(spark, sf), path)
    scored = models.score(load_model(path), labelled_posts(spark, sf, heavy=True))
    return scored.select("post_id", "prediction", "y_pred_proba")


@query()
def newest_post_score(spark, sf):
    """One text scored on its own: that of the newest post."""
    model = _scorer(spark, sf)
    newest = posts(spark, sf).orderBy(F.col("publish_date").desc(), "post_id").first()
    label, share = models.score_text(model, spark, newest["content"])
    return spark.createDataFrame([(newest["post_id"], label, share)], "post_id long, prediction int, y_pred_proba double")


@query()
def knn_classifier(spark, sf):
    """Neighbours in the model matrix: test posts against train posts."""
    _, train, test, _ = _split_features(spark, sf)
    return _knn_predictions(train, test)


# ---- streaming -------------------------------------------------------------


@query("select event_id, user_id, event_type, value from events")
def stream_ingest(spark, sf):
    """Batch and stream see the same rows: the landed files, each once."""
    events = table(spark, sf, "events").select("event_id", "user_id", "event_type", "value")
    folder = f"{checkpoint_dir(spark)}/ingest-{uuid.uuid4().hex}"
    landed = stream_files(spark, sf, events.schema, name_filter="events.parquet")
    ingest_available(landed, f"{folder}/table", f"{folder}/checkpoint")
    return spark.read.schema(events.schema).parquet(f"{folder}/table")


@query()
def stream_scores(spark, sf):
    columns = ["post_id", "author", "content", "publish_date", "target"]
    arrived = labelled_posts(spark, sf).select(*columns)
    folder = f"{checkpoint_dir(spark)}/scores-{uuid.uuid4().hex}"
    write_table(arrived, f"{folder}/landing")
    stream = stream_files(spark, f"{folder}/landing", arrived.schema)
    model = _scorer(spark, sf)
    score_available(model, stream, f"{folder}/table", f"{folder}/checkpoint", ["post_id"])
    return spark.read.parquet(f"{folder}/table")
