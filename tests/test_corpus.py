"""Sources, sinks, corpus jobs and sampling."""

import datetime
from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from finchlab.functions import text as X
from finchlab.operators import filters
from finchlab.operators.ranking import first_per_key, newest_per_group, top_k_per_group
from finchlab.operators.sampling import (
    assign_folds,
    downsample_to,
    label_split,
    rebalance,
    sample_exact,
)
from finchlab.plans import corpus
from finchlab.sources import readers, writers
from finchlab.sources.seeds import collect_by_seed, collected_posts, default_seeds
from finchlab.streaming.ingest import ingest_available, stream_files

RAW_HEADER = (
    "external_author_id,author,content,region,language,publish_date,harvested_date,following,"
    "followers,updates,post_type,account_type,retweet,account_category,new_june_2018,"
    "alt_external_id,tweet_id,article_url,tco1_step1,tco2_step1,tco3_step1"
)


def raw_line(author, content, language="English", retweet=0, category="RightTroll"):
    return (
        f'9,{author},"{content}",US,{language},10/1/2017 19:58,10/1/2017 19:59,1,2,3,,Right,'
        f"{retweet},{category},0,9,9,u,,,"
    )


def test_labelled_csv_to_trimmed_corpus(spark, tmp_path):
    lines = [
        raw_line("a", "one"),
        raw_line("b", "one"),
        raw_line("c", "RT @x: one"),
        raw_line("d", "two", retweet=1),
        raw_line("e", "drei", language="German"),
        raw_line("f", "left", category="LeftTroll"),
        raw_line("g", 'line\nbreak, ""quoted""'),
    ]
    (tmp_path / "posts_1.csv").write_text("\n".join([RAW_HEADER, *lines]) + "\n")
    (tmp_path / "posts_2.csv").write_text("\n".join([RAW_HEADER, raw_line("h", "one")]) + "\n")
    raw = readers.read_labelled(spark, str(tmp_path / "posts_*.csv"), multi_line=True)
    assert raw.count() == 8
    trimmed = corpus.trim_posts(corpus.labelled_category(raw), order=readers.SOURCE_ORDER)
    assert trimmed.columns == ["author", "content", "publish_date", "target"]
    rows = {r["author"]: r for r in trimmed.collect()}
    assert set(rows) == {"a", "g"}
    assert rows["a"]["publish_date"] == datetime.datetime(2017, 10, 1, 19, 58)
    assert rows["g"]["content"] == 'line\nbreak, "quoted"'


def test_control_csv_order_and_sinks(spark, tmp_path):
    folder = tmp_path / "control"
    (folder / "old_files").mkdir(parents=True)
    header = "id,date,time,username,tweet\n"
    (folder / "a.csv").write_text(header + "1,2016-01-01,10:00:00,ann,same\n2,2016-01-02,10:00:00,ann,x\n")
    (folder / "plain.csv").write_text(header + "3,2016-01-03,11:30:00,bob,same\n")
    (folder / "old_files" / "b.csv").write_text(header + "4,2016-01-04,10:00:00,old,old\n")
    raw = readers.read_control(spark, str(folder), "plain.csv", multi_line=True)
    out = corpus.control_posts(raw, order=readers.CONTROL_ORDER)
    rows = {r["content"]: r for r in out.collect()}
    assert set(rows) == {"same", "x"}
    assert rows["same"]["author"] == "bob"  # the file without hashtags comes first
    assert rows["same"]["publish_date"] == datetime.datetime(2016, 1, 3, 11, 30)
    writers.write_csv(out, str(tmp_path / "csv"))
    text = "".join(p.read_text() for p in (tmp_path / "csv").glob("*.csv"))
    assert "2016-01-03 11:30:00" in text
    again = readers.read_posts(spark, str(tmp_path / "csv"), multi_line=True)
    assert sorted(again.collect()) == sorted(out.collect())
    writers.write_table(out, str(tmp_path / "table"))
    assert sorted(readers.read_table(spark, str(tmp_path / "table")).collect()) == sorted(out.collect())


def test_single_post(spark):
    row = readers.single_post(spark, "hello").first()
    assert row.asDict() == {"author": None, "content": "hello", "publish_date": None, "target": None, "post_id": 0}


def test_union_fills_missing_columns(spark):
    a = spark.createDataFrame([(1, "x")], "i int, s string")
    b = spark.createDataFrame([(2,)], "i int")
    assert sorted(map(tuple, corpus.union_all(a, b).collect()), key=str) == [(1, "x"), (2, None)]


def test_first_per_key_nulls_and_idempotence(spark):
    df = spark.createDataFrame(
        [(3, "a"), (1, "a"), (2, None), (4, None), (5, "A")], "i int, t string"
    )
    once = first_per_key(df, ["t"], ["i"])
    assert {(r["i"], r["t"]) for r in once.collect()} == {(1, "a"), (2, None), (5, "A")}
    assert sorted(map(str, first_per_key(once, ["t"], ["i"]).collect())) == sorted(map(str, once.collect()))


def test_first_per_key_combines_before_the_shuffle(spark):
    hot = spark.range(200_000).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("t"))
    out = first_per_key(hot, ["t"], ["id"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "partial_min" in plan and "Window" not in plan
    assert out.filter("t = 'hot'").collect()[0]["id"] == 0


@pytest.mark.parametrize("k", [3, 1200])
def test_top_k_with_a_hot_group(spark, k):
    df = spark.range(5000).select("id", F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id")).alias("g"))
    out = top_k_per_group(df, ["g"], [F.col("id").desc()], k, salt_by=["id"], salts=8)
    hot = [r["id"] for r in out.filter("g = 1").orderBy("rank").collect()]
    wanted = sorted([i for i in range(5000) if i % 3 == 0 or i == 1], reverse=True)[:k]
    assert hot == wanted


def test_newest_rows_up_to_each_groups_own_cap(spark):
    start = datetime.datetime(2016, 1, 1)
    rows = [
        (i, "hot" if i % 3 else "cold", start + datetime.timedelta(minutes=37 * (i // 4)) if i % 50 else None, 2500 if i % 3 else 7)
        for i in range(6000)
    ]
    df = spark.createDataFrame(rows, "id int, g string, t timestamp_ntz, cap int")
    got = sorted((r["g"], r["rank"], r["id"]) for r in newest_per_group(df, "g", "t", "id", "cap").collect())
    wanted = []
    for group, cap in (("cold", 7), ("hot", 2500)):
        own = sorted(((r[2], r[0]) for r in rows if r[1] == group and r[2]), reverse=True)[:cap]
        wanted += [(group, k + 1, i) for k, (_, i) in enumerate(own)]
    assert got == wanted


def frame(spark, n, positive_every=2):
    return spark.range(n).select(
        "id", (F.col("id") % positive_every == 0).cast("int").alias("target")
    )


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.integers(0, 300), st.integers(0, 300), st.integers(0, 5))
def test_exact_sample_size(spark, n, k, seed):
    df = frame(spark, n)
    if k > n:
        with pytest.raises(Exception, match="larger sample"):
            sample_exact(df, k, "id", seed).collect()
    else:
        ids = [r["id"] for r in sample_exact(df, k, "id", seed).collect()]
        assert len(ids) == len(set(ids)) == k
        assert ids == [r["id"] for r in sample_exact(df, k, "id", seed).collect()]


def test_trim_pushes_filters_and_prunes_columns(spark, tmp_path):
    spark.createDataFrame(
        [("a", "x", None, 1, 0, "English", "RightTroll", "wide")],
        "author string, content string, publish_date timestamp_ntz, target int, retweet int, "
        "language string, account_category string, article_url string",
    ).write.parquet(str(tmp_path / "posts"))
    stored = spark.read.parquet(str(tmp_path / "posts"))
    trimmed = corpus.trim_posts(
        corpus.labelled_category(stored), order=["publish_date", "author"]
    )
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")  # show all pushed filters
    plan = trimmed._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    for pushed in ("EqualTo(retweet,0)", "EqualTo(language,English)",
                   "EqualTo(account_category,RightTroll)", "Not(StringStartsWith(content,RT ))"):
        assert pushed in plan
    assert "article_url" not in plan
    assert plan.count("Exchange") == 1


def test_split_sizes_and_plan(spark):
    df = frame(spark, 1003)
    split = label_split(df, 0.1, 0.2, "id", 123)
    sizes = {r["split"]: r["count"] for r in split.groupBy("split").count().collect()}
    assert sizes == {"test": 101, "validation": 181, "train": 721}
    assert split.count() == 1003


def test_rebalance_and_downsample(spark):
    df = frame(spark, 1000)
    out = rebalance(df, 0.1, "id", 123)
    assert {r["target"]: r["count"] for r in out.groupBy("target").count().collect()} == {0: 500, 1: 50}
    tiny = rebalance(frame(spark, 50), 0.1, "id", 1)  # 25 negatives: round(2.5) is 2
    assert tiny.filter("target = 1").count() == 2
    both = downsample_to(df.filter("target = 1"), df.filter("target = 0 and id < 100"), "id", 9)
    assert {r["target"]: r["count"] for r in both.groupBy("target").count().collect()} == {0: 50, 1: 50}


def test_folds_are_even_within_each_class(spark):
    folded = assign_folds(frame(spark, 1000, 7), 3, "id", 123, "target")
    counts = {(r["target"], r["fold"]): r["count"] for r in folded.groupBy("target", "fold").count().collect()}
    assert sum(counts.values()) == 1000
    for label in (0, 1):
        sizes = [counts[label, f] for f in range(3)]
        assert max(sizes) - min(sizes) <= 1


def test_sampling_moves_no_payload(spark):
    df = spark.range(1000).select("id", F.repeat(F.lit("x"), 100).alias("payload"))
    plan = sample_exact(df, 10, "id", 1)._jdf.queryExecution().executedPlan().toString()
    outer = plan[: plan.index("Subquery")]
    assert "Exchange" not in outer


def test_lookup_and_high_water_mark(spark):
    df = frame(spark, 10)
    assert filters.by_key(df, "id", 3).count() == 1
    assert filters.newer_than(df, "id", 3, 6).count() == 3
    assert filters.newer_than(df, "id", None).count() == 10


def test_step_counts(spark):
    df = spark.createDataFrame(
        [("a", 0, "English"), ("a", 0, "English"), ("RT b", 0, "English"), ("c", 1, "English"),
         ("d", 0, "French"), (None, 0, "English")],
        "content string, retweet int, language string",
    )
    got = [(r["stage"], r["rows"]) for r in corpus.trim_step_counts(df).orderBy("step").collect()]
    assert got == [("input", 6), ("retweet_flag", 5), ("retweet_prefix", 3), ("language", 2), ("distinct_text", 1)]


def test_parse_timestamp(spark):
    df = spark.createDataFrame([("10/1/2017 19:58",)], "s string")
    parsed = df.select(X.parse_timestamp(F.col("s"), "M/d/yyyy H:mm")).first()[0]
    assert parsed == datetime.datetime(2017, 10, 1, 19, 58)


def test_collected_posts_carry_their_seeds(spark):
    posts = spark.createDataFrame(
        [(i, f"#A{i % 2} text", datetime.datetime(2016, 1, 1 + i), "English", 0) for i in range(6)],
        "post_id int, content string, publish_date timestamp_ntz, language string, retweet int",
    )
    seeds = [("#a0", 2), ("#a1", 5), ("", 1)]
    out = collected_posts(posts, collect_by_seed(posts, seeds), seeds)
    assert out.columns == [*posts.columns, "seed", "rank"]
    got = sorted((r["seed"], r["rank"], r["post_id"]) for r in out.collect())
    assert got == [("", 1, 5), ("#a0", 1, 4), ("#a0", 2, 2), ("#a1", 1, 5), ("#a1", 2, 3), ("#a1", 3, 1)]


def test_default_seeds():
    seeds = default_seeds()
    assert len(seeds) == 74
    assert seeds[0] == ("#MAGA", 7000)
    assert seeds[-1] == ("", 100000)


def test_stream_ingest_is_incremental(spark, tmp_path):
    landing, table, mark = (str(tmp_path / d) for d in ("landing", "table", "mark"))
    schema = spark.range(1).schema
    spark.range(5).write.parquet(landing)
    ingest_available(stream_files(spark, landing, schema), table, mark)
    assert spark.read.parquet(table).count() == 5
    spark.range(5, 8).write.mode("append").parquet(landing)
    ingest_available(stream_files(spark, landing, schema), table, mark)
    assert sorted(r["id"] for r in spark.read.parquet(table).collect()) == list(range(8))


def test_folds_keep_rows_of_every_label(spark):
    rows = [(i, [0, 1, 2, None][i % 4]) for i in range(40)]
    df = spark.createDataFrame(rows, "k int, target int")
    out = assign_folds(df, 5, "k", 1, "target").collect()
    assert sorted((r["k"], r["target"]) for r in out) == rows
    sizes = Counter((r["target"], r["fold"]) for r in out)
    assert set(sizes.values()) == {2} and len(sizes) == 20


def test_sample_with_null_and_repeated_keys_is_exact_or_fails(spark):
    nulls = spark.createDataFrame([(i if i % 5 else None,) for i in range(1, 21)], "k int")
    twice = spark.createDataFrame([(i // 2,) for i in range(20)], "k int")
    for df in (nulls, twice):
        for n in range(1, 20):
            try:
                assert sample_exact(df, n, "k", 3).count() == n
            except Exception as error:
                assert "not unique where the sample is cut" in str(error)


def test_first_copies_are_not_sorted_by_text(spark):
    df = spark.createDataFrame([("b", 2, "x"), (None, 1, "y"), ("b", 1, "z"), (None, 3, "w")], "t string, o int, p string")
    out = first_per_key(df, ["t"], ["o"])
    assert sorted(map(str, out.collect())) == sorted(["Row(t='b', o=1, p='z')", "Row(t=None, o=1, p='y')"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "keys=[t#" not in plan and "Sort [t#" not in plan
