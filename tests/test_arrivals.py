"""Arriving files: first copies, bounded collection, sketches, counts taken while writing."""

import pytest
from pyspark.sql import functions as F

from finchlab.plans import corpus, sketches
from finchlab.streaming import collect, firsts
from finchlab.streaming.ingest import stream_files

SCHEMA = "post_id long, author string, content string, publish_date timestamp_ntz"


def rows_of(spark, ids, text=lambda i: f"text {i % 7} #Tag{i % 3} #tag{i % 3}"):
    rows = [(i, f"a{i % 4}", text(i), None) for i in ids]
    return spark.createDataFrame(rows, SCHEMA).withColumn(
        "publish_date", F.expr("timestamp_ntz '2016-01-01' + make_interval(0, 0, 0, cast(post_id as int))")
    )


def test_first_copies_of_batches_are_those_of_all_rows(spark, tmp_path):
    index, target = str(tmp_path / "index"), str(tmp_path / "firsts")
    for number, ids in enumerate([range(5), range(5, 9), range(9, 30), []]):
        firsts.add_batch(rows_of(spark, ids), number, index, target, "content", ["post_id"])
    want = {}
    for r in rows_of(spark, range(30)).collect():
        want[r["content"]] = min(want.get(r["content"], r["post_id"]), r["post_id"])
    found = spark.read.parquet(target).collect()
    assert {r["content"]: r["post_id"] for r in found} == want
    # a batch that is run again replaces its own rows
    firsts.add_batch(rows_of(spark, range(5, 9)), 1, index, target, "content", ["post_id"])
    again = spark.read.parquet(target)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, found))


def test_only_touched_parts_of_the_index_are_read(spark, tmp_path):
    index = str(tmp_path / "index")
    firsts.add_batch(rows_of(spark, range(200), lambda i: f"text {i}"), 0, index, str(tmp_path / "firsts"), "content", ["post_id"])
    known = firsts.known_digests(spark, index, 1, ["00", "a7"])
    plan = known._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "00" in plan.split("PartitionFilters")[1].split("]")[0]
    assert known.filter(~F.substring("digest", 1, 2).isin("00", "a7")).isEmpty()
    assert firsts.known_digests(spark, str(tmp_path / "none"), 1, ["00"]) is None


def test_null_texts_are_one_text(spark, tmp_path):
    rows = rows_of(spark, range(4), lambda i: None if i % 2 else "x")
    for number in (0, 1):
        firsts.add_batch(rows, number, str(tmp_path / "i"), str(tmp_path / "f"), "content", ["post_id"])
    assert sorted(r["post_id"] for r in spark.read.parquet(str(tmp_path / "f")).collect()) == [0, 1]


def test_collection_stops_at_the_cap_and_resumes(spark, tmp_path):
    seeds = spark.createDataFrame([("#tag0", 4), ("#TAG1", 100), ("#none", 3), ("#tag2", 0)], "seed string, cap long")
    target = str(tmp_path / "collected")
    for number, ids in enumerate([range(6), range(6, 20), range(20, 40)]):
        collect.take_batch(rows_of(spark, ids), number, seeds, target, "post_id", 2, 33)
    want = [("#tag0", i) for i in (3, 6, 9, 12)] + [("#TAG1", i) for i in range(2, 34) if i % 3 == 1]
    found = spark.read.parquet(target)
    assert sorted((r["seed"], r["post_id"]) for r in found.collect()) == sorted(want)
    state = {r["seed"]: tuple(r)[1:] for r in collect.collected_state(spark, target, "post_id").collect()}
    assert state == {"#tag0": (4, 3, 12), "#TAG1": (10, 4, 31)}
    # run again after a failure: the state of a batch is that before it
    collect.take_batch(rows_of(spark, range(6, 20)), 1, seeds, target, "post_id", 2, 33)
    assert sorted((r["seed"], r["post_id"]) for r in spark.read.parquet(target).collect()) == sorted(want)


def test_collection_from_a_stream_reads_a_file_once(spark, tmp_path):
    seeds = spark.createDataFrame([("#tag0", 5)], "seed string, cap long")
    for ids in (range(6), range(6, 40)):
        rows_of(spark, ids).coalesce(1).write.mode("append").parquet(str(tmp_path / "landing"))
        stream = stream_files(spark, str(tmp_path / "landing"), rows_of(spark, []).schema)
        target = collect.collect_available(stream, seeds, str(tmp_path))
    assert sorted(r["post_id"] for r in spark.read.parquet(target).collect()) == [0, 3, 6, 9, 12]


def test_sketches_of_ranges(spark):
    rows = rows_of(spark, range(900), lambda i: f"text {i % 300} #a #b{i % 2} #c{i % 50}")
    days = sketches.daily_sketches(rows).cache()
    assert days.count() == 900  # a post a day
    for groups, n in (([F.year("day").alias("g")], None), ([F.lit(1).alias("g")], 900)):
        out = sketches.in_range(days, groups, top=3).collect()
        assert n is None or [r["posts"] for r in out] == [n]
    (whole,) = out
    assert abs(whole["authors"] - 4) <= 1
    assert abs(whole["texts"] - 300) <= 4 * sketches.relative_error() * 300 + 1
    assert {(t["item"], t["count"]) for t in whole["hashtags"]} == {("#a", 900), ("#b0", 450), ("#b1", 450)}


def test_counts_taken_by_the_pass_that_trims(spark, tmp_path):
    rows = [
        (1, "x", "RT a", None, "English", 0, 1), (2, "x", "b", None, "English", 1, 1), (3, "x", "c", None, "French", 0, 1),
        (4, "x", "d", None, "English", 0, 1), (5, "x", "d", None, "English", 0, 1), (6, "x", "e", None, "English", 0, 1),
    ]
    posts = spark.createDataFrame(rows, SCHEMA + ", language string, retweet int, target int")
    path = str(tmp_path / "trimmed")
    trimmed, counted = corpus.trim_posts_counted(posts, ["post_id"], path, keep=["post_id"])
    assert sorted(map(tuple, counted.collect())) == sorted(map(tuple, corpus.trim_step_counts(posts).collect()))
    wanted = corpus.trim_posts(posts, ["post_id"], keep=["post_id"])
    assert sorted(map(tuple, trimmed.collect())) == sorted(map(tuple, wanted.collect()))
    assert trimmed.columns == wanted.columns and [r["post_id"] for r in trimmed.orderBy("post_id").collect()] == [4, 6]
    _, empty = corpus.trim_posts_counted(posts.limit(0), ["post_id"], str(tmp_path / "none"))
    assert {r["rows"] for r in empty.collect()} == {0}
