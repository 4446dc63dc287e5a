"""Vocabularies, TF-IDF, scaling, lemmas."""

import math
from collections import Counter

import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from finchlab.operators.lemmas import lemmas_from_corpus, lemmatize_by_join
from finchlab.operators.lists import exploded, with_ngrams
from finchlab.plans import vectors as V
from finchlab.session import spread

BLOCK = V.Block("words", "text", 4, True, 3, ["thanks"])


def texts(spark, rows):
    return spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "post_id int, text string")


ROWS = ["red fox red fox", "red hen", "thanks fox", "", "a b", "red fox hen red fox"]


def grams(text, longest=3):
    words = [w for w in text.split() if len(w) > 1 and w != "thanks"]
    return [
        " ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)
    ]


def brute_vocabulary(rows, size):
    cf, df = Counter(), Counter()
    for r in rows:
        cf.update(grams(r))
        df.update(set(grams(r)))
    top = sorted(cf, key=lambda t: (-cf[t], t))[:size]
    return {t: (cf[t], df[t]) for t in sorted(top)}


def test_ngrams(spark):
    df = with_ngrams(texts(spark, ROWS), BLOCK.terms(), 3, "g")
    for row in df.collect():
        assert sorted(row["g"]) == sorted(grams(row["text"]))


@pytest.mark.parametrize("size", [1, 2, 4, 50])
def test_vocabulary_is_exact_with_and_without_pruning(spark, size):
    block = V.Block("words", "text", size, True, 3, ["thanks"])
    got = V.vocabulary(texts(spark, ROWS), [block]).orderBy("idx").collect()
    assert {r["term"]: (r["cf"], r["df"]) for r in got} == brute_vocabulary(ROWS, size)
    assert [r["idx"] for r in got] == list(range(len(got)))


def test_pruning_is_exact_under_ties(spark):
    rows = [f"w{i:03d} x{i:03d}" for i in range(50)]
    block = V.Block("words", "text", 3, True, 2)
    assert V.frequent_words(texts(spark, rows), block) == ["w000", "w001", "w002"]
    got = V.vocabulary(texts(spark, rows), [block]).orderBy("idx").collect()
    assert [r["term"] for r in got] == ["w000", "w000 x000", "w001"]


def test_pruning_leaves_out_grams_over_rare_words(spark):
    rows = [f"aa bb rare{i:03d} aa bb" for i in range(20)] + ["aa zz zz"]
    block = V.Block("words", "text", 2, True, 3, ["thanks"])
    counted = V.term_counts(texts(spark, rows), [block], prune=True).collect()
    assert not [r["term"] for r in counted if "rare" in r["term"] or "zz" in r["term"]]
    assert {r["term"]: (r["cf"], r["df"]) for r in counted} == {"aa": (41, 21), "bb": (40, 20), "aa bb": (40, 20)}
    got = V.vocabulary(texts(spark, rows), [block]).collect()
    assert {r["term"]: (r["cf"], r["df"]) for r in got} == brute_vocabulary(rows, 2)


def test_pruning_keeps_grams_over_words_tied_with_the_last(spark):
    # "aa zz" is as frequent as "mm", sorts before it, and "zz" is not among the first words
    rows = ["aa zz", "aa zz", "mm", "mm", "aa"]
    block = V.Block("words", "text", 2, True, 2)
    got = V.vocabulary(texts(spark, rows), [block]).orderBy("idx").collect()
    assert [r["term"] for r in got] == ["aa", "aa zz"]


def test_tfidf_formula_and_norm(spark):
    df = texts(spark, ROWS)
    fitted = V.fit_vectors(df, [BLOCK], numerics=[])
    vocabulary = brute_vocabulary(ROWS, 4)
    assert fitted.names == list(vocabulary)
    long = V.long_form(fitted.transform(df), "post_id", fitted).collect()
    got = {(r["post_id"], r["term"]): r["weight"] for r in long}
    for i, text in enumerate(ROWS):
        tf = Counter(g for g in grams(text) if g in vocabulary)
        raw = {t: n * (math.log((1 + len(ROWS)) / (1 + vocabulary[t][1])) + 1) for t, n in tf.items()}
        norm = math.sqrt(sum(w * w for w in raw.values()))
        for t, w in raw.items():
            assert got[i, t] == pytest.approx(w / norm)
    assert len(got) == sum(len(set(grams(t)) & set(vocabulary)) for t in ROWS)


def test_unseen_terms_are_ignored_and_empty_blocks_left_out(spark):
    emojis = V.Block("emojis", "emo", 5)
    train = texts(spark, ROWS).withColumn("emo", F.lit(""))
    fitted = V.fit_vectors(train, [BLOCK, emojis], numerics=[])
    assert "emojis" not in fitted.slices
    new = texts(spark, ["unknown words only"]).withColumn("emo", F.lit("😀"))
    assert list(fitted.transform(new).first()["features"].toArray()) == [0.0] * 4


def test_population_scaling(spark):
    df = spark.createDataFrame([(1.0, 5), (2.0, 5), (4.0, 5)], "a double, b int")
    scaler, n = V.fit_scaler(df, ["a", "b"])
    out = scaler.transform(df).select(vector_to_array("numerics").alias("v")).collect()
    a = [r["v"][0] for r in out]
    assert n == 3
    assert sum(a) == pytest.approx(0)
    assert sum(x * x for x in a) / 3 == pytest.approx(1)
    assert all(r["v"][1] == 0 for r in out)


def test_fitted_pipeline_round_trip(spark, tmp_path):
    from pyspark.ml import PipelineModel

    df = texts(spark, ROWS)
    fitted = V.fit_vectors(df, [BLOCK], numerics=[])
    fitted.model.write().overwrite().save(str(tmp_path / "m"))
    again = PipelineModel.load(str(tmp_path / "m"))
    first = [r["features"] for r in fitted.transform(df).orderBy("post_id").collect()]
    assert [r["features"] for r in again.transform(df).orderBy("post_id").collect()] == first


def test_explode_does_not_compute_the_list_twice(spark):
    df = exploded(texts(spark, ROWS), BLOCK.terms(), "t")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("regexp_extract_all") == 1


def words_frame(spark):
    return spark.createDataFrame(
        [(1, ["foxes", "runs", "fox"]), (2, []), (3, ["runs"] * 5)], "id int, w array<string>"
    )


def test_lemmas_by_join(spark):
    table = spark.createDataFrame(
        [("foxes", "fox"), ("runs", "run"), ("runs", "zzz"), ("it's", "it")], "token string, lemma string"
    )
    joined = lemmatize_by_join(words_frame(spark), "id", "w", table)
    assert {r["id"]: r["w"] for r in joined.collect()} == {1: ["fox", "run", "fox"], 2: [], 3: ["run"] * 5}


def test_lemmas_by_part_of_speech(spark):
    table = spark.createDataFrame(
        [("saw/v", "see"), ("saw/n", "saw"), ("better/a", "good")], "token string, lemma string"
    )
    df = spark.createDataFrame(
        [(1, ["saw", "saw", "better", "better"], ["VBD", "NN", "JJ", "IN"])],
        "id int, w array<string>, t array<string>",
    )
    got = lemmatize_by_join(df, "id", "w", table, tags="t").first()["w"]
    assert got == ["see", "saw", "good", "better"]


def test_dictionary_of_any_size(spark):
    table = spark.range(100_000).select(
        F.concat(F.lit("w"), "id").alias("token"), F.concat(F.lit("l"), "id").alias("lemma")
    )
    df = spark.createDataFrame([(1, ["w0", "w99999", "w100000"])], "id int, w array<string>")
    assert lemmatize_by_join(df, "id", "w", table).first()["w"] == ["l0", "l99999", "w100000"]


def test_lemmas_from_corpus(spark):
    words = spark.createDataFrame([(w,) for w in "foxes fox cats cat gas cities city".split()], "token string")
    got = {r["token"]: r["lemma"] for r in lemmas_from_corpus(words).collect()}
    assert got == {"cats": "cat", "cities": "city"} | ({"foxes": "fox"} if "foxes" in got else {})


def test_lemmas_from_corpus_read_written_tokens(spark, tmp_path):
    spark.createDataFrame([("cats",), ("cat",), ("cats",)], "token string").write.parquet(f"{tmp_path}/words")
    out = lemmas_from_corpus(spark.read.parquet(f"{tmp_path}/words"))
    # the words themselves are read once, for the table of distinct tokens
    assert out.inputFiles() and all("/known-" in path for path in out.inputFiles())
    assert [tuple(r) for r in out.collect()] == [("cats", "cat")]


def test_lemmas_by_join_do_not_make_words_to_test_them(spark):
    """Tested before they are exploded, words would be made at the scan, below any exchange: in one task for one row group."""
    table = spark.createDataFrame([("runs", "run")], "token string, lemma string")
    df = texts(spark, ["runs far", "it runs"]).repartition(4, "post_id").withColumn("w", F.split("text", " "))
    joined = lemmatize_by_join(df.select("post_id", "w"), "post_id", "w", table)
    plan = joined._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Filter" in line and "split" in line]
    assert {r["post_id"]: r["w"] for r in joined.collect()} == {0: ["run", "far"], 1: ["it", "run"]}


def test_lemmas_of_long_texts_are_placed_without_searching_a_map(spark):
    """Words times changes would be 4 * 10**10 steps."""
    table = spark.createDataFrame([("a", "b")], "token string, lemma string")
    df = spark.range(1).select("id", F.array_repeat(F.lit("a"), 200_000).alias("w"))
    joined = lemmatize_by_join(df, "id", "w", table)
    assert "element_at" not in joined._jdf.queryExecution().optimizedPlan().toString()
    assert joined.select(F.size("w"), F.array_distinct("w")).first()[:] == (200_000, ["b"])


def test_lemmas_keep_rows_without_key_or_words(spark):
    table = spark.createDataFrame([("a", "b")], "token string, lemma string")
    rows = [(1, ["x", "a", "y", "a"]), (2, None), (None, ["a"]), (4, ["y", "a"]), (5, ["a", "a", "x"])]
    df = spark.createDataFrame(rows, "id int, w array<string>")
    got = {r["id"]: r["w"] for r in lemmatize_by_join(df, "id", "w", table).collect()}
    assert got == {1: ["x", "b", "y", "b"], 2: None, None: ["a"], 4: ["y", "b"], 5: ["b", "b", "x"]}


def test_rows_of_one_row_group_are_spread_however_many_splits_there_are(spark, tmp_path):
    path = str(tmp_path / "one")
    spark.range(2000).coalesce(1).write.parquet(path)
    cores = spark.sparkContext.defaultParallelism
    spark.conf.set("spark.sql.files.openCostInBytes", 1)
    spark.conf.set("spark.sql.files.maxPartitionBytes", 500)
    try:
        df = spark.read.parquet(path)
        assert df.rdd.getNumPartitions() > cores
        sizes = [len(part) for part in spread(df, "id").rdd.glom().collect()]
        assert sum(sizes) == 2000 and max(sizes) < 2000 / 2
        even = spark.range(0, 2000, 1, 2 * cores)
        assert spread(even, "id") is even
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
