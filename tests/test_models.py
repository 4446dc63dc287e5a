"""Neighbours, metrics, classifiers and scoring."""

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from finchlab.operators import knn, metrics
from finchlab.plans import forests, models, reports
from finchlab.plans.adaboost import AdaBoost
from finchlab.plans.features import post_features
from finchlab.plans.vectors import fit_vectors
from finchlab.sources.writers import load_model, save_model, write_table
from finchlab.streaming.ingest import stream_files
from finchlab.streaming.scoring import score_available


def vectors_frame(spark, n=300, dims=6, seed=0):
    rng = np.random.default_rng(seed)
    # whole numbers: equal distances are exactly equal, so ties are really tested
    matrix = rng.normal(size=(n, dims), scale=3).round()
    matrix[n // 2 : n // 2 + 20] = matrix[0]  # a group of copies
    rows = [(i, [float(x) for x in matrix[i]], int(rng.integers(0, 3))) for i in range(n)]
    return spark.createDataFrame(rows, "id long, vector array<double>, label int"), rows


def brute(rows, k):
    out = {}
    for i, v, _ in rows:
        d = sorted(
            (float(np.sqrt(np.sum((np.array(v) - np.array(w)) ** 2))), j, lab)
            for j, w, lab in rows
            if j != i
        )
        out[i] = d[:k]
    return out


@pytest.mark.parametrize("cells, inner, visits", [(1, 1, 1000), (12, 1, 40), (4, 7, 1000), (9, 30, 15)])
def test_neighbours_match_brute_force(spark, cells, inner, visits):
    df, rows = vectors_frame(spark)
    got = knn.nearest(
        df.repartition(5), df, 7, skip_self=True, max_cells=cells, cell_rows=5, block_bytes=2500, sub_cells=inner,
        visits=visits,
    ).collect()
    wanted = brute(rows, 7)
    by_query = {}
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        by_query.setdefault(r["query_id"], []).append((r["distance"], r["train_id"], r["label"]))
    assert set(by_query) == set(wanted)
    for i, near in wanted.items():
        assert [t for _, t, _ in by_query[i]] == [t for _, t, _ in near]
        assert [d for d, _, _ in by_query[i]] == pytest.approx([d for d, _, _ in near])


def test_far_cells_are_not_visited(spark):
    rows = [(i, [float(1000 * (i % 8) + i // 8 % 5), float(i // 40)], i % 3) for i in range(800)]
    df = spark.createDataFrame(rows, "id long, vector array<double>, label int")
    near = knn.nearest(df, df, 3, cell_rows=50)
    plan = near._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    for r in near.filter("rank = 3").collect():
        own = sorted((math.dist(rows[r["query_id"]][1], v), i) for i, v, _ in rows)[2]
        assert (r["distance"], r["train_id"]) == (pytest.approx(own[0]), own[1])


def test_training_rows_are_moved_once(spark, monkeypatch):
    """However many queries there are, blocks are copied only for `visits` queries each."""
    df, _ = vectors_frame(spark, n=400)
    sent = []
    plain = knn._streamed
    monkeypatch.setattr(knn, "_streamed", lambda k, skip: sent.append(1) or plain(k, skip))
    near = knn.nearest(df, df.unionAll(df), 3, max_cells=8, cell_rows=20, sub_cells=4)
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert sent == [1] and "FlatMapCoGroups" not in plan and "NestedLoop" not in plan
    cells = knn._cells(df.selectExpr("id", "vector as v", "label"), 8, 4, 20)
    assert len(cells.outer) == 8 and 8 < len(cells.count) <= 32


def test_fewer_training_rows_than_k(spark):
    df, _ = vectors_frame(spark, n=4)
    assert knn.nearest(df, df, 10, skip_self=True).count() == 12
    empty = df.filter("id < 0")
    assert knn.nearest(empty, df, 3).count() == 0
    assert knn.nearest(df, empty, 3).count() == 0


def test_vote_ties_go_to_the_smallest_label(spark):
    near = spark.createDataFrame(
        [(1, 10, 2, 0.1, 1), (1, 11, 0, 0.2, 2), (1, 12, 2, 0.3, 3), (1, 13, 0, 0.4, 4)],
        "query_id long, train_id long, label int, distance double, rank int",
    )
    assert knn.vote(near).first()["prediction"] == 0
    per_k = {r["k"]: r["prediction"] for r in knn.votes_per_k(near, 4).collect()}
    assert per_k == {1: 2, 2: 0, 3: 2, 4: 0}
    truth = spark.createDataFrame([(1, 2)], "id long, label int")
    swept = knn.sweep(knn.votes_per_k(near, 4), truth, positive=2)
    assert knn.best_k(swept).first()["k"] == 1


def predictions(spark, pairs):
    return spark.createDataFrame(pairs, "target int, prediction int")


def test_metrics(spark):
    df = predictions(spark, [(1, 1)] * 3 + [(1, 0)] * 2 + [(0, 1)] + [(0, 0)] * 4)
    row = metrics.scores(df, "target", "prediction").first()
    assert row["accuracy"] == pytest.approx(0.7)
    assert row["recall_score"] == pytest.approx(0.6)
    assert row["f1_score"] == pytest.approx(6 / 9)
    shares = {(r["target"], r["prediction"]): r["share"]
              for r in metrics.confusion_normalised(df, "target", "prediction").collect()}
    assert shares[1, 1] == pytest.approx(0.6) and shares[0, 1] == pytest.approx(0.2)


def test_metrics_without_positives_are_zero(spark):
    row = metrics.scores(predictions(spark, [(0, 0)]), "target", "prediction").first()
    assert (row["recall_score"], row["f1_score"], row["accuracy"]) == (0.0, 0.0, 1.0)


def test_best_by_recall_keeps_the_first_of_equals(spark):
    table = spark.createDataFrame([(0, "a", 0.5), (1, "b", 0.9), (2, "c", 0.9)], "i int, estimator string, recall_score double")
    assert metrics.best_by_recall(table, "i").first()["estimator"] == "b"


def test_shares_sum_to_one(spark):
    df = spark.range(10).select((F.col("id") % 3).alias("v"))
    assert sum(r["share"] for r in reports.value_shares(df, "v").collect()) == pytest.approx(1)


WORDS = ["apple pear plum", "apple plum fig", "pear fig apple"], ["iron zinc lead", "zinc tin iron", "lead tin zinc"]


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [
        (i, "a", f"{WORDS[i % 2][i % 3]} number{i % 5} #Tag{i % 2}", None, i % 2) for i in range(120)
    ]
    return spark.createDataFrame(
        rows, "post_id int, author string, content string, publish_date timestamp_ntz, target int"
    )


@pytest.fixture(scope="module")
def matrix(spark, corpus):
    features = post_features(corpus, keep=["post_id"]).cache()
    fitted = fit_vectors(features)
    return fitted, fitted.transform(features).select("post_id", "target", "features").coalesce(2).cache()


def recall(model, df):
    return metrics.scores(model.transform(df), "target", "prediction").first()["recall_score"]


ESTIMATORS = {
    "logistic": lambda: models.logistic_regression(120),
    "tree": lambda: models.decision_tree(5),
    "forest": lambda: models.random_forest(10, "gini", 5),
    "histogram_forest": lambda: models.histogram_forest(forests.TUNED_FORESTS[2]),
    "boosted": lambda: models.boosted_trees(rounds=3),
    "samme_r": lambda: AdaBoost(rounds=4, stagedEvery=2),
    "samme": lambda: AdaBoost(rounds=4, algorithm="SAMME"),
}


@pytest.mark.parametrize("name", ESTIMATORS)
def test_classifiers_learn_a_separable_corpus(matrix, name):
    _, train = matrix
    assert recall(ESTIMATORS[name]().fit(train), train) == 1.0


def test_adaboost_combines_stumps(spark, tmp_path):
    from pyspark.ml.linalg import Vectors

    # an interval: no single threshold separates it, three of them do
    rows = [(k, Vectors.dense([float(k % 10)]), int(3 <= k % 10 < 7)) for k in range(100)]
    train = spark.createDataFrame(rows, ["post_id", "features", "target"]).coalesce(1).cache()
    stump = models.decision_tree(1).fit(train)
    for algorithm in ("SAMME", "SAMME.R"):
        boosted = AdaBoost(rounds=8, algorithm=algorithm).fit(train)
        one = metrics.scores(stump.transform(train), "target", "prediction").first()["accuracy"]
        many = metrics.scores(boosted.transform(train), "target", "prediction").first()["accuracy"]
        assert many > one
        assert many == 1.0
        save_model(PipelineModel(stages=[boosted]), str(tmp_path / algorithm))
        again = PipelineModel.load(str(tmp_path / algorithm)).transform(train)
        assert again.select("prediction").collect() == boosted.transform(train).select("prediction").collect()


def test_named_importances_and_coefficients(spark, matrix):
    fitted, train = matrix
    forest = models.random_forest(trees=3, depth=3).fit(train)
    table = models.importances(forest, fitted.names, train, top=10).collect()
    assert table[0]["importance"] >= table[-1]["importance"]
    regression = models.logistic_regression(120).fit(train)
    rows = models.coefficients(regression, fitted.names, train).collect()
    assert len(rows) == len(fitted.names)
    assert rows[0]["coefficient"] < 0 < rows[-1]["coefficient"]
    assert {r["idx"]: r["feature"] for r in rows} == dict(enumerate(fitted.names))


def test_bake_off_table(matrix):
    _, train = matrix
    _, table = models.bake_off(train, train, {"tree": models.decision_tree(2), "lr": models.logistic_regression(120)})
    assert [c for c in table.columns] == ["estimator", "f1_score", "recall_score"]
    assert {r["estimator"] for r in table.collect()} == {"tree", "lr"}


def test_batch_stream_and_single_post_agree_after_reload(spark, corpus, matrix, tmp_path):
    fitted, train = matrix
    lemmas = spark.createDataFrame([("apples", "apple")], "token string, lemma string")
    write_table(lemmas, str(tmp_path / "lemmas"))
    scorer = models.scoring_model(
        fitted, models.logistic_regression(120).fit(train), keep=["post_id"],
        lemmaPath=str(tmp_path / "lemmas"),
    )
    save_model(scorer, str(tmp_path / "model"))
    scorer = load_model(str(tmp_path / "model"))
    batch = models.score(scorer, corpus).select("post_id", "prediction", "y_pred_proba")
    write_table(corpus, str(tmp_path / "landing"))
    score_available(
        scorer, stream_files(spark, str(tmp_path / "landing"), corpus.schema),
        str(tmp_path / "out"), str(tmp_path / "mark"), ["post_id"],
    )
    streamed = spark.read.parquet(str(tmp_path / "out")).drop("batch")
    assert sorted(map(tuple, streamed.collect())) == sorted(map(tuple, batch.collect()))
    plan = batch._jdf.queryExecution().executedPlan().toString()
    assert "EvalPython" not in plan
    single = models.scoring_model(fitted, models.logistic_regression(120).fit(train))
    label, share = models.score_text(single, spark, "zinc tin iron")
    assert label == 1 and share > 0.5
    assert models.score_text(single, spark, "apple pear plum")[0] == 0


def test_probes_cross_the_nearest_planes_first():
    from finchlab.operators import lsh

    probes = lsh.flips(5, 6)
    assert probes[0] == () and probes[1] == (0,) and len(set(probes)) == 6
    assert len(lsh.flips(1, 99)) == 2 and len(lsh.flips(3, 99)) == 8


def test_approximate_neighbours_find_most_and_measure_right(spark):
    from finchlab.operators import lsh

    rng = np.random.default_rng(8)
    centres = rng.normal(size=(30, 12), scale=4)
    rows = [(i, (centres[i % 30] + rng.normal(size=12)).tolist(), i % 3) for i in range(900)]
    rows += [(1000 + i, rows[0][1], 1) for i in range(400)]  # copies of one vector
    df = spark.createDataFrame(rows, "id long, vector array<double>, label int").repartition(4)
    queries = df.filter("id < 200 or id = 1300")
    near = lsh.approximate_nearest(df, queries, 6, skip_self=True, bucket_rows=40, probes=6)
    exact = knn.nearest(df, queries, 6, skip_self=True)
    counted = lsh.recall(near, exact).first()
    assert counted["queries"] == 201 and counted["wanted"] == 201 * 6
    assert counted["found"] >= 0.9 * counted["wanted"]
    by_id = {i: v for i, v, _ in rows}
    got = near.collect()
    assert all(r["distance"] == pytest.approx(math.dist(by_id[r["query_id"]], by_id[r["train_id"]])) for r in got)
    assert all(r["query_id"] != r["train_id"] for r in got)
    # the copies: smallest ids first, none of them lost to a limit
    assert sorted(r["train_id"] for r in got if r["query_id"] == 1300) == [0, 1000, 1001, 1002, 1003, 1004]
    assert lsh.approximate_nearest(df.limit(0), queries, 3).count() == 0
    assert lsh.approximate_nearest(df, queries.limit(0), 3).count() == 0


def test_queries_travel_once_to_a_block_of_cells():
    """However many of its cells they visit."""
    block = knn._blocks(np.array([3, 4, 9, 0, 2, 2]), 7)
    assert block.tolist() == [0, 0, 1, 2, 2, 2]
    rows, cells = np.array([0, 0, 0, 1, 1, 2]), np.array([0, 1, 4, 0, 1, 5])
    row, own, start = knn._of_blocks(rows, cells, block)
    assert list(zip(row.tolist(), own.tolist(), strict=True)) == [(0, 0), (0, 2), (1, 0), (2, 2)]
    assert [c.tolist() for c in np.split(cells, start[1:])] == [[0, 1], [4], [0, 1], [5]]


def test_approximate_neighbours_leave_a_task_k_at_a_time(spark):
    """Pairs that share a bucket are not rows of a join."""
    from finchlab.operators import lsh

    rows = [(i, [float(i % 7), float(i % 11), float(i)], 0) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, vector array<float>, label int")
    near = lsh.approximate_nearest(df, df, 4, bucket_rows=300, probes=1, tables=2)
    assert "Join" not in near._jdf.queryExecution().optimizedPlan().toString()
    got = {(r["query_id"], r["rank"]): r["train_id"] for r in near.collect()}
    want = {(r["query_id"], r["rank"]): r["train_id"] for r in knn.nearest(df, df, 4).collect()}
    assert len(got) == 1200 and sum(got[at] == want[at] for at in want) > 900


def block_of(x, cells, ids=None):
    n = len(x)
    ids = np.arange(n) if ids is None else ids
    rows = [pa.array(ids), pa.array(np.arange(n) % 3, pa.int32()), pa.array([[int(c)] for c in cells], pa.list_(pa.int32())), pa.array(list(x))]
    return knn._Block([pa.record_batch(rows, names=["id", "label", "cells", "v"])])


def asked(x, ids, cells):
    lists = pa.array([list(range(cells))] * len(x), pa.list_(pa.int32()))
    return pa.record_batch([pa.array(ids), lists, pa.array(list(x))], names=["id", "cells", "v"])


@pytest.mark.parametrize("scale", [1.0, 2.0**-46, 2.0**60])
def test_cells_are_searched_within_the_best_so_far(scale):
    """Products in four or eight bytes, copies and repeated keys: the rows that all distances give."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 5), scale=3).round() * scale  # equal distances are exactly equal
    x[50:90] = x[7]
    ids = np.arange(600) // 2 * 2 + 5  # each key twice
    block = block_of(x, rng.integers(0, 9, 600), ids)
    for skip in (False, True):
        found = block.best(asked(x[:80], ids[:80], 9), 6, skip)
        for i in range(80):
            gap = np.sqrt(((x[i] - x) ** 2).sum(axis=1))
            wanted = sorted((d, t) for d, t in zip(gap, ids, strict=True) if not (skip and t == ids[i]))[:6]
            own = found[found["at"] == i]
            assert list(own["train_id"]) == [t for _, t in wanted]
            assert np.allclose(own["distance"], [d for d, _ in wanted], rtol=1e-12)


def test_few_distances_are_computed_term_by_term(monkeypatch):
    """A cell gave its k best for every query, however far they were from the best of the cells before."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(32 * 64, 8))
    sent = []
    plain = knn._Block._distances
    monkeypatch.setattr(knn._Block, "_distances", lambda s, q, rows, cols: sent.append(len(rows)) or plain(s, q, rows, cols))
    block_of(x, np.arange(len(x)) // 64).best(asked(x[:200], np.arange(200), 32), 10, True)
    # k for the first cell, and about k more each time the rows seen have doubled
    assert sum(sent) < 200 * 10 * 12
