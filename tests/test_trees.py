"""Trees, forests, boosting, stumps and regressions of many folds against plain versions."""

import math

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from finchlab.operators import metrics
from finchlab.plans import adaboost, binned, boosting, forests, logistic, models, selection, trees
from finchlab.plans.forests import Setting, decision_tree
from finchlab.sources.writers import save_model

WIDTH = 9


def data(n=160, seed=4):
    """Values with many zeros and ties, negative ones too; two features decide, one is empty."""
    rng = np.random.default_rng(seed)
    x = np.where(rng.random((n, WIDTH)) < 0.5, 0.0, np.round(rng.normal(size=(n, WIDTH)), 1))
    x[:, 3] = rng.normal(size=n)
    x[:, 7] = 0.0
    y = ((x[:, 3] + x[:, 1] + 0.4 * rng.normal(size=n)) > 0).astype(int)
    return x, y


@pytest.fixture(scope="module")
def table(spark):
    x, y = data()
    rows = [(i, Vectors.dense(x[i]) if i % 2 else Vectors.sparse(WIDTH, list(enumerate(x[i]))), int(y[i])) for i in range(len(y))]
    return spark.createDataFrame(rows, ["post_id", "features", "target"]).repartition(3)


@pytest.fixture(scope="module")
def folded(table):
    return selection.folded(table, "post_id", 4)


@pytest.fixture(scope="module")
def plain(folded):
    """The binned rows as one matrix, with hash, label and fold."""
    rows = folded.rows.toArrow().combine_chunks().to_batches()
    (chunk,) = binned.chunks(iter(rows), folded.cuts)
    return chunk


def test_bins_say_what_cuts_say(table, folded):
    x, _ = data()
    cuts = folded.cuts
    assert cuts.table.shape == (WIDTH, binned.BINS - 1)
    for f in range(WIDTH):
        own = cuts.table[f][np.isfinite(cuts.table[f])]
        assert list(own) == sorted(set(own))
        assert not len(own) or own[-1] < max(x[:, f])
        bins = cuts.of(np.full(len(x), f), x[:, f])
        for b, c in enumerate(own):
            assert ((bins <= b) == (x[:, f] <= c)).all()
    # few distinct values: every one is a cut of its own, but the largest
    assert set(cuts.table[0][np.isfinite(cuts.table[0])]) <= set(x[:, 0])
    assert not np.isfinite(cuts.table[7]).any()


def test_chunks_of_any_size_agree(folded):
    batches = folded.rows.toArrow().combine_chunks().to_batches()
    (whole,) = binned.chunks(iter(batches), folded.cuts)
    parts = list(binned.chunks(iter(batches), folded.cuts, 7))
    assert (np.concatenate([c.x for c in parts]) == whole.x).all()
    assert (np.concatenate([c.columns["y"] for c in parts]) == whole.columns["y"]).all()


def plain_tree(chunk, setting, fold, tree, bins, seed=forests.SEED):
    """Nested (feature, cut, left, right) or a pair of class counts, by loops over everything."""
    own_seed = int(forests.seeds(seed, tree + 1)[tree])
    y, hashes, folds = (chunk.columns[c] for c in ("y", "hash", "fold"))
    weight = trees.drawn(hashes, own_seed) if setting.bootstrap else np.ones(len(y))
    weight = np.where(folds == fold, 0, weight) if fold >= 0 else weight

    def impurity(a, b):
        p = a / (a + b)
        if setting.impurity == "gini":
            return 1 - p * p - (1 - p) ** 2
        return -sum(q * math.log2(q) for q in (p, 1 - p) if q > 0)

    def grown(rows, path, depth):
        a, b = (float(weight[rows][y[rows] == c].sum()) for c in (0, 1))
        if depth == setting.levels or min(a, b) == 0 or a + b < max(2 * setting.leaf, setting.split):
            return a, b
        best = (0.0, None)
        looked = trees.looked_at(np.array([path]), own_seed, setting.looked_at(WIDTH), WIDTH)[0]
        for f in looked[looked >= 0]:
            for cut in range(bins):
                low = rows[chunk.x[rows, f] <= cut]
                la, lb = (float(weight[low][y[low] == c].sum()) for c in (0, 1))
                ra, rb = a - la, b - lb
                if min(la + lb, ra + rb) < max(setting.leaf, 1):
                    continue
                gain = impurity(a, b) - (la + lb) / (a + b) * impurity(la, lb) - (ra + rb) / (a + b) * impurity(ra, rb)
                if round(gain, 9) > best[0]:
                    best = (round(gain, 9), (int(f), cut))
        if best[1] is None:
            return a, b
        f, cut = best[1]
        below = chunk.x[rows, f] <= cut
        return f, cut, grown(rows[below], 2 * path, depth + 1), grown(rows[~below], 2 * path + 1, depth + 1)

    return grown(np.arange(len(y)), 1, 0)


def share_of(tree, x):
    while len(tree) == 4:
        f, cut, left, right = tree
        tree = left if x[f] <= cut else right
    return tree[1] / sum(tree)


@pytest.mark.parametrize(
    "setting",
    [
        decision_tree(),
        decision_tree(2),
        Setting(6, "entropy", 4, 3, 9),
        Setting(7, "gini", None, 1, 2),
        Setting(5, "gini", 3, 5, 2),
    ],
)
def test_trees_match_plain_ones(folded, plain, setting):
    """Shares of all rows, from the trees of two folds and of all rows."""
    own = [-1, 0, 2]
    (grown,) = forests.grow_settings(folded.rows, folded.cuts, [setting], own)
    for fold in own:
        found = forests.shares(grown, fold, plain.x, [setting])[0]
        every = [plain_tree(plain, setting, fold, t, folded.cuts.bins) for t in range(setting.trees)]
        wanted = [np.mean([share_of(t, row) for t in every]) for row in plain.x]
        assert np.allclose(found, wanted, atol=1e-9)


def test_trees_do_not_depend_on_what_grows_beside_them(folded):
    grid = forests.settings_of(
        {"trees": [2, 5], "impurity": ["gini", "entropy"], "depth": [2, 4], "leaf": [1, 4], "split": [2, 30]}
    )
    together = {g.key: g for g in forests.grow_settings(folded.rows, folded.cuts, grid, folded.folds)}
    assert len(together) == 4  # number of trees, depth and split size share their trees
    for setting in (grid[0], grid[-1], Setting(2, "gini", 2, 4, 30)):
        (alone,) = forests.grow_settings(folded.rows.repartition(5), folded.cuts, [setting], [1])
        chunk = np.concatenate([c.x for c in binned.chunks(iter(folded.rows.toArrow().to_batches()), folded.cuts)])
        both = [forests.shares(g, 1, chunk, [setting])[0] for g in (alone, together[setting.grown])]
        assert (both[0] == both[1]).all()


def test_search_counts_every_row_of_every_fold(folded):
    settings = forests.settings_of({"trees": [1, 4], "impurity": ["gini"], "depth": [1, 3], "leaf": [1], "split": [2, 50]})
    grown = forests.grow_settings(folded.rows, folded.cuts, settings, folded.folds)
    counts = forests.judged(folded.rows, folded.cuts, grown, settings)
    n = folded.rows.count()
    sums = counts.groupBy("setting", "held_out").agg(F.sum("n").alias("n")).collect()
    assert {(r["held_out"], r["n"]) for r in sums} == {(True, n), (False, 3 * n)}
    assert len(sums) == 2 * len(settings)
    results = forests.grid_results(counts, settings).orderBy("combination").collect()
    assert [r["parameters"] for r in results] == forests.described(settings)
    by_hand = {}
    for r in counts.filter("held_out and y = 1").collect():
        cell = by_hand.setdefault((r["setting"], r["fold"]), [0, 0])
        cell[r["prediction"]] += r["n"]
    for r in results:
        own = [cell[1] / sum(cell) for (s, _), cell in by_hand.items() if s == r["combination"]]
        assert r["mean_recall"] == pytest.approx(np.mean(own)) and r["std_recall"] == pytest.approx(np.std(own))
        assert 0.5 < r["mean_recall"] <= 1 and r["mean_train_recall"] > 0.5
    best = selection.best_setting(forests.grid_results(counts, settings), settings)
    top = max(r["mean_recall"] for r in results)
    assert best == next(s for s, r in zip(settings, results, strict=True) if r["mean_recall"] == top)


def test_wide_inputs_are_summed_in_groups(folded, monkeypatch):
    (one,) = forests.grow_settings(folded.rows, folded.cuts, [Setting(3, "gini", 4)], [0])
    monkeypatch.setattr(trees, "_WIDE", 1)
    monkeypatch.setattr(trees, "_HELD_CELLS", 100)
    (two,) = forests.grow_settings(folded.rows.repartition(9), folded.cuts, [Setting(3, "gini", 4)], [0])
    assert (one.grove.feature == two.grove.feature).all() and (one.grove.sums == two.grove.sums).all()


def test_estimators_score_as_their_trees_and_survive_saving(spark, table, folded, plain, tmp_path):
    setting = Setting(6, "gini", 4, 2, 20)
    model = models.histogram_forest(setting).fit(table)
    scored = models.with_probability(model.transform(table)).select("post_id", "y_pred_proba").collect()
    (grown,) = forests.grow_settings(folded.rows, folded.cuts, [setting])
    hashes = {r["hash"]: r["key"] for r in folded.sparse.collect()}
    wanted = dict(zip([hashes[h] for h in plain.columns["hash"]], forests.shares(grown, -1, plain.x, [setting])[0], strict=True))
    for r in scored:
        assert r["y_pred_proba"] == pytest.approx(wanted[r["post_id"]])
    for name, one in {"forest": model, "boosted": models.boosted_trees(rounds=3).fit(table)}.items():
        save_model(PipelineModel(stages=[one]), str(tmp_path / name))
        again = PipelineModel.load(str(tmp_path / name)).transform(table)
        assert sorted(map(str, again.collect())) == sorted(map(str, one.transform(table).collect()))


def plain_boost(chunk, rounds, depth, bins, fold=-1, step=0.1, penalty=1.0, least=1.0):
    """Margins of all rows after the rounds, by loops over all cuts."""
    y = chunk.columns["y"]
    seen = chunk.columns["fold"] != fold if fold >= 0 else np.ones(len(y), bool)
    margin = np.zeros(len(y))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = np.where(seen, p - y, 0), np.where(seen, p * (1 - p), 0)
        change = np.zeros(len(y))

        def grow(rows, level):
            G, H = g[rows].sum(), h[rows].sum()
            best = (0.0, None)
            if level < depth and H >= 2 * least:
                for f in range(WIDTH):
                    for cut in range(bins):
                        low = rows[chunk.x[rows, f] <= cut]
                        a, b = g[low].sum(), h[low].sum()
                        if b < least or H - b < least:
                            continue
                        gain = a * a / (b + penalty) + (G - a) ** 2 / (H - b + penalty) - G * G / (H + penalty)
                        if round(gain, 9) > best[0]:
                            best = (round(gain, 9), (f, cut))
            if best[1] is None:
                change[rows] = -step * G / (H + penalty)
                return
            f, cut = best[1]
            below = chunk.x[rows, f] <= cut
            grow(rows[below], level + 1)
            grow(rows[~below], level + 1)

        grow(np.arange(len(y)), 0)
        margin = margin + change
    return margin


def test_boosting_matches_a_plain_version(folded, plain):
    _, rows = boosting.boost(folded.rows, folded.cuts, [-1, 2], rounds=5, depth=2, staged_every=2)
    found = {r["hash"]: r["margin"] for r in rows.collect()}
    for k, fold in enumerate((-1, 2)):
        wanted = plain_boost(plain, 5, 2, folded.cuts.bins, fold)
        own = np.array([found[h][k] for h in plain.columns["hash"].tolist()])
        assert np.abs(own - wanted).max() < 1e-5


def test_boosting_of_folds_is_that_of_each(folded):
    together, _ = boosting.boost(folded.rows, folded.cuts, list(folded.folds), rounds=4)
    alone, _ = boosting.boost(folded.rows.repartition(4), folded.cuts, [3], rounds=4, staged_every=1)
    for (many, values), (one, value) in zip(together, alone, strict=True):
        own = many.select(np.array([3]))
        assert (own.feature == one.feature).all() and (own.cut == one.cut).all()
        assert (values[many.tree == 3] == value).all()


def test_boosted_trees_learn(table):
    model = models.boosted_trees(rounds=40).fit(table)
    assert metrics.scores(model.transform(table), "target", "prediction").first()["accuracy"] > 0.9


def plain_stumps(x, y, rounds, seen=None):
    """(feature, threshold, left, right) by loops; equal purities go to the first feature and value."""
    seen = np.ones(len(y), bool) if seen is None else seen
    w, out = seen.astype(float), []

    def odds(p, n):
        s = p / (p + n)
        return 0.5 * (math.log(max(s, 1e-15)) - math.log(max(1 - s, 1e-15)))

    for _ in range(rounds):
        q = np.floor(w * 2**24 + 0.5)
        best = (-1.0,)
        for f in range(x.shape[1]):
            values = np.unique(x[:, f])
            for v, following in zip(values[:-1], values[1:], strict=True):
                low = x[:, f] <= v
                lp, ln, rp, rn = (q[m & (y == c)].sum() for m in (low, ~low) for c in (1, 0))
                if lp + ln == 0 or rp + rn == 0:
                    continue
                purity = (lp * lp + ln * ln) / (lp + ln) + (rp * rp + rn * rn) / (rp + rn)
                if purity > best[0]:
                    best = (purity, f, (v + following) / 2, lp, ln, rp, rn)
        _, f, threshold, lp, ln, rp, rn = best
        left, right = odds(lp, ln), odds(rp, rn)
        out.append((f, threshold, left, right))
        vote = np.where(x[:, f] <= threshold, left, right)
        after = (lp * math.exp(-left) + ln * math.exp(left) + rp * math.exp(-right) + rn * math.exp(right)) / (lp + ln + rp + rn)
        w = w * np.exp(-(2 * y - 1) * vote) / after
    return out


def test_stumps_match_plain_ones_in_every_fold(folded):
    x, y = data()
    ranges = adaboost.range_table(folded.sparse, folded.cuts)
    rows = adaboost.weighted(folded.sparse, folded.cuts, [0, 1, 2, 3], "fold")
    found = adaboost.boost(rows, ranges, [0, 1, 2, 3], rounds=6, staged_every=4)
    fold = {r["key"]: r["fold"] for r in folded.sparse.collect()}
    fold = np.array([fold[i] for i in range(len(y))])
    for k in range(4):
        wanted = plain_stumps(x, y, 6, fold != k)
        for s, (f, threshold, left, right) in zip(found[k], wanted, strict=True):
            assert (s.feature, s.threshold) == (f, pytest.approx(threshold))
            assert (s.left, s.right) == (pytest.approx(left), pytest.approx(right))
    scores = selection.fold_scores(folded.sparse, found, [0, 1, 2, 3]).collect()
    for r in scores:
        own = sum(s.left if x[r["key"], s.feature] <= s.threshold else s.right for s in found[r["fold"]])
        assert r["score"] == pytest.approx(own)


def test_ranges_change_nothing(folded):
    """Running sums inside ranges are those of whole features."""
    rows = adaboost.weighted(folded.sparse, folded.cuts, [-1])
    ranges = adaboost.range_table(folded.sparse, folded.cuts)
    one = binned.Cuts(np.full((WIDTH, 1), np.inf))
    whole = adaboost.weighted(folded.sparse, one, [-1])
    a = adaboost.cuts_of(adaboost.with_units(rows, 1), 1, ranges).collect()
    b = adaboost.cuts_of(adaboost.with_units(whole, 1), 1, adaboost.range_table(folded.sparse, one)).collect()
    assert sorted(map(str, a)) == sorted(map(str, b)) and len(a) > 100


@pytest.mark.parametrize("share", [1.0, 0.4])
def test_histograms_from_entries_are_those_of_all_cells(plain, folded, share):
    rng = np.random.default_rng(1)
    rows = np.flatnonzero(rng.random(len(plain)) < share)
    node = rng.integers(0, 3, len(rows))
    sums = [trees.fixed(rng.normal(size=len(plain))), np.ones(len(plain))]
    assert len(plain.row) < plain.x.size
    got = trees._entry_sums(plain, rows, node, 3, sums, folded.cuts).reshape(2, 3, WIDTH, folded.cuts.bins)
    wanted = np.zeros_like(got)
    for k, s in enumerate(sums):
        for r, n in zip(rows, node, strict=True):
            wanted[k, n, np.arange(WIDTH), plain.x[r]] += s[r]
    assert (got == wanted).all()


def test_a_round_reads_few_ranges_and_finds_the_best_of_all_cuts(spark, folded):
    ranges = adaboost.range_table(folded.sparse, folded.cuts)
    rows = adaboost.weighted(folded.sparse, folded.cuts, [-1, 0, 1], "fold")
    extents = adaboost.Extents.of(rows, ranges)
    recent = [[], [], []]
    for _ in range(4):
        found = adaboost._best(rows, extents, recent, [0, 2])
        every = adaboost.cuts_of(adaboost.with_units(rows, 3, recent, [0, 2]), 2, ranges)
        best = {r["fold"]: r["cut"].asDict() for r in every.groupBy("fold").agg(F.max("cut").alias("cut")).collect()}
        assert found == [best[0], best[1]]
        for i, cut in zip([0, 2], found, strict=True):
            stump, _, after = adaboost._stump(cut, False)
            recent[i].append((stump, after))
    sums = adaboost.slot_sums(rows, recent, [0]).toArrow()
    few, _ = adaboost._open_ranges(sums, 1, extents)
    assert 0 < len(few) < len(extents.slot) / 2


def test_logistic_folds_match_single_fits_of_mllib(table, folded):
    fitted = logistic.fit_folds(folded.sparse, WIDTH, [-1, *folded.folds], "fold", strength=0.5)
    fold = folded.sparse.select(F.col("key").alias("post_id"), "fold")
    joined = table.join(fold, "post_id").cache()
    for k, held in enumerate(fitted.folds):
        seen = joined.filter(F.col("fold") != held)
        model = models.logistic_regression(seen.count(), 0.5).copy().setTol(1e-12).setMaxIter(500).fit(seen)
        own = [*model.coefficients.toArray(), model.intercept]
        assert np.abs(fitted.coefficients[k] - own).max() < 1e-4
    assert fitted.steps < 15


def test_logistic_in_small_pieces_and_groups(folded, monkeypatch):
    whole = logistic.fit_folds(folded.sparse, WIDTH, [0, 1], "fold")
    monkeypatch.setattr(logistic, "_PAIRS", 50)
    monkeypatch.setattr(logistic, "_WIDE", 1)
    small = logistic.fit_folds(folded.sparse.repartition(5), WIDTH, [0, 1], "fold")
    assert np.abs(whole.coefficients - small.coefficients).max() < 1e-9


def test_cross_validation_of_all_models(folded, monkeypatch):
    few = {"decision tree": decision_tree(3), "random forest": Setting(8)}
    monkeypatch.setattr(selection, "compared_forests", lambda: few)
    monkeypatch.setattr(selection, "adaboost_counts", lambda d, f=selection.adaboost_counts: f(d, rounds=5))
    monkeypatch.setattr(selection, "boosted_counts", lambda d, f=selection.boosted_counts: f(d, rounds=10))
    found = {r["estimator"]: r["mean_recall"] for r in selection.cross_validated(folded).collect()}
    assert set(found) == {"logistic regression", "adaboost", "gradient boosting", *few}
    # better than a guess by the share of the class
    assert all(recall > 0.7 for recall in found.values())


def test_registered_settings_are_the_whole_job():
    settings = forests.settings_of()
    assert len(settings) == len(set(settings)) == 288
    assert len(selection.compared_forests()) == 5
    assert models.boosted_trees().settings()["rounds"] == 100
    assert adaboost.AdaBoost().getOrDefault("rounds") == 50


def of_trees(grown):
    """Trees as nested tuples: nodes are numbered differently where trees grow beside each other."""
    g = grown.grove

    def node(i):
        sums = tuple(g.sums[i])
        return (sums,) if g.feature[i] < 0 else (sums, int(g.feature[i]), int(g.cut[i]), node(g.left[i]), node(g.left[i] + 1))

    return [node(i) for i in g.root]


def test_a_table_held_by_a_task_gives_the_same_models(folded, monkeypatch):
    settings = [Setting(5), Setting(4, "entropy", 3, 3, 10), decision_tree(4), decision_tree()]

    def everything():
        trees_ = [of_trees(g) for g in forests.grow_settings(folded.rows, folded.cuts, settings, [-1, *folded.folds])]
        counts = [
            selection.adaboost_counts(folded, rounds=6),
            selection.adaboost_counts(folded, rounds=6, algorithm=adaboost.BY_CLASS),
            selection.boosted_counts(folded, rounds=12, depth=2),
        ]
        return trees_, [sorted(map(tuple, c.collect())) for c in counts]

    held = everything()
    monkeypatch.setattr(binned, "HELD_CELLS", 0)
    monkeypatch.setattr(trees, "_WIDE", 1)
    dealt = everything()
    assert held == dealt
    assert len(held[1][0]) and max(len(str(t)) for t in held[0][0]) > 500


def test_stumps_of_a_held_table_are_those_of_the_rounds(spark, folded):
    own = folded.sparse.select("y", "fold", "entries")
    found = adaboost.held_stumps(spark, binned.held(own, WIDTH, F.size("entries")), [-1, *folded.folds], rounds=8)
    rows = adaboost.weighted(folded.sparse, folded.cuts, [-1, *folded.folds], "fold")
    wanted = adaboost.boost(rows, adaboost.range_table(folded.sparse, folded.cuts), [-1, *folded.folds], rounds=8)
    assert [[(s.feature, s.threshold) for s in own] for own in found] == [[(s.feature, s.threshold) for s in own] for own in wanted]
    for one, other in zip(found, wanted, strict=True):
        assert np.allclose([(s.left, s.right) for s in one], [(s.left, s.right) for s in other], atol=1e-12)


def test_folds_of_a_small_table_are_fitted_in_few_jobs(spark, folded):
    """A job per level, round and fold took most of the time of a cross-validation of small tables."""
    context = spark.sparkContext
    context.setJobGroup("folds", "folds")
    forests.grow_settings(folded.rows, folded.cuts, [Setting(20), decision_tree(5)], folded.folds)
    selection.adaboost_counts(folded).collect()
    selection.boosted_counts(folded).collect()
    jobs = context.statusTracker().getJobIdsForGroup("folds")
    context.setLocalProperty("spark.jobGroup.id", None)
    assert len(jobs) < 40


def test_larger_tables_are_not_held(folded, monkeypatch):
    assert binned.held_rows(folded.rows, folded.cuts) is not None
    assert binned.held_rows(folded.rows.limit(0), folded.cuts) is None
    monkeypatch.setattr(binned, "HELD_ENTRIES", 10)
    assert binned.held_rows(folded.rows, folded.cuts) is None
