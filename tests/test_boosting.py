"""Histogram booster against plain numpy; attributions against Shapley values by definition."""
import itertools
import math

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from trustlens.ml import attribution as AT
from trustlens.ml import boosting as B
from trustlens.ml import pipeline as PL


def frame(spark, x, label, fold=None):
    fold = [None] * len(x) if fold is None else fold
    rows = [(i, [float(v) for v in r], int(y), None if f is None else int(f)) for i, (r, y, f) in enumerate(zip(x, label, fold, strict=True))]
    df = spark.createDataFrame(rows, "respondent_id long, x array<double>, label int, fold int").repartition(3)
    return df.withColumn("features", array_to_vector("x")).drop("x")


def problem(n=900, d=5, classes=2, seed=0):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, d)), 1)
    x[:, 1] = rng.integers(0, 3, n)
    s = x[:, 0] * (x[:, 1] - 1) + 0.5 * x[:, 2] + rng.normal(scale=0.3, size=n)
    return x, np.digitize(s, np.quantile(s, [i / classes for i in range(1, classes)]))


def brute_tree(bins, g, h, columns, edges, s, depth=0, rows=None):
    """One tree by trying every split of every node."""
    rows = np.arange(len(bins)) if rows is None else rows
    gs, hs = g[rows].sum(), h[rows].sum()
    best = (B.LEAST_GAIN, None, None)
    if depth < s.depth:
        for f in columns:
            for c in range(len(edges[f]) - 1):
                left = rows[bins[rows, f] <= c]
                gl, hl = g[left].sum(), h[left].sum()
                if hl < s.least_curvature or hs - hl < s.least_curvature:
                    continue
                gain = gl ** 2 / (hl + s.ridge) + (gs - gl) ** 2 / (hs - hl + s.ridge) - gs ** 2 / (hs + s.ridge)
                if gain > best[0] * (1 + 1e-9):
                    best = (gain, f, c)
    out = np.zeros(len(bins))
    if best[1] is None:
        out[rows] = -s.step * gs / (hs + s.ridge)
        return out
    right = bins[rows, best[1]] > best[2]
    return out + brute_tree(bins, g, h, columns, edges, s, depth + 1, rows[~right]) + brute_tree(bins, g, h, columns, edges, s, depth + 1, rows[right])


@pytest.mark.parametrize("classes", [2, 4])
def test_margins_equal_plain_boosting(spark, classes):
    x, y = problem(classes=classes)
    s = B.BoostSettings(rounds=3, depth=3, step=0.3, row_share=0.7, column_share=0.6, max_bins=24, seed=5)
    model = B.fit_boosted(frame(spark, x, y), x.shape[1], classes, 0, s)[0]
    edges = model.edges
    bins = B.to_bins(x, edges)
    margin = np.zeros((len(x), 1, 1 if classes == 2 else classes))
    for t in range(s.rounds):
        g, h = B.derivatives(margin.astype(np.float32).astype(float), y)
        columns = B.columns_of_trees(x.shape[1], 1, margin.shape[2], t, s)
        for k in range(margin.shape[2]):
            taken = B.drawn(np.arange(len(x)), s.row_share, s.seed, t, k)
            assert 0.6 < taken.mean() < 0.8
            grown = brute_tree(bins, g[:, 0, k] * taken, h[:, 0, k] * taken, columns[0, k], edges, s)
            margin[:, 0, k] += grown
    assert np.allclose(model.margins(x), margin[:, 0], atol=1e-5)


def test_bins_of_few_and_many_values(spark):
    rng = np.random.default_rng(1)
    x = np.stack([rng.integers(0, 4, 500), np.round(rng.exponential(size=500), 2)], axis=1).astype(float)
    table = B.bin_table(frame(spark, x, np.zeros(500)), vector_to_array("features"), 10)
    edges = B.edges_of(table, 2)
    assert edges[0].tolist() == [0, 1, 2, 3]
    v = np.sort(x[:, 1])
    upto = {u: (v <= u).sum() for u in np.unique(v)}
    before, want = 0, []
    for u, n in upto.items():
        if n * 10 // 500 > before * 10 // 500:
            want.append(u)
        before = n
    assert edges[1].tolist() == want and table.agg(F.sum("n")).first()[0] == 1000
    assert B.to_bins(np.array([[9.0, np.nan], [-1.0, -1.0]]), edges).tolist() == [[3, len(want) - 1], [0, 0]]


def test_sums_by_shuffle_and_by_driver_agree(spark, monkeypatch):
    x, y = problem(classes=3)
    df, s = frame(spark, x, y).persist(), B.BoostSettings(rounds=2, depth=4)
    direct = B.fit_boosted(df, 5, 3, 0, s)[0].margins(x)
    monkeypatch.setattr(B, "DIRECT_BYTES", 0)
    assert np.allclose(B.fit_boosted(df, 5, 3, 0, s)[0].margins(x), direct, atol=1e-6)


def test_fold_models_do_not_see_their_fold(spark):
    x, y = problem(n=600)
    fold = np.arange(600) % 3
    s = B.BoostSettings(rounds=12, depth=2, row_share=1.0, column_share=1.0, step=0.3)  # crosses a checkpoint
    models = B.fit_boosted(frame(spark, x, y, fold), 5, 2, 3, s)
    assert len(models) == 4
    edges, bins = models[0].edges, B.to_bins(x, models[0].edges)
    for f, model in enumerate(models):
        margin = np.zeros((600, 1, 1))
        keep = fold != f
        for _ in range(s.rounds):
            g, h = B.derivatives(margin.astype(np.float32).astype(float), y)
            margin[:, 0, 0] += brute_tree(bins, g[:, 0, 0] * keep, h[:, 0, 0] * keep, range(5), edges, s)
        assert np.allclose(model.margins(x), margin[:, 0], atol=1e-4)


def test_checkpoints_do_not_pile_up(spark, monkeypatch):
    import os
    monkeypatch.setattr(B, "CHECKPOINT_ROUNDS", 2)
    folder = B.ensure_checkpoint_dir(spark).removeprefix("file:")
    held = lambda: {d for d in os.listdir(folder) if d.startswith("rdd-")}
    before, seen = held(), []
    grow = B.grow_level
    monkeypatch.setattr(B, "grow_level", lambda *a: (seen.append(len(held() - before)), grow(*a))[1])
    x, y = problem(n=300)
    model = B.fit_boosted(frame(spark, x, y), 5, 2, 0, B.BoostSettings(rounds=9, depth=2))[0]
    assert len(model.rounds) == 9 and max(seen) == 1 and held() == before


def test_predictions_probabilities_and_saved_model(spark, tmp_path):
    for classes in (2, 3):
        x, y = problem(n=1500, classes=classes, seed=4)
        df = frame(spark, x, y)
        model = B.fit_boosted(df.where("respondent_id < 1000"), 5, classes, 0, B.BoostSettings(rounds=40, depth=4, step=0.2))[0]
        got = model.transform(df).select("respondent_id", "label", "prediction", vector_to_array("probability").alias("p")).toPandas().sort_values("respondent_id")
        p = np.stack(got.p)
        m = model.margins(x)
        want = np.exp(m) / np.exp(m).sum(axis=1, keepdims=True) if classes > 2 else np.concatenate([1 / (1 + np.exp(m)), 1 / (1 + np.exp(-m))], axis=1)
        assert np.allclose(p, want) and (got.prediction == p.argmax(axis=1)).all()
        unseen = got[got.respondent_id >= 1000]
        assert (unseen.prediction == unseen.label).mean() > 0.5 + 0.6 / classes  # the most common class: 1 / classes
        assert model.importance().sum() == pytest.approx(1) and model.importance()[3:].max() < 0.1
        model.save(spark, str(tmp_path / f"m{classes}"))
        assert np.array_equal(B.BoostedModel.load(spark, str(tmp_path / f"m{classes}")).margins(x), m)


def test_root_sums(spark):
    x, y = problem(classes=3)
    s = B.BoostSettings(row_share=1.0, column_share=1.0, max_bins=8)
    got = B.root_sums(frame(spark, x, y), 5, 3, s).toPandas()
    edges = B.edges_of(B.bin_table(frame(spark, x, y), vector_to_array("features"), 8), 5)
    bins = B.to_bins(x, edges)
    for r in got.itertuples():
        at = bins[:, r.feature] == r.bin
        k = getattr(r, "_1")
        assert r.gradient == pytest.approx((1 / 3 - (y[at] == k)).sum()) and r.curvature == pytest.approx(at.sum() * 4 / 9)


def test_one_class_and_constant_columns(spark):
    x = np.ones((50, 2))
    model = B.fit_boosted(frame(spark, x, np.ones(50)), 2, 2, 0, B.BoostSettings(rounds=5))[0]
    assert (model.margins(x) > 0).all() and model.importance().tolist() == [0, 0]


def expectation(tree, x, known, node=0):
    """The tree's mean value when only the features ``known`` are given."""
    if tree["left"][node] < 0:
        return tree["value"][node]
    a, b, f = tree["left"][node], tree["right"][node], tree["feature"][node]
    if f in known:
        return expectation(tree, x, known, a if x[f] <= tree["threshold"][node] else b)
    return sum(expectation(tree, x, known, c) * tree["cover"][c] for c in (a, b)) / tree["cover"][node]


@pytest.mark.parametrize("depth", [1, 3, 6])
def test_attributions_are_shapley_values(spark, depth):
    x, y = problem(n=400, classes=2, seed=depth)
    model = B.fit_boosted(frame(spark, x, y), 5, 2, 0, B.BoostSettings(rounds=3, depth=depth, step=0.5, least_curvature=0.2))[0]
    for tree in model.tree_arrays():
        table, phi = AT.leaf_table(tree), np.zeros((8, 5))
        base = AT.tree_shap(x[:8], table, phi)
        assert base == pytest.approx(expectation(tree, None, ()))
        for r in range(8):
            for i in range(5):
                others = [j for j in range(5) if j != i]
                want = sum(math.factorial(k) * math.factorial(4 - k) / math.factorial(5)
                           * (expectation(tree, x[r], {*c, i}) - expectation(tree, x[r], set(c)))
                           for k in range(5) for c in itertools.combinations(others, k))
                assert phi[r, i] == pytest.approx(want, abs=1e-9)


def test_deep_forest_attributions_add_up(spark):
    from pyspark.ml.classification import RandomForestClassifier
    x, y = problem(n=2000, d=8, seed=7)
    df = frame(spark, x, y)
    rf = RandomForestClassifier(numTrees=20, maxDepth=12, minInstancesPerNode=1, seed=1).fit(df)
    shap = AT.tree_attribution(df, rf, "forest", [f"f{i}" for i in range(8)]).toPandas().set_index("respondent_id").sort_index()
    p = rf.transform(df).select("respondent_id", vector_to_array("probability")[1].alias("p")).toPandas().set_index("respondent_id").sort_index()
    assert np.allclose(shap.sum(axis=1), p.p, atol=1e-8)


def test_fold_scalers(spark):
    rng = np.random.default_rng(2)
    x, fold = rng.normal(3, 2, size=(400, 3)), rng.integers(0, 4, 400)
    x[:, 2] = 7
    table = PL.fold_scalers(frame(spark, x, np.zeros(400), fold), vector_to_array("features"), 4).toPandas()
    for r in table.itertuples():
        rest = x[fold != r.fold, r.feature]
        assert (r.n, r.mean, r.std) == (len(rest), pytest.approx(rest.mean()), pytest.approx(rest.std(ddof=1), abs=1e-6))
    moved = frame(spark, x[:5], np.zeros(5)).select("respondent_id", vector_to_array(PL.rescaled("features", [1, 2, 7], [2, 4, 0])).alias("v")).toPandas()
    assert np.allclose(np.stack(moved.sort_values("respondent_id").v), (x[:5] - [1, 2, 7]) * [0.5, 0.25, 0])


def test_bundles_give_the_sums_of_every_bin():
    rng = np.random.default_rng(3)
    sizes = [2, 200, 5, 2, 1, 7, 5, 2, 61]
    bins = np.stack([rng.integers(0, n, 400) for n in sizes], axis=1).astype(np.uint8)
    bundles = B.Bundles.of(sizes)
    assert sorted(j for own in bundles.members for j in own) == list(range(len(sizes)))
    assert len(bundles.members) < len(sizes)  # fewer columns to count
    *starts, cells = bundles.starts()
    value = rng.integers(0, 9, 400).astype(float)
    code = bundles.codes(bins) + np.array(starts)
    found = bundles.marginals(np.bincount(code.ravel(), np.repeat(value, len(starts)), cells)[None])[0]
    plain = np.concatenate([np.bincount(bins[:, j], value, n) for j, n in enumerate(sizes)])
    assert found.tolist() == plain.tolist()


def test_one_child_of_a_split_is_summed_and_the_other_follows(spark, monkeypatch):
    x, y = problem(classes=3)
    df, s = frame(spark, x, y), B.BoostSettings(rounds=3, depth=4, step=0.3)
    seen, grow = [], B.grow_level

    def watched(blocks, at, above):
        found, sums = grow(blocks, at, above)
        if sums:
            key = (0, 0)
            every = dict(B.level_sums(blocks.collect(), B.replace(at, slot=B.slots(B.open_nodes(at.growing, at.level)))))
            seen.append(B.lighter(at.growing, at.level)[key].sum() * 2 == B.open_nodes(at.growing, at.level)[key].sum())
            there = B.open_nodes(at.growing, at.level)[key]
            assert sums[key][:, there].ravel().tolist() == every[key].ravel().tolist()
        return found, sums

    monkeypatch.setattr(B, "grow_level", watched)
    direct = B.fit_boosted(df, 5, 3, 0, s)[0].margins(x)
    assert sum(seen) == 9  # every level but the first of each round
    monkeypatch.setattr(B, "grow_level", grow)
    monkeypatch.setattr(B, "DIRECT_BYTES", 0)
    assert B.fit_boosted(df, 5, 3, 0, s)[0].margins(x).tolist() == direct.tolist()


@pytest.mark.parametrize("classes", [2, 3])
def test_rows_dealt_to_nodes_give_the_trees_of_levels(spark, monkeypatch, classes):
    x, y = problem(n=2100, classes=classes, seed=2)
    df, s = frame(spark, x, y, np.arange(2100) % 2).persist(), B.BoostSettings(rounds=3, depth=5, step=0.3)
    grow, levels, found = B.grow_level, [], []
    monkeypatch.setattr(B, "grow_level", lambda blocks, at, above: (levels.append(at.level), grow(blocks, at, above))[1])
    for aim, room in ((1 << 13, 1 << 26), (600, 1 << 26), (1 << 13, 0)):
        monkeypatch.setattr(B, "NODE_ROWS", aim)
        monkeypatch.setattr(B, "DEALT_BYTES", room)
        levels.clear()
        found.append(B.fit_boosted(df, 5, classes, 2, s))
        assert levels == 3 * list(range({(1 << 13, 1 << 26): 1, (600, 1 << 26): 2, (1 << 13, 0): 5}[aim, room]))
    for models in zip(*found):
        for rounds in zip(*(m.rounds for m in models)):
            for name in ("feature", "cut", "value", "cover", "gain"):
                first, *others = (getattr(r, name).tolist() for r in rounds)
                assert all(o == first for o in others), name
    assert (found[0][0].rounds[0].feature[0, 0, 7:] >= 0).any()


@pytest.mark.parametrize("classes", [2, 3])
def test_models_grown_whole_give_the_trees_of_rounds_in_one_job(spark, monkeypatch, classes):
    x, y = problem(n=2100, classes=classes, seed=6)
    df, s = frame(spark, x, y, np.arange(2100) % 2).persist(), B.BoostSettings(rounds=4, depth=5, step=0.3)
    by_rounds = B.fit_boosted(df, 5, classes, 2, s)
    monkeypatch.setattr(B, "grow_level", None)  # no round has a job of its own
    for f, (model, want) in enumerate(zip(B.fit_boosted(df, 5, classes, 2, s, B.TASK_BYTES), by_rounds, strict=True)):
        assert len(model.rounds) == s.rounds, f
        for got, then in zip(model.rounds, want.rounds, strict=True):
            for name in ("feature", "cut", "value", "cover", "gain"):
                assert getattr(got, name).tolist() == getattr(then, name).tolist(), (f, name)
    assert (by_rounds[0].rounds[0].feature[0, 0, 7:] >= 0).any()


def test_models_without_rows_or_splits_are_grown_whole_too(spark):
    x = np.ones((50, 2))
    s = B.BoostSettings(rounds=3)
    whole = B.fit_boosted(frame(spark, x, np.ones(50), np.zeros(50)), 2, 2, 1, s, B.TASK_BYTES)
    for model, want in zip(whole, B.fit_boosted(frame(spark, x, np.ones(50), np.zeros(50)), 2, 2, 1, s), strict=True):
        assert model.margins(x).tolist() == want.margins(x).tolist()
    assert (whole[1].margins(x) > 0).all() and not whole[0].margins(x).any()  # every row lies in the first model's fold
    x, y = problem(n=300)
    df, s = frame(spark, x, y).persist(), B.BoostSettings(rounds=3, depth=3)
    whole, want = (B.fit_boosted(df, 5, 3, 0, s, room)[0] for room in (B.TASK_BYTES, 0))  # the third class has no row
    assert whole.margins(x).tolist() == want.margins(x).tolist()
    assert (whole.rounds[0].feature[0, 2] < 0).all() and (whole.rounds[0].feature[0, 0, :3] >= 0).all()
