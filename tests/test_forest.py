"""Forest grown by tasks: against trying every split, against Spark's forest, and in the classifier."""
import numpy as np
import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from trustlens import schema as S
from trustlens.ml import attribution as AT
from trustlens.ml import forest as FO
from trustlens.ml import models as MD
from trustlens.ml.boosting import BoostSettings


def problem(n=1200, d=6, classes=2, seed=0):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, d)), 1)
    x[:, 1] = rng.integers(0, 3, n)
    s = x[:, 0] * (x[:, 1] - 1) + 0.5 * x[:, 2] + rng.normal(scale=0.3, size=n)
    return x, np.digitize(s, np.quantile(s, [i / classes for i in range(1, classes)]))


def frame(spark, x, label, fold=None, parts=3):
    fold = [None] * len(x) if fold is None else fold
    rows = [(i, [float(v) for v in r], float(y), None if f is None else int(f), 1.0 + float(y) / 2) for i, (r, y, f) in enumerate(zip(x, label, fold, strict=True))]
    df = spark.createDataFrame(rows, "respondent_id long, x array<double>, label double, fold int, weight double").repartition(parts)
    return df.withColumn("features", array_to_vector("x")).drop("x")


def held(spark, df, d, classes):
    return spark.sparkContext.broadcast(FO.packed_rows(df, d, classes, 32))


def estimator(**how):
    return RandomForestClassifier(weightCol="weight", **({"numTrees": 12, "maxDepth": 6, "minInstancesPerNode": 5, "seed": 3} | how))


def gini(counts):
    return 1 - ((counts / counts.sum()) ** 2).sum()


@pytest.mark.parametrize("classes", [2, 4])
def test_tree_equals_trying_every_split(classes):
    rng = np.random.default_rng(classes)
    x = rng.integers(0, 20, 500)
    y = np.digitize(np.abs(x - 9) + rng.normal(size=500), np.linspace(2, 8, classes - 1))
    w = np.linspace(1, 2, classes)
    rows = FO.ForestRows(x[:, None].astype(np.uint8), y.astype(np.int16), np.arange(500).astype(np.int8) % 5, w, [np.arange(20.0)])
    how = {"seed": 7, "min_leaf": 5, "depth": 4}
    tree = FO.grow_tree(rows, 2, 1, how)
    drawn = np.random.default_rng([7, 2 - FO.ALL, 1]).poisson(1.0, 500) * (rows.fold != 2)

    def grown(mine, depth):
        """Nested (cut, left, right), or the counts of a leaf."""
        counts = np.bincount(y[mine], drawn[mine], classes)
        best = (FO.LEAST_GAIN, None)
        for cut in range(19) if depth else ():
            a, b = mine & (x <= cut), mine & (x > cut)
            if min(drawn[a].sum(), drawn[b].sum()) >= 5:
                ca, cb = (np.bincount(y[i], drawn[i], classes) * w for i in (a, b))
                gain = gini(counts * w) - (ca.sum() * gini(ca) + cb.sum() * gini(cb)) / (counts * w).sum()
                if gain > best[0] + 1e-12:
                    best = (gain, cut)
        if best[1] is None:
            return counts.tolist()
        a, b = grown(mine & (x <= best[1]), depth - 1), grown(mine & (x > best[1]), depth - 1)
        if isinstance(a, list) and isinstance(b, list) and (a * w).argmax() == (b * w).argmax():
            return counts.tolist()
        return best[1], a, b

    def told(i):
        return (int(tree.cut[i]), told(tree.left[i]), told(tree.right[i])) if tree.feature[i] >= 0 else tree.counts[i].tolist()

    assert told(0) == grown(np.ones(500, bool), 4) and len(tree.feature) > 5
    assert (tree.left[tree.feature >= 0] > np.flatnonzero(tree.feature >= 0)).all()


@pytest.mark.parametrize("classes", [2, 3])
def test_model_agrees_with_spark_s_model_of_the_same_trees(spark, classes):
    x, y = problem(classes=classes)
    df = frame(spark, x, y)
    model = FO.fit_forest(spark, held(spark, df, 6, classes), estimator())
    other = FO.fit_forest(spark, held(spark, frame(spark, x, y, parts=5), 6, classes), estimator())
    assert all(a.counts.tolist() == b.counts.tolist() for a, b in zip(model.trees, other.trees, strict=True))  # however rows lie
    assert len({tuple(t.counts.ravel()) for t in model.trees}) == 12
    theirs = model.as_spark(spark)
    assert theirs.getNumTrees == 12 and theirs.totalNumNodes == sum(len(t.feature) for t in model.trees)
    pick = lambda m: m.transform(df).select("respondent_id", "prediction", vector_to_array("probability").alias("p"), vector_to_array("rawPrediction").alias("r")).toPandas().sort_values("respondent_id")
    a, b = pick(model), pick(theirs)
    assert (a.prediction == b.prediction).all() and np.allclose(np.stack(a.p), np.stack(b.p)) and np.allclose(np.stack(a.r), np.stack(b.r))
    assert np.allclose(model.importance(), theirs.featureImportances.toArray())
    if classes == 2:
        shap = [AT.tree_attribution(df, m, "forest", [f"f{i}" for i in range(6)]).toPandas().sort_values("respondent_id").to_numpy() for m in (model, theirs)]
        assert np.allclose(*shap)


def test_forest_is_as_good_as_spark_s(spark):
    x, y = problem(n=4000, classes=3, seed=5)
    df = frame(spark, x, y).persist()
    train, test = df.where("respondent_id < 3000"), df.where("respondent_id >= 3000")
    right = lambda m: m.transform(test).where("label = prediction").count() / 1000
    est = estimator(numTrees=40, maxDepth=10)
    mine, theirs = FO.fit_forest(spark, held(spark, train, 6, 3), est), est.fit(train)
    assert abs(right(mine) - right(theirs)) < 0.03 and right(mine) > 0.7
    assert 0.8 < sum(len(t.feature) for t in mine.trees) / theirs.totalNumNodes < 1.25


def test_fold_forests_do_not_see_their_fold(spark):
    x, y = problem(n=900, classes=3)
    fold = np.arange(900) % 3
    said = []
    for labels in (y, np.where(fold == 1, (y + 1) % 3, y)):
        got = FO.fold_predictions(spark, held(spark, frame(spark, x, labels, fold), 6, 3), estimator(), 1).toPandas()
        assert len(got) == 300
        said.append(got.prediction.value_counts().to_dict())
        if labels is y:
            assert (got.label == got.prediction).mean() > 0.6
    assert said[0] == said[1]


def test_rows_without_splits_or_of_one_id(spark):
    flat = frame(spark, np.ones((40, 2)), np.arange(40) % 2)
    model = FO.fit_forest(spark, held(spark, flat, 2, 2), estimator())
    assert all(len(t.feature) == 1 for t in model.trees) and model.importance().tolist() == [0, 0]
    x, y = problem(n=300)
    same = [frame(spark, x, y, parts=p).withColumn("respondent_id", F.lit(1).cast("long")) for p in (1, 4)]
    a, b = (FO.fit_forest(spark, held(spark, df, 6, 2), estimator()) for df in same)
    assert [t.counts.tolist() for t in a.trees] == [t.counts.tolist() for t in b.trees]


@pytest.mark.parametrize("room", [FO.FOREST_BYTES, 0])
def test_classifier_grows_its_forests_by_tasks_while_the_rows_fit(spark, resp_small, monkeypatch, tmp_path, room):
    from trustlens.ml import store
    fits, fit = [], RandomForestClassifier._fit
    monkeypatch.setattr(RandomForestClassifier, "_fit", lambda self, df: (fits.append(1), fit(self, df))[1])
    monkeypatch.setattr(FO, "FOREST_BYTES", room)
    monkeypatch.setattr(store, "scratch_path", lambda s, name: str(tmp_path / name))
    small = MD.ModelSettings(lr_max_iter=20, rf_trees=15, rf_depth=5, cv_folds=2, boost=BoostSettings(rounds=2, depth=2))
    res = MD.train_classifier(resp_small, S.FRAUD_TARGET, small)
    assert len(fits) == (0 if room else 3)
    row = res["metrics"].where("model = 'Random Forest'").first()
    assert 0 < row["auc_roc"] <= 1 and 0 < row["cv_accuracy_mean"] <= 1  # 30 test rows
    pred = res["predictions"]["Random Forest"]
    assert "Parquet" in pred._jdf.queryExecution().toString() and "Project" not in pred._jdf.queryExecution().executedPlan().toString()  # written once
    store.publish_classifier(spark, "fraud", res | {"best_model_name": "Random Forest"}, "s")
    key = lambda df: {r["respondent_id"]: r["prediction"] for r in df.select("respondent_id", "prediction").collect()}
    assert key(store.load(spark, "fraud").transform(res["frame"])) == key(res["fitted"]["Random Forest"].transform(res["data"]))
    assert len(MD.feature_importance(res["fitted"]["Random Forest"], res["features"])) == 20
