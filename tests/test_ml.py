"""ML invariants: split, folds, metrics, forest share, attribution additivity."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from trustlens import schema as S
from trustlens.ml import anomaly as AN
from trustlens.ml import attribution as AT
from trustlens.ml import cluster as CL
from trustlens.ml import metrics as M
from trustlens.ml import pipeline as PL


def test_split_keeps_class_shares(spark, resp_small):
    df = resp_small.select("respondent_id", F.col(S.FRAUD_TARGET).alias("label"))
    s = PL.stratified_split(df, "label", 0.2, 42)
    got = {r["label"]: (r["n"], r["t"]) for r in
           s.groupBy("label").agg(F.count("*").alias("n"), F.sum("is_test").alias("t")).collect()}
    for n, t in got.values():
        assert t == int(np.floor(n * 0.2 + 0.5))


def test_folds_disjoint_complete_balanced(spark, resp_small):
    df = resp_small.select("respondent_id", F.col(S.TRUST_TARGET).alias("label"))
    f = PL.stratified_kfold(df, "label", 5, 7)
    assert f.count() == df.count() and f.select("respondent_id").distinct().count() == df.count()
    per = f.groupBy("label", "fold").count().groupBy("label").agg(
        (F.max("count") - F.min("count")).alias("spread"), F.countDistinct("fold").alias("k"))
    for r in per.collect():
        assert r["spread"] <= 1


def test_rank_within_class_is_a_permutation(spark, resp_small):
    df = resp_small.select("respondent_id", F.col("region").alias("c"))
    r = PL.rank_within_class(df, "c", seed=3)
    chk = r.groupBy("c").agg(F.min("_rank").alias("lo"), F.max("_rank").alias("hi"),
                             F.countDistinct("_rank").alias("k"), F.first("_n").alias("n"))
    for row in chk.collect():
        assert row["lo"] == 0 and row["hi"] == row["n"] - 1 and row["k"] == row["n"]


def test_auc_of_shuffled_labels_near_half(spark):
    df = spark.range(20000).select(
        (F.col("id") * 48271 % 2147483647 / 2147483647.0).alias("score"),
        ((F.col("id") * 69621 % 2147483647) % 2).cast("double").alias("label"))
    auc = M.auc_roc(df, "score", "label", 1.0).first()["auc_roc"]
    assert abs(auc - 0.5) < 0.02
    p = df.toPandas()
    ranks = p.score.rank()
    pos = (p.label == 1).sum()
    exact = (ranks[p.label == 1].sum() - pos * (pos + 1) / 2) / (pos * (len(p) - pos))
    assert abs(auc - exact) < 1e-4


def test_split_is_spread_over_the_ids_and_differs_by_seed(spark):
    df = spark.range(1, 3001).select(F.col("id").alias("respondent_id"), (F.col("id") % 3).alias("label"))
    tests = {}
    for seed in (42, 43):
        t = PL.stratified_split(df, "label", 0.2, seed).where("is_test = 1").toPandas()
        assert len(t) == 600 and set(t.label.value_counts()) == {200}
        assert abs(t.respondent_id.mean() - 1500.5) < 100  # about three standard errors
        tests[seed] = set(t.respondent_id)
    assert 60 < len(tests[42] & tests[43]) < 190
    folds = PL.stratified_kfold(df, "label", 5, 42).groupBy("fold").agg(F.avg("respondent_id").alias("m")).toPandas()
    assert (abs(folds.m - 1500.5) < 120).all()


def test_auc_perfect_and_metrics(spark):
    df = spark.createDataFrame([(float(i), float(i >= 5), float(i >= 5)) for i in range(10)],
                               "score double, label double, prediction double")
    assert M.auc_roc(df, "score", "label", 1.0).first()["auc_roc"] == 1.0
    m = M.class_metrics(df).first()
    assert (m["accuracy"], m["f1"], m["precision"], m["recall"]) == (1.0, 1.0, 1.0, 1.0)


def test_isolation_forest_flags_contamination_share(spark, resp_small):
    scaled = CL.scaled_features(resp_small)
    res = AN.isolation_forest(scaled, S.CLUSTER_FEATURES, AN.ForestSettings(trees=50))
    n = res["n"]
    flagged = res["scores"].where("is_anomaly").count()
    assert abs(flagged / n - 0.08) <= 0.01 + 1.0 / n
    s = AN.anomaly_summary(res["scores"]).collect()
    assert sum(r["count"] for r in s) == n


def test_kmeans_same_seed_same_result(spark, resp_small):
    scaled = CL.scaled_features(resp_small)
    a, b = (CL.fit_shared(scaled, [(4, 2, 20)])[0] for _ in range(2))
    assert a.cost == pytest.approx(b.cost) and np.allclose(a.centres, b.centres)


def test_shared_fits_reach_the_cost_of_single_fits(spark):
    from pyspark.ml.clustering import KMeans
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(c, 0.6, size=(n, 3)) for c, n in (((0, 0, 0), 500), ((3, 0, 1), 300), ((0, 4, 0), 80), ((2, 2, 5), 20))])
    df = points(spark, x)
    fits = CL.fit_shared(df, [(k, 10, 300) for k in (2, 3, 4, 5)])
    for k, model in zip((2, 3, 4, 5), fits):
        single = min(KMeans(k=k, seed=s, maxIter=300, featuresCol="features").fit(df).summary.trainingCost for s in range(5))
        far = ((x[:, None, :] - model.centres) ** 2).sum(axis=2)
        assert model.cost == pytest.approx(far.min(axis=1).sum()) and model.cost <= single * 1.001
        got = model.transform(df).select("respondent_id", "cluster_id").toPandas().sort_values("respondent_id")
        assert (got.cluster_id.to_numpy() == far.argmin(axis=1)).all()


def test_kmeans_of_fewer_rows_than_centres(spark):
    model = CL.fit_shared(points(spark, np.array([[1.0, 2.0], [1.0, 2.0]])), [(4, 3, 10)])[0]
    assert model.cost == 0 and CL.fit_shared(points(spark, np.array([[5.0]])), [(1, 1, 5)])[0].centres.tolist() == [[5.0]]
    with pytest.raises(ValueError):
        CL.fit_shared(points(spark, np.array([[5.0]])).where("false"), [(1, 1, 5)])


def points(spark, x):
    from pyspark.ml.functions import array_to_vector
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "respondent_id long, x array<double>").repartition(3).withColumn("features", array_to_vector("x"))


@pytest.mark.parametrize("limit", [40, 500])
def test_silhouette_by_definition(spark, limit):
    rng = np.random.default_rng(0)
    x = np.round(rng.normal(size=(90, 3)), 1)
    x[5] = x[4]
    labels = {"a": rng.integers(0, 3, 90), "b": np.zeros(90, int), "c": np.arange(90) // 2}
    labels["a"][7] = 9  # a cluster of one row
    df = points(spark, x)
    for name, v in labels.items():
        df = df.withColumn(name, F.element_at(F.array(*[F.lit(int(i)) for i in v]), (F.col("respondent_id") + 1).cast("int")))
    got = CL.silhouette_rows(df, ["a", "b", "c"], F.col("x"), limit).toPandas().set_index("respondent_id")
    taken = np.array(sorted(got.index))
    assert len(taken) == min(limit, 90)
    far = np.sqrt(((x[:, None] - x) ** 2).sum(axis=2))
    for i in taken:
        for name, v in labels.items():
            own = [j for j in taken if v[j] == v[i] and j != i]
            rest = [np.mean([far[i, j] for j in taken if v[j] == c]) for c in set(v[taken]) - {v[i]}]
            want = 0.0
            if own and rest:
                a, b = np.mean(far[i, own]), min(rest)
                want = (b - a) / max(a, b) if max(a, b) else 0.0
            assert got.loc[i, f"silhouette_{name}"] == pytest.approx(want, abs=1e-12)


def test_tree_shap_additivity(spark):
    from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 4))
    y = ((x[:, 0] + 0.5 * x[:, 1] * x[:, 2]) > 0).astype(float)
    pdf = [(int(i), *map(float, x[i]), float(y[i])) for i in range(300)]
    df = spark.createDataFrame(pdf, "respondent_id long, a double, b double, c double, d double, label double")
    df = VectorAssembler(inputCols=["a", "b", "c", "d"], outputCol="features").transform(df)
    feats = ["a", "b", "c", "d"]
    gbt = GBTClassifier(maxIter=5, maxDepth=3, seed=1).fit(df)
    shap = AT.tree_attribution(df.limit(50), gbt, "boosted", feats).toPandas()
    margin = gbt.transform(df.limit(50)).select(
        "respondent_id", F.col("rawPrediction").alias("raw")).toPandas()
    m = dict(zip(margin["respondent_id"], [r[1] / 1.0 for r in margin["raw"]]))
    for _, r in shap.iterrows():
        total = r["expected_value"] + sum(r[f] for f in feats)
        assert total == pytest.approx(m[r["respondent_id"]], abs=1e-6)
    rf = RandomForestClassifier(numTrees=3, maxDepth=3, seed=1).fit(df)
    shap = AT.tree_attribution(df.limit(30), rf, "forest", feats).toPandas()
    prob = rf.transform(df.limit(30)).select("respondent_id", "probability").toPandas()
    p = dict(zip(prob["respondent_id"], [v[1] for v in prob["probability"]]))
    for _, r in shap.iterrows():
        assert r["expected_value"] + sum(r[f] for f in feats) == pytest.approx(p[r["respondent_id"]], abs=1e-6)


def test_linear_attributions_add_up(spark):
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 3))
    y = (x[:, 0] - x[:, 2] + rng.normal(scale=0.5, size=200) > 0).astype(float)
    df = spark.createDataFrame([(int(i), *map(float, x[i]), float(y[i])) for i in range(200)],
                               "respondent_id long, a double, b double, c double, label double")
    df = VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(df)
    lr = LogisticRegression(maxIter=50).fit(df)
    w = list(lr.coefficients.toArray())
    per = AT.linear_attribution_rows(df, w, ["a", "b", "c"]).toPandas().set_index("respondent_id")
    margin = x @ np.array(w) + lr.intercept
    expected = margin - margin.mean()
    got = per[["a", "b", "c"]].sum(axis=1).sort_index().to_numpy()
    assert np.allclose(got, expected, atol=1e-9)


def test_cluster_members_sum_to_n(spark, resp_small):
    res = CL.run_clustering(resp_small, CL.ClusterSettings(restarts=1, max_iter=10, sweep_restarts=1,
                                                            sweep_max_iter=5, k_range=(2, 3)))
    prof = res["profiles"].collect()
    assert sum(r["n_members"] for r in prof) == resp_small.count()
    labels = [r["cluster_label"] for r in prof]
    assert len(set(labels)) == 4
    sil = res["silhouette"].collect()
    assert [r["k"] for r in sil] == [2, 3] and all(-1 <= r["silhouette_score"] <= 1 for r in sil)


def test_model_frame_split_and_folds(spark, resp_small):
    frame, feats = PL.model_frame(resp_small, S.FRAUD_TARGET, True, 0.2, 42, 5)
    rows = frame.select("label", "is_test", "fold").toPandas()
    for _, g in rows.groupby("label"):
        n = len(g)
        assert g["is_test"].sum() == int(np.floor(n * 0.2 + 0.5))
        assert g.loc[g["is_test"] == 1, "fold"].isna().all()
        counts = g.loc[g["is_test"] == 0, "fold"].value_counts()
        assert set(counts.index) == {0, 1, 2, 3, 4} and counts.max() - counts.min() <= 1
    assert "has_experienced_fraud" not in feats and "reported_to_bank" not in feats


def test_auc_and_roc_of_many_distinct_scores_are_exact(spark):
    df = spark.range(120000).select((F.col("id") * 48271 % 2147483647 / 2147483647.0 * 10 - 3).alias("score"))
    df = df.withColumn("label", (F.col("score") + ((F.col("score") * 1000) % 1.7) > 2).cast("double"))
    p = df.toPandas()
    ranks, one = p.score.rank(), p.label == 1
    exact = (ranks[one].sum() - one.sum() * (one.sum() + 1) / 2) / (one.sum() * (~one).sum())
    assert abs(M.auc_roc(df, "score", "label", 1.0).first()["auc_roc"] - exact) <= 5.1e-5
    curve = M.roc_curve(df, "score", "label", 1.0)
    assert curve.count() == p.score.nunique() + 1
    at = curve.where("threshold < 3").orderBy(F.desc("threshold")).first()
    assert abs(at["tpr"] - (p.score[one] >= at["threshold"]).mean()) <= 5.1e-5


def test_tree_samples_are_exact_and_independent(spark):
    """Every tree has exactly min(256, n) rows, spread over the ids; trees differ."""
    from pyspark.ml.functions import array_to_vector
    df = spark.range(4000).select(F.col("id").alias("respondent_id"), array_to_vector(F.array(F.rand(1), F.rand(2))).alias("features"))
    t = AN.tree_samples(df, 40, 256, 7).toPandas()
    assert (t.groupby("tree").size() == 256).all() and t.tree.nunique() == 40 and not t.duplicated().any()
    assert (abs(t.groupby("tree").respondent_id.mean() - 2000) < 350).all()  # five standard errors
    sets = [set(g.respondent_id) for _, g in t.groupby("tree")]
    common = [len(a & b) for i, a in enumerate(sets) for b in sets[:i]]
    assert abs(np.mean(common) - 256 * 256 / 4000) < 1.5 and max(common) < 45
    few = AN.tree_samples(df.limit(100), 5, 256, 7).toPandas()
    assert (few.groupby("tree").size() == 100).all()
    res = AN.isolation_forest(df, ["a", "b"], AN.ForestSettings(trees=20))
    assert set(res["nodes"].query("node == 0")["size"]) == {256}
    assert res["rows"].columns == ["respondent_id", "features", "anomaly_score_raw", "anomaly_score", "is_anomaly", "anomaly_tier"]
    assert res["scores"].where("is_anomaly").count() == pytest.approx(0.08 * 4000, abs=2)


def test_tree_samples_widen_until_every_tree_is_full(spark):
    df = spark.range(3000).select(F.col("id").alias("respondent_id"))
    want = AN.tree_samples(df, 6, 64, 1).toPandas()
    small = AN.tree_samples(df, 6, 64, 1, first_share=0.001).toPandas()
    key = ["tree", "respondent_id"]
    assert small.sort_values(key).to_numpy().tolist() == want.sort_values(key).to_numpy().tolist()


def test_models_are_visible_only_through_their_manifest(spark, monkeypatch, tmp_path):
    from trustlens.ml import store
    monkeypatch.setattr(store, "scratch_path", lambda s, name: str(tmp_path / name))
    with pytest.raises(KeyError):
        store.manifest(spark, "kmeans")
    first, second = (CL.CentreModel(np.array([[float(i), 1.0], [2.0, 3.0]]), 4.0) for i in range(2))
    store.publish_clusters(spark, "kmeans", first, {}, "state 1")
    # A run that ends between the model and its manifest: nothing changes for readers.
    monkeypatch.setattr(store, "_publish", lambda *a: (_ for _ in ()).throw(RuntimeError("killed")))
    with pytest.raises(RuntimeError):
        store.publish_clusters(spark, "kmeans", second, {}, "state 2")
    assert np.array_equal(store.load(spark, "kmeans").centres, first.centres)
    monkeypatch.undo()
    monkeypatch.setattr(store, "scratch_path", lambda s, name: str(tmp_path / name))
    store.publish_clusters(spark, "kmeans", second, {"m": spark.range(1)}, "state 2")
    said = store.manifest(spark, "kmeans")
    assert (said["state"], said["metrics"], said["settings"]) == ("state 2", {"m": [{"id": 0}]}, {"k": 2})
    assert np.array_equal(store.load(spark, "kmeans").centres, second.centres)


def test_concurrent_publishers_leave_whole_models(spark, monkeypatch, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    from trustlens.ml import store
    monkeypatch.setattr(store, "scratch_path", lambda s, name: str(tmp_path / name))
    models = [CL.CentreModel(np.full((3, 2), float(i)), float(i)) for i in range(6)]
    with ThreadPoolExecutor(6) as pool:
        list(pool.map(lambda m: store.publish_clusters(spark, "kmeans", m, {}, ""), models))
        seen = [store.load(spark, "kmeans") for _ in range(2)]
    for m in seen:
        assert (m.centres == m.cost).all() and m.centres.shape == (3, 2)


def test_classifiers_train_save_and_load(spark, resp_small, monkeypatch, tmp_path):
    from trustlens.ml import models as MD
    from trustlens.ml import store
    from trustlens.ml.boosting import BoostSettings
    monkeypatch.setattr(store, "scratch_path", lambda s, name: str(tmp_path / name))
    small = MD.ModelSettings(lr_max_iter=20, rf_trees=5, rf_depth=4, cv_folds=2, boost=BoostSettings(rounds=4, depth=3, step=0.3))
    res = MD.train_classifier(resp_small, S.TRUST_TARGET, small)
    rows = res["metrics"].collect()
    assert [r["model"] for r in rows] == MD.MODEL_NAMES and res["n_classes"] == 5
    assert all(0 <= r[c] <= 1 for r in rows for c in ("accuracy", "f1", "auc_roc", "cv_accuracy_mean"))
    assert res["predictions"][MD.BOOSTED].count() == res["data"].where("is_test = 1").count()
    for best in (MD.BOOSTED, MD.MODEL_NAMES[0]):
        store.publish_classifier(spark, "trust", res | {"best_model_name": best}, "s")
        key = lambda df: {r["respondent_id"]: r["prediction"] for r in df.select("respondent_id", "prediction").collect()}
        assert key(store.load(spark, "trust").transform(res["frame"])) == key(res["fitted"][best].transform(res["data"]))
        assert store.manifest(spark, "trust")["model"] == best


@pytest.mark.parametrize("direct", [0, 1 << 20])
def test_lloyd_pass_is_one_job_without_planning_and_equals_brute_force(spark, monkeypatch, direct):
    from pyspark.ml.functions import vector_to_array
    monkeypatch.setattr(CL, "BLOCK_ROWS", 53)
    monkeypatch.setattr(CL, "DIRECT_BYTES", direct)
    rng = np.random.default_rng(12)
    x = np.round(rng.normal(size=(900, 3)), 1)
    sets = [rng.normal(size=(k, 3)) for k in (3, 2, 3, 1, 4)]
    sets[2][2] = sets[2][1]
    blocks = CL.matrices(CL.packed(points(spark, x).repartition(9).select(vector_to_array("features").alias("x"))), 3)
    assert blocks.count() > 9
    group = f"pass-{direct}"
    spark.sparkContext.setJobGroup(group, "")
    try:
        found = np.split(CL.lloyd_pass(blocks, sets), np.cumsum([len(c) for c in sets])[:-1])
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(group)) == 1
    for c, got in zip(sets, found, strict=True):
        far = ((x[:, None] - c) ** 2).sum(axis=2)
        own = far.argmin(axis=1)  # the first of equal centres
        for j, cost in enumerate(CL.costs_of(got, c)):
            assert got[j, 3] == (own == j).sum() and np.allclose(got[j, :3], x[own == j].sum(axis=0))
            assert cost == pytest.approx(far[own == j, j].sum())
    blocks.unpersist()


def test_silhouette_assigns_only_the_sampled_rows(spark, monkeypatch):
    x = np.random.default_rng(13).normal(size=(200, 2))
    scaled, seen = points(spark, x), []
    cfg = CL.ClusterSettings(k_range=(2, 3), silhouette_rows=40)
    models = [CL.CentreModel(x[:k], 1.0) for k in cfg.k_range]
    taken = [r["respondent_id"] for r in CL.hash_sample(scaled, 40, cfg.seed).collect()]
    whole = CL.CentreModel.transform
    monkeypatch.setattr(CL.CentreModel, "transform", lambda self, rows, *a: seen.append(rows.count()) or whole(self, rows, *a))
    got = {r["k"]: r["silhouette_score"] for r in CL.silhouette(scaled, cfg, models).collect()}
    assert seen == [40, 40]
    far = np.sqrt(((x[taken][:, None] - x[taken]) ** 2).sum(axis=2))
    for k in cfg.k_range:
        own, want = ((x[taken][:, None] - x[:k]) ** 2).sum(axis=2).argmin(axis=1), []
        for i in range(40):
            mean = {c: far[i, (own == c) & (np.arange(40) != i)].mean() for c in set(own) if ((own == c) & (np.arange(40) != i)).any()}
            a, b = mean.get(own[i]), min(v for c, v in mean.items() if c != own[i])
            want.append(0.0 if a is None else (b - a) / max(a, b))
        assert got[k] == pytest.approx(np.mean(want), abs=1e-4)


def test_lloyd_pass_over_packed_blocks_equals_brute_force(spark, monkeypatch):
    from pyspark.ml.functions import vector_to_array
    monkeypatch.setattr(CL, "BLOCK_ROWS", 37)
    rng = np.random.default_rng(11)
    x = np.round(rng.normal(size=(700, 3)), 1)
    sets = [rng.normal(size=(k, 3)) for k in (4, 2, 4, 1, 3, 2)]
    sets[2][3] = sets[2][0]  # the first of equal centres takes the rows
    df = points(spark, x).select(vector_to_array("features").alias("x"))
    blocks = CL.packed(df)
    assert dict(blocks.dtypes) == {"x": "binary"} and 700 // 37 <= blocks.count() <= 700 // 37 + 1 + df.rdd.getNumPartitions()
    for rows in (df, blocks):
        got = {(r["set"], r["centre"]): r for r in CL.lloyd_sums(rows, sets).collect()}
        assert len(got) == sum(map(len, sets))
        for i, c in enumerate(sets):
            far = ((x[:, None] - c) ** 2).sum(axis=2)
            own = far.argmin(axis=1)
            for j in range(len(c)):
                r, mine = got[i, j], own == j
                assert r["n"] == mine.sum() and np.isclose(r["cost"], far[mine, j].sum())
                assert np.allclose([r["s0"], r["s1"], r["s2"]], x[mine].sum(axis=0))
    assert got[2, 3]["n"] == 0


def test_forest_tasks_follow_the_rows_and_rows_keep_their_nodes(spark):
    from pyspark.ml.functions import array_to_vector

    from trustlens.ml import models as MD
    rng = np.random.default_rng(8)
    rows = [(i, float(i % 2), 1.0, [float(v) for v in rng.normal(i % 2, 1.0, 4)]) for i in range(400)]
    df = spark.createDataFrame(rows, "respondent_id long, label double, weight double, x array<double>").repartition(4, "respondent_id")
    train = df.select("respondent_id", "label", "weight", array_to_vector("x").alias("features"))
    assert MD.forest_rows(train, 400).rdd.getNumPartitions() == 1
    assert MD.forest_rows(train, 3 * MD.FOREST_ROWS).rdd.getNumPartitions() == 3
    assert MD.forest_rows(train, 100 * MD.FOREST_ROWS).rdd.getNumPartitions() == 4  # never more than there are
    forest = MD.estimators(400, MD.ModelSettings(rf_trees=5, rf_depth=6))["Random Forest"]
    assert forest.getCacheNodeIds()
    plain = forest.copy().setCacheNodeIds(False)
    assert forest.fit(train).toDebugString.split("\n")[1:] == plain.fit(train).toDebugString.split("\n")[1:]


def test_logistic_regression_goes_over_no_more_parts_than_its_rows_ask_for(spark, resp_small, monkeypatch):
    from pyspark.ml.classification import LogisticRegression

    from trustlens.ml import models as MD
    from trustlens.ml.boosting import BoostSettings
    parts, fit = [], LogisticRegression._fit
    monkeypatch.setattr(LogisticRegression, "_fit", lambda self, df: (parts.append(df.rdd.getNumPartitions()), fit(self, df))[1])
    monkeypatch.setattr(MD, "FOREST_ROWS", 60)
    small = MD.ModelSettings(lr_max_iter=5, rf_trees=2, rf_depth=2, cv_folds=2, boost=BoostSettings(rounds=1, depth=1))
    res = MD.train_classifier(resp_small, S.FRAUD_TARGET, small)
    assert res["data"].rdd.getNumPartitions() == 4 and parts == [2, 2, 2]  # 120 training rows
