"""Query catalog, machine learning.

Split, folds, class weights, confusion metrics, AUC and ROC have SQL checks
(they are arithmetic over the given rows; the score is a rule-based one that
SQL can state).  Model training (k-means, PCA, forests, boosting, isolation
forest, attributions) has none: the driver records row counts only, and the
tests check invariants.

The registered queries train at the reference's sizes.  Fitted results are kept per Spark
application, data folder and state of its files, so the queries that share a fit
(metrics, importance, best model, ...) fit once.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from trustlens import schema as S
from trustlens.ml import anomaly as AN
from trustlens.ml import attribution as AT
from trustlens.ml import boosting as BO
from trustlens.ml import cluster as CL
from trustlens.ml import metrics as M
from trustlens.ml import models as MD
from trustlens.ml import pipeline as PL
from trustlens.plans import sql as Q
from trustlens.plans.catalog import _FEATURE_SQL, resp

QUERIES: dict = {}
ORACLE: dict = {}
_CACHE: dict = {}


def register(key, sql=None):
    def deco(fn):
        QUERIES[key] = fn
        if sql is not None:
            ORACLE[key] = sql
        return fn
    return deco


def _cached(spark, sf, name, make):
    from trustlens.sources.respondents import input_state
    key = (spark.sparkContext.applicationId, sf, input_state(spark, sf), name)
    if key not in _CACHE:
        _CACHE[key] = make()
    return _CACHE[key]


def fraud_result(spark, sf):
    return _cached(spark, sf, "fraud", lambda: MD.train_classifier(
        resp(spark, sf), S.FRAUD_TARGET))


def trust_result(spark, sf):
    return _cached(spark, sf, "trust", lambda: MD.train_classifier(
        resp(spark, sf), S.TRUST_TARGET))


def scaled_result(spark, sf):
    return _cached(spark, sf, "scaled", lambda: CL.scaled_features(resp(spark, sf)))


def cluster_result(spark, sf):
    return _cached(spark, sf, "cluster", lambda: CL.run_clustering(
        resp(spark, sf), CL.ClusterSettings(), scaled_result(spark, sf)))


def forest_result(spark, sf):
    def make():
        scaled = scaled_result(spark, sf)
        return AN.isolation_forest(scaled, S.CLUSTER_FEATURES, AN.ForestSettings())
    return _cached(spark, sf, "iforest", make)


# ---------------------------------------------------------------------------
# split, folds, weights (SQL-checked)
# ---------------------------------------------------------------------------
_H = "('0x' || substr(md5(CAST(respondent_id AS VARCHAR) || ':{s}'), 1, 15))::BIGINT"


def _rank_sql(label: str, seed: int) -> str:
    h = _H.format(s=seed)
    return (f"SELECT respondent_id, CAST({label} AS DOUBLE) AS label,"
            f" row_number() OVER (PARTITION BY {label} ORDER BY {h}, respondent_id) - 1 AS rk,"
            f" count(*) OVER (PARTITION BY {label}) AS nc FROM respondents")


@register("stratified_split", Q.with_resp(
    f", r AS ({_rank_sql('has_experienced_fraud', 42)})"
    " SELECT respondent_id, label, CAST(CASE WHEN rk < floor(nc * 0.2 + 0.5) THEN 1 ELSE 0 END AS INT)"
    " AS is_test FROM r"))
def q_stratified_split(spark, sf):
    """80/20 split by fraud class: per class, the round(20%) rows of smallest
    hash of (id, 42) are the test part."""
    df = resp(spark, sf).select("respondent_id", F.col(S.FRAUD_TARGET).cast("double").alias("label"))
    return PL.stratified_split(df, "label", 0.2, 42)


@register("stratified_kfold", Q.with_resp(
    f", r AS ({_rank_sql('has_experienced_fraud', 43)})"
    " SELECT respondent_id, label, CAST(rk % 5 AS INT) AS fold FROM r"))
def q_stratified_kfold(spark, sf):
    """5 stratified folds by fraud class (rank of hash within class mod 5)."""
    df = resp(spark, sf).select("respondent_id", F.col(S.FRAUD_TARGET).cast("double").alias("label"))
    return PL.stratified_kfold(df, "label", 5, 43)


@register("class_weights", Q.with_resp(
    ", c AS (SELECT q_trust_platform, count(*) AS n FROM respondents GROUP BY q_trust_platform)"
    " SELECT q_trust_platform, n, (SELECT CAST(count(*) AS DOUBLE) FROM respondents)"
    " / ((SELECT CAST(count(*) AS DOUBLE) FROM c) * n) AS weight FROM c"))
def q_class_weights(spark, sf):
    """Balanced class weights n / (k * n_class) for the trust target."""
    return PL.class_weights(resp(spark, sf), S.TRUST_TARGET)


# rule-based fraud score for the metric checks: higher = riskier
_RULE_SCORE = f"(100 - {Q.POSTURE_NO_FRAUD})"


def _rule_frame(spark, sf):
    from trustlens import functions as X
    df = resp(spark, sf)
    score = 100 - X.posture_expr(fraud_term=False)
    return df.select("respondent_id", F.col(S.FRAUD_TARGET).cast("double").alias("label"),
                     score.cast("double").alias("score"),
                     (score > 40).cast("double").alias("prediction"))


def _metrics_sql() -> str:
    pred = f"CAST(CASE WHEN {_RULE_SCORE} > 40 THEN 1 ELSE 0 END AS DOUBLE)"
    return (
        f", p AS (SELECT CAST(has_experienced_fraud AS DOUBLE) AS label, {pred} AS prediction FROM respondents),"
        " conf AS (SELECT label, prediction, count(*) AS n FROM p GROUP BY label, prediction),"
        " sup AS (SELECT label AS c, sum(n) AS support, sum(CASE WHEN label = prediction THEN n ELSE 0 END)"
        " AS tp FROM conf GROUP BY label),"
        " prd AS (SELECT prediction AS c, sum(n) AS predicted FROM conf GROUP BY prediction),"
        " per AS (SELECT coalesce(sup.support, 0) AS support, coalesce(sup.tp, 0) AS tp,"
        " coalesce(prd.predicted, 0) AS predicted FROM sup FULL OUTER JOIN prd ON sup.c = prd.c),"
        " pr AS (SELECT support, tp, CASE WHEN predicted > 0 THEN CAST(tp AS DOUBLE) / predicted ELSE 0.0 END AS p,"
        " CASE WHEN support > 0 THEN CAST(tp AS DOUBLE) / support ELSE 0.0 END AS r FROM per),"
        " f AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END AS f1 FROM pr)"
        f" SELECT {Q.r('CAST(sum(tp) AS DOUBLE) / sum(support)', 4)} AS accuracy,"
        f" {Q.r('sum(f1 * support) / CAST(sum(support) AS DOUBLE)', 4)} AS f1,"
        f" {Q.r('sum(p * support) / CAST(sum(support) AS DOUBLE)', 4)} AS precision,"
        f" {Q.r('sum(r * support) / CAST(sum(support) AS DOUBLE)', 4)} AS recall FROM f")


@register("class_metrics", Q.with_resp(_metrics_sql()))
def q_class_metrics(spark, sf):
    """Accuracy and weighted F1 / precision / recall of the rule 'posture
    without the fraud term below 60' as a fraud predictor."""
    return M.class_metrics(_rule_frame(spark, sf))


@register("confusion_matrix", Q.with_resp(
    f" SELECT CAST(has_experienced_fraud AS DOUBLE) AS label,"
    f" CAST(CASE WHEN {_RULE_SCORE} > 40 THEN 1 ELSE 0 END AS DOUBLE) AS prediction, count(*) AS n"
    " FROM respondents GROUP BY 1, 2"))
def q_confusion_matrix(spark, sf):
    return M.confusion(_rule_frame(spark, sf))


_SCORE_COUNTS = (f", c AS (SELECT CAST({_RULE_SCORE} AS DOUBLE) AS score,"
                 " sum(CASE WHEN has_experienced_fraud = 1 THEN 1 ELSE 0 END) AS pos,"
                 " sum(CASE WHEN has_experienced_fraud = 1 THEN 0 ELSE 1 END) AS neg"
                 " FROM respondents GROUP BY 1)")


@register("auc_roc", Q.with_resp(
    _SCORE_COUNTS + ", b AS (SELECT *, sum(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING"
    " AND CURRENT ROW) - neg AS neg_below FROM c)"
    f" SELECT {Q.r('sum(pos * (neg_below + 0.5 * neg)) / (CAST(sum(pos) AS DOUBLE) * CAST(sum(neg) AS DOUBLE))', 4)}"
    " AS auc_roc FROM b"))
def q_auc_roc(spark, sf):
    """AUC of the rule-based risk score (100 - posture without fraud term) for fraud."""
    return M.auc_roc(_rule_frame(spark, sf), "score", "label", 1.0)


@register("roc_curve", Q.with_resp(
    _SCORE_COUNTS + ", t AS (SELECT CAST(sum(pos) AS DOUBLE) AS P, CAST(sum(neg) AS DOUBLE) AS N FROM c),"
    " cum AS (SELECT score, sum(pos) OVER (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING"
    " AND CURRENT ROW) AS tp, sum(neg) OVER (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING"
    " AND CURRENT ROW) AS fp FROM c)"
    " SELECT 'inf'::DOUBLE AS threshold, 0.0::DOUBLE AS fpr, 0.0::DOUBLE AS tpr UNION ALL"
    f" SELECT score, {Q.r('fp / (SELECT N FROM t)', 4)}, {Q.r('tp / (SELECT P FROM t)', 4)} FROM cum"))
def q_roc_curve(spark, sf):
    return M.roc_curve(_rule_frame(spark, sf), "score", "label", 1.0)


# ---------------------------------------------------------------------------
# classifiers (rows-only checks)
# ---------------------------------------------------------------------------
@register("fraud_classifier")
def q_fraud_classifier(spark, sf):
    """LR, RF, boosted trees on fraud (leak-free features): test metrics + 5-fold CV."""
    return fraud_result(spark, sf)["metrics"].drop("ord")


@register("trust_classifier")
def q_trust_classifier(spark, sf):
    """LR, RF, boosted trees (softmax over all classes) on trust 1-5 (shifted to 0-4)."""
    return trust_result(spark, sf)["metrics"].drop("ord")


def _one_model(name):
    def fn(spark, sf):
        return fraud_result(spark, sf)["metrics"].where(F.col("model") == name).drop("ord")
    fn.__doc__ = f"{name} on the fraud target: test metrics and CV."
    return fn


register("logistic")(_one_model("Logistic Regression"))
register("random_forest")(_one_model("Random Forest"))
register("boosted_trees")(_one_model("Gradient Boosted Trees"))


@register("cv_score")
def q_cv_score(spark, sf):
    """5-fold stratified CV accuracy / weighted F1, mean and population std."""
    return fraud_result(spark, sf)["metrics"].select(
        "model", "cv_accuracy_mean", "cv_accuracy_std", "cv_f1_mean", "cv_f1_std")


@register("best_model")
def q_best_model(spark, sf):
    """Best fraud model by AUC and best trust model by F1 (first on a tie)."""
    f = MD.best_model(fraud_result(spark, sf)["metrics"], "auc_roc").select(
        F.lit("fraud").alias("task"), "best_model", F.col("auc_roc").alias("score"))
    t = MD.best_model(trust_result(spark, sf)["metrics"], "f1").select(
        F.lit("trust").alias("task"), "best_model", F.col("f1").alias("score"))
    return f.unionByName(t)


@register("metrics_long")
def q_metrics_long(spark, sf):
    return MD.metrics_long(fraud_result(spark, sf)["metrics"].drop("ord"))


@register("feature_importance")
def q_feature_importance(spark, sf):
    """Top-20 importances of the boosted-tree fraud model."""
    return MD.importance_frame(spark, fraud_result(spark, sf)["feature_importance"])


@register("top_features")
def q_top_features(spark, sf):
    """Top-20 importances of the trust model (boosted trees over all classes)."""
    return MD.importance_frame(spark, trust_result(spark, sf)["feature_importance"])


def _test_rows(res):
    """All scaled test rows (features vector)."""
    return res["data"].where("is_test = 1").select("respondent_id", "features")


#: Fixed weights, so that SQL can state the attributions.
_FIXED_WEIGHTS = {"num_services_used": 0.75, "avg_literacy_score": -1.5, "years_digital_banking": 0.125}


@register("linear_attribution", Q.with_resp(
    ", a AS (SELECT " + ", ".join(f"{_FEATURE_SQL.get(c, c)} AS {c}" for c in _FIXED_WEIGHTS) + " FROM respondents),"
    " m AS (SELECT " + ", ".join(f"avg({c}) AS {c}" for c in _FIXED_WEIGHTS) + " FROM a) "
    + " UNION ALL ".join(f"SELECT '{c}' AS feature, {Q.r(f'avg(abs({w} * (a.{c} - m.{c})))', 6)} AS mean_abs_shap FROM a, m" for c, w in _FIXED_WEIGHTS.items())))
def q_linear_attribution(spark, sf):
    """w_j (x_j - mean_j) attributions of a linear score with fixed weights, all rows:
    mean |attribution| per feature."""
    from pyspark.ml.feature import VectorAssembler

    from trustlens import functions as X
    from trustlens.operators.features import engineer_features
    names = list(_FIXED_WEIGHTS)
    rows = VectorAssembler(inputCols=names, outputCol="features").transform(engineer_features(resp(spark, sf)))
    per = AT.linear_attribution(rows.select("respondent_id", "features"), list(_FIXED_WEIGHTS.values()), names)
    return per.select("feature", X.rnd(F.col("mean_abs_shap"), 6).alias("mean_abs_shap"))


@register("tree_attribution")
def q_tree_attribution(spark, sf):
    """Per-row TreeSHAP values of the fraud boosted-tree model on all test rows."""
    res = fraud_result(spark, sf)
    return AT.tree_attribution(_test_rows(res), res["fitted"][MD.BOOSTED], "boosted", res["features"])


def fraud_attributions(res):
    """(feature, mean |attribution|) of the best fraud model: linear or TreeSHAP."""
    best, rows = res["best_model_name"], _test_rows(res)
    if best == "Logistic Regression":
        return AT.linear_attribution(rows, list(res["fitted"][best].coefficients.toArray()), res["features"])
    kind = "forest" if best == "Random Forest" else "boosted"
    return AT.global_importance(AT.tree_attribution(rows, res["fitted"][best], kind, res["features"]), res["features"])


@register("attribution_table")
def q_attribution_table(spark, sf):
    """Top-20 mean |attribution| of the best fraud model over all test rows."""
    return AT.attribution_table(fraud_attributions(fraud_result(spark, sf)))


@register("roc_curve_models")
def q_roc_curve_models(spark, sf):
    """ROC points of the fitted fraud models on the test rows."""
    from pyspark.ml.functions import vector_to_array
    res, out = fraud_result(spark, sf), None
    for name, pred in res["predictions"].items():
        scored = pred.select("label", vector_to_array("probability")[1].alias("s"))
        part = M.roc_curve(scored, "s", "label", 1.0).withColumn("model", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


# ---------------------------------------------------------------------------
# clustering (rows-only checks)
# ---------------------------------------------------------------------------
@register("kmeans")
def q_kmeans(spark, sf):
    """k = 4 k-means (best of the restarts) on the scaled clustering features."""
    return cluster_result(spark, sf)["assignments"].select("respondent_id", "cluster_id")


@register("silhouette")
def q_silhouette(spark, sf):
    return cluster_result(spark, sf)["silhouette"]


@register("best_k")
def q_best_k(spark, sf):
    return cluster_result(spark, sf)["best_k"]


@register("pca")
def q_pca(spark, sf):
    """Two principal components per row and the explained variance %."""
    model, rows = CL.pca(scaled_result(spark, sf))
    ev = [round(float(v) * 100, 1) for v in model.explainedVariance.toArray()]
    return rows.select("respondent_id", "pca_1", "pca_2", F.lit(ev[0]).alias("explained_var_1"), F.lit(ev[1]).alias("explained_var_2"))


@register("run_clustering")
def q_run_clustering(spark, sf):
    return cluster_result(spark, sf)["assignments"].select(
        "respondent_id", "cluster_id", "cluster_label", "pca_1", "pca_2")


#: A clustering that SQL can state: by the id and the service count.
_RULE_CLUSTER = "CAST((respondent_id + num_services_used) % 4 AS INT)"


def _rule_clusters(spark, sf):
    from trustlens.operators.features import engineer_features
    return engineer_features(resp(spark, sf)).withColumn("cluster_id", F.expr(_RULE_CLUSTER))


_RULE_CLUSTER_SQL = (
    ", f AS (SELECT respondent_id, has_experienced_fraud AS fraud, " + ", ".join(f"{_FEATURE_SQL.get(c, c)} AS {c}" for c in S.CLUSTER_FEATURES) + " FROM respondents),"
    f" g AS (SELECT *, {_RULE_CLUSTER} AS cluster_id FROM f),"
    " k AS (SELECT cluster_id, row_number() OVER (ORDER BY avg(security_posture_score) DESC, cluster_id) - 1 AS r FROM g GROUP BY cluster_id),"
    " lab AS (SELECT cluster_id, CASE r " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(S.CLUSTER_LABELS))
    + " ELSE 'Cluster ' || r END AS cluster_label FROM k)")


@register("join_cluster_label", Q.with_resp(
    _RULE_CLUSTER_SQL + " SELECT respondent_id, cluster_id, cluster_label FROM g LEFT JOIN lab USING (cluster_id)"))
def q_join_cluster_label(spark, sf):
    """Every respondent's cluster id (by a rule) joined to its posture-ranked label."""
    return CL.join_cluster_label(_rule_clusters(spark, sf)).select("respondent_id", "cluster_id", "cluster_label")


@register("rule_cluster_profiles", Q.with_resp(
    _RULE_CLUSTER_SQL + " SELECT cluster_id, cluster_label, " + ", ".join(f"{Q.r(f'avg({c})', 3)} AS {c}" for c in S.CLUSTER_FEATURES)
    + f", count(*) AS n_members, {Q.r('avg(fraud) * 100', 1)} AS fraud_rate_pct FROM g JOIN lab USING (cluster_id) GROUP BY ALL"))
def q_rule_cluster_profiles(spark, sf):
    """Profiles of clusters given by a rule."""
    return CL.cluster_profiles(CL.join_cluster_label(_rule_clusters(spark, sf)))


@register("cluster_profiles")
def q_cluster_profiles(spark, sf):
    return cluster_result(spark, sf)["profiles"]


@register("attach_scores")
def q_attach_scores(spark, sf):
    """Respondent rows with cluster and anomaly results: the scored rows keep their columns
    and go through the cluster model, so that nothing is joined by id."""
    rows = forest_result(spark, sf)["rows"]
    done = CL.join_cluster_label(cluster_result(spark, sf)["model"].transform(rows))
    return done.select(*resp(spark, sf).columns, "cluster_id", "cluster_label",
                       "anomaly_score_raw", "anomaly_score", "is_anomaly", "anomaly_tier")


@register("sink_models")
def q_sink_models(spark, sf):
    """k-means and the best fraud classifier (with imputer, assembler and scaler) published
    to the shared folder and loaded back through their manifests: cluster sizes and
    predicted classes of all rows by the loaded models."""
    from trustlens.ml import store
    from trustlens.sources.respondents import input_state
    clusters, fraud = cluster_result(spark, sf), fraud_result(spark, sf)
    state = str(input_state(spark, sf))
    store.publish_clusters(spark, "kmeans", clusters["model"], {"silhouette": clusters["silhouette"]}, state)
    store.publish_classifier(spark, "fraud", fraud, state)
    sizes = store.load(spark, "kmeans").transform(clusters["scaled"]).groupBy(F.col("cluster_id").alias("value")).count()
    said = store.load(spark, "fraud").transform(fraud["frame"]).groupBy(F.col("prediction").cast("int").alias("value")).count()
    return sizes.select(F.lit("kmeans").alias("model"), "value", "count").unionByName(
        said.select(F.lit(fraud["best_model_name"]).alias("model"), "value", "count"))


# ---------------------------------------------------------------------------
# anomaly detection (rows-only checks)
# ---------------------------------------------------------------------------
@register("isolation_forest")
def q_isolation_forest(spark, sf):
    """Isolation-forest scores per row: raw, 0-100, flag (8%), tier."""
    return forest_result(spark, sf)["scores"]


@register("anomaly_summary")
def q_anomaly_summary(spark, sf):
    return AN.anomaly_summary(forest_result(spark, sf)["scores"])


@register("anomaly_profile")
def q_anomaly_profile(spark, sf):
    return AN.anomaly_profile(forest_result(spark, sf)["rows"])


@register("anomaly_histogram")
def q_anomaly_histogram(spark, sf):
    """30 equal-width bins of the 0-100 anomaly score (chart data)."""
    from trustlens.operators.descriptive import histogram
    return histogram(forest_result(spark, sf)["scores"], "anomaly_score", 30)


# ---------------------------------------------------------------------------
# summaries of models over rule-based results that SQL can state
# ---------------------------------------------------------------------------
#: An anomaly score by a rule, 0-100 with one decimal, and its flag.
_RULE_ANOMALY = "round(((respondent_id * 37) % 1001) / 10.0, 1)"


def _rule_scores(spark, sf):
    from trustlens import functions as X
    score = X.rnd(F.col("respondent_id") * 37 % 1001 / 10.0, 1)
    return resp(spark, sf).withColumns({"anomaly_score": score, "is_anomaly": score < 8}) \
        .withColumn("anomaly_tier", X.anomaly_tier(F.col("anomaly_score")))


_RULE_ANOMALY_SQL = f", a AS (SELECT respondent_id, {Q.r('((respondent_id * 37) % 1001) / 10.0', 1)} AS score FROM respondents)"


@register("rule_anomaly_profile", Q.with_resp(
    _RULE_ANOMALY_SQL + ", f AS (SELECT respondent_id, " + ", ".join(f"{_FEATURE_SQL.get(c, c)} AS {c}" for c in S.CLUSTER_FEATURES)
    + " FROM respondents) SELECT CASE WHEN score < 8 THEN 'Anomalous' ELSE 'Normal' END AS \"group\", "
    + ", ".join(f"{Q.r(f'avg({c})', 3)} AS {c}" for c in S.CLUSTER_FEATURES) + " FROM f JOIN a USING (respondent_id) GROUP BY 1"))
def q_rule_anomaly_profile(spark, sf):
    """Feature means of anomalous and normal rows, the flag given by a rule."""
    from trustlens.operators.features import engineer_features
    return AN.anomaly_profile(engineer_features(_rule_scores(spark, sf)))


@register("rule_anomaly_summary", Q.with_resp(
    _RULE_ANOMALY_SQL + ", t AS (SELECT CASE WHEN score <= 20 THEN 'Critical' WHEN score <= 40 THEN 'High' WHEN score <= 60 THEN 'Medium'"
    " ELSE 'Normal' END AS tier FROM a) SELECT tier, count(*) AS count,"
    f" {Q.pct('count(*)', '(SELECT count(*) FROM t)')} AS pct FROM t GROUP BY tier"))
def q_rule_anomaly_summary(spark, sf):
    """Rows and share of every tier, the score given by a rule."""
    return AN.anomaly_summary(_rule_scores(spark, sf))


_FOREST = AN.ForestSettings()


@register("iforest_samples", Q.with_resp(
    ", d AS (SELECT respondent_id, md5(CAST(respondent_id AS VARCHAR) || ':42') AS x FROM respondents),"
    " h AS (SELECT respondent_id, ('0x' || substr(x, 1, 13))::BIGINT AS a, ('0x' || substr(x, 14, 13))::BIGINT AS b FROM d),"
    f" r AS (SELECT t::INT AS tree, respondent_id, row_number() OVER (PARTITION BY t ORDER BY (a + t * b) % {AN.HASH_MODULUS}, respondent_id) AS k"
    f" FROM h, range({_FOREST.trees}) g(t)) SELECT tree, respondent_id FROM r WHERE k <= {_FOREST.max_samples}"))
def q_iforest_samples(spark, sf):
    """Which rows each tree of the isolation forest is grown from."""
    return AN.tree_samples(resp(spark, sf), _FOREST.trees, _FOREST.max_samples, _FOREST.seed)


# ---------------------------------------------------------------------------
# parts of the fits that SQL can state
# ---------------------------------------------------------------------------
_RAW_SQL = "SELECT respondent_id, has_experienced_fraud AS label, " + ", ".join(
    f"CAST({_FEATURE_SQL.get(c, c)} AS DOUBLE) AS f{i}" for i, c in enumerate(S.CLUSTER_FEATURES)) + " FROM respondents"
_LONG_SQL = " UNION ALL ".join(f"SELECT respondent_id, label, {i} AS feature, f{i} AS value FROM raw" for i in range(len(S.CLUSTER_FEATURES)))
_BINS = 16


def _raw_features(spark, sf):
    """respondent_id, label (fraud), fold (none), features: the unscaled clustering features."""
    from pyspark.ml.feature import VectorAssembler

    from trustlens.operators.features import engineer_features
    rows = engineer_features(resp(spark, sf)).withColumn("label", F.col(S.FRAUD_TARGET)).withColumn("fold", F.lit(None).cast("int"))
    return VectorAssembler(inputCols=S.CLUSTER_FEATURES, outputCol="features").transform(rows)


_BINS_SQL = (
    f", raw AS ({_RAW_SQL}), long AS ({_LONG_SQL}),"
    " c AS (SELECT feature, value, count(*) AS n FROM long GROUP BY ALL),"
    " s AS (SELECT *, sum(n) OVER (PARTITION BY feature ORDER BY value ROWS UNBOUNDED PRECEDING) AS upto, sum(n) OVER (PARTITION BY feature) AS total,"
    " count(*) OVER (PARTITION BY feature) AS k FROM c),"
    f" e AS (SELECT feature, value AS upper, upto FROM s WHERE k <= {_BINS} OR upto * {_BINS} // total > (upto - n) * {_BINS} // total),"
    " bins AS (SELECT feature, row_number() OVER w - 1 AS bin, upper, upto - coalesce(lag(upto) OVER w, 0) AS n FROM e"
    " WINDOW w AS (PARTITION BY feature ORDER BY upper))")


@register("boost_bins", Q.with_resp(
    _BINS_SQL + " SELECT CAST(feature AS INT) AS feature, CAST(bin AS INT) AS bin, upper, CAST(n AS BIGINT) AS n FROM bins"))
def q_boost_bins(spark, sf):
    """Bins of the clustering features, 16 at most."""
    from pyspark.ml.functions import vector_to_array
    return BO.bin_table(_raw_features(spark, sf), vector_to_array("features"), _BINS)


@register("boost_root_sums", Q.with_resp(
    _BINS_SQL + ", b AS (SELECT l.feature, l.label, min(bins.bin) AS bin FROM long l JOIN bins ON bins.feature = l.feature AND bins.upper >= l.value"
    " GROUP BY l.feature, l.label, l.respondent_id) SELECT 0::INT AS class, feature::INT AS feature, bin::INT AS bin,"
    " sum(0.5::DOUBLE - label) AS gradient, sum(0.25::DOUBLE) AS curvature FROM b GROUP BY ALL"))
def q_boost_root_sums(spark, sf):
    """Gradient and curvature by bin in the root of the first tree, all rows and columns."""
    cfg = BO.BoostSettings(row_share=1.0, column_share=1.0, max_bins=_BINS)
    return BO.root_sums(_raw_features(spark, sf), len(S.CLUSTER_FEATURES), 2, cfg)


@register("fold_scalers", Q.with_resp(
    f", r AS ({_rank_sql('has_experienced_fraud', 43)}), raw AS ({_RAW_SQL}), long AS ({_LONG_SQL}),"
    " j AS (SELECT feature, value, rk % 5 AS own FROM long JOIN r USING (respondent_id))"
    f" SELECT f::INT AS fold, feature::INT AS feature, count(*) AS n, {Q.r('avg(value)', 6)} AS mean, {Q.r('stddev_samp(value)', 6)} AS std"
    " FROM j, range(5) g(f) WHERE own <> f GROUP BY f, feature"))
def q_fold_scalers(spark, sf):
    """The scaler of every fold: mean and deviation of the clustering features outside it."""
    from pyspark.ml.functions import vector_to_array

    from trustlens import functions as X
    folds = PL.stratified_kfold(_raw_features(spark, sf).drop("fold"), S.FRAUD_TARGET, 5, 43)
    return PL.fold_scalers(folds, vector_to_array("features"), 5).select(
        "fold", "feature", "n", X.rnd(F.col("mean"), 6).alias("mean"), X.rnd(F.col("std"), 6).alias("std"))


#: Centres of one step of k-means that SQL can state: on the values' scale, without ties.
_CENTRES = [[20.31 + 23.17 * j if i == 0 else 0.37 + 0.83 * j + 0.11 * i for i in range(len(S.CLUSTER_FEATURES))] for j in range(3)]


def _nearest_sql() -> str:
    far = [" + ".join(f"(f{i} - {v!r}::DOUBLE) * (f{i} - {v!r}::DOUBLE)" for i, v in enumerate(c)) for c in _CENTRES]
    d = ", ".join(f"{e} AS d{j}" for j, e in enumerate(far))
    return (f", raw AS ({_RAW_SQL}), far AS (SELECT *, {d} FROM raw),"
            " near AS (SELECT *, CASE WHEN d0 <= d1 AND d0 <= d2 THEN 0 WHEN d1 <= d2 THEN 1 ELSE 2 END AS centre, least(d0, d1, d2) AS d FROM far)")


@register("lloyd_step", Q.with_resp(
    _nearest_sql() + f" SELECT centre, count(*) AS n, {Q.r('sum(d)', 2)} AS cost, "
    + ", ".join(f"{Q.r(f'avg(f{i})', 4)} AS {c}" for i, c in enumerate(S.CLUSTER_FEATURES)) + " FROM near GROUP BY centre"))
def q_lloyd_step(spark, sf):
    """One pass of k-means from fixed centres: rows, cost and new centre of each."""
    import numpy as np
    from pyspark.ml.functions import vector_to_array

    from trustlens import functions as X
    sums = CL.lloyd_sums(_raw_features(spark, sf).select(vector_to_array("features").alias("x")), [np.array(_CENTRES)])
    return sums.where("n > 0").select("centre", "n", X.rnd(F.col("cost"), 2).alias("cost"), *[
        X.rnd(F.col(f"s{i}") / F.col("n"), 4).alias(c) for i, c in enumerate(S.CLUSTER_FEATURES)])


_SILHOUETTE_ROWS = 1200


@register("rule_silhouette", Q.with_resp(
    f", raw AS ({_RAW_SQL}), g AS (SELECT *, CAST((respondent_id + f4) % 4 AS INT) AS c FROM raw),"
    f" s AS (SELECT * FROM g ORDER BY {_H.format(s=42)}, respondent_id LIMIT {_SILHOUETTE_ROWS}),"
    " p AS (SELECT a.respondent_id, a.c AS own, b.c, sum(sqrt(" + " + ".join(f"(a.f{i} - b.f{i}) * (a.f{i} - b.f{i})" for i in range(len(S.CLUSTER_FEATURES)))
    + ")) AS total, count(*) AS n FROM s a, s b GROUP BY ALL),"
    " m AS (SELECT respondent_id, own, sum(CASE WHEN c = own THEN total / greatest(n - 1, 1) END) AS a,"
    " sum(CASE WHEN c = own THEN n END) AS n, min(CASE WHEN c <> own THEN total / n END) AS b FROM p GROUP BY respondent_id, own)"
    f" SELECT own AS cluster_id, count(*) AS n, {Q.r('avg(CASE WHEN n > 1 AND b IS NOT NULL AND greatest(a, b) > 0 THEN (b - a) / greatest(a, b) ELSE 0 END)', 4)}"
    " AS silhouette FROM m GROUP BY own"))
def q_rule_silhouette(spark, sf):
    """Mean Euclidean silhouette of clusters given by a rule, over a hash sample of 1,200 rows."""
    from pyspark.ml.functions import vector_to_array

    from trustlens import functions as X
    rows = _raw_features(spark, sf).withColumn("cluster_id", F.expr(_RULE_CLUSTER))
    found = CL.silhouette_rows(rows, ["cluster_id"], vector_to_array("features"), _SILHOUETTE_ROWS)
    own = rows.select("respondent_id", "cluster_id").join(found, "respondent_id")
    return own.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"), X.rnd(F.avg("silhouette_cluster_id"), 4).alias("silhouette"))


def _rule_metrics(spark, sf):
    """Metrics of three rules (risk score over 30, 40, 50) as fraud predictors."""
    out = None
    for i, cut in enumerate((30, 40, 50)):
        pred = _rule_frame(spark, sf).withColumn("prediction", (F.col("score") > cut).cast("double"))
        one = M.class_metrics(pred).select(F.lit(f"over {cut}").alias("model"), F.lit(i).alias("ord"), "*")
        out = one if out is None else out.unionByName(one)
    return out


def _rule_metrics_sql() -> str:
    parts, ctes = [], []
    for i, cut in enumerate((30, 40, 50)):
        body = _metrics_sql().replace("> 40", f"> {cut}")
        names = ("p", "conf", "sup", "prd", "per", "pr", "f")
        for n in names:
            body = body.replace(f", {n} AS (", f", {n}{i} AS (").replace(f" {n} AS (", f" {n}{i} AS (")
            body = body.replace(f"FROM {n} ", f"FROM {n}{i} ").replace(f"FROM {n})", f"FROM {n}{i})").replace(f"JOIN {n} ", f"JOIN {n}{i} ")
        body = body.replace("sup.", f"sup{i}.").replace("prd.", f"prd{i}.")
        cte, _, select = body.rpartition(" SELECT ")
        ctes.append(cte)
        select = select.rpartition(" FROM f")[0]
        parts.append(f"SELECT 'over {cut}' AS model, {i} AS ord, {select} FROM f{i}")
    return "".join(ctes) + ", metrics AS (" + " UNION ALL ".join(parts) + ")"


@register("rule_metrics_long", Q.with_resp(
    _rule_metrics_sql() + " SELECT model, metric, value FROM (SELECT model, accuracy, f1, precision, recall FROM metrics)"
    " UNPIVOT (value FOR metric IN (accuracy, f1, precision, recall))"))
def q_rule_metrics_long(spark, sf):
    """Long form (model, metric, value) of the metrics of three rules."""
    return MD.metrics_long(_rule_metrics(spark, sf).drop("ord"))


@register("rule_best_model", Q.with_resp(
    _rule_metrics_sql() + " SELECT model AS best_model, f1 FROM metrics ORDER BY f1 DESC, ord LIMIT 1"))
def q_rule_best_model(spark, sf):
    """The rule with the highest weighted F1, the first on a tie."""
    return MD.best_model(_rule_metrics(spark, sf), "f1")


#: What several queries share, and for each of those queries the last fit it needs.
FITS = {"scaled": scaled_result, "iforest": forest_result, "cluster": cluster_result, "fraud": fraud_result, "trust": trust_result}
FITTED = {
    "pca": "scaled", "isolation_forest": "iforest", "anomaly_summary": "iforest", "anomaly_profile": "iforest", "anomaly_histogram": "iforest",
    "kmeans": "cluster", "silhouette": "cluster", "best_k": "cluster", "run_clustering": "cluster", "cluster_profiles": "cluster",
    "attach_scores": "cluster", "sink_models": "fraud", "fraud_classifier": "fraud", "logistic": "fraud", "random_forest": "fraud",
    "boosted_trees": "fraud", "cv_score": "fraud", "metrics_long": "fraud", "feature_importance": "fraud", "tree_attribution": "fraud",
    "attribution_table": "fraud", "roc_curve_models": "fraud", "trust_classifier": "trust", "best_model": "trust", "top_features": "trust"}
