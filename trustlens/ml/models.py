"""Fraud and trust classifiers: logistic regression, random forest, boosted
trees; test metrics, stratified cross-validation, feature importance.

Features are imputed, assembled and scaled by a Spark ML ``Pipeline`` fit on the
training part.  Logistic regression is a Spark ML estimator; the forest's trees are grown by
tasks (``ml.forest``), or by Spark ML's estimator where the rows are too many for that; boosted
trees (``ml.boosting``) grow the models of all folds and classes together.  Executors train, and
only metric rows and model parameters reach the driver.  The model frame is written once
to the shared checkpoint folder, so the many fits re-read it instead of recomputing its
lineage, and a lost executor re-reads files.
"""

from __future__ import annotations

import math
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trustlens import functions as X
from trustlens import schema as S
from trustlens.ml import forest as FO
from trustlens.ml import metrics as M
from trustlens.ml.boosting import TASK_BYTES, BoostedModel, BoostSettings, fit_boosted
from trustlens.ml.pipeline import assembler, fold_scalers, imputer, model_frame, rescaled
from trustlens.session import materialize

BOOSTED = "Gradient Boosted Trees"
MODEL_NAMES = ["Logistic Regression", "Random Forest", BOOSTED]
#: Memory of a task for the sums of forest nodes: more nodes are split in one pass.
FOREST_MEMORY_MB = 1024
#: Rows of a task of a forest fit, as an aim: every task sums all nodes of a level, so more
#: tasks than the rows ask for only send more sums.  The fits of the folds run side by side.
FOREST_ROWS = 1 << 15


@dataclass(frozen=True)
class ModelSettings:
    """Model sizes.  Defaults are the reference's."""
    lr_max_iter: int = 1000
    rf_trees: int = 300
    rf_depth: int = 12
    rf_min_leaf: int = 5
    boost: BoostSettings = field(default_factory=BoostSettings)
    cv_folds: int = 5
    test_size: float = 0.2
    seed: int = 42


def estimators(n_train: int, cfg: ModelSettings) -> dict:
    """sklearn's C = 1 on a summed loss is Spark's regParam = 1 / n on a mean loss."""
    lr = LogisticRegression(maxIter=cfg.lr_max_iter, regParam=1.0 / max(n_train, 1),
                            elasticNetParam=0.0, standardization=False, weightCol="weight",
                            family="auto", tol=1e-4)  # sklearn's default tolerance
    rf = RandomForestClassifier(numTrees=cfg.rf_trees, maxDepth=cfg.rf_depth,
                                minInstancesPerNode=cfg.rf_min_leaf, weightCol="weight",
                                featureSubsetStrategy="sqrt", maxMemoryInMB=FOREST_MEMORY_MB, seed=cfg.seed,
                                cacheNodeIds=True)  # rows keep their nodes instead of walking every tree again
    return dict(zip(MODEL_NAMES, [lr, rf]))


def _auc(pred: DataFrame, n_classes: int) -> DataFrame:
    if n_classes == 2:
        p1 = pred.select("label", vector_to_array("probability")[1].alias("s"))
        return M.auc_roc(p1, "s", "label", 1.0)
    a = M.multiclass_auc(pred, list(range(n_classes)), "probability", "label")
    return a.select(X.rnd(F.col("auc_roc"), 4).alias("auc_roc"))


def feature_importance(model, features: list[str], top: int = 20) -> list[tuple[str, float]]:
    """Top importances of a tree model."""
    vec = model.importance() if isinstance(model, BoostedModel | FO.ForestModel) else model.featureImportances.toArray()
    pairs = sorted(zip(features, [float(v) for v in vec]), key=lambda t: (-t[1], t[0]))
    return pairs[:top]


def _fold_scores(model, rows: DataFrame) -> tuple[float, float]:
    r = M.class_metrics(model.transform(rows), digits=12).first()
    return r["accuracy"], r["f1"]


def forest_rows(train: DataFrame, n_train: int) -> DataFrame:
    """``train`` in no more partitions than ``FOREST_ROWS`` rows each ask for."""
    return train.coalesce(max(1, -(-n_train // FOREST_ROWS)))


def _fit_fold(est, train: DataFrame, fold: int, scaler: tuple) -> tuple[float, float]:
    """Fit on the rows outside a fold, with a scaler of those rows, and score the fold."""
    rows = train.withColumn("features", rescaled("features", *scaler))
    return _fold_scores(est.fit(rows.where(F.col("fold") != fold)), rows.where(F.col("fold") == fold))


def _forest_fold(spark: SparkSession, rows, est, fold: int) -> tuple[float, float]:
    """Accuracy and F1 on a fold of a forest of the other rows; bins do not change by scaling."""
    r = M.class_metrics(FO.fold_predictions(spark, rows, est, fold), digits=12).first()
    return r["accuracy"], r["f1"]


def train_classifier(df: DataFrame, target: str, cfg: ModelSettings | None = None,
                     leak_free: bool = True, select_by: str | None = None,
                     parallelism: int = 6) -> dict:
    """Fit the three models on the stratified 80% part; test metrics on the
    20% part; k-fold CV (accuracy, weighted F1: mean and population std) on the
    training part; best model by AUC (fraud) or F1 (trust), first on a tie.

    The imputer is fit once on the training part; every fold has its own scaler, from one
    aggregate of all folds.  Fits of logistic regression and forest are independent Spark
    jobs submitted from ``parallelism`` driver threads (the scheme of
    ``CrossValidator(parallelism=...)``); the boosted trees of all folds grow in one fit
    (bins do not change by scaling) meanwhile.  Logistic regression goes first: its many
    short jobs would wait for the long tasks of the others.
    """
    cfg = cfg or ModelSettings()
    select_by = select_by or ("auc_roc" if target == S.FRAUD_TARGET else "f1")
    spark: SparkSession = df.sparkSession
    frame, feats = model_frame(df, target, leak_free, cfg.test_size, cfg.seed, cfg.cv_folds)
    train_rows = frame.where("is_test = 0")
    # impute only the columns that hold nulls (one cheap counting pass instead
    # of a quantile pass over every feature)
    nulls = train_rows.agg(*[F.count(F.when(F.col(c).isNull(), 1)).alias(c) for c in feats]).first()
    holes = [c for c in feats if nulls[c] > 0]
    prep = Pipeline(stages=assembler(feats, imputed=[imputer(train_rows, holes)] if holes else None)).fit(train_rows)
    data = prep.transform(frame).select("respondent_id", "label", "weight", "is_test", "fold",
                                        "features")
    # Spark sizes the shuffled partitions; the many passes of the fits read them cached
    data = data.repartition("respondent_id").persist(StorageLevel.MEMORY_AND_DISK)
    n_classes = int(data.agg(F.max("label")).first()[0]) + 1
    train = data.where("is_test = 0")
    test = data.where("is_test = 1")
    n_train = train.count()
    fitted, rows, preds, scores = {}, [], {}, {}
    scalers = scalers_of(fold_scalers(train, vector_to_array("features"), cfg.cv_folds), cfg.cv_folds, len(feats))
    with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
        linear, forest = (estimators(n_train, cfg)[name] for name in MODEL_NAMES[:2])
        dealt = forest_rows(train, n_train)  # a pass of either is little work a row
        fits = [pool.submit(_fit_fold, linear, dealt, f, scalers[f]) for f in range(cfg.cv_folds)] + [pool.submit(linear.fit, dealt)]
        if FO.fits(n_train, len(feats)):
            held = spark.sparkContext.broadcast(FO.packed_rows(train, len(feats), n_classes, forest.getMaxBins()))
            tasks = [(_forest_fold, spark, held, forest, f) for f in range(cfg.cv_folds)] + [(FO.fit_forest, spark, held, forest)]
        else:
            held = None
            tasks = [(_fit_fold, forest, dealt, f, scalers[f]) for f in range(cfg.cv_folds)] + [(forest.fit, dealt)]
        *scores[MODEL_NAMES[0]], fitted[MODEL_NAMES[0]] = [f.result() for f in fits]
        fits = [pool.submit(*task) for task in tasks]
        *by_fold, boosted = fit_boosted(train, len(feats), n_classes, cfg.cv_folds, cfg.boost, TASK_BYTES)
        *scores[MODEL_NAMES[1]], fitted[MODEL_NAMES[1]] = [f.result() for f in fits]
        if held:
            held.destroy()
        fitted[BOOSTED] = boosted
        scores[BOOSTED] = list(pool.map(lambda f: _fold_scores(by_fold[f], train.where(F.col("fold") == f)), range(cfg.cv_folds)))
    for i, (name, model) in enumerate(fitted.items()):
        # written once: the metrics, the AUC's passes and the ROC read it
        preds[name] = materialize(model.transform(test).select("respondent_id", "label", "probability", "prediction"), f"predictions_{i}")
        m = M.class_metrics(preds[name]).first()
        auc = _auc(preds[name], n_classes).first()["auc_roc"]
        accs, f1s = [a for a, _ in scores[name]], [b for _, b in scores[name]]
        rows.append((name, i, m["accuracy"], m["f1"], m["precision"], m["recall"], auc,
                     _r4(_mean(accs)), _r4(_std(accs)), _r4(_mean(f1s)), _r4(_std(f1s))))
    metrics = spark.createDataFrame(rows, METRICS_SCHEMA)  # three rows of results
    best = metrics.orderBy(F.desc(select_by), "ord").first()["model"]
    importance = feature_importance(fitted[BOOSTED], feats)
    return {"task": target, "metrics": metrics.orderBy("ord"), "best_model_name": best,
            "fitted": fitted, "prep": prep, "features": feats, "predictions": preds,
            "data": data, "frame": frame, "feature_importance": importance, "n_classes": n_classes, "settings": cfg}


def scalers_of(table: DataFrame, folds: int, n_features: int) -> list[tuple[list[float], list[float]]]:
    """(means, standard deviations) of every fold: folds x features numbers."""
    means, stds = ([[0.0] * n_features for _ in range(folds)] for _ in range(2))
    for r in table.collect():
        means[r["fold"]][r["feature"]], stds[r["fold"]][r["feature"]] = r["mean"], r["std"]
    return list(zip(means, stds, strict=True))


METRICS_SCHEMA = ("model string, ord int, accuracy double, f1 double, precision double, "
                  "recall double, auc_roc double, cv_accuracy_mean double, cv_accuracy_std double, "
                  "cv_f1_mean double, cv_f1_std double")


def _mean(xs):
    return sum(xs) / len(xs)


def _std(xs):
    """Population standard deviation (as numpy's default)."""
    mu = _mean(xs)
    return (sum((x - mu) ** 2 for x in xs) / len(xs)) ** 0.5


def _r4(x):
    return math.floor(x * 10000 + 0.5) / 10000


def importance_frame(spark: SparkSession, pairs: list[tuple[str, float]]) -> DataFrame:
    """(rank, feature, importance) from model parameters."""
    return spark.createDataFrame([(i + 1, f, round(v, 6)) for i, (f, v) in enumerate(pairs)],
                                 "rank int, feature string, importance double")


def best_model(metrics: DataFrame, by: str, order: str = "ord") -> DataFrame:
    """Arg-max row of a metrics table, first in ``order`` on a tie."""
    return metrics.agg(F.max_by("model", F.struct(F.col(by), -F.col(order))).alias("best_model"),
                       F.max(by).alias(by))


def metrics_long(metrics: DataFrame) -> DataFrame:
    vals = [c for c in metrics.columns if c != "model"]
    return metrics.unpivot(["model"], vals, "metric", "value")
