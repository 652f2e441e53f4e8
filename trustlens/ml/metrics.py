"""Classification metrics from grouped counts.

Accuracy and weighted precision / recall / F1 come from the confusion counts
(one group-by on (label, prediction), at most classes^2 rows).  AUC and the
ROC curve come from counts per distinct score: an exact running count over
those (``operators.ranks``) gives, for every positive, the negatives ranked
below it -- the Mann-Whitney form of the AUC, ties counted half.
"""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trustlens import functions as X
from trustlens.operators.ranks import running


def confusion(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    return pred.groupBy(F.col(label).alias("label"), F.col(prediction).alias("prediction")) \
        .agg(F.count(F.lit(1)).alias("n"))


def class_metrics(pred: DataFrame, label: str = "label", prediction: str = "prediction",
                  digits: int = 4) -> DataFrame:
    """One row: accuracy, weighted f1, precision, recall (0 where undefined)."""
    conf = confusion(pred, label, prediction)
    sup = conf.groupBy(F.col("label").alias("c")).agg(
        F.sum("n").alias("support"),
        F.sum(F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0)).alias("tp"))
    prd = conf.groupBy(F.col("prediction").alias("c")).agg(F.sum("n").alias("predicted"))
    per = sup.join(prd, "c", "full_outer").fillna(0, ["support", "tp", "predicted"])
    p = F.when(F.col("predicted") > 0, F.col("tp") / F.col("predicted")).otherwise(0.0)
    r = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(0.0)
    f1 = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)
    per = per.select("support", "tp", p.alias("p"), r.alias("r"), f1.alias("f1"))
    tot = F.sum("support").cast("double")
    return per.agg(
        X.rnd(F.sum("tp") / tot, digits).alias("accuracy"),
        X.rnd(F.sum(F.col("f1") * F.col("support")) / tot, digits).alias("f1"),
        X.rnd(F.sum(F.col("p") * F.col("support")) / tot, digits).alias("precision"),
        X.rnd(F.sum(F.col("r") * F.col("support")) / tot, digits).alias("recall"))


def _score_counts(df: DataFrame, score, positive) -> DataFrame:
    return df.groupBy(score.alias("score")).agg(
        F.sum(positive.cast("bigint")).alias("pos"),
        F.sum((~positive).cast("bigint")).alias("neg"))


def _auc(pos: str = "pos", neg: str = "neg"):
    wins = F.sum(F.col(pos) * (F.col(f"{neg}_before") + 0.5 * F.col(neg)))
    return wins / (F.sum(pos).cast("double") * F.sum(neg).cast("double"))


def auc_roc(df: DataFrame, score: str, label: str = "label", positive_value=1, digits: int = 4) -> DataFrame:
    """One row (auc): P(score_pos > score_neg) + 0.5 P(tie), exact over the distinct scores."""
    c = running(_score_counts(df, F.col(score).cast("double"), F.col(label) == positive_value), "score", ["neg"])
    return c.agg(_auc().alias("auc")).select(X.rnd(F.col("auc"), digits).alias("auc_roc"))


def roc_curve(df: DataFrame, score: str, label: str = "label", positive_value=1, digits: int = 4) -> DataFrame:
    """ROC points (threshold, fpr, tpr) for every distinct score, descending,
    starting at (inf, 0, 0)."""
    counts = _score_counts(df, F.col(score).cast("double"), F.col(label) == positive_value)
    c = running(counts, "score", ["pos", "neg"])
    positives = counts.select(F.sum("pos").cast("double")).scalar()
    negatives = counts.select(F.sum("neg").cast("double")).scalar()
    pts = c.select("score", X.rnd((negatives - F.col("neg_before")) / negatives, digits).alias("fpr"),
                   X.rnd((positives - F.col("pos_before")) / positives, digits).alias("tpr"))
    start = c.sparkSession.createDataFrame([(float("inf"), 0.0, 0.0)], "score double, fpr double, tpr double")
    return start.unionByName(pts).withColumnRenamed("score", "threshold").orderBy("fpr", "tpr")


def multiclass_auc(pred: DataFrame, classes: list[int], score_col: str = "probability", label: str = "label") -> DataFrame:
    """One-vs-rest AUC per class, weighted by class support (aligned classes: score
    entry i is scored against label == i); exact, all classes in one pass."""
    one = (pred.select(F.col(label).alias("y"), vector_to_array(score_col).alias("s"))
           .select("y", F.posexplode("s").alias("cls", "score")).where(F.col("cls").isin(classes)))
    counts = one.groupBy("cls", "score").agg(F.sum((F.col("y") == F.col("cls")).cast("bigint")).alias("pos"),
                                             F.sum((F.col("y") != F.col("cls")).cast("bigint")).alias("neg"))
    per = running(counts, "score", ["neg"], ["cls"]).groupBy("cls").agg(F.sum("pos").alias("support"), _auc().alias("auc"))
    return per.agg((F.sum(F.col("auc") * F.col("support")) / F.sum("support")).alias("auc_roc"))
