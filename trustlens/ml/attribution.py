"""Model attributions of all given rows.

Linear models: attribution_j = w_j * (x_j - mean_j) on the scaled features, a
column expression per feature; global importance = mean |attribution|.

Tree ensembles: path-dependent TreeSHAP (Lundberg, Erion, Lee 2018), from one table per
tree that is prepared once.  A leaf asks for one interval of every feature on its path; let
``o_j`` be 1 where a row lies in the interval of feature j and ``z_j`` the share of the
training rows that the splits on j let by.  The Shapley weight ``k! (m-1-k)! / m!`` is the
integral of ``y^k (1-y)^(m-1-k)`` over [0, 1], so the leaf gives feature i

    value * (o_i - z_i) * integral of prod_{j != i} (o_j y + z_j (1 - y)) dy,

a polynomial that ``ceil(m / 2)`` Gauss-Legendre points integrate exactly.  All leaves and
all rows of a batch are handled by array products; nothing is copied along paths.

Node tables (model parameters: trees x nodes, bounded by the model settings) are broadcast;
``mapInPandas`` computes the attributions of each batch of rows.  Forests average the
per-tree values (probability of class 1); boosted trees add them up (margin scale).
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trustlens import functions as X
from trustlens.ml.boosting import BoostedModel
from trustlens.ml.forest import ForestModel
from trustlens.session import scratch_path


def linear_attribution_rows(rows: DataFrame, weights: list[float], features: list[str],
                            vector_col: str = "features") -> DataFrame:
    """Per-row attributions w_j * (x_j - mean_j) (respondent_id, one column per
    feature); they add up to the margin minus the mean margin."""
    arr = rows.select("respondent_id", vector_to_array(vector_col).alias("x"))
    xs = {f: F.col("x")[i] for i, f in enumerate(features)}
    # one row of feature means (a parameter vector) -> literals
    means = arr.agg(*[F.avg(xs[f]).alias(f"m{i}") for i, f in enumerate(features)]).first()
    return arr.select("respondent_id", *[
        (F.lit(float(w)) * (xs[f] - F.lit(float(means[f"m{i}"])))).alias(f)
        for i, (f, w) in enumerate(zip(features, weights))])


def linear_attribution(rows: DataFrame, weights: list[float], features: list[str],
                       vector_col: str = "features") -> DataFrame:
    """(feature, mean_abs_shap) for a linear model on scaled features."""
    per = linear_attribution_rows(rows, weights, features, vector_col)
    return global_importance(per, features)


# ---------------------------------------------------------------------------
# TreeSHAP
# ---------------------------------------------------------------------------

#: Numbers of one (row, leaf, feature) array at a time.
WORK = 1 << 21


@dataclass(frozen=True)
class LeafTable:
    """One tree as (leaf, feature) entries, leaf after leaf: feature, interval (low, high],
    share z; per leaf its first entry and value; the mean value over the training rows."""
    feature: np.ndarray
    low: np.ndarray
    high: np.ndarray
    share: np.ndarray
    first: np.ndarray
    value: np.ndarray
    expected: float


def leaf_table(tree: dict) -> LeafTable:
    """The leaves of a tree given as node arrays (left when x <= threshold)."""
    left, right, feat = tree["left"], tree["right"], tree["feature"]
    thr, value, cover = tree["threshold"], tree["value"], tree["cover"]
    entries, first, values, expected = [], [], [], 0.0
    todo: list[tuple[int, dict]] = [(0, {})]
    while todo:
        j, path = todo.pop()
        if left[j] < 0:
            expected += float(value[j]) * float(cover[j] / cover[0]) if cover[0] else 0.0
            if path:  # a tree of one leaf says the same for all rows
                first.append(len(entries))
                values.append(float(value[j]))
                entries += [(f, *ask) for f, ask in path.items()]
            continue
        f = int(feat[j])
        low, high, share = path.get(f, (-np.inf, np.inf, 1.0))
        to_left, to_right = (share * float(cover[c] / cover[j]) if cover[j] else 0.0 for c in (left[j], right[j]))
        todo.append((right[j], path | {f: (max(low, thr[j]), high, to_right)}))
        todo.append((left[j], path | {f: (low, min(high, thr[j]), to_left)}))
    a = np.array(entries, dtype=float).reshape(-1, 4)
    return LeafTable(a[:, 0].astype(np.int64), a[:, 1], a[:, 2], a[:, 3], np.array(first, dtype=np.int64), np.array(values), expected)


def tree_shap(x: np.ndarray, table: LeafTable, phi: np.ndarray, scale: float = 1.0) -> float:
    """Add scale * the attributions of one tree for all rows of x into phi; returns scale *
    the tree's expected value."""
    if len(table.first):
        sizes = np.diff(np.append(table.first, len(table.feature)))
        points, weights = np.polynomial.legendre.leggauss(int(-(-sizes.max() // 2)))
        points, weights = (points + 1) / 2, weights / 2
        leaf = np.repeat(np.arange(len(sizes)), sizes)
        onto = np.zeros((len(table.feature), x.shape[1]))
        onto[np.arange(len(leaf)), table.feature] = scale * table.value[leaf]
        step = max(1, WORK // len(leaf))
        for at in range(0, len(x), step):
            v = x[at:at + step][:, table.feature]
            inside = ((v > table.low) & (v <= table.high)).astype(float)
            gap = inside - table.share
            total = np.zeros_like(gap)
            for y, w in zip(points, weights, strict=True):
                factor = table.share + gap * y  # share (1 - y) + inside y, over 0 for rows that a split can meet
                factor = np.maximum(factor, 1e-300)
                total += w * np.multiply.reduceat(factor, table.first, axis=1)[:, leaf] / factor
            phi[at:at + step] += (gap * total) @ onto
    return scale * table.expected


def tree_table(model, kind: str) -> tuple[list[dict], list[float]]:
    """Node arrays per tree and tree weights; of a Spark model read from its saved form.
    Boosted trees of more than two classes give those of the highest class."""
    if isinstance(model, BoostedModel):
        trees = model.tree_arrays(0 if model.n_classes == 2 else model.n_classes - 1)
        return trees, [1.0] * len(trees)
    if isinstance(model, ForestModel):
        trees = model.tree_arrays()
        return trees, [1.0 / len(trees)] * len(trees)
    spark = SparkSession.getActiveSession()
    path = scratch_path(spark, f"model_{uuid.uuid4().hex[:8]}")
    model.write().overwrite().save(path)
    nodes = (spark.read.parquet(f"{path}/data")
             .select("treeID", "nodeData.id", "nodeData.prediction", "nodeData.impurityStats",
                     "nodeData.leftChild", "nodeData.rightChild", "nodeData.split.featureIndex",
                     F.get(F.col("nodeData.split.leftCategoriesOrThreshold"), 0).alias("threshold"))
             .toPandas())
    weights = list(model.treeWeights)
    trees = []
    for tid in sorted(nodes["treeID"].unique()):
        t = nodes[nodes["treeID"] == tid].sort_values("id")
        size = int(t["id"].max()) + 1
        arr = {k: np.full(size, -1, dtype=np.int64) for k in ["left", "right", "feature"]}
        arr["threshold"] = np.zeros(size)
        arr["value"] = np.zeros(size)
        arr["cover"] = np.zeros(size)
        ids = t["id"].to_numpy()
        arr["left"][ids] = t["leftChild"].to_numpy()
        arr["right"][ids] = t["rightChild"].to_numpy()
        arr["feature"][ids] = t["featureIndex"].to_numpy()
        arr["threshold"][ids] = t["threshold"].fillna(0.0).to_numpy()
        stats = t["impurityStats"].to_numpy()
        if kind == "forest":
            arr["cover"][ids] = [float(np.sum(s)) for s in stats]
            arr["value"][ids] = [float(s[1] / np.sum(s)) if len(s) > 1 and np.sum(s) > 0 else 0.0
                                 for s in stats]
        else:
            arr["cover"][ids] = [float(s[0]) for s in stats]
            arr["value"][ids] = t["prediction"].to_numpy()
        trees.append(arr)
    if kind == "forest":
        weights = [1.0 / len(trees)] * len(trees)
    return trees, weights


def tree_attribution(rows: DataFrame, model, kind: str, features: list[str],
                     vector_col: str = "features") -> DataFrame:
    """Per-row TreeSHAP values (respondent_id, expected_value, one column per
    feature) for a random forest (kind='forest') or boosted trees ('boosted')."""
    spark = rows.sparkSession
    trees, weights = tree_table(model, kind)
    bc = spark.sparkContext.broadcast(([leaf_table(t) for t in trees], weights))
    d = len(features)
    cols = [f"shap_{i}" for i in range(d)]

    def run(batches):
        ts, ws = bc.value
        for pdf in batches:
            if not len(pdf):
                continue
            x = np.stack(pdf["x"].to_numpy()).astype(float)
            phi = np.zeros((len(x), d))
            ev = sum(tree_shap(x, t, phi, w) for t, w in zip(ts, ws))
            out = pd.DataFrame(phi, columns=cols)
            out.insert(0, "expected_value", ev)
            out.insert(0, "respondent_id", pdf["respondent_id"].to_numpy())
            yield out

    schema = "respondent_id bigint, expected_value double, " + ", ".join(f"{c} double" for c in cols)
    # a row costs all trees, so rows are dealt over all tasks
    dealt = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "respondent_id")
    res = dealt.select("respondent_id", vector_to_array(vector_col).alias("x")).mapInPandas(run, schema)
    return res.select("respondent_id", "expected_value",
                      *[F.col(c).alias(f) for c, f in zip(cols, features)])


def global_importance(per_row: DataFrame, features: list[str]) -> DataFrame:
    """(feature, mean_abs_shap) from per-row attributions."""
    agg = per_row.agg(*[F.avg(F.abs(F.col(f))).alias(f) for f in features])
    return agg.unpivot([], features, "feature", "mean_abs_shap")


def attribution_table(importance: DataFrame, top: int = 20) -> DataFrame:
    """rank, feature, mean |attribution| (4 dp): the top ``top`` features."""
    t = importance.orderBy(F.desc("mean_abs_shap"), "feature").limit(top)
    w = Window.orderBy(F.desc("mean_abs_shap"), "feature")  # over the top rows only
    return t.select(F.row_number().over(w).alias("rank"), "feature",
                    X.rnd(F.col("mean_abs_shap"), 4).alias("mean_abs_shap"))
