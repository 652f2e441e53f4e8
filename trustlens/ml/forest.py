"""Random forest whose trees are grown by tasks, by the rules of Spark ML's classifier; that
one itself is fit where the rows are too many for this (``models``).

Spark's forest sums the nodes of all trees level by level and shuffles those sums: below the
first levels a forest of 300 trees has far more nodes than a task has rows.  Here the rows, cut
into bins and packed into bytes, are broadcast (``FOREST_BYTES`` at most), and a task grows some
of the trees from them, all nodes of a level at once.

The rules are Spark's: at most 32 bins, Poisson draws of rows, ``ceil(sqrt)`` features drawn
for every node, weighted Gini impurity, a least number of drawn rows in a child, a node whose
leaves all say the same becomes a leaf.  Bins are exact (``boosting.bin_table``), and draws
follow (seed, forest, tree) over the rows in order of their ids, so that a forest does not
depend on how its rows lie in partitions.

The forest of all rows is a ``ForestModel``, arrays on the driver and in the tasks that score
(``as_spark`` gives Spark's model, whose objects take ten times the room in every task).  Those
of the folds are only scored: their tasks return the votes on the rows of the fold.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trustlens.ml.boosting import bin_table, edges_of, pack, to_bins
from trustlens.session import scratch_path

#: Bytes of training rows that are broadcast at most.
FOREST_BYTES = 128 << 20
#: Tasks of a forest for every core, as an aim: trees differ in size.
TASKS_PER_CORE = 2
#: The fold that no row lies in.
ALL = -2
#: Gains at most this are rounding.
LEAST_GAIN = 1e-12

NODE = ("treeID int, nodeData struct<id int, prediction double, impurity double, impurityStats array<double>, rawCount bigint, gain double, "
        "leftChild int, rightChild int, split struct<featureIndex int, leftCategoriesOrThreshold array<double>, numCategories int>>")


@dataclass
class ForestRows:
    """Training rows in order of their ids: bins, label, fold (-1: none); the weight of every
    label, the bounds of the bins."""
    bins: np.ndarray
    label: np.ndarray
    fold: np.ndarray
    weights: np.ndarray
    edges: list[np.ndarray]


@dataclass
class Tree:
    """Nodes, parents before their children: feature (-1: leaf), cut, gain, children, and the
    drawn rows of every label."""
    feature: np.ndarray
    cut: np.ndarray
    gain: np.ndarray
    left: np.ndarray
    right: np.ndarray
    counts: np.ndarray

    def slim(self) -> "Tree":
        """The same in the least types that hold it."""
        kinds = (np.int16, np.uint8, np.float64, np.int32, np.int32, np.int32)
        return Tree(*(a.astype(kind) for a, kind in zip(vars(self).values(), kinds, strict=True)))


def fits(n: int, n_features: int) -> bool:
    return n * (n_features + 16) <= FOREST_BYTES


def packed_rows(train: DataFrame, n_features: int, n_classes: int, max_bins: int) -> ForestRows:
    """The rows of ``train`` (respondent_id, features, label, fold, weight)."""
    edges = edges_of(bin_table(train, vector_to_array("features"), max_bins), n_features)
    weights = np.zeros(n_classes)
    for r in train.groupBy("label").agg(F.max("weight").alias("w")).collect():  # a row a class
        weights[int(r["label"])] = r["w"]
    blocks = pack(train, edges, 0, 0)
    ids, bins, label, fold = (np.concatenate(a) for a in zip(*blocks.map(lambda b: (b.ids, b.bins, b.label, b.fold)).collect(), strict=True))
    blocks.unpersist()
    mixed = np.zeros(len(ids), np.uint64)  # tells rows of one id apart
    for own, by in zip(bins.T, np.random.default_rng(0).integers(1 << 63, size=n_features, dtype=np.uint64), strict=True):
        mixed += own * by
    order = np.lexsort((mixed, fold, label, ids))
    return ForestRows(bins[order], label[order], fold[order], weights, edges)


def grow_tree(rows: ForestRows, without: int, number: int, est: dict) -> Tree:
    """A tree of the rows outside a fold; of all for ``ALL``."""
    rng = np.random.default_rng([est["seed"] & (1 << 64) - 1, without - ALL, number])
    drawn = rng.poisson(1.0, len(rows.label))
    at = np.flatnonzero((rows.fold != without) & (drawn > 0))  # rows of open nodes
    n_features, classes, w = rows.bins.shape[1], len(rows.weights), rows.weights
    sizes = np.array([len(e) for e in rows.edges])
    some = max(1, int(np.ceil(np.sqrt(n_features))))
    flat = rows.bins.reshape(-1)
    node = np.zeros(len(at), np.int64)  # place among the open nodes
    opened = np.array([0])  # their numbers in the tree
    total = np.bincount(rows.label[at], drawn[at], classes)[None]
    made = [(np.array([-1]), np.array([0]), np.array([-1.0]), np.array([-1]), np.array([-1]), total)]
    n_nodes = 1

    def splits(counts: np.ndarray) -> np.ndarray:
        """Nodes that may have two children of enough rows and are not pure."""
        return (counts.sum(axis=1) >= 2 * est["min_leaf"]) & ((counts * w > 0).sum(axis=1) > 1)

    on = splits(total)
    if not on.all():
        opened = opened[:0]
    for _ in range(est["depth"]):
        if not len(opened):
            break
        features = np.sort(np.argpartition(rng.random((len(opened), n_features)), some - 1, axis=1)[:, :some], axis=1)
        width = sizes[features]
        start = np.cumsum(width).reshape(width.shape) - width  # first cell of every (node, feature)
        n_cells = int(width.sum())
        bins = flat[(at * n_features)[:, None] + features[node]]
        code = (start[node] + bins) * classes + rows.label[at][:, None]
        cells = np.bincount(code.ravel(), np.repeat(drawn[at], some), n_cells * classes).reshape(n_cells, classes)
        segment = np.repeat(np.arange(width.size), width.ravel())
        run = np.cumsum(cells, axis=0)
        before = np.concatenate([np.zeros((1, classes)), run])[start.ravel()]
        left = run - before[segment]
        owner = segment // some
        right = total[owner] - left
        lw, rw, tw = left * w, right * w, total * w
        ls, rs, ts = lw.sum(axis=1), rw.sum(axis=1), tw.sum(axis=1)
        # Gini: impurity of the node less those of its children, by their weights
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = ((lw ** 2).sum(axis=1) / ls + (rw ** 2).sum(axis=1) / rs - ((tw ** 2).sum(axis=1) / ts)[owner]) / ts[owner]
        enough = (left.sum(axis=1) >= est["min_leaf"]) & (right.sum(axis=1) >= est["min_leaf"]) & (ls > 0) & (rs > 0)
        gain = np.where(enough, gain, -1.0)
        best = np.maximum.reduceat(gain, start[:, 0])
        top = np.flatnonzero(gain == best[owner])
        cell = top[np.unique(owner[top], return_index=True)[1]]  # the first of the best
        split = np.flatnonzero(best > LEAST_GAIN)
        if not len(split):
            break
        cell = cell[split]
        place = np.full(len(opened), -1)
        place[split] = np.arange(len(split))
        feature, cut = features.ravel()[segment[cell]], cell - start.ravel()[segment[cell]]
        child = n_nodes + 2 * np.arange(len(split))
        own = np.stack([left[cell], right[cell]], axis=1).reshape(-1, classes)
        for had, value in zip(made[-1], (feature, cut, best[split], child, child + 1), strict=False):
            had[opened[split] - (n_nodes - len(made[-1][0]))] = value
        made.append(tuple(np.full(len(own), v) for v in (-1, 0, -1.0, -1, -1)) + (own,))
        go = place[node] >= 0
        at, node = at[go], place[node[go]]
        below = 2 * node + (flat[at * n_features + feature[node]] > cut[node])
        on = splits(own)
        place = np.where(on, np.cumsum(on) - 1, -1)
        go = place[below] >= 0
        at, node = at[go], place[below[go]]
        opened, total = n_nodes + np.flatnonzero(on), own[on]
        n_nodes += len(own)
    return pruned(Tree(*(np.concatenate(a) for a in zip(*made, strict=True))), w)


def pruned(tree: Tree, weights: np.ndarray) -> Tree:
    """A node whose two children are leaves of the same prediction becomes a leaf, from below."""
    said = (tree.counts * weights).argmax(axis=1)
    feature = tree.feature.copy()
    while True:
        inner = np.flatnonzero(feature >= 0)
        a, b = tree.left[inner], tree.right[inner]
        ends = inner[(feature[a] < 0) & (feature[b] < 0) & (said[a] == said[b])]
        if not len(ends):
            break
        feature[ends] = -1
    kept = np.zeros(len(feature), bool)
    kept[0] = True
    for i in np.flatnonzero(feature >= 0):  # parents before their children
        if kept[i]:
            kept[tree.left[i]] = kept[tree.right[i]] = True
    name = np.append(np.cumsum(kept) - 1, -1)
    leaf = feature < 0
    return Tree(*(a[kept] for a in (feature, np.where(leaf, 0, tree.cut), np.where(leaf, -1.0, tree.gain), name[np.where(leaf, -1, tree.left)],
                                    name[np.where(leaf, -1, tree.right)], tree.counts)))


def leaf_of(tree: Tree, bins: np.ndarray) -> np.ndarray:
    node, at = np.zeros(len(bins), np.int64), np.arange(len(bins))
    while True:
        feature = tree.feature[node]
        inner = feature >= 0
        if not inner.any():
            return node
        down = np.where(bins[at, np.maximum(feature, 0)] > tree.cut[node], tree.right[node], tree.left[node])
        node = np.where(inner, down, node)


def votes_of(tree: Tree, weights: np.ndarray, bins: np.ndarray) -> np.ndarray:
    """The shares of the labels in every row's leaf, by weight."""
    stats = tree.counts * weights
    return (stats / np.maximum(stats.sum(axis=1, keepdims=True), 1e-300))[leaf_of(tree, bins)]


def node_batch(tree: Tree, number: int, weights: np.ndarray, edges: list[np.ndarray]) -> pa.RecordBatch:
    """The nodes of a tree in Spark's format."""
    n, stats = len(tree.feature), tree.counts * weights
    sums = stats.sum(axis=1)
    impurity = 1.0 - ((stats / np.where(sums > 0, sums, 1.0)[:, None]) ** 2).sum(axis=1)
    inner = tree.feature >= 0
    bounds = pa.array([float(edges[f][c]) for f, c in zip(tree.feature[inner], tree.cut[inner], strict=True)], pa.float64())
    split = pa.StructArray.from_arrays([
        pa.array(tree.feature, pa.int32()), pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(inner)]), pa.int32()), bounds),
        pa.array(np.full(n, -1), pa.int32())], ["featureIndex", "leftCategoriesOrThreshold", "numCategories"])
    data = pa.StructArray.from_arrays([
        pa.array(np.arange(n), pa.int32()), pa.array(stats.argmax(axis=1).astype(float)), pa.array(np.where(sums > 0, impurity, 0.0)),
        pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * stats.shape[1], pa.int32()), pa.array(stats.ravel())),
        pa.array(tree.counts.sum(axis=1).astype(np.int64)), pa.array(tree.gain), pa.array(tree.left, pa.int32()), pa.array(tree.right, pa.int32()), split],
        ["id", "prediction", "impurity", "impurityStats", "rawCount", "gain", "leftChild", "rightChild", "split"])
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, number), pa.int32()), data], ["treeID", "nodeData"])


def settings_of(est: RandomForestClassifier) -> dict:
    return {"seed": est.getSeed(), "min_leaf": est.getMinInstancesPerNode(), "depth": est.getMaxDepth()}


def tasks_of(spark: SparkSession, trees: int) -> int:
    return min(trees, TASKS_PER_CORE * spark.sparkContext.defaultParallelism)


@dataclass
class ForestModel:
    """A fitted forest; ``est`` has its settings."""
    trees: list[Tree]
    weights: np.ndarray
    edges: list[np.ndarray]
    est: RandomForestClassifier

    def transform(self, rows: DataFrame, vector_col: str = "features") -> DataFrame:
        """``rows`` with rawPrediction (votes), probability (vectors) and prediction."""
        held = rows.sparkSession.sparkContext.broadcast((self.trees, self.weights, self.edges))  # bounded by the settings

        @F.pandas_udf("array<double>")
        def votes(x: pd.Series) -> pd.Series:
            trees, weights, edges = held.value
            if not len(x):
                return pd.Series([], dtype=object)
            bins = to_bins(np.stack(x.to_numpy()), edges)
            return pd.Series(list(sum(votes_of(tree, weights, bins) for tree in trees)))

        out = rows.withColumn("_v", votes(vector_to_array(vector_col)))
        total = F.aggregate("_v", F.lit(0.0), lambda a, v: a + v)
        share = F.transform("_v", lambda v: F.when(total > 0, v / total).otherwise(0.0))
        said = (F.array_position("_v", F.array_max("_v")) - 1).cast("double")
        return out.withColumns({"rawPrediction": array_to_vector("_v"), "probability": array_to_vector(share), "prediction": said}).drop("_v")

    def importance(self) -> np.ndarray:
        """Mean over the trees of the shares of the features in a tree's gains, weighted by the
        nodes' rows; adding up to 1."""
        all_ = np.zeros(len(self.edges))
        for tree in self.trees:
            inner = tree.feature >= 0
            own = np.bincount(tree.feature[inner], tree.gain[inner] * (tree.counts[inner] * self.weights).sum(axis=1), len(all_))
            all_ += own / own.sum() if own.sum() else own
        return all_ / all_.sum() if all_.sum() else all_

    def tree_arrays(self) -> list[dict]:
        """The trees as node arrays with thresholds (left when x <= threshold) and the share of
        class 1."""
        out = []
        for tree in self.trees:
            stats = tree.counts * self.weights
            cover = stats.sum(axis=1)
            out.append({"left": tree.left.astype(np.int64), "right": tree.right.astype(np.int64), "feature": tree.feature.astype(np.int64),
                        "threshold": np.array([self.edges[f][c] if f >= 0 else 0.0 for f, c in zip(tree.feature, tree.cut, strict=True)]),
                        "value": stats[:, 1] / np.maximum(cover, 1e-300) if stats.shape[1] > 1 else np.zeros(len(cover)), "cover": cover})
        return out

    def as_spark(self, spark: SparkSession) -> RandomForestClassificationModel:
        """Spark's model of the same trees: written in its format, and loaded."""
        path, trees, weights, edges = scratch_path(spark, f"forest_{uuid.uuid4().hex}"), self.trees, self.weights, self.edges
        held = spark.sparkContext.broadcast(trees)

        def nodes(batches):
            for batch in batches:
                for number in batch.column(0).to_pylist():
                    yield node_batch(held.value[number], number, weights, edges)

        spark.range(0, len(trees), 1, max(1, len(trees) // 64)).mapInArrow(nodes, NODE).write.parquet(f"{path}/data")
        self.est.write().save(f"{path}/estimator")
        said = json.loads(spark.read.text(f"{path}/estimator/metadata").first()[0])
        said |= {"class": "org.apache.spark.ml.classification.RandomForestClassificationModel", "numFeatures": len(edges),
                 "numClasses": len(weights), "numTrees": len(trees)}
        tree = {"class": "org.apache.spark.ml.classification.DecisionTreeClassificationModel", "timestamp": said["timestamp"],
                "sparkVersion": said["sparkVersion"], "paramMap": {}, "defaultParamMap": {}}
        spark.createDataFrame([(json.dumps(said),)], "value string").coalesce(1).write.text(f"{path}/metadata")
        each = [(t, json.dumps(tree | {"uid": f"dtc_{uuid.uuid4().hex[:12]}"}), 1.0) for t in range(len(trees))]
        spark.createDataFrame(each, "_1 int, _2 string, _3 double").coalesce(1).write.parquet(f"{path}/treesMetadata")
        return RandomForestClassificationModel.load(path)


def fit_forest(spark: SparkSession, rows, est: RandomForestClassifier) -> ForestModel:
    """The forest of all rows.  ``rows``: a broadcast of ``ForestRows``."""
    how, trees = settings_of(est), est.getNumTrees()
    numbers = spark.sparkContext.parallelize(range(trees), tasks_of(spark, trees))
    return ForestModel(numbers.map(lambda t: grow_tree(rows.value, ALL, t, how).slim()).collect(), rows.value.weights, rows.value.edges, est)


def fold_predictions(spark: SparkSession, rows, est: RandomForestClassifier, fold: int) -> DataFrame:
    """(label, prediction) of the rows of a fold, by a forest of the others."""
    how, n_classes = settings_of(est), len(rows.value.weights)

    def votes(batches):
        r = rows.value
        own = np.flatnonzero(r.fold == fold)
        bins, sums = r.bins[own], np.zeros((len(own), n_classes))
        for batch in batches:
            for number in batch.column(0).to_pylist():
                sums += votes_of(grow_tree(r, fold, number, how), r.weights, bins)
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(r.label[own].astype(float)), *(pa.array(c) for c in sums.T)],
                                         ["row", "label", *(f"s{k}" for k in range(n_classes))])

    names = [f"s{k}" for k in range(n_classes)]
    trees = est.getNumTrees()
    parts = spark.range(0, trees, 1, tasks_of(spark, trees)).mapInArrow(votes, ", ".join(["row bigint", "label double", *(f"{c} double" for c in names)]))
    # rounded: the order in which the tasks' votes are added does not tell ties apart
    all_votes = parts.groupBy("row", "label").agg(F.array(*(F.round(F.sum(c), 9) for c in names)).alias("v"))
    return all_votes.select("label", (F.array_position("v", F.array_max("v")) - 1).cast("double").alias("prediction"))
