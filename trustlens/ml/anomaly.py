"""Isolation forest (Liu, Ting, Zhou 2008) as Spark jobs.

1. Tree samples: the min(256, n) rows of smallest hash of (id, seed, tree), exactly.  Only
   hashes below a bound that about twice as many rows meet take part (were a tree short of
   rows, the bound would be doubled); every task then keeps the smallest of each tree before
   the shuffle, so that what meets does not grow with the data.
2. ``groupBy(tree).applyInPandas`` grows one tree per group (random feature,
   uniform cut between the node's min and max, height limit ceil(log2 psi)) and
   emits its node rows.
3. The node table (trees x at most 2 psi nodes: model parameters, bounded by
   the settings, not the data) is broadcast; a pandas function scores every row:
   s = -2^(-mean path length / c(psi)), as a column, so that rows keep their columns.
4. offset = the exact contamination quantile of s; raw
   score = s - offset, flagged when negative; 0-100 min-max score and tiers.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trustlens import functions as X
from trustlens import schema as S
from trustlens.operators.ranks import quantiles
from trustlens.session import materialize

EULER_GAMMA = 0.5772156649015329


@dataclass(frozen=True)
class ForestSettings:
    """Defaults are the reference's."""
    trees: int = 300
    max_samples: int = 256
    contamination: float = 0.08
    seed: int = 42


def c_factor(n):
    """Average path length of an unsuccessful search in a BST of n points."""
    n = np.asarray(n, dtype=float)
    out = np.zeros_like(n)
    big = n > 2
    out[big] = 2.0 * (np.log(n[big] - 1.0) + EULER_GAMMA) - 2.0 * (n[big] - 1.0) / n[big]
    out[n == 2] = 1.0
    return out


NODE_SCHEMA = ("tree int, node int, feature int, threshold double, left int, right int, "
               "size int, depth int")


def _grow(pdf: pd.DataFrame, n_features: int, max_depth: int, seed: int) -> pd.DataFrame:
    tree = int(pdf["tree"].iloc[0])
    x = np.stack(pdf["x"].to_numpy()).astype(float) if len(pdf) else np.zeros((0, n_features))
    rng = np.random.default_rng([seed, tree])
    rows = []
    stack = [(0, np.arange(len(x)), 0)]
    next_id = 1
    while stack:
        nid, idx, depth = stack.pop()
        sub = x[idx]
        leaf = depth >= max_depth or len(idx) <= 1
        if not leaf:
            lo, hi = sub.min(axis=0), sub.max(axis=0)
            free = np.flatnonzero(hi > lo)
            leaf = len(free) == 0
        if leaf:
            rows.append((tree, nid, -1, 0.0, -1, -1, len(idx), depth))
            continue
        f = int(rng.choice(free))
        thr = float(rng.uniform(lo[f], hi[f]))
        go_left = sub[:, f] < thr
        left, right = next_id, next_id + 1
        next_id += 2
        rows.append((tree, nid, f, thr, left, right, len(idx), depth))
        stack.append((right, idx[~go_left], depth + 1))
        stack.append((left, idx[go_left], depth + 1))
    return pd.DataFrame(rows, columns=["tree", "node", "feature", "threshold", "left", "right",
                                       "size", "depth"])


def _forest_arrays(nodes: pd.DataFrame) -> dict:
    """Dense per-tree node arrays (tree, node) -> fields, for vectorised scoring."""
    t = nodes["tree"].to_numpy()
    trees = np.unique(t)
    tmap = {v: i for i, v in enumerate(trees)}
    width = int(nodes["node"].max()) + 1
    shape = (len(trees), width)
    arr = {k: np.full(shape, -1 if k != "threshold" else 0.0,
                      dtype=float if k == "threshold" else np.int64)
           for k in ["feature", "threshold", "left", "right", "size", "depth"]}
    ti = np.array([tmap[v] for v in t])
    ni = nodes["node"].to_numpy()
    for k in arr:
        arr[k][ti, ni] = nodes[k].to_numpy()
    return arr


def _path_lengths(x: np.ndarray, forest: dict) -> np.ndarray:
    """Mean path length over trees for each row of x (vectorised over rows)."""
    n_trees = forest["feature"].shape[0]
    total = np.zeros(len(x))
    rows = np.arange(len(x))
    for t in range(n_trees):
        feat, thr = forest["feature"][t], forest["threshold"][t]
        left, right = forest["left"][t], forest["right"][t]
        node = np.zeros(len(x), dtype=np.int64)
        while True:
            f = feat[node]
            inner = f >= 0
            if not inner.any():
                break
            v = x[rows, np.where(inner, f, 0)]
            nxt = np.where(v < thr[node], left[node], right[node])
            node = np.where(inner, nxt, node)
        total += forest["depth"][t][node] + c_factor(forest["size"][t][node])
    return total / n_trees


#: Modulus of the trees' hashes, and bits of the two numbers that they are made of.
HASH_MODULUS, HASH_DIGITS = (1 << 52) - 47, 13


def tree_samples(rows: DataFrame, trees: int, size: int, seed: int, keep: list[str] | None = None,
                 first_share: float | None = None) -> DataFrame:
    """(tree, respondent_id, the columns ``keep``): for every tree the min(size, n) rows of
    smallest hash.  A row's hash for tree t is (a + t b) modulo a number near 2^52, a and b
    being the first and the next 13 hex digits of the md5 of ``id:seed``."""
    n = rows.count()
    digest = F.md5(F.concat(F.col("respondent_id").cast("bigint").cast("string"), F.lit(f":{seed}")))
    number = lambda at: F.conv(F.substring(digest, at, HASH_DIGITS), 16, 10).cast("bigint")
    slim = rows.select("respondent_id", *(keep or []), number(1).alias("_a"), number(1 + HASH_DIGITS).alias("_b"))
    share = first_share or 2.0 * size / max(n, 1)
    while True:
        bound = HASH_MODULUS if share >= 1 else int(HASH_MODULUS * share)
        hashes = F.transform(F.sequence(F.lit(0).cast("bigint"), F.lit(trees - 1).cast("bigint")), lambda t: F.struct(
            t.cast("int").alias("tree"), ((F.col("_a") + t * F.col("_b")) % HASH_MODULUS).alias("hash")))
        near = slim.select("respondent_id", *(keep or []), F.explode(F.filter(hashes, lambda h: h["hash"] < bound)).alias("h"))
        rank = F.row_number().over(Window.partitionBy("h.tree").orderBy("h.hash", "respondent_id"))
        kept = near.withColumn("_r", rank).where(F.col("_r") <= size)
        taken = materialize(kept.select("h.tree", "respondent_id", *(keep or [])), "tree_samples")
        if share >= 1 or taken.count() == trees * min(size, n):
            return taken
        share *= 2


def isolation_forest(scaled: DataFrame, features: list[str], cfg: ForestSettings | None = None,
                     vector_col: str = "features") -> dict:
    """Fit and score: ``rows`` (all columns of ``scaled`` and the scores), ``scores`` (ids
    and scores), the trees' nodes."""
    cfg = cfg or ForestSettings()
    spark = scaled.sparkSession
    n = scaled.count()
    psi = min(cfg.max_samples, n)
    max_depth = int(math.ceil(math.log2(max(psi, 2))))
    points = scaled.withColumn("_x", vector_to_array(vector_col))
    samples = tree_samples(points, cfg.trees, cfg.max_samples, cfg.seed, ["_x"]).select("tree", F.col("_x").alias("x"))
    d, seed = len(features), cfg.seed
    nodes = samples.groupBy("tree").applyInPandas(
        lambda pdf: _grow(pdf, d, max_depth, seed), NODE_SCHEMA)
    node_pdf = nodes.toPandas()  # model parameters: trees x <= 2*psi nodes
    forest = spark.sparkContext.broadcast(_forest_arrays(node_pdf) if len(node_pdf) else None)
    c_psi = float(c_factor([psi])[0])

    @F.pandas_udf("double")
    def score(x: pd.Series) -> pd.Series:
        return pd.Series(-np.power(2.0, -_path_lengths(np.stack(x.to_numpy()), forest.value) / c_psi) if len(x) else np.zeros(0))

    scored = materialize(points.withColumn("_s", score("_x")).drop("_x"), "iforest_scores")
    offset = quantiles(scored, ["_s"], cfg.contamination).select("value").scalar()
    lo = scored.select(F.min("_s")).scalar() - offset
    hi = scored.select(F.max("_s")).scalar() - offset
    out = scored.withColumn("_raw", F.col("_s") - offset)
    norm = (F.col("_raw") - lo) / (hi - lo + 1e-9) * 100
    out = out.withColumns({"anomaly_score_raw": X.rnd(F.col("_raw"), 4), "anomaly_score": X.rnd(norm, 1), "is_anomaly": F.col("_raw") < 0})
    out = out.withColumn("anomaly_tier", X.anomaly_tier(F.col("anomaly_score"))).drop("_s", "_raw")
    scores = out.select("respondent_id", "anomaly_score_raw", "anomaly_score", "is_anomaly", "anomaly_tier")
    return {"rows": out, "scores": scores, "nodes": node_pdf, "psi": psi, "n": n}


def anomaly_summary(scores: DataFrame) -> DataFrame:
    """Count and % per tier, in tier order."""
    n = scores.select(F.count(F.lit(1))).scalar()
    return (scores.groupBy("anomaly_tier").agg(F.count(F.lit(1)).alias("count"))
            .select(F.col("anomaly_tier").alias("tier"), "count",
                    X.pct(F.col("count"), n).alias("pct"),
                    X.anomaly_tier_ord(F.col("anomaly_tier")).alias("_o"))
            .orderBy("_o").drop("_o"))


def anomaly_profile(rows: DataFrame) -> DataFrame:
    """Mean of each clustering feature for anomalous and normal rows (3 dp); ``rows`` hold
    the flag and the features."""
    return (rows.groupBy(F.when(F.col("is_anomaly"), "Anomalous").otherwise("Normal").alias("group"))
            .agg(*[X.rnd(F.avg(c), 3).alias(c) for c in S.CLUSTER_FEATURES])
            .orderBy("group"))
