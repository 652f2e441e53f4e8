"""Segmentation: k-means on the 11 scaled clustering features, silhouette by k,
PCA to two components, cluster labels by mean posture, cluster profiles.

**k-means.**  All restarts of all k share the scans: one pass assigns every row under every
(k, restart) set of centres and sums count and vectors per (set, centre); sets that
have settled leave.  The sums are bounded by the settings, whatever the rows.  The rows are
packed once as an RDD of matrices: a pass is one job of two products a block, and planning
a DataFrame query for each takes longer than the job.  Every set starts from centres that k-means++ draws in a sample of ``init_rows`` rows of smallest hash;
the passes cover all rows.

**Silhouette** is Euclidean, over the ``silhouette_rows`` rows of smallest hash (all, if there
are no more), as the reference takes at most 3,000.  The sample is broadcast, its size being a
setting; its rows are dealt over the tasks, each of which takes a block of them against the
sample, for all clusterings at once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import RDD, StorageLevel
from pyspark.ml import Pipeline
from pyspark.ml.feature import PCA
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trustlens import functions as X
from trustlens import schema as S
from trustlens.ml.pipeline import assembler, imputer, row_hash
from trustlens.operators.features import engineer_features
from trustlens.session import materialize

#: Rows that a task takes against all centres, or all sample rows, at once.
BATCH = 256
#: Rows of a packed block.
BLOCK_ROWS = 4096
#: Sums of one pass that all tasks together may send to the driver.
DIRECT_BYTES = 32 << 20


@dataclass(frozen=True)
class ClusterSettings:
    """Defaults are the reference's."""
    k: int = 4
    restarts: int = 20
    max_iter: int = 500
    sweep_restarts: int = 15
    sweep_max_iter: int = 300
    k_range: tuple = (2, 3, 4, 5, 6, 7)
    seed: int = 42
    init_rows: int = 4096
    silhouette_rows: int = 3000
    tolerance: float = 1e-4


def scaled_features(df: DataFrame) -> DataFrame:
    """The rows of ``df`` with the engineered features and ``features``, the vector of the
    11 clustering features, median-imputed and standardised.  The feature table is written
    once to the shared folder and the scaled rows are persisted (reused by every pass)."""
    feats = materialize(engineer_features(df), "cluster_features")
    nulls = feats.agg(*[F.count(F.when(F.col(c).isNull(), 1)).alias(c) for c in S.CLUSTER_FEATURES]).first()
    todo = [c for c in S.CLUSTER_FEATURES if nulls[c] > 0]
    model = Pipeline(stages=assembler(S.CLUSTER_FEATURES, imputed=[imputer(feats, todo)] if todo else None)).fit(feats)
    out = model.transform(feats).select(*feats.columns, "features")
    return out.repartition("respondent_id").persist(StorageLevel.MEMORY_AND_DISK)


# ---------------------------------------------------------------------------
# k-means, all sets of centres in one pass
# ---------------------------------------------------------------------------
@dataclass(frozen=True)
class CentreModel:
    """Fitted centres (cluster, feature) and the cost of the training rows."""
    centres: np.ndarray
    cost: float

    def distances(self, x: Column) -> list[Column]:
        """The squared distance of an array column to every centre."""
        return [sum(((x[i] - float(v)) * (x[i] - float(v)) for i, v in enumerate(c)), F.lit(0.0)) for c in self.centres]

    def transform(self, rows: DataFrame, vector_col: str = "features") -> DataFrame:
        """``rows`` with cluster_id: the nearest centre, the first on a tie."""
        near = F.array_min(F.array(*[F.struct(d.alias("d"), F.lit(i).alias("i")) for i, d in enumerate(self.distances(F.col("_x")))]))
        return rows.withColumn("_x", vector_to_array(vector_col)).withColumn("cluster_id", near["i"]).drop("_x")

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(i, [float(v) for v in c], float(self.cost)) for i, c in enumerate(self.centres)],
                                     "cluster_id int, centre array<double>, cost double")

    @staticmethod
    def load(spark: SparkSession, path: str) -> "CentreModel":
        rows = spark.read.parquet(path).orderBy("cluster_id").collect()  # k rows
        return CentreModel(np.array([r["centre"] for r in rows]), rows[0]["cost"])


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of x to all rows of y."""
    return np.maximum((x * x).sum(axis=1)[:, None] - 2 * x @ y.T + (y * y).sum(axis=1), 0.0)


def matrix(batch, column: str = "x") -> np.ndarray:
    """A column of arrays of one length as a matrix."""
    values = batch.column(column)
    flat = values.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(values), -1) if len(values) else np.zeros((0, 0))


def packed(points: DataFrame) -> DataFrame:
    """``points`` (x: array) as blocks of at most ``BLOCK_ROWS`` rows (x: binary, doubles row
    after row), which a pass reads without turning every number over."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            x = matrix(batch).astype(np.float64)
            blocks = [x[at:at + BLOCK_ROWS].tobytes() for at in range(0, len(x), BLOCK_ROWS)]
            yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.binary())], names=["x"])

    return points.select("x").mapInArrow(run, "x binary")


def matrices(blocks: DataFrame, d: int) -> RDD:
    """The blocks of ``packed`` as matrices of d features, persisted."""
    return blocks.rdd.map(lambda r: np.frombuffer(r["x"]).reshape(-1, d)).persist(StorageLevel.MEMORY_AND_DISK)


def centre_sums(blocks, sets: list[np.ndarray]) -> np.ndarray:
    """Of every centre of all sets, one after the other: the sum of each feature over the rows
    that are nearest to it, their number and the sum of their squared lengths.  A row's own
    squared length is the same to all centres, so one product gives what is compared; sets of
    one size are taken together; a second product sums the members of all."""
    every = np.concatenate(sets)
    sizes = np.array([len(c) for c in sets])
    first = np.cumsum([0, *sizes[:-1]])
    groups = [first[sizes == k] + np.arange(k)[:, None] for k in np.unique(sizes)]  # (centre, set)
    order = np.concatenate([g.ravel() for g in groups])
    every = every[order]
    sides = np.concatenate([-2 * every, (every * every).sum(axis=1)[:, None]], axis=1)
    found = np.zeros((len(every), every.shape[1] + 2))
    for x in blocks:
        rows = np.concatenate([x, np.ones((len(x), 1)), (x * x).sum(axis=1)[:, None]], axis=1)
        for part in (rows[at:at + BATCH] for at in range(0, len(rows), BATCH)):
            far, at = sides @ part[:, :-1].T, 0
            member = np.empty(far.shape, dtype=bool)
            for k, s in (g.shape for g in groups):
                of = far[at:at + k * s].reshape(k, -1)
                own = np.equal(of, of.min(axis=0), out=member[at:at + k * s].reshape(k, -1))
                if np.count_nonzero(own) != of.shape[1]:  # the first on a tie
                    own[...] = of.argmin(axis=0) == np.arange(k)[:, None]
                at += k * s
            found += member.astype(np.float64) @ part
    out = np.empty_like(found)
    out[order] = found
    return out


def costs_of(sums: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The squared distances of every centre's rows to it, from ``centre_sums``."""
    s, n, q = sums[:, :-2], sums[:, -2], sums[:, -1]
    return np.maximum(q - 2 * (s * centres).sum(axis=1) + n * (centres * centres).sum(axis=1), 0.0)


def lloyd_sums(points: DataFrame, sets: list[np.ndarray]) -> DataFrame:
    """One pass over ``points`` (x: array, or blocks of ``packed``): (set, centre, n, cost, one
    sum per feature)."""
    import pyarrow as pa
    every = np.concatenate(sets)
    blocks = dict(points.dtypes)["x"] == "binary"
    which = np.repeat(np.arange(len(sets)), [len(c) for c in sets])
    centre = np.concatenate([np.arange(len(c)) for c in sets])
    names = [f"s{i}" for i in range(every.shape[1])]

    def run(batches):
        parts = (np.frombuffer(v.as_buffer()).reshape(-1, every.shape[1]) for b in batches for v in b.column("x")) if blocks else map(matrix, batches)
        sums = centre_sums((x for x in parts if len(x)), sets)
        yield pa.RecordBatch.from_arrays(
            [pa.array(which.astype(np.int32)), pa.array(centre.astype(np.int32)), pa.array(sums[:, -2].astype(np.int64)),
             pa.array(costs_of(sums, every)), *[pa.array(np.ascontiguousarray(sums[:, i])) for i in range(len(names))]],
            names=["set", "centre", "n", "cost", *names])

    parts = points.select("x").mapInArrow(run, "set int, centre int, n long, cost double, " + ", ".join(f"{c} double" for c in names))
    return parts.groupBy("set", "centre").agg(*[F.sum(c).alias(c) for c in ["n", "cost", *names]])


def lloyd_pass(blocks: RDD, sets: list[np.ndarray]) -> np.ndarray:
    """``centre_sums`` of all blocks in one job.  The tasks' sums meet on executors first, where
    they are more than ``DIRECT_BYTES``."""
    sent = blocks.getNumPartitions() * sum(c.shape[0] * (c.shape[1] + 2) for c in sets) * 8
    return blocks.mapPartitions(lambda it: [centre_sums(it, sets)]).treeReduce(np.add, 1 if sent <= DIRECT_BYTES else 2)


def _first_centres(sample: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k-means++: each next centre with a chance that grows with the squared distance."""
    rng = np.random.default_rng([seed, k])
    centres = sample[[rng.integers(len(sample))]]
    near = squared(sample, centres)[:, 0]
    while len(centres) < k:
        total = near.sum()
        at = rng.choice(len(sample), p=near / total) if total > 0 else rng.integers(len(sample))
        centres = np.concatenate([centres, sample[[at]]])
        near = np.minimum(near, squared(sample, sample[[at]])[:, 0])
    return centres


def hash_sample(rows: DataFrame, n: int, seed: int) -> DataFrame:
    """The n rows of smallest hash of (respondent_id, seed)."""
    return rows.orderBy(row_hash("respondent_id", seed), "respondent_id").limit(n)


def fit_shared(scaled: DataFrame, fits: list[tuple[int, int, int]], cfg: "ClusterSettings | None" = None,
               vector_col: str = "features") -> list[CentreModel]:
    """For each (k, restarts, iterations) the model of least cost among its restarts."""
    cfg = cfg or ClusterSettings()
    points = scaled.select("respondent_id", vector_to_array(vector_col).alias("x"))
    sample = np.array([r["x"] for r in hash_sample(points, cfg.init_rows, cfg.seed).select("x").collect()])
    if not len(sample):
        raise ValueError("no rows to cluster")
    blocks = matrices(packed(points), sample.shape[1])
    settled = cfg.tolerance * sample.var(axis=0).mean()  # the reference's rule
    owner, left, centres = [], [], []
    for i, (k, restarts, iterations) in enumerate(fits):
        for r in range(restarts):
            owner.append(i)
            left.append(iterations)
            centres.append(_first_centres(sample, k, cfg.seed + r))
    active = list(range(len(centres)))
    while active:
        found = lloyd_pass(blocks, [centres[j] for j in active])
        ends = np.cumsum([len(centres[j]) for j in active])[:-1]
        still = []
        for j, sums in zip(active, np.split(found, ends), strict=True):
            n = sums[:, -2:-1]
            new = np.where(n > 0, sums[:, :-2] / np.maximum(n, 1), centres[j])  # a centre without rows stays
            shift = ((new - centres[j]) ** 2).sum()
            centres[j], left[j] = new, left[j] - 1
            if shift > settled and left[j] > 0:
                still.append(j)
        active = still
    costs = costs_of(lloyd_pass(blocks, centres), np.concatenate(centres))
    costs = [c.sum() for c in np.split(costs, np.cumsum([len(c) for c in centres])[:-1])]
    blocks.unpersist()
    best = [min((j for j, o in enumerate(owner) if o == i), key=lambda j: costs[j]) for i in range(len(fits))]
    return [CentreModel(centres[j], float(costs[j])) for j in best]


# ---------------------------------------------------------------------------
# silhouette
# ---------------------------------------------------------------------------
def silhouette_rows(rows: DataFrame, labels: list[str], vector: Column, limit: int = 3000, seed: int = 42) -> DataFrame:
    """(respondent_id, one silhouette per label column) of the sampled rows: (b - a) /
    max(a, b) with a the mean Euclidean distance to the other rows of the own cluster and b
    the least mean distance to another cluster's; 0 in a cluster of one row.  Labels are
    whole numbers."""
    spark = rows.sparkSession
    slim = rows.select("respondent_id", vector.alias("x"), *[F.col(c).cast("int").alias(c) for c in labels])
    sample = materialize(hash_sample(slim, limit, seed), "silhouette_sample")
    held = sample.toPandas()  # at most ``limit`` rows
    names = [f"silhouette_{c}" for c in labels]
    if not len(held):
        return sample.select("respondent_id", *[F.lit(None).cast("double").alias(c) for c in names])
    every = spark.sparkContext.broadcast((np.stack(held["x"].to_numpy()), {c: held[c].to_numpy() for c in labels}))

    def run(batches):
        x, groups = every.value
        member = {c: (g[:, None] == np.unique(g)).astype(float) for c, g in groups.items()}
        for pdf in batches:
            for at in range(0, len(pdf), BATCH):
                part = pdf.iloc[at:at + BATCH]
                own = np.stack(part["x"].to_numpy())
                far = np.zeros((len(own), len(x)))
                for i in range(own.shape[1]):  # differences, not products: equal rows are at 0
                    far += (own[:, i, None] - x[:, i]) ** 2
                far = np.sqrt(far)
                out = {"respondent_id": part["respondent_id"].to_numpy()}
                for c, name in zip(labels, names, strict=True):
                    total, sizes = far @ member[c], member[c].sum(axis=0)
                    mine = part[c].to_numpy()[:, None] == np.unique(groups[c])
                    size = (mine * sizes).sum(axis=1)
                    a = (total * mine).sum(axis=1) / np.maximum(size - 1, 1)
                    b = np.where(mine, np.inf, total / sizes).min(axis=1)
                    with np.errstate(invalid="ignore"):
                        s = (b - a) / np.maximum(a, b)
                    out[name] = np.where((size > 1) & np.isfinite(b) & (np.maximum(a, b) > 0), s, 0.0)
                yield pd.DataFrame(out)

    dealt = sample.repartition(spark.sparkContext.defaultParallelism, "respondent_id")
    return dealt.mapInPandas(run, "respondent_id bigint, " + ", ".join(f"{c} double" for c in names))


def silhouette(scaled: DataFrame, cfg: ClusterSettings, models: list[CentreModel] | None = None) -> DataFrame:
    """(k, silhouette_score, inertia) for each k of the sweep."""
    models = models or fit_shared(scaled, [(k, cfg.sweep_restarts, cfg.sweep_max_iter) for k in cfg.k_range], cfg)
    # only the sampled rows are assigned
    rows, labels = hash_sample(scaled.select("respondent_id", "features"), cfg.silhouette_rows, cfg.seed), []
    for k, model in zip(cfg.k_range, models, strict=True):
        rows = model.transform(rows).withColumnRenamed("cluster_id", f"k{k}")
        labels.append(f"k{k}")
    found = silhouette_rows(rows, labels, vector_to_array("features"), cfg.silhouette_rows, cfg.seed)
    score = found.agg(*[F.avg(f"silhouette_{c}").alias(c) for c in labels]).first()
    sdf = scaled.sparkSession.createDataFrame(
        [(int(k), score[f"k{k}"], m.cost) for k, m in zip(cfg.k_range, models, strict=True)], "k int, silhouette double, inertia double")
    return sdf.select("k", X.rnd(F.col("silhouette"), 4).alias("silhouette_score"), X.rnd(F.col("inertia"), 1).alias("inertia"))


def best_k(sil: DataFrame) -> DataFrame:
    """k with the highest silhouette (smallest k on a tie); reported only."""
    return sil.agg(F.max_by("k", F.struct("silhouette_score", -F.col("k"))).alias("best_k"),
                   F.max("silhouette_score").alias("silhouette_score"))


def pca(scaled: DataFrame, k: int = 2):
    """PCA model and (respondent_id, pca_1, pca_2); inputs are standardised, so
    Spark's uncentred projection equals the centred one."""
    model = PCA(k=k, inputCol="features", outputCol="pca").fit(scaled)
    return model, pca_columns(model, scaled).select("respondent_id", *[f"pca_{i + 1}" for i in range(k)])


def pca_columns(model, scaled: DataFrame) -> DataFrame:
    arr = vector_to_array(F.col("pca"))
    return model.transform(scaled).withColumns({f"pca_{i + 1}": arr[i] for i in range(model.getK())}).drop("pca")


def cluster_labels(assigned: DataFrame) -> DataFrame:
    """(cluster_id, cluster_label): clusters ranked by mean posture, highest
    first, then labelled in that order (k rows, a bound of the model)."""
    means = assigned.groupBy("cluster_id").agg(F.avg("security_posture_score").alias("mp"))
    # window over the k cluster rows only
    ranked = means.withColumn("r", F.row_number().over(Window.orderBy(F.desc("mp"), "cluster_id")) - 1)
    labels = F.create_map(*[x for i, l in enumerate(S.CLUSTER_LABELS) for x in (F.lit(i), F.lit(l))])
    return ranked.select("cluster_id", F.coalesce(labels[F.col("r")],
                                                  F.concat(F.lit("Cluster "), F.col("r").cast("string")))
                         .alias("cluster_label"))


def join_cluster_label(assigned: DataFrame) -> DataFrame:
    return assigned.join(F.broadcast(cluster_labels(assigned)), "cluster_id", "left")


def run_clustering(df: DataFrame, cfg: ClusterSettings | None = None, scaled: DataFrame | None = None) -> dict:
    """Sweep, final model, PCA, labels and profiles.  ``scaled``: ``scaled_features(df)``
    if there already."""
    cfg = cfg or ClusterSettings()
    scaled = scaled_features(df) if scaled is None else scaled
    pca_model, _ = pca(scaled)
    # the final restarts and the sweep share their passes
    km, *sweep = fit_shared(scaled, [(cfg.k, cfg.restarts, cfg.max_iter),
                                     *[(k, cfg.sweep_restarts, cfg.sweep_max_iter) for k in cfg.k_range]], cfg)
    sil = silhouette(scaled, cfg, sweep)
    # the two models are applied one after the other: no join of their outputs
    labelled = join_cluster_label(pca_columns(pca_model, km.transform(scaled)))
    profiles = cluster_profiles(labelled)
    ev = [round(float(v) * 100, 1) for v in pca_model.explainedVariance.toArray()]
    return {"assignments": labelled, "profiles": profiles, "silhouette": sil, "best_k": best_k(sil),
            "model": km, "pca_model": pca_model, "explained_variance_pct": ev, "scaled": scaled}


def cluster_profiles(labelled: DataFrame) -> DataFrame:
    """Per cluster: mean of every clustering feature (3 dp), label, members,
    fraud rate %."""
    aggs = [X.rnd(F.avg(c), 3).alias(c) for c in S.CLUSTER_FEATURES]
    return (labelled.groupBy("cluster_id", "cluster_label")
            .agg(*aggs, F.count(F.lit(1)).alias("n_members"),
                 X.rnd(F.avg("has_experienced_fraud") * 100, 1).alias("fraud_rate_pct"))
            .orderBy("cluster_id"))
