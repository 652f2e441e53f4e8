"""Feature assembly, stratified split / folds and class weights.

Ranks within a class are computed without a window over the whole class (a
class may hold a third of all rows): rows carry a mixing hash h of
(id, seed); the hash range is cut into 2^20 buckets, rows are counted per
(class, bucket) -- a table bounded by the bucket count, not by the data --
and a running count over those buckets gives each bucket's offset.  The exact
rank is offset + position inside the bucket, a window over one bucket's rows
(about n / 2^20 of them).
"""

from __future__ import annotations

from pyspark.ml.feature import Imputer, ImputerModel, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trustlens.operators.features import feature_table
from trustlens.operators.ranks import quantiles
from trustlens.session import materialize

HASH_BITS = 60               # 15 hex digits of an md5
BUCKET_SHIFT = 40            # 2^60 >> 40 = 2^20 buckets


def row_hash(id_col: str, seed: int) -> F.Column:
    """A mixing hash of (id, seed) in [0, 2^60): the first 15 hex digits of the md5 of
    ``id:seed``, which other SQL engines can state as well."""
    text = F.concat(F.col(id_col).cast("bigint").cast("string"), F.lit(f":{seed}"))
    return F.conv(F.substring(F.md5(text), 1, HASH_BITS // 4), 16, 10).cast("bigint")


def rank_within_class(df: DataFrame, class_col: str, id_col: str = "respondent_id",
                      seed: int = 42) -> DataFrame:
    """Add ``_rank`` (0-based rank of (hash, id) inside the class) and ``_n``
    (class size), exactly, with no window wider than one hash bucket."""
    h = row_hash(id_col, seed)
    rows = df.withColumn("_h", h).withColumn("_b", F.shiftright("_h", BUCKET_SHIFT))
    counts = rows.groupBy(class_col, "_b").agg(F.count(F.lit(1)).alias("_bn"))
    wc = (Window.partitionBy(class_col).orderBy("_b")
          .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    offsets = (counts.withColumn("_off", F.sum("_bn").over(wc) - F.col("_bn"))
               .withColumn("_n", F.sum("_bn").over(Window.partitionBy(class_col))))
    wb = Window.partitionBy(class_col, "_b").orderBy("_h", id_col)
    local = rows.withColumn("_pos", F.row_number().over(wb) - 1)
    return (local.join(offsets.select(class_col, "_b", "_off", "_n"), [class_col, "_b"])
            .withColumn("_rank", (F.col("_off") + F.col("_pos")).cast("bigint"))
            .drop("_h", "_b", "_pos", "_off"))


def stratified_split(df: DataFrame, label: str, test_size: float = 0.2, seed: int = 42,
                     id_col: str = "respondent_id") -> DataFrame:
    """Add ``is_test``: per class, the floor(test_size * n_class + 0.5) rows
    with the smallest hash of (id, seed) form the test part."""
    r = rank_within_class(df, label, id_col, seed)
    k = F.floor(F.col("_n") * test_size + 0.5)
    return r.withColumn("is_test", (F.col("_rank") < k).cast("int")).drop("_rank", "_n")


def stratified_kfold(df: DataFrame, label: str, k: int = 5, seed: int = 42,
                     id_col: str = "respondent_id") -> DataFrame:
    """Add ``fold`` in 0..k-1: rank within class (by hash) modulo k, so every
    fold holds floor or ceil of n_class / k rows of each class."""
    r = rank_within_class(df, label, id_col, seed)
    return r.withColumn("fold", (F.col("_rank") % k).cast("int")).drop("_rank", "_n")


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """(label, n, weight) with the balanced weight n_total / (k * n_class)."""
    c = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    tot = df.select(F.count(F.lit(1)).cast("double")).scalar()
    k = c.select(F.count(F.lit(1)).cast("double")).scalar()
    return c.withColumn("weight", tot / (k * F.col("n")))


def weight_of(train: DataFrame, label: str, value: F.Column) -> F.Column:
    """The balanced weight of ``value``: a look-up in a map of one entry per class, from
    one count of the training rows.  No row is shuffled by its label."""
    weights = class_weights(train, label).agg(F.map_from_entries(F.collect_list(F.struct(label, "weight")))).scalar()
    return F.element_at(weights, value)


def imputer(df: DataFrame, columns: list[str]) -> ImputerModel:
    """An ``ImputerModel`` with the exact medians of ``columns``."""
    found = {r["column"]: r["value"] for r in quantiles(df, columns).collect()}  # one row a column
    medians = df.sparkSession.createDataFrame([tuple(found.get(c, 0.0) for c in columns)], ", ".join(f"`{c}` double" for c in columns))
    model = Imputer(strategy="mean", inputCols=columns, outputCols=[f"{c}__imp" for c in columns]).fit(medians)
    return model  # the mean of one row of medians


def assembler(features: list[str], scale: bool = True, imputed: list | None = None) -> list:
    """Stages: the given (fitted) imputer -> VectorAssembler -> StandardScaler, fit on
    the data the pipeline is fit on (the training part)."""
    stages, cols = [], list(features)
    if imputed:
        stages.append(imputed[0])
        done = set(imputed[0].getInputCols())
        cols = [f"{c}__imp" if c in done else c for c in features]
    stages.append(VectorAssembler(inputCols=cols, outputCol="raw_features", handleInvalid="keep"))
    if scale:
        stages.append(StandardScaler(inputCol="raw_features", outputCol="features",
                                     withMean=True, withStd=True))
    return stages


def fold_scalers(train: DataFrame, values: F.Column, folds: int) -> DataFrame:
    """(fold, feature, n, mean, std): the scaler of the rows outside each fold, for every
    entry of the array ``values``.  Counts, sums and sums of squares of all folds come from
    one aggregate; a fold's scaler is the total minus the fold."""
    long = train.select("fold", F.posexplode(values).alias("feature", "x"))
    per = long.groupBy("fold", "feature").agg(F.count("x").alias("n"), F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"))
    every = train.sparkSession.range(folds).select(F.col("id").cast("int").alias("_without"))
    n, s, q = (F.sum(c) for c in ("n", "s", "q"))
    rest = (per.join(F.broadcast(every), F.col("fold") != F.col("_without"))  # folds x folds x features rows
            .groupBy(F.col("_without").alias("fold"), "feature").agg(n.alias("n"), s.alias("s"), q.alias("q")))
    spread = F.greatest(F.col("q") - F.col("s") * F.col("s") / F.col("n"), F.lit(0.0)) / (F.col("n") - 1)
    return rest.select("fold", "feature", "n", (F.col("s") / F.col("n")).alias("mean"), F.sqrt(spread).alias("std"))


def rescaled(vector_col: str, means: list[float], stds: list[float]) -> F.Column:
    """A vector column less ``means``, over ``stds``; 0 where a column is constant."""
    lit = lambda xs: F.array(*[F.lit(float(x)) for x in xs])
    moved = F.zip_with(vector_to_array(vector_col), lit(means), lambda x, m: x - m)
    return array_to_vector(F.zip_with(moved, lit([1 / s if s > 1e-12 else 0.0 for s in stds]), lambda x, f: x * f))


def model_frame(df: DataFrame, target: str, leak_free: bool = True,
                test_size: float = 0.2, seed: int = 42, k_folds: int = 5) -> tuple[DataFrame, list[str]]:
    """Flat feature table + label, split flag, CV fold and class weight, for one
    target; null features are imputed by the column median."""
    flat, feats = feature_table(df, target, leak_free=leak_free)
    lo = flat.select(F.min(target)).scalar()
    flat = flat.withColumn("label", (F.col(target) - lo).cast("double"))  # lo: one row
    # one ranking pass gives both: the test part is the k smallest ranks of
    # each class, so a training row's rank among training rows is rank - k
    ranked = rank_within_class(flat, "label", seed=seed)
    k = F.floor(F.col("_n") * test_size + 0.5)
    is_test = F.col("_rank") < k
    out = (ranked.withColumn("is_test", is_test.cast("int"))
           .withColumn("fold", F.when(~is_test, ((F.col("_rank") - k) % k_folds).cast("int")))
           .drop("_rank", "_n"))
    # written once: the class counts below and every fit read it
    out = materialize(out, f"model_frame_{target}")
    return out.withColumn("weight", weight_of(out.where("is_test = 0"), "label", F.col("label"))), feats
