"""Row-level features and predicates (one output row per respondent).

All are column expressions appended in one projection, so Catalyst fuses them
into the scan's whole-stage-codegen span; nothing here shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trustlens import functions as X
from trustlens import schema as S
from trustlens.operators.ranks import quantiles


def spt_index(df: DataFrame) -> DataFrame:
    """Mean of the 10 SPT items per row (nulls skipped); lower = more trusting."""
    return df.select("respondent_id", X.row_mean(S.SPT_COLUMNS).alias("spt_index"))


def posture_score(df: DataFrame) -> DataFrame:
    return df.select("respondent_id", X.posture_expr().alias("security_posture_score"))


def feature_columns(leak_free: bool = False, target: str | None = None) -> dict[str, Column]:
    """Engineered features as named expressions, in output order.

    ``leak_free``: posture without the fraud term and the Likert mean without the
    target item (see README: the reference's own set leaks the target).
    """
    posture = X.posture_expr(fraud_term=not (leak_free and target == S.FRAUD_TARGET))
    spt_items = [c for c in S.LIKERT_COLUMNS if not (leak_free and c == target)]
    services = sum((F.col(c) for c in S.SERVICE_COLUMNS), F.lit(0)).cast("int")
    behaviour = sum((F.col(c) for c in ["has_mfa_enabled", "uses_biometric_auth",
                                         "uses_strong_password", "regularly_updates_app"]),
                    F.lit(0)).cast("int")
    return {
        "security_posture_score": posture,
        "num_services_used": services,
        "avg_literacy_score": X.row_mean(S.LITERACY_COLUMNS, 3),
        "avg_spt_score": X.row_mean(spt_items, 3),
        "security_behaviour_count": behaviour,
        "high_usage_intensity": ((F.col("usage_frequency") == "Daily") & (services >= 4)).cast("int"),
    }


def engineer_features(df: DataFrame, leak_free: bool = False, target: str | None = None) -> DataFrame:
    """Append posture, service count, literacy mean, Likert mean, behaviour count
    and high-usage flag to every row."""
    return df.withColumns(feature_columns(leak_free, target))


def vulnerable_flag(df: DataFrame) -> DataFrame:
    posture = X.posture_expr()
    return df.select("respondent_id", posture.alias("security_posture_score"),
                     X.vulnerable_expr(posture).alias("is_vulnerable"))


def high_posture_flag(df: DataFrame) -> DataFrame:
    posture = X.posture_expr()
    return df.select("respondent_id", posture.alias("security_posture_score"),
                     (posture >= 70).cast("int").alias("is_high_posture"))


def fraud_victims(df: DataFrame, victims: bool = True) -> DataFrame:
    return df.where(F.col("has_experienced_fraud") == (1 if victims else 0))


def likert_labels(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Likert codes -> text labels for the given items."""
    columns = columns or S.SPT_COLUMNS
    return df.select("respondent_id", *[X.likert_label(F.col(c)).alias(c + "_label") for c in columns])


def likert_bucketize(df: DataFrame, column: str, out: str = "bucket",
                     thresholds=(-1.2, -0.4, 0.4, 1.2)) -> DataFrame:
    return df.withColumn(out, X.likert_bucketize(F.col(column), thresholds))


def weighted_assign(df: DataFrame, key: str, options: list[tuple[str, int]], out: str,
                    salt: int = 1) -> DataFrame:
    return df.withColumn(out, X.weighted_assign(F.col(key), options, salt))


def minmax_scale(df: DataFrame, column: str, out: str | None = None, scale100: bool = False,
                 eps: float = 0.0) -> DataFrame:
    """(x - min) / (max - min + eps) [* 100].  min and max are scalar subqueries
    over the whole column (one small aggregate, evaluated once)."""
    out = out or column + "_scaled"
    lo = df.select(F.min(column).cast("double")).scalar()
    hi = df.select(F.max(column).cast("double")).scalar()
    v = (F.col(column) - lo) / (hi - lo + eps)
    if scale100:
        v = v * 100
    return df.withColumn(out, v)


def ordinal_encode(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    columns = columns or list(S.ORDINAL_MAPS)
    return df.withColumns({c: X.ordinal_code(c) for c in columns})


def levels_of(df: DataFrame, columns: list[str]) -> dict[str, list[str]]:
    """The values of each column, sorted; one aggregate, as small as the levels are."""
    row = df.agg(*[F.sort_array(F.collect_set(F.col(c).cast("string"))).alias(c) for c in columns]).first()
    return {c: list(row[c]) for c in columns}


def onehot_encode(df: DataFrame, columns: list[str] | None = None,
                  levels: dict[str, list[str]] | None = None) -> DataFrame:
    """Flat one-hot: one 0/1 column ``col_value`` per level, no level dropped, levels
    in sorted order.  Levels are those in the data unless given; finding them is one
    job while the query is built, as the output's columns follow from them.  A null
    belongs to no level."""
    columns = columns or S.NOMINAL_COLUMNS
    levels = levels or levels_of(df, columns)
    out = {}
    for c in columns:
        for v in levels[c]:
            out[f"{c}_{v}"] = F.coalesce((F.col(c) == v).cast("int"), F.lit(0))
    keep = [c for c in df.columns if c not in columns]
    return df.select(*[F.col(f"`{c}`") for c in keep], *[e.alias(n) for n, e in out.items()])


NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double", "boolean")


def is_numeric(kind: str) -> bool:
    return kind in NUMERIC or kind.startswith("decimal")


def numeric_only(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(f"`{n}`") for n, t in df.dtypes if is_numeric(t)])


def median_impute(df: DataFrame, columns: list[str]) -> DataFrame:
    """null -> exact column median.  The medians of all columns come from one pass over
    value counts and enter as one scalar subquery (a map of one entry per column)."""
    medians = quantiles(df, columns).agg(F.map_from_entries(F.collect_list(F.struct("column", "value")))).scalar()
    out = df.withColumn("_medians", medians)
    return out.withColumns({c: F.coalesce(F.col(c).cast("double"), F.element_at("_medians", F.lit(c))) for c in columns}).drop("_medians")


def target_shift(df: DataFrame, target: str, out: str = "label") -> DataFrame:
    lo = df.select(F.min(target)).scalar()
    return df.withColumn(out, (F.col(target) - lo).cast("int"))


def cluster_features(df: DataFrame) -> DataFrame:
    """The 11 numeric clustering features (engineered columns included)."""
    eng = engineer_features(df)
    return eng.select("respondent_id", *S.CLUSTER_FEATURES)


def feature_table(df: DataFrame, target: str, leak_free: bool = False,
                  drop_cols: list[str] | None = None) -> tuple[DataFrame, list[str]]:
    """Flat numeric feature table (respondent_id, target, features...) for ML.

    features = all columns minus id, target and fraud_type (and for the fraud
    target reported_to_bank, fraud_resolved; for trust q_overall_satisfaction),
    ordinals coded, nominals one-hot by the levels in the data, booleans 0/1, decimals
    double, remaining text dropped.
    """
    eng = engineer_features(df, leak_free=leak_free, target=target)
    exclude = {"respondent_id", target, "fraud_type", *(drop_cols or [])}
    if target == S.FRAUD_TARGET:
        exclude.update(["reported_to_bank", "fraud_resolved"])
    if target == S.TRUST_TARGET:
        exclude.add("q_overall_satisfaction")
    enc = onehot_encode(ordinal_encode(eng))
    kinds = dict(enc.dtypes)
    feats = [c for c, t in enc.dtypes if c not in exclude and is_numeric(t)]

    def plain(c: str) -> Column:
        if kinds[c] == "boolean":
            return F.col(f"`{c}`").cast("int").alias(c)
        return F.col(f"`{c}`").cast("double").alias(c) if kinds[c].startswith("decimal") else F.col(f"`{c}`")

    out = enc.select("respondent_id", F.col(target).alias(target), *[plain(c) for c in feats])
    return out, feats


def fit_standard_scaler(df: DataFrame, columns: list[str]) -> dict[str, tuple[float, float]]:
    """Means and sample standard deviations of the columns (one aggregate;
    the result is the scaler's parameters)."""
    row = df.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)],
                 *[F.stddev_samp(c).alias(f"s{i}") for i, c in enumerate(columns)]).first()
    return {c: (float(row[f"m{i}"]), float(row[f"s{i}"] or 0.0)) for i, c in enumerate(columns)}


def standard_scale(df: DataFrame, columns: list[str], params: dict | None = None,
                   digits: int | None = None) -> DataFrame:
    """(x - mean) / std (n - 1) per column; a constant column maps to 0.
    ``params`` from ``fit_standard_scaler`` (fit on the training part)."""
    params = params or fit_standard_scaler(df, columns)
    out = {}
    for c in columns:
        mu, sd = params[c]
        z = (F.col(c).cast("double") - F.lit(mu)) / F.lit(sd) if sd > 0 else F.lit(0.0)
        out[c] = X.rnd(z, digits) if digits is not None else z
    return df.withColumns(out)
