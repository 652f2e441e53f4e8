"""Row-level features and encoders."""
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.sql import functions as F

from conftest import survey_df, survey_rows
from trustlens import functions as X
from trustlens.operators import features as FE


def test_ordinal_unseen_is_minus_one(spark):
    rows = survey_rows(4)
    rows[0]["age_group"] = "Unknown"
    out = FE.ordinal_encode(survey_df(spark, rows), ["age_group"]).orderBy("respondent_id")
    codes = [r["age_group"] for r in out.collect()]
    assert codes[0] == -1 and codes[1:] == [1, 2, 3]


def test_constant_column_scales_to_zero(spark):
    df = spark.createDataFrame([(1.0, float(i)) for i in range(5)], "c double, v double")
    v = VectorAssembler(inputCols=["c", "v"], outputCol="raw").transform(df)
    s = StandardScaler(inputCol="raw", outputCol="z", withMean=True, withStd=True).fit(v).transform(v)
    assert all(r["z"][0] == 0.0 for r in s.collect())


def test_posture_rule(spark):
    rows = survey_rows(1, has_mfa_enabled=1, uses_biometric_auth=1, uses_strong_password=1,
                       regularly_updates_app=1, shared_device=0, q_phishing_awareness=1,
                       has_experienced_fraud=0, q_password_hygiene=2)
    assert FE.posture_score(survey_df(spark, rows)).first()["security_posture_score"] == 100
    rows = survey_rows(1, has_mfa_enabled=0, uses_biometric_auth=0, uses_strong_password=0,
                       regularly_updates_app=0, shared_device=1, q_phishing_awareness=5,
                       has_experienced_fraud=1, q_password_hygiene=5)
    assert FE.posture_score(survey_df(spark, rows)).first()["security_posture_score"] == 0


def test_bucketize_strict_thresholds(spark):
    df = spark.createDataFrame([(v,) for v in [-1.2, -1.19, -0.4, 0.4, 0.41, 1.2, 1.3]], "x double")
    out = [r["b"] for r in df.select(X.likert_bucketize(F.col("x")).alias("b")).collect()]
    assert out == [1, 2, 2, 3, 4, 4, 5]


def test_anomaly_tier_upper_inclusive(spark):
    df = spark.createDataFrame([(v,) for v in [0.0, 20.0, 20.1, 40.0, 60.0, 60.5, 100.0]], "s double")
    out = [r["t"] for r in df.select(X.anomaly_tier(F.col("s")).alias("t")).collect()]
    assert out == ["Critical", "Critical", "High", "High", "Medium", "Normal", "Normal"]


def test_alpha_label_nan_first(spark):
    df = spark.createDataFrame([(float("nan"),), (0.95,), (0.65,), (0.1,)], "a double")
    out = [r["l"] for r in df.select(X.alpha_label(F.col("a")).alias("l")).collect()]
    assert out == ["N/A", "Excellent", "Questionable", "Poor"]


def test_median_impute_is_exact(spark):
    rows = [(i, float(i) if i % 7 else None) for i in range(1, 200)]
    df = spark.createDataFrame(rows, "id long, v double")
    exact = FE.median_impute(df, ["v"]).where("id = 7").first()["v"]
    vals = sorted(float(i) for i in range(1, 200) if i % 7)
    m = len(vals)
    assert exact == (vals[(m - 1) // 2] + vals[m // 2]) / 2


def test_weighted_draws_do_not_repeat_with_the_key(spark):
    """Draws of keys a million apart are unrelated, and shares follow the weights."""
    options = [("a", 20), ("b", 30), ("c", 50)]
    df = spark.range(20_000).select(X.weighted_assign(F.col("id"), options).alias("near"),
                                    X.weighted_assign(F.col("id") + 1_000_003, options).alias("far"))
    got = df.agg(F.avg((F.col("near") == F.col("far")).cast("int")).alias("same"),
                 *[F.avg((F.col("near") == n).cast("int")).alias(n) for n, _ in options]).first()
    assert abs(got.same - 0.38) < 0.02  # 0.2^2 + 0.3^2 + 0.5^2
    assert all(abs(got[n] - w / 100) < 0.015 for n, w in options)
