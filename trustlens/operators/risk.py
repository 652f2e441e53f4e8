"""Risk scoring: channel risk, attack surface, security gaps, posture by
segment, vulnerable cohorts.

Every operator is one scan of the respondent table with partial (map-side)
aggregation into a key space of at most a few dozen groups, so a segment value
holding a third of all rows costs one buffer row per map task, not a hot
reducer.  The static weight tables are fixed six-row dimensions and are
broadcast.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trustlens import functions as X
from trustlens import schema as S

# Fixed value: composite (mean of the five weights) of each channel, and the
# normaliser of the attack surface (sum of composites * 100, summed in the
# order Mobile, UPI, Internet, ATM, NEFT/RTGS, Aadhaar).
COMPOSITE = {row[1]: sum(row[3:8]) / 5 for row in S.CHANNEL_WEIGHTS}
MAX_EXPOSURE = sum(COMPOSITE[c] * 100 for c in [
    "Mobile Banking", "UPI / Payments", "Internet Banking", "ATM Services", "NEFT/RTGS",
    "Aadhaar Pay"])


def _spark(df: DataFrame) -> SparkSession:
    return df.sparkSession


def posture_by_segment(df: DataFrame, segment: str) -> DataFrame:
    """Mean posture (1 dp), % posture >= 70 (1 dp) and n per segment value."""
    p = X.posture_expr()
    return (df.groupBy(F.col(segment).alias("segment_value"))
            .agg(F.sum(p).alias("_s"), F.sum((p >= 70).cast("int")).alias("_h"),
                 F.count(p).alias("n"))
            .select("segment_value",
                    X.rnd(F.col("_s") / F.col("n"), 1).alias("mean_posture"),
                    X.pct(F.col("_h"), F.col("n")).alias("high_posture_pct"),
                    F.col("n").cast("bigint").alias("n"))
            .orderBy(F.desc("mean_posture"), "segment_value"))


def vulnerable_cohorts(df: DataFrame, segments: list[str] | None = None) -> DataFrame:
    """Vulnerable share (posture < 40 and (no MFA or fraud victim)), mean
    posture and n for every value of each segment column, all in one table.

    One ``GROUPING SETS`` aggregate: a single scan, Expand by the number of
    segments, partial aggregation, one shuffle of about 25 keys.
    """
    segments = segments or S.COHORT_SEGMENTS
    p = X.posture_expr()
    rows = df.select(*segments, p.alias("_p"), X.vulnerable_expr(p).alias("_v"))
    g = (rows.groupingSets([[c] for c in segments], *segments)
         .agg(F.sum("_v").alias("_vs"), F.sum("_p").alias("_ps"), F.count("_p").alias("n"),
              F.grouping_id(*segments).alias("_gid")))
    nseg = len(segments)
    seg_name = None
    for i, c in enumerate(segments):
        # grouping_id bit of column i is set when the column is aggregated away
        gid = (1 << nseg) - 1 - (1 << (nseg - 1 - i))
        seg_name = (F.when(F.col("_gid") == gid, c) if seg_name is None
                    else seg_name.when(F.col("_gid") == gid, c))
    value = F.coalesce(*[F.col(c).cast("string") for c in segments])
    return (g.select(seg_name.alias("segment"), value.alias("segment_value"),
                     X.pct(F.col("_vs"), F.col("n")).alias("vulnerable_pct"),
                     X.rnd(F.col("_ps") / F.col("n"), 1).alias("mean_posture"),
                     F.col("n").cast("bigint").alias("n"))
            .orderBy(F.desc("vulnerable_pct"), "segment", "segment_value"))


def vulnerable_cohorts_union(df: DataFrame, segments: list[str] | None = None) -> DataFrame:
    """Same table as ``vulnerable_cohorts``, built as a row union of one
    group-by per segment (``unionByName``); Spark reuses the one scan."""
    segments = segments or S.COHORT_SEGMENTS
    p = X.posture_expr()
    rows = df.select(*segments, p.alias("_p"), X.vulnerable_expr(p).alias("_v"))
    parts = [rows.groupBy(F.col(c).cast("string").alias("segment_value"))
             .agg(F.sum("_v").alias("_vs"), F.sum("_p").alias("_ps"), F.count("_p").alias("n"))
             .withColumn("segment", F.lit(c)) for c in segments]
    u = reduce(lambda a, b: a.unionByName(b), parts)
    return (u.select("segment", "segment_value",
                     X.pct(F.col("_vs"), F.col("n")).alias("vulnerable_pct"),
                     X.rnd(F.col("_ps") / F.col("n"), 1).alias("mean_posture"),
                     F.col("n").cast("bigint").alias("n"))
            .orderBy(F.desc("vulnerable_pct"), "segment", "segment_value"))


def top_cohorts(cohorts: DataFrame, k: int = 15) -> DataFrame:
    """The k most vulnerable cohorts with a ``segment: value`` label."""
    return (cohorts.orderBy(F.desc("vulnerable_pct"), "segment", "segment_value").limit(k)
            .withColumn("label", F.concat_ws(": ", "segment", "segment_value")))


def _adoption_long(df: DataFrame) -> DataFrame:
    """(service_col, adopters, total): one wide aggregate, then unpivot."""
    wide = df.agg(*[F.sum(c).cast("bigint").alias(c) for c in S.SERVICE_COLUMNS],
                  F.count(F.lit(1)).alias("total"))
    return wide.unpivot(["total"], S.SERVICE_COLUMNS, "service_col", "adopters")


def join_channel_weights(df: DataFrame) -> DataFrame:
    """(service_col, adopters, total) joined to the channel weight table
    (6 fixed rows, broadcast); services without weights are skipped."""
    w = F.broadcast(S.channel_weights_df(_spark(df)))
    return _adoption_long(df).join(w, "service_col", "inner")


def channel_risk_matrix(df: DataFrame) -> DataFrame:
    """Per channel: adoption %, the five weights * 100, composite and
    adoption-weighted risk; sorted by weighted risk descending."""
    j = join_channel_weights(df)
    composite = reduce(lambda a, b: a + b, [F.col(c) for c in S.RISK_WEIGHT_NAMES]) / 5
    adoption = F.col("adopters") / F.col("total")
    return (j.select(
        "channel",
        X.rnd(adoption * 100, 1).alias("adoption_pct"),
        *[X.rnd(F.col(c) * 100, 1).alias(c) for c in S.RISK_WEIGHT_NAMES],
        X.rnd(composite * 100, 1).alias("composite_risk_score"),
        X.rnd(composite * adoption * 100, 1).alias("weighted_risk_score"),
        "ord")
        .orderBy(F.desc("weighted_risk_score"), "ord").drop("ord"))


def attack_surface(df: DataFrame) -> DataFrame:
    """One row: raw exposure (sum of rounded weighted scores), normalised
    attack surface (0-100), MFA, fraud, shared-device %, risk level."""
    m = channel_risk_matrix(df)
    # weighted_risk_score has one decimal: sum it as exact tenths.
    raw = m.agg(F.sum(F.round(F.col("weighted_risk_score") * 10).cast("bigint")) / 10).scalar()
    pop = df.agg(F.sum("has_mfa_enabled").alias("mfa"), F.sum("has_experienced_fraud").alias("fr"),
                 F.sum("shared_device").alias("sh"), F.count(F.lit(1)).alias("n"))
    norm = F.least(F.col("raw") / MAX_EXPOSURE * 100, F.lit(100.0))
    return (pop.withColumn("raw", raw)  # scalar subquery over the 6-row matrix
            .select(X.rnd(F.col("raw"), 2).alias("raw_exposure_score"),
                    X.rnd(norm, 1).alias("normalised_attack_surface"),
                    X.pct(F.col("mfa"), F.col("n")).alias("mfa_coverage_pct"),
                    X.pct(F.col("fr"), F.col("n")).alias("fraud_incidence_pct"),
                    X.pct(F.col("sh"), F.col("n")).alias("shared_device_pct"),
                    X.risk_level(norm).alias("risk_level")))


def security_gaps(df: DataFrame) -> DataFrame:
    """Seven gaps with fixed severity; prevalence from one aggregate;
    priority = severity * prevalence / 100 (2 dp); priority descending."""
    a = df.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("has_mfa_enabled").alias("mfa"), F.sum("shared_device").alias("sh"),
        F.sum("uses_biometric_auth").alias("bio"),
        F.sum((F.col("q_password_hygiene") >= 4).cast("int")).alias("pw"),
        F.sum((F.col("q_phishing_awareness") >= 4).cast("int")).alias("ph"),
        F.sum("regularly_updates_app").alias("upd"),
        F.sum("has_experienced_fraud").alias("fr"),
        F.sum(((F.col("has_experienced_fraud") == 1) & (F.col("reported_to_bank") == 0))
              .cast("int")).alias("unrep"))
    n = F.col("n")
    prevalence = [
        X.rnd((1 - F.col("mfa") / n) * 100, 1),
        X.rnd(F.col("sh") / n * 100, 1),
        X.rnd((1 - F.col("bio") / n) * 100, 1),
        X.rnd(F.col("pw") / n * 100, 1),
        X.rnd(F.col("ph") / n * 100, 1),
        X.rnd((1 - F.col("upd") / n) * 100, 1),
        F.when(F.col("fr") > 0, X.rnd(F.col("unrep") / F.col("fr") * 100, 1)).otherwise(0.0),
    ]
    structs = [F.struct(F.lit(g).alias("gap"), F.lit(sev).alias("severity"),
                        prev.alias("prevalence_pct"), F.lit(mit).alias("mitigation"),
                        F.lit(i).alias("ord"))
               for i, ((g, sev, mit), prev) in enumerate(zip(S.SECURITY_GAPS, prevalence))]
    rows = a.select(F.explode(F.array(*structs)).alias("g")).select("g.*")
    return (rows.withColumn("priority_score",
                            X.rnd(F.col("severity") * F.col("prevalence_pct") / 100, 2))
            .orderBy(F.desc("priority_score"), "ord")
            .select("gap", F.col("severity").cast("int").alias("severity"), "prevalence_pct",
                    "mitigation", "priority_score"))


def threat_actor_table(spark: SparkSession) -> DataFrame:
    """Static actor table; tactics joined by ' | '."""
    return S.threat_actors_df(spark).select(
        "threat_actor", "primary_target",
        F.array_join("tactics", " | ").alias("tactics"), "skill_level", "motivation")


def exposure_score(df: DataFrame) -> DataFrame:
    """Per respondent: channel exposure = sum of the composites of the adopted
    channels, normalised to 0-100 by the all-channel total (1 dp), and the
    risk level rule (> 70 Critical, > 50 High, else Medium)."""
    raw = reduce(lambda a, b: a + b, [F.when(F.col(svc) == 1, F.lit(COMPOSITE[ch] * 100)).otherwise(0.0)
                                      for svc, ch, *_ in S.CHANNEL_WEIGHTS])
    norm = F.least(raw / MAX_EXPOSURE * 100, F.lit(100.0))
    return df.select("respondent_id", X.rnd(norm, 1).alias("exposure_score"),
                     X.risk_level(norm).alias("risk_level"))
