"""Query catalog: rule and encoder queries, sorting and ranks, legacy variants."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from trustlens import schema as S
from trustlens.operators import descriptive as D
from trustlens.operators import features as FE
from trustlens.operators import risk as R
from trustlens.operators import stats as ST
from trustlens.plans import sql as Q
from trustlens.plans.catalog import (_COHORT_SQL, _COUNTS_SQL, _FEATURE_SQL, _summary_sql,
                                     SPT_MEAN_SQL, resp)
from trustlens.plans.catalog_stats import _label

QUERIES: dict = {}
ORACLE: dict = {}


def register(key, sql=None):
    def deco(fn):
        QUERIES[key] = fn
        if sql is not None:
            ORACLE[key] = sql
        return fn
    return deco


_EXPOSURE = " + ".join(
    f"CASE WHEN {svc} = 1 THEN {R.COMPOSITE[ch] * 100!r} ELSE 0.0 END" for svc, ch, *_ in S.CHANNEL_WEIGHTS)


@register("risk_level", Q.with_resp(
    f", e AS (SELECT respondent_id, least(({_EXPOSURE}) / {R.MAX_EXPOSURE!r} * 100, 100.0) AS x"
    " FROM respondents)"
    f" SELECT respondent_id, {Q.r('x', 1)} AS exposure_score,"
    " CASE WHEN x > 70 THEN 'Critical' WHEN x > 50 THEN 'High' ELSE 'Medium' END AS risk_level FROM e"))
def q_risk_level(spark, sf):
    """Per-respondent channel exposure (0-100) and its risk level."""
    return R.exposure_score(resp(spark, sf))


@register("alpha_label", Q.with_resp(
    ", a AS (SELECT region, CAST(10 AS INT) AS items, " + Q.r(
        f"{10 / 9!r} * (1 - (" + " + ".join(f"var_samp({c})" for c in S.SPT_COLUMNS)
        + ") / var_samp(" + " + ".join(S.SPT_COLUMNS) + "))", 4)
    + " AS cronbach_alpha FROM respondents WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in S.SPT_COLUMNS)
    + f" GROUP BY region) SELECT region, items, cronbach_alpha, {_label('cronbach_alpha')} AS reliability"
    " FROM a"))
def q_alpha_label(spark, sf):
    """Reliability label of the SPT scale's alpha within each region."""
    return ST.grouped_reliability(resp(spark, sf), "region", S.SPT_COLUMNS)


def _feature_sql(name: str) -> str:
    if name in _FEATURE_SQL:
        return f"{_FEATURE_SQL[name]}"
    if name in S.ORDINAL_MAPS:
        cases = " ".join(f"WHEN '{v}' THEN {i}" for i, v in enumerate(S.ORDINAL_MAPS[name]))
        return f"CAST(coalesce(CASE {name} {cases} END, -1) AS INT)"
    for c in S.NOMINAL_COLUMNS:
        for v in S.NOMINAL_LEVELS[c]:
            if name == f"{c}_{v}":
                return f"CAST(CASE WHEN {c} = '{v}' THEN 1 ELSE 0 END AS INT)"
    return name


def _fraud_features() -> list[str]:
    """Feature names of the reference's fraud feature set, in matrix order."""
    ordinal = list(S.ORDINAL_MAPS)
    base = [c for c in S.REQUIRED_COLUMNS
            if c not in ("respondent_id", S.FRAUD_TARGET, "fraud_type", "reported_to_bank",
                         "fraud_resolved")
            and (c not in FE_STRINGS or c in ordinal)]
    eng = list(_FEATURE_SQL)
    dummies = [f"{c}_{v}" for c in S.NOMINAL_COLUMNS for v in S.NOMINAL_LEVELS[c]]
    return base + eng + dummies


FE_STRINGS = {"gender", "age_group", "education", "occupation", "income_bracket", "region",
              "bank_type", "usage_frequency", "transaction_frequency", "avg_transaction_amount_tier",
              "device_type", "os_type", "fraud_type"}


@register("feature_matrix", Q.with_resp(
    f" SELECT respondent_id, {S.FRAUD_TARGET}, " + ", ".join(
        f'{_feature_sql(n)} AS "{n}"' for n in _fraud_features()) + " FROM respondents"))
def q_feature_matrix(spark, sf):
    """Flat fraud feature matrix with the reference's feature set: ordinals
    coded, nominals one-hot, engineered features, ids/target/leaky columns out."""
    out, feats = FE.feature_table(resp(spark, sf), S.FRAUD_TARGET, leak_free=False)
    return out


def _z(c: str) -> str:
    x = _FEATURE_SQL.get(c, c)
    return (f"CASE WHEN (SELECT stddev_samp({x}) FROM respondents) > 0 THEN"
            f" (CAST({x} AS DOUBLE) - (SELECT avg({x}) FROM respondents))"
            f" / (SELECT stddev_samp({x}) FROM respondents) ELSE 0.0 END")


@register("standard_scale", Q.with_resp(
    " SELECT respondent_id, " + ", ".join(f"{Q.r(_z(c), 6)} AS {c}" for c in S.CLUSTER_FEATURES)
    + " FROM respondents"))
def q_standard_scale(spark, sf):
    """The 11 clustering features standardised ((x - mean) / sample std), 6 dp."""
    feats = FE.cluster_features(resp(spark, sf))
    return FE.standard_scale(feats, S.CLUSTER_FEATURES, digits=6)


@register("sort_results", Q.with_resp(
    _COHORT_SQL.replace(" SELECT segment, segment_value, ", ", c AS (SELECT segment, segment_value, ", 1)
    + ") SELECT CAST(row_number() OVER (ORDER BY vulnerable_pct DESC, segment, segment_value) AS INT)"
    " AS position, c.* FROM c"))
def q_sort_results(spark, sf):
    """Vulnerable cohorts in result order (pct descending, then segment, value)
    with their position (window over the ~25 cohort rows)."""
    c = R.vulnerable_cohorts(resp(spark, sf))
    w = Window.orderBy(F.desc("vulnerable_pct"), "segment", "segment_value")
    return c.select(F.row_number().over(w).cast("int").alias("position"), *c.columns)


@register("mid_ranks", Q.with_resp(
    _COUNTS_SQL + " SELECT column_name AS \"column\", CAST(rating AS INT) AS rating, n,"
    " (2 * (sum(n) OVER (PARTITION BY column_name ORDER BY rating ROWS BETWEEN UNBOUNDED PRECEDING"
    " AND CURRENT ROW) - n) + n + 1) / 2.0 AS mid_rank FROM lc WHERE rating IS NOT NULL"))
def q_mid_ranks(spark, sf):
    """Average rank of each rating of each Likert item (ties share the mean rank)."""
    c = D.likert_counts(resp(spark, sf)).where(F.col("rating").isNotNull())
    return ST.mid_ranks(c).select("column", "rating", "n", (F.col("rank2") / 2.0).alias("mid_rank"))


# ---------------------------------------------------------------------------
# legacy variants
# ---------------------------------------------------------------------------
@register("likert_summary_legacy", Q.with_resp(_summary_sql(S.LIKERT_COLUMNS, legacy=True)))
def q_likert_summary_legacy(spark, sf):
    """Earlier form of the Likert summary: mean to 2 dp, no std."""
    return D.likert_summary(resp(spark, sf), legacy=True)


@register("frequency_table_legacy", Q.with_resp(
    " SELECT coalesce(CAST(usage_frequency AS VARCHAR), 'nan') AS category, count(*) AS count,"
    f" {Q.pct('count(*)', '(SELECT count(*) FROM respondents)')} AS percentage"
    " FROM respondents GROUP BY usage_frequency"))
def q_frequency_table_legacy(spark, sf):
    return D.frequency_table(resp(spark, sf), "usage_frequency", pct_name="percentage")


@register("service_adoption_legacy", Q.with_resp(
    " " + " UNION ALL ".join(
        f"SELECT '{label}' AS service, CAST(sum({c}) AS BIGINT) AS count,"
        f" {Q.pct(f'sum({c})', 'count(*)')} AS percentage FROM respondents"
        for c, label in D.LEGACY_SERVICE_LABELS)))
def q_service_adoption_legacy(spark, sf):
    """Earlier form: four services, unsorted, (service, count, percentage)."""
    return D.service_adoption_legacy(resp(spark, sf))


@register("spt_index_stats_legacy", Q.with_resp(
    f", v AS (SELECT {SPT_MEAN_SQL} AS x FROM respondents)"
    f" SELECT {Q.r('avg(x)', 2)} AS mean, {Q.r('median(x)', 2)} AS median,"
    f" {Q.r('stddev_samp(x)', 2)} AS std,"
    f" {Q.pct('sum(CASE WHEN x <= 2.0 THEN 1 ELSE 0 END)', 'count(*)')} AS pct_positive FROM v"))
def q_spt_index_stats_legacy(spark, sf):
    """Earlier form of the SPT index statistics: 2 dp, no pct_negative."""
    return D.spt_index_stats(resp(spark, sf), legacy=True)
