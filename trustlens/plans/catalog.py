"""Query catalog: one Spark query per operator, with its SQL cross-check.

``QUERIES[key](spark, sf_dir) -> DataFrame`` runs the operator over the whole
respondent table derived from ``sf_dir``.  ``ORACLE[key]`` is the same result
in plain SQL over the driver's tables (absent for operators SQL cannot state:
model training, random sampling); the names and types of the output columns
match.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trustlens import functions as X
from trustlens import schema as S
from trustlens.operators import descriptive as D
from trustlens.operators import features as FE
from trustlens.operators import risk as R
from trustlens.plans import sql as Q
from trustlens.sources.respondents import respondents_table

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def register(key: str, sql: str | None = None):
    def deco(fn):
        QUERIES[key] = fn
        if sql is not None:
            ORACLE[key] = sql
        return fn
    return deco


def resp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return respondents_table(spark, sf_dir)


# ---------------------------------------------------------------------------
# 2.2 row-level features
# ---------------------------------------------------------------------------
SPT_MEAN_SQL = Q.row_mean(S.SPT_COLUMNS)


@register("spt_index", Q.with_resp(
    f" SELECT respondent_id, {SPT_MEAN_SQL} AS spt_index FROM respondents"))
def q_spt_index(spark, sf):
    return FE.spt_index(resp(spark, sf))


@register("posture_score", Q.with_resp(
    f" SELECT respondent_id, CAST({Q.POSTURE} AS INT) AS security_posture_score FROM respondents"))
def q_posture_score(spark, sf):
    return FE.posture_score(resp(spark, sf))


_FEATURE_SQL = {
    "security_posture_score": f"CAST({Q.POSTURE} AS INT)",
    "num_services_used": "CAST(" + " + ".join(S.SERVICE_COLUMNS) + " AS INT)",
    "avg_literacy_score": Q.r(Q.row_mean(S.LITERACY_COLUMNS), 3),
    "avg_spt_score": Q.r(Q.row_mean(S.LIKERT_COLUMNS), 3),
    "security_behaviour_count": "CAST(has_mfa_enabled + uses_biometric_auth + uses_strong_password"
                                " + regularly_updates_app AS INT)",
    "high_usage_intensity": "CAST(CASE WHEN usage_frequency = 'Daily' AND (" + " + ".join(
        S.SERVICE_COLUMNS) + ") >= 4 THEN 1 ELSE 0 END AS INT)",
}

for _key, _col in [("num_services", "num_services_used"), ("avg_literacy", "avg_literacy_score"),
                   ("avg_spt", "avg_spt_score"), ("behaviour_count", "security_behaviour_count"),
                   ("high_usage", "high_usage_intensity")]:
    def _mk(col):
        def fn(spark, sf):
            return FE.engineer_features(resp(spark, sf)).select("respondent_id", col)
        return fn
    register(_key, Q.with_resp(
        f" SELECT respondent_id, {_FEATURE_SQL[_col]} AS {_col} FROM respondents"))(_mk(_col))


@register("engineer_features", Q.with_resp(
    " SELECT respondents.*, " + ", ".join(f"{e} AS {n}" for n, e in _FEATURE_SQL.items())
    + " FROM respondents"))
def q_engineer_features(spark, sf):
    return FE.engineer_features(resp(spark, sf))


@register("vulnerable_flag", Q.with_resp(
    f" SELECT respondent_id, CAST({Q.POSTURE} AS INT) AS security_posture_score,"
    f" CAST({Q.vulnerable()} AS INT) AS is_vulnerable FROM respondents"))
def q_vulnerable_flag(spark, sf):
    return FE.vulnerable_flag(resp(spark, sf))


@register("high_posture_flag", Q.with_resp(
    f" SELECT respondent_id, CAST({Q.POSTURE} AS INT) AS security_posture_score,"
    f" CAST(CASE WHEN {Q.POSTURE} >= 70 THEN 1 ELSE 0 END AS INT) AS is_high_posture"
    " FROM respondents"))
def q_high_posture_flag(spark, sf):
    return FE.high_posture_flag(resp(spark, sf))


@register("fraud_victims", Q.with_resp(
    " SELECT * FROM respondents WHERE has_experienced_fraud = 1"))
def q_fraud_victims(spark, sf):
    return FE.fraud_victims(resp(spark, sf))


_LABEL_CASE = "CASE {c} " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in S.LIKERT_LABELS.items()) + " END"


@register("likert_labels", Q.with_resp(
    " SELECT respondent_id, " + ", ".join(
        _LABEL_CASE.format(c=c) + f" AS {c}_label" for c in S.SPT_COLUMNS) + " FROM respondents"))
def q_likert_labels(spark, sf):
    return FE.likert_labels(resp(spark, sf))


def _z_sql(col: str) -> str:
    """Standardised value: (x - mean) / sample std, moments from exact integer sums."""
    n = "CAST((SELECT count({c}) FROM respondents) AS DOUBLE)".format(c=col)
    s1 = "CAST((SELECT sum({c}) FROM respondents) AS DOUBLE)".format(c=col)
    s2 = "CAST((SELECT sum({c} * {c}) FROM respondents) AS DOUBLE)".format(c=col)
    return (f"((CAST({col} AS DOUBLE) - {s1} / {n})"
            f" / sqrt(({n} * {s2} - {s1} * {s1}) / ({n} * ({n} - 1))))")


@register("likert_bucketize", Q.with_resp(
    f" SELECT respondent_id, CAST(CASE WHEN z > 1.2 THEN 5 WHEN z > 0.4 THEN 4 WHEN z > -0.4 THEN 3"
    f" WHEN z > -1.2 THEN 2 ELSE 1 END AS INT) AS posture_bucket FROM"
    f" (SELECT respondent_id, {Q.r(_z_sql('num_phishing_attempts_received'), 6)} AS z"
    f" FROM respondents) t"))
def q_likert_bucketize(spark, sf):
    """Bucketize the standardised phishing-attempt count into 1..5 (strict
    thresholds -1.2, -0.4, 0.4, 1.2)."""
    df = resp(spark, sf)
    c = "num_phishing_attempts_received"
    n = df.select(F.count(c).cast("double")).scalar()
    s1 = df.select(F.sum(c).cast("double")).scalar()
    s2 = df.select(F.sum(F.col(c).cast("bigint") * F.col(c)).cast("double")).scalar()
    sd = F.sqrt((n * s2 - s1 * s1) / (n * (n - 1)))
    z = X.rnd((F.col(c).cast("double") - s1 / n) / sd, 6)
    return FE.likert_bucketize(df.select("respondent_id", z.alias("z")), "z", "posture_bucket") \
        .select("respondent_id", "posture_bucket")


_SEGMENT_OPTS = [("Gold", 20), ("Silver", 30), ("Bronze", 50)]


@register("weighted_assign", Q.with_resp(
    ", d AS (SELECT respondent_id, ('0x' || substr(md5(CAST(respondent_id AS VARCHAR) || ':7'), 1, 15))::BIGINT % 100 AS draw"
    " FROM respondents)"
    " SELECT respondent_id, CASE WHEN draw < 20 THEN 'Gold' WHEN draw < 50 THEN 'Silver' ELSE 'Bronze' END AS tier FROM d"))
def q_weighted_assign(spark, sf):
    """Deterministic weighted assignment (20/30/50) of a tier by hash of the id."""
    return FE.weighted_assign(resp(spark, sf), "respondent_id", _SEGMENT_OPTS, "tier", salt=7) \
        .select("respondent_id", "tier")


@register("minmax_scale", Q.with_resp(
    f" SELECT respondent_id, {Q.r('(CAST(num_phishing_attempts_received AS DOUBLE) - (SELECT min(num_phishing_attempts_received) FROM respondents)) / ((SELECT max(num_phishing_attempts_received) FROM respondents) - (SELECT min(num_phishing_attempts_received) FROM respondents) + 1e-9) * 100', 4)} AS phishing_scaled"
    " FROM respondents"))
def q_minmax_scale(spark, sf):
    df = FE.minmax_scale(resp(spark, sf), "num_phishing_attempts_received", "phishing_scaled",
                         scale100=True, eps=1e-9)
    return df.select("respondent_id", X.rnd(F.col("phishing_scaled"), 4).alias("phishing_scaled"))


def _tier_sql(v: str) -> str:
    return ("CASE " + " ".join(f"WHEN {v} > {lo} AND {v} <= {hi} THEN '{lab}'"
                               for lab, lo, hi in S.ANOMALY_TIERS) + " END")


@register("anomaly_tier", Q.with_resp(
    f" SELECT respondent_id, score, {_tier_sql('score')} AS tier FROM (SELECT respondent_id,"
    f" {Q.r(f'CAST({Q.POSTURE} - (SELECT min({Q.POSTURE}) FROM respondents) AS DOUBLE) / ((SELECT max({Q.POSTURE}) FROM respondents) - (SELECT min({Q.POSTURE}) FROM respondents) + 1e-9) * 100', 1)} AS score"
    " FROM respondents) t"))
def q_anomaly_tier(spark, sf):
    """Tier rule (-1,20] Critical ... (60,101] Normal on a 0-100 min-max score
    (here: of the posture score)."""
    df = FE.posture_score(resp(spark, sf))
    df = FE.minmax_scale(df, "security_posture_score", "score", scale100=True, eps=1e-9)
    df = df.withColumn("score", X.rnd(F.col("score"), 1))
    return df.select("respondent_id", "score", X.anomaly_tier(F.col("score")).alias("tier"))


@register("ordinal_encode", Q.with_resp(
    " SELECT respondent_id, " + ", ".join(
        "CAST(coalesce(CASE " + c + " " + " ".join(f"WHEN '{v}' THEN {i}" for i, v in enumerate(vals))
        + " END, -1) AS INT) AS " + c for c, vals in S.ORDINAL_MAPS.items()) + " FROM respondents"))
def q_ordinal_encode(spark, sf):
    return FE.ordinal_encode(resp(spark, sf)).select("respondent_id", *S.ORDINAL_MAPS)


def _with_new_level(df):
    """``df`` with a region that no fixed list knows, by an id rule."""
    return df.withColumn("region", F.expr("CASE WHEN respondent_id % 11 = 7 THEN 'Island' ELSE region END"))


_ISLAND = "CASE WHEN respondent_id % 11 = 7 THEN 'Island' ELSE region END"


def _level_sql(c: str, v: str) -> str:
    value = _ISLAND if c == "region" else c
    return f"CAST(CASE WHEN {value} = '{v}' THEN 1 ELSE 0 END AS INT) AS \"{c}_{v}\""


_LEVELS = {c: S.NOMINAL_LEVELS[c] + (["Island"] if c == "region" else []) for c in S.NOMINAL_COLUMNS}


@register("onehot_encode", Q.with_resp(
    " SELECT respondent_id, " + ", ".join(_level_sql(c, v) for c in S.NOMINAL_COLUMNS for v in _LEVELS[c]) + " FROM respondents"))
def q_onehot_encode(spark, sf):
    """One-hot columns by the levels in the data, one of them in no list."""
    df = _with_new_level(resp(spark, sf)).select("respondent_id", *S.NOMINAL_COLUMNS)
    return FE.onehot_encode(df)


_NUMERIC_SQL = [c for c in S.REQUIRED_COLUMNS if c not in {
    "gender", "age_group", "education", "occupation", "income_bracket", "region", "bank_type", "usage_frequency",
    "transaction_frequency", "avg_transaction_amount_tier", "device_type", "os_type", "fraud_type"}]


@register("numeric_only", Q.with_resp(" SELECT " + ", ".join(_NUMERIC_SQL) + " FROM respondents"))
def q_numeric_only(spark, sf):
    return FE.numeric_only(resp(spark, sf))


_IMPUTED = ["years_digital_banking", "num_phishing_attempts_received", "q_trust_platform"]


def _holed(c: str, i: int) -> str:
    return f"CASE WHEN respondent_id % {7 + 4 * i} = {i + 1} THEN NULL ELSE {c} END"


@register("median_impute", Q.with_resp(
    ", h AS (SELECT respondent_id, " + ", ".join(f"{_holed(c, i)} AS {c}" for i, c in enumerate(_IMPUTED)) + " FROM respondents)"
    " SELECT respondent_id, " + ", ".join(f"coalesce(CAST({c} AS DOUBLE), (SELECT median({c}) FROM h)) AS {c}" for c in _IMPUTED) + " FROM h"))
def q_median_impute(spark, sf):
    """Exact medians put in for values that are taken out by an id rule."""
    df = resp(spark, sf).select("respondent_id", *[F.expr(_holed(c, i)).alias(c) for i, c in enumerate(_IMPUTED)])
    return FE.median_impute(df, _IMPUTED)


@register("cluster_features", Q.with_resp(
    " SELECT respondent_id, " + ", ".join(
        f"{_FEATURE_SQL[c]} AS {c}" if c in _FEATURE_SQL else c for c in S.CLUSTER_FEATURES)
    + " FROM respondents"))
def q_cluster_features(spark, sf):
    return FE.cluster_features(resp(spark, sf))


@register("target_shift", Q.with_resp(
    " SELECT respondent_id, CAST(q_trust_platform - (SELECT min(q_trust_platform) FROM respondents)"
    " AS INT) AS label FROM respondents"))
def q_target_shift(spark, sf):
    return FE.target_shift(resp(spark, sf), S.TRUST_TARGET).select("respondent_id", "label")


@register("title_label", Q.with_resp(
    ", t AS (SELECT DISTINCT CASE WHEN has_experienced_fraud = 1 THEN 'account_takeover_risk'"
    " ELSE 'data_exfiltration_risk' END AS name, segment_value FROM (SELECT has_experienced_fraud,"
    " region AS segment_value FROM respondents) x)"
    " SELECT name, segment_value,"
    " array_to_string(list_transform(string_split(replace(regexp_replace(name, '_risk$', ''), '_', ' '),"
    " ' '), lambda w: upper(substr(w, 1, 1)) || lower(substr(w, 2))), ' ') AS title,"
    " 'region: ' || segment_value AS label,"
    " CAST(CASE WHEN lower(name) LIKE '%takeover%' THEN 1 ELSE 0 END AS INT) AS is_takeover FROM t"))
def q_title_label(spark, sf):
    """Chart labels: strip '_risk', '_' -> ' ', title case; 'segment: value'
    labels; keyword class by lower-case contains."""
    df = resp(spark, sf)
    t = df.select(F.when(F.col("has_experienced_fraud") == 1, "account_takeover_risk")
                  .otherwise("data_exfiltration_risk").alias("name"),
                  F.col("region").alias("segment_value")).distinct()
    return t.select("name", "segment_value", X.title_label(F.col("name"), "_risk").alias("title"),
                    F.concat(F.lit("region: "), "segment_value").alias("label"),
                    F.lower("name").contains("takeover").cast("int").alias("is_takeover"))


# ---------------------------------------------------------------------------
# 2.3 joins
# ---------------------------------------------------------------------------
_CW_VALUES = "(VALUES " + ", ".join(
    f"('{s}', '{c}', '{a}', {w1!r}::DOUBLE, {w2!r}::DOUBLE, {w3!r}::DOUBLE, {w4!r}::DOUBLE,"
    f" {w5!r}::DOUBLE, {i})"
    for i, (s, c, a, w1, w2, w3, w4, w5) in enumerate(S.CHANNEL_WEIGHTS)) + \
    ") AS cw(service_col, channel, adoption_label, attack_surface, malware_risk, phishing_risk," \
    " account_takeover_risk, data_exfiltration_risk, ord)"
_ADOPTION_SQL = (", ad AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS service_col, CAST(sum({c}) AS BIGINT) AS adopters, count(*) AS total"
    " FROM respondents" for c in S.SERVICE_COLUMNS) + ")")


@register("join_channel_weights", Q.with_resp(
    _ADOPTION_SQL + " SELECT ad.service_col, ad.total, ad.adopters, cw.channel, cw.adoption_label,"
    " cw.attack_surface, cw.malware_risk, cw.phishing_risk, cw.account_takeover_risk,"
    f" cw.data_exfiltration_risk, CAST(cw.ord AS INT) AS ord FROM ad JOIN {_CW_VALUES}"
    " ON ad.service_col = cw.service_col"))
def q_join_channel_weights(spark, sf):
    return R.join_channel_weights(resp(spark, sf))


_COUNTS_SQL = (", lc AS (SELECT column_name, rating, count(*) AS n FROM ("
               + Q.unpivot_likert(S.LIKERT_COLUMNS) + ") u GROUP BY column_name, rating)")


@register("join_titles", Q.with_resp(
    _COUNTS_SQL + f" SELECT lc.column_name AS \"column\", CAST(lc.rating AS INT) AS rating, lc.n,"
    f" coalesce(items.title, lc.column_name) AS title, CAST(items.item_order AS INT) AS item_order"
    f" FROM lc LEFT JOIN {Q.items_values()} ON lc.column_name = items.column_name"))
def q_join_titles(spark, sf):
    return D.join_titles(D.likert_counts(resp(spark, sf)))


@register("complete_domain", Q.with_resp(
    _COUNTS_SQL + ", items AS (SELECT DISTINCT column_name FROM lc),"
    " grid AS (SELECT column_name, unnest([1, 2, 3, 4, 5]) AS rating FROM items)"
    " SELECT grid.column_name AS \"column\", CAST(grid.rating AS INT) AS rating,"
    " CAST(coalesce(lc.n, 0) AS BIGINT) AS n FROM grid LEFT JOIN lc"
    " ON grid.column_name = lc.column_name AND grid.rating = lc.rating"))
def q_complete_domain(spark, sf):
    return D.complete_domain(D.likert_counts(resp(spark, sf)))


# ---------------------------------------------------------------------------
# 2.4 aggregations
# ---------------------------------------------------------------------------
@register("likert_counts", Q.with_resp(
    _COUNTS_SQL + " SELECT column_name AS \"column\", CAST(rating AS INT) AS rating, n FROM lc"))
def q_likert_counts(spark, sf):
    return D.likert_counts(resp(spark, sf))


def _summary_sql(cols: list[str], legacy: bool = False) -> str:
    std = ("" if legacy else
           f" {Q.r('sqrt((CAST(k AS DOUBLE) * CAST(s2 AS DOUBLE) - CAST(s1 AS DOUBLE) * CAST(s1 AS DOUBLE)) / (CAST(k AS DOUBLE) * (CAST(k AS DOUBLE) - 1)))', 3)} AS std,")
    return (
        ", lc AS (SELECT column_name, rating, count(*) AS n FROM ("
        + Q.unpivot_likert(cols) + ") u GROUP BY column_name, rating),"
        " a AS (SELECT column_name, sum(n) AS total,"
        " sum(CASE WHEN rating IS NOT NULL THEN n END) AS k,"
        " sum(CASE WHEN rating IS NOT NULL THEN rating * n END) AS s1,"
        " sum(CASE WHEN rating IS NOT NULL THEN rating * rating * n END) AS s2,"
        " sum(CASE WHEN rating = 1 THEN n ELSE 0 END) AS n1,"
        " sum(CASE WHEN rating IN (1, 2) THEN n ELSE 0 END) AS npos,"
        " sum(CASE WHEN rating = 3 THEN n ELSE 0 END) AS nneu,"
        " sum(CASE WHEN rating IN (4, 5) THEN n ELSE 0 END) AS nneg FROM lc GROUP BY column_name)"
        " SELECT a.column_name AS \"column\", coalesce(items.title, a.column_name) AS question,"
        f" {Q.r('CAST(s1 AS DOUBLE) / k', 2 if legacy else 3)} AS mean_score," + std + 
        f" {Q.pct('n1', 'total')} AS strongly_agree_pct, {Q.pct('npos', 'total')} AS positive_pct,"
        f" {Q.pct('nneu', 'total')} AS neutral_pct, {Q.pct('nneg', 'total')} AS negative_pct"
        f" FROM a LEFT JOIN {Q.items_values()} ON a.column_name = items.column_name")


@register("likert_summary", Q.with_resp(_summary_sql(S.LIKERT_COLUMNS)))
def q_likert_summary(spark, sf):
    return D.likert_summary(resp(spark, sf))


@register("spt_summary", Q.with_resp(_summary_sql(S.SPT_COLUMNS)))
def q_spt_summary(spark, sf):
    return D.spt_summary(resp(spark, sf))


@register("weakest_dimension", Q.with_resp(
    _summary_sql(S.SPT_COLUMNS).replace(" SELECT a.column_name AS", ", summ AS (SELECT a.column_name AS", 1)
    + "), ranked AS (SELECT summ.*, items.item_order FROM summ JOIN " + Q.items_values()
    + " ON summ.\"column\" = items.column_name)"
    " SELECT question AS dimension, \"column\", positive_pct, negative_pct, mean_score FROM ranked"
    " ORDER BY positive_pct, item_order LIMIT 1"))
def q_weakest_dimension(spark, sf):
    return D.weakest_dimension(resp(spark, sf))


@register("likert_distribution", Q.with_resp(
    _COUNTS_SQL + ", items AS (SELECT DISTINCT column_name FROM lc),"
    " grid AS (SELECT column_name, unnest([1, 2, 3, 4, 5]) AS rating FROM items)"
    " SELECT grid.column_name AS \"column\", " + _LABEL_CASE.format(c="grid.rating") + " AS rating,"
    " CAST(grid.rating AS INT) AS rating_code, CAST(coalesce(lc.n, 0) AS BIGINT) AS count,"
    f" {Q.pct('coalesce(lc.n, 0)', '(SELECT count(*) FROM respondents)')} AS pct"
    " FROM grid LEFT JOIN lc ON grid.column_name = lc.column_name AND grid.rating = lc.rating"))
def q_likert_distribution(spark, sf):
    return D.likert_distribution(resp(spark, sf))


_DIV_NAMES = {1: "strongly_agree", 2: "agree", 3: "neutral", 4: "disagree", 5: "strongly_disagree"}


@register("likert_diverging", Q.with_resp(
    ", lc AS (SELECT column_name, rating, count(*) AS n FROM (" + Q.unpivot_likert(S.SPT_COLUMNS)
    + ") u WHERE rating IS NOT NULL GROUP BY column_name, rating),"
    " w AS (SELECT column_name, sum(n) AS tot, " + ", ".join(
        f"sum(CASE WHEN rating = {k} THEN n ELSE 0 END) AS c{k}" for k in _DIV_NAMES)
    + " FROM lc GROUP BY column_name)"
    " SELECT w.column_name AS \"column\", coalesce(items.title, w.column_name) AS question, "
    + ", ".join(f"{Q.pct(f'c{k}', 'tot')} AS pct_{v}" for k, v in _DIV_NAMES.items())
    + f" FROM w LEFT JOIN {Q.items_values()} ON w.column_name = items.column_name"))
def q_likert_diverging(spark, sf):
    return D.likert_diverging(resp(spark, sf))


@register("spt_index_stats", Q.with_resp(
    f", v AS (SELECT {SPT_MEAN_SQL} AS x FROM respondents)"
    f" SELECT {Q.r('avg(x)', 3)} AS mean, {Q.r('median(x)', 3)} AS median,"
    f" {Q.r('stddev_samp(x)', 3)} AS std,"
    f" {Q.pct('sum(CASE WHEN x <= 2.0 THEN 1 ELSE 0 END)', 'count(*)')} AS pct_positive,"
    f" {Q.pct('sum(CASE WHEN x >= 4.0 THEN 1 ELSE 0 END)', 'count(*)')} AS pct_negative FROM v"))
def q_spt_index_stats(spark, sf):
    return D.spt_index_stats(resp(spark, sf))


@register("frequency_table", Q.with_resp(
    " SELECT coalesce(CAST(usage_frequency AS VARCHAR), 'nan') AS category, count(*) AS count,"
    f" {Q.pct('count(*)', '(SELECT count(*) FROM respondents)')} AS pct"
    " FROM respondents GROUP BY usage_frequency"))
def q_frequency_table(spark, sf):
    return D.frequency_table(resp(spark, sf), "usage_frequency")


_DEMO_SQL = (", long AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, CAST({c} AS VARCHAR) AS value FROM respondents"
    for c in S.DEMOGRAPHIC_COLUMNS) + ")"
    " SELECT column_name AS \"column\", coalesce(value, 'nan') AS category, count(*) AS count,"
    f" {Q.pct('count(*)', '(SELECT count(*) FROM respondents)')} AS pct"
    " FROM long GROUP BY column_name, value")


@register("demographic_summary", Q.with_resp(_DEMO_SQL))
def q_demographic_summary(spark, sf):
    return D.demographic_summary(resp(spark, sf))


@register("demographic_pct", Q.with_resp(_DEMO_SQL))
def q_demographic_pct(spark, sf):
    return D.demographic_pct(resp(spark, sf))


_SERVICE_SQL = (_ADOPTION_SQL + " SELECT cw.adoption_label AS channel, ad.adopters,"
                f" {Q.pct('ad.adopters', 'ad.total')} AS adoption_pct"
                f" FROM ad JOIN {_CW_VALUES} ON ad.service_col = cw.service_col")


@register("service_adoption", Q.with_resp(_SERVICE_SQL))
def q_service_adoption(spark, sf):
    return D.service_adoption(resp(spark, sf))


@register("top_channel", Q.with_resp(_SERVICE_SQL + " ORDER BY adoption_pct DESC, cw.ord LIMIT 1"))
def q_top_channel(spark, sf):
    return D.top_channel(resp(spark, sf))


@register("fraud_profile", Q.with_resp(
    ", a AS (SELECT count(*) AS n, sum(CASE WHEN has_experienced_fraud = 1 THEN 1 ELSE 0 END) AS nf,"
    " sum(CASE WHEN has_experienced_fraud = 1 THEN reported_to_bank ELSE 0 END) AS rep,"
    " sum(CASE WHEN has_experienced_fraud = 1 THEN fraud_resolved ELSE 0 END) AS res FROM respondents)"
    " SELECT 'Total respondents' AS metric, CAST(n AS BIGINT) AS value, 100.0::DOUBLE AS pct FROM a"
    f" UNION ALL SELECT 'Experienced fraud', CAST(nf AS BIGINT), {Q.pct('nf', 'n')} FROM a"
    f" UNION ALL SELECT 'Reported to bank', CAST(rep AS BIGINT),"
    f" CASE WHEN nf > 0 THEN {Q.pct('rep', 'nf')} ELSE 0.0 END FROM a"
    f" UNION ALL SELECT 'Fraud resolved', CAST(res AS BIGINT),"
    f" CASE WHEN nf > 0 THEN {Q.pct('res', 'nf')} ELSE 0.0 END FROM a"))
def q_fraud_profile(spark, sf):
    return D.fraud_profile(resp(spark, sf))


@register("fraud_type_breakdown", Q.with_resp(
    " SELECT fraud_type, count(*) AS count, "
    f"{Q.pct('count(*)', '(SELECT count(*) FROM respondents WHERE has_experienced_fraud = 1)')}"
    " AS pct_of_fraud_victims FROM respondents WHERE has_experienced_fraud = 1 GROUP BY fraud_type"))
def q_fraud_type_breakdown(spark, sf):
    return D.fraud_type_breakdown(resp(spark, sf))


def _risk_matrix_sql() -> str:
    comp = "(cw.attack_surface + cw.malware_risk + cw.phishing_risk + cw.account_takeover_risk" \
           " + cw.data_exfiltration_risk) / 5"
    adop = "(CAST(ad.adopters AS DOUBLE) / ad.total)"
    return (_ADOPTION_SQL + ", m AS (SELECT cw.channel, cw.ord,"
            f" {Q.r(adop + ' * 100', 1)} AS adoption_pct, "
            + ", ".join(f"{Q.r(f'cw.{c} * 100', 1)} AS {c}" for c in S.RISK_WEIGHT_NAMES)
            + f", {Q.r(f'{comp} * 100', 1)} AS composite_risk_score,"
            f" {Q.r(f'{comp} * {adop} * 100', 1)} AS weighted_risk_score"
            f" FROM ad JOIN {_CW_VALUES} ON ad.service_col = cw.service_col)")


@register("channel_risk_matrix", Q.with_resp(
    _risk_matrix_sql() + " SELECT channel, adoption_pct, " + ", ".join(S.RISK_WEIGHT_NAMES)
    + ", composite_risk_score, weighted_risk_score FROM m"))
def q_channel_risk_matrix(spark, sf):
    return R.channel_risk_matrix(resp(spark, sf))


@register("attack_surface", Q.with_resp(
    _risk_matrix_sql() + ", raw AS (SELECT CAST(sum(CAST(round(weighted_risk_score * 10) AS BIGINT))"
    " AS DOUBLE) / 10 AS raw FROM m),"
    " pop AS (SELECT sum(has_mfa_enabled) AS mfa, sum(has_experienced_fraud) AS fr,"
    " sum(shared_device) AS sh, count(*) AS n FROM respondents),"
    f" z AS (SELECT (SELECT raw FROM raw) AS raw, least((SELECT raw FROM raw) / {R.MAX_EXPOSURE!r} * 100,"
    " 100.0) AS norm, pop.* FROM pop)"
    f" SELECT {Q.r('raw', 2)} AS raw_exposure_score, {Q.r('norm', 1)} AS normalised_attack_surface,"
    f" {Q.pct('mfa', 'n')} AS mfa_coverage_pct, {Q.pct('fr', 'n')} AS fraud_incidence_pct,"
    f" {Q.pct('sh', 'n')} AS shared_device_pct,"
    " CASE WHEN norm > 70 THEN 'Critical' WHEN norm > 50 THEN 'High' ELSE 'Medium' END AS risk_level"
    " FROM z"))
def q_attack_surface(spark, sf):
    return R.attack_surface(resp(spark, sf))


_GAP_PREV = [
    Q.r("(1 - CAST(sum(has_mfa_enabled) AS DOUBLE) / count(*)) * 100", 1),
    Q.r("CAST(sum(shared_device) AS DOUBLE) / count(*) * 100", 1),
    Q.r("(1 - CAST(sum(uses_biometric_auth) AS DOUBLE) / count(*)) * 100", 1),
    Q.r("CAST(sum(CASE WHEN q_password_hygiene >= 4 THEN 1 ELSE 0 END) AS DOUBLE) / count(*) * 100", 1),
    Q.r("CAST(sum(CASE WHEN q_phishing_awareness >= 4 THEN 1 ELSE 0 END) AS DOUBLE) / count(*) * 100", 1),
    Q.r("(1 - CAST(sum(regularly_updates_app) AS DOUBLE) / count(*)) * 100", 1),
    "CASE WHEN sum(has_experienced_fraud) > 0 THEN " + Q.r(
        "CAST(sum(CASE WHEN has_experienced_fraud = 1 AND reported_to_bank = 0 THEN 1 ELSE 0 END)"
        " AS DOUBLE) / sum(has_experienced_fraud) * 100", 1) + " ELSE 0.0 END",
]


@register("security_gaps", Q.with_resp(
    ", g AS (" + " UNION ALL ".join(
        f"SELECT '{gap}' AS gap, CAST({sev} AS INT) AS severity, {prev} AS prevalence_pct,"
        f" '{mit}' AS mitigation FROM respondents"
        for (gap, sev, mit), prev in zip(S.SECURITY_GAPS, _GAP_PREV)) + ")"
    f" SELECT gap, severity, prevalence_pct, mitigation,"
    f" {Q.r('severity * prevalence_pct / 100', 2)} AS priority_score FROM g"))
def q_security_gaps(spark, sf):
    return R.security_gaps(resp(spark, sf))


@register("posture_by_segment", Q.with_resp(
    f" SELECT income_bracket AS segment_value, {Q.r(f'CAST(sum({Q.POSTURE}) AS DOUBLE) / count(*)', 1)}"
    f" AS mean_posture, {Q.pct(f'sum(CASE WHEN {Q.POSTURE} >= 70 THEN 1 ELSE 0 END)', 'count(*)')}"
    " AS high_posture_pct, count(*) AS n FROM respondents GROUP BY income_bracket"))
def q_posture_by_segment(spark, sf):
    return R.posture_by_segment(resp(spark, sf), "income_bracket")


_COHORT_SQL = (
    f", v AS (SELECT *, {Q.POSTURE} AS p, {Q.vulnerable()} AS vul FROM respondents), g AS ("
    + " UNION ALL ".join(
        f"SELECT '{c}' AS segment, CAST({c} AS VARCHAR) AS segment_value, sum(vul) AS vs,"
        f" sum(p) AS ps, count(*) AS n FROM v GROUP BY {c}" for c in S.COHORT_SEGMENTS) + ")"
    f" SELECT segment, segment_value, {Q.pct('vs', 'n')} AS vulnerable_pct,"
    f" {Q.r('CAST(ps AS DOUBLE) / n', 1)} AS mean_posture, CAST(n AS BIGINT) AS n FROM g")


@register("vulnerable_cohorts", Q.with_resp(_COHORT_SQL))
def q_vulnerable_cohorts(spark, sf):
    return R.vulnerable_cohorts(resp(spark, sf))


@register("union_cohorts", Q.with_resp(_COHORT_SQL))
def q_union_cohorts(spark, sf):
    return R.vulnerable_cohorts_union(resp(spark, sf))


@register("top_cohorts", Q.with_resp(
    _COHORT_SQL.replace(" SELECT segment, segment_value, ", ", c AS (SELECT segment, segment_value, ", 1)
    + ") SELECT c.*, segment || ': ' || segment_value AS label FROM c"
    " ORDER BY vulnerable_pct DESC, segment, segment_value LIMIT 15"))
def q_top_cohorts(spark, sf):
    return R.top_cohorts(R.vulnerable_cohorts(resp(spark, sf)), 15)


@register("fraud_by_region", Q.with_resp(
    f" SELECT region, {Q.r('CAST(sum(has_experienced_fraud) AS DOUBLE) / count(*) * 100', 1)}"
    " AS fraud_pct, count(*) AS n FROM respondents GROUP BY region"))
def q_fraud_by_region(spark, sf):
    return D.fraud_by_region(resp(spark, sf))


@register("posture_by_region", Q.with_resp(
    f" SELECT region, {Q.r(f'CAST(sum({Q.POSTURE}) AS DOUBLE) / count(*)', 1)} AS mean_posture,"
    " count(*) AS n FROM respondents GROUP BY region"))
def q_posture_by_region(spark, sf):
    return D.posture_by_region(resp(spark, sf))


@register("satisfaction_by_usage", Q.with_resp(
    " SELECT usage_frequency,"
    f" {Q.r('CAST(sum(q_overall_satisfaction) AS DOUBLE) / count(q_overall_satisfaction)', 3)}"
    " AS mean_satisfaction, count(q_overall_satisfaction) AS n FROM respondents GROUP BY usage_frequency"))
def q_satisfaction_by_usage(spark, sf):
    return D.satisfaction_by_usage(resp(spark, sf))


def _hist_sql(name: str, expr: str, bins: int) -> str:
    lo = (f"(SELECT CASE WHEN max({expr}) = min({expr}) THEN CAST(min({expr}) AS DOUBLE) - 0.5"
          f" ELSE CAST(min({expr}) AS DOUBLE) END FROM respondents)")
    hi = (f"(SELECT CASE WHEN max({expr}) = min({expr}) THEN CAST(max({expr}) AS DOUBLE) + 0.5"
          f" ELSE CAST(max({expr}) AS DOUBLE) END FROM respondents)")
    return (
        f"SELECT '{name}' AS feature, CAST(g.bin AS INT) AS bin,"
        f" {Q.r(f'g.lo + g.bin * ((g.hi - g.lo) / {bins})', 4)} AS bin_lo,"
        f" {Q.r(f'g.lo + (g.bin + 1) * ((g.hi - g.lo) / {bins})', 4)} AS bin_hi,"
        " CAST(coalesce(c.cnt, 0) AS BIGINT) AS count"
        f" FROM (SELECT {lo} AS lo, {hi} AS hi, unnest(range({bins})) AS bin) g"
        f" LEFT JOIN (SELECT CAST(least(floor((CAST({expr} AS DOUBLE) - {lo}) * {bins} / ({hi} - {lo})),"
        f" {bins - 1}) AS INT) AS bin, count(*) AS cnt FROM respondents"
        f" WHERE {expr} IS NOT NULL GROUP BY 1) c ON c.bin = g.bin")


_HISTS = [("years_digital_banking", "years_digital_banking", 15),
          ("spt_index", SPT_MEAN_SQL, 30),
          ("security_posture_score", Q.POSTURE, 20)]


@register("histogram", Q.with_resp(" " + " UNION ALL ".join(_hist_sql(n, e, b) for n, e, b in _HISTS)))
def q_histogram(spark, sf):
    df = resp(spark, sf)
    feats = df.select(F.col("years_digital_banking"), X.row_mean(S.SPT_COLUMNS).alias("spt_index"),
                      X.posture_expr().alias("security_posture_score"))
    return D.histograms(feats, {n: b for n, _, b in _HISTS})


@register("crosstab_fraud", Q.with_resp(
    " SELECT CAST(age_group AS VARCHAR) AS value,"
    " CAST(sum(CASE WHEN has_experienced_fraud = 0 THEN 1 ELSE 0 END) AS BIGINT) AS no_fraud,"
    " CAST(sum(CASE WHEN has_experienced_fraud = 1 THEN 1 ELSE 0 END) AS BIGINT) AS fraud"
    " FROM respondents GROUP BY age_group"))
def q_crosstab_fraud(spark, sf):
    return D.crosstab_fraud(resp(spark, sf), "age_group")
