"""Query catalog, statistics (reliability, correlations, rank tests).

The SQL checks state each statistic independently of the Spark code: variances
with ``var_samp``, ranks with ``rank()`` windows over the raw rows, correlations
with ``corr`` -- only the rounding rule and the tail formulas are shared.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from trustlens import schema as S
from trustlens.operators import stats as ST
from trustlens.plans import sql as Q
from trustlens.plans.catalog import resp

QUERIES: dict = {}
ORACLE: dict = {}


def register(key, sql=None):
    def deco(fn):
        QUERIES[key] = fn
        if sql is not None:
            ORACLE[key] = sql
        return fn
    return deco


def _label(a: str) -> str:
    return (f"CASE WHEN {a} IS NULL OR isnan({a}) THEN 'N/A' WHEN {a} >= 0.9 THEN 'Excellent'"
            f" WHEN {a} >= 0.8 THEN 'Good' WHEN {a} >= 0.7 THEN 'Acceptable'"
            f" WHEN {a} >= 0.6 THEN 'Questionable' ELSE 'Poor' END")


def _alpha_sql(name: str, cols: list[str], order: int) -> str:
    k = len(cols)
    complete = " AND ".join(f"{c} IS NOT NULL" for c in cols)
    item_vars = " + ".join(f"var_samp({c})" for c in cols)
    total = " + ".join(cols)
    a = f"{k / (k - 1)!r} * (1 - ({item_vars}) / var_samp({total}))"
    return (f"SELECT '{name}' AS scale, CAST({k} AS INT) AS items, {Q.r(a, 4)} AS cronbach_alpha,"
            f" {order} AS ord FROM respondents WHERE {complete}")


_REL_SQL = (", a AS (" + " UNION ALL ".join(
    _alpha_sql(n, cs, i) for i, (n, cs) in enumerate(S.RELIABILITY_SCALES)) + ")"
    f" SELECT scale, items, cronbach_alpha, {_label('cronbach_alpha')} AS reliability FROM a")


@register("scale_reliability", Q.with_resp(_REL_SQL))
def q_scale_reliability(spark, sf):
    return ST.scale_reliability(resp(spark, sf))


@register("cronbach_alpha", Q.with_resp(
    ", a AS (" + _alpha_sql("Full SPT Scale", S.SPT_COLUMNS, 0) + ")"
    f" SELECT scale, items, cronbach_alpha, {_label('cronbach_alpha')} AS reliability FROM a"))
def q_cronbach_alpha(spark, sf):
    return ST.cronbach_alpha(resp(spark, sf), S.SPT_COLUMNS, "Full SPT Scale")


def _corr_sql(method: str) -> str:
    cols = S.SPT_COLUMNS
    complete = " AND ".join(f"{c} IS NOT NULL" for c in cols)
    if method == "spearman":
        vals = ", ".join(
            f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2 AS {c}"
            for c in cols)
    else:
        vals = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in cols)
    pairs = [(i, j) for i in range(len(cols)) for j in range(i, len(cols))]
    corr = ", ".join(f"{Q.r(f'corr({cols[i]}, {cols[j]})', 3)} AS c_{i}_{j}" for i, j in pairs)
    cells = []
    for i, j in pairs:
        for a, b in ([(i, j)] if i == j else [(i, j), (j, i)]):
            cells.append(f"SELECT '{cols[a]}' AS item_a, '{cols[b]}' AS item_b,"
                         f" '{S.LIKERT_TITLES[cols[a]]}' AS title_a,"
                         f" '{S.LIKERT_TITLES[cols[b]]}' AS title_b, c_{i}_{j} AS rho FROM cc")
    return (f", rk AS (SELECT {vals} FROM respondents WHERE {complete}),"
            f" cc AS (SELECT {corr} FROM rk) " + " UNION ALL ".join(cells))


@register("spearman_matrix", Q.with_resp(_corr_sql("spearman")))
def q_spearman_matrix(spark, sf):
    return ST.correlation_matrix(resp(spark, sf), S.SPT_COLUMNS, "spearman")


@register("pearson_matrix", Q.with_resp(_corr_sql("pearson")))
def q_pearson_matrix(spark, sf):
    return ST.correlation_matrix(resp(spark, sf), S.SPT_COLUMNS, "pearson")


#: Columns of few, of many and of nearly only distinct values.
_WIDE = ["q_trust_platform", "security_posture_score", "c_acctbal", "spent"]


def _wide_sql() -> str:
    ranks = ", ".join(f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2 AS r{i}" for i, c in enumerate(_WIDE))
    cells = " UNION ALL ".join(f"SELECT '{a}' AS item_a, '{b}' AS item_b, {Q.r(f'corr(r{i}, r{j})', 3)} AS rho FROM rk"
                               for i, a in enumerate(_WIDE) for j, b in enumerate(_WIDE))
    return (", o AS (SELECT o_custkey, CAST(sum(o_totalprice) AS DOUBLE) AS spent FROM orders GROUP BY o_custkey),"
            f" w AS (SELECT q_trust_platform, {Q.POSTURE} AS security_posture_score, CAST(c_acctbal AS DOUBLE) AS c_acctbal, spent"
            " FROM respondents JOIN customer ON c_custkey = respondent_id JOIN o ON o_custkey = respondent_id),"
            f" rk AS (SELECT {ranks} FROM w) {cells}")


@register("spearman_wide", Q.with_resp(_wide_sql()))
def q_spearman_wide(spark, sf):
    """Rank correlations of a Likert item, the posture score, the account balance and the
    sum of the orders: columns of any number of distinct values."""
    from trustlens.operators.features import engineer_features
    read = lambda name: spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet")
    spent = read("orders").groupBy(F.col("o_custkey").alias("respondent_id")).agg(F.sum("o_totalprice").cast("double").alias("spent"))
    balance = read("customer").select(F.col("c_custkey").alias("respondent_id"), F.col("c_acctbal").cast("double").alias("c_acctbal"))
    rows = engineer_features(resp(spark, sf)).join(balance, "respondent_id").join(spent, "respondent_id")
    return ST.correlation_matrix(rows, _WIDE, "spearman").select("item_a", "item_b", "rho")


def _fmt3(x: str) -> str:
    return f"printf('%.3f', {Q.r(x, 3)})"


def _mw_block(c: str) -> str:
    ties = (f"(SELECT sum(CAST(t AS DOUBLE) * t * t - t) FROM (SELECT count(*) AS t FROM respondents"
            f" WHERE has_experienced_fraud IN (0, 1) AND {c} IS NOT NULL GROUP BY {c}) y)")
    return (
        f"SELECT '{c}' AS item, sum(CASE WHEN g = 1 THEN 1 ELSE 0 END) AS n1, count(*) AS n,"
        f" sum(CASE WHEN g = 1 THEN mr ELSE 0 END) AS r1, {ties} AS ties FROM"
        f" (SELECT has_experienced_fraud AS g, rank() OVER (ORDER BY {c})"
        f" + (count(*) OVER (PARTITION BY {c}) - 1) / 2 AS mr FROM respondents"
        f" WHERE has_experienced_fraud IN (0, 1) AND {c} IS NOT NULL) x")


def _mw_sql() -> str:
    u1 = "(r1 - CAST(n1 AS DOUBLE) * (n1 + 1) / 2)"
    n1, n2, n = "CAST(n1 AS DOUBLE)", "CAST(n - n1 AS DOUBLE)", "CAST(n AS DOUBLE)"
    return (
        ", t AS (" + " UNION ALL ".join(_mw_block(c) for c in S.SPT_COLUMNS) + "),"
        f" u AS (SELECT item, {u1} AS u1, {n1} AS n1, {n2} AS n2, {n} AS n, ties FROM t),"
        " z AS (SELECT item, u1, n1, n2, greatest(u1, n1 * n2 - u1) AS u, n1 * n2 / 2 AS mu,"
        " sqrt(n1 * n2 / 12 * ((n + 1) - ties / (n * (n - 1)))) AS sd, 1 - (2 * u1) / (n1 * n2) AS r"
        " FROM u),"
        f" p AS (SELECT *, least(2 * {Q.norm_sf('(u - mu - 0.5) / sd')}, 1.0) AS p FROM z)"
        " SELECT 'Mann-Whitney U: ' || coalesce(items.title, item) AS test,"
        f" {Q.r('u1', 2)} AS statistic, {Q.r('p', 4)} AS p_value, {Q.r('abs(r)', 3)} AS effect_size,"
        " p < 0.05 AS significant,"
        " 'Fraud victims give ' || CASE WHEN r < 0 THEN 'higher ratings (less trust)'"
        " ELSE 'lower ratings (more trust)' END || ' (r=' || " + _fmt3("r")
        + " || ', ' || CASE WHEN p < 0.05 THEN 'significant' ELSE 'not significant' END || ')'"
        f" AS interpretation FROM p LEFT JOIN {Q.items_values()} ON p.item = items.column_name")


@register("mann_whitney", Q.with_resp(_mw_sql()))
def q_mann_whitney(spark, sf):
    return ST.mann_whitney(resp(spark, sf))


def _chi_block(c: str) -> str:
    return (f"SELECT '{c}' AS segment, CAST({c} AS VARCHAR) AS value,"
            " sum(CASE WHEN has_experienced_fraud = 0 THEN 1 ELSE 0 END) AS o0,"
            " sum(CASE WHEN has_experienced_fraud = 1 THEN 1 ELSE 0 END) AS o1"
            f" FROM respondents WHERE has_experienced_fraud IS NOT NULL AND {c} IS NOT NULL GROUP BY {c}")


def _chi_sql() -> str:
    def contrib(o, ct):
        e = f"(rw * CAST({ct} AS DOUBLE) / n)"
        d = f"({o} - {e})"
        adj = f"(CASE WHEN dof = 1 THEN abs({d}) - least(0.5, abs({d})) ELSE abs({d}) END)"
        return f"(CASE WHEN {e} > 0 THEN {adj} * {adj} / {e} ELSE 0.0 END)"
    return (
        ", cells AS (" + " UNION ALL ".join(_chi_block(c) for c in S.CHI_SQUARE_SEGMENTS) + "),"
        " tot AS (SELECT segment, sum(o0) AS c0, sum(o1) AS c1, CAST(sum(o0 + o1) AS DOUBLE) AS n,"
        " count(*) AS r FROM cells GROUP BY segment),"
        " dims AS (SELECT *, (CASE WHEN c0 > 0 THEN 1 ELSE 0 END) + (CASE WHEN c1 > 0 THEN 1 ELSE 0 END)"
        " AS k FROM tot),"
        " j AS (SELECT cells.*, o0 + o1 AS rw, dims.c0, dims.c1, dims.n, dims.r, dims.k,"
        " (dims.r - 1) * (dims.k - 1) AS dof FROM cells JOIN dims USING (segment)),"
        f" x AS (SELECT segment, sum({contrib('o0', 'c0')} + {contrib('o1', 'c1')}) AS chi2,"
        " any_value(dof) AS dof, any_value(n) AS n, any_value(r) AS r, any_value(k) AS k"
        " FROM j GROUP BY segment),"
        f" p AS (SELECT *, CASE WHEN dof > 0 THEN {Q.chi2_sf('chi2', 'dof')} ELSE 1.0 END AS p,"
        " sqrt(chi2 / (n * (least(r, k) - 1))) AS v FROM x)"
        " SELECT 'Chi-square: Fraud vs ' || segment AS test, " + Q.r("chi2", 3) + " AS statistic,"
        f" {Q.r('p', 4)} AS p_value, {Q.r('v', 3)} AS effect_size, p < 0.05 AS significant,"
        " 'Fraud incidence ' || CASE WHEN p < 0.05 THEN 'differs' ELSE 'does not differ' END"
        " || ' significantly by ' || segment || ' (Cramér V=' || " + _fmt3("v") + " || ')'"
        " AS interpretation FROM p")


@register("chi_square", Q.with_resp(_chi_sql()))
def q_chi_square(spark, sf):
    return ST.chi_square(resp(spark, sf))


def _kw_sql(segment: str, value: str = "q_trust_platform") -> str:
    return (
        f", rk AS (SELECT {segment} AS grp, rank() OVER (ORDER BY {value})"
        f" + (count(*) OVER (PARTITION BY {value}) - 1) / 2 AS mr FROM respondents"
        f" WHERE {segment} IS NOT NULL AND {value} IS NOT NULL),"
        " g AS (SELECT grp, count(*) AS ng, sum(mr) AS rg FROM rk GROUP BY grp),"
        f" tt AS (SELECT sum(CAST(t AS DOUBLE) * t * t - t) AS ties, CAST(sum(t) AS DOUBLE) AS n"
        f" FROM (SELECT count(*) AS t FROM respondents WHERE {segment} IS NOT NULL"
        f" AND {value} IS NOT NULL GROUP BY {value}) y),"
        " h AS (SELECT (12.0 / ((SELECT n FROM tt) * ((SELECT n FROM tt) + 1)) * sum(rg * rg / ng)"
        " - 3 * ((SELECT n FROM tt) + 1)) / (1 - (SELECT ties FROM tt) / ((SELECT n FROM tt)"
        " * (SELECT n FROM tt) * (SELECT n FROM tt) - (SELECT n FROM tt))) AS h, count(*) AS k FROM g),"
        f" p AS (SELECT h, k, {Q.chi2_sf('h', 'k - 1')} AS p,"
        " (h - k + 1) / ((SELECT CAST(count(*) AS DOUBLE) FROM respondents) - k) AS eta2 FROM h"
        " WHERE k >= 2)"
        f" SELECT 'Kruskal-Wallis: Trust by {segment}' AS test, {Q.r('h', 3)} AS statistic,"
        f" {Q.r('p', 4)} AS p_value, {Q.r('greatest(eta2, 0.0)', 3)} AS effect_size,"
        " p < 0.05 AS significant, 'Platform trust ' || CASE WHEN p < 0.05 THEN 'varies'"
        f" ELSE 'does not vary' END || ' significantly by {segment} (η²=' || " + _fmt3("eta2")
        + " || ')' AS interpretation FROM p")


@register("kruskal", Q.with_resp(_kw_sql("income_bracket")))
def q_kruskal(spark, sf):
    return ST.kruskal(resp(spark, sf), "income_bracket")


@register("kruskal_region", Q.with_resp(_kw_sql("region")))
def q_kruskal_region(spark, sf):
    return ST.kruskal(resp(spark, sf), "region")


_nested = Q.nested


_REPORT_SQL = (
    f", mw AS ({_nested(_mw_sql())}), cs AS ({_nested(_chi_sql())}),"
    f" ki AS ({_nested(_kw_sql('income_bracket'))}), kr AS ({_nested(_kw_sql('region'))})"
    " SELECT 'fraud_vs_trust' AS family, * FROM mw"
    " UNION ALL SELECT 'fraud_vs_demographics', * FROM cs"
    " UNION ALL SELECT 'trust_by_income', * FROM ki"
    " UNION ALL SELECT 'trust_by_region', * FROM kr")


@register("stat_report", Q.with_resp(_REPORT_SQL))
def q_stat_report(spark, sf):
    return ST.stat_report(resp(spark, sf))
