"""Query catalog, sources / validation / sinks and the report tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from trustlens import schema as S
from trustlens.operators import descriptive as D
from trustlens.operators import report as RP
from trustlens.operators import risk as R
from trustlens.plans import sql as Q
from trustlens.plans.catalog import (_SERVICE_SQL, _summary_sql, SPT_MEAN_SQL, resp)
from trustlens.session import scratch_path
from trustlens.sources import survey as SV

QUERIES: dict = {}
ORACLE: dict = {}


def register(key, sql=None):
    def deco(fn):
        QUERIES[key] = fn
        if sql is not None:
            ORACLE[key] = sql
        return fn
    return deco


def _scratch(spark, name: str) -> str:
    return scratch_path(spark, f"{name}_{uuid.uuid4().hex[:8]}")


@register("scan_survey", Q.with_resp(" SELECT * FROM respondents"))
def q_scan_survey(spark, sf):
    """Respondent table written as CSV with its columns in reverse order and one more
    column, read back by the header, validated and coerced."""
    df = resp(spark, sf)
    path = SV.write_csv(df.select(F.lit("note").alias("remark"), *reversed(df.columns)), _scratch(spark, "survey_csv"))
    return SV.read_survey(spark, path, "csv").select(*S.REQUIRED_COLUMNS)


_LEGACY_SQL = Q.with_resp(
    " SELECT CAST(respondent_id AS INT) AS respondent_id, gender, age_group, education, occupation,"
    " usage_frequency, " + ", ".join(f"CAST({c} AS INT) AS {c}" for c in S.LEGACY_SERVICE_COLUMNS)
    + ", " + ", ".join(S.LEGACY_LIKERT_COLUMNS) + " FROM respondents")


@register("scan_legacy", _LEGACY_SQL)
def q_scan_legacy(spark, sf):
    """Legacy 22-column profile (flags as True/False text) written as CSV, read
    back with the legacy schema, validated, flags coerced to 0/1."""
    legacy = SV.legacy_projection(resp(spark, sf))
    path = SV.write_csv(legacy.select(*reversed(legacy.columns)), _scratch(spark, "legacy_csv"))
    return SV.read_survey(spark, path, "csv", profile="legacy").select(*legacy.columns)


#: Lines of the CSV that get two more fields, lose the last one, or have text for a number.
_RAGGED = "CASE WHEN respondent_id % 41 = 7 THEN 'long' WHEN respondent_id % 43 = 5 THEN 'short' WHEN respondent_id % 47 = 3 THEN 'text' END"


def _line_sql() -> str:
    cut = ", ".join(f"coalesce(CAST({c} AS VARCHAR), '')" for c in S.REQUIRED_COLUMNS[:-1])
    last = f"coalesce(CAST({S.REQUIRED_COLUMNS[-1]} AS VARCHAR), '')"
    return (f" SELECT respondent_id, CASE {_RAGGED} WHEN 'long' THEN concat_ws(',', {cut}, {last}, 'more', '') WHEN 'short' THEN concat_ws(',', {cut})"
            f" ELSE concat_ws(',', {cut}, 'often') END AS line FROM respondents WHERE {_RAGGED} IS NOT NULL")


@register("csv_quarantine", Q.with_resp(_line_sql()))
def q_csv_quarantine(spark, sf):
    """Survey CSV in which some lines have two fields too many, one too few, or text where
    a number belongs: the lines that the reader puts aside, as they stand in the file."""
    df = resp(spark, sf)
    text = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in S.REQUIRED_COLUMNS]
    kind = F.expr(_RAGGED)
    line = (F.when(kind == "long", F.concat_ws(",", *text, F.lit("more"), F.lit(""))).when(kind == "short", F.concat_ws(",", *text[:-1]))
            .when(kind == "text", F.concat_ws(",", *text[:-1], F.lit("often"))).otherwise(F.concat_ws(",", *text)))
    path, aside = _scratch(spark, "ragged_csv"), _scratch(spark, "quarantine")
    # One column of whole lines, named like the header, without quoting.
    (df.select(line.alias(",".join(S.REQUIRED_COLUMNS))).write.option("header", True).option("sep", "\u0001")
     .option("quote", "").option("escapeQuotes", False).csv(path))
    SV.read_survey(spark, path, "csv", quarantine=aside)
    return spark.read.parquet(aside).select(F.substring_index("line", ",", 1).cast(dict(df.dtypes)["respondent_id"]).alias("respondent_id"), "line")


#: Damage to the respondent table, so that the checks have something to find: (column,
#: rows by id, value).  The same rules stand in the SQL checks.
DAMAGE = [("q_feel_secure", "respondent_id % 17 = 3", "9"), ("q_saves_time", "respondent_id % 29 = 1", "0"),
          ("q_trust_platform", "respondent_id % 23 = 5", "NULL"), ("q_saves_time", "respondent_id % 31 = 2", "NULL"),
          ("uses_upi", "respondent_id % 19 = 4", "2"), ("uses_atm", "respondent_id % 37 = 6", "NULL")]


def _damaged(df):
    """``df`` with the values of DAMAGE put in, as far as it has the columns."""
    for column, rows, value in DAMAGE:
        if column in df.columns:
            kind = dict(df.dtypes)[column]
            if kind == "boolean":
                df = df.withColumn(column, F.expr(f"CASE WHEN {rows} THEN {'NULL' if value == 'NULL' else repr(value)} ELSE CAST({column} AS STRING) END"))
            else:
                df = df.withColumn(column, F.expr(f"CASE WHEN {rows} THEN CAST({value} AS {kind}) ELSE {column} END"))
    return df


def _damaged_sql(column: str) -> str:
    out = f"CAST({column} AS VARCHAR)"
    for c, rows, value in DAMAGE:
        if c == column:
            out = f"CASE WHEN {rows} THEN {'NULL' if value == 'NULL' else repr(value)} ELSE {out} END"
    return out


def _viol_body(cols, ok, more: str = "") -> str:
    return ("SELECT column_name AS \"column\", count(*) AS n_bad, min(id) AS first_bad_id" + more
            + " FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS column_name, CAST(respondent_id AS BIGINT) AS id, {_damaged_sql(c)} AS value FROM respondents" for c in cols)
            + f") WHERE NOT coalesce({ok}, false) GROUP BY column_name")


_LIKERT_OK = "TRY_CAST(value AS DOUBLE) BETWEEN 1 AND 5"
_BINARY_OK = "value IN ('0', '1', 'true', 'false', 'True', 'False', 'TRUE', 'FALSE', '0.0', '1.0')"


@register("check_likert_range", Q.with_resp(" " + _viol_body(S.LIKERT_COLUMNS, _LIKERT_OK)))
def q_check_likert_range(spark, sf):
    """Likert violations in a table with values out of range and nulls put in."""
    return SV.check_likert_range(_damaged(resp(spark, sf)))


@register("check_binary", Q.with_resp(" " + _viol_body(S.BINARY_FEATURES, _BINARY_OK)))
def q_check_binary(spark, sf):
    """Flag violations in a table with wrong flags and nulls put in."""
    return SV.check_binary(_damaged(resp(spark, sf)))


@register("check_legacy", Q.with_resp(" " + _viol_body(S.LEGACY_LIKERT_COLUMNS, _LIKERT_OK, ", 'likert' AS \"check\"")
                                      + " UNION ALL " + _viol_body(S.LEGACY_SERVICE_COLUMNS, _BINARY_OK, ", 'binary' AS \"check\"")))
def q_check_legacy(spark, sf):
    """Legacy profile checks (Likert range and binary flags) of a damaged table."""
    legacy = _damaged(SV.legacy_projection(resp(spark, sf)))
    lk = SV.check_likert_range(legacy, S.LEGACY_LIKERT_COLUMNS).withColumn("check", F.lit("likert"))
    bn = SV.check_binary(legacy, S.LEGACY_SERVICE_COLUMNS).withColumn("check", F.lit("binary"))
    return lk.unionByName(bn)


@register("coerce_types", Q.with_resp(" SELECT * FROM respondents"))
def q_coerce_types(spark, sf):
    """Binary flags as text and Likert as double, coerced back to INT."""
    df = resp(spark, sf)
    raw = df.withColumns({c: F.when(F.col(c) == 1, "True").otherwise("False") for c in S.BINARY_FEATURES})
    raw = raw.withColumns({c: F.col(c).cast("double") for c in S.LIKERT_COLUMNS})
    return SV.coerce_types(raw).select(*S.REQUIRED_COLUMNS)


def _sink_sql() -> str:
    from trustlens.plans.catalog import ORACLE as checks
    names = {"service_adoption": "service_adoption", "likert_summary": "likert_summary", "fraud_profile": "fraud_profile",
             "channel_risk_matrix": "channel_risk_matrix", "security_gap_matrix": "security_gaps", "vulnerable_cohorts": "vulnerable_cohorts"}
    counts = " UNION ALL ".join(f"SELECT '{table}' AS name, count(*) AS n FROM ({checks[key]}) q" for table, key in names.items())
    return f"SELECT name AS \"table\", format, n AS rows FROM ({counts}) c, (VALUES ('parquet'), ('csv')) f(format)"


@register("sink_tables", _sink_sql())
def q_sink_tables(spark, sf):
    """Write the main result tables (parquet and CSV) and read back row counts."""
    df = resp(spark, sf)
    base = _scratch(spark, "tables")
    tables = {"service_adoption": D.service_adoption(df), "likert_summary": D.likert_summary(df),
              "fraud_profile": D.fraud_profile(df), "channel_risk_matrix": R.channel_risk_matrix(df),
              "security_gap_matrix": R.security_gaps(df), "vulnerable_cohorts": R.vulnerable_cohorts(df)}
    out = None
    for name, t in tables.items():
        for fmt in ("parquet", "csv"):
            path = SV.write_table(t, f"{base}/{fmt}/{name}", fmt)
            back = (spark.read.parquet(path) if fmt == "parquet"
                    else spark.read.option("header", True).csv(path))
            part = back.agg(F.count(F.lit(1)).alias("rows")).select(
                F.lit(name).alias("table"), F.lit(fmt).alias("format"), "rows")
            out = part if out is None else out.unionByName(part)
    return out


# ---------------------------------------------------------------------------
# report tables
# ---------------------------------------------------------------------------
def _fill_sql(template: str, *values: str) -> str:
    parts = template.replace("'", "''").split("{}")
    out = f"'{parts[0]}'"
    for v, p in zip(values, parts[1:]):
        out += f" || CAST({v} AS VARCHAR) || '{p}'"
    return out


_STATS_SQL = (f", v AS (SELECT {SPT_MEAN_SQL} AS x FROM respondents)"
              f" SELECT {Q.r('avg(x)', 3)} AS mean,"
              f" {Q.pct('sum(CASE WHEN x <= 2.0 THEN 1 ELSE 0 END)', 'count(*)')} AS pct_positive FROM v")
_WEAK_SQL = (_summary_sql(S.SPT_COLUMNS).replace(
    " SELECT a.column_name AS", ", summ AS (SELECT a.column_name AS", 1)
    + "), ranked AS (SELECT summ.*, items.item_order FROM summ JOIN " + Q.items_values()
    + " ON summ.\"column\" = items.column_name)"
    " SELECT question AS dimension, positive_pct, mean_score FROM ranked"
    " ORDER BY positive_pct, item_order LIMIT 1")
_POP_SQL = (f"SELECT count(*) AS n, sum(has_mfa_enabled) AS mfa, sum(has_experienced_fraud) AS fraud,"
            f" sum(CASE WHEN {Q.POSTURE} >= 70 THEN 1 ELSE 0 END) AS hp FROM respondents")
_REPORT_CTES = (
    f", top AS ({Q.nested(_SERVICE_SQL + ' ORDER BY adoption_pct DESC, cw.ord LIMIT 1')}),"
    f" st AS ({Q.nested(_STATS_SQL)}), weak AS ({Q.nested(_WEAK_SQL)}),"
    f" trust AS ({Q.nested(_summary_sql([S.TRUST_TARGET]))}),"
    f" griev AS ({Q.nested(_summary_sql(['q_grievance_resolution']))}),"
    f" pop AS ({_POP_SQL})")


@register("key_insights", Q.with_resp(
    _REPORT_CTES + ", s AS (" + " UNION ALL ".join(
        f"SELECT {i + 1} AS ord, {t} AS text" for i, t in enumerate([
            _fill_sql(RP.INSIGHTS[0], "(SELECT channel FROM top)", "(SELECT adoption_pct FROM top)"),
            _fill_sql(RP.INSIGHTS[1], Q.pct("(SELECT fraud FROM pop)", "(SELECT n FROM pop)")),
            _fill_sql(RP.INSIGHTS[2], Q.pct("(SELECT mfa FROM pop)", "(SELECT n FROM pop)")),
            _fill_sql(RP.INSIGHTS[3], "(SELECT mean FROM st)", "(SELECT pct_positive FROM st)"),
            _fill_sql(RP.INSIGHTS[4], "(SELECT dimension FROM weak)", "(SELECT positive_pct FROM weak)", "(SELECT mean_score FROM weak)"),
            _fill_sql(RP.INSIGHTS[5], Q.pct("(SELECT hp FROM pop)", "(SELECT n FROM pop)")),
            _fill_sql(RP.INSIGHTS[6], "(SELECT positive_pct FROM trust)")])) + ") SELECT * FROM s"))
def q_key_insights(spark, sf):
    return RP.key_insights(resp(spark, sf))


def _rec_sql() -> str:
    vals = [[Q.pct("(SELECT mfa FROM pop)", "(SELECT n FROM pop)")], [Q.pct("(SELECT fraud FROM pop)", "(SELECT n FROM pop)"), "(SELECT positive_pct FROM griev)"],
            ["(SELECT dimension FROM weak)"], [], [], []]
    rows = []
    for i, ((area, sev, tmpl, rec), v) in enumerate(zip(RP.RECOMMENDATIONS, vals)):
        rows.append(f"SELECT {i + 1} AS ord, '{area}' AS area, '{sev}' AS severity,"
                    f" {_fill_sql(tmpl, *v)} AS finding, '{rec.replace(chr(39), chr(39) * 2)}'"
                    " AS recommendation")
    return _REPORT_CTES + " " + " UNION ALL ".join(rows)


@register("recommendations", Q.with_resp(_rec_sql()))
def q_recommendations(spark, sf):
    return RP.recommendations(resp(spark, sf))
