"""Descriptive operators on hand-made frames."""
from conftest import survey_df, survey_rows
from trustlens.operators import descriptive as D
from trustlens.operators import risk as R


def test_likert_distribution_zero_fills(spark):
    rows = survey_rows(10)
    for r in rows:
        r["q_feel_secure"] = 2 if r["respondent_id"] % 2 else 4
    out = D.likert_distribution(survey_df(spark, rows), ["q_feel_secure"]).collect()
    assert [(r["rating_code"], r["count"]) for r in out] == [(1, 0), (2, 5), (3, 0), (4, 5), (5, 0)]
    assert [r["rating"] for r in out][0] == "Strongly Agree"


def test_fraud_profile_without_victims(spark):
    rows = survey_rows(12, has_experienced_fraud=0, reported_to_bank=0, fraud_resolved=0)
    out = {r["metric"]: (r["value"], r["pct"]) for r in D.fraud_profile(survey_df(spark, rows)).collect()}
    assert out["Experienced fraud"] == (0, 0.0)
    assert out["Reported to bank"] == (0, 0.0)
    assert out["Total respondents"] == (12, 100.0)


def test_attack_surface_consistency(spark, resp_small):
    m = R.channel_risk_matrix(resp_small).collect()
    raw = round(sum(r["weighted_risk_score"] for r in m), 2)
    a = R.attack_surface(resp_small).first()
    assert a["raw_exposure_score"] == raw
    assert a["normalised_attack_surface"] == round(min(raw / R.MAX_EXPOSURE * 100, 100) + 1e-12, 1)


def test_gap_priority(spark, resp_small):
    for r in R.security_gaps(resp_small).collect():
        assert abs(r["priority_score"] - r["severity"] * r["prevalence_pct"] / 100) < 0.0051


def test_cohorts_cover_population(spark, resp_small):
    n = resp_small.count()
    out = R.vulnerable_cohorts(resp_small).collect()
    per_segment = {}
    for r in out:
        per_segment[r["segment"]] = per_segment.get(r["segment"], 0) + r["n"]
    assert set(per_segment.values()) == {n}
    assert R.vulnerable_cohorts_union(resp_small).collect() == out


def test_histogram_counts_all_rows(spark, resp_small):
    h = D.histogram(resp_small, "years_digital_banking", 15).collect()
    assert len(h) == 15 and sum(r["count"] for r in h) == resp_small.count()


def test_exposure_score_rule(spark):
    from conftest import survey_df, survey_rows
    from trustlens import schema as S
    all_on = {c: 1 for c in S.SERVICE_COLUMNS}
    none = {c: 0 for c in S.SERVICE_COLUMNS}
    rows = survey_rows(1, **all_on) + [dict(survey_rows(1, **none)[0], respondent_id=2)]
    out = {r["respondent_id"]: (r["exposure_score"], r["risk_level"])
           for r in R.exposure_score(survey_df(spark, rows)).collect()}
    assert out[1] == (100.0, "Critical") and out[2] == (0.0, "Medium")


def test_legacy_variants_shape(spark, resp_small):
    s = D.likert_summary(resp_small, legacy=True)
    assert "std" not in s.columns
    assert D.spt_index_stats(resp_small, legacy=True).columns == ["mean", "median", "std", "pct_positive"]
    svc = D.service_adoption_legacy(resp_small).collect()
    assert [r["service"] for r in svc][-1] == "Digital Payment Apps (UPI)"
    assert D.frequency_table(resp_small, "region", pct_name="percentage").columns == \
        ["category", "count", "percentage"]


def test_threat_actor_table(spark):
    t = R.threat_actor_table(spark).collect()
    assert len(t) == 5
    assert t[0]["tactics"] == "Smishing | Vishing | Fake UPI apps | OTP fraud"
