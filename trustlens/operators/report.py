"""Key insights and policy recommendations: sentence tables filled with values
computed from the data (each value is a scalar subquery over a small result
table; the sentences are built with column expressions)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trustlens import functions as X
from trustlens import schema as S
from trustlens.operators import descriptive as D

# ---------------------------------------------------------------------------
# Sentence templates ({} = value from the data) and the
# recommendation table (area, severity, finding template, recommendation).
# ---------------------------------------------------------------------------
INSIGHTS = [
    "Top channel: {} ({}% adoption) — highest attack-surface priority.",
    "{}% of respondents have experienced digital banking fraud — exceeding industry benchmarks.",
    "Only {}% have MFA enabled — a critical security gap across all risk segments.",
    "SPT index mean: {} — {}% of users are positive on security/trust.",
    "Weakest SPT dimension: '{}' ({}% positive, mean {}).",
    "Only {}% of respondents score ≥70/100 on the composite Security Posture Index.",
    "Platform trust: {}% positive — driven by convenience but undermined by incident resolution failures.",
]

RECOMMENDATIONS = [
    ("Multi-Factor Authentication", "Critical",
     "Only {}% of users have MFA enabled despite it being the single most effective fraud deterrent.",
     "Mandate MFA for all transactions above ₹5,000. Require banks to default-enable MFA for new accounts."),
    ("Fraud Incident Response", "High",
     "{}% of respondents experienced fraud; grievance resolution scores {}% positive — the weakest trust driver.",
     "Legislate 48-hour mandatory acknowledgement and 15-day resolution SLA for digital fraud complaints, with public reporting."),
    ("Data Privacy & Transparency", "High",
     "Weakest SPT dimension: '{}' — users lack confidence in institutional accountability.",
     "Require plain-language data-use disclosures, granular consent dashboards, and third-party data-sharing audit trails."),
    ("Cybersecurity Literacy", "Medium",
     "Low phishing-awareness and password-hygiene scores correlate strongly with fraud victimisation in the ML models.",
     "Mandate bank-funded in-app security literacy modules; integrate cyber-hygiene into school curricula."),
    ("Regulatory Oversight", "Medium",
     "Trust in regulators is fragmented — younger, rural, and lower-income cohorts show significantly lower regulatory trust.",
     "Establish an independent Digital Banking Ombudsman with publicly accessible incident dashboards and quarterly reporting."),
    ("Shared-Device & ATM Security", "Medium",
     "25%+ of respondents access digital banking on shared devices; ATM skimming remains a vector in Tier-2/3 cities.",
     "Enforce automatic session-logout, device-fingerprinting alerts, and mandatory EMV chip adoption for ATM cards."),
]


def fill(template: str, *values: Column) -> Column:
    """Template with {} slots -> concat of literal parts and values as text."""
    parts = template.split("{}")
    assert len(parts) == len(values) + 1, template
    out = [F.lit(parts[0])]
    for v, p in zip(values, parts[1:]):
        out += [v.cast("string"), F.lit(p)]
    return F.concat(*out)


def _population(df: DataFrame) -> DataFrame:
    """One row: respondents, the counts the texts need, and the adopters per service."""
    p = X.posture_expr()
    return df.agg(F.count(F.lit(1)).alias("n"), F.sum("has_mfa_enabled").alias("mfa"),
                  F.sum("has_experienced_fraud").alias("fraud"),
                  F.sum((p >= 70).cast("int")).alias("hp"), *[F.sum(c).alias(c) for c in S.SERVICE_COLUMNS])


def _one(df: DataFrame, *columns: str):
    """The named columns of a one-row table as one scalar."""
    return df.select(F.struct(*columns)).scalar()


def key_insights(df: DataFrame) -> DataFrame:
    """Seven sentences (ord, text) filled from one aggregate over the population and the
    services, one table of Likert counts and one histogram of the SPT index."""
    counts = D.likert_counts(df)  # one counts plan shared by the Likert values
    pop = _population(df).withColumns({
        "st": _one(D.spt_index_stats(df), "mean", "pct_positive"),
        "weak": _one(D.weakest_dimension(df, counts), "dimension", "positive_pct", "mean_score"),
        "trust": _one(D.likert_summary(df, [S.TRUST_TARGET], counts=counts), "positive_pct"),
        "top": F.array_max(F.array(*[F.struct(X.pct(F.col(w[0]), F.col("n")).alias("pct"), F.lit(-i).alias("place"), F.lit(w[2]).alias("channel"))
                                     for i, w in enumerate(S.CHANNEL_WEIGHTS)]))})
    n = F.col("n")
    texts = [
        fill(INSIGHTS[0], F.col("top.channel"), F.col("top.pct")),
        fill(INSIGHTS[1], X.pct(F.col("fraud"), n)),
        fill(INSIGHTS[2], X.pct(F.col("mfa"), n)),
        fill(INSIGHTS[3], F.col("st.mean"), F.col("st.pct_positive")),
        fill(INSIGHTS[4], F.col("weak.dimension"), F.col("weak.positive_pct"), F.col("weak.mean_score")),
        fill(INSIGHTS[5], X.pct(F.col("hp"), n)),
        fill(INSIGHTS[6], F.col("trust.positive_pct")),
    ]
    rows = F.array(*[F.struct(F.lit(i + 1).alias("ord"), t.alias("text")) for i, t in enumerate(texts)])
    return pop.select(F.explode(rows).alias("r")).select("r.ord", "r.text")


def recommendations(df: DataFrame) -> DataFrame:
    """Six (area, severity, finding, recommendation) rows, findings from data."""
    counts = D.likert_counts(df)  # one counts plan shared by the Likert values
    weak = D.weakest_dimension(df, counts).select("dimension").scalar()
    griev = D.likert_summary(df, ["q_grievance_resolution"], counts=counts) \
        .select("positive_pct").scalar()
    pop = _population(df)
    n = F.col("n")
    values = [[X.pct(F.col("mfa"), n)], [X.pct(F.col("fraud"), n), griev], [weak], [], [], []]
    rows = F.array(*[
        F.struct(F.lit(i + 1).alias("ord"), F.lit(area).alias("area"), F.lit(sev).alias("severity"),
                 fill(tmpl, *vals).alias("finding"), F.lit(rec).alias("recommendation"))
        for i, ((area, sev, tmpl, rec), vals) in enumerate(zip(RECOMMENDATIONS, values))])
    return pop.select(F.explode(rows).alias("r")).select("r.*")
