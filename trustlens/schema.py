"""Survey schema profiles, column groups and static dimension tables.

The lists, titles, weights and label texts in this module are fixed values that
results must reproduce exactly; they are stated here as plain data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Column groups
# ---------------------------------------------------------------------------
DEMOGRAPHIC_COLUMNS = [
    "gender", "age_group", "education", "occupation", "income_bracket", "region",
    "bank_type", "years_digital_banking",
]
SERVICE_COLUMNS = [
    "uses_mobile_banking", "uses_internet_banking", "uses_atm", "uses_upi",
    "uses_neft_rtgs", "uses_aadhaar_pay",
]
USAGE_COLUMNS = ["usage_frequency", "transaction_frequency", "avg_transaction_amount_tier"]
SECURITY_SETUP_COLUMNS = [
    "has_mfa_enabled", "uses_biometric_auth", "uses_strong_password",
    "regularly_updates_app", "shared_device", "device_type", "os_type",
]
INCIDENT_COLUMNS = [
    "has_experienced_fraud", "fraud_type", "reported_to_bank", "fraud_resolved",
    "num_phishing_attempts_received",
]
LITERACY_COLUMNS = [
    "q_phishing_awareness", "q_password_hygiene", "q_data_sharing_awareness",
    "q_regulatory_awareness",
]
SECURITY_PERCEPTION_COLUMNS = [
    "q_feel_secure", "q_security_features", "q_privacy_policy_clarity",
    "q_mfa_effectiveness", "q_data_breach_concern", "q_incident_response_speed",
    "q_third_party_concern",
]
TRUST_COLUMNS = ["q_trust_platform", "q_grievance_resolution", "q_regulatory_trust"]
CONVENIENCE_COLUMNS = [
    "q24_7_availability", "q_saves_time", "q_easy_access", "q_reduced_branch_visits",
    "q_speed_efficiency", "q_user_friendly", "q_overall_satisfaction",
    "q_improved_experience",
]
SPT_COLUMNS = SECURITY_PERCEPTION_COLUMNS + TRUST_COLUMNS
LIKERT_COLUMNS = LITERACY_COLUMNS + SPT_COLUMNS + CONVENIENCE_COLUMNS

BINARY_FEATURES = [
    "has_mfa_enabled", "uses_biometric_auth", "uses_strong_password",
    "regularly_updates_app", "shared_device", "uses_mobile_banking",
    "uses_internet_banking", "uses_atm", "uses_upi", "uses_neft_rtgs",
    "uses_aadhaar_pay", "has_experienced_fraud", "reported_to_bank", "fraud_resolved",
]
NOMINAL_COLUMNS = ["gender", "region", "bank_type", "device_type", "os_type", "occupation"]
COHORT_SEGMENTS = ["age_group", "income_bracket", "region", "education", "occupation"]
CHI_SQUARE_SEGMENTS = ["gender", "age_group", "income_bracket", "region", "bank_type"]

FRAUD_TARGET = "has_experienced_fraud"
TRUST_TARGET = "q_trust_platform"

REQUIRED_COLUMNS = (
    ["respondent_id", "gender", "age_group", "education", "occupation",
     "income_bracket", "region", "bank_type", "years_digital_banking"]
    + SERVICE_COLUMNS
    + ["usage_frequency", "transaction_frequency", "avg_transaction_amount_tier",
       "has_mfa_enabled", "uses_biometric_auth", "uses_strong_password",
       "regularly_updates_app", "shared_device", "device_type", "os_type",
       "has_experienced_fraud", "fraud_type", "reported_to_bank",
       "fraud_resolved", "num_phishing_attempts_received"]
    + LIKERT_COLUMNS
)

# ---------------------------------------------------------------------------
# Likert labels and item titles
# ---------------------------------------------------------------------------
LIKERT_LABELS = {
    1: "Strongly Agree",
    2: "Agree",
    3: "Neutral",
    4: "Disagree",
    5: "Strongly Disagree",
}

LIKERT_TITLES = {
    "q_phishing_awareness": "Can identify phishing messages",
    "q_password_hygiene": "Uses unique strong passwords",
    "q_data_sharing_awareness": "Understands bank data collection",
    "q_regulatory_awareness": "Knows data-protection rights",
    "q_feel_secure": "Overall feeling of security",
    "q_security_features": "Adequacy of security features",
    "q_privacy_policy_clarity": "Privacy policy is clear/transparent",
    "q_mfa_effectiveness": "MFA / two-step login is effective",
    "q_data_breach_concern": "Concern about data breaches",
    "q_incident_response_speed": "Bank responds quickly to incidents",
    "q_third_party_concern": "Concern over third-party data sharing",
    "q_trust_platform": "Trust in digital banking platform",
    "q_grievance_resolution": "Timely grievance resolution",
    "q_regulatory_trust": "Trust in regulators to protect data",
    "q24_7_availability": "24/7 transaction availability",
    "q_saves_time": "Saves time vs branch visits",
    "q_easy_access": "Easy to access and navigate",
    "q_reduced_branch_visits": "Reduced need to visit branch",
    "q_speed_efficiency": "Speed and efficiency",
    "q_user_friendly": "User-friendly interface",
    "q_overall_satisfaction": "Overall satisfaction",
    "q_improved_experience": "Improved banking experience",
}

# Scale names of the reliability table, in output order.
RELIABILITY_SCALES = [
    ("Security Perceptions", SECURITY_PERCEPTION_COLUMNS),
    ("Trust Dimensions", TRUST_COLUMNS),
    ("Cybersecurity Literacy", LITERACY_COLUMNS),
    ("Convenience / Satisfaction", CONVENIENCE_COLUMNS),
    ("Full SPT Scale", SPT_COLUMNS),
    ("All Likert Items", LIKERT_COLUMNS),
]

# ---------------------------------------------------------------------------
# Channel risk weights
# (service column, channel, adoption label, attack surface, malware, phishing,
#  account takeover, data exfiltration)
# ---------------------------------------------------------------------------
CHANNEL_WEIGHTS = [
    ("uses_mobile_banking", "Mobile Banking", "Mobile Banking App", 0.85, 0.75, 0.90, 0.80, 0.70),
    ("uses_internet_banking", "Internet Banking", "Internet Banking", 0.70, 0.80, 0.85, 0.85, 0.80),
    ("uses_atm", "ATM Services", "ATM Services", 0.60, 0.55, 0.50, 0.65, 0.45),
    ("uses_upi", "UPI / Payments", "UPI / Digital Payments", 0.90, 0.65, 0.95, 0.70, 0.60),
    ("uses_neft_rtgs", "NEFT/RTGS", "NEFT / RTGS", 0.55, 0.45, 0.60, 0.70, 0.65),
    ("uses_aadhaar_pay", "Aadhaar Pay", "Aadhaar Pay", 0.65, 0.50, 0.70, 0.60, 0.75),
]
RISK_WEIGHT_NAMES = [
    "attack_surface", "malware_risk", "phishing_risk", "account_takeover_risk",
    "data_exfiltration_risk",
]

# ---------------------------------------------------------------------------
# Threat actor profiles
# (actor, primary target, tactics, skill level, motivation)
# ---------------------------------------------------------------------------
THREAT_ACTORS = [
    ("Phishing Operator", "UPI / Mobile Banking users",
     ["Smishing", "Vishing", "Fake UPI apps", "OTP fraud"], "Low–Medium", "Financial"),
    ("Account Takeover Actor", "Internet Banking / High-income users",
     ["Credential stuffing", "SIM swap", "Session hijack"], "Medium–High", "Financial"),
    ("Insider Threat", "Customer PII / Transaction records",
     ["Data exfiltration", "Privilege abuse"], "Medium", "Financial / Espionage"),
    ("APT / Nation-State", "Banking infrastructure / SWIFT",
     ["Spear phishing", "Supply-chain attack", "Zero-day exploits"], "Very High",
     "Geopolitical / Financial"),
    ("Social Engineer", "Low-literacy / Elderly users",
     ["Impersonation", "Fake customer care", "Gift-card scams"], "Low", "Financial"),
]

# ---------------------------------------------------------------------------
# Security gaps (gap, severity, mitigation).  Prevalence rules are
# in operators/risk.py, in the same order.
# ---------------------------------------------------------------------------
SECURITY_GAPS = [
    ("No MFA enabled", 5, "Mandate MFA for all high-value transactions"),
    ("Shared device usage", 4, "Enforce session expiry + device-binding alerts"),
    ("No biometric authentication", 3, "Default-enable biometrics on supported devices"),
    ("Weak password hygiene", 4, "Enforce password complexity + breach-check on login"),
    ("Low phishing awareness", 4, "Mandatory in-app phishing-simulation training"),
    ("App not regularly updated", 3, "Enforce minimum app version before login"),
    ("No fraud reported after incident", 5,
     "Streamline one-tap fraud reporting; proactive outreach to victims"),
]

# ---------------------------------------------------------------------------
# Ordinal codes for ordered categories
# ---------------------------------------------------------------------------
ORDINAL_MAPS = {
    "age_group": ["18-24", "25-34", "35-44", "45-54", "55+"],
    "education": ["High School", "Graduate", "Postgraduate", "Doctoral"],
    "income_bracket": ["<25k", "25k-50k", "50k-100k", "100k-200k", ">200k"],
    "usage_frequency": ["Rarely", "Monthly", "Weekly", "Daily"],
    "transaction_frequency": ["Monthly", "Weekly", "Once daily", "Multiple times daily"],
    "avg_transaction_amount_tier": ["<1k INR", "1k-10k INR", "10k-50k INR", ">50k INR"],
}

# Levels of the nominal columns, in dummy-column order (sorted, as one-hot
# encoders name them).
NOMINAL_LEVELS = {
    "gender": sorted(["Male", "Female", "Non-binary", "Prefer not to say"]),
    "region": sorted(["Metro", "Tier-1", "Tier-2", "Tier-3", "Rural"]),
    "bank_type": sorted(["Public Sector", "Private Sector", "Cooperative", "Payment Bank", "NBFC"]),
    "device_type": sorted(["Smartphone", "Tablet", "Laptop", "Desktop"]),
    "os_type": sorted(["Android", "iOS", "Windows", "macOS", "Other"]),
    "occupation": sorted(["Student", "Salaried Employee", "Business Owner", "Self-Employed",
                          "Retired", "Other"]),
}

# Display order of usage frequency (legacy satisfaction chart).
USAGE_ORDER = ["Daily", "Weekly", "Monthly", "Rarely"]

# Cluster labels, assigned by mean posture rank (1 = highest posture).
CLUSTER_LABELS = [
    "Security-Conscious & Trusting",
    "Digitally Active but Vulnerable",
    "Skeptical / Low-Adopter",
    "High-Risk / Fraud-Exposed",
]

# Anomaly tiers on the 0-100 score: (label, lower exclusive, upper inclusive).
ANOMALY_TIERS = [("Critical", -1, 20), ("High", 20, 40), ("Medium", 40, 60), ("Normal", 60, 101)]

# Cluster feature set (11 numeric columns), in matrix order.
CLUSTER_FEATURES = [
    "security_posture_score", "security_behaviour_count", "avg_literacy_score",
    "has_experienced_fraud", "num_services_used", "high_usage_intensity",
    "q_feel_secure", "q_trust_platform", "q_grievance_resolution",
    "q_phishing_awareness", "q_data_breach_concern",
]

# ---------------------------------------------------------------------------
# Schema profiles
# ---------------------------------------------------------------------------
_STRING_COLS = {
    "gender", "age_group", "education", "occupation", "income_bracket", "region",
    "bank_type", "usage_frequency", "transaction_frequency",
    "avg_transaction_amount_tier", "device_type", "os_type", "fraud_type",
}


def survey_schema() -> T.StructType:
    """52-column main survey profile, in file column order."""
    fields = []
    for c in REQUIRED_COLUMNS:
        if c == "respondent_id":
            t = T.LongType()
        elif c in _STRING_COLS:
            t = T.StringType()
        else:
            t = T.IntegerType()
        fields.append(T.StructField(c, t, True))
    return T.StructType(fields)


LEGACY_SERVICE_COLUMNS = ["uses_mobile_banking", "uses_internet_banking", "uses_atm", "uses_upi"]
LEGACY_LIKERT_COLUMNS = [
    "q24_7_availability", "q_saves_time", "q_easy_access", "q_reduced_branch_visits",
    "q_feel_secure", "q_security_features", "q_trust_platform", "q_speed_efficiency",
    "q_user_friendly", "q_grievance_resolution", "q_overall_satisfaction",
    "q_improved_experience",
]
LEGACY_COLUMNS = (["respondent_id", "gender", "age_group", "education", "occupation",
                   "usage_frequency"] + LEGACY_SERVICE_COLUMNS + LEGACY_LIKERT_COLUMNS)


def legacy_schema() -> T.StructType:
    """22-column legacy profile: booleans are text True/False."""
    fields = [T.StructField("respondent_id", T.IntegerType(), True)]
    for c in ["gender", "age_group", "education", "occupation", "usage_frequency"]:
        fields.append(T.StructField(c, T.StringType(), True))
    for c in LEGACY_SERVICE_COLUMNS:
        fields.append(T.StructField(c, T.BooleanType(), True))
    for c in LEGACY_LIKERT_COLUMNS:
        fields.append(T.StructField(c, T.IntegerType(), True))
    return T.StructType(fields)


# ---------------------------------------------------------------------------
# Dimension DataFrames (fixed size, safe to broadcast)
# ---------------------------------------------------------------------------

def channel_weights_df(spark: SparkSession) -> DataFrame:
    schema = ("service_col string, channel string, adoption_label string, "
              "attack_surface double, malware_risk double, phishing_risk double, "
              "account_takeover_risk double, data_exfiltration_risk double, ord int")
    rows = [tuple(r) + (i,) for i, r in enumerate(CHANNEL_WEIGHTS)]
    return spark.createDataFrame(rows, schema)


def likert_items_df(spark: SparkSession) -> DataFrame:
    scale_of = {}
    for name, cols in [("literacy", LITERACY_COLUMNS), ("perception", SECURITY_PERCEPTION_COLUMNS),
                       ("trust", TRUST_COLUMNS), ("convenience", CONVENIENCE_COLUMNS)]:
        for c in cols:
            scale_of[c] = name
    rows = [(c, LIKERT_TITLES[c], scale_of[c], i) for i, c in enumerate(LIKERT_COLUMNS)]
    return spark.createDataFrame(rows, "column string, title string, scale string, item_order int")


def likert_labels_df(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(sorted(LIKERT_LABELS.items()), "code int, label string")


def threat_actors_df(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [(a, t, list(tac), s, m) for a, t, tac, s, m in THREAT_ACTORS],
        "threat_actor string, primary_target string, tactics array<string>, "
        "skill_level string, motivation string")
