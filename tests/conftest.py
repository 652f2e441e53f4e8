import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from trustlens.session import get_session
    s = get_session("local[4]", 4, app_name="trustlens-tests",
                    extra={"spark.checkpoint.dir": tempfile.mkdtemp(prefix="tl-test-ckpt-")})
    yield s
    s.stop()


@pytest.fixture(scope="session")
def resp_small(spark):
    from trustlens.sources.respondents import respondents_table
    return respondents_table(spark, SMALL)


def survey_rows(n=40, **override):
    """Hand-made valid survey rows (main profile) as dicts."""
    from trustlens import schema as S
    rows = []
    for i in range(n):
        r = {}
        for c in S.REQUIRED_COLUMNS:
            if c == "respondent_id":
                r[c] = i + 1
            elif c in S.LIKERT_COLUMNS:
                r[c] = 1 + (i * 7 + len(c)) % 5
            elif c in S.BINARY_FEATURES:
                r[c] = (i + len(c)) % 2
            elif c in ("years_digital_banking", "num_phishing_attempts_received"):
                r[c] = i % 9
            elif c == "usage_frequency":
                r[c] = ["Daily", "Weekly", "Monthly", "Rarely"][i % 4]
            elif c == "fraud_type":
                r[c] = "Phishing"
            else:
                opts = S.ORDINAL_MAPS.get(c) or S.NOMINAL_LEVELS.get(c) or ["A", "B"]
                r[c] = opts[i % len(opts)]
        r.update(override)
        rows.append(r)
    return rows


def survey_df(spark, rows):
    from trustlens import schema as S
    return spark.createDataFrame([tuple(r[c] for c in S.REQUIRED_COLUMNS) for r in rows],
                                 S.survey_schema())
