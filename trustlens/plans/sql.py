"""SQL text helpers for the DuckDB cross-check queries.

Each check query starts with the ``respondents`` CTE and then states the
operator in plain SQL, with the same rounding rule as the Spark side
(``floor(x * 10^d + 0.5) / 10^d`` on DOUBLE) and explicit output types.
"""

from __future__ import annotations

from trustlens import schema as S
from trustlens.sources.respondents import respondents_cte


def r(expr: str, d: int) -> str:
    p = 10 ** d
    return f"(floor(CAST(({expr}) AS DOUBLE) * {p} + 0.5) / {p})"


def pct(num: str, den: str, d: int = 1) -> str:
    return r(f"CAST(({num}) AS DOUBLE) / ({den}) * 100", d)


POSTURE = (
    "least(greatest(has_mfa_enabled * 20 + uses_biometric_auth * 15 + uses_strong_password * 15"
    " + regularly_updates_app * 15 + (1 - shared_device) * 10"
    " + CASE WHEN q_phishing_awareness IN (1, 2) THEN 10 ELSE 0 END"
    " + CASE WHEN q_password_hygiene IN (1, 2) THEN 5 ELSE 0 END"
    " + (1 - has_experienced_fraud) * 10, 0), 100)")

POSTURE_NO_FRAUD = (
    "least(greatest(has_mfa_enabled * 20 + uses_biometric_auth * 15 + uses_strong_password * 15"
    " + regularly_updates_app * 15 + (1 - shared_device) * 10"
    " + CASE WHEN q_phishing_awareness IN (1, 2) THEN 10 ELSE 0 END"
    " + CASE WHEN q_password_hygiene IN (1, 2) THEN 5 ELSE 0 END, 0), 100)")


def vulnerable(posture: str = POSTURE) -> str:
    return (f"CASE WHEN ({posture}) < 40 AND (has_mfa_enabled = 0 OR has_experienced_fraud = 1)"
            " THEN 1 ELSE 0 END")


def row_mean(cols: list[str]) -> str:
    s = " + ".join(f"coalesce({c}, 0)" for c in cols)
    k = " + ".join(f"CASE WHEN {c} IS NULL THEN 0 ELSE 1 END" for c in cols)
    return f"(CAST(({s}) AS DOUBLE) / ({k}))"


def items_values() -> str:
    """(column, title, item_order) rows of the 22 Likert items."""
    rows = ", ".join(f"('{c}', '{S.LIKERT_TITLES[c]}', {i})" for i, c in enumerate(S.LIKERT_COLUMNS))
    return f"(VALUES {rows}) AS items(column_name, title, item_order)"


def unpivot_likert(cols: list[str], src: str = "respondents") -> str:
    """Long form (column_name, rating) of the given items, as UNION ALL."""
    return " UNION ALL ".join(f"SELECT '{c}' AS column_name, {c} AS rating FROM {src}" for c in cols)


def nested(body: str) -> str:
    """A check body (', a AS (...) SELECT ...') as a self-contained subquery."""
    assert body.startswith(", ")
    return "WITH " + body[2:]


def with_resp(body: str) -> str:
    """Prefix the respondents CTE; ``body`` starts with ', name AS (...)' or ' SELECT'."""
    return respondents_cte() + body


# ---------------------------------------------------------------------------
# Distribution tails in SQL (same formulas as trustlens.functions)
# ---------------------------------------------------------------------------

def erfc(x: str) -> str:
    from trustlens.functions import ERFC_COEFFS as C
    z = f"abs({x})"
    t = f"(1.0::DOUBLE / (1.0::DOUBLE + 0.5 * {z}))"
    poly = f"{C[-1]!r}"
    for c in reversed(C[1:-1]):
        poly = f"({c!r} + {t} * {poly})"
    ans = f"({t} * exp(-{z} * {z} + {C[0]!r} + {t} * {poly}))"
    return f"(CASE WHEN {x} >= 0 THEN {ans} ELSE 2.0 - {ans} END)"


def norm_sf(z: str) -> str:
    return f"(0.5 * {erfc(f'({z}) / 1.4142135623730951')})"


def chi2_sf(x: str, dof: str) -> str:
    half = f"(({x}) / 2.0)"
    terms = lambda n, step: (f"list_sum(list_transform(range(0, {n}), lambda i:"  # noqa: E731
                             f" exp(-{half} + coalesce(list_sum(list_transform(range(1, i + 1), lambda j: ln(({x}) / ({step})))), 0.0))))")
    even = terms(f"({dof}) // 2", "2.0 * j")
    odd = (f"{erfc(f'sqrt({half})')} + sqrt(2.0 * ({x}) / pi()) * coalesce({terms(f'(({dof}) - 1) // 2', '2.0 * j + 1')}, 0.0)")
    return f"(CASE WHEN ({x}) <= 0 THEN 1.0 WHEN ({dof}) % 2 = 0 THEN {even} ELSE {odd} END)"
