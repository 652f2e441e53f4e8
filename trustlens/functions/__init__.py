"""Scalar column expressions shared by the operators.

All of them are built-in Spark expressions (JVM side, whole-stage codegen);
none is a Python UDF.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from trustlens import schema as S


def rnd(c: Column | str, digits: int) -> Column:
    """Round half up on DOUBLE: floor(x * 10^d + 0.5) / 10^d.

    Spark's ``round`` rounds the decimal text and other engines round the binary
    double; this form gives the same double in every engine.
    """
    p = 10 ** digits
    c = F.col(c) if isinstance(c, str) else c
    return (F.floor(c.cast("double") * p + 0.5) / p).cast("double")


def pct(num: Column, den: Column, digits: int = 1) -> Column:
    """Percentage num / den * 100, rounded; operands are exact counts."""
    return rnd(num / den * 100, digits)


def safe_div(num: Column, den: Column) -> Column:
    return F.when(den != 0, num / den)


# ---------------------------------------------------------------------------
# Row-level rules
# ---------------------------------------------------------------------------

def posture_expr(fraud_term: bool = True) -> Column:
    """Security posture 0-100 (higher = safer), integer valued.

    20*mfa + 15*biometric + 15*strong password + 15*updates + 10*(1-shared)
    + 10*(phishing awareness in 1,2) + 10*(1-fraud) + 5*(password hygiene in 1,2),
    clipped to 0..100.  ``fraud_term=False`` drops the fraud component (the
    leak-free variant used as an ML feature for the fraud target).
    """
    s = (F.col("has_mfa_enabled") * 20
         + F.col("uses_biometric_auth") * 15
         + F.col("uses_strong_password") * 15
         + F.col("regularly_updates_app") * 15
         + (1 - F.col("shared_device")) * 10
         + F.col("q_phishing_awareness").isin(1, 2).cast("int") * 10
         + F.col("q_password_hygiene").isin(1, 2).cast("int") * 5)
    if fraud_term:
        s = s + (1 - F.col("has_experienced_fraud")) * 10
    return F.least(F.greatest(s, F.lit(0)), F.lit(100)).cast("int")


def row_mean(cols: list[str], digits: int | None = None) -> Column:
    """Mean of the non-null items of a row (nulls skipped, as pandas does)."""
    total = sum((F.coalesce(F.col(c), F.lit(0)) for c in cols), F.lit(0))
    count = sum((F.col(c).isNotNull().cast("int") for c in cols), F.lit(0))
    m = F.when(count > 0, total / count)
    return rnd(m, digits) if digits is not None else m.cast("double")


def vulnerable_expr(posture: Column) -> Column:
    return ((posture < 40) & ((F.col("has_mfa_enabled") == 0)
                              | (F.col("has_experienced_fraud") == 1))).cast("int")


def likert_bucketize(x: Column, thresholds=(-1.2, -0.4, 0.4, 1.2)) -> Column:
    """Continuous value -> 1..5 by strict thresholds (x > t moves up a level)."""
    t1, t2, t3, t4 = thresholds
    return (F.when(x > t4, 5).when(x > t3, 4).when(x > t2, 3).when(x > t1, 2)
            .otherwise(1)).cast("int")


def weighted_assign(key: Column, options: list[tuple[str, int]], salt: int = 1) -> Column:
    """Deterministic weighted category by hash of a key.

    Draw d = the first 15 hex digits of the md5 of ``key:salt``, modulo the total
    weight; then the first option whose running weight exceeds d.  Draws do not repeat
    with a period of the key.
    """
    total = sum(w for _, w in options)
    digits = F.substring(F.md5(F.concat(key.cast("bigint").cast("string"), F.lit(f":{salt}"))), 1, 15)
    d = F.conv(digits, 16, 10).cast("bigint") % total
    expr = None
    run = 0
    for label, w in options[:-1]:
        run += w
        expr = F.when(d < run, F.lit(label)) if expr is None else expr.when(d < run, F.lit(label))
    last = F.lit(options[-1][0])
    return last if expr is None else expr.otherwise(last)


def anomaly_tier(score: Column) -> Column:
    """0-100 score -> tier, upper-inclusive bins (-1,20], (20,40], (40,60], (60,101]."""
    e = None
    for label, lo, hi in S.ANOMALY_TIERS:
        cond = (score > lo) & (score <= hi)
        e = F.when(cond, label) if e is None else e.when(cond, label)
    return e


def anomaly_tier_ord(tier: Column) -> Column:
    e = None
    for i, (label, _, _) in enumerate(S.ANOMALY_TIERS):
        e = F.when(tier == label, i) if e is None else e.when(tier == label, i)
    return e


def risk_level(score: Column) -> Column:
    return F.when(score > 70, "Critical").when(score > 50, "High").otherwise("Medium")


def alpha_label(alpha: Column) -> Column:
    """Reliability label; NaN/null first (Spark orders NaN above all numbers)."""
    return (F.when(alpha.isNull() | F.isnan(alpha), "N/A")
            .when(alpha >= 0.9, "Excellent").when(alpha >= 0.8, "Good")
            .when(alpha >= 0.7, "Acceptable").when(alpha >= 0.6, "Questionable")
            .otherwise("Poor"))


def likert_label(code: Column) -> Column:
    m = F.create_map(*[x for k, v in sorted(S.LIKERT_LABELS.items()) for x in (F.lit(k), F.lit(v))])
    return m[code]


def ordinal_code(column: str, values: list[str] | None = None) -> Column:
    """Ordered category -> code (position in the order), unseen -> -1."""
    values = values or S.ORDINAL_MAPS[column]
    m = F.create_map(*[x for i, v in enumerate(values) for x in (F.lit(v), F.lit(i))])
    return F.coalesce(m[F.col(column)], F.lit(-1)).cast("int")


def title_label(name: Column, suffix: str | None = None) -> Column:
    """Strip a suffix, '_' -> ' ', title case."""
    c = name
    if suffix:
        c = F.regexp_replace(c, F.lit(suffix + "$"), F.lit(""))
    return F.initcap(F.replace(c, F.lit("_"), F.lit(" ")))


# ---------------------------------------------------------------------------
# Distribution tails (column expressions, evaluated on few-row results)
# ---------------------------------------------------------------------------
# Chebyshev coefficients of the complementary error function
# (published approximation, fractional error below 1.2e-7).
ERFC_COEFFS = [-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806,
               0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277]


def erfc_sql(x: str) -> str:
    """erfc of a SQL expression (Chebyshev form above), as Spark SQL text."""
    z = f"abs({x})"
    t = f"(1.0D / (1.0D + 0.5D * {z}))"
    poly = f"{ERFC_COEFFS[-1]!r}D"
    for c in reversed(ERFC_COEFFS[1:-1]):
        poly = f"({c!r}D + {t} * {poly})"
    ans = f"({t} * exp(-{z} * {z} + {ERFC_COEFFS[0]!r}D + {t} * {poly}))"
    return f"(CASE WHEN {x} >= 0 THEN {ans} ELSE 2.0D - {ans} END)"


def norm_sf_sql(z: str) -> str:
    return f"(0.5D * {erfc_sql(f'(({z}) / {math.sqrt(2.0)!r}D)')})"


def chi2_sf_sql(x: str, dof: str) -> str:
    """Upper tail of the chi-square distribution for integer dof (closed form).

    Even dof: exp(-x/2) * sum_{i<dof/2} (x/2)^i / i!.
    Odd dof:  erfc(sqrt(x/2)) + sqrt(2x/pi) exp(-x/2) sum_{i<(dof-1)/2} x^i / (2i+1)!!.
    Each term follows from the one before (times x/(2i) or x/(2i+1)), so there is no
    factorial and no bound on dof; exp(-x/2) is split over two factors so that a large
    statistic with as many degrees of freedom does not underflow early.
    """
    half = f"(({x}) / 2.0D)"
    quarter = f"exp(-({x}) / 4.0D)"

    def series(n: str, step: str) -> str:
        return (f"aggregate(sequence(1, greatest({n} - 1, 1)), named_struct('t', {quarter}, 's', IF({n} >= 1, {quarter}, 0.0D)),"
                f" (a, i) -> IF(i > {n} - 1, a, named_struct('t', a.t * ({x}) / ({step}), 's', a.s + a.t * ({x}) / ({step}))), a -> a.s)")

    even = f"{quarter} * {series(f'CAST(({dof}) / 2 AS INT)', '2.0D * i')}"
    odd = (f"{erfc_sql(f'sqrt({half})')} + sqrt(2.0D * ({x}) / {math.pi!r}D) * {quarter}"
           f" * {series(f'CAST((({dof}) - 1) / 2 AS INT)', '2.0D * i + 1')}")
    return f"(CASE WHEN ({x}) <= 0 THEN 1.0D WHEN ({dof}) % 2 = 0 THEN {even} ELSE {odd} END)"


def erfc(x: str) -> Column:
    """erfc of the named column (one SQL expression, parsed once in the JVM)."""
    return F.expr(erfc_sql(f"`{x}`"))


def norm_sf(z: str) -> Column:
    """Upper tail of the standard normal at the named column."""
    return F.expr(norm_sf_sql(f"`{z}`"))


def chi2_sf(x: str, dof: str) -> Column:
    """Upper chi-square tail at the named statistic and dof columns."""
    return F.expr(chi2_sf_sql(f"`{x}`", f"`{dof}`"))


# ---------------------------------------------------------------------------
# Exact Mann-Whitney tail (small samples without ties)
# ---------------------------------------------------------------------------


def _partitions(parts: list[int], size: int) -> list[int]:
    """Ways to write 0 .. size - 1 as a sum of ``parts`` (each any number of times)."""
    ways = [1] + [0] * (size - 1)
    for p in parts:
        for i in range(p, size):
            ways[i] += ways[i - p]
    return ways


def mwu_arrangements(m: int, n: int, k: int) -> int:
    """Arrangements of m and n untied rows with U <= k, exactly, for any n.

    The counts are the coefficients of prod_i (1 - q^(n+i)) / (1 - q^i), i = 1 .. m; a
    further factor 1 / (1 - q) sums them.  The denominator's coefficients are a
    polynomial of degree m on every residue class of lcm(1 .. m), so a far one follows
    from m + 1 near ones by Lagrange's formula; nothing of size m * n is held."""
    from fractions import Fraction
    from itertools import combinations
    m, n = min(m, n), max(m, n)
    cycle = math.lcm(*range(1, m + 1))
    ways = _partitions([1, *range(1, m + 1)], cycle * (m + 1))

    def coefficient(at: int) -> int:
        if at < len(ways):
            return ways[at]
        x, base = divmod(at, cycle)
        total = Fraction(0)
        for j in range(m + 1):
            term = Fraction(ways[base + cycle * j])
            for i in range(m + 1):
                if i != j:
                    term *= Fraction(x - i, j - i)
            total += term
        return int(total)

    return sum((-1) ** r * coefficient(k - sum(c)) for r in range(m + 1)
               for c in combinations(range(n + 1, n + m + 1), r) if k >= sum(c))


def mwu_exact_two_sided(n1: int, n2: int, u: float) -> float:
    """2 * P(U >= u) under the null, clipped to 1 (u = max(U1, U2))."""
    n1, n2, k = int(n1), int(n2), int(round(u))
    total = math.comb(n1 + n2, n1)
    tail = mwu_arrangements(n1, n2, n1 * n2 - k) if k <= n1 * n2 else 0  # U is symmetric
    return min(1.0, (2 * tail) / total)   # exact integer ratio -> float


def mwu_exact_p(n1: Column, n2: Column, u: Column, ties: Column) -> Column:
    """Column form (Arrow-batched pandas UDF over the few per-item result rows); null
    unless there are no ties and a group has at most 8 rows."""

    @F.pandas_udf("double")
    def _p(a: pd.Series, b: pd.Series, c: pd.Series, t: pd.Series) -> pd.Series:
        return pd.Series([mwu_exact_two_sided(x, y, z) if w == 0 and 0 < min(x, y) <= 8 else None
                          for x, y, z, w in zip(a, b, c, t)], dtype="float64")
    return _p(n1.cast("long"), n2.cast("long"), u.cast("double"), ties.cast("double"))
