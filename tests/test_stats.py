"""Statistics on hand-made frames and tail functions against known values."""
import math

import pytest
from pyspark.sql import functions as F

from trustlens import functions as X
from trustlens.operators import stats as ST


@pytest.mark.parametrize("x", [-2.5, -0.3, 0.0, 0.2, 1.0, 1.7, 3.0])
def test_erfc(spark, x):
    v = spark.createDataFrame([(x,)], "x double").select(X.erfc("x").alias("v")).first()["v"]
    assert v == pytest.approx(math.erfc(x), rel=2e-7, abs=1e-9)


@pytest.mark.parametrize("x,dof", [(3.841459, 1), (5.991465, 2), (7.814728, 3), (9.487729, 4),
                                   (11.0705, 5), (12.5916, 6), (42.5570, 29), (55.7585, 40), (124.3421, 100), (233.9943, 200)])
def test_chi2_critical_values(spark, x, dof):
    df = spark.createDataFrame([(x, dof)], "x double, d int")
    v = df.select(X.chi2_sf("x", "d").alias("v")).first()["v"]
    assert v == pytest.approx(0.05, abs=2e-6)


def test_alpha_identical_items_is_one(spark):
    df = spark.createDataFrame([(i % 5 + 1, i % 5 + 1) for i in range(20)], "a int, b int")
    r = ST.cronbach_alpha(df, ["a", "b"]).first()
    assert r["cronbach_alpha"] == 1.0 and r["reliability"] == "Excellent"


def test_alpha_single_item_is_nan(spark):
    df = spark.createDataFrame([(i % 5 + 1,) for i in range(20)], "a int")
    r = ST.cronbach_alpha(df, ["a"]).first()
    assert math.isnan(r["cronbach_alpha"]) and r["reliability"] == "N/A"


def _mw_frame(spark, victims, others):
    rows = [(i, 1, v) for i, v in enumerate(victims)] + \
        [(100 + i, 0, v) for i, v in enumerate(others)]
    return spark.createDataFrame(rows, "respondent_id long, has_experienced_fraud int, q int")


def test_mann_whitney_disjoint_groups(spark):
    df = _mw_frame(spark, [4, 5, 5, 4, 5] * 4, [1, 2, 1, 2, 1] * 4)
    r = ST.mann_whitney(df, ["q"]).first()
    assert r["effect_size"] == 1.0
    assert r["statistic"] == 400.0  # U of victims = n1 * n2 when all rank higher
    assert r["significant"]


def test_mann_whitney_all_tied(spark):
    df = _mw_frame(spark, [3] * 10, [3] * 12)
    r = ST.mann_whitney(df, ["q"]).first()
    assert r["statistic"] == 60.0 and r["effect_size"] == 0.0


def test_mann_whitney_matches_normal_approximation(spark):
    victims, others = [1, 2, 2, 3, 4, 5, 5, 5, 3, 4], [1, 1, 2, 2, 3, 3, 2, 1, 4, 2, 1]
    r = ST.mann_whitney(_mw_frame(spark, victims, others), ["q"]).first()
    allv = sorted(victims + others)
    rank = {v: (allv.index(v) + 1 + len(allv) - allv[::-1].index(v)) / 2 for v in set(allv)}
    n1, n2, n = len(victims), len(others), len(allv)
    u1 = sum(rank[v] for v in victims) - n1 * (n1 + 1) / 2
    ties = sum(allv.count(v) ** 3 - allv.count(v) for v in set(allv))
    sd = math.sqrt(n1 * n2 / 12 * ((n + 1) - ties / (n * (n - 1))))
    z = (max(u1, n1 * n2 - u1) - n1 * n2 / 2 - 0.5) / sd
    p = min(1.0, math.erfc(z / math.sqrt(2)))
    assert r["statistic"] == round(u1, 2)
    assert r["p_value"] == pytest.approx(p, abs=1e-4)


def test_chi_square_two_by_two_with_continuity(spark):
    # 2x2: rows a/b, fraud 0/1 counts (10, 20), (30, 15)
    rows = [("a", 0)] * 10 + [("a", 1)] * 20 + [("b", 0)] * 30 + [("b", 1)] * 15
    df = spark.createDataFrame(rows, "grp string, has_experienced_fraud int")
    r = ST.chi_square(df, ["grp"]).first()
    obs = [[10, 20], [30, 15]]
    n = 75
    rt, ct = [30, 45], [40, 35]
    chi2 = 0.0
    for i in range(2):
        for j in range(2):
            e = rt[i] * ct[j] / n
            d = max(abs(obs[i][j] - e) - 0.5, 0)
            chi2 += d * d / e
    assert r["statistic"] == round(chi2, 3)
    assert r["p_value"] == pytest.approx(math.erfc(math.sqrt(chi2 / 2)), abs=1e-4)
    assert r["effect_size"] == pytest.approx(math.sqrt(chi2 / n), abs=1e-3)


def test_kruskal_against_closed_form(spark):
    data = {"x": [1, 2, 2, 3, 5], "y": [3, 4, 4, 5, 5, 5], "z": [1, 1, 2, 3]}
    rows = [(g, v) for g, vs in data.items() for v in vs]
    df = spark.createDataFrame(rows, "seg string, q_trust_platform int")
    r = ST.kruskal(df, "seg").first()
    allv = sorted(v for vs in data.values() for v in vs)
    n = len(allv)
    rank = {v: (allv.index(v) + 1 + n - allv[::-1].index(v)) / 2 for v in set(allv)}
    h = 12 / (n * (n + 1)) * sum(sum(rank[v] for v in vs) ** 2 / len(vs) for vs in data.values()) \
        - 3 * (n + 1)
    h /= 1 - sum(allv.count(v) ** 3 - allv.count(v) for v in set(allv)) / (n ** 3 - n)
    assert r["statistic"] == round(h, 3)
    assert r["p_value"] == pytest.approx(math.exp(-h / 2), abs=1e-4)  # dof 2


def test_spearman_equals_pearson_of_ranks(spark):
    rows = [(i, (i * 7) % 5 + 1, (i * 3) % 5 + 1) for i in range(30)]
    df = spark.createDataFrame(rows, "respondent_id long, a int, b int")
    got = {(r["item_a"], r["item_b"]): r["rho"] for r in ST.correlation_matrix(df, ["a", "b"]).collect()}
    a = [r[1] for r in rows]
    b = [r[2] for r in rows]

    def ranks(v):
        s = sorted(v)
        return [(s.index(x) + 1 + len(s) - s[::-1].index(x)) / 2 for x in v]
    ra, rb = ranks(a), ranks(b)
    ma, mb = sum(ra) / 30, sum(rb) / 30
    cov = sum((x - ma) * (y - mb) for x, y in zip(ra, rb))
    rho = cov / math.sqrt(sum((x - ma) ** 2 for x in ra) * sum((y - mb) ** 2 for y in rb))
    assert got[("a", "b")] == got[("b", "a")] == pytest.approx(round(rho, 3), abs=1e-9)
    assert got[("a", "a")] == 1.0


def test_grouped_reliability_matches_per_group(spark):
    rows = [("g1" if i % 2 else "g2", i % 5 + 1, (i * 3) % 5 + 1, (i * 3 + i % 2) % 5 + 1) for i in range(60)]
    df = spark.createDataFrame(rows, "grp string, a int, b int, c int")
    got = {r["grp"]: r["cronbach_alpha"] for r in ST.grouped_reliability(df, "grp", ["a", "b", "c"]).collect()}
    for g in ("g1", "g2"):
        sub = df.where(F.col("grp") == g)
        assert got[g] == ST.cronbach_alpha(sub, ["a", "b", "c"]).first()["cronbach_alpha"]


def test_exact_distribution_small_no_ties(spark):
    from itertools import combinations
    victims, others = [1.5, 3.2, 4.8, 6.1], [2.2, 0.7, 5.5, 7.3, 8.1, 0.2, 9.4]
    df = spark.createDataFrame([(i, 1, v) for i, v in enumerate(victims)]
                               + [(100 + i, 0, v) for i, v in enumerate(others)],
                               "respondent_id long, has_experienced_fraud int, q double")
    r = ST.mann_whitney(df, ["q"]).first()
    allv = victims + others
    n1, n2 = len(victims), len(others)

    def u_of(group):
        return sum(1 for a in group for b in allv if b not in group and a > b)
    u1 = u_of(victims)
    u = max(u1, n1 * n2 - u1)
    dist = [u_of(set(c)) for c in combinations(allv, n1)]
    p = min(1.0, 2 * sum(1 for x in dist if x >= u) / len(dist))
    assert r["statistic"] == u1
    assert r["p_value"] == round(p, 4)


def test_exact_arrangements_against_enumeration():
    from itertools import combinations
    from math import comb

    from trustlens.functions import mwu_arrangements
    for m, n in [(1, 1), (2, 3), (3, 5), (4, 8), (5, 40)]:
        sums = [sum(c) - m * (m + 1) // 2 for c in combinations(range(1, m + n + 1), m)] if n < 9 else None
        if sums:
            assert [mwu_arrangements(m, n, k) for k in range(m * n + 1)] == [sum(s <= k for s in sums) for k in range(m * n + 1)]
        assert mwu_arrangements(m, n, m * n) == comb(m + n, m)
    # far beyond what a table of all counts could hold; U is symmetric
    m, n = 8, 10 ** 9
    assert mwu_arrangements(m, n, m * n // 2) + mwu_arrangements(m, n, m * n // 2 - 1) == comb(m + n, m)


def test_ranks_of_many_distinct_values(spark):
    """More than 100,000 distinct values, in parts, with nulls and ties."""
    from trustlens.operators.ranks import quantiles, running
    n = 120_000
    df = spark.range(n).selectExpr("id % 2 AS part", "CAST((id * 7919) % 120011 AS DOUBLE) AS v", "1 + id % 3 AS n")
    got = running(df, "v", ["n"], ["part"]).toPandas().sort_values(["part", "v"])
    assert len(got) == n
    assert (got.groupby("part").n.cumsum() - got.n == got.n_before).all()
    med = {r["column"]: r["value"] for r in quantiles(df.select("v", (-F.col("v")).alias("w")), ["v", "w"]).collect()}
    exact = df.toPandas().v.median()
    assert med == {"v": exact, "w": -exact}


def test_spearman_of_wide_codes(spark):
    rows = [(i % 16, (i * 7) % 16, 15 - i % 16) for i in range(160)]
    df = spark.createDataFrame(rows, "q1 int, q2 int, q3 int")
    got = {(r["item_a"], r["item_b"]): r["rho"] for r in ST.correlation_matrix(df, ["q1", "q2", "q3"]).collect()}
    want = df.toPandas().rank().corr()
    assert all(abs(v - want.loc[a, b]) < 6e-4 for (a, b), v in got.items()) and got["q1", "q3"] == -1.0


def test_spearman_of_continuous_columns(spark):
    df = spark.range(5000).select((F.col("id") * 48271 % 2147483647 / 7.0).alias("a"), (F.col("id") * 69623 % 1009).alias("b"),
                                  F.when(F.col("id") % 11 > 0, F.col("id") % 3).alias("c"))
    out = ST.correlation_matrix(df.withColumn("d", F.col("a") + F.col("b") * 1e6), ["a", "b", "c", "d"])
    assert "collect_list" not in out._jdf.queryExecution().toString()
    want = df.toPandas().assign(d=lambda p: p.a + p.b * 1e6).dropna().rank().corr()
    for r in out.collect():
        assert r["rho"] == pytest.approx(want.loc[r["item_a"], r["item_b"]], abs=6e-4)


def test_report_from_the_cube_equals_the_single_tests(spark, resp_small):
    got = {r["test"]: r for r in ST.stat_report(resp_small).collect()}
    single = [*ST.mann_whitney(resp_small).collect(), *ST.chi_square(resp_small).collect(),
              *ST.kruskal(resp_small, "income_bracket").collect(), *ST.kruskal(resp_small, "region").collect()]
    assert len(got) == len(single) and all(all(got[r["test"]][c] == r[c] for c in ST.RESULT_COLUMNS) for r in single)


def test_constant_column_has_no_correlation(spark):
    df = spark.createDataFrame([(i, 7) for i in range(9)], "a int, b int")
    for method in ("spearman", "pearson"):
        got = {(r["item_a"], r["item_b"]): r["rho"] for r in ST.correlation_matrix(df, ["a", "b"], method).collect()}
        assert got == {("a", "a"): 1.0, ("a", "b"): None, ("b", "a"): None, ("b", "b"): None}
