"""Inferential statistics on Spark: reliability, rank correlations and rank tests.

Every statistic here is a closed form over grouped counts, so the Spark work is
one scan with partial aggregation into a tiny key space (item x rating x group,
a few hundred rows at most) followed by column arithmetic on those few rows.
Ranks are mid-ranks from running counts over the rating order (a window over
at most five rows per item); doubled ranks are integers (2*cum + n + 1).
Nothing row-level reaches the driver; p-values are column expressions
(``functions.norm_sf`` / ``functions.chi2_sf``).

Null ratings are rejected by the loader (as in the reference); the rank tests
work on complete rows (listwise deletion), which equals pairwise deletion when
the loader's checks pass.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trustlens import functions as X
from trustlens import schema as S
from trustlens.operators.ranks import running
from trustlens.session import materialize

RESULT_COLUMNS = ["test", "statistic", "p_value", "effect_size", "significant", "interpretation"]


def _items(df: DataFrame) -> DataFrame:
    return S.likert_items_df(df.sparkSession).select("column", "title", "item_order")


# ---------------------------------------------------------------------------
# Reliability
# ---------------------------------------------------------------------------

def _alpha_parts(key: str, cols: list[str]) -> tuple[list[str], str]:
    """SQL aggregates for one scale over its complete rows, and its alpha.

    alpha = k/(k-1) * (1 - sum_i var_i / var_T); with n complete rows,
    sum_i var_i / var_T = (n*C - sum_i S_i^2) / (n*B - A^2) where S_i = sum x_i,
    C = sum of x_i^2 over items and rows, A = sum T, B = sum T^2 (T = row total).
    All sums are exact BIGINT.
    """
    k = len(cols)
    complete = " AND ".join(f"{c} IS NOT NULL" for c in cols)
    tot = " + ".join(f"CAST({c} AS BIGINT)" for c in cols)
    sq = " + ".join(f"CAST({c} AS BIGINT) * {c}" for c in cols)
    w = lambda e: f"CASE WHEN {complete} THEN {e} END"
    aggs = [f"count({w('1')}) AS {key}_n", f"sum({w(tot)}) AS {key}_a",
            f"sum({w(f'({tot}) * ({tot})')}) AS {key}_b", f"sum({w(sq)}) AS {key}_c"]
    aggs += [f"sum({w(f'CAST({c} AS BIGINT)')}) AS {key}_s{i}" for i, c in enumerate(cols)]
    if k < 2:
        return aggs, "CAST('NaN' AS DOUBLE)"
    d = lambda c: f"CAST({c} AS DOUBLE)"
    ssq = " + ".join(f"{d(f'{key}_s{i}')} * {d(f'{key}_s{i}')}" for i in range(k))
    num = f"({d(f'{key}_n')} * {d(f'{key}_c')} - ({ssq}))"
    den = f"({d(f'{key}_n')} * {d(f'{key}_b')} - {d(f'{key}_a')} * {d(f'{key}_a')})"
    return aggs, f"{k / (k - 1)!r} * (1 - {num} / {den})"


def scale_reliability(df: DataFrame, scales: list[tuple[str, list[str]]] | None = None) -> DataFrame:
    """Cronbach's alpha (4 dp) and label for each scale, all scales in one pass."""
    scales = scales or S.RELIABILITY_SCALES
    cols = sorted({c for _, cs in scales for c in cs if c in df.columns})
    aggs, alphas, meta = [], [], []
    for i, (name, cs) in enumerate(scales):
        cs = [c for c in cs if c in cols]
        a, alpha = _alpha_parts(f"sc{i}", cs)
        aggs += a
        alphas.append(f"{alpha} AS a{i}")
        meta.append((f"a{i}", name, len(cs), i))
    one = df.select(*cols).agg(*[F.expr(e) for e in aggs]).selectExpr(*alphas)
    long = one.unpivot([], [m[0] for m in meta], "key", "alpha")
    names = df.sparkSession.createDataFrame(meta, "key string, scale string, items int, ord int")
    alpha = F.when(F.isnan("alpha"), F.lit(float("nan"))).otherwise(X.rnd(F.col("alpha"), 4))
    return (F.broadcast(names).join(long, "key")
            .select("scale", F.col("items").cast("int").alias("items"),
                    alpha.alias("cronbach_alpha"), X.alpha_label(alpha).alias("reliability"), "ord")
            .orderBy("ord").drop("ord"))


def grouped_reliability(df: DataFrame, group: str, columns: list[str] | None = None) -> DataFrame:
    """Cronbach's alpha (4 dp) and its label of one scale within every value of
    ``group``: one grouped aggregate (partial aggregation, one row per group)."""
    cols = columns or S.SPT_COLUMNS
    aggs, alpha = _alpha_parts("g", cols)
    one = df.groupBy(group).agg(*[F.expr(e) for e in aggs]).selectExpr(group, f"{alpha} AS alpha")
    a = F.when(F.isnan("alpha"), F.lit(float("nan"))).otherwise(X.rnd(F.col("alpha"), 4))
    return one.select(group, F.lit(len(cols)).alias("items"), a.alias("cronbach_alpha"),
                      X.alpha_label(a).alias("reliability")).orderBy(group)


def cronbach_alpha(df: DataFrame, columns: list[str], name: str = "scale") -> DataFrame:
    """One-row table (scale, items, cronbach_alpha, reliability)."""
    return scale_reliability(df, [(name, columns)])


# ---------------------------------------------------------------------------
# Mid-ranks and correlations
# ---------------------------------------------------------------------------

def mid_ranks(counts: DataFrame, part: str = "column", value: str = "rating", n: str = "n") -> DataFrame:
    """Add ``rank2`` = 2 * average rank of each value within ``part``:
    2 * (running count before the value) + n + 1."""
    out = running(counts, value, [n], [part])
    return out.withColumn("rank2", (2 * F.col(f"{n}_before") + F.col(n) + 1).cast("bigint")).drop(f"{n}_before")


def _complete(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in cols]))


def correlation_matrix(df: DataFrame, columns: list[str] | None = None,
                       method: str = "spearman") -> DataFrame:
    """Long-form correlation matrix (item_a, item_b, title_a, title_b, rho 3 dp).

    Spearman replaces each value by its (doubled) mid-rank: ranks per (column, value) are
    written once and joined back column by column.  Spark broadcasts them while their
    written size is below its threshold (codes, flags) and shuffles beyond (continuous
    columns), so that columns may have any number of distinct values.  Then both methods
    are Pearson sums over the rows: one aggregate with n, sum x_i and sum x_i x_j for every
    pair (i <= j).  The generated sums are SQL expressions (parsed once in the JVM).  A
    constant column has no correlation: null.
    """
    cols = [c for c in (columns or S.SPT_COLUMNS) if c in df.columns]
    rows = _complete(df, cols)
    if method == "spearman":
        rows = rows.select(*[F.col(c).cast("double").alias(c) for c in cols])
        counts = rows.unpivot([], cols, "column", "rating").groupBy("column", "rating").agg(F.count(F.lit(1)).alias("n"))
        ranks = materialize(mid_ranks(counts).select("column", "rating", F.col("rank2").cast("double").alias("rank2")), "mid_ranks")
        for i, c in enumerate(cols):
            of = ranks.where(F.col("column") == c).select(F.col("rating").alias(f"_v{i}"), F.col("rank2").alias(f"_r{i}"))
            rows = rows.join(of, F.col(c) == F.col(f"_v{i}"))
        vals = [F.col(f"_r{i}").alias(f"v{i}") for i in range(len(cols))]
    elif method == "pearson":
        vals = [F.col(c).cast("double").alias(f"v{i}") for i, c in enumerate(cols)]
    else:
        raise ValueError(f"unknown method {method}")
    k = len(cols)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    sums = ["count(1) AS n"] + [f"sum(v{i}) AS s{i}" for i in range(k)] + \
        [f"sum(v{i} * v{j}) AS p{i}_{j}" for i, j in pairs]
    one = rows.select(*vals).agg(*[F.expr(e) for e in sums])

    def rho(i, j):
        sxy = f"(n * p{i}_{j} - s{i} * s{j})"
        sxx = f"(n * p{i}_{i} - s{i} * s{i})"
        syy = f"(n * p{j}_{j} - s{j} * s{j})"
        return f"CAST(floor({sxy} / nullif(sqrt({sxx} * {syy}), 0) * 1000 + 0.5) / 1000 AS DOUBLE) AS c{i}_{j}"

    wide = one.selectExpr(*[rho(i, j) for i, j in pairs])
    long = wide.unpivot([], [f"c{i}_{j}" for i, j in pairs], "cell", "rho")
    # pair table: 2 * k * (k - 1) / 2 + k named cells (fixed by the item list)
    spark = df.sparkSession
    cells = [(f"c{i}_{j}", cols[i], cols[j]) for i, j in pairs] + \
        [(f"c{i}_{j}", cols[j], cols[i]) for i, j in pairs if i != j]
    names = spark.createDataFrame(cells, "cell string, item_a string, item_b string")
    items = _items(df)
    ta = items.select(F.col("column").alias("item_a"), F.col("title").alias("title_a"),
                      F.col("item_order").alias("oa"))
    tb = items.select(F.col("column").alias("item_b"), F.col("title").alias("title_b"),
                      F.col("item_order").alias("ob"))
    return (F.broadcast(names).join(long, "cell")
            .join(F.broadcast(ta), "item_a", "left").join(F.broadcast(tb), "item_b", "left")
            .select("item_a", "item_b", F.coalesce("title_a", "item_a").alias("title_a"),
                    F.coalesce("title_b", "item_b").alias("title_b"), "rho", "oa", "ob")
            .orderBy("oa", "ob").drop("oa", "ob"))


# ---------------------------------------------------------------------------
# Rank tests
# ---------------------------------------------------------------------------

def _fmt3(c: Column) -> Column:
    return F.format_string("%.3f", X.rnd(c, 3))


def mann_whitney(df: DataFrame, columns: list[str] | None = None,
                 group: str = "has_experienced_fraud") -> DataFrame:
    """Victims (group = 1) vs others per item: U of the victims' sample,
    two-sided p (normal approximation with tie and continuity correction; the
    exact distribution of U when there are no ties and a group has at most 8
    rows), rank-biserial r = 1 - 2U/(n1 n2), effect = |r|."""
    cols = [c for c in (columns or S.SPT_COLUMNS) if c in df.columns]
    return mann_whitney_of(df.select(F.col(group).alias("g"), *cols).unpivot(["g"], cols, "column", "rating")
                           .groupBy("column", "rating", "g").agg(F.count(F.lit(1)).alias("n")))


def mann_whitney_of(counts: DataFrame) -> DataFrame:
    """The test rows from counts ``n`` by (column, rating, g)."""
    cnt = counts.where(F.col("g").isin(0, 1) & F.col("rating").isNotNull()).groupBy("column", "rating").agg(
        F.sum(F.when(F.col("g") == 1, F.col("n")).otherwise(0)).alias("n1r"), F.sum("n").alias("n"))
    ranked = mid_ranks(cnt)
    t = ranked.groupBy("column").agg(
        F.sum("n1r").alias("n1"), F.sum("n").alias("n"),
        F.sum(F.col("n1r") * F.col("rank2")).alias("r1x2"),
        F.sum(F.col("n").cast("double") ** 3 - F.col("n")).alias("ties"))
    n1 = F.col("n1").cast("double")
    n = F.col("n").cast("double")
    n2 = n - n1
    u1 = F.col("r1x2") / 2.0 - n1 * (n1 + 1) / 2
    u = F.greatest(u1, n1 * n2 - u1)
    mu = n1 * n2 / 2
    sd = F.sqrt(n1 * n2 / 12 * ((n + 1) - F.col("ties") / (n * (n - 1))))
    # all values tied -> sd = 0: z = -inf, p = 1 (as the normal tail gives)
    t = t.withColumn("_z", F.when(sd > 0, (u - mu - 0.5) / sd))
    p_norm = F.when(F.col("_z").isNotNull(), F.least(2 * X.norm_sf("_z"), F.lit(1.0))).otherwise(1.0)
    # no ties and a group of at most 8 rows: exact null distribution of U, on the few
    # result rows
    t = t.withColumn("_p_exact", X.mwu_exact_p(n1, n2, u, F.col("ties")))
    p = F.coalesce(F.col("_p_exact"), p_norm)
    r = F.when(n1 * n2 > 0, 1 - (2 * u1) / (n1 * n2))
    out = F.broadcast(_items(counts))
    res = t.join(out, "column", "left").select(
        F.concat(F.lit("Mann-Whitney U: "), F.coalesce("title", "column")).alias("test"),
        X.rnd(u1, 2).alias("statistic"), X.rnd(p, 4).alias("p_value"),
        X.rnd(F.abs(r), 3).alias("effect_size"), (p < 0.05).alias("significant"),
        F.concat(F.lit("Fraud victims give "),
                 F.when(r < 0, F.lit("higher ratings (less trust)"))
                 .otherwise(F.lit("lower ratings (more trust)")),
                 F.lit(" (r="), _fmt3(r), F.lit(", "),
                 F.when(p < 0.05, "significant").otherwise("not significant"),
                 F.lit(")")).alias("interpretation"),
        F.coalesce("item_order", F.lit(99)).alias("_o"))
    return res.orderBy("_o").drop("_o")


def chi_square(df: DataFrame, segments: list[str] | None = None,
               target: str = "has_experienced_fraud") -> DataFrame:
    """Fraud flag vs each segment: chi2 (Yates correction when dof = 1), p,
    Cramer's V = sqrt(chi2 / (n (min(r, c) - 1)))."""
    segs = [c for c in (segments or S.CHI_SQUARE_SEGMENTS) if c in df.columns]
    long = df.select(F.col(target).alias("y"), *[F.col(c).cast("string").alias(c) for c in segs]).unpivot(["y"], segs, "segment", "value")
    return chi_square_of(long.groupBy("segment", "value", "y").agg(F.count(F.lit(1)).alias("n")), segs)


def chi_square_of(counts: DataFrame, segs: list[str]) -> DataFrame:
    """The test rows from counts ``n`` by (segment, value, y)."""
    # contingency cells, one row per (segment, value) with both target levels
    cells = (counts.where(F.col("y").isNotNull() & F.col("value").isNotNull()).groupBy("segment", "value")
             .agg(F.sum(F.when(F.col("y") == 0, F.col("n")).otherwise(0)).alias("o0"),
                  F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).alias("o1")))
    ws = Window.partitionBy("segment")
    c = (cells.withColumn("row", F.col("o0") + F.col("o1"))
         .withColumn("c0", F.sum("o0").over(ws)).withColumn("c1", F.sum("o1").over(ws))
         .withColumn("n", F.sum("row").over(ws))
         .withColumn("r", F.count(F.lit(1)).over(ws))
         .withColumn("k", (F.col("c0") > 0).cast("int") + (F.col("c1") > 0).cast("int")))
    dof = (F.col("r") - 1) * (F.col("k") - 1)
    n = F.col("n").cast("double")

    def contrib(o: str, col_total: str) -> Column:
        e = F.col("row") * F.col(col_total).cast("double") / n
        diff = F.col(o) - e
        adj = F.when(dof == 1, F.abs(diff) - F.least(F.lit(0.5), F.abs(diff))).otherwise(F.abs(diff))
        return F.when(e > 0, adj * adj / e).otherwise(0.0)

    cc = c.withColumn("x", contrib("o0", "c0") + contrib("o1", "c1")).withColumn("dof", dof)
    t = cc.groupBy("segment").agg(F.sum("x").alias("chi2"), F.first("dof").alias("dof"),
                                  F.first("n").alias("n"), F.first("r").alias("r"),
                                  F.first("k").alias("k"))
    chi2 = F.col("chi2")
    p = F.when(F.col("dof") > 0, X.chi2_sf("chi2", "dof")).otherwise(1.0)
    v = F.sqrt(chi2 / (F.col("n") * (F.least(F.col("r"), F.col("k")) - 1)))
    order = F.create_map(*[x for i, s in enumerate(segs) for x in (F.lit(s), F.lit(i))])
    return (t.select(
        F.concat(F.lit("Chi-square: Fraud vs "), "segment").alias("test"),
        X.rnd(chi2, 3).alias("statistic"), X.rnd(p, 4).alias("p_value"),
        X.rnd(v, 3).alias("effect_size"), (p < 0.05).alias("significant"),
        F.concat(F.lit("Fraud incidence "),
                 F.when(p < 0.05, "differs").otherwise("does not differ"),
                 F.lit(" significantly by "), "segment",
                 F.lit(" (Cramér V="), _fmt3(v), F.lit(")")).alias("interpretation"),
        order[F.col("segment")].alias("_o"))
        .orderBy("_o").drop("_o"))


def kruskal(df: DataFrame, segment: str = "income_bracket",
            value: str = "q_trust_platform") -> DataFrame:
    """Kruskal-Wallis H of ``value`` across ``segment`` groups (tie-corrected),
    p from chi-square with k-1 dof, eta^2 = (H - k + 1)/(n - k)."""
    # one scan: every row counts for n_all, rows with both values for the test
    return kruskal_of(df.groupBy(F.col(segment).alias("grp"), F.col(value).alias("rating")).agg(F.count(F.lit(1)).alias("ng")), segment)


def kruskal_of(cells: DataFrame, segment: str) -> DataFrame:
    """The test row from counts ``ng`` by (grp, rating)."""
    both = F.col("grp").isNotNull() & F.col("rating").isNotNull()
    per_rating = mid_ranks(cells.where(both).groupBy("rating").agg(F.sum("ng").alias("n"), F.collect_list(F.struct("grp", "ng")).alias("of"))
                           .withColumn("part", F.lit(0)), part="part")
    ranked = per_rating.select("rank2", "n", F.inline("of"))
    per_group = ranked.groupBy("grp").agg(
        F.sum("ng").alias("ng"), F.sum(F.col("ng") * F.col("rank2")).alias("rx2"),
        # a value's tie term, spread over its groups by their share of its rows
        F.sum((F.col("n").cast("double") ** 2 - 1) * F.col("ng")).alias("ties"))
    t = per_group.agg(F.sum((F.col("rx2") / 2.0) ** 2 / F.col("ng")).alias("srn"), F.count(F.lit(1)).alias("k"),
                      F.sum("ng").cast("double").alias("n"), F.sum("ties").alias("tsum"))
    t = t.withColumn("n_all", cells.agg(F.sum("ng").cast("double")).scalar())
    n = F.col("n")
    h0 = 12.0 / (n * (n + 1)) * F.col("srn") - 3 * (n + 1)
    t = t.withColumn("h", h0 / (1 - F.col("tsum") / (n * n * n - n))).withColumn("dof", F.col("k") - 1)
    h = F.col("h")
    k = F.col("k")
    p = X.chi2_sf("h", "dof")
    eta2 = (h - k + 1) / (F.col("n_all") - k)
    return t.where(k >= 2).select(
        F.lit(f"Kruskal-Wallis: Trust by {segment}").alias("test"),
        X.rnd(h, 3).alias("statistic"), X.rnd(p, 4).alias("p_value"),
        X.rnd(F.greatest(eta2, F.lit(0.0)), 3).alias("effect_size"),
        (p < 0.05).alias("significant"),
        F.concat(F.lit("Platform trust "), F.when(p < 0.05, "varies").otherwise("does not vary"),
                 F.lit(f" significantly by {segment} (η²="), _fmt3(eta2), F.lit(")"))
        .alias("interpretation"))


def report_cube(df: DataFrame, group: str = S.FRAUD_TARGET, value: str = S.TRUST_TARGET,
                tests: tuple[str, ...] = ("income_bracket", "region")) -> DataFrame:
    """(family, name, level, other, n): the counts that all tests of the report need, from
    one scan.  Every row stands in one cell of each test, and cells are counted before the
    shuffle: a few hundred rows."""
    cell = lambda family, name, level, other: F.struct(
        F.lit(family).alias("family"), F.lit(name).alias("name"), F.col(level).cast("string").alias("level"), F.col(other).cast("int").alias("other"))
    cells = [cell("ratings", c, c, group) for c in S.SPT_COLUMNS if c in df.columns]
    cells += [cell("segments", c, c, group) for c in S.CHI_SQUARE_SEGMENTS if c in df.columns]
    cells += [cell("trust", c, c, value) for c in tests]
    return df.select(F.explode(F.array(*cells)).alias("c")).groupBy("c.family", "c.name", "c.level", "c.other").agg(F.count(F.lit(1)).alias("n"))


def stat_report(df: DataFrame) -> DataFrame:
    """All test rows on the TestResult schema, with their family: one scan of ``df`` counts
    the cells of all tests, which is written and read by each."""
    cube = materialize(report_cube(df), "report_cube")
    part = lambda family: cube.where(F.col("family") == family)
    ratings = part("ratings").select(F.col("name").alias("column"), F.col("level").cast("double").alias("rating"), F.col("other").alias("g"), "n")
    segments = part("segments").select(F.col("name").alias("segment"), F.col("level").alias("value"), F.col("other").alias("y"), "n")
    trust = lambda c: kruskal_of(part("trust").where(F.col("name") == c).select(
        F.col("level").alias("grp"), F.col("other").alias("rating"), F.col("n").alias("ng")), c)
    parts = [mann_whitney_of(ratings).withColumn("family", F.lit("fraud_vs_trust")),
             chi_square_of(segments, [c for c in S.CHI_SQUARE_SEGMENTS if c in df.columns]).withColumn("family", F.lit("fraud_vs_demographics")),
             trust("income_bracket").withColumn("family", F.lit("trust_by_income")),
             trust("region").withColumn("family", F.lit("trust_by_region"))]
    return reduce(lambda a, b: a.unionByName(b), parts).select("family", *RESULT_COLUMNS)
