"""Descriptive tables: frequencies, Likert summaries, SPT index, fraud profile,
histograms.

Shared base: ``likert_counts`` -- one scan, ``unpivot`` of the Likert items,
partial aggregation to (item, rating, n), at most 22 x 5 groups.  Means,
standard deviations and percentages are closed-form over those integer counts
(exact BIGINT sums, one division), so results do not depend on partition order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trustlens import functions as X
from trustlens import schema as S


def _spark(df: DataFrame) -> SparkSession:
    return df.sparkSession


def likert_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, rating, n) over the given Likert items; null ratings kept."""
    columns = columns or S.LIKERT_COLUMNS
    long = df.select(*columns).unpivot([], columns, "column", "rating")
    return long.groupBy("column", "rating").agg(F.count(F.lit(1)).alias("n"))


def join_titles(df: DataFrame, on: str = "column") -> DataFrame:
    """item -> title (default: the item name) and item order; broadcast of the
    22-row fixed item table."""
    items = F.broadcast(S.likert_items_df(_spark(df)).select(
        F.col("column").alias(on), "title", "item_order"))
    return (df.join(items, on, "left")
            .withColumn("title", F.coalesce("title", F.col(on)))
            .withColumn("item_order", F.coalesce("item_order", F.lit(1 << 20))))


def likert_summary(df: DataFrame, columns: list[str] | None = None, legacy: bool = False,
                   counts: DataFrame | None = None) -> DataFrame:
    """Per item: mean (3 dp), sample std (3 dp), % rating 1, % 1-2, % 3, % 4-5.
    ``legacy``: the earlier form (mean 2 dp, no std column).  ``counts``: a
    shared ``likert_counts`` table (several summaries then reuse one scan)."""
    columns = columns or S.LIKERT_COLUMNS
    c = (likert_counts(df, columns) if counts is None
         else counts.where(F.col("column").isin(columns)))
    r = F.col("rating").cast("bigint")
    valid = F.col("rating").isNotNull()
    agg = c.groupBy("column").agg(
        F.sum("n").alias("total"),
        F.sum(F.when(valid, F.col("n"))).alias("k"),
        F.sum(F.when(valid, r * F.col("n"))).alias("s1"),
        F.sum(F.when(valid, r * r * F.col("n"))).alias("s2"),
        F.sum(F.when(r == 1, F.col("n")).otherwise(0)).alias("n1"),
        F.sum(F.when(r.isin(1, 2), F.col("n")).otherwise(0)).alias("npos"),
        F.sum(F.when(r == 3, F.col("n")).otherwise(0)).alias("nneu"),
        F.sum(F.when(r.isin(4, 5), F.col("n")).otherwise(0)).alias("nneg"))
    k = F.col("k").cast("double")
    s1 = F.col("s1").cast("double")
    var = (k * F.col("s2").cast("double") - s1 * s1) / (k * (k - 1))
    stats = [X.rnd(F.col("s1") / F.col("k"), 2 if legacy else 3).alias("mean_score")]
    if not legacy:
        stats.append(X.rnd(F.sqrt(var), 3).alias("std"))
    out = join_titles(agg).select(
        "column", F.col("title").alias("question"), *stats,
        X.pct(F.col("n1"), F.col("total")).alias("strongly_agree_pct"),
        X.pct(F.col("npos"), F.col("total")).alias("positive_pct"),
        X.pct(F.col("nneu"), F.col("total")).alias("neutral_pct"),
        X.pct(F.col("nneg"), F.col("total")).alias("negative_pct"),
        "item_order")
    return out.orderBy("item_order").drop("item_order")


def spt_summary(df: DataFrame) -> DataFrame:
    return likert_summary(df, S.SPT_COLUMNS)


def weakest_dimension(df: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """SPT item with the lowest positive %, first in item order on a tie."""
    s = join_titles(likert_summary(df, S.SPT_COLUMNS, counts=counts))
    best = s.agg(F.min_by(F.struct("question", "column", "positive_pct", "negative_pct", "mean_score"),
                          F.struct("positive_pct", "item_order")).alias("w"))
    return best.select(F.col("w.question").alias("dimension"), "w.column", "w.positive_pct",
                       "w.negative_pct", "w.mean_score")


def complete_domain(counts: DataFrame, domain: list[int] | None = None) -> DataFrame:
    """Left join (item, rating, n) to the full rating domain, missing -> 0."""
    domain = domain or [1, 2, 3, 4, 5]
    items = counts.select("column").distinct()
    grid = items.select("column", F.explode(F.array(*[F.lit(d) for d in domain])).alias("rating"))
    return (grid.join(counts.where(F.col("rating").isNotNull()), ["column", "rating"], "left")
            .withColumn("n", F.coalesce("n", F.lit(0)).cast("bigint")))


def likert_distribution(df: DataFrame, columns: list[str] | None = None,
                        pct_name: str = "pct") -> DataFrame:
    """Count and % (of all rows) per rating 1-5, zero-filled, per item
    (legacy form: share named ``percentage``)."""
    columns = columns or S.LIKERT_COLUMNS
    counts = complete_domain(likert_counts(df, columns))
    total = df.select(F.count(F.lit(1))).scalar()
    return (counts.select("column", X.likert_label(F.col("rating")).alias("rating"),
                          F.col("rating").alias("rating_code"), F.col("n").alias("count"),
                          X.pct(F.col("n"), total).alias(pct_name))
            .orderBy("column", "rating_code"))


def likert_diverging(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """% of answers per label, one column per label, per item (chart data)."""
    columns = columns or S.SPT_COLUMNS
    c = likert_counts(df, columns).where(F.col("rating").isNotNull())
    names = {1: "strongly_agree", 2: "agree", 3: "neutral", 4: "disagree", 5: "strongly_disagree"}
    wide = c.groupBy("column").pivot("rating", list(names)).agg(F.sum("n"))
    tot = sum((F.coalesce(F.col(str(k)), F.lit(0)) for k in names), F.lit(0))
    out = join_titles(wide).select(
        "column", F.col("title").alias("question"),
        *[X.pct(F.coalesce(F.col(str(k)), F.lit(0)), tot).alias(f"pct_{v}") for k, v in names.items()],
        "item_order")
    return out.orderBy("item_order").drop("item_order")


def spt_index_stats(df: DataFrame, legacy: bool = False) -> DataFrame:
    """Mean, median, sample std (3 dp) of the SPT index, % index <= 2, % >= 4.

    The index is (sum of items) / (non-null items).  Everything comes from one histogram
    of its values: survey codes give a few hundred values at most, whatever the rows.
    """
    total = sum((F.coalesce(F.col(c), F.lit(0)) for c in S.SPT_COLUMNS), F.lit(0))
    cnt = sum((F.col(c).isNotNull().cast("int") for c in S.SPT_COLUMNS), F.lit(0))
    h = (df.select(total.alias("s"), cnt.alias("k")).where(F.col("k") > 0)
         .groupBy("s", "k").agg(F.count(F.lit(1)).alias("n"))
         .withColumn("v", F.col("s") / F.col("k")))
    st = h.agg(F.sum("n").alias("N"),
               F.sum(F.col("v") * F.col("n")).alias("sv"),
               F.sum(F.col("v") * F.col("v") * F.col("n")).alias("svv"),
               F.sum(F.when(F.col("v") <= 2.0, F.col("n")).otherwise(0)).alias("npos"),
               F.sum(F.when(F.col("v") >= 4.0, F.col("n")).otherwise(0)).alias("nneg"),
               F.sort_array(F.collect_list(F.struct("v", "n"))).alias("hist"))

    def at(rank):
        """The value that holds the row of this rank (from 1), by a running count."""
        return F.expr(f"aggregate(hist, named_struct('seen', 0L, 'v', CAST(NULL AS DOUBLE)),"
                      f" (a, e) -> named_struct('seen', a.seen + e.n, 'v', IF(a.seen < {rank}, e.v, a.v)), a -> a.v)")

    lo, hi = at("floor((N - 1) / 2) + 1"), at("floor(N / 2) + 1")
    Nd = F.col("N").cast("double")
    var = (F.col("svv") - F.col("sv") * F.col("sv") / Nd) / (Nd - 1)
    d = 2 if legacy else 3  # legacy form: 2 dp and no pct_negative
    cols = [X.rnd(F.col("sv") / Nd, d).alias("mean"), X.rnd((lo + hi) / 2, d).alias("median"),
            X.rnd(F.sqrt(F.greatest(var, F.lit(0.0))), d).alias("std"),
            X.pct(F.col("npos"), F.col("N")).alias("pct_positive")]
    if not legacy:
        cols.append(X.pct(F.col("nneg"), F.col("N")).alias("pct_negative"))
    return st.select(*cols)


def frequency_table(df: DataFrame, column: str, pct_name: str = "pct") -> DataFrame:
    """Value counts incl. null (as 'nan'), category text, % of rows (1 dp).
    The legacy form names the share ``percentage``."""
    total = df.select(F.count(F.lit(1))).scalar()
    return (df.groupBy(F.col(column).alias("_v")).agg(F.count(F.lit(1)).alias("count"))
            .select(F.coalesce(F.col("_v").cast("string"), F.lit("nan")).alias("category"),
                    "count", X.pct(F.col("count"), total).alias(pct_name), "_v")
            .orderBy(F.col("_v").asc_nulls_last()).drop("_v"))


def demographic_summary(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """frequency_table for every demographic column, one scan (unpivot as text)."""
    columns = columns or S.DEMOGRAPHIC_COLUMNS
    total = df.select(F.count(F.lit(1))).scalar()
    long = df.select(*[F.col(c).cast("string").alias(c) for c in columns]).unpivot(
        [], columns, "column", "value")
    return (long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("count"))
            .select("column", F.coalesce("value", F.lit("nan")).alias("category"), "count",
                    X.pct(F.col("count"), total).alias("pct"),
                    F.expr("try_cast(value AS INT)").alias("_num"), "value")
            .orderBy("column", "_num", "value").drop("_num", "value"))


def demographic_pct(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Counts per value sorted by count descending, with % (chart data)."""
    t = demographic_summary(df, columns)
    return t.orderBy("column", F.desc("count"), "category")


def service_adoption(df: DataFrame) -> DataFrame:
    """Adopters and % per channel (adoption label), % descending."""
    from trustlens.operators.risk import join_channel_weights
    j = join_channel_weights(df)
    return (j.select(F.col("adoption_label").alias("channel"),
                     F.col("adopters").cast("bigint").alias("adopters"),
                     X.pct(F.col("adopters"), F.col("total")).alias("adoption_pct"), "ord")
            .orderBy(F.desc("adoption_pct"), "ord").drop("ord"))


# Service labels of the legacy (four-service) table.
LEGACY_SERVICE_LABELS = [("uses_mobile_banking", "Mobile Banking App"),
                         ("uses_internet_banking", "Internet Banking"),
                         ("uses_atm", "ATM Services"),
                         ("uses_upi", "Digital Payment Apps (UPI)")]


def service_adoption_legacy(df: DataFrame) -> DataFrame:
    """Legacy form: four services, (service, count, percentage), in column order."""
    cols = [c for c, _ in LEGACY_SERVICE_LABELS]
    wide = df.agg(*[F.sum(c).cast("bigint").alias(c) for c in cols], F.count(F.lit(1)).alias("n"))
    rows = F.array(*[F.struct(F.lit(label).alias("service"), F.col(c).alias("count"),
                              X.pct(F.col(c), F.col("n")).alias("percentage"), F.lit(i).alias("o"))
                     for i, (c, label) in enumerate(LEGACY_SERVICE_LABELS)])
    return wide.select(F.explode(rows).alias("r")).select("r.*").orderBy("o").drop("o")


def top_channel(df: DataFrame) -> DataFrame:
    return service_adoption(df).limit(1)


def _metric(name: str, value, pct, order: int):
    return F.struct(F.lit(name).alias("metric"), value.cast("bigint").alias("value"),
                    pct.cast("double").alias("pct"), F.lit(order).alias("ord"))


def fraud_profile(df: DataFrame) -> DataFrame:
    """Total, victims, reported, resolved; the last two as % of victims (0 if none)."""
    a = df.agg(F.count(F.lit(1)).alias("n"),
               F.sum(F.when(F.col("has_experienced_fraud") == 1, 1).otherwise(0)).alias("nf"),
               F.sum(F.when(F.col("has_experienced_fraud") == 1, F.col("reported_to_bank"))
                     .otherwise(0)).alias("rep"),
               F.sum(F.when(F.col("has_experienced_fraud") == 1, F.col("fraud_resolved"))
                     .otherwise(0)).alias("res"))
    of_victims = lambda c: F.when(F.col("nf") > 0, X.pct(F.col(c), F.col("nf"))).otherwise(0.0)
    rows = F.array(
        _metric("Total respondents", F.col("n"), F.lit(100.0), 0),
        _metric("Experienced fraud", F.col("nf"), X.pct(F.col("nf"), F.col("n")), 1),
        _metric("Reported to bank", F.col("rep"), of_victims("rep"), 2),
        _metric("Fraud resolved", F.col("res"), of_victims("res"), 3))
    return (a.select(F.explode(rows).alias("r")).select("r.*").orderBy("ord").drop("ord"))


def fraud_type_breakdown(df: DataFrame) -> DataFrame:
    """Victims by fraud type, count descending, % of victims."""
    v = df.where(F.col("has_experienced_fraud") == 1)
    nf = v.select(F.count(F.lit(1))).scalar()
    return (v.groupBy("fraud_type").agg(F.count(F.lit(1)).alias("count"))
            .select("fraud_type", "count", X.pct(F.col("count"), nf).alias("pct_of_fraud_victims"))
            .orderBy(F.desc("count"), "fraud_type"))


def fraud_by_region(df: DataFrame) -> DataFrame:
    return (df.groupBy("region")
            .agg(F.sum("has_experienced_fraud").alias("_f"), F.count(F.lit(1)).alias("n"))
            .select("region", X.rnd(F.col("_f") / F.col("n") * 100, 1).alias("fraud_pct"), "n")
            .orderBy(F.desc("fraud_pct"), "region"))


def posture_by_region(df: DataFrame) -> DataFrame:
    return (df.groupBy("region")
            .agg(F.sum(X.posture_expr()).alias("_s"), F.count(F.lit(1)).alias("n"))
            .select("region", X.rnd(F.col("_s") / F.col("n"), 1).alias("mean_posture"), "n")
            .orderBy(F.desc("mean_posture"), "region"))


def satisfaction_by_usage(df: DataFrame) -> DataFrame:
    """Mean overall satisfaction per usage frequency, in Daily..Rarely order."""
    order = F.create_map(*[x for i, v in enumerate(S.USAGE_ORDER) for x in (F.lit(v), F.lit(i))])
    return (df.groupBy("usage_frequency")
            .agg(F.sum("q_overall_satisfaction").alias("_s"),
                 F.count("q_overall_satisfaction").alias("n"))
            .select("usage_frequency", X.rnd(F.col("_s") / F.col("n"), 3).alias("mean_satisfaction"),
                    "n", F.coalesce(order[F.col("usage_frequency")], F.lit(99)).alias("_o"))
            .orderBy("_o", "usage_frequency").drop("_o"))


def histograms(df: DataFrame, bins: dict[str, int]) -> DataFrame:
    """Equal-width bins between min and max (last bin closed), zero-filled, for
    several numeric columns at once: (feature, bin, bin_lo, bin_hi, count).

    One aggregate gives every column's min and max; one scan of the long form
    (feature, value) joined to those few rows (broadcast, one per feature)
    gives the bin counts; the full bin range per feature is a ``sequence``
    exploded from the same few rows and left-joined to the counts.
    """
    names = list(bins)
    mm = df.agg(*[F.min(F.col(c).cast("double")).alias(f"mn{i}") for i, c in enumerate(names)],
                *[F.max(F.col(c).cast("double")).alias(f"mx{i}") for i, c in enumerate(names)])
    st = mm.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.lit(bins[c]).alias("bins"),
                 F.col(f"mn{i}").alias("mn"), F.col(f"mx{i}").alias("mx"))
        for i, c in enumerate(names)])).alias("s")).select("s.*")
    same = F.col("mx") == F.col("mn")
    st = st.select("feature", "bins",
                   F.when(same, F.col("mn") - 0.5).otherwise(F.col("mn")).alias("lo"),
                   F.when(same, F.col("mx") + 0.5).otherwise(F.col("mx")).alias("hi"))
    long = (df.select(*[F.col(c).cast("double").alias(c) for c in names])
            .unpivot([], names, "feature", "value").where(F.col("value").isNotNull()))
    idx = F.least(F.floor((F.col("value") - F.col("lo")) * F.col("bins") / (F.col("hi") - F.col("lo"))),
                  F.col("bins") - 1).cast("int")
    counts = (long.join(F.broadcast(st), "feature")
              .groupBy("feature", idx.alias("bin")).agg(F.count(F.lit(1)).alias("count")))
    grid = st.select("feature", "lo", "hi", "bins",
                     F.explode(F.sequence(F.lit(0), F.col("bins") - 1)).alias("bin"))
    width = (F.col("hi") - F.col("lo")) / F.col("bins")
    return (grid.join(counts, ["feature", "bin"], "left")
            .select("feature", "bin",
                    X.rnd(F.col("lo") + F.col("bin") * width, 4).alias("bin_lo"),
                    X.rnd(F.col("lo") + (F.col("bin") + 1) * width, 4).alias("bin_hi"),
                    F.coalesce("count", F.lit(0)).cast("bigint").alias("count"))
            .orderBy("feature", "bin"))


def histogram(df: DataFrame, value: str, bins: int) -> DataFrame:
    """Histogram of one column (see ``histograms``)."""
    return histograms(df, {value: bins})


def crosstab_fraud(df: DataFrame, column: str) -> DataFrame:
    """Contingency table column x fraud flag (no_fraud, fraud counts)."""
    return (df.groupBy(F.col(column).cast("string").alias("value"))
            .pivot("has_experienced_fraud", [0, 1]).count()
            .select("value", F.coalesce(F.col("0"), F.lit(0)).cast("bigint").alias("no_fraud"),
                    F.coalesce(F.col("1"), F.lit(0)).cast("bigint").alias("fraud"))
            .orderBy("value"))
