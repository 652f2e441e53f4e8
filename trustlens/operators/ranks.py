"""Exact running counts over ordered values, at any number of distinct values.

Rows are first counted per value.  The ordered values are cut into ranges; a range's
total comes from one aggregate, the totals before it from a window over the few ranges,
and the running count inside a range from a window over that range.  The cuts come from
a sketch and decide only how even the ranges are, never the result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Ranges of values that are counted independently.
RANGES = 256


def running(counts: DataFrame, value: str, sums: list[str], parts: list[str] | None = None,
            ranges: int = RANGES) -> DataFrame:
    """Add ``<name>_before`` for each of ``sums``: its total over smaller values of the
    same ``parts``.  ``counts`` has one row per (parts, value); nulls come first."""
    parts = list(parts or [])
    v = F.col(value).cast("double")
    cuts = counts.select(F.percentile_approx(v, [i / ranges for i in range(1, ranges)], 4 * ranges)).scalar()
    rows = counts.withColumn("_cuts", cuts)
    below = F.size(F.filter(F.col("_cuts"), lambda c: c < F.col(value).cast("double")))
    rows = rows.withColumn("_range", F.when(v.isNull() | F.col("_cuts").isNull(), 0).otherwise(below)).drop("_cuts")
    total = rows.groupBy(*parts, "_range").agg(*[F.sum(s).alias(f"_t_{s}") for s in sums])
    over = Window.partitionBy(*parts) if parts else Window.partitionBy(F.lit(0))
    ahead = over.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # at most ``ranges`` rows a part
    total = total.select(*[F.col(p).alias(f"_p_{p}") for p in parts], F.col("_range").alias("_r"),
                         *[F.coalesce(F.sum(f"_t_{s}").over(ahead), F.lit(0)).alias(f"_b_{s}") for s in sums])
    inside = Window.partitionBy(*parts, "_range").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({f"_i_{s}": F.coalesce(F.sum(s).over(inside), F.lit(0)) for s in sums})
    on = reduce(lambda a, b: a & b, [F.col(p).eqNullSafe(F.col(f"_p_{p}")) for p in parts], F.col("_range") == F.col("_r"))
    return rows.join(total, on).select(*counts.columns, *[(F.col(f"_i_{s}") + F.col(f"_b_{s}")).alias(f"{s}_before") for s in sums])


def quantiles(df: DataFrame, columns: list[str], share: float = 0.5) -> DataFrame:
    """One row per column (column, value): the exact quantile with linear interpolation
    between neighbouring values, nulls and NaN left out.  All columns in one pass."""
    long = (df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], columns, "column", "value")
            .where(F.col("value").isNotNull() & ~F.isnan("value")))
    counts = long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    size = counts.groupBy(F.col("column").alias("_c")).agg(F.sum("n").alias("size"))  # one row a column
    placed = running(counts, "value", ["n"], ["column"]).join(size, F.col("column") == F.col("_c"))
    at = (F.col("size") - 1) * F.lit(float(share))
    low, high = F.floor(at), F.ceil(at)
    holds = lambda k: (F.col("n_before") <= k) & (k < F.col("n_before") + F.col("n"))
    found = placed.where(holds(low) | holds(high)).groupBy("column").agg(
        F.max(F.when(holds(low), F.col("value"))).alias("a"), F.max(F.when(holds(high), F.col("value"))).alias("b"),
        F.max(at - low).alias("t"))
    return found.select("column", F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(F.col("a") * (1 - F.col("t")) + F.col("b") * F.col("t")).alias("value"))
