"""Connected components of a link table, by alternating star contractions.

Every step is a grouped minimum and a join; no neighbour list is ever collected.  The
links of each step are written under the shared checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trustlens.session import materialize


def _star(links: DataFrame, small: bool) -> DataFrame:
    """Large star: each larger neighbour of u goes to the least of u and its neighbours.
    Small star: u and its smaller neighbours go to the least of those."""
    if small:
        seen = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    else:
        seen = links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(
            links.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = seen.groupBy("u").agg(F.min("v").alias("least")).withColumn("least", F.least("u", "least"))
    if small:
        moved = seen.join(least, "u").select(F.col("v").alias("a"), F.col("least").alias("b")).unionAll(
            least.select(F.col("u").alias("a"), F.col("least").alias("b")))
    else:
        moved = seen.filter("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("least").alias("b"))
    return moved.filter("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(a, b) links to (node, root): the smallest node reachable, for each node with a
    link.  Null and self links are ignored."""
    now = materialize(links.select("a", "b").filter("a <> b").distinct(), "links")
    state = None
    while True:
        stars = materialize(_star(_star(now, small=False), small=True), "stars")
        new = stars.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if new == state:
            return stars.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(
                stars.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
        now, state = stars, new
