"""Mixing sources to target weights by entropy balancing.

Targets: the sources, by code point and null last, share the words of the corpus by their
weights; a target stops at ``cap`` times its source's words and the excess is shared anew
by weight (water filling).

Rates: of all document rates ``r_i`` in (0, cap] that give every source its target words,
``sum(size_i * r_i) = target``, the ones nearest to 1 in relative entropy,
``min sum(r_i ln r_i - r_i + 1)``, are exponentially tilted, ``r_i = min(cap, exp(l * u_i))``
with ``u_i`` the document's size over its source's mean.  The dual is convex with one
multiplier a source; Newton's steps, kept inside a bracket of the root, solve it.  Every
step is one aggregate over counts by (source, size), never over documents, and the
multipliers are a table that is written and read again.

Copies: rates become whole millionths.  Running sums of expected copies over a source's
sizes are rounded, so that the copies of (source, size) never stray by one from what is
expected.  What is still missing or over in words is then paid in few copies, largest sizes
first, from at most eight sizes in each doubling.  Documents of one (source, size) differ by
one copy at most; which ones have the extra copy follows from a hash of doc_id.

All sums are of whole numbers or decimals, so neither the dealing of rows nor a lost task
changes the result.  DataFrame functions only.  A source or a size that holds most rows is
counted before it is shuffled, and its documents are ranked in hash ranges.

Defined results: a null text has no words; a document without words has rate 1, one copy
and takes none; a null source is a source of its own; a null doc_id counts as the text
``null``; rows that repeat a doc_id are documents of their own.  With no rows there is no
source and no row.  Columns that are not kept are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trustlens.llm.common import documents, text_or_empty
from trustlens.operators.ranks import running
from trustlens.session import materialize

WEIGHTS = (5, 2, 1)
CAP = 3
WORD = r"[^\x20\x09-\x0D]+"
#: Rates are whole numbers of this part.
UNIT = 1_000_000
#: A source's expected words may be off its target by this share before rounding.
TOLERANCE = 1e-7
MAX_STEPS = 200
HASH_BITS = 52
#: Rows of one (source, size) that are ranked together, as an aim, and ranges at most.
RANGE_ROWS, RANGE_BITS = 1024, 16


def _key(by: str) -> Column:
    """Never null; its order is that of the code points, null last."""
    return F.when(F.col(by).isNull(), "1").otherwise(F.concat(F.lit("0"), F.col(by).cast("string")))


def sized(docs: DataFrame, by: str, keep: list[str]) -> DataFrame:
    """key, size (words), place (a hash of doc_id), row (the columns to keep)."""
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    place = F.conv(F.substring(F.md5(name), 1, HASH_BITS // 4), 16, 10).cast("long")
    return docs.select(_key(by).alias("key"), F.regexp_count(text_or_empty(), F.lit(WORD)).cast("long").alias("size"),
                       place.alias("place"), F.struct(*keep).alias("row"))


def targets(cells: DataFrame, weights=WEIGHTS, cap: int = CAP) -> DataFrame:
    """key, source_size, target, mean and least size, from counts by (key, size).  The
    windows run over the sources, one row each."""
    per = cells.groupBy("key").agg(
        F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum(F.when(F.col("size") > 0, F.col("n"))).alias("filled"),
        F.min(F.when(F.col("size") > 0, F.col("size"))).alias("least"))
    number = F.row_number().over(Window.orderBy("key"))
    per = per.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (number - 1) % len(weights) + 1))
    per = per.withColumn("limit", F.col("source_size") * float(cap))
    everything = Window.partitionBy(F.lit(0))
    before = Window.orderBy(F.col("limit") / F.col("weight"), "key").rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("source_size").over(everything)
    level = ((total - F.coalesce(F.sum("limit").over(before), F.lit(0.0)))
             / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    per = per.withColumn("full", F.col("limit") <= F.col("weight") * level).withColumn("total", total)
    rest = F.col("total") - F.coalesce(F.sum(F.when(F.col("full"), F.col("limit"))).over(everything), F.lit(0.0))
    share = F.col("weight") / F.sum(F.when(~F.col("full"), F.col("weight"))).over(everything)
    return per.select("key", "source_size", F.when(F.col("full"), F.col("limit")).otherwise(rest * share).alias("target"), "full",
                      (F.col("source_size") / F.col("filled")).alias("mean"), "least")


def _tilted(cap: int) -> Column:
    """The rate of a (key, size): capped for full sources, 1 without words."""
    free = F.least(F.lit(float(cap)), F.exp(F.col("multiplier") * F.col("size") / F.col("mean")))
    return F.when(F.col("size") == 0, 1.0).when(F.col("full"), float(cap)).otherwise(free)


def multipliers(cells: DataFrame, sources: DataFrame, cap: int = CAP, tolerance: float = TOLERANCE,
                max_steps: int = MAX_STEPS) -> DataFrame:
    """``sources`` with each one's multiplier, by Newton's steps on the dual.  Between the
    multiplier that gives the shortest document the target's rate and 0 (or, upwards, the one
    that caps it) lies the root; a step out of the bracket is replaced by its middle."""
    ratio = F.log(F.col("target") / F.col("source_size"))
    unit = F.col("mean") / F.col("least")
    grow = F.col("target") >= F.col("source_size")
    state = sources.select(
        "*", F.lit(0.0).alias("multiplier"), F.when(grow, 0.0).otherwise(ratio * unit).alias("low"),
        F.when(grow, F.log(F.lit(float(cap))) * unit).otherwise(0.0).alias("high"),
        (F.col("full") | F.col("mean").isNull() | (F.col("target") == F.col("source_size"))).alias("done"))
    state = materialize(state, "mix_state")
    for _ in range(max_steps):
        if state.filter("NOT done").isEmpty():
            return state
        rate = _tilted(cap)
        words = F.col("n") * F.col("size") * rate
        slope = F.when(rate < cap, words * F.col("size") / F.col("mean")).otherwise(0.0)
        active = state.filter("NOT done").select("key", "multiplier", "mean", "full")
        now = (cells.join(active, "key").groupBy("key")
               .agg(F.sum(words.cast("decimal(38,6)")).cast("double").alias("words"),
                    F.sum(slope.cast("decimal(38,6)")).cast("double").alias("slope")))
        gap = F.col("words") - F.col("target")
        moved = state.join(now, "key", "left").withColumn("gap", gap)
        moved = moved.withColumns({"low": F.when(F.col("gap") < 0, F.col("multiplier")).otherwise(F.col("low")),
                                   "high": F.when(F.col("gap") >= 0, F.col("multiplier")).otherwise(F.col("high"))})
        step = F.col("multiplier") - F.col("gap") / F.col("slope")
        middle = (F.col("low") + F.col("high")) / 2
        next_one = F.when((F.col("slope") > 0) & (step > F.col("low")) & (step < F.col("high")), step).otherwise(middle)
        near = F.abs("gap") <= F.col("target") * tolerance
        closed = (next_one == F.col("low")) | (next_one == F.col("high"))  # neighbours as doubles
        moved = moved.withColumn("next", next_one).withColumn("near", near | closed)
        state = materialize(moved.select(
            *sources.columns, F.when(F.col("done") | F.col("near"), F.col("multiplier")).otherwise(F.col("next")).alias("multiplier"),
            "low", "high", (F.col("done") | F.col("near")).alias("done")), "mix_state")
    raise ValueError(f"no solution within {max_steps} steps")


def _payments(cells: DataFrame, cap: int) -> DataFrame:
    """(key, size, change): copies more or less that bring a source to its target."""
    owed = cells.groupBy("key").agg((F.floor(F.first("target") + 0.5) - F.sum(F.col("copies") * F.col("size"))).alias("owed"))
    # The fullest size of each eighth of a doubling: a bounded list a source.
    step = F.floor(F.log2("size") * 8)
    menu = (cells.filter("size > 0").groupBy("key", step.alias("step"))
            .agg(F.max(F.struct("n", "size", "copies")).alias("cell")).groupBy("key")
            .agg(F.sort_array(F.collect_list(F.struct("cell.size", "cell.n", "cell.copies")), asc=False).alias("menu")))
    start = F.struct(F.col("owed").cast("long").alias("owed"), F.array().cast("array<struct<size:bigint,change:bigint>>").alias("paid"))

    def pay(state: Column, cell: Column) -> Column:
        wanted = F.floor((state["owed"] / cell["size"]) + 0.5)
        change = F.greatest(-cell["copies"], F.least(wanted, cap * cell["n"] - cell["copies"])).cast("long")
        paid = F.when(change == 0, state["paid"]).otherwise(
            F.concat(state["paid"], F.array(F.struct(cell["size"].alias("size"), change.alias("change")))))
        return F.struct((state["owed"] - change * cell["size"]).cast("long").alias("owed"), paid.alias("paid"))

    paid = owed.join(menu, "key").select("key", F.explode(F.aggregate("menu", start, pay)["paid"]).alias("p"))
    return paid.select("key", "p.size", "p.change")


def cell_copies(cells: DataFrame, solved: DataFrame, cap: int = CAP) -> DataFrame:
    """key, size, n, rate (in millionths), copies (of all n together), source_size, target."""
    rates = cells.join(solved, "key").select("key", "size", "n", "source_size", "target", F.floor(_tilted(cap) * UNIT + 0.5).alias("rate"))
    rates = materialize(rates.withColumn("expected", F.col("n") * F.col("rate")), "mix_rates")
    placed = running(rates, "size", ["expected"], ["key"])
    copies = F.expr(f"(expected_before + expected + {UNIT // 2}) DIV {UNIT} - (expected_before + {UNIT // 2}) DIV {UNIT}")
    rounded = materialize(placed.withColumn("copies", copies).drop("expected", "expected_before"), "mix_rounded")
    paid = rounded.join(_payments(rounded, cap), ["key", "size"], "left")
    return paid.withColumn("copies", F.col("copies") + F.coalesce("change", F.lit(0))).drop("change")


def mix(docs: DataFrame, by: str = "source", weights=WEIGHTS, cap: int = CAP, keep: list[str] | None = None,
        range_rows: int = RANGE_ROWS) -> DataFrame:
    """One row per document: row (a struct of the columns ``keep``), size, source_size,
    target, rate, copies, taken (words of all copies)."""
    rows = materialize(sized(docs, by, keep or ["doc_id"]), "mix_rows")
    cells = materialize(rows.groupBy("key", "size").agg(F.count(F.lit(1)).alias("n")), "mix_cells")
    sources = materialize(targets(cells, weights, cap), "mix_sources")
    cells = cell_copies(cells, multipliers(cells, sources, cap), cap)
    bits = min(RANGE_BITS, (rows.count() // range_rows).bit_length())
    rows = rows.withColumn("range", F.shiftright("place", HASH_BITS - bits))
    at = ["key", "size", "range"]
    before = Window.partitionBy("key", "size").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = rows.groupBy(*at).agg(F.count(F.lit(1)).alias("here")).join(cells, ["key", "size"])
    ahead = F.coalesce(F.sum("here").over(before), F.lit(0))
    ranges = ranges.select(*at, "source_size", "target", (F.col("rate") / UNIT).alias("rate"),
                           F.expr("copies DIV n").alias("base"), (F.expr("copies % n") - ahead).alias("extra"))
    rank = F.row_number().over(Window.partitionBy(*at).orderBy("place", "row"))
    copies = F.col("base") + (F.col("rank") <= F.col("extra")).cast("long")
    return (rows.withColumn("rank", rank).join(ranges, at).withColumn("copies", copies)
            .select("row", "size", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).alias("taken")))


def mixture(docs: DataFrame, by: str = "source", weights=WEIGHTS, cap: int = CAP) -> DataFrame:
    """The mixed corpus: the rows of ``docs``, each as often as its copies."""
    taken = mix(docs, by, weights, cap, keep=docs.columns).filter("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("row.*")


def op11_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents``, sources weighing 5, 2, 1, repeating."""
    return mix(documents(spark, sf_dir)).select("row.doc_id", "size", "source_size", "target", "taken", "copies", "rate")
