"""Shared helpers of the training-data operators."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow.compute as pc
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words: everything between ASCII control, space and punctuation characters.
WORD_PATTERN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Rows in one Arrow batch: bounds a Python worker's memory when texts are long.
ARROW_ROWS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def text_or_empty(c: Column | str = "text") -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only.  ``lower`` does just that to ASCII text, and faster."""
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(
        F.translate(c, UPPER, UPPER.lower()))


def words_of(c: Column) -> Column:
    """The array of words of a text, A-Z lower-cased; null has none."""
    return F.regexp_extract_all(ascii_lower(F.coalesce(c, F.lit(""))), F.lit(WORD_PATTERN), F.lit(0))


def bounded_batches(spark: SparkSession, rows: int = ARROW_ROWS) -> None:
    """Lower the Arrow batch size for Python functions over whole texts."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))


def shuffle_tasks(docs: DataFrame, each: int = 1) -> int:
    """Tasks for a shuffle of what the scan tasks of ``docs`` give: ``each`` for a scan
    part, so that what a task reads does not grow with the input."""
    return max(1, each * docs.select(docs.columns[0]).rdd.getNumPartitions())


#: Stores that pyarrow calls by another scheme than Hadoop (fixed values).
SCHEMES = {"s3a": "s3", "s3n": "s3", "wasb": "abfs", "wasbs": "abfss"}


def pyarrow_uri(folder: str) -> str:
    """The shared folder's URI as pyarrow reads it."""
    scheme, mark, rest = folder.partition(":")
    if not mark or "/" in scheme:
        return folder
    if scheme == "dbfs":  # mounted under /dbfs on every machine of such a cluster
        return "/dbfs/" + rest.lstrip("/")
    if scheme in ("wasb", "wasbs"):
        rest = rest.replace(".blob.", ".dfs.", 1)
    return f"{SCHEMES.get(scheme, scheme)}:{rest}"


def shared_files(folder: str) -> tuple[pafs.FileSystem, str]:
    """The file system that holds ``folder``, and the path in it."""
    return pafs.FileSystem.from_uri(pyarrow_uri(folder))


def same(left: DataFrame, right: DataFrame, *names: str) -> Column:
    """Null-safe equality of columns that both sides have."""
    return reduce(lambda a, b: a & b, [left[n].eqNullSafe(right[n]) for n in names])


def by_bytes(batch, column: str, limit: int = 4 << 20):
    """Slices of an Arrow batch whose strings have at most ``limit`` bytes (or one row)."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    at = 0
    while at < len(batch):
        n = max(1, int(np.searchsorted(np.cumsum(sizes[at:at + 4096]), limit, side="right")))
        yield batch.slice(at, n)
        at += n


def powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64."""
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def ragged_take(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The concatenation of ``values[s:s + n]`` over all (s, n)."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return values[np.repeat(starts - (ends - sizes), sizes) + np.arange(total)]
