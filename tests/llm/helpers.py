"""Rows for the tests of the training-data operators."""

from pyspark.sql import DataFrame, SparkSession

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark: SparkSession, texts, ids=None, schema=DOC_SCHEMA, extra=()) -> DataFrame:
    """A documents table; ``extra`` holds further (name, type, value) columns."""
    ids = list(range(len(texts))) if ids is None else ids
    rows = [(i, t, "en", "s", None if t is None else len(t), *[v for _, _, v in extra]) for i, t in zip(ids, texts, strict=True)]
    return spark.createDataFrame(rows, ", ".join([schema, *[f"{n} {k}" for n, k, _ in extra]])).repartition(3)


def rows(df: DataFrame, *order: str) -> list[tuple]:
    return sorted((tuple(r) for r in df.collect()), key=repr) if not order else [tuple(r) for r in df.orderBy(*order).collect()]
