"""Survey sources, validation and sinks.

Readers use an explicit ``StructType`` (no inference pass over the data).
Binary flags are read as text so that 0/1 and True/False are both accepted;
Likert items are read as numbers.  Validation is one pass per check with two
aggregates per checked column (no row expansion); only the violation summary
(bounded by the number of columns) reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trustlens import schema as S
from trustlens.session import materialize

TRUE_TEXT = ["1", "true", "True", "TRUE", "1.0"]
FALSE_TEXT = ["0", "false", "False", "FALSE", "0.0"]
NUMERIC_TYPES = {"tinyint", "smallint", "int", "bigint", "float", "double"}


def read_schema(header: list[str], profile: str = "main") -> T.StructType:
    """Reader schema in the file's column order: known columns by the profile, with
    binary flags as text and Likert items as double; any other column as text."""
    base = {f.name: f for f in (S.survey_schema() if profile == "main" else S.legacy_schema()).fields}
    likert, binary = set(S.LIKERT_COLUMNS), set(S.BINARY_FEATURES)
    fields = []
    for name in header:
        if name in binary or name not in base:
            fields.append(T.StructField(name, T.StringType(), True))
        elif name in likert:
            fields.append(T.StructField(name, T.DoubleType(), True))
        else:
            fields.append(base[name])
    return T.StructType(fields)


def find_survey(spark: SparkSession, explicit: str | None = None, raw: str | None = None, synthetic: str | None = None) -> str:
    """The path to load: the explicit one if given, else the raw one if it exists, else
    the synthetic one.  FileNotFoundError if nothing lies there."""
    def there(path: str) -> bool:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)

    path = explicit or (raw if raw and there(raw) else synthetic)
    if not path or not there(path):
        raise FileNotFoundError(f"no survey data at {path}")
    return path


#: The column in which the CSV reader puts the text of a line that doesn't fit the schema.
DAMAGED = "_damaged_line"


def load_csv(spark: SparkSession, path: str, profile: str = "main", required: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, damaged) of a CSV survey with header.  ``damaged`` (file, line) has every line
    with too few or too many fields or with text where a number belongs, as it stands in
    the file.  Both come from the one pass that reads: it writes the typed rows, damaged
    lines beside them, and what follows reads that table."""
    header = spark.read.option("header", True).csv(path).columns  # reads the first line
    if required and (missing := sorted(set(required) - set(header))):
        raise ValueError(f"Dataset missing required columns: {missing}")
    schema = T.StructType([*read_schema(header, profile).fields, T.StructField(DAMAGED, T.StringType(), True)])
    read = (spark.read.schema(schema).option("header", True).option("enforceSchema", False)
            .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", DAMAGED).csv(path))
    both = materialize(read.withColumn("_file", F.input_file_name()), "survey_rows")
    return (both.where(F.col(DAMAGED).isNull()).drop(DAMAGED, "_file"),
            both.where(F.col(DAMAGED).isNotNull()).select(F.col("_file").alias("file"), F.col(DAMAGED).alias("line")))


def read_survey(spark: SparkSession, path: str, fmt: str = "csv", profile: str = "main",
                validate_rows: bool = True, quarantine: str | None = None) -> DataFrame:
    """Load a survey table (CSV with header, or Parquet), validate, coerce types.

    CSV columns are found by the names in the header, in any order; further columns are
    kept.  Files of a folder must agree on their header (Spark checks each).  Damaged lines
    (see ``load_csv``) are an error, unless ``quarantine`` names a folder: then they are
    written there (file, line) and the other rows are returned."""
    required = S.REQUIRED_COLUMNS if profile == "main" else S.LEGACY_COLUMNS
    if fmt == "csv":
        df, damaged = load_csv(spark, path, profile, required if validate_rows else None)
        if quarantine:
            damaged.write.mode("overwrite").parquet(quarantine)
        elif first := damaged.orderBy("line").first():
            raise ValueError(f"{damaged.count()} damaged lines, such as in {first['file']}: {first['line'][:200]}")
    elif fmt == "parquet":
        df = spark.read.parquet(path)
    else:
        raise ValueError(f"unknown format {fmt}")
    if validate_rows:
        validate(df, required=required)
    return coerce_types(df)


def binary_value(c: str):
    """Text or number flag -> 1/0, anything else -> null."""
    v = F.col(c).cast("string")
    return (F.when(v.isin(TRUE_TEXT), 1).when(v.isin(FALSE_TEXT), 0)).cast("int")


def coerce_types(df: DataFrame) -> DataFrame:
    """Binary flags and Likert items to INT (Likert truncates like astype(int))."""
    out = {c: binary_value(c) for c in S.BINARY_FEATURES if c in df.columns}
    out.update({c: F.col(c).cast("int") for c in S.LIKERT_COLUMNS if c in df.columns})
    return df.withColumns(out)


def check_required(df: DataFrame, required: list[str] | None = None) -> list[str]:
    """Missing required columns, sorted (schema metadata only, no job)."""
    required = required or S.REQUIRED_COLUMNS
    return sorted(set(required) - set(df.columns))


def _violations(df: DataFrame, cols: list[str], ok, id_col: str = "respondent_id") -> DataFrame:
    """(column, n_bad, first_bad_id) for columns with at least one bad value.

    One pass with two aggregates per column (count of bad values, smallest id
    among them): no row expansion; the one-row result is unpivoted.
    """
    cols = [c for c in cols if c in df.columns]
    if not cols:
        return df.sparkSession.createDataFrame([], "column string, n_bad bigint, first_bad_id bigint")
    rid = F.col(id_col).cast("bigint")
    types = dict(df.dtypes)
    aggs = []
    for i, c in enumerate(cols):
        bad = ~F.coalesce(ok(F.col(c), types[c]), F.lit(False))
        aggs += [F.count(F.when(bad, 1)).alias(f"n{i}"), F.min(F.when(bad, rid)).alias(f"f{i}")]
    one = df.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"n{i}").alias("n_bad"),
                              F.col(f"f{i}").alias("first_bad_id")) for i, c in enumerate(cols)])
    return (one.select(F.explode(rows).alias("r")).select("r.*")
            .where(F.col("n_bad") > 0).orderBy("column"))


def check_likert_range(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Per Likert column: count of values outside 1..5 or null, first bad id."""
    cols = columns or S.LIKERT_COLUMNS

    def ok(v, t):
        num = v if t in NUMERIC_TYPES else v.try_cast("double")
        return num.between(1, 5)
    return _violations(df, cols, ok)


def check_binary(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Per binary column: count of values not in {0, 1, True, False}, first bad id."""
    cols = columns or S.BINARY_FEATURES

    def ok(v, t):
        if t == "boolean":
            return v.isNotNull()
        if t in NUMERIC_TYPES:
            return v.isin(0, 1)
        return v.isin(TRUE_TEXT + FALSE_TEXT)
    return _violations(df, cols, ok)


def validate(df: DataFrame, required: list[str] | None = None,
             likert: list[str] | None = None, binary: list[str] | None = None) -> None:
    """Raise ValueError on missing columns, out-of-range Likert or non-binary flags."""
    missing = check_required(df, required)
    if missing:
        raise ValueError(f"Dataset missing required columns: {missing}")
    lk = check_likert_range(df, likert).limit(1).collect()
    if lk:
        raise ValueError(f"Column '{lk[0]['column']}' contains values outside 1–5 "
                         f"(first bad id: {lk[0]['first_bad_id']})")
    bn = check_binary(df, binary).limit(1).collect()
    if bn:
        raise ValueError(f"Column '{bn[0]['column']}' must be binary (0/1)")


def legacy_projection(df: DataFrame) -> DataFrame:
    """The 22-column legacy shape of a main-profile table (flags as booleans)."""
    return df.select(F.col("respondent_id").cast("int").alias("respondent_id"),
                     "gender", "age_group", "education", "occupation", "usage_frequency",
                     *[(F.col(c) == 1).alias(c) for c in S.LEGACY_SERVICE_COLUMNS],
                     *S.LEGACY_LIKERT_COLUMNS)


def write_csv(df: DataFrame, path: str) -> str:
    df.write.mode("overwrite").option("header", True).csv(path)
    return path


def write_table(df: DataFrame, path: str, fmt: str = "parquet") -> str:
    """Sink one result table (overwrite).  Result tables are small; the
    respondent-level tables keep their partitioning."""
    w = df.write.mode("overwrite")
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.parquet(path)
    return path
