"""Table readers. No reader infers types from data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Input layouts of the entity, panel and label tables in CSV form.
ENTITY_CSV = T.StructType([
    T.StructField("CustomerID", T.StringType()),
    T.StructField("Age", T.DoubleType()),
    T.StructField("Gender", T.StringType()),
    T.StructField("Region", T.StringType()),
    T.StructField("ContractType", T.StringType()),
    T.StructField("MonthlyCharges", T.DoubleType()),
    T.StructField("SignupDate", T.StringType()),
])
PANEL_CSV = T.StructType([
    T.StructField("CustomerID", T.StringType()),
    T.StructField("Month", T.StringType()),
    T.StructField("CallMinutes", T.DoubleType()),
    T.StructField("DataUsageGB", T.DoubleType()),
    T.StructField("SMSCount", T.IntegerType()),
    T.StructField("Complaints", T.IntegerType()),
])
LABEL_CSV = T.StructType([
    T.StructField("CustomerID", T.StringType()),
    T.StructField("Churn", T.IntegerType()),
])


class Tables:
    """The parquet tables of one folder, read lazily by name: ``t("orders")``."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")
        self._scans: dict[str, DataFrame] = {}

    def __call__(self, name: str) -> DataFrame:
        if name not in self._scans:
            self._scans[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return self._scans[name]


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN means "missing" in the sources; keep one missing marker only."""
    floats = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.select(*[
        F.when(~F.isnan(c), F.col(c)).alias(c) if c in floats else F.col(c) for c in df.columns
    ])


def read_csv_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV scan with a declared schema; unparseable cells become NULL."""
    raw = spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE").csv(path)
    return nan_to_null(raw)


BAD_ROW = "_corrupt_record"


def read_csv_cells(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Every cell of a CSV as its text beside its typed value: column ``c`` is a struct (raw, value).

    ``value`` is NULL for a text that the declared type cannot take; NaN stays NaN here. Lines with
    more or fewer cells than the schema keep their whole text in BAD_ROW.
    """
    texts = T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields] + [T.StructField(BAD_ROW, T.StringType())])
    raw = spark.read.schema(texts).option("header", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", BAD_ROW).csv(path)
    typed = [F.struct(F.col(f.name).alias("raw"), F.col(f.name).try_cast(f.dataType).alias("value")).alias(f.name) for f in schema.fields]
    return raw.select(*typed, BAD_ROW)


def malformed_cells(cells: DataFrame) -> DataFrame:
    """Per column of :func:`read_csv_cells`: rows, empty cells, cells that do not parse, NaN cells, and the first bad text; one pass.

    Cells of lines with a wrong number of cells are counted in ``in_bad_rows`` only.
    """
    names = [c for c in cells.columns if c != BAD_ROW]
    bad_row = F.col(BAD_ROW).isNotNull()
    counts = []
    for c in names:
        raw, value = F.col(f"{c}.raw"), F.col(f"{c}.value")
        malformed = ~bad_row & raw.isNotNull() & value.isNull()
        is_float = dict(cells.select(f"{c}.value").dtypes)["value"] in ("double", "float")
        nan = ~bad_row & F.isnan(value) if is_float else F.lit(False)
        counts.append(F.struct(
            F.lit(c).alias("column"), F.count(F.lit(1)).alias("n_rows"), F.count_if(~bad_row & raw.isNull()).alias("empty"), F.count_if(malformed).alias("malformed"),
            F.count_if(nan).alias("not_a_number"), F.count_if(bad_row).alias("in_bad_rows"), F.min(F.when(malformed, raw)).alias("first_bad")))
    return cells.agg(F.array(*counts).alias("c")).select(F.inline("c"))


def read_summary(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Re-read a JSON summary written by :func:`siftwright.sources.sinks.write_summary`."""
    return spark.read.schema(schema).json(path)
