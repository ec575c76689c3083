"""Observation tables: CSV or parquet in, typed rows out, bad rows set aside."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vaneworks.schema import FEATURES, LABEL, OBSERVATION_SCHEMA, ROW_ID, SERIES, TIME

CORRUPT = "_corrupt_record"


def _header(spark: SparkSession, path: str) -> list[str]:
    return spark.read.option("header", True).csv(path).columns


def read_observations(
    spark: SparkSession,
    path: str,
    fmt: str = "csv",
    schema: T.StructType = OBSERVATION_SCHEMA,
    optional: Sequence[str] = (),
) -> DataFrame:
    """Read observations with a given schema (never inferred).

    CSV columns are found by the names of the header, in any order; further ones are not read. A missing one is an error
    unless it is ``optional``: a table without a series is one series (0), a row without an id gets a hash of its values.
    CSV rows that do not fit keep their text in ``_corrupt_record``; ``split_rejected`` separates them. Parquet rows
    are typed already, and filters on them reach the scan.
    """
    if fmt == "parquet":
        return spark.read.schema(schema).parquet(path)
    if fmt != "csv":
        raise ValueError(f"unsupported format {fmt!r}")
    names = _header(spark, path)
    missing = [f.name for f in schema.fields if f.name not in names]
    if refused := [name for name in missing if name not in optional]:
        raise ValueError(f"missing columns {refused} in {path}")
    known = {f.name: f for f in schema.fields}
    in_file = [known.get(name, T.StructField(name, T.StringType())) for name in names]
    rows = (
        spark.read.schema(T.StructType([*in_file, T.StructField(CORRUPT, T.StringType())]))
        .option("header", True)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT)
        .option("enforceSchema", False)
        .csv(path)
    )
    given = [F.col(f"`{name}`") for name in names if name in known]
    filled = {name: F.lit(0) if name == SERIES else F.xxhash64(*given) if name == ROW_ID else F.lit(None) for name in missing}
    columns = [filled[f.name].cast(f.dataType).alias(f.name) if f.name in filled else F.col(f"`{f.name}`") for f in schema.fields]
    return rows.select(*columns, CORRUPT)


def coerce_timestamp(df: DataFrame, column: str = TIME, strict: bool = True) -> DataFrame:
    """Text to ``timestamp_ntz``: strict fails the job on bad text, lenient turns it into NULL (see ``reject_reason``)."""
    if isinstance(df.schema[column].dataType, T.TimestampNTZType):
        return df
    value = F.col(column)
    return df.withColumn(column, value.cast("timestamp_ntz") if strict else value.try_cast("timestamp_ntz"))


def with_reject_reason(df: DataFrame, features: Sequence[str] = FEATURES, label: str | None = LABEL) -> DataFrame:
    """``reject_reason``: why a row cannot be used, NULL for good rows. Missing feature *values* are allowed."""
    reason = F.lit(None).cast("string")
    if label and label in df.columns:
        reason = F.when(~F.col(label).isin(0, 1), "bad_label").otherwise(reason)
    for name in features:
        if name not in df.columns:
            raise ValueError(f"missing column {name}")
    if SERIES in df.columns:
        reason = F.when(F.col(SERIES).isNull(), "missing_series").otherwise(reason)
    if TIME in df.columns:
        reason = F.when(F.col(TIME).isNull(), "bad_timestamp").otherwise(reason)
    if CORRUPT in df.columns:
        reason = F.when(F.col(CORRUPT).isNotNull(), "malformed").otherwise(reason)
    return df.withColumn("reject_reason", reason)


def count_reasons(df: DataFrame) -> DataFrame:
    """Rows per reason, good ones under ``ok``, in one pass."""
    return df.groupBy(F.coalesce("reject_reason", F.lit("ok")).alias("reason")).agg(F.count("*").alias("n"))


def split_rejected(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good rows, rejected rows with their reason); every input row is in exactly one of them."""
    good = df.where(F.col("reject_reason").isNull()).drop("reject_reason", CORRUPT)
    return good, df.where(F.col("reject_reason").isNotNull())
