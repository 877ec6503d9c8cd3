"""Readers and writers for study files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cohortloom.operators.tables import to_long


def read_csv(spark: SparkSession, path: str, schema: str, sep: str = ",") -> DataFrame:
    """Delimited text with a header; ``NA`` and blank cells are missing.

    The schema is given, so the file is read once and unused columns are
    skipped by the parser.
    """
    return spark.read.schema(schema).options(
        header=True, sep=sep, nullValue="NA", enforceSchema=False
    ).csv(path)


def read_tsv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return read_csv(spark, path, schema, sep="\t")


def read_matrix(spark: SparkSession, path: str, key: str = "feature", columns: str = "sample_id",
                value_type: str = "double", sep: str = ",") -> DataFrame:
    """Matrix whose first column is the row key, as long (key, column, value) rows.

    Only the header line is read ahead, to learn the column names.
    """
    header = spark.read.options(header=True, sep=sep).csv(path).columns
    fields = [f"`{header[0]}` string"] + [f"`{c}` {value_type}" for c in header[1:]]
    wide = read_csv(spark, path, ", ".join(fields), sep)
    return to_long(wide.withColumnRenamed(header[0], key), [key], header[1:], columns, "value")


def read_stage(spark: SparkSession, path: str) -> DataFrame:
    """A table written by an earlier stage."""
    return spark.read.parquet(path)


def write_stage(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def write_csv(df: DataFrame, path: str, sep: str = ",") -> None:
    """Delimited text with a header, missing values as ``NA``."""
    df.write.mode("overwrite").options(header=True, sep=sep, nullValue="NA").csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """One JSON record per row (metrics, chosen parameters)."""
    df.write.mode("overwrite").json(path)


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)
