"""Text files as documents, and results as text files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_lines(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """(file, line, text): the lines of text files with their numbers from 0. A file is read by one task, for the numbers."""
    whole = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    lines = whole.select("file", F.posexplode(F.split(F.regexp_replace("value", r"\r?\n\z", ""), r"\r?\n")).alias("line", "text"))
    return lines


def read_unnumbered(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """(text): the lines of text files of any size, in no order."""
    return spark.read.text(paths).withColumnRenamed("value", "text")


def write_lines(df: DataFrame, column: str, path: str) -> None:
    """One text column as text files; line feeds inside stay."""
    df.select(F.col(column).alias("value")).write.mode("overwrite").text(path)
