"""NDJSON in and out, and byte-bounded batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators import folds


def read(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """One JSON object for each line; malformed lines give nulls."""
    return spark.read.schema(schema).json(path)


def encoded(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "true"}).alias("value"))


def write(df: DataFrame, path: str) -> None:
    encoded(df).write.text(path)


def line_bytes(df: DataFrame) -> DataFrame:
    """``df`` with line_bytes: the bytes of each row's line with its line end."""
    return df.withColumn("line_bytes", (F.octet_length(F.to_json(F.struct("*"), {"ignoreNullFields": "true"})) + 1).cast("long"))


def batches(rows: DataFrame, key: str, order: list[str], n_bytes: str, most: int) -> DataFrame:
    """key, order and batch: rows are packed in order while a batch's bytes stay within ``most``; a larger row is alone."""
    slim = rows.select(key, *order, n_bytes)
    return folds.folded(slim, key, [F.col(c) for c in order], n_bytes, (-1, 0), folds.packing(most), "batch").drop(n_bytes)
