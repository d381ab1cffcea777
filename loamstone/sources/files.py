"""Sources and sinks: folders of texts, snapshots with fingerprints, generations behind a pointer, JDBC."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import text as T


def read_texts(spark: SparkSession, folder: str, pattern: str = "*.md") -> DataFrame:
    """(source, text): each file whole."""
    files = spark.read.text(folder, wholetext=True, pathGlobFilter=pattern, recursiveFileLookup=True)
    return files.select(F.input_file_name().alias("source"), F.col("value").alias("text"))


def read_snapshot(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """A table whose columns may have been added over time; the columns of older files are null."""
    reader = spark.read.option("mergeSchema", True)
    return (reader.schema(schema) if schema else reader).parquet(path)


def write_snapshot(df: DataFrame, path: str) -> None:
    """The commit protocol publishes all of it or nothing."""
    df.write.mode("overwrite").parquet(path)


def with_fingerprint(df: DataFrame) -> DataFrame:
    return df.withColumn("fingerprint", T.fingerprint(*df.columns))


def write_generation(df: DataFrame, root: str) -> str:
    """A new generation beside the old ones, then the pointer moves; a failed write leaves the pointer alone."""
    name = f"gen={uuid.uuid4().hex}"
    df.write.parquet(f"{root}/{name}")
    df.sparkSession.createDataFrame([(name,)], "generation string").coalesce(1).write.mode("overwrite").parquet(f"{root}/_pointer")
    return name


def read_generation(spark: SparkSession, root: str) -> DataFrame:
    name = spark.read.parquet(f"{root}/_pointer").first().generation
    return spark.read.parquet(f"{root}/{name}")


def read_jdbc(spark: SparkSession, url: str, table: str, key: str | None = None, low: int = 0, high: int = 0, parts: int = 1) -> DataFrame:
    """A database table, read in ranges of a numeric key if one is given."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table)
    if key:
        reader = reader.option("partitionColumn", key).option("lowerBound", low).option("upperBound", high).option("numPartitions", parts)
    return reader.load()
