"""Reading tables; intermediate ones come from the session module."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import over_cores, released, saved

__all__ = ["free_name", "met", "released", "saved", "table"]

#: a key with more than a HOT-th part of all rows is hot: there are fewer than HOT of them
HOT = 500


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    found = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return over_cores(found) if name == "documents" else found  # whole texts are work for each row


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or with more underscores before it if a column is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def met(rows: DataFrame, groups: DataFrame, keys: list[str], total: int, size: str, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``groups``, a table with a row for each key and its number of rows in ``size``; ``total`` is the number of all rows.

    The rows of hot keys meet their group by a broadcast of fewer than HOT rows and stay where they are; those of the others by a shuffle.
    """
    hot = F.col(size) > max(1000, total / HOT)
    big = F.broadcast(groups.where(hot))
    return rows.join(big, keys).unionByName(rows.join(big.select(keys), keys, "left_anti").join(groups.where(~hot), keys, how))
