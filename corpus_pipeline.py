"""Documents to packed training sequences, in stages: (name, function) with function(spark, docs, sf_dir) -> DataFrame.

Each stage works on all that the one before it kept, and all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamstone.llm import decontaminate, minhash, packing, quality, suffix_dedup
from loamstone.llm.io import free_name, saved, table
from loamstone.llm.queries import vocabulary
from loamstone.session import ship


def _keyed(docs: DataFrame, *columns: str) -> tuple[DataFrame, str]:
    """The rows with a key of their own, by the columns that decide on them: ids may be missing, or name several texts."""
    name = free_name(docs, "_row")
    return docs.withColumn(name, F.xxhash64(*columns)), name


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that are kept, each judged by its own text and language."""
    rows, key = _keyed(docs, "doc_id", "text", "lang")
    verdicts = quality.quality_rules(rows, table(spark, sf_dir, "labels"), also=(key,))
    return rows.join(verdicts.where("kept").select(key).distinct(), key, "left_semi").select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group: that with the least id, one without an id last; of rows that repeat an id and a text, one."""
    rows, key = _keyed(docs, "doc_id", "text")
    found = minhash.near_duplicates(rows.select(F.col(key).alias("row"), "text"), "row")
    ids = rows.select(F.col(key).alias("row"), "doc_id")
    # a row for each row of docs, without its text
    found = saved(found.groupBy("row").agg(F.first("component_id").alias("component"), F.count("*").alias("n")).join(ids.distinct(), "row"))
    best = found.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("best"))
    good = rows.join(best.select(F.col("best.row").alias(key)), key, "left_semi")
    again = found.where("n > 1").select(F.col("row").alias(key))
    if again.isEmpty():
        return good.select(docs.columns)
    once = good.join(again, key, "left_semi").dropDuplicates([key])
    return good.join(again, key, "left_anti").unionByName(once).select(docs.columns)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # passages of over fifty words may be much shorter than the 400 bytes of the query's contract; long words make 300 bytes of fewer
    return suffix_dedup.without_repeats(docs, window=300, words=51).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, vocabulary())


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("suffix_array_dedup", suffix_array_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("pack", pack),
]
#: Tokens and suffix buckets are out of SQL's reach: tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written to the shared folder and read again for the next."""
    docs = table(ship(spark), sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = saved(docs)
    return docs
