"""Making the package importable in Python workers, tables cut from their lineage, and small tables dealt over the cores."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def ship(spark: SparkSession) -> SparkSession:
    """Adds this checkout to the workers' module path; on a cluster without it there, pass the package with --py-files."""
    environment = spark.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables: the one that the session names, else the warehouse; only a session that is one process takes a folder of its machine."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named
    if context._jsc.sc().getCheckpointDir().isEmpty():
        if not context.master.startswith("local"):
            return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_loamstone"
        context.setCheckpointDir(tempfile.mkdtemp(prefix="loamstone-"))
    return context._jsc.sc().getCheckpointDir().get()


def _place(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def saved(df: DataFrame) -> DataFrame:
    """The same rows, computed once, written as a table to the shared folder and read from there.

    A lost executor then costs no recomputation of what came before. The table goes with ``released``, or when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/loamstone-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    files, place = _place(spark, path)
    files.deleteOnExit(place)
    out = spark.read.schema(df.schema).parquet(path)
    out._saved_at = path
    return out


def released(*tables: DataFrame) -> None:
    """Deletes tables made by ``saved`` that nothing will read again."""
    for df in tables:
        files, place = _place(df.sparkSession, df._saved_at)
        files.delete(place, True)


def over_cores(scan: DataFrame) -> DataFrame:
    """A scan of fewer splits than there are cores, dealt over them: rows of one row group would all be work of one task. Larger tables are left as they are."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan
