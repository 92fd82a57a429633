"""Session helpers that every operator shares: reading tables, cutting lineage."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given Parquet tables, by Spark alone (the folder may be in any store)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Sends this package to all workers, for sessions that were not started where Python finds it. Spark serves the archive from the driver."""
    root = Path(__file__).resolve().parent
    spark.sparkContext.addPyFile(shutil.make_archive(f"{tempfile.mkdtemp(prefix='foldlog-')}/{root.name}-{uuid.uuid4().hex[:8]}", "zip", root.parent, root.name))


def spread(df: DataFrame, *by: str) -> DataFrame:
    """df, dealt to all cores where it is read in fewer parts than there are cores: for rows that take long to work on.

    by: columns of many values to deal by; without them Spark sorts the rows first.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, *by)


def checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared folder for checkpoints; a folder of our own only where none is named, and only on one machine."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not named:
        current = sc._jsc.sc().getCheckpointDir()
        if not current.isDefined() and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: on a cluster it must name a folder that all machines share")
        named = current.get() if current.isDefined() else tempfile.mkdtemp(prefix="spark-checkpoint-")
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """df, written once to the shared checkpoint folder, so that lost executors cost no recomputation of its lineage."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def keep(df: DataFrame, *by: str) -> DataFrame:
    """df, written once as Parquet in the shared checkpoint folder and read back: later reads take single columns.

    by: columns whose values get folders of their own, so that a filter on them reads those alone.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Removes the files of a table that keep() wrote. Nothing may read it afterwards."""
    sc = df.sparkSession.sparkContext
    folders = {f[: f.index("/", f.index("/table-") + 1)] for f in df.inputFiles() if "/table-" in f}
    for folder in folders:
        path = sc._jvm.org.apache.hadoop.fs.Path(folder)
        if path.getName().startswith("table-"):
            path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
