"""What a session needs: Python workers that find this package, and a folder that driver and executors share."""

from __future__ import annotations

import tempfile
from pathlib import Path
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession


def importable(spark: SparkSession) -> None:
    """Adds the package's folder to the workers' module path; on a cluster the package is installed or sent with --py-files instead."""
    root, env = str(Path(__file__).resolve().parents[1]), spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(":") if p]
    if root not in paths:
        env["PYTHONPATH"] = ":".join([root, *paths])


def checkpoint_folder(spark: SparkSession) -> str:
    """The checkpoint folder that the session names. Where it names none, a temporary one, but only if driver and executors are one process."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-"))
    return sc.getCheckpointDir()


def new_folder(spark: SparkSession) -> str:
    """A folder of its own below the checkpoint folder."""
    return f"{checkpoint_folder(spark)}/{uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Materialised in the shared checkpoint folder, without its lineage."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def kept(df: DataFrame) -> DataFrame:
    """Written as Parquet to a folder of its own below the shared checkpoint folder and read from there: one pass, and what reads it knows its size and takes only the columns it needs."""
    path = new_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
