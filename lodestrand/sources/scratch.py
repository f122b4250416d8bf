"""Cutting lineage: a reliable checkpoint in the folder that the cluster names."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; without it a local session uses the temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (base or f"{tempfile.gettempdir()}/lodestrand-checkpoint").rstrip("/")


def folder(spark: SparkSession, label: str) -> str:
    """A new folder's path in the shared one, with a name that Scratch.sweep knows."""
    return f"{shared(spark)}/{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """The rows of df, computed once into the shared folder."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(shared(df.sparkSession))
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Let shuffle files go that no plan at hand reads any more: Spark removes them once their owners are collected."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
