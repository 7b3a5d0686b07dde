"""Session settings, table loading and lineage cuts shared by all plans."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def get_session(cores: str = "*", shuffle_partitions: int = 8, driver_memory: str = "6g") -> SparkSession:
    """A local session with the settings the plans assume: AQE on, UTC, Arrow transfer."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("linkweave")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", driver_memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as named in ``spark.checkpoint.dir``.

    Only where the session names none and all of it runs on this machine (tests) a temporary folder is made and set.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir names no folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="linkweave-")
        spark.conf.set("spark.checkpoint.dir", named)
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def run_dir(spark: SparkSession) -> str:
    """The folder of this application's tables within the shared folder."""
    return f"{shared_dir(spark)}/linkweave/{spark.sparkContext.applicationId}"


def release(spark: SparkSession) -> None:
    """Delete all tables that this application wrote with ``cut``; frames that read them are of no use afterwards."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(run_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame, name: str = "t") -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it again.

    Cuts the lineage, so that the loss of an executor costs no more than the step at hand, and makes
    whatever is used twice computed once.
    """
    spark = df.sparkSession
    path = f"{run_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with ``value`` as a column that is computed once a row: filters and projections that name it aren't merged with what computes it."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def filled(run: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """``run`` for mapInPandas without frames of no rows, neither in nor out: Arrow can't tell their columns' types."""

    def wrapped(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return (out for out in run(b for b in batches if len(b)) if len(out))

    return wrapped


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of a data folder: one parquet file or a folder of them."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
