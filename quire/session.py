"""Session helpers shared by all operators."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FEW = 200_000  # short rows (some 100 bytes each) that are broadcast; more are shuffled


def checkpoint_dir(spark: SparkSession) -> str:
    """Directory shared by all executors, as the cluster names it.

    ``spark.checkpoint.dir`` wins.  Only a session without it (tests, one
    machine) gets a folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(named)
        return named
    current = spark.sparkContext.getCheckpointDir()
    if current is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        own = tempfile.mkdtemp(prefix="quire-")
        atexit.register(shutil.rmtree, own, True)
        spark.sparkContext.setCheckpointDir(own)
        current = spark.sparkContext.getCheckpointDir()
    return str(current)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint of ``df``: survives lost executors, unlike a local one."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder: cuts lineage, and later reads take only the columns they need."""
    path = os.path.join(checkpoint_dir(df.sparkSession), f"table-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, most: int = FEW) -> DataFrame:
    """``df`` for a join: broadcast if it has at most ``most`` rows, which are counted, else as any other side.

    ``df`` should be cheap to count, as a table is.
    """
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def once(df: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct rows of ``df``, of which few are repeated: only rows whose keys are there twice are shuffled.

    Keys are counted by a hash of theirs; rows of equal hash are compared as a whole.
    """
    own = df.withColumn("_key", F.xxhash64(*keys))
    twice = small(written(own.groupBy("_key").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_key")))
    return own.join(twice, "_key", "left_anti").union(own.join(twice, "_key", "left_semi").distinct()).drop("_key")


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """Read one table of a scale directory."""
    return spark.read.parquet(os.path.join(sf_dir, f"{table}.parquet"))
