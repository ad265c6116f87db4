"""What the operators share: table access, the shared folder, and Arrow batches of bounded size."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What a Python task gets at once: rows, and bytes (with one row more, however long).
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": 1024, "spark.sql.execution.arrow.maxBytesPerBatch": 4 << 20}


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's folder for checkpoints; a temporary one only where a session on one machine names none (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="recollect-")
        spark.conf.set("spark.checkpoint.dir", named)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(named)
    return named


def tidy(spark: SparkSession) -> None:
    """Let go of the shuffle files and checkpoints of steps that nothing refers to any more.

    Executors keep them until the driver's garbage is collected, which a driver with little to do rarely does; an operator of
    many small steps would fill the executors' disks meanwhile.
    """
    gc.collect()
    spark._jvm.System.gc()


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint to the shared folder: later reads survive lost executors and don't recompute."""
    shared_dir(df.sparkSession)
    out = df.checkpoint()
    tidy(df.sparkSession)
    return out


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path for a table in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write as Parquet in the shared folder and read again: much smaller than a checkpoint, columns can be pruned."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path, compression="zstd")
    tidy(df.sparkSession)
    return df.sparkSession.read.parquet(path)


def map_batches(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow with batches of bounded size.

    The bounds are settings of the session that hold when the plan runs, so they stay set; a smaller one is left alone.
    """
    for key, most in BATCHES.items():
        now = df.sparkSession.conf.get(key, None)
        if now is None or not now.isdigit() or not 0 < int(now) <= most:
            df.sparkSession.conf.set(key, str(most))
    return df.mapInArrow(f, schema)


def quoted(name: str) -> Column:
    """A column by its name, whatever characters the name has."""
    return F.col("`" + name.replace("`", "``") + "`")
