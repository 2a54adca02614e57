"""Intermediate tables in the folder that all executors share, and joins whose strategy follows a checked size."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stored bytes up to which a written table is broadcast; beyond it the join shuffles.
BROADCAST_BYTES = 6 << 20


def in_one_process(spark: SparkSession) -> bool:
    """Whether tasks run in the driver's process: true in local mode only."""
    master = spark.sparkContext.master
    return master.startswith("local") and not master.startswith("local-cluster")


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; a temporary one only in local mode, where it is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not in_one_process(spark):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="tallyloom-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def own_folder(spark: SparkSession) -> str:
    """This application's part of the shared folder; other applications' tables lie beside it."""
    return f"{shared_folder(spark)}/tallyloom/{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    """An unused path for an intermediate table."""
    return f"{own_folder(spark)}/tables/{name}-{uuid.uuid4().hex}"


def result_path(spark: SparkSession, name: str) -> str:
    """An unused path for a result that stays when intermediate tables are discarded."""
    return f"{own_folder(spark)}/results/{name}-{uuid.uuid4().hex}"


def discard_written(spark: SparkSession) -> None:
    """Delete this application's intermediate tables; results that still read them must be stored before. Tables of other applications and results stay."""
    delete_path(spark, f"{own_folder(spark)}/tables")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as a compressed table in the shared folder and read it back: its lineage is cut and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def stored_bytes(df: DataFrame) -> int:
    """Bytes of the files that df reads."""
    total = 0
    for name in df.inputFiles():
        fs, path = _fs(df.sparkSession, name)
        total += fs.getFileStatus(path).getLen()
    return total


def delete_path(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def join_checked(big: DataFrame, written: DataFrame, on: list[str], how: str, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Join big to a table that was written by materialize().

    The written side is broadcast if its stored size is at most ``limit`` (compressed: in memory it may take some times as much);
    beyond that both sides are shuffled and adaptive execution splits skewed keys.
    """
    side = F.broadcast(written) if stored_bytes(written) <= limit else written.hint("merge")
    return big.join(side, on, how)
