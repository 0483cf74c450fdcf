"""Reading the tables of one dataset directory, and working storage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Lazy scan of ``<sf_dir>/<name>.parquet``; Catalyst prunes columns and pushes filters."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def working_folder(spark: SparkSession) -> str:
    """The shared folder for checkpoints.

    The cluster's ``spark.checkpoint.dir`` is used where it is set. Only where it is
    unset (local tests) a temporary folder of this machine is made and set.
    """
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        held = sc._jsc.sc().getCheckpointDir()
        folder = held.get() if held.isDefined() else tempfile.mkdtemp(prefix="bidloom-")
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(folder)
    return folder


def own_folder(spark: SparkSession) -> str:
    """Where this application keeps its tables: a folder of its own in the working folder."""
    return f"{working_folder(spark).rstrip('/')}/bidloom/{spark.sparkContext.applicationId}"


def cut(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder and read back: later stages neither
    recompute it nor depend on the executors that made it."""
    spark = df.sparkSession
    path = f"{own_folder(spark)}/{uuid.uuid4().hex}"
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.cut_path = path
    return out


def discard(*frames: DataFrame) -> None:
    """Deletes the tables of ``cut`` frames of which what was made is itself written: nothing reads them again."""
    for df in frames:
        if path := getattr(df, "cut_path", None):
            _delete(df.sparkSession, path)


def release(spark: SparkSession) -> None:
    """Deletes all working tables of this application; results not yet written elsewhere are lost with them."""
    _delete(spark, own_folder(spark))


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
