"""Work tables: lineage is cut by writing to the folder all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``.  Where it is unset and Spark runs in one process, as in tests, a temporary folder is set; a
    cluster without it has no folder that all executors share, and then this fails."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = tempfile.mkdtemp(prefix="textloom-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back; the files go when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/textloom-core/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_at = path
    return out


def uncut(*tables: DataFrame) -> None:
    """Remove work tables that nothing reads any more."""
    for df in tables:
        _remove(df.sparkSession, df._cut_at)


def _remove(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is None or spark.sparkContext._gateway is None:
        return  # the session has ended, and its owner cleans the folder
    try:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # noqa: BLE001  the JVM has ended before us
        pass
