"""Scratch tables in the folder that every executor shares.

Lineage is cut by writing Parquet below ``spark.checkpoint.dir``: a lost executor then costs a re-read, never a
recomputation of everything before. Only where that setting is absent does this module choose a folder of its own.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; without that setting, a temporary one in local mode alone.

    On a cluster the home folder of its default file system stands in, unless that is each machine's own disk: then
    there is no place that all executors share, and an error says so.
    """
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    app, master = spark.sparkContext.applicationId, spark.sparkContext.master
    if app not in _own:
        if master == "local" or master.startswith("local["):
            at = tempfile.mkdtemp(prefix="gleaner-")
            atexit.register(shutil.rmtree, at, ignore_errors=True)
            _own[app] = "file://" + at
        else:
            fs = spark.sparkContext._jvm.org.apache.hadoop.fs.FileSystem.get(spark._jsc.hadoopConfiguration())
            if fs.getUri().getScheme() == "file":
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            _own[app] = fs.getHomeDirectory().toString()
    return _own[app]


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh place in the shared folder; what is written there goes when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/gleaner/{name}-{uuid.uuid4().hex}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and return a reader of it."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Delete the scratch table that ``df`` reads; the caller knows that nothing will read it again."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for file in df.inputFiles()[:1]:
        path = jvm.org.apache.hadoop.fs.Path(file).getParent()
        if "/gleaner/" in path.toString():
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
