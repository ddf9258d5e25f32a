"""Session helpers: table loading, shared scratch folder, shipping the package to executors."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, read by Spark so that any Hadoop-compatible path works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A fresh path in the folder that driver and executors share.

    The cluster names it in ``spark.checkpoint.dir``; only where that is unset
    and all runs on this machine (tests) a temporary folder stands in.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="spark-graphband-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/graphband-{uuid.uuid4().hex}"


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage ends here
    and every executor, also a replacement of a lost one, can read the copy."""
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(*done: DataFrame | str | None) -> None:
    """Delete tables of ``materialise``, or shared folders, that nothing reads any more."""
    spark = SparkSession.getActiveSession()
    for x in done:
        path = x if isinstance(x, str) else getattr(x, "_scratch", None)
        if path and "/graphband-" in path:
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


_SHIPPED = "_graphband_shipped"


_BATCH, _USUAL, _OWN = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "8m"


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors once per context, as ``--py-files`` would.

    Batches that go to Python are bounded by bytes as well as by rows, unless
    the session says otherwise: a worker holds a few copies of one.
    """
    sc = spark.sparkContext
    if sc.getConf().get(_BATCH) is None and spark.conf.get(_BATCH) == _USUAL:
        spark.conf.set(_BATCH, _OWN)
    if getattr(sc, _SHIPPED, False):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    build = tempfile.mkdtemp(prefix="spark-graphband-zip-")
    shutil.copytree(here, f"{build}/src/graphband", ignore=shutil.ignore_patterns("__pycache__", "*.pyc"))
    sc.addPyFile(shutil.make_archive(f"{build}/graphband_package", "zip", f"{build}/src"))
    setattr(sc, _SHIPPED, True)
