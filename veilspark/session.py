"""Session defaults for local work; on a cluster the caller brings its own session."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int = 8, app: str = "veilspark") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config(PARTITIONS, str(cpus))  # tables of one file each
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")  # call sites of each expression cost a second a plan
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in spark.checkpoint.dir, or the context's own; a temporary folder only where both
    are unset and the master is local. On a cluster without a shared folder it is an error, as executors can't read each other's disks."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named is None:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("name a folder that all executors share in spark.checkpoint.dir")
        named = "file://" + tempfile.mkdtemp(prefix="veilspark-cut-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """`df` written to the shared folder and read back: a costly result is computed once, its lineage ends there, and lost
    executors don't lose it. The folder goes when the application ends, or earlier by `discard`."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/veilspark-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _folder(spark, path, lambda fs, at: fs.deleteOnExit(at))
    out = spark.read.schema(df.schema).parquet(path)
    out._veilspark_path = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes what `cut` wrote, once nothing reads it any more."""
    if path := getattr(df, "_veilspark_path", None):
        _folder(df.sparkSession, path, lambda fs, at: fs.delete(at, True))


def _folder(spark: SparkSession, path: str, act) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    act(at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at)


def ship_package(spark: SparkSession) -> None:
    """Gives the executors' Python workers this package, once a context, so that only the driver needs it installed."""
    sc = spark.sparkContext
    if getattr(sc, "_veilspark_shipped", False):
        return
    import shutil

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    folder = tempfile.mkdtemp(prefix="veilspark-")  # on the driver only; Spark serves the file to the executors
    at = os.path.join(folder, "src", "veilspark")
    shutil.copytree(os.path.join(root, "veilspark"), at, ignore=shutil.ignore_patterns("__pycache__"))
    sc.addPyFile(shutil.make_archive(os.path.join(folder, "veilspark"), "zip", os.path.join(folder, "src")))
    sc._veilspark_shipped = True


#: A setting of the session, not of the data: in so many partitions Python work is spread by one shuffle of its texts. Unset,
#: as on a cluster, whose tables have many files, the partitions of the scan stay; then no operator shuffles texts for it.
PARTITIONS = "spark.veilspark.partitions"


def spread(df: DataFrame, *by: str) -> DataFrame:
    """`df` in the partitions that the session names in PARTITIONS, by the columns `by`; as it is where it names none."""
    n = df.sparkSession.conf.get(PARTITIONS, None)
    return df if n is None else df.repartition(int(n), *by)
