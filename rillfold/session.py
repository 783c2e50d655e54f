"""Session helpers shared by queries, tests and the benchmark."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", app: str = "rillfold", shuffle: int = 8) -> SparkSession:
    """A local session with the settings every operator assumes (UTC, AQE, Arrow)."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.driver.host", "127.0.0.1")
        .getOrCreate()
    )


_OWN: set[tuple[str, str]] = set()


def _own_folder(spark: SparkSession, base: str) -> str:
    """This application's folder below `base`, which its driver deletes when it ends."""
    app = spark.sparkContext.applicationId
    where = os.path.join(base, f"rillfold-{app}")
    if (app, base) not in _OWN:
        path = spark._jvm.org.apache.hadoop.fs.Path(where)
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        fs.mkdirs(path)
        fs.deleteOnExit(path)
        _OWN.add((app, base))
    return where


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder for `purpose` below the cluster's shared checkpoint folder, deleted when the application ends.

    The folder is read from ``spark.checkpoint.dir``. Only where that is unset and the master is
    a plain ``local`` one (tests) is a temporary folder used; anywhere else that is an error,
    since a machine-local folder isn't visible to the executors.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
        base = "file://" + tempfile.mkdtemp(prefix="rillfold-")
        spark.conf.set("spark.checkpoint.dir", base)
    return os.path.join(_own_folder(spark, base), f"{purpose}-{uuid.uuid4().hex}")


def written(spark: SparkSession, folder: str | None) -> bool:
    """Whether a table was written to a folder and is still there; someone may have cleared the shared folder."""
    if folder is None:
        return False
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def kept(df, purpose: str):
    """The rows of `df`, written to the shared folder once: for what is read several times, and to cut lineage."""
    spark = df.sparkSession
    where = shared_dir(spark, purpose)
    df.write.parquet(where)
    return spark.read.schema(df.schema).parquet(where)


def table(spark: SparkSession, sf_dir: str, name: str):
    """The table `name` of a data folder; Parquet, so filters and columns reach the scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
